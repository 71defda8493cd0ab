import itertools
import random

from hypothesis import given, settings
from hypothesis import strategies as st

from noonward.llm import license_scan as ls

MIT = ls.NOTICES["MIT-notice"]


def is_increasing(pairs):
    return all(a < c and b < d for (a, b), (c, d) in zip(pairs, pairs[1:]))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 30), max_size=14))
def test_longest_increasing(values):
    got = ls.longest_increasing(values)
    assert all(values[a] < values[b] and a < b for a, b in zip(got, got[1:]))
    best = max((n for n in range(len(values) + 1) if any(all(x < y for x, y in zip(c, c[1:])) for c in itertools.combinations(values, n))), default=0)
    assert len(got) == best


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from("abcdefgh"), max_size=12), st.lists(st.sampled_from("abcdefgh"), max_size=12))
def test_alignment_is_a_common_subsequence(a, b):
    pairs = ls.align(a, b)
    assert is_increasing(pairs) and all(a[i] == b[j] for i, j in pairs)
    if len(set(a)) == len(a) and len(set(b)) == len(b):  # all words are anchors: the longest one
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, j in itertools.product(range(len(a)), range(len(b))):
            table[i + 1][j + 1] = table[i][j] + 1 if a[i] == b[j] else max(table[i][j + 1], table[i + 1][j])
        assert len(pairs) == table[-1][-1]


def test_anchors_then_gaps():
    a = "x x one y two y three".split()
    b = "x one y two y three x".split()
    assert [a[i] for i, _ in ls.align(a, b)] == "x one y two y three".split()


def finds(text, coverage=0.9, notices=None):
    made = [ls.Template.of(n, t, coverage) for n, t in (notices or ls.NOTICES).items()]
    return [(m["license"], m["matched"], text[m["start"] : m["end"]]) for m in ls.scan_text(text, made)]


def test_notices_in_running_text():
    text = "Some text. THIS  project is\nlicensed, under the MIT licence -- no: License! And more of the project under the sun."
    assert finds(text) == [("MIT-notice", 8, "THIS  project is\nlicensed, under the MIT licence -- no: License")]
    assert finds("nothing of the kind under the sun, licensed or not") == []


def test_every_place_is_found():
    noise = " the project of this is under the and the mit ".split()
    rng = random.Random(1)
    filler = lambda n: " ".join(rng.choice(noise[:5]) for _ in range(n))
    for gap in (0, 1, 5, 50):
        text = f" {filler(gap)} ".join([MIT] * 4)
        assert [f[0] for f in finds(text)].count("MIT-notice") == 4, gap


def test_prefilter_loses_nothing():
    """Texts cut from a notice: found just where enough of its words are there."""
    rng = random.Random(2)
    template = ls.Template.of("t", ls.NOTICES["GPL-header"], 0.8)
    for _ in range(60):
        words = [w for w in template.words if rng.random() > 0.2]
        text = " ".join(["before"] * 30 + words + ["after"] * 30)
        matched = len(ls.align(words, list(template.words)))
        got = finds(text, 0.8, {"t": ls.NOTICES["GPL-header"]})
        assert bool(got) == (matched >= template.least)


def test_odd_rows_empty_table_and_clashing_names(odd, documents, clashing):
    rows = ls.scan(odd).collect()
    assert len(rows) == 12 and all(r.licenses == [] for r in rows)
    assert ls.scan(documents([])).count() == 0
    df = ls.scan(clashing([(1, f"x {MIT}"), (1, f"x {MIT}")], "LICENSES", "start"))
    assert [[(m.license, m.start, m.coverage) for m in r.licenses] for r in df.collect()] == [[("MIT-notice", 2, 1.0)]] * 2
    assert ls.scan(documents([(1, MIT)]), {"empty": "", "dots": "..."}).first().licenses == []


def test_usual_wordings_of_short_notices():
    said = {
        "Released under the MIT License.": "MIT-released",
        "Distributed under the terms of the MIT license.": "MIT-released",
        "This project is available under the MIT License.": "MIT-notice",
        "Released under CC BY-SA 4.0.": "CC-BY-SA-4.0",
        "Licensed under the Apache License 2.0.": "Apache-2.0",
        "Distributed under the Apache License, Version 2.0.": "Apache-2.0",
        "Available under the GNU General Public License, version 3.": "GPL-3.0-released",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.": "CC-BY-4.0-long",
    }
    for line, name in said.items():
        assert [f[0] for f in finds(f"The text before. {line} The text under it.")] == [name], line
    text = " And so on. ".join(said)
    assert [f[0] for f in finds(text)] == list(said.values())


def test_short_notices_keep_the_name_of_the_license():
    for line in ("Released under the BSD License.", "Licensed under the Apache License, Version 1.1.", "Licensed under CC BY-ND 4.0.", "the MIT license"):
        assert finds(line) == [], line
    assert [f[0] for f in finds("Licensed under the MIT License or the Apache License, Version 2.0.")] == ["Apache-2.0", "MIT-released"]
    assert finds("Distributed under the MIT License.", coverage=1.0) == []


def test_license_lines_of_the_test_tables(spark, data_folder):
    docs = spark.read.parquet(f"{data_folder}/documents.parquet").select("doc_id", "text")
    said = docs.filter(r"text rlike '(Released|[Ll]icensed) under [^.\\n]{0,40}(License|CC BY)'")
    found = ls.scan(said).filter("size(licenses) = 0")
    assert said.count() > 30 and found.count() == 0
