import random
import re
import time
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from noonward.llm import jaccard_join as jj
from noonward.llm.components import components

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, words):
    own = [w.translate(LOWER) for w in re.findall(r"[^\x20\x09-\x0D]+", text or "")]
    if not own:
        return frozenset()
    size = min(words, len(own))
    return frozenset(tuple(own[i : i + size]) for i in range(len(own) - size + 1))


def brute(rows, s):
    """Component per row, by all pairs of rows with a doc_id."""
    sets = [shingles(t, s.words) for _, t in rows]
    label = list(range(len(rows)))

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            both = rows[i][0] is not None and rows[j][0] is not None
            if (a == b and a) or (both and a and b and 100 * len(a & b) >= s.percent * len(a | b)):
                label[root(i)] = root(j)
    least = defaultdict(list)
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            least[root(i)].append(doc_id)
    return [
        (doc_id, len(sets[i]), (min(least[root(i)]) if least[root(i)] else None) if sets[i] else doc_id)
        for i, (doc_id, _) in enumerate(rows)
    ]


def found(documents, rows, s):
    return sorted(map(tuple, jj.jaccard_groups(documents(rows), s).collect()), key=str)


def edited(rng, words, n):
    words = list(words)
    for _ in range(n):
        words[rng.randrange(len(words))] = f"e{rng.randrange(10**6)}"
    return words


def corpus(seed, families=12, members=8, hot=None):
    rng = random.Random(seed)
    rows, i = [], 0
    for _ in range(families):
        base = [f"w{rng.randrange(4000)}" for _ in range(rng.randrange(6, 150))]
        for _ in range(members):
            text = edited(rng, base, rng.randrange(0, max(2, len(base) // 18)))
            rows.append((i, " ".join((hot or []) + text)))
            i += 3
    rng.shuffle(rows)
    return rows


SMALL = dict(frequent=6, few=3, block=400, per_match=8)


@pytest.mark.parametrize(
    "seed, s",
    [
        (1, jj.Settings()),
        (2, jj.Settings(words=4, percent=85)),
        (3, jj.Settings(words=2, percent=60, **SMALL)),
        (4, jj.Settings(words=1, percent=50, **SMALL)),
        (5, jj.Settings(words=3, percent=90, listed=20, frequent=3, few=2, block=100, per_match=4)),
    ],
)
def test_against_all_pairs(documents, seed, s):
    hot = [f"hot{i}" for i in range(25)]
    rows = corpus(seed) + [(10_000 + i, t) for i, t in corpus(seed + 50, families=6, hot=hot)]
    rows += [(20_000 + i, " ".join(hot)) for i in range(10)] + [(30_000 + i, " ".join([*hot, f"x{i}"])) for i in range(10)]
    assert found(documents, rows, s) == sorted(brute(rows, s), key=str)


def test_exactly_at_the_limit(documents):
    s = jj.Settings(words=1, percent=80)
    words = [f"w{i}" for i in range(12)]
    rows = [(1, " ".join(words[:8])), (2, " ".join(words[:10])), (3, " ".join(words[:12]))]
    assert found(documents, rows, s) == [(1, 8, 1), (2, 10, 1), (3, 12, 1)]
    rows = [(1, " ".join(words[:7])), (2, " ".join(words[:9]))]
    assert found(documents, rows, s) == [(1, 7, 1), (2, 9, 2)]


def test_odd_rows(odd):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    got = sorted(map(tuple, jj.jaccard_groups(odd).collect()), key=str)
    assert got == sorted(brute(rows, jj.Settings()), key=str)


def test_rows_without_id(documents):
    rows = [(None, "a b c d e f"), (None, "lonely words that nobody else has here"), (7, "a b c d e f"), (None, "a b c d e f")]
    assert found(documents, rows, jj.Settings()) == sorted([(None, 2, 7), (None, 3, None), (7, 2, 7), (None, 2, 7)], key=str)


def test_empty_table_and_clashing_names(documents, clashing):
    assert jj.jaccard_groups(documents([])).count() == 0
    df = clashing([(1, "A b"), (2, "a B"), (3, "")], "n", "member", "prefix", "component_id", "cluster")
    assert sorted(map(tuple, jj.jaccard_groups(df).collect())) == [(1, 1, 1), (2, 1, 1), (3, 0, 3)]


@settings(max_examples=200, deadline=None)
@given(st.data())
def test_prefixes_lose_no_link(data):
    """Similar sets share as many prefix members as the smaller of their q, whatever members are listed."""
    s = jj.Settings(percent=data.draw(st.sampled_from([50, 80, 85])), per_match=data.draw(st.sampled_from([3, 8, 32])))
    base = data.draw(st.sets(st.integers(0, 400), min_size=1, max_size=80))
    other = (base - data.draw(st.sets(st.sampled_from(sorted(base)), max_size=12))) | data.draw(st.sets(st.integers(401, 500), max_size=12))
    listed = np.array(sorted(data.draw(st.sets(st.integers(0, 500), max_size=300))), np.uint64)
    if not other or 100 * len(base & other) < s.percent * len(base | other):
        return
    a, b = (jj.prefix_of(np.array(sorted(x), np.uint64), s, listed) for x in (base, other))
    least = int(min(s.base_matches(len(base)), s.base_matches(len(other))))
    assert len(np.intersect1d(a, b)) >= least >= max(s.needed(len(base)), s.needed(len(other)), 1)


def test_linked_joins_up_what_all_pairs_join():
    rng = random.Random(9)
    sets = [np.array(sorted(rng.sample(range(40), rng.randrange(5, 25))), np.uint64) for _ in range(150)]
    links = jj.linked(list(range(150)), sets, 50)
    label = list(range(150))

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for a, b in links:
        shared = len(np.intersect1d(sets[a], sets[b]))
        assert 100 * shared >= 50 * (len(sets[a]) + len(sets[b]) - shared) and root(a) != root(b)
        label[root(a)] = root(b)
    for i in range(150):
        for j in range(i):
            shared = len(np.intersect1d(sets[i], sets[j]))
            if 2 * shared >= len(sets[i]) + len(sets[j]) - shared:
                assert root(i) == root(j)


def test_shingles_are_runs_of_words():
    rng = random.Random(4)
    texts = ["", " \t\n", "a", "A b", "word " * 3000, " lead and trail ", "\v\f\r\n x", "\x00 \x00\x00 a\x00", "Ünï 12,5 \u00a0\u2003 \x1c \U0001f600"]
    texts += ["".join(rng.choice("abAB \n\t\x00\x1c é") for _ in range(rng.randrange(60))) for _ in range(300)]
    texts += [" ".join("z" * rng.randrange(jj.LONG - 9, jj.LONG + 9) for _ in range(rng.randrange(9))) for _ in range(100)]
    for words in (1, 2, 5):
        sets = [m.tobytes() for m in jj.shingle_sets(texts, words)]
        want = [shingles(t, words) for t in texts]
        assert [len(m) // 8 for m in sets] == [len(w) for w in want]
        assert len(set(sets)) == len(set(want)) == len(set(zip(sets, want)))
        for _ in range(500):
            i, j = rng.randrange(len(texts)), rng.randrange(len(texts))
            assert len(np.intersect1d(np.frombuffer(sets[i], np.uint64), np.frombuffer(sets[j], np.uint64))) == len(want[i] & want[j])


def quoting(seed, n, lines, own):
    """Sets of one to four of so many lines, some far more common than others, and a few members of their own."""
    rng = random.Random(seed)
    pool = [[rng.getrandbits(63) for _ in range(12)] for _ in range(lines)]
    picked = [{int(lines * rng.random() ** 2) for _ in range(rng.randrange(2, 5))} for _ in range(n)]
    return [{m for i in lines for m in pool[i]} | {rng.getrandbits(63) for _ in range(own)} for lines in picked]


def test_sets_that_quote_common_lines_are_not_all_compared():
    """Before, each of the sets was held against all others of its cluster: over a minute."""
    sets = [np.array(sorted(m), np.uint64) for m in quoting(6, 20_000, lines=400, own=9)]
    began = time.process_time()
    assert jj.linked(list(range(len(sets))), sets, 85) == []
    assert time.process_time() - began < 20


def test_large_clusters_are_split_by_what_is_rare_in_them(documents, monkeypatch):
    s = jj.Settings(words=1, percent=80, **(SMALL | {"block": 1000}))
    rng = random.Random(7)
    texts = [[f"m{m}" for m in sorted(x)] for x in quoting(7, 150, lines=20, own=6)]
    texts += [edited(rng, texts[k], 1) for k in range(0, 150, 10)]
    family = [f"f{k}" for k in range(60)]
    texts += [edited(rng, family, 3) for _ in range(40)]  # linked throughout, so it stays large
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    seen, blocks = [], jj._blocks

    def largest(clustered, s):
        own = clustered.filter("n <> 60").groupBy("cluster").sum("n").agg({"sum(n)": "max"}).first()[0]
        seen.append(own)
        return blocks(clustered, s)

    monkeypatch.setattr(jj, "_blocks", largest)
    assert found(documents, rows, s) == sorted(brute(rows, s), key=str)
    assert seen[0] <= s.block


def test_components(spark):
    chain = [(i, i + 1) for i in range(100, 160)] + [(5, 3), (3, 9), (7, 7), (None, 4), (9, 5)]
    df = spark.createDataFrame(chain, "a long, b long")
    got = dict(map(tuple, components(df).collect()))
    assert got == {i: 100 for i in range(100, 161)} | {3: 3, 5: 3, 9: 3}
    assert components(df.filter("a < 0")).count() == 0


def test_several_texts_under_one_id(documents):
    """Long and short texts share their ids; no link of the short ones is lost."""
    s = jj.Settings(words=1, percent=50)
    rng = random.Random(8)
    rows = []
    for i in range(12):
        base = [f"s{i}w{k}" for k in range(8)]
        rows += [(i, " ".join(base)), (100 + i, " ".join([*base[:6], "x", "y"]))]
        long = [f"l{i % 3}w{k}" for k in range(300)]
        rows += [(i, " ".join(edited(rng, long, 20))), (100 + i, " ".join(edited(rng, long, 30)))]
    assert found(documents, rows, s) == sorted(brute(rows, s), key=str)


def test_one_of_each_keeps_other_texts_of_an_id(documents):
    text = " ".join(f"w{i}" for i in range(40))
    other = " ".join(f"v{i}" for i in range(40))
    rows = [(5, text), (5, other), (5, other), (3, text + " more"), (9, "quite different words here now"), (9, other + " end"),
            (None, text), (None, text), (7, ""), (7, None), (8, "")]
    got = sorted(((r.doc_id, r.text) for r in jj.one_of_each(documents(rows)).collect()), key=str)
    want = [(5, other), (3, text + " more"), (9, "quite different words here now"), (None, text), (None, text), (7, ""), (8, "")]
    assert [r if r[1] else (r[0], "") for r in got] == sorted(want, key=str)
