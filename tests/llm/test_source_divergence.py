import random
import re
from collections import Counter, defaultdict

from noonward.llm import source_divergence as sd

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "text string, lang string, source string"


def brute(rows, min_docs=3, top=200):
    rows = [tuple(x or "" for x in r) for r in rows]
    n, df, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for text, lang, source in rows:
        words = TERM.findall(text.translate(LOWER))
        groups[lang].add(source)
        n[lang, source].update(words)
        df[lang].update(set(words))
    out = []
    for lang, sources in groups.items():
        kept = sorted(t for t, c in df[lang].items() if c >= min_docs)
        whole = Counter({t: sum(n[lang, s][t] for s in sources) for t in kept})

        def shares(c):
            total = sum(c[t] for t in kept)
            return {t: 1 + 10**9 * (c[t] + 1) // (total + len(kept)) for t in kept}

        p, q = {s: shares(n[lang, s]) for s in sources}, shares(whole)
        for s in sources:
            pair = [(o, sum((p[s][t] - p[o][t]) ** 2 // p[o][t] for t in kept)) for o in sources if o != s]
            term = [(t, (p[s][t] - q[t]) ** 2 // q[t]) for t in kept if n[lang, s][t] and p[s][t] > q[t]]
            for part, items in (("pair", pair), ("term", term)):
                items.sort(key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, i, v, r) for r, (i, v) in enumerate(items, 1) if part == "pair" or r <= top]
    return sorted(out)


def found(spark, rows, schema=SCHEMA, **settings):
    return sorted(map(tuple, sd.audit(spark.createDataFrame(rows, schema), **settings).collect()))


def corpus(seed, n, sources=7, words=150):
    rng = random.Random(seed)
    terms = ["é" * (1 + i % 3) + f"{'xyz'[i % 3]}" * (i % 7) + chr(97 + i % 26) + chr(97 + i // 26) for i in range(words)]
    rows = []
    for _ in range(n):
        source = rng.randrange(sources)
        text = " ".join(rng.choice([str.upper, str.lower])(terms[min(int(rng.expovariate(0.03)) + 5 * source, words - 1)]) for _ in range(rng.randrange(60)))
        rows.append((text, rng.choice(["en", "de"]), f"s{source}"))
    return rows


def test_against_dense_sums(spark):
    rows = corpus(1, 200)
    assert found(spark, rows) == brute(rows)


def test_many_cells(spark, monkeypatch):
    rows = corpus(2, 300, sources=11)
    monkeypatch.setattr(sd, "GROUPS_PER_BLOCK", 3)
    monkeypatch.setattr(sd, "TERMS_PER_BLOCK", 16)
    monkeypatch.setattr(sd, "HELD_COUNTS", 50)
    assert found(spark, rows, top_terms=5) == brute(rows, top=5)


def test_odd_rows(spark):
    long = "wort " * 20_000
    rows = [
        (None, None, None), ("a b a", None, "s"), ("a b", "", "s"), ("a", None, ""), (long, "de", "x"), (long, "de", "x"), ("wort andere", "de", "y"),
        ("", "de", "z"), ("123 .,", "de", "w"), ("x", "fr", "only"), ("a\x00b A_B Ünï", "", "s"), ("nichts", "it", "p"), ("mehr", "it", "q"),
    ]
    got = found(spark, rows)
    assert got == brute(rows)
    assert ("it", "p", "pair", "q", 0, 1) in got and not any(r[0] == "fr" for r in got)


def test_ties_rank_by_the_bytes_of_the_item(spark):
    rows = [("é z a \U0001f600 ｚ", "en", "s")] * 3 + [("other", "en", "t")] * 3
    got = [r for r in found(spark, rows) if r[:3] == ("en", "s", "term")]
    assert got == [r for r in brute(rows) if r[:3] == ("en", "s", "term")]
    assert [r[3] for r in sorted(got, key=lambda r: r[5])] == ["a", "z", "é", "ｚ", "\U0001f600"]


def test_empty_table_and_clashing_names(spark):
    schema = f"{SCHEMA}, term string, n int, `group` int, PLACE int, kept string"
    assert found(spark, [], schema) == []
    rows = [("a b", "en", f"s{i % 2}", "mine", 1, 1, 1, "k") for i in range(6)]
    assert found(spark, rows, schema) == brute([r[:3] for r in rows])
