import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from noonward.llm import lexical_search as ls

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def brute(docs, items, k):
    """(item_id, rank, doc_id, score) by scoring every document."""
    counts = [(i, Counter(terms(t))) for i, t in docs if terms(t)]
    n, total = len(counts), sum(sum(c.values()) for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    out = []
    for item_id, text in set(items):
        scored = []
        for doc_id, c in counts:
            m = 50 + 50 * sum(c.values()) * n // total
            own = [t for t in set(terms(text)) if t in c]
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 20 * m)) for t in own)
            if score > 0:
                scored.append((-score, doc_id is None, doc_id))
        out += [(item_id, r, d, -s) for r, (s, _, d) in enumerate(sorted(scored, key=lambda x: (x[0], x[1], x[2] or 0))[:k], 1)]
    return sorted(out, key=str)


def found(spark, documents, docs, items, k):
    table = spark.createDataFrame(items, "item_id long, text string")
    return sorted(map(tuple, ls.ranked_search(documents(docs), table, k).collect()), key=str)


def corpus(seed, n=300):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(120)] + ["Über", "ÉTÉ", "naïve"]
    pick = lambda: words[min(int(rng.expovariate(0.04)), len(words) - 1)]
    docs = [(rng.randrange(10**6), " ".join(pick() for _ in range(rng.choice([1, 5, 30, 200])))) for _ in range(n)]
    items = [(i, ", ".join(pick().upper() for _ in range(rng.randrange(1, 14)))) for i in range(25)]
    return docs, items


def test_against_all_scores(spark, documents, monkeypatch):
    docs, items = corpus(1)
    docs += [(10**7 + i, docs[0][1]) for i in range(90)] + [(10**8, docs[1][1])] * 3
    monkeypatch.setattr(ls, "RANGE_ROWS", 40)
    monkeypatch.setattr(ls, "BUCKET_POSTINGS", 300)
    for k in (1, 7, 50):
        assert found(spark, documents, docs, items, k) == brute(docs, items, k)


def test_several_blocks_of_items(spark, documents, monkeypatch):
    docs, items = corpus(2, 60)
    monkeypatch.setattr(ls, "BLOCK_CHARS", 200)
    assert found(spark, documents, docs, items, 5) == brute(docs, items, 5)


def test_odd_rows(spark, odd):
    docs = [(r.doc_id, r.text) for r in odd.collect()]
    items = [(1, "word X 7"), (1, "a b"), (1, "a b"), (2, None), (3, ""), (4, ".,;"), (None, "c"), (5, "Ünï 5 \U0001f600\U0001f600"), (6, "nowhere")]
    table = spark.createDataFrame(items, "item_id long, text string")
    got = sorted(map(tuple, ls.ranked_search(odd, table, 50).collect()), key=str)
    assert got == brute(docs, items, 50)
    assert {r[0] for r in got} == {1, None, 5}


def test_empty_tables_and_clashing_names(spark, documents, clashing):
    items = spark.createDataFrame([(1, "a", "x")], "item_id long, text string, doc_id string")
    assert ls.ranked_search(documents([]), items).count() == 0
    assert ls.ranked_search(documents([(1, "a")]), items.limit(0)).count() == 0
    df = clashing([(1, "a b"), (2, "b c")], "query", "length", "terms", "N", "score")
    assert [tuple(r)[:3] for r in ls.ranked_search(df, items).collect()] == [(1, 1, 1)]


@settings(max_examples=150, deadline=None)
@given(st.integers(0, 10**6), st.sampled_from([1, 2, 5, 20]))
def test_no_document_is_pruned_that_reaches_the_least_score(seed, heavy):
    rng = np.random.default_rng(seed)
    sizes = rng.integers(1, 12, 40)
    ends = np.concatenate([[0], np.cumsum(sizes)])
    own = np.concatenate([rng.choice(30, n, replace=False) for n in sizes])
    impacts = rng.integers(1, 10**6, len(own))
    length = np.sqrt(np.add.reduceat(impacts.astype(float) ** 2, ends[:-1]))
    bucket = ls.Bucket(length, ends, own, impacts)
    q = ls.Query.of(rng.choice(30, 9, replace=False), rng.integers(0, 20_000, 9))
    assert q.heavy <= ls.HEAVIEST
    scores = bucket.scores(q, np.arange(40))
    weights = dict(zip(q.terms.tolist(), q.weights.tolist()))
    assert scores.tolist() == [
        sum(weights.get(int(t), 0) * int(i) for t, i in zip(own[a:b], impacts[a:b])) for a, b in zip(ends[:-1], ends[1:])
    ]
    least = int(np.sort(scores)[-heavy])
    assert set(np.flatnonzero(scores >= least)) <= set(bucket.candidates(q, least))


def test_short_vectors_are_skipped_whole():
    bucket = ls.Bucket(np.array([5.0, 4.0]), np.array([0, 1, 2]), np.array([0, 1]), np.array([5, 4]))
    q = ls.Query.of(np.array([0]), np.array([10]))
    assert bucket.candidates(q, 51).tolist() == [] and bucket.candidates(q, 50).tolist() == [0]


@pytest.mark.parametrize("text", ["", "a1 B-c_é. x\x7f\x1cy", "ÄÖ1Z"])
def test_terms(text):
    assert [t.decode() for t in ls.terms_of(text)] == terms(text)
