import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from noonward.llm import quality_rules as qr


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = list(zip(words, words[1:], words[2:]))
    often = Counter(windows)
    covered = {k + j for k, w in enumerate(windows) if often[w] > 1 for j in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    symbols = sum(c in "#*$%&|<>" for c in text)
    return len(words), sum(map(len, words)), symbols, len(lines), len(lines) - len(set(lines)), len(covered)


def test_counts(odd, documents):
    rng = random.Random(3)
    texts = ["".join(rng.choice("ab# \n\t é") for _ in range(rng.randrange(120))) for _ in range(150)]
    texts += ["a b c a b c a b c", "a a a a", "a b c d a b c", " a\n a\na\n\n\n a", "A.\nB!\nc"]
    df = odd.unionByName(documents(list(enumerate(texts))))
    rows = qr.measure(df).collect()
    assert len(rows) == 12 + len(texts)
    for r in rows:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_lines, r.n_dup_lines, r.n_repeat_words) == brute(r.text), r.text
        assert 0 <= r.n_upper <= r.n_letters <= r.word_chars and r.n_ended_lines <= r.n_lines


def test_estimation_finds_the_rules_accuracies():
    rng = random.Random(1)
    truth, patterns, labels = ((0.95, 0.6), (0.9, 0.7), (0.98, 0.4), (0.9, 0.5)), Counter(), []
    for _ in range(20_000):
        good = rng.random() < 0.85
        votes = tuple(0 if rng.random() < 0.2 else (1 if (rng.random() < (g if good else 1 - b)) else -1) for g, b in truth)
        patterns[votes] += 1
        labels.append((votes, good))
    model = qr.fit(list(patterns.items()))
    assert abs(model.prior - 0.85) < 0.05
    for (g, b), mine_good, mine_bad in zip(truth, model.right_if_good, model.right_if_bad):
        assert abs(g - mine_good) < 0.04 and abs(b - mine_bad) < 0.15
    right = sum((qr.log_odds(model, v) >= 0) == good for v, good in labels)
    all_must_pass = sum((-1 not in v) == good for v, good in labels)
    assert right > all_must_pass


def test_posterior_agrees_with_brute_force(documents):
    words = "the quick brown fox jumps over a lazy dog and runs through wide green fields until night falls".split()
    rng = random.Random(5)
    rows = [(i, " ".join(rng.choice(words) + str(rng.randrange(999)) for _ in range(80)) + ".") for i in range(60)]
    rows += [(100 + i, "BUY!!! " * 30 + "|" * 50) for i in range(6)] + [(200 + i, "\n".join(["$$$ %%%"] * 60)) for i in range(4)]
    judged = qr.judge(qr.measure(documents(rows))).collect()
    patterns = Counter(tuple(r.votes) for r in judged)
    model = qr.fit(list(patterns.items()))
    for r in judged:
        p = 1 / (1 + math.exp(-qr.log_odds(model, tuple(r.votes))))
        assert r.p_good == pytest.approx(p)
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert r.kept == (not r.base_failed and p >= 0.5)
    assert {r.kept for r in judged if r.doc_id < 100} == {True}
    assert {r.kept for r in judged if r.doc_id >= 200} == {False}


def test_nulls_in_the_votes_of_a_rule_abstain(documents):
    own = (qr.Rule("none", "null > 1", "null > 1"), qr.Rule("some", "n_words > 1", "n_words = 1"))
    rows = qr.judge(qr.measure(documents([(1, "a"), (2, "a b"), (3, None)])), own).orderBy("doc_id").collect()
    assert [r.votes for r in rows] == [[0, 1], [0, -1], [0, 0]]


def test_empty_table_clashing_names_and_no_python(documents, clashing):
    assert qr.judge(qr.measure(documents([]))).count() == 0
    df = qr.judge(qr.measure(clashing([(1, "a b")], "n_words", "VOTES", "kept", "_words", "p_good")))
    row = df.first()
    assert (row.n_words, row.kept, row._words) == (2, False, "mine") and len({c.lower() for c in df.columns}) == len(df.columns)
    plan = qr.measure(documents([(1, "a")]).select(F.col("text")))._jdf.queryExecution().toString()
    assert "Python" not in plan.replace("PythonRDD", "") and "Arrow" not in plan


def test_labelled_documents(spark, data_folder):
    from noonward.llm.common import table

    docs = table(spark, data_folder, "documents").select("doc_id", "text")
    judged = qr.judge(qr.measure(docs).drop("text")).join(table(spark, data_folder, "labels"), "doc_id").collect()
    good = [r.kept for r in judged if r.quality == 1 and not r.base_failed]
    bad = [r.kept for r in judged if r.quality == 0]
    assert sum(good) >= 0.98 * len(good) and sum(bad) <= 0.4 * len(bad)
