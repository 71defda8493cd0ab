import random
import re

import pytest

from noonward.llm import decontaminate as dc

ITEM = "The quick brown fox jumps over the lazy dog and then runs far away, into the deep green forest."


def distance_to_substring(item, text):
    """Least edit distance of item to any substring of text, by the full matrix."""
    row = list(range(len(item) + 1))
    best = row[-1]
    for c in text:
        new = [0]
        for i, d in enumerate(item, 1):
            new.append(min(row[i] + 1, new[-1] + 1, row[i - 1] + (d != c)))
        row, best = new, min(best, new[-1])
    return best


def edited(rng, text, n):
    for _ in range(n):
        i = rng.randrange(len(text))
        text = text[:i] + rng.choice(["", "x", text[i] + "q"]) + text[i + 1 :]
    return text


def test_distances_as_by_the_full_matrix():
    rng = random.Random(1)
    for _ in range(150):
        item = dc.Item.of(1, "".join(rng.choice("ab") for _ in range(rng.randrange(1, 90))), 0.5)
        text = "".join(rng.choice("ab") for _ in range(rng.randrange(1, 60)))
        assert min(dc.distances(item, text)) == min(distance_to_substring(item.text, text), len(item.text)) or not text
        found = dc.best_match(item, text)
        if found:
            d, low, high = found
            whole = list(dc.distances(item, text[low:high], anchored=True))
            assert (whole[-1] if whole else len(item.text)) == d


def test_finds_are_those_of_all_pairs(documents, spark):
    rng = random.Random(7)
    words = [f"{a}{b}" for a in "bcdfglmprst" for b in ("an", "or", "ing", "el")]
    items = [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(4, 30)))) for i in range(12)]
    rows = []
    for i in range(120):
        text = " ".join(rng.choice(words) for _ in range(rng.randrange(0, 60)))
        if i % 3 == 0:
            item = rng.choice(items)[1]
            text += " " + edited(rng, item, rng.randrange(0, max(1, len(item) // 10))) + " " + text
        rows.append((i, text))
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.distance for r in dc.find_leaks(documents(rows), benchmark).collect()}
    want = {}
    for doc_id, text in rows:
        for item_id, item in items:
            item, whole = dc.normalised(item), dc.normalised(text)
            if len(item.split()) >= 5 and (d := distance_to_substring(item, whole)) <= int(len(item) * 0.0625):
                want[doc_id, item_id] = d
    assert got == want and len(want) > 20 and any(want.values())


def test_case_punctuation_and_places(documents, spark):
    text = "é😀 Before: THE QUICK, brown fox -- jumps over\nthe lazy dog; and then runs far away into the deap green forest! After."
    leak = dc.find_leaks(documents([(1, text), (1, text)]), spark.createDataFrame([(5, ITEM), (5, ITEM)], "item_id long, text string")).collect()
    assert [(r.doc_id, r.item_id, r.distance, r.matches) for r in leak] == [(1, 5, 1, 1)] * 2
    assert text[leak[0].start : leak[0].end].startswith("THE QUICK") and text[leak[0].start : leak[0].end].endswith("forest")


def test_odd_rows(odd, spark):
    items = [(1, None), (2, ""), (None, ITEM), (3, "too few words"), (4, "word " * 30), (5, "!!! ..."), (6, "x" * 50)]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    found = dc.with_leaks(odd, benchmark).collect()
    assert len(found) == 12
    assert {r.doc_id for r in found if r.leaks} == {4, 5} and {x.item_id for r in found for x in r.leaks} == {4}


def test_empty_tables_and_clashing_names(documents, clashing, spark):
    benchmark = spark.createDataFrame([(5, ITEM, "x")], "item_id long, text string, item string")
    assert dc.find_leaks(documents([]), benchmark).count() == 0
    assert dc.find_leaks(documents([(1, ITEM)]), benchmark.filter("item_id < 0")).count() == 0
    df = dc.with_leaks(clashing([(1, ITEM)], "LEAKS", "item_id"), benchmark)
    assert [x.item_id for x in df.first().leaks] == [5] and df.first().item_id == "mine"


def test_items_in_several_blocks(documents, spark, monkeypatch):
    items = [(i, re.sub("quick", f"quick{'abcdefgh'[i] * 12}", ITEM)) for i in range(8)]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    docs = documents([(i, f"so {t} yes") for i, t in items])
    whole = sorted(dc.find_leaks(docs, benchmark).collect())
    monkeypatch.setattr(dc, "BLOCK_CHARS", 300)
    assert sorted(dc.find_leaks(docs, benchmark).collect()) == whole and len(whole) >= 8


@pytest.mark.parametrize("text", ["İstanbul ǅ", "a_b-c", "ß1 2"])
def test_places_fit_the_normalised_text(text):
    whole, starts, ends = dc.normalised_places(text)
    assert whole == dc.normalised(text) and len(whole) == len(starts) == len(ends)


def test_items_of_few_words_and_without_blanks(documents, spark):
    items = [(1, "Who discovered penicillin?"), (2, "中国的首都是哪里?"), (3, "Paris"), (4, ITEM), (5, "What is 2+2?"), (6, "北京")]
    texts = ["Q: who discovered Penicillin! A", "whoever and who discovered penicillins", "他问中国的首都是哪里吗", "in Paris today", "who discovered penicillin"]
    texts += ["So: what is 2 + 2?", "what is 2+22", "comparisons", "在北京吗", "北京"]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    found = dc.find_leaks(documents(list(enumerate(texts))), benchmark).collect()
    assert {(r.doc_id, r.item_id, texts[r.doc_id][r.start : r.end]) for r in found} == {
        (0, 1, "who discovered Penicillin"), (2, 2, "中国的首都是哪里"), (4, 1, "who discovered penicillin"), (3, 3, "Paris"),
        (5, 5, "what is 2 + 2"), (8, 6, "北京"), (9, 6, "北京"),
    }
