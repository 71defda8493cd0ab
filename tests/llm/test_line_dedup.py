import random
import re

from noonward.llm import line_dedup as ld

BLANKS = " \t\n\r\x0b\x0c"


def brute(rows, min_words):
    """(doc_id, removed, kept_text) per row, by one pass in the order of doc_id."""
    first, out = {}, [None] * len(rows)
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0))
    for i in order:
        doc_id, text = rows[i]
        whole, at, own, marks = text or "", 0, set(), []
        for part in re.findall(r"\n|[^\n.!?]*[.!?]+|[^\n.!?]+", whole):
            words = re.sub("[A-Z]+", lambda m: m.group().lower(), part).encode().split()
            if words:
                key = b" ".join(words)
                low, high = at + len(part) - len(part.lstrip(BLANKS)), at + len(part.rstrip(BLANKS))
                marks.append((first.setdefault(key, doc_id) != doc_id or key in own, len(words), low, high))
                own.add(key)
            at += len(part)
        assert at == len(whole)
        told = "".join("x" if m[0] else "." for m in marks)
        runs = [marks[m.start() : m.end()] for m in re.finditer("x+", told)]
        gone = [(r[0][2], r[-1][3]) for r in runs if sum(m[1] for m in r) >= min_words]
        kept = "".join(c for k, c in enumerate(whole) if not any(a <= k < b for a, b in gone)) if len(whole) < 5_000 else None
        out[i] = (doc_id, gone, kept if text is not None else None)
    return out


def found(df, min_words):
    rows = ld.remove_repeats(df, min_words).collect()
    return [(r.doc_id, [tuple(s) for s in r.removed], r.kept_text if r.text is None or len(r.text) < 5_000 else None) for r in rows]


def test_against_one_pass(documents):
    rng = random.Random(3)
    sentences = [" ".join(rng.choice("abcde") * rng.randrange(1, 3) for _ in range(rng.randrange(1, 7))) for _ in range(30)]
    rows = []
    for i in range(80):
        parts = [rng.choice([str.upper, str.lower])(rng.choice(sentences)) + rng.choice([". ", ".\n", "! ", "\n", " "]) for _ in range(rng.randrange(9))]
        rows.append((i * 7 % 80, "é " + "".join(parts)))
    for min_words in (1, 5, 9):
        assert sorted(found(documents(rows), min_words), key=str) == sorted(brute(rows, min_words), key=str)


def test_a_passage_of_short_sentences_is_cut_out_whole(documents):
    """It begins in the middle of a line, goes over several lines, and none of its sentences has five words."""
    passage = "It rained. Who knew that? Nobody did!\nThe cat slept on. So did he.\n\nTime went by. It was late now. Good night."
    rows = [(2, f"Some words before it all. {passage} And some words after that. Nobody did!"), (1, f"Quite other text begins here now. {passage}")]
    got = {r.doc_id: r.kept_text for r in ld.remove_repeats(documents(rows)).collect()}
    assert got == {1: rows[1][1], 2: "Some words before it all.  And some words after that. Nobody did!"}


def test_lone_sentences_and_short_lines_stay(documents):
    common = "All rights reserved."
    rows = [(i, f"{common}\nText number {i} has its own words. As we all know, it is so.\n{common}") for i in range(30)]
    assert all(r.kept_text == r.text and not r.removed for r in ld.remove_repeats(documents(rows)).collect())


def test_repeated_lines_and_paragraphs(documents):
    line = "one line of twenty words " * 4
    paragraph = f"{line.upper()}\nand a second line of it\n"
    rows = [(1, f"{line}\nfirst"), (2, f"{line}\nsecond"), (3, f"third\n\n{paragraph}\n"), (4, f"{paragraph}fourth")]
    got = {r.doc_id: [tuple(s) for s in r.removed] for r in ld.remove_repeats(documents(rows)).collect()}
    n = len(line.strip())
    assert got == {1: [], 2: [(0, n)], 3: [(7, 7 + n)], 4: [(0, len(paragraph) - 1)]}


def test_odd_rows(odd):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    for min_words in (1, 2):
        assert sorted(found(odd, min_words), key=str) == sorted(brute(rows, min_words), key=str)


def test_ties_and_rows_without_id(documents):
    text = "the same five words here."
    rows = [(1, text), (1, text), (None, text), (None, "only rows without id say this."), (None, "only rows without id say this.")]
    kept = sorted((str(r.doc_id), r.kept_text) for r in ld.remove_repeats(documents(rows), 5).collect())
    own = "only rows without id say this."
    assert kept == [("1", text), ("1", text), ("None", ""), ("None", own), ("None", own)]


def test_empty_table_and_clashing_names(documents, clashing):
    assert ld.remove_repeats(documents([])).count() == 0
    df = ld.remove_repeats(clashing([(1, "a b c d e")], "hi", "lo", "first", "KEPT_TEXT", "_repeats", "_id"))
    assert df.first().kept_text == "a b c d e" and df.first().hi == "mine"
    assert len({c.lower() for c in df.columns}) == len(df.columns)
