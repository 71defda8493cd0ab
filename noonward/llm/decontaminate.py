"""Benchmark decontamination by pigeonhole edit matching.

A test item of m characters may differ from a passage by k = floor(m * rate) edits. Cut into k + 1 pieces, at least
one piece must then occur in the passage as it is. An Aho-Corasick automaton of all pieces runs over each whole
text; around every hit, Myers' bit-parallel algorithm computes the least edit distance of the item to any
substring, and up to k edits count as a find.

Texts and items are compared as their letters and digits in lower case, words apart by one blank.
"""

import re
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from noonward.llm.common import slices, without

#: Characters of benchmark items that go to the tasks at a time; larger benchmarks take several passes.
BLOCK_CHARS = 4_000_000
WORD = re.compile(r"[^\W_]+")
GAP = re.compile(r"[\W_]+")
#: Letters of scripts that set no blanks between words: Thai to Burmese, Khmer, kana, Chinese characters.
UNSPACED = re.compile("[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff]")


def normalised(text: str) -> str:
    return GAP.sub(" ", text).strip().lower()


def n_words(item: str) -> int:
    """Words of a normalised text; each letter of a script without blanks is one."""
    return len(UNSPACED.findall(item)) + len(UNSPACED.sub(" ", item).split())


def normalised_places(text: str) -> tuple[str, list[int], list[int]]:
    """The normalised text, and for each of its characters the start and end of its origin in `text`."""
    words, starts, ends = [], [], []
    for found in WORD.finditer(text):
        at, own = found.start(), found.group()
        if words:
            starts.append(ends[-1])
            ends.append(at)
        low = own.lower()
        same = len(low) == len(own)
        for i in range(len(low)):
            starts.append(at + i if same else at)
            ends.append(at + i + 1 if same else found.end())
        words.append(low)
    return " ".join(words), starts, ends


@dataclass(frozen=True)
class Item:
    item_id: int | None
    text: str
    errors: int
    masks: dict[str, int]

    @classmethod
    def of(cls, item_id: int | None, text: str, rate: float) -> "Item":
        masks: dict[str, int] = {}
        for i, c in enumerate(text):
            masks[c] = masks.get(c, 0) | 1 << i
        return cls(item_id, text, int(len(text) * rate), masks)

    def pieces(self) -> Iterator[tuple[str, int]]:
        """The pieces and the place in the item where each ends."""
        n, m = self.errors + 1, len(self.text)
        for i in range(n):
            low, high = i * m // n, (i + 1) * m // n
            yield self.text[low:high], high


def distances(item: Item, text: str, anchored: bool = False) -> Iterator[int]:
    """After each character of `text`, the least edit distance of the item to a substring that ends there.

    Anchored, to the whole of `text` so far. Columns of the distance matrix are kept as differences, in the bits of
    two whole numbers.
    """
    m = len(item.text)
    full, top, first = (1 << m) - 1, 1 << (m - 1), 1 if anchored else 0
    up, down, score = full, 0, m
    get = item.masks.get
    for c in text:
        same = get(c, 0)
        diagonal = (((same & up) + up) ^ up) | same | down
        rise = down | ~(diagonal | up) & full
        fall = up & diagonal
        if rise & top:
            score += 1
        elif fall & top:
            score -= 1
        rise = rise << 1 & full | first
        fall = fall << 1 & full
        vertical = same | down
        up = fall | ~(vertical | rise) & full
        down = rise & vertical
        yield score


def best_match(item: Item, text: str) -> tuple[int, int, int] | None:
    """(distance, start, end) of the nearest substring, the first and then the shortest of equals; None beyond the budget."""
    best, end = min(((d, i + 1) for i, d in enumerate(distances(item, text))), default=(item.errors + 1, 0))
    if best > item.errors:
        return None
    back = Item.of(item.item_id, item.text[::-1], 0)
    for size, d in enumerate(distances(back, text[:end][::-1], anchored=True), 1):
        if d == best:
            return best, end - size, end
    return best, end, end


class Matcher:
    """All items of a block, searched at once."""

    def __init__(self, items: list[Item]):
        self.items = items
        places: dict[str, list[tuple[int, int]]] = {}
        for i, item in enumerate(items):
            for piece, end in item.pieces():
                places.setdefault(piece, []).append((i, end))
        self.automaton = ahocorasick.Automaton()
        for piece, at in places.items():
            self.automaton.add_word(piece, at)
        self.automaton.make_automaton()

    def windows(self, text: str) -> dict[int, list[list[int]]]:
        """By item, the stretches of `text` in which a match with one of the hit pieces must lie."""
        out: dict[int, list[list[int]]] = {}
        hits: dict[int, set[int]] = {}
        for at, places in self.automaton.iter(text):
            for i, end in places:
                hits.setdefault(i, set()).add(at + 1 - end)
        for i, starts in hits.items():
            item, merged = self.items[i], out.setdefault(i, [])
            for start in sorted(starts):
                low, high = max(0, start - item.errors), start + len(item.text) + item.errors
                if merged and low <= merged[-1][1]:
                    merged[-1][1] = max(merged[-1][1], high)
                else:
                    merged.append([low, high])
        return out

    def search(self, text: str) -> list[tuple[int, int, int, int]]:
        """(number of the item, distance, start, end) of the best match in each window of a normalised text."""
        out = []
        for i, windows in self.windows(text).items():
            for low, high in windows:
                if found := best_match(self.items[i], text[low:high]):
                    out.append((i, found[0], low + found[1], low + found[2]))
        return out


LEAK = T.StructType([T.StructField(c, T.LongType()) for c in ("item_id", "distance", "start", "end", "matches")])


def _searched(docs: DataFrame, rows: list, rate: float, min_words: int, text: str) -> DataFrame:
    """`docs` with the finds of a block of items added to its column leaks."""
    items = [(r.item_id, r.item) for r in rows if n_words(r.item) >= min_words]
    n = len(items)
    items += [(r.item_id, r.item) for r in rows if n_words(r.item) < min_words]
    # few words: as they are, with the blanks around them, so that they are no parts of words
    around = [("" if UNSPACED.match(t[0]) else " ", "" if UNSPACED.match(t[-1]) else " ") for _, t in items[n:]]
    kind = pa.list_(pa.struct([(f.name, pa.int64()) for f in LEAK]))

    def run(batches):
        matcher = Matcher([Item.of(i, t, rate) for i, t in items[:n]]) if n else None
        exact = Matcher([Item.of(i, a + t + b, 0) for (i, t), (a, b) in zip(items[n:], around)]) if around else None
        for batch, texts in slices(batches, text):
            leaks = []
            for whole, known in zip(texts, batch.column("leaks").to_pylist()):
                by_item: dict[int, list] = {}
                plain = normalised(whole)
                for i, *match in matcher.search(plain) if matcher else ():
                    by_item.setdefault(i, []).append(match)
                for i, d, low, high in exact.search(f" {plain} ") if exact else ():
                    before, after = map(len, around[i])
                    by_item.setdefault(n + i, []).append([d, low + before - 1, high - after - 1])
                out = list(known or ())
                if by_item:
                    _, starts, ends = normalised_places(whole)
                for i, matches in by_item.items():
                    d, low, high = min(matches)
                    at = dict(start=starts[low], end=ends[high - 1])
                    out.append(dict(item_id=items[i][0], distance=d, **at, matches=len(matches)))
                leaks.append(out)
            place = batch.schema.get_field_index("leaks")
            yield batch.set_column(place, "leaks", pa.array(leaks, kind))

    return docs.mapInArrow(run, docs.schema)


def with_leaks(
    docs: DataFrame, benchmark: DataFrame, rate: float = 0.0625, min_words: int = 5, text: str = "text"
) -> DataFrame:
    """`docs` with leaks: for each test item that the text contains its item_id, distance, start, end and matches.

    distance, start and end (code points of the text) are those of the best match, the first of equals; matches
    counts the stretches where the item was found. `benchmark` needs (item_id, text); its other columns are not
    used. Missing and empty texts contain nothing. Each letter of a script without blanks counts as a word. Items of
    fewer than `min_words` words are found as whole words without an error, single words too; items without a letter
    or digit match nothing. Rows of `docs` stay as they are, repeated ones too; repeated items count once. A
    column called leaks is replaced. Items go to the tasks in blocks of about BLOCK_CHARS characters, each a pass
    over all texts.
    """
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce("text", F.lit("")).alias("text"))

    def clean(batches):
        for batch, texts in slices(batches, "text"):
            made = [normalised(t) for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column("item_id"), pa.array(made, pa.string())], names=["item_id", "item"])

    items = items.mapInArrow(clean, "item_id long, item string").distinct()
    items = items.filter("item != ''")
    chars = items.agg(F.sum(F.length("item"))).first()[0] or 0
    blocks = -(-chars // BLOCK_CHARS)
    out = without(docs, "leaks").withColumn("leaks", F.array().cast(T.ArrayType(LEAK)))
    for b in range(blocks):
        block = items.filter(F.pmod(F.xxhash64("item"), F.lit(blocks)) == b).orderBy("item_id", "item")
        out = _searched(out, block.collect(), rate, min_words, text)
    return out


def find_leaks(docs: DataFrame, benchmark: DataFrame, rate: float = 0.0625, min_words: int = 5) -> DataFrame:
    """(doc_id, item_id, distance, start, end, matches): the leaks of `docs` (doc_id, text), a row each."""
    found = with_leaks(docs.select("doc_id", "text"), benchmark, rate, min_words)
    return found.select("doc_id", F.explode("leaks").alias("leak")).select("doc_id", "leak.*")
