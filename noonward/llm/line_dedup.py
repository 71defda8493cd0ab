"""Substring deduplication by hashing lines and the sentences of lines.

Texts are cut into units: lines, and within a line the stretches up to a sentence end, so that a passage pasted
into the middle of a line is found as well. Units of any length are normalised (A-Z in lower case, runs of blanks as
one) and known by a 128-bit digest. Digests are grouped over all documents; the occurrence in the document of the
least doc_id, and there the first, stays, all others are repeats. Neighbouring repeats make a run: whole lines,
paragraphs, or a passage that begins in one line and ends in another. Runs of enough words are cut out of their
texts; a lone common sentence or short line stays. Places are those of the original.
"""

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from noonward.llm.common import slices, unused, without
from noonward.llm.skew import join_counted
from noonward.session import discard, store

#: These stretches fill a text without a gap.
UNIT = re.compile(r"\n|[^\n.!?]*[.!?]+|[^\n.!?]+")


BLANKS = " \t\n\r\x0b\x0c"


def units(text: str) -> list[tuple[int, int, int, bytes]]:
    """(start, end, words, digest) of the units of a text, without the blanks around them."""
    out = []
    for found in UNIT.finditer(text):
        part = found.group()
        words = part.encode().lower().split()
        if words:
            low = found.start() + len(part) - len(part.lstrip(BLANKS))
            high = found.end() - len(part) + len(part.rstrip(BLANKS))
            out.append((low, high, len(words), hashlib.blake2b(b" ".join(words), digest_size=16).digest()))
    return out


def repeated_runs(own: list[tuple[int, int, int, bytes]], repeated: set[bytes], min_words: int) -> list[tuple[int, int]]:
    """(start, end) of the runs of units that are repeated or come again in the text, of `min_words` words or more."""
    out, seen, run = [], set(), []
    for unit in [*own, None]:
        if unit and (unit[3] in repeated or unit[3] in seen):
            run.append(unit)
        else:
            if sum(u[2] for u in run) >= min_words:
                out.append((run[0][0], run[-1][1]))
            run = []
        if unit:
            seen.add(unit[3])
    return out


def _digests(docs: DataFrame) -> DataFrame:
    """(doc_id, hi, lo): the distinct units of each row."""

    def run(batches):
        for batch, texts in slices(batches, "text"):
            rows = [list({u[3]: None for u in units(t)}) for t in texts]
            which = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
            halves = np.frombuffer(b"".join(d for r in rows for d in r), np.int64).reshape(-1, 2)
            columns = [batch.column("doc_id").take(pa.array(which)), pa.array(halves[:, 0]), pa.array(halves[:, 1])]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "hi", "lo"])

    return docs.mapInArrow(run, "doc_id long, hi long, lo long")


def _repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, repeats): per document its units that a document of lesser doc_id holds as well, 16 bytes each.

    What is grouped are minima, which combine before the shuffle, so that a unit that a third of all documents
    share is a few rows; the rows of such units meet their minimum where they are.
    """
    each = store(_digests(docs))
    first = each.groupBy("hi", "lo").agg(F.min("doc_id").alias("first"), F.count("*").alias("n"))
    first = store(first.filter("n > 1"))
    total = first.agg(F.sum("n")).first()[0] or 0
    later = join_counted(each, first, ["hi", "lo"], "n", total).filter("not doc_id <=> first")
    found = store(later.groupBy("doc_id").agg(F.collect_set(F.struct("hi", "lo")).alias("repeats")))
    discard(each, first)
    return found


def remove_repeats(docs: DataFrame, min_words: int = 20, text: str = "text") -> DataFrame:
    """`docs` with removed and kept_text.

    `removed` has the (start, end) of each run cut out, in code points of the original, in order; `kept_text` is the
    rest. A run is a series of units, with nothing but blanks between them, that all are repeats; it goes if it has
    `min_words` words. A missing text has no units, and stays missing. Rows of equal doc_id rank as one document:
    each keeps what that document keeps, and loses what it repeats itself. Rows without a doc_id rank behind all
    others and among themselves as one document. Columns called as the results are replaced.
    """
    base = without(docs, "removed", "kept_text")
    key, held = unused(base, "_id"), unused(base, "_repeats")
    slim = base.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias("text"))
    repeats = _repeats(slim).select(F.col("doc_id").alias(key), F.col("repeats").alias(held))
    joined = base.join(repeats, F.col("doc_id").cast("long").eqNullSafe(F.col(key)), "left").drop(key)

    own_columns = base.columns

    def run(batches):
        for batch, texts in slices(batches, text):
            missing = batch.column(text).is_null().to_pylist()
            removed, kept = [], []
            for whole, gone, null in zip(texts, batch.column(held).to_pylist(), missing):
                bad = {np.array([g["hi"], g["lo"]], np.int64).tobytes() for g in gone or ()}
                spans = repeated_runs(units(whole), bad, min_words)
                removed.append([{"start": a, "end": b} for a, b in spans])
                ends = [0, *(b for _, b in spans)]
                starts = [*(a for a, _ in spans), len(whole)]
                kept.append(None if null else "".join(whole[a:b] for a, b in zip(ends, starts)))
            columns = [batch.column(c) for c in own_columns]
            spans_type = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
            columns += [pa.array(removed, spans_type), pa.array(kept, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=[*own_columns, "removed", "kept_text"])

    span = T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])
    added = [T.StructField("removed", T.ArrayType(span)), T.StructField("kept_text", T.StringType())]
    return joined.mapInArrow(run, T.StructType([*base.schema, *added]))
