"""How far the sources of a language differ in their words: a cube of (source block, source block, term block) cells.

Every (language, source) group has a smoothed share of each kept term, in integer parts of 10^9. The divergence of
two groups is a sum over all kept terms, so it can be cut along three axes: groups in blocks, against groups in
blocks, over terms in blocks. A slice is one group's shares of one term block; it is replicated to the cells of all
group blocks of its language, a cell computes the partial divergences of its pairs in both directions from dense
matrices of bounded size, and partial sums are added up along the term axis. No task holds a whole vocabulary, a
whole group or all groups.
"""

from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from noonward.llm.common import slices, texts_of
from noonward.session import discard, store

#: Sides of a cell.
GROUPS_PER_BLOCK, TERMS_PER_BLOCK = 32, 8192
#: Counts that a task holds before it passes them on.
HELD_COUNTS = 300_000

#: ASCII letters in lower case and all bytes of other characters; anything else divides terms.
_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b > 127 else 32 for b in range(256))


def terms_of(text: str) -> list[bytes]:
    return text.encode().translate(_BYTES).split()


def _counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, holding): occurrences, and documents that hold the term; combined per task first."""

    def told(held):
        for (lang, source), (n, holding) in held.items():
            terms = list(n)
            columns = [pa.array([lang] * len(terms)), pa.array([source] * len(terms)), pa.array(terms, pa.binary())]
            columns += [pa.array([n[t] for t in terms], pa.int64()), pa.array([holding[t] for t in terms], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["lang", "source", "term", "n", "holding"])

    def run(batches):
        held, size = defaultdict(lambda: (Counter(), Counter())), 0
        for batch, texts in slices(batches, "text"):
            for text, lang, source in zip(texts, texts_of(batch.column("lang")), texts_of(batch.column("source"))):
                words = terms_of(text)
                if words:
                    n, holding = held[lang, source]
                    before = len(n)
                    n.update(words)
                    holding.update(set(words))
                    size += len(n) - before
                if size >= HELD_COUNTS:
                    yield from told(held)
                    held.clear()
                    size = 0
        yield from told(held)

    found = docs.mapInArrow(run, "lang string, source string, term binary, n long, holding long")
    summed = found.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("holding").alias("holding"))
    return summed.withColumn("term", F.col("term").cast("string"))


def _share(count: Column | str, total: Column | str, kept: Column | str) -> Column:
    """1 + 10^9 * (count + 1) div (total + kept), exact for counts of any size; 1 where nothing is kept."""
    over = F.lit(1_000_000_000).cast("decimal(10,0)") * (F.col(count) + 1).cast("decimal(20,0)")
    below = F.greatest(F.col(total) + F.col(kept), F.lit(1)).cast("decimal(20,0)")
    return F.lit(1).cast("long") + F.call_function("div", over, below)


def _squares(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), q)


def _cell(rows: pd.DataFrame) -> pd.DataFrame:
    """(lang, a, b, value): over the terms of the cell, how far group a is from group b, for both orders of its pairs."""
    lang, low, high, width = (rows[c].iloc[0] for c in ("lang", "low", "high", "width"))
    share = np.repeat(rows["empty"].to_numpy()[:, None], width, axis=1)
    for i, (places, own) in enumerate(zip(rows["places"], rows["shares"])):
        if places is not None:
            share[i, places] = own
    group, block = rows["group"].to_numpy(), rows["block"].to_numpy()
    left, right = np.flatnonzero(block == low), np.flatnonzero(block == high)
    out = []
    for i in left:
        others = right if low != high else right[group[right] != group[i]]
        squares = (share[others] - share[i]) ** 2
        out.append((np.full(len(others), group[i]), group[others], (squares // share[others]).sum(axis=1)))
        if low != high:
            out.append((group[others], np.full(len(others), group[i]), (squares // share[i]).sum(axis=1)))
    a, b, value = (np.concatenate(c) if out else np.empty(0, np.int64) for c in zip(*out)) if out else ([], [], [])
    return pd.DataFrame({"lang": lang, "a": a, "b": b, "value": value}).astype({"a": "int64", "b": "int64", "value": "int64"})


def audit(docs: DataFrame, min_docs: int = 3, top_terms: int = 200) -> DataFrame:
    """(lang, source, part, item, value, rank) for every (lang, source) group of `docs` (lang, source, text).

    Part `pair`: the group against every other source (item) of its language; value is the sum over kept terms of
    (p - q)^2 div q with p the group's and q the item's share; all ranks. Part `term`: the kept terms that the group
    has and uses more than its language does, value likewise with q the language's share; `top_terms` ranks. Kept are
    the terms that `min_docs` documents of the language hold. Ranks run from 1 by falling value, then by item.

    Missing texts, languages and sources count as ''. Groups without terms, and languages without kept terms, have
    pairs as well (of value 0 in the latter). Repeated rows count as often as they come; a language with one source has no pairs. Other columns are not used.
    """
    docs = docs.select(*[F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source", "text")])
    counts = store(_counts(docs))
    terms = counts.groupBy("lang", "term").agg(F.sum("n").alias("lang_n"), F.sum("holding").alias("holding"))
    terms = store(terms.filter(F.col("holding") >= min_docs).drop("holding"))
    langs = terms.groupBy("lang").agg(F.count(F.lit(1)).alias("kept"), F.sum("lang_n").alias("lang_total"))
    langs = docs.select("lang").distinct().join(langs, "lang", "left").fillna(0, ["kept", "lang_total"])
    langs = store(langs.withColumn("term_blocks", F.greatest(F.ceil(F.col("kept") / TERMS_PER_BLOCK), F.lit(1)).cast("int")))
    dealt = terms.join(langs, "lang").withColumn("term_block", F.pmod(F.xxhash64("term"), "term_blocks").cast("int"))
    within = Window.partitionBy("lang", "term_block").orderBy("term")
    places = dealt.withColumn("place", F.row_number().over(within) - 1)
    places = store(places.select("lang", "term", "term_block", "place", _share("lang_n", "lang_total", "kept").alias("lang_share")))
    placed = store(counts.drop("holding").join(places, ["lang", "term"]))

    totals = placed.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = docs.select("lang", "source").distinct().join(totals, ["lang", "source"], "left").fillna(0, ["total"])
    number = F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1
    groups = groups.join(langs.drop("lang_total"), "lang").withColumn("group", number.cast("long")).withColumn("none", F.lit(0))
    groups = groups.withColumn("block", F.floor(F.col("group") / GROUPS_PER_BLOCK)).withColumn("empty", _share("none", "total", "kept"))
    groups = groups.withColumn("last_block", F.max("block").over(Window.partitionBy("lang")))
    groups = store(groups.drop("none"))

    own = placed.join(groups.select("lang", "source", "group", "total", "kept"), ["lang", "source"])
    shares = store(own.withColumn("share", _share("n", "total", "kept")))
    filled = shares.groupBy("lang", "group", "term_block").agg(F.collect_list(F.struct("place", "share")).alias("own"))
    widths = places.groupBy("lang", "term_block").agg(F.count(F.lit(1)).alias("width"))
    every = groups.withColumn("term_block", F.explode(F.expr("sequence(0, term_blocks - 1)")))
    cut = every.join(widths, ["lang", "term_block"], "left").join(filled, ["lang", "group", "term_block"], "left")
    cells = cut.withColumn("other", F.explode(F.expr("sequence(0L, last_block)")))
    cells = cells.select(
        "lang", "term_block", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "group", "block", "empty",
        F.coalesce("width", F.lit(0)).alias("width"), F.col("own.place").alias("places"), F.col("own.share").alias("shares"),
    )
    partial = cells.groupBy("lang", "term_block", "low", "high").applyInPandas(_cell, "lang string, a long, b long, value long")
    pairs = partial.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    name = groups.select("lang", F.col("group").alias("a"), "source")
    item = groups.select("lang", F.col("group").alias("b"), F.col("source").alias("item"))
    pairs = pairs.join(name, ["lang", "a"]).join(item, ["lang", "b"]).select("lang", "source", F.lit("pair").alias("part"), "item", "value")
    more = shares.filter(F.col("share") > F.col("lang_share"))
    value = _squares(F.col("share"), F.col("lang_share"))
    own_terms = more.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), value.alias("value"))
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    best = own_terms.withColumn("rank", rank).filter(F.col("rank") <= top_terms)
    out = store(pairs.withColumn("rank", rank).unionByName(best))
    discard(counts, terms, langs, places, placed, groups, shares)
    return out
