"""Ranked lexical search of stated queries over all documents, by buckets of impact vectors of like length.

A document is a vector of impacts, one per term of the queries, and a query a vector of weights; the score is their
product. Vectors are ordered by length and cut into buckets of neighbours. Longest first, a query

1. skips a bucket if its own length times the greatest of the bucket is below its k-th best score so far,
2. adds up, inside a bucket, the products of its heaviest coordinates only, and drops a document if that sum and the
   most that the remaining coordinates can give (the product of the lengths of what remains, or the greatest impacts
   of the bucket) stay below the same score,
3. scores the documents left exactly, in 64-bit integers.

The longest twentieth of all documents is searched first; its k-th scores are where all other tasks begin. Every task
has a range of lengths, keeps k documents per query and returns no more.
"""

import math
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from noonward.llm.common import slices
from noonward.session import discard, store

#: Characters of query texts that go to the tasks at a time; larger sets take several passes.
BLOCK_CHARS = 4_000_000
#: Share of the documents, the longest vectors, that is searched first.
FIRST_SHARE = 0.05
#: Documents of a range of lengths, and postings of a bucket.
RANGE_ROWS = 50_000
BUCKET_POSTINGS = 2_000_000
#: What the heaviest coordinates leave of a query's squared length, and how many there are at most.
LEFT_OVER, HEAVIEST = 0.25, 16

#: ASCII letters in lower case, digits and all bytes of other characters; anything else divides terms.
_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else 32 for b in range(256))


def terms_of(text: str) -> list[bytes]:
    return text.encode().translate(_BYTES).split()


def length_factor(n: int, docs: int, terms: int) -> int:
    """m of a document of n terms, of `docs` documents with `terms` terms in all."""
    return 50 + 50 * n * docs // terms


def weight(docs: int, holding: int) -> int:
    return math.floor(1000 * math.log((2 * docs + 2) / (2 * holding + 1)))


def impact(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return 1_000_000_000 * tf // (1000 * tf + 20 * m)


@dataclass(frozen=True)
class Query:
    """Term numbers, heaviest first, and their weights; `rest` is the length of what follows the first `heavy`."""

    terms: np.ndarray
    weights: np.ndarray
    heavy: int
    length: float
    rest: float

    @staticmethod
    def of(terms: np.ndarray, weights: np.ndarray) -> "Query":
        order = np.argsort(-weights, kind="stable")
        terms, weights = terms[order], weights[order]
        squares = weights.astype(float) ** 2
        left = squares[::-1].cumsum()[::-1]
        heavy = int(np.searchsorted(-left, -LEFT_OVER * squares.sum())) if len(terms) else 0
        heavy = min(max(heavy, 1), HEAVIEST, len(terms))
        return Query(terms, weights, heavy, math.sqrt(squares.sum()), math.sqrt(squares[heavy:].sum()))


#: Bounds are computed in doubles; they are raised by this factor so that rounding drops nothing.
_SAFE = 1 + 1e-9


class Bucket:
    """Documents of like length: postings by document and by term."""

    def __init__(self, length: np.ndarray, ends: np.ndarray, terms: np.ndarray, impacts: np.ndarray):
        self.length = length
        order = np.argsort(terms, kind="stable")
        self.by_term, self.owner = terms[order], np.repeat(np.arange(len(length)), np.diff(ends))[order]
        self.by_impact = impacts[order]

    def postings(self, term: int) -> tuple[np.ndarray, np.ndarray]:
        low, high = np.searchsorted(self.by_term, [term, term + 1])
        return self.owner[low:high], self.by_impact[low:high]

    def candidates(self, q: Query, least: int) -> np.ndarray:
        """Documents whose score may be `least` or more."""
        if q.length * self.length.max(initial=0) * _SAFE < least:
            return np.empty(0, np.int64)
        partial, squares = np.zeros(len(self.length)), np.zeros(len(self.length))
        for term, w in zip(q.terms[: q.heavy], q.weights[: q.heavy]):
            docs, own = self.postings(term)
            partial[docs] += w * own
            squares[docs] += own.astype(float) ** 2
        greatest = sum(int(w) * int(self.postings(t)[1].max(initial=0)) for t, w in zip(q.terms[q.heavy :], q.weights[q.heavy :]))
        left = np.sqrt(np.maximum(self.length**2 * _SAFE - squares, 0)) * q.rest
        return np.flatnonzero((partial + np.minimum(left, greatest)) * _SAFE >= least)

    def scores(self, q: Query, docs: np.ndarray) -> np.ndarray:
        """Exact scores of some of the documents."""
        place = np.full(len(self.length), -1)
        place[docs] = np.arange(len(docs))
        out = np.zeros(len(docs), np.int64)
        for term, w in zip(q.terms, q.weights):
            owner, own = self.postings(term)
            at = place[owner]
            out[at[at >= 0]] += w * own[at >= 0]
        return out


class Best:
    """The k best documents of a query so far: highest scores, then least ids, those without an id last."""

    def __init__(self, k: int, least: int):
        self.k, self.least = k, max(least, 1)
        self.scores, self.ids, self.absent = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, bool)

    def add(self, scores: np.ndarray, ids: np.ndarray, absent: np.ndarray) -> None:
        good = scores >= self.least
        self.scores = np.concatenate([self.scores, scores[good]])
        self.ids = np.concatenate([self.ids, ids[good]])
        self.absent = np.concatenate([self.absent, absent[good]])
        order = np.lexsort((self.ids, self.absent, -self.scores))[: self.k]
        self.scores, self.ids, self.absent = self.scores[order], self.ids[order], self.absent[order]
        if len(order) == self.k:
            self.least = max(self.least, int(self.scores[-1]))


def _counted(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """(doc_id, n, terms, tfs): length of each document with a term, and its terms that queries have."""

    def run(batches):
        for batch, texts in slices(batches, "text"):
            keep, sizes, ends, flat, tfs = [], [], [0], [], []
            for i, text in enumerate(texts):
                words = terms_of(text)
                if words:
                    own = [(vocabulary[w], c) for w, c in Counter(words).items() if w in vocabulary]
                    keep.append(i)
                    sizes.append(len(words))
                    flat += [t for t, _ in own]
                    tfs += [c for _, c in own]
                    ends.append(len(flat))
            ends = pa.array(ends, pa.int32())
            lists = [pa.ListArray.from_arrays(ends, pa.array(x, pa.int32())) for x in (flat, tfs)]
            ids = batch.column("doc_id").take(pa.array(keep, pa.int64()))
            yield pa.RecordBatch.from_arrays([ids, pa.array(sizes, pa.int64()), *lists], names=["doc_id", "n", "terms", "tfs"])

    return docs.mapInArrow(run, "doc_id long, n long, terms array<int>, tfs array<int>")


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Ends and values of a column of lists."""
    ends = column.offsets.to_numpy() - column.offsets[0].as_py()
    return ends.astype(np.int64), column.flatten().to_numpy().astype(np.int64)


def _impacts(counted: DataFrame, n_docs: int, n_terms: int) -> DataFrame:
    """(doc_id, length, terms, impacts) of the documents that have a term of a query."""

    def run(batches):
        for batch in batches:
            ends, tfs = _lists(batch.column("tfs"))
            m = np.array([length_factor(n, n_docs, n_terms) for n in batch.column("n").to_pylist()], np.int64)
            sizes = np.diff(ends)
            own = impact(tfs, np.repeat(m, sizes))
            squares = np.add.reduceat(own.astype(float) ** 2, ends[:-1])  # no list is empty
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(own, pa.int32()))
            columns = [batch.column("doc_id"), pa.array(np.sqrt(squares)), batch.column("terms"), lists]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "length", "terms", "impacts"])

    made = counted.filter(F.size("terms") > 0).mapInArrow(run, "doc_id long, length double, terms array<int>, impacts array<int>")
    return made.filter("length > 0")


def _buckets(batches):
    """Batches of documents, longest first, cut so that none has too many postings."""
    for batch in batches:
        ends, _ = _lists(batch.column("terms"))
        start = 0
        while start < len(batch):
            end = max(start + 1, int(np.searchsorted(ends, ends[start] + BUCKET_POSTINGS, "right")) - 1)
            part = batch.slice(start, end - start)
            own_ends, terms = _lists(part.column("terms"))
            _, impacts = _lists(part.column("impacts"))
            yield part.column("doc_id"), Bucket(part.column("length").to_numpy(), own_ends, terms, impacts)
            start = end


def _searched(vectors: DataFrame, queries: list[Query], least: list[int], k: int) -> DataFrame:
    """(query, doc_id, score): the k best documents of each task and query that reach the query's least score."""

    def run(batches):
        best = [Best(k, low) for low in least]
        for column, bucket in _buckets(batches):
            absent = column.is_null().to_numpy(zero_copy_only=False)
            ids = column.fill_null(0).to_numpy()
            for q, own in zip(queries, best):
                docs = bucket.candidates(q, own.least)
                if len(docs):
                    own.add(bucket.scores(q, docs), ids[docs], absent[docs])
        for number, own in enumerate(best):
            if len(own.ids):
                columns = [pa.array(np.full(len(own.ids), number)), pa.array(own.ids, mask=own.absent), pa.array(own.scores)]
                yield pa.RecordBatch.from_arrays(columns, names=["query", "doc_id", "score"])

    return vectors.mapInArrow(run, "query long, doc_id long, score long")


def _by_length(vectors: DataFrame, rows: int) -> DataFrame:
    """Ranges of lengths, longest first in each; rows of equal length are told apart by doc_id."""
    order = [F.desc("length"), F.col("doc_id")]
    return vectors.repartitionByRange(-(-rows // RANGE_ROWS) or 1, *order).sortWithinPartitions(*order)


def _top(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _search_block(docs: DataFrame, items: list, k: int) -> DataFrame:
    """(query, rank, doc_id, score) of a block of items."""
    own_terms = [dict.fromkeys(terms_of(r.text)) for r in items]
    vocabulary: dict[bytes, int] = {}
    for own in own_terms:
        for t in own:
            vocabulary.setdefault(t, len(vocabulary))
    counted = store(_counted(docs, vocabulary))
    totals = counted.agg(F.count(F.lit(1)).alias("docs"), F.sum("n").alias("terms")).first()
    # one number per term of the block's queries
    holding = dict(map(tuple, counted.select(F.explode("terms").alias("t")).groupBy("t").count().collect()))
    weights = {t: weight(totals.docs, holding.get(i, 0)) for t, i in vocabulary.items()}
    queries = [
        Query.of(np.array([vocabulary[t] for t in own], np.int64), np.array([weights[t] for t in own], np.int64)) for own in own_terms
    ]
    vectors = store(_impacts(counted, totals.docs, totals.terms or 1))
    discard(counted)
    size = vectors.agg(F.count(F.lit(1)).alias("rows"), F.percentile_approx("length", 1 - FIRST_SHARE, 10_000).alias("cut")).first()
    cut = size.cut or 0.0
    longest = _by_length(vectors.filter(F.col("length") >= cut), int(size.rows * FIRST_SHARE) + 1)
    first = store(_top(_searched(longest, queries, [1] * len(queries), k), k))
    least = {r.query: r.score for r in first.filter(F.col("rank") == k).collect()}  # one number per query
    others = _by_length(vectors.filter(F.col("length") < cut), size.rows)
    more = _searched(others, queries, [least.get(i, 1) for i in range(len(queries))], k)
    found = store(_top(more.unionByName(first.drop("rank")), k))
    discard(vectors, first)
    return found


def ranked_search(docs: DataFrame, items: DataFrame, k: int = 50) -> DataFrame:
    """(item_id, rank, doc_id, score): the k documents of `docs` (doc_id, text) with the highest score for each item.

    `items` needs (item_id, text); other columns of either table are not used. A term counts once per item. Only
    scores above 0 are told; equal scores rank by doc_id, rows without one last. Missing and empty texts have no
    terms: such documents are found by nothing, such items find nothing. Rows of `docs` are ranked one by one,
    repeated ones too; rows of `items` that are alike are one item, and those of one item_id with different texts are
    ranked each by itself. Statistics (documents, terms, holders of a term) are those of the whole table.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    items = items.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce("text", F.lit("")).alias("text"))
    items = items.filter("text <> ''").distinct()
    chars = items.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = -(-chars // BLOCK_CHARS)
    spark = docs.sparkSession
    out = spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    for b in range(blocks):
        block = items.filter(F.pmod(F.xxhash64("text"), F.lit(blocks)) == b).orderBy("item_id", "text").collect()
        if block:
            numbers = spark.createDataFrame([(i, r.item_id) for i, r in enumerate(block)], "query long, item_id long")
            found = _search_block(docs, block, k).join(numbers, "query")
            out = out.unionByName(found.select("item_id", "rank", "doc_id", "score"))
    return out
