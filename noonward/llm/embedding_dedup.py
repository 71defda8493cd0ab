"""Near copies of embeddings by spherical-cap filters.

A filter is a direction on the sphere; a vector belongs to it if their cosine exceeds a threshold, so a filter is a
cap. Two vectors with a small angle between them share caps much more often than others do. The directions are those
of random product codes: vectors are turned at random and cut into two halves, each half has a list of random
directions, and every pair of one from each list is a filter. A vector is decoded to all filters that it exceeds by
going through the first list and, of the second, only as far as the sum can still reach the threshold. Several
codes, each with a turn of its own, even out how many filters single vectors get.

1. Equal vectors of a label are one node, with the number of its copies.
2. Every node is decoded. What first meets in the filters are not vectors but 128 signs of random projections of
   each: who has no neighbour there whose signs are near enough leaves the filter. Large filters keep all.
3. The vectors of those left meet in each filter, those of large filters in pairs of blocks, and cosines are computed
   in double precision. A pair is counted in the first filter that both share, and nowhere else.
4. A task returns a sum per node and at most one edge per node and filter, never its pairs.
"""

import hashlib
import math
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from noonward.llm.components import components
from noonward.llm.jaccard_join import mixed
from noonward.llm.skew import HOT_SHARE, join_counted
from noonward.session import discard, store


@dataclass(frozen=True)
class Settings:
    """Links from `cosine` on. With these figures 99 % or more of the pairs exactly at 0.93 share a filter."""

    cosine: float = 0.93
    codes: int = 12
    #: Filters of a code that a vector exceeds, and vectors that exceed a filter, both on average and at random.
    lists: int = 4
    held: int = 4
    #: Vectors of a block of a large filter.
    block: int = 1024
    #: Bytes of vectors and lists in a task.
    task_bytes: int = 32_000_000
    #: Signs of a vector, 64 to a word, and how many deviations more than expected may differ in a linked pair.
    words: int = 2
    deviations: float = 6.0
    seed: int = 11

    @property
    def most_differing(self) -> int:
        """Signs that differ between two vectors at the cosine, apart from a chance of one in 10^8 or so."""
        n, p = 64 * self.words, math.acos(self.cosine) / math.pi
        return int(n * p + self.deviations * math.sqrt(n * p * (1 - p)))


#: Shorter vectors are filled up with zeros, which changes no angle.
LEAST_WIDTH = 16


def cap_threshold(width: int, share: float) -> float:
    """The cosine that a random direction exceeds with the given probability."""
    t = np.linspace(0, 1, 100_001)
    density = (1 - t * t) ** ((width - 3) / 2)
    above = np.cumsum(density[::-1])[::-1]
    return float(t[np.searchsorted(-above / (2 * above[0]), -share)])


@dataclass(frozen=True)
class Codes:
    """Random product codes for vectors of one width: `turns` and for each of them two lists of directions."""

    turns: np.ndarray
    halves: np.ndarray
    threshold: float
    projections: np.ndarray

    @property
    def size(self) -> int:
        return self.halves.shape[2]

    def signs(self, unit: np.ndarray) -> np.ndarray:
        """64 signs to each word, a row of words per vector."""
        bits = np.packbits(unit @ self.projections[: unit.shape[1]] > 0, axis=1)
        return np.ascontiguousarray(bits).view(np.int64)

    def decode(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, filter) of all filters that the rows of unit vectors exceed, by row and filter."""
        width, (codes, _, size, half) = self.turns.shape[1], self.halves.shape
        padded = np.zeros((len(unit), width), np.float32)
        padded[:, : unit.shape[1]] = unit
        rows, filters = [], []
        for c in range(codes):
            turned = padded @ self.turns[c]
            first, second = turned[:, :half] @ self.halves[c, 0].T, turned[:, half:] @ self.halves[c, 1].T
            order = np.argsort(-second, axis=1)
            falling = -np.take_along_axis(second, order, axis=1)
            at, i = np.nonzero(first + second.max(axis=1, keepdims=True) >= self.threshold)
            step = 0
            while len(at):  # the next best of the second list, for those that the last one was still enough for
                good = first[at, i] - falling[at, step] >= self.threshold
                at, i = at[good], i[good]
                rows.append(at)
                filters.append((c * size + i) * size + order[at, step])
                step += 1
                if step == size:
                    break
        row, found = np.concatenate(rows), np.concatenate(filters).astype(np.int64)
        by_row = np.lexsort((found, row))
        return row[by_row], found[by_row]


@lru_cache(maxsize=4)
def codes_for(dim: int, vectors: int, s: Settings) -> Codes:
    """Codes of so many filters that each holds about `held` of `vectors` random vectors.

    Their lists have about sqrt(vectors) directions: 24 * sqrt(vectors) * dim / 2 floats in all, 30 MB for a million
    vectors of 64 parts under one label, 370 MB for a hundred million of 768.
    """
    width = max(LEAST_WIDTH, dim + dim % 2)
    size = max(4, math.ceil(math.sqrt(s.lists * max(vectors, 1) / s.held)))
    rng = np.random.default_rng([s.seed, width, size])
    turns = np.stack([np.linalg.qr(rng.standard_normal((width, width)))[0] for _ in range(s.codes)])
    halves = rng.standard_normal((s.codes, 2, size, width // 2))
    halves /= np.linalg.norm(halves, axis=3, keepdims=True) * math.sqrt(2)
    projections = rng.standard_normal((width, 64 * s.words))
    turns, halves = turns.astype(np.float32), halves.astype(np.float32)
    return Codes(turns, halves, cap_threshold(width, s.lists / size**2), projections)


def unit_rows(values: np.ndarray) -> np.ndarray:
    """Rows of length 1; first divided by their largest part, so that no square overflows or vanishes."""
    scaled = values / np.abs(values).max(axis=1, keepdims=True)
    return scaled / np.linalg.norm(scaled, axis=1, keepdims=True)


def usable_vector(values: list | None) -> np.ndarray | None:
    """The vector in double precision; None if it is missing, zero, or has missing or non-finite parts."""
    if not values or None in values:
        return None
    vector = np.asarray(values, np.float64)
    return vector if np.isfinite(vector).all() and vector.any() else None


def _vectors(df: DataFrame, ids: str, vector: str, label: str) -> DataFrame:
    """(vec_id, hi, lo, group, dim, raw) of each row; all but vec_id are empty where it links with nothing."""
    kind = np.float32 if df.schema[vector].dataType.elementType == T.FloatType() else np.float64
    given = df.select(
        F.col(ids).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("vector"), F.col(label).cast("string").alias("label")
    )

    def run(batches):
        for batch in batches:
            out = []
            for vec_id, values, own in zip(*(batch.column(c).to_pylist() for c in ("vec_id", "vector", "label"))):
                found = None if own is None or vec_id is None else usable_vector(values)
                if found is None:
                    out.append((vec_id, None, None, None, None, None))
                    continue
                raw, space = found.astype(kind).tobytes(), f"{len(found)}:{own}".encode()
                hi, lo = np.frombuffer(hashlib.blake2b(raw, digest_size=16, key=hashlib.blake2b(space).digest()[:32]).digest(), np.int64)
                group = int(np.frombuffer(hashlib.blake2b(space, digest_size=8).digest(), np.int64)[0])
                out.append((vec_id, int(hi), int(lo), group, len(found), raw))
            names = ["vec_id", "hi", "lo", "group", "dim", "raw"]
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary()]
            columns = [pa.array([r[k] for r in out], t) for k, t in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return given.mapInArrow(run, "vec_id long, hi long, lo long, group long, dim int, raw binary"), kind


def _decoded(distinct: DataFrame, largest: int, kind: type, s: Settings) -> DataFrame:
    """(node, signs, buckets): 64-bit names of the filters that a vector exceeds, apart by label and width."""

    def run(batches):
        for batch in batches:
            dims, groups = (batch.column(c).to_numpy() for c in ("dim", "group"))
            lists, signs = [None] * len(dims), [None] * len(dims)
            for dim in np.unique(dims):
                at = np.flatnonzero(dims == dim)
                codes = codes_for(int(dim), largest, s)
                chunk = max(1, min(512, 2_000_000 // codes.size))
                for part in np.array_split(at, -(-len(at) // chunk)):
                    raw = b"".join(batch.column("raw").take(pa.array(part)).to_pylist())
                    unit = unit_rows(np.frombuffer(raw, kind).reshape(len(part), dim).astype(np.float64))
                    row, found = codes.decode(unit)
                    names = mixed(found.astype(np.uint64) + mixed(groups[part].view(np.uint64))[row]).view(np.int64)
                    ends, words = np.searchsorted(row, np.arange(len(part) + 1)), codes.signs(unit)
                    for k, i in enumerate(part):
                        lists[i], signs[i] = np.unique(names[ends[k] : ends[k + 1]]), words[k]
            many = pa.list_(pa.int64())
            columns = [batch.column("node"), pa.array(signs, many), pa.array(lists, many)]
            yield pa.RecordBatch.from_arrays(columns, names=["node", "signs", "buckets"])

    return distinct.select("node", "group", "dim", "raw").mapInArrow(run, "node long, signs array<long>, buckets array<long>")


def _with_neighbour(rows: pd.DataFrame, s: Settings) -> pd.DataFrame:
    """Of (bucket, node, w0, w1, ...) those that have another node in their bucket with signs near their own."""
    rows = rows.sort_values("bucket", ignore_index=True)
    bucket, words = rows["bucket"].to_numpy(), rows[[f"w{i}" for i in range(s.words)]].to_numpy().view(np.uint64)
    found = np.zeros(len(rows), bool)
    for step in range(1, s.block):
        i = np.flatnonzero(bucket[:-step] == bucket[step:])
        if not i.size:
            break
        near = i[np.bitwise_count(words[i] ^ words[i + step]).sum(axis=1) <= s.most_differing]
        found[near] = found[near + step] = True
    return rows.loc[found, ["node", "bucket"]]


def _neighbours(decoded: DataFrame, s: Settings) -> DataFrame:
    """(node, bucket) of the nodes that may be linked with another one of the bucket."""
    words = [F.col("signs")[i].alias(f"w{i}") for i in range(s.words)]
    each = decoded.select("node", F.explode("buckets").alias("bucket"), *words)
    counts = each.groupBy("bucket").agg(F.count(F.lit(1)).alias("held"))
    large = store(counts.filter(F.col("held") > s.block))
    total = decoded.agg(F.sum(F.size("buckets"))).first()[0] or 0
    large_rows = join_counted(each.select("node", "bucket"), large, ["bucket"], "held", total).select("node", "bucket")
    hot = large.filter(F.col("held") >= total * HOT_SHARE).select("bucket")
    others = each.join(F.broadcast(hot), "bucket", "left_anti").join(large.select("bucket"), "bucket", "left_anti")
    tasks = total * (24 + 8 * s.words) // s.task_bytes + 1
    task = F.pmod(F.xxhash64("bucket"), F.lit(tasks)).alias("task")
    small = others.select(task, "*").groupBy("task").applyInPandas(lambda rows: _with_neighbour(rows, s), "node long, bucket long")
    found = store(small.unionByName(large_rows))
    discard(large)
    return found


def _met_before(lists: list[np.ndarray], others: list[np.ndarray], bucket: int) -> np.ndarray:
    """Which of `lists` share a bucket of lesser name with which of `others`."""
    left = [b[b < bucket] for b in lists]
    right = [b[b < bucket] for b in others]
    both = np.intersect1d(np.concatenate(left), np.concatenate(right))
    if not both.size:
        return np.zeros((len(left), len(right)), bool)

    def marks(side):
        out = np.zeros((len(side), len(both)), np.float32)
        for i, own in enumerate(side):
            out[i, np.searchsorted(both, np.intersect1d(own, both, assume_unique=True))] = 1
        return out

    return marks(left) @ marks(right).T > 0


def spanning_edges(linked: np.ndarray) -> list[tuple[int, int]]:
    """Edges that keep what a symmetric matrix of links connects, fewer than it has rows."""
    out, is_open = [], linked.any(axis=1)
    while is_open.any():
        frontier = np.array([int(is_open.argmax())])
        is_open[frontier] = False
        while len(frontier):
            near = linked[frontier] & is_open
            reached = np.flatnonzero(near.any(axis=0))
            out += zip(frontier[near[:, reached].argmax(axis=0)].tolist(), reached.tolist())
            is_open[reached] = False
            frontier = reached
    return out


#: Buckets of up to so many vectors are compared together with others.
SMALL = 32


def _compare(rows: pd.DataFrame, kind: type, s: Settings) -> pd.DataFrame:
    """(a, b, n): sums per node (b empty) and edges (n empty) of the buckets of a task."""
    rows = rows.sort_values(["dim", "group", "bucket"], kind="stable", ignore_index=True)
    low, high = rows["low"].iloc[0], rows["high"].iloc[0]
    block, copies, node, bucket = (rows[c].to_numpy() for c in ("block", "copies", "node", "bucket"))
    lists, sums = rows["buckets"].tolist(), np.zeros(len(rows), np.int64)
    same = (bucket[1:] == bucket[:-1]) & (rows["group"].to_numpy()[1:] == rows["group"].to_numpy()[:-1])
    same &= rows["dim"].to_numpy()[1:] == rows["dim"].to_numpy()[:-1]
    run = np.concatenate([[0], np.cumsum(~same)])  # rows of one bucket lie together
    starts = np.flatnonzero(np.concatenate([[True], ~same]))
    sizes = np.diff(np.concatenate([starts, [len(rows)]]))
    edges = []
    for dim, part in rows.groupby("dim", sort=False):
        at = part.index.to_numpy()
        base = int(at[0])  # rows of one width lie together
        unit = unit_rows(np.frombuffer(b"".join(part["raw"]), kind).reshape(len(part), dim).astype(np.float64))
        own_run = run[at]
        small = (sizes[own_run] <= SMALL) & (low == high)
        for step in range(1, SMALL):
            i = np.flatnonzero((own_run[:-step] == own_run[step:]) & small[:-step])
            if not i.size:
                break
            cosine = np.einsum("ij,ij->i", unit[i], unit[i + step])
            for k in i[cosine >= s.cosine].tolist():
                x, y = base + k, base + k + step
                shared = np.intersect1d(lists[x], lists[y], assume_unique=True)
                if shared[0] == bucket[x]:
                    sums[x] += copies[y]
                    sums[y] += copies[x]
                    edges.append((node[x], node[y]))
        for first in np.unique(own_run[~small]):
            i = starts[first] + np.arange(sizes[first])
            if low == high:
                j = i
            else:
                i, j = i[block[i] == low], i[block[i] == high]
            if not len(i) or not len(j):
                continue
            near = unit[i - base] @ unit[j - base].T >= s.cosine
            if low == high:
                np.fill_diagonal(near, False)
            if not near.any():
                continue
            one, two = near.any(axis=1), near.any(axis=0)
            i, j, near = i[one], j[two], near[np.ix_(one, two)]
            near &= ~_met_before([lists[x] for x in i], [lists[x] for x in j], bucket[i[0]])
            sums[i] += near @ copies[j]
            if low == high:
                edges += [(node[i[x]], node[i[y]]) for x, y in spanning_edges(near)]
            else:
                sums[j] += near.T @ copies[i]
                both = np.concatenate([i, j])
                square = np.zeros((len(both), len(both)), bool)
                square[: len(i), len(i) :], square[len(i) :, : len(i)] = near, near.T
                edges += [(node[both[x]], node[both[y]]) for x, y in spanning_edges(square)]
    told = pd.DataFrame({"a": node, "n": sums})[sums > 0].groupby("a", as_index=False)["n"].sum()
    out = pd.concat([told, pd.DataFrame(edges, columns=["a", "b"], dtype="int64")], ignore_index=True)
    return out.reindex(columns=["a", "b", "n"]).astype("Int64")


def _meetings(distinct: DataFrame, pairs: DataFrame, counts: DataFrame, s: Settings) -> DataFrame:
    """A row per node, bucket and pair of blocks that it is compared in."""
    total = counts.agg(F.sum("held")).first()[0] or 0
    shared = join_counted(pairs, counts, ["bucket"], "held", total)
    own = shared.groupBy("node").agg(F.collect_list(F.struct("bucket", "held")).alias("met"))
    met = distinct.select("node", "copies", "group", "dim", "raw").join(own, "node")
    size = F.octet_length("raw") + 8 * F.size("met") + 64
    # one number: the bytes of all small buckets, from which follows how many tasks they need
    bytes_ = met.agg(F.sum(size * F.size("met"))).first()[0] or 0
    tasks = int(bytes_ // s.task_bytes) + 1
    buckets = F.array_sort(F.transform("met", lambda m: m.bucket))
    rows = met.withColumn("buckets", buckets).withColumn("m", F.explode("met")).select("*", "m.*").drop("m", "met")
    rows = rows.withColumn("blocks", F.ceil(F.col("held") / s.block).cast("long"))
    rows = rows.withColumn("block", F.pmod(F.xxhash64("node"), "blocks"))
    rows = rows.withColumn("other", F.explode(F.expr("sequence(0L, blocks - 1)")))
    parted = rows.withColumns(
        {
            "task": F.when(F.col("blocks") == 1, F.pmod(F.xxhash64("bucket"), F.lit(tasks))).otherwise(-1),
            "key": F.when(F.col("blocks") > 1, F.col("bucket")),
            "low": F.least("block", "other"),
            "high": F.greatest("block", "other"),
        }
    )
    return parted.drop("blocks", "other", "held")


def near_vectors(
    df: DataFrame, s: Settings = Settings(), vec_id: str = "vec_id", vector: str = "embedding", label: str = "label"
) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of `df`, whose other columns are not used.

    Two rows are linked if their labels are equal, their vectors of one width, and their cosine is at least
    `s.cosine`. n_links counts the other rows that a row is linked with, component_id is the least vec_id that links
    lead to, its own included, and kept tells that both are the same. Rows without a vec_id or label, and vectors
    that are missing, empty, zero or with missing or non-finite parts link with nothing. Repeated rows are vectors
    of their own, linked with each other; rows of one vec_id with different vectors are one node of the graph.
    No link is reported below the cosine; pairs that share no filter are missed (see Settings; a test measures it).
    """
    own, kind = _vectors(df, vec_id, vector, label)
    rows = store(own)
    narrow = rows.filter("hi is not null").select("vec_id", "hi", "lo")
    distinct = rows.filter("hi is not null").groupBy("hi", "lo").agg(
        F.min("vec_id").alias("rep"),
        F.count(F.lit(1)).alias("copies"),
        *[F.first(c).alias(c) for c in ("group", "dim", "raw")],
    )
    distinct = store(distinct.withColumn("node", F.monotonically_increasing_id()))  # settled by being written
    largest = distinct.groupBy("group").count().agg(F.max("count")).first()[0] or 0
    decoded = store(_decoded(distinct, largest, kind, s))
    pairs = _neighbours(decoded, s)
    counts = store(pairs.groupBy("bucket").agg(F.count(F.lit(1)).alias("held")).filter("held > 1"))
    met = _meetings(distinct, pairs, counts, s).groupBy("task", "key", "low", "high")
    found = store(met.applyInPandas(lambda part: _compare(part, kind, s), "a long, b long, n long"))
    discard(decoded, pairs, counts)
    sums = found.filter("b is null").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("n"))
    table = distinct.select("hi", "lo", "node", "rep", "copies")
    total = table.agg(F.sum("copies")).first()[0] or 0
    # a vec_id that has several vectors ties them together
    known = store(join_counted(narrow, table, ["hi", "lo"], "copies", total).select("vec_id", "node"))
    ends = known.groupBy("vec_id").agg(F.min("node").alias("a"), F.max("node").alias("last"))
    several = known.join(ends.filter("a <> last").select("vec_id", "a"), "vec_id").select("a", F.col("node").alias("b"))
    reached = components(found.filter("b is not null").select("a", "b").union(several)).withColumnRenamed("id", "node")
    table = table.join(sums, "node", "left").join(reached, "node", "left").withColumn("component", F.coalesce("component", "node"))
    table = store(table)
    least = table.groupBy("component").agg(F.min("rep").alias("component_id"), F.count(F.lit(1)).alias("held"))
    n_links = F.col("copies") - 1 + F.coalesce("n", F.lit(0))
    named = join_counted(table, least, ["component"], "held", table.count())
    table = store(named.select("hi", "lo", "copies", n_links.alias("n_links"), "component_id"))
    discard(known, found, distinct)
    linked = join_counted(narrow, table, ["hi", "lo"], "copies", total).select("vec_id", "n_links", "component_id")
    alone = rows.filter("hi is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.union(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
