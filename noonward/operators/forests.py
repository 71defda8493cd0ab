"""Forests and boosted trees of all hours ahead, grown together from sums in bins.

Samples are cut into bins once and stored. Each level of all trees of a block is then one pass: tasks add up weights and
targets by (tree and hour, node, feature, bin), the sums are added, and the best split of each node goes to the driver.
What is collected and sent out is bounded by the parameters (trees, hours, depth, features), not by the samples. Targets
count in whole steps of their range, so sums are exact and the trees do not depend on how the samples are partitioned or
on tasks that ran twice.

Missing and infinite values are replaced as everywhere; tied splits go to the first feature and the least bin.
"""

import hashlib
import json
import time
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, replace
from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from noonward import constants as K
from noonward.functions.columns import finite
from noonward.operators.linear import share_of_time
from noonward.operators.trees import with_plant_behaviour
from noonward.session import discard, store, written


@dataclass(frozen=True)
class Kind:
    """How trees of a model name grow: smallest leaf, what is added to a node's weight, most leaves, one after another."""

    smallest_leaf: int
    ridge: float
    most_leaves: int | None
    boosted: bool


# Defaults behind the model names.
KINDS = {
    "RF": Kind(1, 0.0, None, False),
    "XGB": Kind(1, 1.0, None, True),
    "LGBM": Kind(20, 0.0, 31, True),
}
BINS = 64
#: Steps that the range of a target is counted in.
STEPS = 1 << 24
#: Bytes of sums that a task holds at a time.
SUMS_BYTES = 96 << 20
#: Samples that are added up at a time. Their weights count in units of UNIT and their steps in ones, side by side in one
#: double: exact while the weights are below FITS and the steps below half a unit, as they hardly ever are not.
CHUNK = 4096
UNIT, FITS = 2.0**40, 2**12 * 1.9
#: Features whose sums travel together.
TOGETHER = 32
#: Boosted trees after which the targets that are left over are written down.
REWRITE = 10

_POISSON = np.cumsum(np.exp(-1.0) / np.cumprod([1.0, *range(1, 12)]))
_PARTIAL = "unit int, node int, block int, n binary, s binary"
_SPLIT = "unit int, node int, feature int, bin int, gain double, n long, s long, n_left long, s_left long"


@dataclass(frozen=True)
class Trees:
    """Trees side by side, each for one hour ahead; node k has the children 2k and 2k+1, the root is node 1."""

    tree: np.ndarray
    hour: np.ndarray
    feature: np.ndarray  # (trees, nodes), -1 for a leaf
    bin: np.ndarray
    value: np.ndarray
    gain: np.ndarray

    @staticmethod
    def blank(tree, hour, depth: int) -> "Trees":
        shape = len(tree), 2 << depth
        return Trees(np.array(tree), np.array(hour), np.full(shape, -1), np.zeros(shape, int), np.zeros(shape), np.zeros(shape))

    @staticmethod
    def joined(parts: list["Trees"]) -> "Trees":
        return Trees(*[np.concatenate([getattr(p, f) for p in parts]) for f in Trees.__dataclass_fields__])

    def of_hours(self, hours: np.ndarray) -> "Trees":
        kept = np.isin(self.hour, hours)
        return Trees(*[getattr(self, f)[kept] for f in Trees.__dataclass_fields__])

    def reach(self, unit: int, bins: np.ndarray) -> np.ndarray:
        """The node where each sample ends."""
        node, rows = np.ones(len(bins), int), np.arange(len(bins))
        for _ in range(self.feature.shape[1].bit_length() - 2):
            feature = self.feature[unit][node]
            right = bins[rows, np.maximum(feature, 0)] > self.bin[unit][node]
            node = np.where(feature >= 0, 2 * node + right, node)
        return node

    def total(self, bins: np.ndarray, hours: int) -> np.ndarray:
        out = np.zeros((len(bins), hours))
        for u, h in enumerate(self.hour):
            out[:, h] += self.value[u][self.reach(u, bins)]
        return out


@dataclass(frozen=True)
class Forest:
    """Fitted trees with what it takes to use them: edges of the bins, centre and range of each target."""

    trees: Trees
    edges: list[np.ndarray]
    centre: np.ndarray
    span: np.ndarray
    share: float

    def predict(self, x: np.ndarray) -> np.ndarray:
        return self.centre + self.span * self.share * self.trees.total(cut(x, self.edges), len(self.centre))

    def to_json(self) -> str:
        trees = {f: getattr(self.trees, f).tolist() for f in Trees.__dataclass_fields__}
        edges = [e.tolist() for e in self.edges]
        return json.dumps({"trees": trees, "edges": edges, "centre": self.centre.tolist(), "span": self.span.tolist(), "share": self.share})

    @staticmethod
    def from_json(text: str) -> "Forest":
        d = json.loads(text)
        trees = Trees(**{f: np.array(v) for f, v in d["trees"].items()})
        return Forest(trees, [np.array(e) for e in d["edges"]], np.array(d["centre"]), np.array(d["span"]), d["share"])


def cut(x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    """The bin of each value: bin b ends with edge b."""
    return np.stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)], axis=1).astype(np.uint8)


def bin_edges(train: DataFrame, bins: int = BINS) -> list[np.ndarray]:
    """Quantiles of each feature in training, without repeats."""
    cells = train.select(F.posexplode("_x").alias("feature", "x"))
    shares = [k / bins for k in range(1, bins)]
    found = {r["feature"]: np.unique(r["q"]) for r in cells.groupBy("feature").agg(F.percentile_approx("x", shares).alias("q")).collect()}
    return [found[f] for f in range(len(found))]


def _in_bins(batches: Iterator[pd.DataFrame], edges, hours, centre, span) -> Iterator[pd.DataFrame]:
    for rows in batches:
        y = (np.vstack(rows["_y"])[:, hours] - centre) / span
        yield pd.DataFrame({"_id": rows["_id"], "_bins": [b.tobytes() for b in cut(np.vstack(rows["_x"]), edges)], "_y": list(y)})


def _read(rows: pd.DataFrame, features: int) -> tuple[np.ndarray, np.ndarray]:
    bins = np.frombuffer(b"".join(rows["_bins"]), np.uint8).reshape(-1, features)
    return bins, np.vstack(rows["_y"])


def _left_over(batches: Iterator[pd.DataFrame], features: int, trees: Trees) -> Iterator[pd.DataFrame]:
    """Targets less what the trees give."""
    for rows in batches:
        bins, y = _read(rows, features)
        yield rows.assign(_y=list(y - trees.total(bins, y.shape[1])))


def weights(ids: np.ndarray, tree: int, seed: int) -> np.ndarray:
    """How often each sample is drawn for a tree: Poisson numbers of mean 1 from a hash of sample, tree and seed."""
    with np.errstate(over="ignore"):
        z = ids.astype(np.int64).view(np.uint64) ^ (np.uint64(seed + 1) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(tree + 1) * np.uint64(0xD1B54A32D192ED03))
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        z ^= z >> np.uint64(31)
    return np.searchsorted(_POISSON, z / 2.0**64, side="right")


def _both(at: np.ndarray, w: np.ndarray, ws: np.ndarray, features: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Sums of weights and of weighted steps by cell, in one count where both fit into the whole numbers of a double."""
    if w.sum() < FITS and np.abs(ws).sum() < UNIT / 2:
        both = np.bincount(at, np.repeat(w * UNIT + ws, features), size)
        of_n = np.rint(both / UNIT)
        return of_n, both - of_n * UNIT
    return np.bincount(at, np.repeat(w, features), size), np.bincount(at, np.repeat(ws, features), size)


def _sums(batches: Iterator[pd.DataFrame], trees: Trees, nodes: np.ndarray, before: Trees | None, features: int, seed: int | None) -> Iterator[pd.DataFrame]:
    """Weights and targets by node, feature and bin, for rows (unit, node) of `nodes`, sorted."""
    width = features * BINS
    n, s = np.zeros((len(nodes), width)), np.zeros((len(nodes), width))
    cells = np.arange(features) * BINS
    units, starts = np.unique(nodes[:, 0], return_index=True)
    for rows in (some.iloc[i : i + CHUNK] for some in batches for i in range(0, len(some), CHUNK)):
        bins, y = _read(rows, features)
        if before is not None:
            y = y - before.total(bins, y.shape[1])
        steps, cell = np.rint(y * STEPS), cells + bins
        drawn = {}
        for u, start, end in zip(units, starts, [*starts[1:], len(nodes)]):
            tree = trees.tree[u]
            if tree not in drawn:
                drawn = {tree: np.ones(len(rows)) if seed is None else weights(rows["_id"].to_numpy(), tree, seed)}
            slots = np.full(trees.feature.shape[1], -1)
            slots[nodes[start:end, 1]] = np.arange(end - start)
            slot = slots[trees.reach(u, bins)]
            live = (slot >= 0) & (drawn[tree] > 0)
            w = drawn[tree][live].astype(float)
            at = (cell[live] + slot[live, None] * width).ravel()
            of_n, of_s = _both(at, w, w * steps[live, trees.hour[u]], features, (end - start) * width)
            n[start:end] += of_n.reshape(-1, width)
            s[start:end] += of_s.reshape(-1, width)
    out = []
    for (u, node), of_n, of_s in zip(nodes, n, s):
        if of_n.any():
            whole = [m.astype(np.int64).reshape(features, BINS) for m in (of_n, of_s)]
            out += [(u, node, b, *[m[b : b + TOGETHER].tobytes() for m in whole]) for b in range(0, features, TOGETHER)]
        if len(out) >= 256:
            yield pd.DataFrame(out, columns=["unit", "node", "block", "n", "s"])
            out = []
    if out:
        yield pd.DataFrame(out, columns=["unit", "node", "block", "n", "s"])


def _best_splits(batches: Iterator[pd.DataFrame], kind: Kind) -> Iterator[pd.DataFrame]:
    """The best split of each node within each block of features; feature -1 if there is none.

    All sums of a pass fit in SUMS_BYTES, whatever part of them a task gets.
    """
    whole: dict[tuple, list[np.ndarray]] = {}
    for rows in batches:
        for unit, node, block, n, s in rows.itertuples(index=False):
            parts = [np.frombuffer(m, np.int64) for m in (n, s)]
            had = whole.get((unit, node, block))
            whole[unit, node, block] = parts if had is None else [x + y for x, y in zip(had, parts)]
    found = []
    for (unit, node, block), parts in whole.items():
        n, s = (m.reshape(-1, BINS) for m in parts)
        all_n, all_s = int(n[0].sum()), int(s[0].sum())
        left_n, left_s = n.cumsum(axis=1), s.cumsum(axis=1)
        gain = _score(left_n, left_s, kind) + _score(all_n - left_n, all_s - left_s, kind) - _score(all_n, all_s, kind)
        gain[np.minimum(left_n, all_n - left_n) < kind.smallest_leaf] = -1.0
        f, b = np.unravel_index(gain.argmax(), gain.shape)
        split = (block + f, b, gain[f, b]) if gain[f, b] > 1e-9 else (-1, 0, 0.0)
        found.append((unit, node, *split, all_n, all_s, left_n[f, b], left_s[f, b]))
    yield pd.DataFrame(found, columns=[c.split()[0] for c in _SPLIT.split(", ")])


def _score(weight, total, kind: Kind):
    return (total / STEPS) ** 2 / np.maximum(weight + kind.ridge, 1e-12)


def grow(binned: DataFrame, trees: Trees, before: Trees | None, depth: int, kind: Kind, features: int, seed: int | None) -> Trees:
    """The trees grown to a depth, one pass over the samples for each level; `before` is taken off the targets first."""
    feature, bin_, value, gain = trees.feature.copy(), trees.bin.copy(), trees.value.copy(), trees.gain.copy()
    nodes, most = np.array([(u, 1) for u in range(len(trees.tree))]), max(1, SUMS_BYTES // (16 * features * BINS))
    for _ in range(depth):
        now, chosen = replace(trees, feature=feature, bin=bin_), []
        for some in np.split(nodes, range(most, len(nodes), most)):
            parts = binned.mapInPandas(partial(_sums, trees=now, nodes=some, before=before, features=features, seed=seed), _PARTIAL)
            best = parts.repartition("unit", "node", "block").mapInPandas(partial(_best_splits, kind=kind), _SPLIT)
            chosen += _best_of(best.collect())
        for r in chosen:
            u, node = r["unit"], r["node"]
            if node == 1:
                value[u, 1] = r["s"] / STEPS / max(r["n"] + kind.ridge, 1e-12)
            if r["feature"] < 0:
                continue
            feature[u, node], bin_[u, node], gain[u, node] = r["feature"], r["bin"], r["gain"]
            n, s = r["n_left"], r["s_left"]
            value[u, 2 * node] = s / STEPS / (n + kind.ridge)
            value[u, 2 * node + 1] = (r["s"] - s) / STEPS / (r["n"] - n + kind.ridge)
        nodes = np.array(sorted((r["unit"], 2 * r["node"] + k) for r in chosen if r["feature"] >= 0 for k in (0, 1)))
        if not len(nodes):
            break
    grown = replace(trees, feature=feature, bin=bin_, value=value, gain=gain)
    return grown if kind.most_leaves is None else best_first(grown, kind.most_leaves)


def _best_of(splits: list) -> list:
    """The best of each node's blocks; the first feature among equals."""
    best: dict[tuple, tuple] = {}
    for r in splits:
        rank = r["gain"], -r["feature"]
        key = r["unit"], r["node"]
        if key not in best or rank > best[key][0]:
            best[key] = rank, r
    return [best[key][1] for key in sorted(best)]


def best_first(trees: Trees, leaves: int) -> Trees:
    """What is left if, of all nodes that could be split, the one with the highest gain always is, up to a number of leaves.

    A node's gain does not depend on the order of splits, so the trees may be grown by levels before.
    """
    feature = np.full_like(trees.feature, -1)
    for u in range(len(trees.tree)):
        open_nodes = [1]
        for _ in range(leaves - 1):
            open_nodes = [k for k in open_nodes if trees.feature[u, k] >= 0]
            if not open_nodes:
                break
            node = max(open_nodes, key=lambda k: (trees.gain[u, k], -k))
            feature[u, node] = trees.feature[u, node]
            open_nodes = [k for k in open_nodes if k != node] + [2 * node, 2 * node + 1]
    return replace(trees, feature=feature)


def _settings(model: str, params: dict[str, float]) -> dict[str, float]:
    if model not in KINDS:
        raise ValueError(f"unknown model: {model}")
    p = {k: v for k, v in params.items() if k in K.ALLOWED_PARAMS[model]}
    return {
        "trees": int(p.get("n_estimators", 30)),
        "depth": int(p.get("max_depth", 3)),
        "rate": float(p.get("learning_rate", 0.1)),
        "seed": int(p.get("random_state", K.RANDOM_SEED)),
    }


def _ready(samples: DataFrame) -> DataFrame:
    # rounded, since sums of doubles depend on their order and a plant must not change sides of an edge between two scans
    return with_plant_behaviour(samples).withColumn("_x", F.transform("_x", lambda v: F.round(finite(v), 9)))


def _training(samples: DataFrame) -> DataFrame:
    key = F.xxhash64("plant_id", "sample_idx").alias("_id")
    return _ready(samples).filter("part = 'train'").select(key, "_x", F.transform("y", finite).alias("_y"))


def fit_forest(samples: DataFrame, model: str, params: dict[str, float], horizons: range = range(K.HOURS_PER_DAY), bootstrap: bool = True, parallelism: int = 8) -> Forest:
    """Trees of all hours ahead, fitted on the training part of all plants."""
    kind, own, hours = KINDS[model] if model in KINDS else None, _settings(model, params), list(horizons)
    train = _training(samples)
    y = [F.col("_y")[h] for h in hours]
    row = train.agg(F.count(F.lit(1)), *[F.struct(F.avg(c), F.min(c), F.max(c)) for c in y]).first()
    if not row[0]:
        raise ValueError("too few samples to train and test")
    centre = np.round([r[0] for r in row[1:]], 9)
    span = np.array([r[2] - r[1] or 1.0 for r in row[1:]])
    edges = bin_edges(train)
    features, depth = len(edges), own["depth"]
    cutting = partial(_in_bins, edges=edges, hours=hours, centre=centre, span=span)
    binned = store(train.mapInPandas(cutting, "_id long, _bins binary, _y array<double>"))
    count = len(hours)
    try:
        if kind.boosted:
            binned, trees = _boosted(binned, own, kind, features, count)
            return Forest(trees, edges, centre, span, 1.0)
        numbers = np.arange(own["trees"] * count)
        size = -(-len(numbers) // parallelism)
        blocks = [Trees.blank(part // count, part % count, depth) for part in np.split(numbers, range(size, len(numbers), size))]
        seed = own["seed"] if bootstrap else None
        few = _few(binned, len(blocks))
        with ThreadPoolExecutor(parallelism) as pool:
            grown = list(pool.map(lambda t: grow(few, t, None, depth, kind, features, seed), blocks))
        return Forest(Trees.joined(grown), edges, centre, span, 1.0 / own["trees"])
    finally:
        discard(binned)


def _few(binned: DataFrame, jobs: int) -> DataFrame:
    """Binned samples in as many partitions as it takes to keep the cluster busy with a number of jobs at a time.

    Each task sends out its sums for all nodes, whatever samples it has, so that their bytes grow with the tasks; it reads
    its samples batch by batch. The number of tasks therefore follows the cores and not the samples.
    """
    return binned.coalesce(-(-2 * binned.sparkSession.sparkContext.defaultParallelism // max(2, jobs)))


def _boosted(binned: DataFrame, own: dict, kind: Kind, features: int, hours: int) -> tuple[DataFrame, Trees]:
    """One tree per hour and round on what the earlier ones left over, each shrunken by the rate, the first included.

    Where the samples have fewer partitions than the cluster has cores, the hours of a round go out in several jobs.
    """
    done, since = [], []
    jobs = -(-binned.sparkSession.sparkContext.defaultParallelism // binned.rdd.getNumPartitions())
    parts = np.array_split(np.arange(hours), min(jobs, hours))

    def next_trees(k: int, few: DataFrame, some: np.ndarray) -> Trees:
        before = Trees.joined(since).of_hours(some) if since else None
        return grow(few, Trees.blank([k] * len(some), some, own["depth"]), before, own["depth"], kind, features, None)

    with ThreadPoolExecutor(len(parts)) as pool:
        for k in range(own["trees"]):
            few = _few(binned, 1)
            grown = Trees.joined(list(pool.map(partial(next_trees, k, few), parts)))
            since.append(replace(grown, value=grown.value * own["rate"]))
            if len(since) == REWRITE and k < own["trees"] - 1:
                rest = store(binned.mapInPandas(partial(_left_over, features=features, trees=Trees.joined(since)), binned.schema))
                discard(binned)
                binned, done, since = rest, done + since, []
    return binned, Trees.joined(done + since)


def score(samples: DataFrame, forest: Forest) -> DataFrame:
    """Forecasts of the test part in scaled units, for all hours the forest knows, and each sample's share of the time they took.

    The plant's behaviour is taken from the training part of the same samples.
    """
    text = forest.to_json()

    @F.pandas_udf("y_pred array<double>, seconds double")
    def predicted(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model = Forest.from_json(text)
        for x in batches:
            started = time.perf_counter()
            found = list(model.predict(np.vstack(x)))
            yield pd.DataFrame({"y_pred": found, "seconds": share_of_time(started, len(x))})

    test = _ready(samples).filter("part = 'test'").withColumn("_p", predicted("_x"))
    return test.withColumns({"y_pred": F.col("_p.y_pred"), "inference_time_sec": F.col("_p.seconds")}).drop("_x", "_p")


def save_forest(spark: SparkSession, forest: Forest, path: str) -> None:
    spark.createDataFrame([(forest.to_json(),)], "model string").coalesce(1).write.mode("overwrite").parquet(path)


def load_forest(spark: SparkSession, path: str) -> Forest:
    return Forest.from_json(spark.read.parquet(path).first()["model"])


def digest(samples: DataFrame, model: str, params: dict[str, float], horizons: range) -> str:
    """What a fit depends on: the training samples, in any order and partitioning, and the parameters used."""
    train = samples.filter("part = 'train'")
    of = F.xxhash64("plant_id", "sample_idx", "features", "y")
    found = train.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(of).alias("x"), F.sum(of.cast("decimal(38,0)")).alias("s")).first()
    told = sorted(_settings(model, params).items())
    return hashlib.sha256(repr((found["n"], found["x"], str(found["s"]), model, told, list(horizons))).encode()).hexdigest()


def fit_trees(
    samples: DataFrame,
    model: str,
    params: dict[str, float],
    horizons: range = range(K.HOURS_PER_DAY),
    registry: str | None = None,
) -> tuple[DataFrame, Forest]:
    """Forecasts of the test part in scaled units, and the fitted trees.

    With a `registry` folder, trees that were fitted before on the same samples with the same parameters are read from
    there, others are added. `samples` is read several times, so give it stored.
    """
    spark = samples.sparkSession
    path = None
    if registry is not None:
        path = f"{registry.rstrip('/')}/{digest(samples, model, params, horizons)}"
        if written(spark, f"{path}/_SUCCESS"):
            forest = load_forest(spark, path)
            return score(samples, forest), forest
    forest = fit_forest(samples, model, params, horizons)
    if path is not None:
        save_forest(spark, forest, path)
    return score(samples, forest), forest
