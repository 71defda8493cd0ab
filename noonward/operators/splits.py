"""Train, validation and test parts."""

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from noonward import constants as K
from noonward.operators.prepare import plant_settings
from noonward.operators.timeline import rank_by_bucket


def _share(ratio: float | Column) -> Column:
    return ratio if isinstance(ratio, Column) else F.lit(float(ratio))


def part_of(rank, total, train: float | Column = K.TRAIN_RATIO, val: float | Column = K.VAL_RATIO) -> Column:
    """The first share trains, the next validates, all the rest tests; shares may be columns."""
    rank, total = F.col(rank), F.col(total)
    n_train = F.floor(total * _share(train))
    n_val = F.floor(total * _share(val))
    return F.when(rank < n_train, "train").when(rank < n_train + n_val, "val").otherwise("test")


def part_by_boundary(rank, total, train: float = K.TRAIN_RATIO, val: float = K.VAL_RATIO) -> Column:
    """As part_of, but validation ends at the share of both parts together."""
    rank, total = F.col(rank), F.col(total)
    n_train = F.floor(total * F.lit(float(train)))
    n_both = F.floor(total * F.lit(float(train) + float(val)))
    return F.when(rank < n_train, "train").when(rank < n_both, "val").otherwise("test")


def shuffle_key(seed: int | Column, sample_idx: str = "sample_idx") -> Column:
    seed = seed if isinstance(seed, Column) else F.lit(seed)
    return F.md5(F.concat(seed.cast("string"), F.lit(":"), F.col(sample_idx).cast("string")))


#: Settings of a plant that a split follows.
SPLIT_SETTINGS = ["train_ratio", "val_ratio", "shuffle_split", "random_seed"]


def _followed(rows: DataFrame, settings: DataFrame | None, *given) -> tuple[DataFrame, list]:
    """Rows with their plant's settings, and train, val, shuffle and seed: the plant's own or else those given."""
    if settings is None:
        return rows, list(given)
    joined = rows.join(plant_settings(settings, *SPLIT_SETTINGS), "plant_id", "left")
    return joined, [F.coalesce(f"_{n}", F.lit(v)) for n, v in zip(SPLIT_SETTINGS, given)]


#: Samples of a plant in a bucket of the shuffled order, about.
BUCKET = 4096


def shuffled_rank(samples: DataFrame, seed: int | Column = K.RANDOM_SEED, out: str = "rank") -> DataFrame:
    """Rank in a repeatable random order.

    The order is that of a hash of seed and sample number, ranked bucket by bucket of its first digits. A plant has
    as many buckets as its n_samples asks for, so that none grows with its history.
    """
    keyed = samples.withColumn("_key", shuffle_key(seed))
    spread = F.conv(F.substring("_key", 1, 7), 16, 10).cast("long") * F.ceil(F.col("n_samples") / BUCKET)
    return rank_by_bucket(keyed, F.floor(spread / 16**7), "_key", out=out).drop("_key")


#: Orders of a shuffled split: by a hash of the sample, or by the permutation of NumPy's legacy generator (MT19937).
ORDERS = ["hash", "mt19937"]


def permutations(sizes: DataFrame) -> DataFrame:
    """(seed, n_samples, sample_idx, rank): where each sample stands in the permutation of `n_samples` under `seed`.

    `sizes` has seed and n_samples. Each pair is drawn once, however many plants have it, in a task of its own; the
    table is never longer than the samples it is for.
    """

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for seed, n in zip(batch["seed"], batch["n_samples"]):
                order = np.random.RandomState(seed).permutation(n)
                for k in range(0, n, 100_000):
                    part = order[k : k + 100_000]
                    at = np.arange(k, k + len(part))
                    yield pd.DataFrame({"seed": seed, "n_samples": n, "sample_idx": part, "rank": at})

    pairs = sizes.select(F.col("seed").cast("long").alias("seed"), F.col("n_samples").cast("long").alias("n_samples"))
    pairs = pairs.filter("n_samples > 0").distinct().repartition("seed", "n_samples")
    return pairs.mapInPandas(draw, "seed long, n_samples long, sample_idx long, rank long")


def permuted_rank(samples: DataFrame, seed: int | Column = K.RANDOM_SEED, out: str = "rank") -> DataFrame:
    """Rank of each sample in the permutation of its plant's samples; empty for rows that are no sample."""
    seed = seed if isinstance(seed, Column) else F.lit(seed)
    rows = samples.withColumn("_seed", seed.cast("long"))
    drawn = permutations(rows.filter("sample_idx is not null").select(F.col("_seed").alias("seed"), "n_samples"))
    drawn = drawn.select(F.col("seed").alias("_seed"), "n_samples", "sample_idx", F.col("rank").alias(out))
    return rows.join(drawn, ["_seed", "n_samples", "sample_idx"], "left").select(*samples.columns, out)


def daily_part(
    shuffle: bool,
    train: float = K.TRAIN_RATIO,
    val: float = K.VAL_RATIO,
    seed: int = K.RANDOM_SEED,
    out: str = "part",
    settings: DataFrame | None = None,
    order: str = "hash",
):
    """A step that adds the part to a numbered day spine (one short row per plant and day).

    With `settings` a plant's own ratios, shuffling and seed go before those given. `order` is one of ORDERS.
    """
    if order not in ORDERS:
        raise ValueError(f"unknown order: {order}")

    def add(numbered: DataFrame) -> DataFrame:
        spine, (own_train, own_val, own_shuffle, own_seed) = _followed(numbered, settings, train, val, shuffle, seed)
        if shuffle or settings is not None:
            shuffled = F.lit(own_shuffle) if settings is None else own_shuffle
            spine = daily_rank(shuffled, own_seed, order, "_rank")(spine)
        else:
            spine = spine.withColumn("_rank", F.col("sample_idx"))
        part = F.when(F.col("sample_idx").isNotNull(), part_of("_rank", "n_samples", own_train, own_val))
        return spine.withColumn(out, part).select(*numbered.columns, out)

    return add


def daily_rank(shuffle: Column, seed: int | Column = K.RANDOM_SEED, order: str = "hash", out: str = "rank"):
    """A step that adds to a numbered day spine where each sample day stands, in order of time or shuffled."""

    def add(spine: DataFrame) -> DataFrame:
        if order == "mt19937":
            drawn = permuted_rank(spine, seed, "_drawn")
            return drawn.withColumn(out, F.when(shuffle, F.col("_drawn")).otherwise(F.col("sample_idx"))).drop("_drawn")
        key = F.when(shuffle, shuffle_key(seed))
        by_key = Window.partitionBy("plant_id").orderBy(F.col("sample_idx").isNull(), key, "sample_idx")
        return spine.withColumn(out, F.row_number().over(by_key) - 1)

    return add


def hourly_part(
    shuffle: bool,
    train: float = K.TRAIN_RATIO,
    val: float = K.VAL_RATIO,
    seed: int = K.RANDOM_SEED,
    out: str = "part",
    settings: DataFrame | None = None,
    order: str = "hash",
):
    """A step that adds the part to hourly rows, each the start of a sliding sample; `settings`, `order` as for daily_part.

    It runs before the samples are put together, so only single rows are moved.
    """
    if order not in ORDERS:
        raise ValueError(f"unknown order: {order}")

    def add(rows: DataFrame) -> DataFrame:
        if not shuffle and settings is None:
            return rows.withColumn(out, part_of("sample_idx", "n_samples", train, val))
        numbers = rows.filter("sample_idx is not null").select("plant_id", "pos", "sample_idx", "n_samples")
        numbers, (own_train, own_val, own_shuffle, own_seed) = _followed(numbers, settings, train, val, shuffle, seed)
        ranked = (permuted_rank if order == "mt19937" else shuffled_rank)(numbers, own_seed, "_rank")
        if settings is not None:
            ranked = ranked.withColumn("_rank", F.when(own_shuffle, F.col("_rank")).otherwise(F.col("sample_idx")))
        parts = ranked.select("plant_id", "pos", part_of("_rank", "n_samples", own_train, own_val).alias(out))
        return rows.join(parts, ["plant_id", "pos"], "left")

    return add
