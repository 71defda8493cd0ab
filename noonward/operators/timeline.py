"""Order along a plant's timeline without bringing a whole plant into one task.

Hourly rows are only ever grouped by (plant, day) or (plant, block of positions). What needs the
order over a whole plant (day positions, row offsets, the last value of the day before) is worked
out on the day spine, which has one short row per plant and calendar day, and joined back by day.
"""

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from noonward import constants as K
from noonward.functions.columns import all_present

PLANT = "plant_id"
DAY = ["plant_id", "date"]
DAYS_PER_BLOCK = 128
HOURS_PER_BLOCK = 672


def _by_date():
    return Window.partitionBy(PLANT).orderBy("date")


def _whole():
    return Window.partitionBy(PLANT)


def _within_day():
    return Window.partitionBy(*DAY).orderBy("dt")


def previous_value(hours: DataFrame, value: str, out: str) -> DataFrame:
    """The value of the plant's row before, empty at its first row."""
    last = hours.groupBy(*DAY).agg(F.max_by(value, "dt").alias("_last"))
    carried = last.select(*DAY, F.lag("_last").over(_by_date()).alias("_carried"))
    first_of_day = F.row_number().over(_within_day()) == 1
    return (
        hours.join(carried, DAY)
        .withColumn(out, F.when(first_of_day, F.col("_carried")).otherwise(F.lag(value).over(_within_day())))
        .drop("_carried")
    )


def summarize_days(
    hours: DataFrame,
    scaled: Iterable[str] = (),
    hist: Iterable[str] = (),
    required: Iterable[str] = (K.TARGET,),
) -> DataFrame:
    """Rows, filled columns and extremes of each plant and present day; combined before the shuffle."""
    scaled = list(scaled)
    return hours.groupBy(*DAY).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.bool_and(all_present(list(hist))).alias("hist_ok"),
        F.bool_and(all_present(list(required))).alias("required_ok"),
        *[F.min(c).alias(f"lo_{c}") for c in scaled],
        *[F.max(c).alias(f"hi_{c}") for c in scaled],
    )


def spine_of(days: DataFrame) -> DataFrame:
    """One row per plant and present day.

    day_pos counts present days from 0, row_offset the rows before the day, plant_rows all rows;
    complete tells whether the day has 24 rows, hist_ok and required_ok whether those columns are
    filled throughout; lo_<c> and hi_<c> become the plant's extremes of each scaled column.
    """
    by_date = _by_date()
    earlier = by_date.rowsBetween(Window.unboundedPreceding, -1)
    return days.select(
        *DAY,
        "n_rows",
        (F.col("n_rows") == K.HOURS_PER_DAY).alias("complete"),
        "hist_ok",
        "required_ok",
        (F.row_number().over(by_date) - 1).cast("long").alias("day_pos"),
        F.coalesce(F.sum("n_rows").over(earlier), F.lit(0)).cast("long").alias("row_offset"),
        F.sum("n_rows").over(_whole()).alias("plant_rows"),
        *[F.min(c).over(_whole()).alias(c) for c in days.columns if c.startswith("lo_")],
        *[F.max(c).over(_whole()).alias(c) for c in days.columns if c.startswith("hi_")],
    )


def day_spine(
    hours: DataFrame,
    scaled: Iterable[str] = (),
    hist: Iterable[str] = (),
    required: Iterable[str] = (K.TARGET,),
) -> DataFrame:
    return spine_of(summarize_days(hours, scaled, hist, required))


def number_samples(spine: DataFrame, past_days: int, need_history: bool = True) -> DataFrame:
    """Add sample_idx (empty where the day is no sample) and n_samples to the spine.

    A day is a sample when it is complete and filled, when it is at least the (past_days + 2)-th
    present day and when the past_days present days before it are complete and filled.
    """
    usable = F.col("complete") & F.col("hist_ok") if need_history else F.col("complete")
    if past_days:
        before = F.sum(usable.cast("int")).over(_by_date().rowsBetween(-past_days, -1))
        spine = spine.withColumn("_sample", F.coalesce(before == past_days, F.lit(False)))
    else:
        spine = spine.withColumn("_sample", F.lit(True))
    is_sample = (
        F.col("_sample") & (F.col("day_pos") > past_days) & F.col("complete") & F.col("required_ok")
    )
    return (
        spine.withColumn("_sample", is_sample)
        .withColumn("_seen", F.sum(F.col("_sample").cast("long")).over(_by_date().rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("sample_idx", F.when(F.col("_sample"), F.col("_seen") - 1))
        .withColumn("n_samples", F.sum(F.col("_sample").cast("long")).over(_whole()))
        .drop("_sample", "_seen")
    )


def add_position(hours: DataFrame, spine: DataFrame, *carry: str) -> DataFrame:
    """Position of each row in its plant's timeline, from 0."""
    return (
        hours.join(spine.select(*DAY, "row_offset", "plant_rows", *carry), DAY)
        .withColumn("pos", F.col("row_offset") + F.row_number().over(_within_day()) - 1)
        .drop("row_offset")
    )


def spread_to_blocks(rows: DataFrame, pos: str, before: int, after: int, size: int) -> DataFrame:
    """Copy each row to all blocks of `size` positions that need it.

    A row serves the positions from `after` below to `before` above its own, so only rows near a
    block's edge are copied. `in_own_block` tells the originals from the copies.
    """
    here = F.col(pos)
    first = F.greatest(here - after, F.lit(0))
    blocks = F.sequence(F.floor(first / size), F.floor((here + before) / size))
    return rows.withColumn("block", F.explode(blocks)).withColumn(
        "in_own_block", F.col("block") == F.floor(here / size)
    )


def block_window(pos: str) -> Window:
    return Window.partitionBy(PLANT, "block").orderBy(pos)


def values_before(hours: DataFrame, spine: DataFrame, value: str, offsets: list[int]) -> DataFrame:
    """Values of a column the given numbers of rows back, as <value>_lag<offset>."""
    placed = spread_to_blocks(add_position(hours, spine), "pos", max(offsets), 0, HOURS_PER_BLOCK)
    w = block_window("pos")
    lagged = placed.select("*", *[F.lag(value, n).over(w).alias(f"{value}_lag{n}") for n in offsets])
    return lagged.filter("in_own_block").drop("block", "in_own_block", "plant_rows")


def rank_by_bucket(rows: DataFrame, bucket: Column, order: str, key: str = PLANT, out: str = "rank") -> DataFrame:
    """Rank rows from 0 within a key when `bucket` rises with `order`; each bucket is ranked by itself."""
    rows = rows.withColumn("_bucket", bucket)
    counts = rows.groupBy(key, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy(key).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(key, "_bucket", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_offset"))
    within = Window.partitionBy(key, "_bucket").orderBy(order)
    return (
        rows.join(offsets, [key, "_bucket"])
        .withColumn(out, F.col("_offset") + F.row_number().over(within) - 1)
        .drop("_bucket", "_offset")
    )
