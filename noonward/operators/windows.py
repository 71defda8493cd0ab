"""Samples: a stretch of the past, the forecast of the time ahead, and the truth."""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noonward import constants as K
from noonward.operators import timeline as T
from noonward.operators.prepare import FeaturePlan, Prepared, scale

_LO, _HI = f"lo_{K.TARGET}", f"hi_{K.TARGET}"


def _blank(hours: int, width: int) -> Column:
    return F.array_repeat(F.array_repeat(F.lit(0.0), width), hours)


def _columns(names: list[str], scaled: bool) -> Column:
    if not names:
        return F.array().cast("array<double>")
    return F.array(*[scale(c) if scaled else F.col(c).cast("double") for c in names])


def day_rows(hours: DataFrame, marks: DataFrame, plan: FeaturePlan, scaled: bool = True) -> DataFrame:
    """One row per complete day with its 24 hours as arrays.

    `marks` is the spine limited to complete days, so no array has more than 24 entries.
    """
    hour = F.struct(
        F.col("Hour"),
        _columns(plan.hist, scaled).alias("h"),
        _columns(plan.fcst, scaled).alias("f"),
        F.col(K.TARGET).cast("double").alias("t"),
    )
    carried = [c for c in marks.columns if c not in T.DAY and not c.startswith(("lo_", "hi_"))] + [_LO, _HI]
    grouped = (
        hours.join(marks, T.DAY)
        .groupBy(*T.DAY)
        .agg(F.sort_array(F.collect_list(hour)).alias("r"), *[F.first(c).alias(c) for c in carried])
    )
    return grouped.select(
        *T.DAY,
        *carried,
        F.transform("r", lambda x: x["h"]).alias("x_day"),
        F.transform("r", lambda x: x["f"]).alias("x_fcst"),
        F.transform("r", lambda x: x["t"]).alias("y_true"),
    )


def daily_samples(
    prepared: Prepared,
    past_hours: int,
    scaled: bool = True,
    split: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """One sample per day: past_hours // 24 present days of history, the day's forecast, its 24 targets.

    Columns: plant_id, date, sample_idx, n_samples, x_hist, x_fcst (hours x features), y_true, end_dt
    (the last hour predicted), the plant's target extremes and whatever `split` adds to the numbered spine (see splits.daily_part),
    where one short row per day is moved instead of the samples. Without history x_hist holds zeros.
    """
    plan, past_days = prepared.plan, past_hours // K.HOURS_PER_DAY
    with_history = bool(plan.hist) and not plan.forecast_only
    numbered = T.number_samples(prepared.spine, past_days, with_history)
    known = set(numbered.columns)
    numbered = split(numbered) if split else numbered
    added = [c for c in numbered.columns if c not in known]
    marks = numbered.filter("complete").drop(
        "complete", "hist_ok", "required_ok", "n_rows", "row_offset", "plant_rows"
    )
    if not with_history or not past_days:
        marks = marks.filter(F.col("sample_idx").isNotNull())
    if not with_history:
        plan = FeaturePlan([], plan.fcst, plan.forecast_only)
    days = day_rows(prepared.hours, marks, plan, scaled)
    if not with_history or not past_days:
        width = max(1, len(prepared.plan.hist))
        samples = days.withColumn("x_hist", _blank(past_hours, width))
    else:
        spread = T.spread_to_blocks(days, "day_pos", past_days, 0, T.DAYS_PER_BLOCK)
        before = T.block_window("day_pos").rangeBetween(-past_days, -1)
        samples = (
            spread.withColumn("x_hist", F.flatten(F.collect_list("x_day").over(before)))
            .filter("in_own_block")
            .filter(F.col("sample_idx").isNotNull())
        )
    last_hour = F.col("date").cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.lit(K.HOURS_PER_DAY - 1))
    return samples.select(
        *T.DAY, "sample_idx", "n_samples", *added, "x_hist", "x_fcst", "y_true", last_hour.alias("end_dt"), _LO, _HI
    )


def sliding_samples(
    prepared: Prepared,
    past_hours: int,
    future_hours: int = 24,
    scaled: bool = True,
    split: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """One sample per row position with past_hours rows before it and future_hours rows from it on.

    Positions count rows, so a sample may span a gap in time. `end_dt` is the last hour predicted;
    `split` may add columns to the rows a sample starts at (see splits.hourly_part).
    """
    plan = prepared.plan
    columns = list(dict.fromkeys([*plan.all_columns, K.TARGET]))
    bounds = [f"{side}_{c}" for c in columns for side in ("lo", "hi")]
    placed = T.add_position(prepared.hours, prepared.spine, *bounds)
    with_history = bool(plan.hist) and not plan.forecast_only
    is_start = (F.col("pos") >= past_hours) & (F.col("pos") + future_hours <= F.col("plant_rows"))
    rows = placed.select(
        T.PLANT,
        "dt",
        "Hour",
        "pos",
        F.when(is_start, F.col("pos") - past_hours).alias("sample_idx"),
        (F.col("plant_rows") - past_hours - future_hours + 1).alias("n_samples"),
        _LO,
        _HI,
        _columns(plan.hist if with_history else [], scaled).alias("h"),
        _columns(plan.fcst, scaled).alias("f"),
        F.col(K.TARGET).cast("double").alias("t"),
    )
    known = set(rows.columns)
    rows = split(rows) if split else rows
    added = [c for c in rows.columns if c not in known]
    size = max(T.HOURS_PER_BLOCK, past_hours + future_hours)
    spread = T.spread_to_blocks(rows, "pos", past_hours, future_hours - 1, size)
    w = T.block_window("pos")
    past, ahead = w.rangeBetween(-past_hours, -1), w.rangeBetween(0, future_hours - 1)
    blank = _blank(past_hours or 1, len(plan.hist))
    history = F.collect_list("h").over(past) if with_history and past_hours else blank
    return (
        spread.withColumn("x_hist", history)
        .withColumn("_ahead", F.collect_list(F.struct("Hour", "f", "t", "dt")).over(ahead))
        .filter("in_own_block")
        .filter(F.col("sample_idx").isNotNull())
        .select(
            T.PLANT,
            F.col("dt").cast("date").alias("date"),
            "sample_idx",
            "n_samples",
            *added,
            "x_hist",
            F.transform("_ahead", lambda x: x["f"]).alias("x_fcst"),
            F.transform("_ahead", lambda x: x["t"]).alias("y_true"),
            F.transform("_ahead", lambda x: x["Hour"]).alias("hours"),
            F.element_at("_ahead", -1)["dt"].alias("end_dt"),
            _LO,
            _HI,
        )
    )


def flatten_sample(x_hist: str = "x_hist", x_fcst: str = "x_fcst") -> Column:
    """History hour by hour, then the forecast hour by hour."""
    return F.concat(F.flatten(x_hist), F.flatten(x_fcst))


def scaled_target(y_true: str = "y_true") -> Column:
    lo, hi = F.col(_LO), F.col(_HI)
    return F.transform(y_true, lambda y: F.coalesce((y - lo) / F.nullif(hi - lo, F.lit(0.0)), F.lit(0.0)))
