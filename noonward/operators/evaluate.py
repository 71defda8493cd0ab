"""Forecast tables and their scores.

A forecast table has plant_id, experiment_name, model, sample_idx, date, horizon, y_true, y_pred.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noonward import constants as K
from noonward.functions.metrics import valid_pair
from noonward.functions.columns import half_even


def mean_of_past_days(past_days: int) -> Column:
    """Forecast each hour by the mean of that hour over the past days of a one-column history."""
    hours = F.sequence(F.lit(0), F.lit(K.HOURS_PER_DAY - 1))
    days = F.sequence(F.lit(0), F.lit(past_days - 1))
    at = lambda d, h: F.col("x_hist")[d * K.HOURS_PER_DAY + h][0]
    return F.transform(hours, lambda h: F.aggregate(days, F.lit(0.0), lambda s, d: s + at(d, h)) / past_days)


def stamps_from_end(end, horizon, length=K.HOURS_PER_DAY) -> Column:
    """Hour a step is for, counted back from the last hour of the window."""
    length = F.col(length) if isinstance(length, str) else F.lit(length)
    return F.col(end) - F.make_dt_interval(F.lit(0), length - 1 - F.col(horizon))


def long_forecasts(samples: DataFrame, y_pred, *keep: str) -> DataFrame:
    """One row per sample and hour ahead, stamped with the hour it is for."""
    y_pred = F.col(y_pred) if isinstance(y_pred, str) else y_pred
    known = ["plant_id", *keep, "sample_idx", "date"]
    steps = samples.withColumns({"_p": y_pred, "_n": F.size("y_true")}).select(
        *known, "end_dt", "_n", F.posexplode(F.arrays_zip("y_true", "_p")).alias("horizon", "v")
    )
    return steps.select(
        *known,
        "horizon",
        stamps_from_end("end_dt", "horizon", "_n").alias("forecast_datetime"),
        F.col("v.y_true").alias("y_true"),
        F.col("v._p").alias("y_pred"),
    )


def daily_metrics(forecasts: DataFrame, *keys: str) -> DataFrame:
    """MAE and RMSE per sample day averaged over days; R2 over all pairs.

    Sums are taken per day first and rolled up from there, so the pairs are read once. R2 comes from
    the day moments: the total spread is the spread within days plus that between day means.
    """
    t, g = valid_pair("y_true", "y_pred")
    per_day = forecasts.groupBy(*keys, "sample_idx").agg(
        F.count(t).alias("_n"),
        F.avg(F.abs(t - g)).alias("_mae"),
        F.avg((t - g) * (t - g)).alias("_mse"),
        F.avg(t).alias("_mean"),
        F.var_pop(t).alias("_var"),
        F.min(t).alias("_lo"),
        F.max(t).alias("_hi"),
    )
    filled = per_day.filter(F.col("_n") > 0)
    n = F.sum("_n")
    center = F.sum(F.col("_n") * F.col("_mean")) / n
    between = F.sum(F.col("_n") * F.col("_mean") * F.col("_mean")) - n * center * center
    rolled = filled.groupBy(*keys).agg(
        F.avg("_mae").alias("mae"),
        F.avg(F.sqrt("_mse")).alias("rmse"),
        F.sum(F.col("_n") * F.col("_mse")).alias("_res"),
        (F.sum(F.col("_n") * F.col("_var")) + F.greatest(between, F.lit(0.0))).alias("_tot"),
        (F.max("_hi") - F.min("_lo")).alias("range_true"),
        F.count(F.lit(1)).alias("n_days"),
        n.alias("samples"),
    )
    constant = F.col("range_true") == 0
    r2 = F.when(constant, F.when(F.col("_res") == 0, 1.0).otherwise(0.0)).otherwise(
        1 - F.col("_res") / F.nullif(F.col("_tot"), F.lit(0.0))
    )
    return rolled.select(
        *keys,
        half_even("mae", 4).alias("mae"),
        half_even("rmse", 4).alias("rmse"),
        half_even(r2, 4).alias("r2"),
        "n_days",
        "samples",
        "range_true",
        F.sqrt(F.col("_res") / F.col("samples")).alias("flat_rmse"),
    )


def experiment_metrics(forecasts: DataFrame, *keys: str) -> DataFrame:
    """Daily metrics with the squared and the range-normalised RMSE derived from the rounded RMSE."""
    daily = daily_metrics(forecasts, *keys)
    return daily.withColumns(
        {
            "mse": F.col("rmse") * F.col("rmse"),
            "nrmse": F.col("rmse") / F.nullif(F.col("range_true"), F.lit(0.0)),
        }
    )


def study_daily_metrics(forecasts: DataFrame, *keys: str, days: str | None = None) -> DataFrame:
    """Daily MAE, RMSE and R2 with the flat RMSE over the range of the truth, per study row.

    `days` names a column for the number of days or windows.
    """
    counted = [F.col("n_days").alias(days)] if days else []
    spread = F.col("range_true")
    nrmse = F.when(spread == 0, F.lit(float("inf"))).otherwise(F.col("flat_rmse") / F.nullif(spread, F.lit(0.0)))
    return daily_metrics(forecasts, *keys).select(
        *keys, "mae", "rmse", "r2", F.col("samples").alias("test_samples"), nrmse.alias("nrmse"), *counted
    )


def hours_ahead(forecasts: DataFrame, horizons: list[int] = K.MULTI_HORIZONS) -> DataFrame:
    """For each h, the forecast made h steps ahead against the first true value of the sample it is for.

    Sample i's step h lines up with sample i + h - 1. Both sides carry the sample number as join key,
    so nothing needs the order of a whole plant.
    """
    keys = ["plant_id", "experiment_name", "model"]
    made = (
        forecasts.withColumn("h", F.col("horizon") + 1)
        .filter(F.col("h").isin(horizons))
        .select(*keys, "h", (F.col("sample_idx") + F.col("h") - 1).alias("sample_idx"), "y_pred")
    )
    first = forecasts.filter("horizon = 0").select(*keys, "sample_idx", "y_true")
    return made.join(first, [*keys, "sample_idx"])
