"""Aggregates over plants, pivots and the records kept of runs."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from noonward import constants as K
from noonward.functions import metrics as M
from noonward.functions.columns import half_even, mean_and_spread
from noonward.operators.moments import deviation, merged, moments
from noonward.sinks.tables import append_batch, batch_of
from noonward.sources.results import read_batches

STUDY_METRICS = ["mae", "rmse", "r2", "nrmse", "train_time"]


def aggregate_over_plants(detailed: DataFrame, *keys: str, windows: str | None = None) -> DataFrame:
    """Mean and sample deviation of each study metric over plants, to 2 places, and the plants."""
    present = [m for m in STUDY_METRICS if m in detailed.columns]
    parts = [c for m in present for c in _mean_std(m)]
    if windows:
        parts.append(F.avg(windows).alias("avg_windows"))
    return detailed.groupBy(*keys).agg(*parts, F.count(F.lit(1)).alias("n_plants"))


def _mean_std(metric: str) -> tuple[Column, Column]:
    return (
        half_even(F.avg(metric), 2).alias(f"{metric}_mean"),
        half_even(F.stddev_samp(metric), 2).alias(f"{metric}_std"),
    )


def _successful(results: DataFrame) -> DataFrame:
    ok = results.filter("status = 'SUCCESS'")
    if {"rmse", "mean_true"} <= set(ok.columns):
        ok = ok.withColumn("nrmse", F.col("rmse") / F.nullif(F.col("mean_true"), F.lit(0.0)))
    return ok


def aggregate_results(results: DataFrame, *group_by: str) -> DataFrame:
    """Mean and deviation of the successful results, per group or, without one, per metric.

    Where the mean of the truth is given, nRMSE is the RMSE over it.
    """
    ok = _successful(results)
    present = [m for m in STUDY_METRICS if m in ok.columns]
    if group_by:
        return ok.groupBy(*group_by).agg(*[c for m in present for c in _mean_std(m)])
    wide = ok.agg(F.count(F.lit(1)).alias("n"), *[c for m in present for c in _mean_std(m)]).filter("n > 0")
    rows = [
        F.struct(F.lit(m).alias("metric"), F.col(f"{m}_mean").alias("mean"), F.col(f"{m}_std").alias("std")) for m in present
    ]
    return wide.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def add_to_aggregate(results: DataFrame, path: str, *group_by: str, batch: str | None = None) -> None:
    """Add the successful results of a batch to the aggregate stored at `path`, without reading what is there.

    The aggregate has a few rows per batch. A batch added again replaces itself; it is known by the plants and
    experiments it holds unless named. Batches must not share results: a result that is done again under another batch
    would count twice.
    """
    ok = _successful(results)
    present = [m for m in STUDY_METRICS if m in ok.columns]
    name = batch or batch_of(results.select("plant_id", "experiment_name"))
    append_batch(moments(ok, list(group_by), present).coalesce(1), path, name)


def stored_aggregate(spark: SparkSession, path: str, *group_by: str) -> DataFrame:
    """What `aggregate_results` gives for all results added at `path`, from their moments alone.

    `group_by` may be fewer columns than the moments were kept by.
    """
    keys = list(group_by)
    whole = merged(read_batches(spark, path), keys)
    mean, std = half_even("mean", 2).alias("mean"), half_even(deviation(), 2).alias("std")
    if not keys:
        return whole.filter("n > 0").select("metric", mean, std)
    found = whole.select(*keys, "metric", mean, std)
    names = [m for m in STUDY_METRICS if m in {r[0] for r in whole.select("metric").distinct().collect()}]
    wide = found.groupBy(*keys).pivot("metric", names).agg(F.first("mean").alias("mean"), F.first("std").alias("std"))
    return wide.select(*keys, *[f"{m}_{part}" for m in names for part in ("mean", "std")])


def pivot_models(aggregated: DataFrame, dimension: str, value: str, models: list[str] = K.MODEL_ORDER) -> DataFrame:
    return aggregated.groupBy(dimension).pivot("model", models).agg(F.first(value))


def pivot_formatted(aggregated: DataFrame, dimension: str, metric: str, models: list[str] = K.MODEL_ORDER) -> DataFrame:
    """Cells 'mean±std', 'mean' where there is no deviation, 'N/A' where there is no value."""
    text = mean_and_spread(f"{metric}_mean", f"{metric}_std")
    wide = pivot_models(aggregated.withColumn("_cell", text), dimension, "_cell", models)
    return wide.select(dimension, *[F.coalesce(F.col(f"`{m}`"), F.lit("N/A")).alias(m) for m in models])


def best_configuration(results: DataFrame, *keys: str) -> DataFrame:
    """The result with the smallest MAE, overall or per key; names decide between equals."""
    best = F.min(F.struct("mae", "plant_id", "experiment_name"))
    ok = results.filter("status = 'SUCCESS' and mae is not null")
    found = (ok.groupBy(*keys) if keys else ok).agg(best.alias("b"))
    return found.select("b.plant_id", "b.experiment_name", "b.mae")


def _given(table: DataFrame, name: str, default, kind: str) -> Column:
    """A column as it is in the table, the default where it is empty or not there."""
    given = F.col(name) if name in table.columns else F.lit(None)
    return F.coalesce(given.cast(kind), F.lit(default).cast(kind)).alias(name)


def summary_rows(results: DataFrame) -> DataFrame:
    """Settings and metrics of each result as kept in its summary."""
    return results.select(
        "plant_id",
        "experiment_name",
        "model",
        _given(results, "use_hist_weather", False, "boolean"),
        _given(results, "use_forecast", False, "boolean"),
        _given(results, "past_days", 1, "int"),
        F.coalesce("complexity", F.lit("low")).alias("model_complexity"),
        F.lit("high").alias("correlation_level"),
        F.coalesce("use_time_encoding", F.lit(True)).alias("use_time_encoding"),
        F.col("lookback_hours").alias("past_hours"),
        F.lit(K.HOURS_PER_DAY).alias("future_hours"),
        (F.col("rmse") * F.col("rmse")).alias("mse"),
        "rmse",
        "mae",
        F.col("r2").alias("r_square"),
        "train_time_sec",
        _given(results, "inference_time_sec", None, "double"),
        "param_count",
        F.col("test_samples").alias("samples_count"),
    )


# What makes two ablation rows the same.
ABLATION_KEY = [
    "model",
    "use_pv",
    "use_hist_weather",
    "use_forecast",
    "weather_category",
    "use_time_encoding",
    "past_days",
    "model_complexity",
]


def ablation_table(results: DataFrame) -> DataFrame:
    """Results in the ablation layout, times and metrics to 4 places."""
    r4 = lambda c: half_even(F.coalesce(F.col(c), F.lit(0.0)), 4)
    return results.select(
        "plant_id",
        "model",
        "use_pv",
        "use_hist_weather",
        "use_forecast",
        "weather_category",
        "use_time_encoding",
        "past_days",
        F.col("complexity").alias("model_complexity"),
        F.coalesce("epochs", F.lit(15)).alias("epochs"),
        F.coalesce("batch_size", F.lit(32)).alias("batch_size"),
        F.coalesce("learning_rate", F.lit(0.001)).alias("learning_rate"),
        "use_ideal_nwp",
        r4("train_time_sec").alias("train_time_sec"),
        half_even(_given(results, "inference_time_sec", 0.0, "double"), 4).alias("inference_time_sec"),
        "param_count",
        F.col("test_samples").alias("samples_count"),
        F.col("best_epoch").cast("double").alias("best_epoch"),
        _given(results, "final_lr", None, "double"),
        half_even(F.coalesce(F.col("rmse") * F.col("rmse"), F.lit(0.0)), 4).alias("mse"),
        r4("rmse").alias("rmse"),
        r4("mae").alias("mae"),
        r4("nrmse").alias("nrmse"),
        r4("r2").alias("r_square"),
        half_even(_given(results, "smape", None, "double"), 4).alias("smape"),
        _given(results, "gpu_memory_used", 0, "int"),
    )


def season_hour_forecasts(forecasts: DataFrame) -> DataFrame:
    """Forecasts as the season and hour analysis keeps them."""
    return forecasts.select(
        F.date_format("forecast_datetime", "yyyy-MM-dd HH:mm:ss").alias("date"),
        F.col("y_true").alias("ground_truth"),
        F.col("y_pred").alias("prediction"),
        "model",
        F.col("plant_id").alias("project_id"),
        F.col("sample_idx").alias("window_index"),
        F.col("horizon").alias("hour"),
    )


def season_hour_summary(forecasts: DataFrame, settings: DataFrame) -> DataFrame:
    """Settings, figures of the run and flat metrics per plant and model, with the ratios this summary is known for.

    `settings` has one row per plant and model; what it lacks, as a row or a column, is the default of its field.
    """
    flat = forecasts.groupBy("plant_id", "model").agg(
        M.mse().alias("mse"),
        M.rmse().alias("rmse"),
        M.mae().alias("mae"),
        M.r2_or_zero().alias("r_square"),
        F.count_distinct("sample_idx").alias("samples_count"),
    )
    scored = flat.withColumns({"nrmse": M.share_of_mae("rmse", "mae"), "smape": M.twice_share_of_mae("mae")})
    r4 = [half_even(c, 4).alias(c) for c in ("mse", "rmse", "mae", "nrmse", "r_square", "smape")]
    days = F.expr("coalesce(lookback_hours, 24) div 24")
    days = (F.coalesce("past_days", days) if "past_days" in settings.columns else days).cast("int").alias("past_days")
    given = lambda name, default, kind: _given(settings, name, default, kind)
    seconds = lambda name: half_even(given(name, 0.0, "double"), 4).alias(name)
    return scored.join(settings, ["plant_id", "model"], "left").select(
        "plant_id",
        "model",
        given("weather_category", "unknown", "string").alias("weather_level"),
        given("lookback_hours", 24, "int"),
        F.replace(F.coalesce("complexity", F.lit("unknown")), F.lit("level"), F.lit("")).alias("complexity_level"),
        F.lit("80%").alias("dataset_scale"),
        *[given(c, False, "boolean") for c in ("use_pv", "use_hist_weather", "use_forecast", "use_time_encoding", "use_ideal_nwp")],
        days,
        given("selected_weather_features", "[]", "string"),
        given("epochs", 0, "int"),
        given("batch_size", 0, "int"),
        given("learning_rate", 0.0, "double"),
        seconds("train_time_sec"),
        seconds("inference_time_sec"),
        given("param_count", 0, "int"),
        "samples_count",
        given("best_epoch", 0, "int"),
        given("final_lr", 0.0, "double"),
        *r4,
        given("gpu_memory_used", 0, "int"),
        F.concat(F.lit("season_hour_"), F.lower("model"), F.lit(".yaml")).alias("config_file"),
    )
