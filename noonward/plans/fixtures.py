"""Plant-like tables derived from the given sales and event tables.

Plants are groups of neighbouring suppliers (or users), so their number grows with the data.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from noonward import constants as K
from noonward.session import store

SUPPLIERS_PER_PLANT = 34
USERS_PER_PLANT = 50
PSEUDO_DAYS = 60
DAY_STRIDE = 16


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _stamped(cells: DataFrame) -> DataFrame:
    return cells.withColumns(
        {
            "Year": F.year("date"),
            "Month": F.month("date"),
            "Day": F.dayofmonth("date"),
            "dt": F.make_timestamp_ntz(
                F.year("date"), F.month("date"), F.dayofmonth("date"), F.col("Hour"), F.lit(0), F.lit(0)
            ),
        }
    )


def dense_cells(spark: SparkSession, folder: str) -> DataFrame:
    """Plant, pseudo-day and hour with a target and eleven weather columns, before the defects."""
    items = table(spark, folder, "lineitem").select(
        F.expr(f"l_suppkey div {SUPPLIERS_PER_PLANT}").alias("plant"),
        (F.datediff(F.col("l_shipdate").cast("date"), F.lit("1992-01-01").cast("date")) % PSEUDO_DAYS).alias("dd"),
        (F.col("l_orderkey") % 24).cast("int").alias("Hour"),
        "l_quantity",
        "l_linenumber",
        "l_returnflag",
        "l_linestatus",
        "l_tax",
    )
    q, n = F.col("l_quantity"), F.col("l_linenumber")
    flag = lambda c, v: F.count(F.when(F.col(c) == v, 1)).cast("double")
    weather = {
        "global_tilted_irradiance": F.sum(q),
        "vapour_pressure_deficit": F.max(q),
        "relative_humidity_2m": F.min(q),
        "temperature_2m": F.sum(n).cast("double"),
        "wind_gusts_10m": F.max(n).cast("double"),
        "cloud_cover_low": flag("l_returnflag", "A"),
        "wind_speed_100m": flag("l_linestatus", "F"),
        "snow_depth": F.lit(0.0),
        "dew_point_2m": flag("l_returnflag", "R"),
        "surface_pressure": F.count(F.lit(1)).cast("double"),
        "precipitation": F.sum(F.round(F.col("l_tax") * 100).cast("int")).cast("double"),
    }
    cells = items.groupBy("plant", "dd", "Hour").agg(
        (2 * F.avg(q)).alias(K.TARGET), *[c.alias(name) for name, c in weather.items()]
    )
    return cells.withColumn("plant_id", F.col("plant").cast("string")).drop("plant")


def dense_hours(spark: SparkSession, folder: str) -> DataFrame:
    """Hourly plant rows with a missing target, a missing forecast and a missing day in some plants."""
    cells = dense_cells(spark, folder)
    third = F.col("plant_id").cast("int") % 3
    ahead = {w + K.FORECAST_SUFFIX: F.col(w) + F.col("Hour") % 3 - 1 for w in K.WEATHER}
    defects = {
        K.TARGET: F.when(~((third == 1) & (F.col("dd") == 7) & (F.col("Hour") == 3)), F.col(K.TARGET)),
        "global_tilted_irradiance_pred": F.when(
            ~((third == 2) & (F.col("dd") == 11) & (F.col("Hour") == 5)),
            F.col("global_tilted_irradiance_pred"),
        ),
    }
    rows = cells.filter(~((third == 0) & (F.col("dd") == 20))).withColumns(ahead).withColumns(defects)
    dated = rows.withColumn("date", F.date_add(F.lit("2022-01-01").cast("date"), F.col("dd") * DAY_STRIDE))
    return _stamped(dated).drop("dd")


def stored_hours(spark: SparkSession, folder: str, weather: bool = True) -> DataFrame:
    """The dense rows, worked out from the sales table once for queries that pass over them repeatedly.

    Without `weather` only time and target are worked out and kept.
    """
    rows = dense_hours(spark, folder)
    return store(rows if weather else rows.select("plant_id", "Month", "Hour", "date", "dt", K.TARGET))


def gappy_hours(spark: SparkSession, folder: str) -> DataFrame:
    """Hourly plant rows with natural gaps."""
    events = table(spark, folder, "events")
    cells = events.groupBy(
        F.expr(f"cast(user_id div {USERS_PER_PLANT} as string)").alias("plant_id"),
        F.col("ts").cast("date").alias("date"),
        F.hour("ts").alias("Hour"),
    ).agg(F.sum(F.round(F.col("value") * 100).cast("long")).alias("cents"), F.count(F.lit(1)).cast("double").alias("load"))
    mean = F.col("cents") / (F.col("load") * 100)
    return _stamped(cells.withColumn(K.TARGET, F.least(mean, F.lit(100.0))).drop("cents"))


def plants(spark: SparkSession, folder: str) -> DataFrame:
    """Plant settings, one plant per supplier, with some settings left to the template."""
    key = F.col("s_suppkey")
    return table(spark, folder, "supplier").select(
        key.cast("string").alias("plant_id"),
        F.concat(F.lit("Project "), key.cast("string")).alias("plant_name"),
        F.when(key % 10 != 9, F.concat(F.lit("data\\Project"), key.cast("string"), F.lit(".csv"))).alias("data_path"),
        F.when(key % 4 == 1, "2023-01-01").alias("start_date"),
        F.when(key % 4 == 2, "2024-06-30").alias("end_date"),
        F.when(key % 5 == 1, 0.6).alias("train_ratio"),
        F.when(key % 6 == 1, F.lit(False)).when(key % 6 == 2, F.lit(True)).alias("shuffle_split"),
        F.when(key % 7 == 3, "high_weather").alias("weather_category"),
        F.floor(F.abs("s_acctbal")).cast("long").alias("size"),
    )


def losses(spark: SparkSession, folder: str) -> DataFrame:
    """Epoch logs: each 40 neighbouring parts are one run."""
    key = F.col("p_partkey")
    return table(spark, folder, "part").select(
        F.expr("cast(p_partkey div 400 as string)").alias("plant_id"),
        F.concat(F.lit("run_"), F.expr("p_partkey div 40").cast("string")).alias("experiment_name"),
        (key % 40 + 1).cast("int").alias("epoch"),
        (((key * 7919) % 1009) / 1009.0 / (key % 40 + 1)).alias("train_loss"),
        (((key * 104729) % 997) / 997.0 / (1 + (key % 40) / 8.0)).alias("val_loss"),
        (F.col("p_size") / 10.0).alias("epoch_time"),
    )


def results(spark: SparkSession, folder: str) -> DataFrame:
    """Results of the grid: a third of the plants complete, a third in progress, a third not started."""
    from noonward.plans.grid import experiment_grid

    work = experiment_grid(plants(spark, folder).select("plant_id", "size"))
    key, n = F.col("plant_id").cast("long"), F.length("experiment_name").cast("long")
    mix = (n * 37 + F.col("size") * 13 + key * 7 + F.col("lookback_hours") * 3) % 4001
    status = (
        F.when(key % 3 == 0, "SUCCESS")
        .when((key % 3 == 1) & ((n + key) % 3 == 0), "SUCCESS")
        .when((key % 3 == 1) & ((n + key) % 7 == 0), "FAILED")
    )
    ok = F.col("status") == "SUCCESS"
    return (
        work.withColumns({"mix": mix, "status": status})
        .filter(F.col("status").isNotNull())
        .withColumn("mae", F.when(ok, 2 + F.col("mix") / 977.0))
        .withColumns(
            {
                "rmse": F.col("mae") * (1 + (F.col("mix") % 89) / 211.0),
                "r2": F.when(ok, 1 - (F.col("mix") % 787) / 991.0),
                "train_time_sec": F.when(ok, (F.col("mix") % 503) / 7.0).otherwise(0.0),
                "test_samples": F.when(ok, 24 * (F.col("mix") % 50 + 1)).otherwise(0).cast("long"),
                "best_epoch": F.when(ok, F.col("mix") % 20).otherwise(0).cast("int"),
                "param_count": F.when(ok, n * 3).otherwise(0).cast("int"),
                "error": F.when(~ok, "no valid samples"),
            }
        )
        .withColumn("nrmse", F.col("rmse") / 53.0)
        .drop("mix", "size")
    )


def forecasts(spark: SparkSession, folder: str) -> DataFrame:
    """Two stand-in models: the last present day and the mean of the last three."""
    from noonward.operators.evaluate import long_forecasts, mean_of_past_days
    from noonward.operators.prepare import FeaturePlan, prepare
    from noonward.operators.windows import daily_samples

    prepared = prepare(stored_hours(spark, folder, weather=False), FeaturePlan([K.TARGET], [], False))
    made = None
    for name, days in (("persist", 1), ("mean3", 3)):
        samples = daily_samples(prepared, 24 * days, scaled=False)
        labelled = samples.withColumns({"model": F.lit(name), "experiment_name": F.lit(f"{name}_{24 * days}h")})
        long = long_forecasts(labelled, mean_of_past_days(days), "model", "experiment_name", "n_samples")
        made = long if made is None else made.unionByName(long)
    return made


def tier_forecasts(spark: SparkSession, folder: str) -> DataFrame:
    """A stand-in model per weather tier: the mean of the tier's scaled forecasts, in percent."""
    from noonward.functions.columns import clip_percent
    from noonward.operators import timeline as T
    from noonward.operators.prepare import plan_features, prepare, scaled_hours, unscale

    prepared = prepare(stored_hours(spark, folder), plan_features("NWP", "all_weather", time_encoding=False))
    lo, hi = f"lo_{K.TARGET}", f"hi_{K.TARGET}"
    numbered = T.number_samples(prepared.spine, 0, need_history=False).filter("sample_idx is not null")
    rows = scaled_hours(prepared).join(numbered.select(*T.DAY, "sample_idx", lo, hi), T.DAY)
    guess = lambda names: sum((F.col(w + K.FORECAST_SUFFIX) for w in names), F.lit(0.0)) / len(names)
    tiers = [
        F.struct(F.lit(t).alias("feature_tier"), guess(K.WEATHER_CATEGORIES[c]).alias("scaled"))
        for t, c in K.FEATURE_TIERS.items()
    ]
    return rows.select(
        "plant_id",
        "sample_idx",
        F.col("Hour").alias("horizon"),
        unscale(F.col(K.TARGET), F.col(lo), F.col(hi)).alias("y_true"),
        lo,
        hi,
        F.explode(F.array(*tiers)).alias("t"),
    ).select(
        "plant_id",
        F.lit("blend").alias("model"),
        "t.feature_tier",
        "sample_idx",
        "horizon",
        "y_true",
        clip_percent(unscale(F.col("t.scaled"), F.col(lo), F.col(hi))).alias("y_pred"),
    )


def target_days(spark: SparkSession, folder: str, past_days: int = 1) -> DataFrame:
    """Truth per plant, sample and hour ahead, with the sample's number."""
    from noonward.operators.evaluate import long_forecasts
    from noonward.operators.prepare import FeaturePlan, prepare
    from noonward.operators.windows import daily_samples

    prepared = prepare(stored_hours(spark, folder, weather=False), FeaturePlan([K.TARGET], [], False))
    samples = daily_samples(prepared, 24 * past_days, scaled=False)
    return long_forecasts(samples, "y_true", "n_samples").drop("y_pred")


def hourly_means(days: DataFrame, *keys: str) -> DataFrame:
    """Stand-in model: each hour's mean over the training part, for the test part."""
    mean = days.filter("part = 'train'").groupBy("plant_id", *keys, "horizon").agg(F.avg("y_true").alias("y_pred"))
    return days.filter("part = 'test'").join(mean, ["plant_id", *keys, "horizon"])
