"""Experiment grids, work lists and presets.

A grid is spread out next to each plant with explode, without a join. The table of plants is short, so it comes as one
partition or a few; since its grid is hundreds of times as long, plants are dealt out before.
"""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noonward import constants as K
from noonward.functions.columns import experiment_name, forecast_only, model_family, scenario_label

RESULT_KEY = ["plant_id", "experiment_name"]


def _structs(rows: list[dict[str, Column]]) -> Column:
    return F.explode(F.array(*[F.struct(*[c.alias(n) for n, c in row.items()]) for row in rows]))


def _model_levels() -> Column:
    """Each deep and tree model at each complexity, and the linear model without one."""
    rows = [(m, level) for m in K.DEEP_MODELS + K.TREE_MODELS for level in K.GRID_COMPLEXITIES]
    return _structs(
        [
            {"model": F.lit(m), "complexity": F.lit(level).cast("string")}
            for m, level in [*rows, (K.LINEAR_MODEL, None)]
        ]
    )


def _feature_choices() -> Column:
    """Scenarios with power at each lookback, and those on forecasts alone without one."""
    with_power = [(s, hours) for s in K.POWER_SCENARIOS for hours in K.GRID_LOOKBACKS]
    choices = with_power + [(s, 0) for s in K.FORECAST_ONLY_SCENARIOS]
    names = ["use_pv", "use_hist_weather", "use_forecast", "use_ideal_nwp"]
    return _structs(
        [
            {
                "scenario": F.lit(s),
                "lookback_hours": F.lit(hours),
                **{n: F.lit(flag) for n, flag in zip(names, K.SCENARIOS[s])},
            }
            for s, hours in choices
        ]
    )


def deal_out(plants: DataFrame) -> DataFrame:
    """Plants over as many partitions as a shuffle has, by plant_id.

    The number is given, since partitions as small as these would be put together again.
    """
    return plants.repartition(int(plants.sparkSession.conf.get("spark.sql.shuffle.partitions")), "plant_id")


def experiment_grid(plants: DataFrame) -> DataFrame:
    """All 284 experiments of each plant."""
    kept = [c for c in plants.columns]
    spread = (
        deal_out(plants)
        .withColumn("m", _model_levels())
        .withColumn("f", _feature_choices())
        .filter((F.col("m.model") != K.LINEAR_MODEL) | (F.col("f.lookback_hours") == 0))
        .withColumn("use_time_encoding", F.explode(F.array(F.lit(True), F.lit(False))))
        .select(*kept, "m.*", "f.*", "use_time_encoding")
    )
    return spread.withColumns(
        {
            "experiment_name": experiment_name(
                "model", "complexity", "scenario", "lookback_hours", "use_time_encoding"
            ),
            "past_days": F.expr("lookback_hours div 24").cast("int"),
            "no_hist_power": F.col("lookback_hours") == 0,
        }
    )


def save_path(plant="plant_id", name="experiment_name") -> Column:
    return F.concat(F.col(plant), F.lit("_results/"), F.col(name))


def label_scenarios(grid: DataFrame) -> DataFrame:
    """Scenario and forecast-only mode worked out from the flags."""
    flags = ["use_pv", "use_hist_weather", "use_forecast", "use_ideal_nwp"]
    return grid.withColumns(
        {
            "scenario_label": scenario_label(*flags),
            "forecast_only": forecast_only("no_hist_power", "use_pv", "use_hist_weather"),
        }
    )


def count_by_family(grid: DataFrame) -> DataFrame:
    """Experiments per plant and model family, with the plant's total."""
    return (
        grid.select("plant_id", model_family().alias("family"))
        .groupBy("plant_id", "family")
        .agg(F.count(F.lit(1)).alias("n"))
        .rollup("plant_id", "family")
        .agg(F.sum("n").alias("n_experiments"))
        .filter(F.col("plant_id").isNotNull())
        .select("plant_id", F.coalesce("family", F.lit("all")).alias("family"), "n_experiments")
    )


SUCCEEDED = "coalesce(status, 'SUCCESS') = 'SUCCESS'"


def settings_key(*values: Column | str) -> Column:
    """A fingerprint of settings: the same for the same values in the same order."""
    each = [F.coalesce((F.col(v) if isinstance(v, str) else v).cast("string"), F.lit("")) for v in values]
    return F.md5(F.concat_ws("|", *each))


def pending(work: DataFrame, results: DataFrame, any_status: bool = False) -> DataFrame:
    """Work without a successful result; with any_status, without any result.

    Where work and results both have a settings_key, a result counts only if it was made with the same settings. Both
    sides are sorted and merged: a grid's size is estimated by that of its plants, so that Spark would broadcast it.
    """
    done = results if any_status else results.filter(SUCCEEDED)
    keys = [*RESULT_KEY, *(c for c in ("settings_key",) if c in work.columns and c in results.columns)]
    return work.join(done.select(*keys).distinct().hint("merge"), keys, "left_anti")


def pending_plants(plants: DataFrame, results: DataFrame) -> DataFrame:
    """Plants with fewer successes than the grid has experiments; a result without status is one."""
    full = (
        results.filter(SUCCEEDED)
        .groupBy("plant_id")
        .agg(F.count(F.lit(1)).alias("n"))
        .filter(F.col("n") >= K.GRID_SIZE)
    )
    return plants.join(full, "plant_id", "left_anti")


def tree_params(level: str) -> dict[str, float]:
    trees, depth, rate = K.TREE_PRESETS[level]
    return {
        "n_estimators": float(trees),
        "max_depth": float(depth),
        "learning_rate": rate,
        "random_state": float(K.RANDOM_SEED),
        "verbosity": -1.0,
    }


def deep_params(level: str) -> dict[str, float]:
    epochs, width, hidden, layers, _ = K.DEEP_PRESETS[level]
    return {
        "epochs": float(epochs),
        "d_model": float(width),
        "hidden_dim": float(hidden),
        "num_layers": float(layers),
        **K.DEEP_SHARED,
    }


def _map(values: dict[str, float]) -> Column:
    return F.create_map(*[c for k, v in values.items() for c in (F.lit(k), F.lit(v))])


def add_presets(grid: DataFrame) -> DataFrame:
    """Parameters and channel widths by model family and complexity."""
    params, channels = F.lit(None).cast("map<string,double>"), F.lit(None).cast("array<int>")
    for level in K.COMPLEXITY_LEVELS:
        here = F.col("complexity") == level
        deep = F.col("model").isin(K.DEEP_MODELS) & here
        tree = F.col("model").isin(K.TREE_MODELS) & here
        params = F.when(deep, _map(deep_params(level))).when(tree, _map(tree_params(level))).otherwise(params)
        channels = F.when(deep, F.array(*[F.lit(c) for c in K.DEEP_PRESETS[level][4]])).otherwise(channels)
    return grid.withColumns({"params": params, "tcn_channels": channels})


def keep_allowed(params: str, model: str = "model") -> Column:
    """The parameters a model accepts."""
    allowed = F.array().cast("array<string>")
    for name, keys in K.ALLOWED_PARAMS.items():
        if keys:
            allowed = F.when(F.col(model) == name, F.array(*[F.lit(k) for k in keys])).otherwise(allowed)
    return F.map_filter(params, lambda k, _: F.array_contains(allowed, k))


def study_grid(plants: DataFrame, models: list[str] = K.DEEP_MODELS + K.TREE_MODELS + [K.LINEAR_MODEL]) -> DataFrame:
    """Base experiment of each model: power and forecast, one day back, no time encoding, high complexity.

    The linear model uses the forecast alone.
    """
    linear = F.col("model") == K.LINEAR_MODEL
    return plants.withColumn("model", F.explode(F.array(*[F.lit(m) for m in models]))).withColumns(
        {
            "complexity": F.lit("high"),
            "use_pv": ~linear,
            "use_hist_weather": F.lit(False),
            "use_forecast": F.lit(True),
            "use_ideal_nwp": F.lit(False),
            "use_time_encoding": F.lit(False),
            "lookback_hours": F.when(linear, 0).otherwise(24),
            "no_hist_power": F.when(linear, F.lit(True)),
            "shuffle_split": F.lit(True),
        }
    )


def vary(grid: DataFrame, dimension: str, values: list, like: str = "string") -> DataFrame:
    """One copy of each row per value of a study dimension."""
    return grid.withColumn(dimension, F.explode(F.array(*[F.lit(v).cast(like) for v in values])))


def custom_study(plants: DataFrame, models: list[str], modify: Callable[[DataFrame], DataFrame] | None) -> DataFrame:
    """The base experiments of chosen models after a user's step."""
    base = study_grid(plants, models)
    return base.transform(modify) if modify else base
