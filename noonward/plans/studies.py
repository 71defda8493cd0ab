"""The eight sensitivity studies.

A study is a list of experiments, its scores per plant and the aggregate over plants. The studies by
season and hour slice one run; the others vary one setting.
"""

from dataclasses import replace
from functools import reduce

from pyspark.errors import IllegalArgumentException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noonward import constants as K
from noonward.functions import metrics as M
from noonward.functions.columns import season_of
from noonward.operators.evaluate import study_daily_metrics
from noonward.plans import experiments as E
from noonward.plans.reports import STUDY_METRICS, aggregate_over_plants, pivot_formatted
from noonward.sinks.tables import save_study_table

FITTED_MODELS = E.TRAINED_MODELS
# Studies that leave the linear model out.
WITHOUT_LINEAR = {"lookback_window", "model_complexity"}
# The column each study varies.
DIMENSION = {
    "seasonal_effect": "season",
    "hourly_effect": "hour",
    "weather_feature_adoption": "feature_tier",
    "lookback_window": "lookback_hours",
    "model_complexity": "complexity",
    "training_scale": "training_scale",
    "no_shuffle": None,
    "dataset_extension": None,
}


def by_season(forecasts: DataFrame, *keys: str) -> DataFrame:
    keyed = forecasts.withColumn("season", season_of(F.month("date")))
    return keyed.groupBy(*keys, "season").agg(*M.study_metrics())


def by_hour(forecasts: DataFrame, *keys: str) -> DataFrame:
    return forecasts.groupBy(*keys, F.col("horizon").alias("hour")).agg(*M.study_metrics())


def by_tier(forecasts: DataFrame, *keys: str) -> DataFrame:
    return forecasts.groupBy(*keys, "feature_tier").agg(*M.study_metrics())


def study_experiments(study: str, models: list[str] = FITTED_MODELS) -> list[E.Experiment]:
    """Experiments of a study; `tags` name the level of the study's dimension."""
    if study not in DIMENSION:
        raise ValueError(f"unknown study: {study}")
    if study in WITHOUT_LINEAR:
        models = [m for m in models if m != K.LINEAR_MODEL]
    base = [E.base_experiment(m) for m in models]
    changes: dict[str, dict] = {"": {}}
    if study == "weather_feature_adoption":
        changes = {t: {"weather_category": c} for t, c in K.FEATURE_TIERS.items()}
    elif study == "lookback_window":
        changes = {str(h): {"lookback_hours": h} for h in K.STUDY_LOOKBACKS}
    elif study == "model_complexity":
        changes = {c: {"complexity": c} for c in K.COMPLEXITY_LEVELS}
    elif study == "training_scale":
        changes = {n: {"train_ratio": r} for n, r in K.TRAINING_SCALES.items()}
    elif study == "no_shuffle":
        changes = {"": {"shuffle": False}}
    elif study == "dataset_extension":
        changes = {"": {"sliding": True}}
    made = []
    for e in base:
        for level, change in changes.items():
            changed = replace(e, **change)
            name = "_".join(filter(None, [study, changed.experiment_name, level]))
            made.append(replace(changed, name=name, tags={"level": level}))
    return made


def _labelled(forecasts: DataFrame, experiments: list[E.Experiment]) -> DataFrame:
    levels = F.create_map(*[F.lit(v) for e in experiments for v in (e.experiment_name, e.tags["level"])])
    return forecasts.withColumn("level", levels[F.col("experiment_name")])


def detailed(study: str, fits: DataFrame, experiments: list[E.Experiment]) -> DataFrame:
    """Scores of a study per plant, model and level, with the training time."""
    forecasts = _labelled(E.forecasts_of(fits, experiments), experiments)
    spent = _labelled(fits, experiments).filter("error is null").withColumn(
        "model", F.create_map(*[F.lit(v) for e in experiments for v in (e.experiment_name, e.model)])[F.col("experiment_name")]
    )
    times = spent.groupBy("plant_id", "model", "level").agg(F.max("train_time_sec").alias("train_time"))
    keys = ["plant_id", "model", "level"]
    if study == "seasonal_effect":
        scores = by_season(forecasts, *keys)
    elif study == "hourly_effect":
        scores = by_hour(forecasts, *keys)
    elif study == "weather_feature_adoption":
        scores = by_tier(forecasts.withColumn("feature_tier", F.col("level")), *keys)
    else:
        scores = study_daily_metrics(forecasts, *keys)
        dimension = DIMENSION[study]
        if dimension:
            like = "int" if dimension == "lookback_hours" else "string"
            scores = scores.withColumn(dimension, F.col("level").cast(like))
        if study == "dataset_extension":
            scores = scores.withColumns(
                {
                    "window_type": F.lit("hourly_sliding"),
                    "total_windows": F.expr(f"test_samples div {K.HOURS_PER_DAY}"),
                }
            )
    return scores.join(times, keys).drop("level")


def aggregated(study: str, scores: DataFrame) -> DataFrame:
    keys = [k for k in (DIMENSION[study], "model") if k]
    windows = "total_windows" if study == "dataset_extension" else None
    return aggregate_over_plants(scores, *keys, windows=windows)


# The settings that a study varies, which go before those of a plant.
INSISTS = {
    "weather_feature_adoption": ("weather_category",),
    "training_scale": ("train_ratio",),
    "no_shuffle": ("shuffle",),
}


def run_study(
    hours: DataFrame, study: str, models: list[str] = FITTED_MODELS, settings: DataFrame | None = None
) -> tuple[DataFrame, DataFrame]:
    """Detailed and aggregated scores of one study over all plants; `settings` as for run_experiments."""
    experiments = [replace(e, insists=INSISTS.get(study, ())) for e in study_experiments(study, models)]
    if settings is None:
        fits = E.run_fits(hours, experiments)
    else:
        groups = E.by_settings(hours, experiments, hours.select("plant_id").distinct(), settings)
        fits = reduce(DataFrame.unionByName, [E.run_fits(rows, free, settings=own) for own, rows, free in groups])
    scores = detailed(study, fits, experiments)
    return scores, aggregated(study, scores)


def save_study(study: str, scores: DataFrame, totals: DataFrame, folder: str, copy_to: str | None = None) -> None:
    """Detailed and aggregated tables, and one formatted pivot per metric where there is a dimension."""
    save_study_table(scores, folder, study, "detailed", copy_to)
    save_study_table(totals, folder, study, "aggregated", copy_to)
    if DIMENSION[study]:
        for metric in STUDY_METRICS:
            save_study_table(pivot_formatted(totals, DIMENSION[study], metric), folder, study, f"pivot_{metric}", copy_to)


def run_studies(
    hours: DataFrame,
    folder: str,
    numbers: list[int] | None = None,
    models: list[str] = FITTED_MODELS,
    settings: DataFrame | None = None,
) -> DataFrame:
    """Run the chosen studies and save their tables; returns a log of (study, status, started, ended, error).

    Errors of Spark's own, as after a full disk, are no result of a study and end the run.
    """
    from datetime import datetime, timezone

    log = []
    for number in numbers or list(K.STUDIES):
        study = K.STUDIES.get(number)
        if study is None:
            continue
        started = datetime.now(timezone.utc)
        error = None
        try:
            own = () if settings is None else (settings,)
            save_study(study, *run_study(hours, study, models, *own), folder)
        except (ValueError, RuntimeError, IllegalArgumentException) as problem:  # a study that cannot be run is logged, the others go on
            error = str(problem)
        ended = datetime.now(timezone.utc)
        log.append((study, "FAILED" if error else "SUCCESS", started, ended, error))
    schema = "study string, status string, started timestamp, ended timestamp, error string"
    return hours.sparkSession.createDataFrame(log, schema)
