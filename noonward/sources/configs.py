"""Plant settings: reading, overlay on a template, creation and checks."""

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from noonward import constants as K
from noonward.functions.columns import forward_slashes

# Settings of a new plant.
TEMPLATE = {
    "future_hours": 24,
    "past_hours": 24,
    "train_ratio": K.TRAIN_RATIO,
    "val_ratio": K.VAL_RATIO,
    "test_ratio": K.TEST_RATIO,
    "shuffle_split": False,
    "random_seed": K.RANDOM_SEED,
    "weather_category": "all_weather",
    "has_ideal_nwp": True,
    "results_base_dir": "results",
    "start_date": K.DEFAULT_START,
    "end_date": K.DEFAULT_END,
}
# Settings a plant must have.
REQUIRED = ["plant_id", "data_path", "start_date", "end_date"]

SETTINGS_SCHEMA = (
    "plant_id string, plant_name string, data_path string, start_date string, end_date string, "
    "future_hours int, past_hours int, train_ratio double, val_ratio double, test_ratio double, "
    "shuffle_split boolean, random_seed int, weather_category string, has_ideal_nwp boolean, "
    "results_base_dir string, save_options map<string,boolean>, "
    "ml_params map<string,map<string,double>>, dl_params map<string,map<string,double>>, error string"
)


def read_settings(spark: SparkSession, folder: str) -> DataFrame:
    """One row per settings file; a file that cannot be read gives a row with its error."""
    import yaml

    names = [f.split()[0] for f in SETTINGS_SCHEMA.replace("map<string,", "").split(", ")]

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for text in batch["value"]:
                try:
                    found = yaml.safe_load(text) or {}
                    row = {n: found.get(n) for n in names}
                    for n in ("start_date", "end_date", "plant_id"):
                        row[n] = None if row[n] is None else str(row[n])
                except (yaml.YAMLError, AttributeError) as problem:
                    row = {**dict.fromkeys(names), "error": str(problem)}
                rows.append(row)
            frame = pd.DataFrame(rows, columns=names)
            yield frame.astype(object).where(frame.notna(), None)

    files = spark.read.option("pathGlobFilter", "*.yaml").text(folder, wholetext=True)
    return files.mapInPandas(parse, SETTINGS_SCHEMA)


def overlay(plants: DataFrame, template: dict[str, object] | DataFrame) -> DataFrame:
    """Fill what a plant leaves out from the template; a plant's own setting wins as a whole."""
    if isinstance(template, DataFrame):
        template = template.first().asDict()
    given = set(plants.columns)
    filled = {
        name: F.coalesce(F.col(name), F.lit(value)) if name in given else F.lit(value)
        for name, value in template.items()
        if value is not None
    }
    return plants.withColumns(filled)


def new_settings(ranges: DataFrame, files: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """Settings of plants that have files but no settings yet, with the dates found in the data."""
    made = files.select("plant_id", forward_slashes("data_path").alias("data_path")).join(ranges, "plant_id", "left")
    if existing is not None:
        made = made.join(existing.select("plant_id"), "plant_id", "left_anti")
    made = made.withColumn("plant_name", F.concat(F.lit("Project "), F.col("plant_id")))
    return overlay(made, TEMPLATE)


def check_settings(plants: DataFrame, files: DataFrame) -> DataFrame:
    """Add `complete` (all required settings) and `valid` (and the data file exists)."""
    known = files.select("data_path").distinct().withColumn("_found", F.lit(True))
    return (
        plants.join(known, "data_path", "left")
        .withColumn("complete", _all_given(REQUIRED))
        .withColumn("valid", F.col("complete") & F.coalesce("_found", F.lit(False)))
        .drop("_found")
    )


def _all_given(names: list[str]) -> Column:
    given = F.lit(True)
    for name in names:
        given = given & F.col(name).isNotNull()
    return given


def count_valid(checked: DataFrame) -> DataFrame:
    return checked.groupBy("valid").agg(F.count(F.lit(1)).alias("n_plants"))


def choose_plants(plants: DataFrame, ids: list[str] | None = None, skip: int = 0, first: int | None = None) -> DataFrame:
    """The named plants, or in order of plant_id all after `skip`, at most `first` of them."""
    if ids:
        return plants.filter(F.col("plant_id").isin(ids))
    chosen = plants.orderBy("plant_id").offset(skip)
    return chosen.limit(first) if first else chosen
