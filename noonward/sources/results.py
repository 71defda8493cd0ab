"""Result tables."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from noonward.sources.by_name import layouts, read_layouts

RESULTS_SCHEMA = (
    "plant_id string, experiment_name string, model string, complexity string, scenario string, "
    "lookback_hours int, use_time_encoding boolean, mae double, rmse double, r2 double, nrmse double, "
    "train_time_sec double, test_samples long, best_epoch int, param_count int, status string, error string"
)
RESULTS_COLUMNS = [f.split()[0] for f in RESULTS_SCHEMA.split(", ")]


def as_results(rows: DataFrame) -> DataFrame:
    """Bring rows to the results layout; what they lack becomes empty, a settings_key and an inference_time_sec that they have stay."""
    types = dict(f.split() for f in RESULTS_SCHEMA.split(", "))
    given = set(rows.columns)
    return rows.select(
        *[(F.col(c) if c in given else F.lit(None)).cast(types[c]).alias(c) for c in RESULTS_COLUMNS],
        *[F.col(c).cast("string") for c in ("settings_key",) if c in given],
        *[F.col(c).cast("double") for c in ("inference_time_sec",) if c in given],
    )


def read_batches(spark: SparkSession, *paths: str, batches: bool = False) -> DataFrame:
    """A table that was appended to in batches; also such as were written before there were batches.

    With `batches` each row has its batch's name in `batch`, empty for rows that have none.
    """
    rows = spark.read.option("mergeSchema", True).option("recursiveFileLookup", True).parquet(*paths)
    if not batches:
        return rows
    return rows.withColumn("batch", F.regexp_extract("_metadata.file_path", r"/batch=([^/]*)/[^/]*$", 1))


def read_results(spark: SparkSession, *paths: str) -> DataFrame:
    return as_results(read_batches(spark, *paths))


def read_results_csv(spark: SparkSession, *paths: str) -> DataFrame:
    """Results kept as text with a header, each file read by its own; the status, or any column, may be missing.

    What cannot be read as its column's type is empty; whole numbers may have a fraction of zero.
    """
    types = dict(f.split() for f in RESULTS_SCHEMA.split(", "))

    def columns(layout, cell):
        text = {c: cell(c).try_cast("double") if t in ("int", "long") else cell(c) for c, t in types.items()}
        return {c: t.try_cast(types[c]) for c, t in text.items()}

    return read_layouts(spark, layouts(spark, list(paths)), columns, RESULTS_SCHEMA)


def union_results(*tables: DataFrame) -> DataFrame:
    first, *rest = [as_results(t) for t in tables]
    for other in rest:
        first = first.unionByName(other, allowMissingColumns=True)
    return first
