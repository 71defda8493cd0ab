"""Hourly plant files."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from noonward import constants as K
from noonward.functions.columns import absent_if_nan, forward_slashes, hour_stamp, plant_id_from_file
from noonward.sources.by_name import Layout, layouts, read_layouts

# Column names of the files.
TIME_COLUMNS = ["Year", "Month", "Day", "Hour"]
FILE_TARGET = "Capacity Factor"
FILE_PATTERN = "*.{csv,CSV}"


def _layouts(spark: SparkSession, *paths: str) -> list[Layout]:
    return layouts(spark, list(paths), pathGlobFilter=FILE_PATTERN, recursiveFileLookup=True)


def _whole(text: Column) -> Column:
    """A whole number, also where a tool has written it with a fraction of zero."""
    number = text.try_cast("double")
    return F.when(number == F.floor(number), number.try_cast("int"))


def _number(text: Column) -> Column:
    return absent_if_nan(text.try_cast("double"))


def _lacking(layout: Layout) -> list[str]:
    return [c for c in [*TIME_COLUMNS, FILE_TARGET] if c not in layout.names]


def read_hourly(
    spark: SparkSession, *paths: str, plant_id: Column | None = None, strict: bool = True
) -> DataFrame:
    """Plant files of any layouts, the plant taken from the file name.

    Each file's columns are matched by its own header; weather columns that a file lacks are empty, those that all
    lack are absent. Time columns and target must be there in every file unless `strict` is off; then they are
    empty, and date_ranges falls back on the default range. A cell that is no number, or a date that does not
    exist, is empty too: `unreadable_plants` lists the plants that have such rows.
    """
    found = _layouts(spark, *paths)
    if strict and (bad := {c for layout in found for c in _lacking(layout)}):
        raise ValueError(f"missing columns: {sorted(bad)}")
    given = {n for layout in found for n in layout.names}
    weather = [w for w in [*K.WEATHER, *(w + K.FORECAST_SUFFIX for w in K.WEATHER)] if w in given]
    plant = plant_id_from_file(F.col("file_name")) if plant_id is None else plant_id

    def columns(layout: Layout, cell) -> dict[str, Column]:
        return {
            "plant_id": plant,
            **{c: _whole(cell(c)) for c in TIME_COLUMNS},
            K.TARGET: _number(cell(FILE_TARGET)),
            **{w: _number(cell(w)) for w in weather},
        }

    schema = f"plant_id string, {', '.join(f'{c} int' for c in TIME_COLUMNS)}, {K.TARGET} double"
    return with_stamp(read_layouts(spark, found, columns, schema))


def unreadable_plants(spark: SparkSession, *paths: str) -> DataFrame:
    """(plant_id, error): plants whose files lack a needed column, or have cells or dates that cannot be read.

    Such a plant does not end the reading of the others; the table goes to plant_status.
    """

    def columns(layout: Layout, cell) -> dict[str, Column]:
        numbers = [FILE_TARGET, *K.WEATHER, *(w + K.FORECAST_SUFFIX for w in K.WEATHER)]
        cells = [cell(c) for c in numbers if c in layout.names]
        no_number = [c.isNotNull() & c.try_cast("double").isNull() for c in cells]
        lacking = _lacking(layout)
        told = F.lit("missing columns: " + ", ".join(lacking)) if lacking else None
        no_time = hour_stamp(*[_whole(cell(c)) for c in TIME_COLUMNS]).isNull()
        problem = F.when(no_time, F.lit("no such time")).when(F.array_contains(F.array(*no_number), True), F.lit("not a number"))
        return {"plant_id": plant_id_from_file(F.col("file_name")), "error": problem if told is None else told}

    found = read_layouts(spark, _layouts(spark, *paths), columns, "plant_id string, error string")
    return found.filter("error is not null").groupBy("plant_id").agg(F.min("error").alias("error"))


def with_stamp(rows: DataFrame) -> DataFrame:
    """Add the time stamp and the calendar day from year, month, day and hour."""
    stamped = rows.withColumn("dt", hour_stamp(*TIME_COLUMNS))
    return stamped.withColumn("date", F.col("dt").cast("date"))


def union_layouts(*tables: DataFrame) -> DataFrame:
    first, *rest = tables
    for other in rest:
        first = first.unionByName(other, allowMissingColumns=True)
    return first


def source_files(spark: SparkSession, folder: str) -> DataFrame:
    """File name, plant, path and time of change of each plant file; contents are not read."""
    listed = (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", FILE_PATTERN)
        .option("recursiveFileLookup", True)
        .load(folder)
    )
    name = F.regexp_extract("path", r"([^/]*)$", 1)
    return listed.select(
        name.alias("file_name"),
        plant_id_from_file(name).alias("plant_id"),
        forward_slashes("path").alias("data_path"),
        F.col("modificationTime").alias("changed"),
    )


def count_source_files(spark: SparkSession, folder: str) -> int:
    n = source_files(spark, folder).count()
    if not n:
        raise ValueError(f"no plant files in {folder}")
    return n


def date_ranges(hours: DataFrame) -> DataFrame:
    """First day, last day and rows of each plant; the default range where no row has a time."""
    day = lambda c: F.date_format(c, "yyyy-MM-dd")
    return hours.groupBy("plant_id").agg(
        F.coalesce(day(F.min("dt")), F.lit(K.DEFAULT_START)).alias("start_date"),
        F.coalesce(day(F.max("dt")), F.lit(K.DEFAULT_END)).alias("end_date"),
        F.count(F.lit(1)).alias("data_length"),
    )


def latest_files(files: DataFrame) -> DataFrame:
    """The most recently changed file of each plant."""
    newest = F.max_by(F.struct("file_name", "data_path"), F.struct("changed", "file_name"))
    return files.groupBy("plant_id").agg(newest.alias("f"), F.max("changed").alias("changed")).select(
        "plant_id", "f.file_name", "f.data_path", "changed"
    )
