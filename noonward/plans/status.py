"""Completion of plants and of the fleet."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from noonward import constants as K
from noonward.functions.columns import half_even
from noonward.session import store


def plant_status(plants: DataFrame, results: DataFrame, unreadable: DataFrame | None = None) -> DataFrame:
    """Successes, rest, progress and state of each plant, those without results included.

    Rows of a result table without a status count when they name an experiment. Plants whose results
    could not be read (plant_id, error) are in state ERROR with nothing completed.
    """
    if unreadable is not None:
        known = plant_status(plants, results.join(unreadable.select("plant_id"), "plant_id", "left_anti"))
        failed = F.col("error").isNotNull()
        return known.join(unreadable.select("plant_id", "error"), "plant_id", "left").withColumn(
            "status", F.when(failed, "ERROR").otherwise(F.col("status"))
        )
    success = (F.col("status") == "SUCCESS") | (F.col("status").isNull() & F.col("experiment_name").isNotNull())
    done = results.groupBy("plant_id").agg(F.count(F.when(success, 1)).alias("completed"))
    completed = F.coalesce("completed", F.lit(0))
    return (
        plants.select("plant_id")
        .join(done, "plant_id", "left")
        .select(
            "plant_id",
            F.when(completed >= K.GRID_SIZE, "COMPLETE").when(completed > 0, "IN_PROGRESS").otherwise("NOT_STARTED").alias(
                "status"
            ),
            completed.alias("completed"),
            (K.GRID_SIZE - completed).alias("remaining"),
            (completed / K.GRID_SIZE * 100).alias("progress"),
        )
    )


def fleet_status(status: DataFrame) -> DataFrame:
    """Totals over all plants and the hours left at the usual time per plant."""
    state = lambda s: F.count(F.when(F.col("status") == s, 1))
    totals = status.agg(
        F.count(F.lit(1)).alias("n_plants"),
        state("COMPLETE").alias("n_complete"),
        state("IN_PROGRESS").alias("n_in_progress"),
        state("NOT_STARTED").alias("n_not_started"),
        state("ERROR").alias("n_error"),
        F.sum("completed").alias("completed"),
    )
    total = F.col("n_plants") * K.GRID_SIZE
    left = F.col("n_not_started") + F.col("n_in_progress") * 0.5
    return totals.withColumns(
        {
            "total": total,
            "remaining": total - F.col("completed"),
            "percent": half_even(F.col("completed") / F.nullif(total, F.lit(0)) * 100, 1),
            "hours_left": left * K.HOURS_PER_PLANT,
        }
    )


def in_progress(status: DataFrame) -> DataFrame:
    return status.filter("status = 'IN_PROGRESS'").orderBy(F.desc("completed"), "plant_id")


def not_started_head(status: DataFrame, shown: int = 20) -> DataFrame:
    """The first plants not started, each with how many more there are."""
    waiting = status.filter("status = 'NOT_STARTED'")
    total = waiting.agg(F.greatest(F.count(F.lit(1)) - shown, F.lit(0)).alias("more"))
    return waiting.select("plant_id").orderBy("plant_id").limit(shown).withColumn("more", total.scalar())


def batches(status: DataFrame, size: int = K.PLANTS_PER_BATCH) -> DataFrame:
    """Plants not started in batches of `size`, in order of plant_id.

    Plants are dealt out by ranges of their ids. A plant's number is its rank in its range plus the number of plants
    in earlier ranges, so only the short table of ranges is ordered as a whole. The ranges are stored, since a
    second look could cut them in other places.
    """
    waiting = status.filter("status = 'NOT_STARTED'").select("plant_id").repartitionByRange("plant_id")
    waiting = store(waiting.withColumn("range", F.spark_partition_id()))
    counts = waiting.groupBy("range").agg(F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy(F.lit(0)).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("range", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("offset"))
    rank = F.row_number().over(Window.partitionBy("range").orderBy("plant_id")) - 1
    place = (F.col("offset") + rank).cast("long")
    return waiting.join(offsets, "range").select(
        "plant_id",
        place.alias("place"),
        F.floor(place / size).alias("batch"),
        (F.floor(place / size) * size).alias("skip"),
    )


def remaining_time(results: DataFrame, plants: DataFrame) -> DataFrame:
    """Hours spent, hours to go at the average per plant so far, and the sum."""
    spent = results.agg(
        (F.sum("train_time_sec") / 3600).alias("elapsed"), F.count_distinct("plant_id").alias("processed")
    )
    total = plants.agg(F.count(F.lit(1)).alias("n_plants")).scalar()
    left = F.col("elapsed") / F.nullif(F.col("processed"), F.lit(0)) * (total - F.col("processed"))
    return spent.select(
        half_even("elapsed", 2).alias("elapsed_hours"),
        "processed",
        (total - F.col("processed")).alias("remaining_plants"),
        half_even(left, 2).alias("remaining_hours"),
        half_even(F.col("elapsed") + left, 2).alias("total_hours"),
    )


def run_summary(runs: DataFrame, places: int = 1) -> DataFrame:
    """Successes, failures and minutes of each study in a log of runs (study, status, started, ended)."""
    minutes = (F.unix_micros("ended") - F.unix_micros("started")) / 60e6
    return runs.groupBy("study").agg(
        F.count(F.when(F.col("status") == "SUCCESS", 1)).alias("n_success"),
        F.count(F.when(F.col("status") != "SUCCESS", 1)).alias("n_failed"),
        half_even(F.sum(F.when(F.col("status") == "SUCCESS", minutes)), places).alias("minutes"),
    )
