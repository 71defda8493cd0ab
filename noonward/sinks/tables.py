"""Writing tables."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noonward.functions.columns import model_rank
from noonward.session import written
from noonward.sources.results import as_results, read_batches


def batch_of(keys: DataFrame) -> str:
    """A name for a set of keys: the same for the same keys, in whatever order they come."""
    told = keys.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64(*keys.columns)).alias("all"), F.sum(F.xxhash64(F.lit(1), *keys.columns) % 2**31).alias("more")).first()
    return f"{told.n}-{(told.all or 0) % 2**64:016x}-{(told.more or 0) % 2**40:010x}"


def append_batch(rows: DataFrame, path: str, batch: str) -> None:
    """Append rows to a table as a batch of a name; writing the same batch again replaces it.

    A batch is a folder that appears as a whole when its job commits, so a broken write leaves nothing behind, and a
    repeated or a second concurrent one no row twice. Read the table with `read_batches`.
    """
    named = rows.withColumn("batch", F.lit(batch))
    named.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(path)


def append_results(results: DataFrame, path: str, batch: str | None = None) -> None:
    """One append per batch; rows lie sorted by plant, so readers of a plant skip most of each file.

    Without a name the batch is known by the plants and experiments it holds, so that appending the same results again
    replaces them. Give a name where working the rows out twice is dear, as `run_saving` does.
    """
    rows = as_results(results)
    named = batch or batch_of(rows.select(*[c for c in ("plant_id", "experiment_name", "settings_key", "status") if c in rows.columns]))
    append_batch(rows.sortWithinPartitions("plant_id", "experiment_name"), path, named)


def save_hours(hours: DataFrame, table: str, path: str, buckets: int) -> DataFrame:
    """Keep hourly rows bucketed by plant and day.

    Preparation joins and orders rows by plant and day, so it reads this table without moving them.
    """
    spread = hours.repartition(buckets, "plant_id", "date")
    writer = spread.write.mode("overwrite").format("parquet").option("path", path)
    writer.bucketBy(buckets, "plant_id", "date").saveAsTable(table)
    return hours.sparkSession.table(table)


def in_model_order(table: DataFrame, *after: str) -> DataFrame:
    return table.orderBy(model_rank(), "model", *after)


def save_study_table(table: DataFrame, folder: str, study: str, name: str, copy_to: str | None = None) -> None:
    """A study's table as text in the study's folder, ordered by model where it has one.

    Study tables have one row per model and level (or plant), so one file is enough for the
    aggregates; tables that still have a row per plant are written in parallel.
    """
    per_plant = "plant_id" in table.columns
    ordered = in_model_order(table) if "model" in table.columns else table
    for base in filter(None, [folder, copy_to]):
        out = ordered if per_plant else ordered.coalesce(1)
        out.write.mode("overwrite").option("header", True).csv(f"{base}/{study}/{name}")


def _fresh(existing: DataFrame, new: DataFrame, keys: list[str], arrival: tuple[str, ...]) -> DataFrame:
    if not arrival:
        raise ValueError("name the columns that tell which of the new rows with equal keys came first")
    rest = [c for c in new.columns if c not in keys]
    once = new.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*arrival)).alias("_r")).select(*keys, "_r.*")
    same = [F.col(f"n.{k}").eqNullSafe(F.col(f"e.{k}")) for k in keys]
    # merged, since existing rows may be many more than their estimate, as rows of a grid are
    known = existing.select(*keys).distinct().hint("merge").alias("e")
    return once.alias("n").join(known, same, "left_anti").select(*new.columns)


def append_new(existing: DataFrame, new: DataFrame, keys: list[str], *arrival: str) -> DataFrame:
    """All existing rows and the new ones whose key is not among them; empty keys are equal.

    Of new rows with the same key the first to arrive is kept, by the columns `arrival`, which must be named: the
    order in which rows happen to be read is not repeatable after a shuffle.
    """
    return existing.unionByName(_fresh(existing, new, keys, arrival).select(*existing.columns))


def save_new(new: DataFrame, path: str, keys: list[str], *arrival: str) -> None:
    """Append to the table at `path` the new rows whose key it does not have, as a batch.

    The batch is known by the keys of `new`; rows that an earlier write of the same batch has left do not count as
    known, so that a repeated write gives the same rows once.
    """
    batch = batch_of(new.select(*keys))
    if written(new.sparkSession, path):
        known = read_batches(new.sparkSession, path, batches=True).filter(F.col("batch") != batch).select(*keys)
    else:
        known = new.select(*keys).limit(0)
    append_batch(_fresh(known, new, keys, arrival), path, batch)


def save_forecasts(forecasts: DataFrame, path: str, batch: str | None = None) -> None:
    """Append forecasts as a batch, known by its plants and experiments unless named."""
    name = batch or batch_of(forecasts.select("plant_id", "experiment_name").distinct())
    append_batch(forecasts.sortWithinPartitions("plant_id", "experiment_name"), path, name)


def save_epoch_log(log: DataFrame, path: str, batch: str | None = None) -> None:
    """Append epochs as a batch, known by its plants, experiments and epochs unless named."""
    name = batch or batch_of(log.select("plant_id", "experiment_name", "epoch"))
    append_batch(log.sortWithinPartitions("plant_id", "experiment_name"), path, name)


def save_status_report(status: DataFrame, path: str) -> None:
    status.write.mode("overwrite").option("header", True).csv(path)
