"""Session helpers."""

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str = "8", shuffle_partitions: int = 8) -> SparkSession:
    """A session for tests and the bench, with a folder of its own; on a cluster use the one the platform hands out."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("noonward")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="noonward-"))
        .getOrCreate()
    )


def _shared(spark: SparkSession) -> str:
    """The folder the session names in spark.checkpoint.dir; without one, a folder below the warehouse."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    return (named or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_noonward").rstrip("/")


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write `df` to the shared folder and go on from there."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(_shared(df.sparkSession))
    return df.checkpoint(eager=True)


def shared_folder(spark: SparkSession) -> str:
    """A new folder below the shared one, for tables written on the way."""
    return f"{_shared(spark)}/noonward-{uuid.uuid4().hex}"


def store(df: DataFrame) -> DataFrame:
    """Write a table several passes will read to the shared folder, and read it from there.

    Unlike a checkpoint the files are columnar, so each pass reads only the columns it uses.
    """
    path = shared_folder(df.sparkSession)
    df.write.parquet(path)
    found = df.sparkSession.read.schema(df.schema).parquet(path)
    found.stored_at = path
    return found


def discard(*tables: DataFrame) -> None:
    """Delete tables that `store` wrote and nothing will read again."""
    for df in tables:
        spark, path = df.sparkSession, df.stored_at
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def written(spark: SparkSession, path: str) -> bool:
    """Whether there is anything at a path, in whatever store it lies."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)
