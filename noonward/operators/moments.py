"""Count, mean and squared deviations of metrics per group, kept so that later results can be added to them."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

MOMENTS = "n bigint, mean double, squares double"


def moments(rows: DataFrame, keys: list[str], metrics: list[str]) -> DataFrame:
    """One row per group and metric: how many values, their mean and the sum of squared deviations from it.

    Empty values do not count; a metric without values in a group has n = 0 and nothing else. Empty keys are a group.
    """
    cells = [
        F.struct(
            F.lit(m).alias("metric"),
            F.count(m).alias("n"),
            F.avg(m).alias("mean"),
            (F.var_pop(m) * F.count(m)).alias("squares"),
        )
        for m in metrics
    ]
    wide = rows.groupBy(*keys).agg(*[c.alias(f"_{i}") for i, c in enumerate(cells)])
    return wide.select(*keys, F.explode(F.array(*[f"_{i}" for i in range(len(cells))])).alias("m")).select(*keys, "m.*")


def merged(parts: DataFrame, keys: list[str]) -> DataFrame:
    """Moments of all rows from moments of disjoint parts of them.

    Deviations of the parts' means are taken from the common mean, not from squares, so nothing is lost by cancelling.
    """
    group = Window.partitionBy(*keys, "metric")
    common = F.sum(F.col("mean") * F.col("n")).over(group) / F.nullif(F.sum("n").over(group), F.lit(0))
    off = F.col("n") * F.pow(F.col("mean") - F.col("_common"), 2)
    return (
        parts.withColumn("_common", common)
        .groupBy(*keys, "metric")
        .agg(F.sum("n").alias("n"), F.max("_common").alias("mean"), F.sum(F.col("squares") + off).alias("squares"))
    )


def deviation(n: str = "n", squares: str = "squares"):
    """Sample deviation; empty for fewer than two values."""
    return F.when(F.col(n) > 1, F.sqrt(F.col(squares) / (F.col(n) - 1)))
