"""Connected components of a table of edges."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noonward.session import discard, store


def components(edges: DataFrame) -> DataFrame:
    """(id, component) of all ids in `edges` (a long, b long): component is the least id that can be reached.

    Every round each id takes the least label among itself, its neighbours and the label of its label, so that
    chains shorten by half or more; rounds go on until no label changes. All steps are joins on one id and
    minima that combine before the shuffle; each round is written to the shared folder, and only a count comes to
    the driver. Edges with a missing end are left out.
    """
    real = edges.filter("a is not null and b is not null and a <> b").select("a", "b")
    both = store(real.union(real.select("b", "a")).distinct())
    start = both.groupBy("a").agg(F.least("a", F.min("b")).alias("label"))
    labels = store(start.select(F.col("a").alias("id"), "label", F.lit(True).alias("moved")))
    while not labels.filter("moved").isEmpty():
        near = both.join(labels.withColumnRenamed("id", "b"), "b").groupBy("a").agg(F.min("label").alias("near"))
        step = labels.join(near.withColumnRenamed("a", "id"), "id").select("id", "label", F.least("label", "near").alias("least"))
        jump = step.select(F.col("id").alias("least"), F.col("least").alias("further"))
        new = F.least("least", "further")
        before, labels = labels, store(step.join(jump, "least").select("id", new.alias("label"), (new != F.col("label")).alias("moved")))
        discard(before)
    discard(both)
    return labels.select("id", F.col("label").alias("component"))
