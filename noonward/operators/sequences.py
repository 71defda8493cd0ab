"""Sequence features and epoch logs."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from noonward import constants as K


def dilated_offsets(kernel: int, levels: int) -> list[int]:
    """Rows back that a stack of causal kernels with doubling dilation looks at."""
    return sorted({step * 2**level for level in range(levels) for step in range(1, kernel)})


def position_waves(pos, width: int) -> Column:
    """Sine in even and cosine in odd places, with wave lengths growing along the width."""
    waves = []
    for place in range(width):
        rate = F.exp(F.lit(-float(place - place % 2)) * F.log(F.lit(10000.0)) / width)
        angle = F.col(pos) * rate
        waves.append(F.cos(angle) if place % 2 else F.sin(angle))
    return F.array(*waves)


def cumulative_time(log: DataFrame) -> DataFrame:
    """Running training time of each run; a run has a bounded number of epochs."""
    run = Window.partitionBy("plant_id", "experiment_name").orderBy("epoch")
    return log.withColumn("cum_time", F.sum("epoch_time").over(run.rowsBetween(Window.unboundedPreceding, 0)))


def best_epochs(log: DataFrame) -> DataFrame:
    """The epoch with the smallest validation loss, the first of equals."""
    best = F.min(F.struct("val_loss", "epoch"))
    return log.groupBy("plant_id", "experiment_name").agg(best.alias("b")).select(
        "plant_id", "experiment_name", F.col("b.epoch").alias("best_epoch"), F.col("b.val_loss").alias("best_loss")
    )


def _losses(log: DataFrame) -> DataFrame:
    in_order = F.sort_array(F.collect_list(F.struct("epoch", "val_loss")))
    return log.groupBy("plant_id", "experiment_name").agg(in_order.alias("losses"))


def early_stops(log: DataFrame, patience: int = 10, min_delta: float = 0.001) -> DataFrame:
    """The epoch a run ends at when `patience` epochs in a row fail to beat the best loss by min_delta."""
    start = F.struct(F.lit(float("inf")).alias("best"), F.lit(0).alias("waited"), F.lit(0).alias("last"))

    def step(state: Column, epoch: Column) -> Column:
        better = epoch["val_loss"] < state["best"] - F.lit(min_delta)
        after = F.struct(
            F.when(better, epoch["val_loss"]).otherwise(state["best"]).alias("best"),
            F.when(better, F.lit(0)).otherwise(state["waited"] + 1).alias("waited"),
            epoch["epoch"].alias("last"),
        )
        return F.when(state["waited"] >= patience, state).otherwise(after)

    return _losses(log).select(
        "plant_id",
        "experiment_name",
        F.aggregate("losses", start, step)["last"].alias("stop_epoch"),
        F.size("losses").alias("n_epochs"),
    )


def final_rates(log: DataFrame, rate: float = 0.001) -> DataFrame:
    """Learning rate after the last epoch of a schedule that lowers it when the loss stalls."""
    start = F.struct(F.lit(float("inf")).alias("best"), F.lit(0).alias("bad"), F.lit(rate).alias("rate"))

    def step(state: Column, epoch: Column) -> Column:
        better = epoch["val_loss"] < state["best"] * F.lit(1 - K.PLATEAU["threshold"])
        bad = F.when(better, F.lit(0)).otherwise(state["bad"] + 1)
        lowered = F.greatest(state["rate"] * F.lit(K.PLATEAU["factor"]), F.lit(K.PLATEAU["min_lr"]))
        stalled = bad > K.PLATEAU["patience"]
        moved = F.when(stalled & (state["rate"] - lowered > 1e-8), lowered).otherwise(state["rate"])
        return F.struct(
            F.when(better, epoch["val_loss"]).otherwise(state["best"]).alias("best"),
            F.when(stalled, F.lit(0)).otherwise(bad).alias("bad"),
            moved.alias("rate"),
        )

    return _losses(log).select(
        "plant_id", "experiment_name", F.aggregate("losses", start, step)["rate"].alias("final_lr")
    )
