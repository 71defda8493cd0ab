"""Least squares of sliding samples straight from hourly rows.

A sliding sample is a stretch of neighbouring hours, so the products that the normal equations need are sums of
v(t) * v(t + lag) over a range of hours, which two neighbouring samples share but for one term. Hours are therefore
grouped in blocks, each hour once and those near an edge twice, and no table of samples is ever made:

* over a range of neighbouring samples, each lag takes one product over its hours; the other entries with the same
  lag follow from it by adding the term that enters and taking away the one that leaves;
* for a shuffled split the samples outside the training part are worked out one by one, a slice at a time, and taken
  away from the sums over all samples of the block (or the training samples are added up so, if they are fewer).

Blocks return one matrix of sums each, which add up to the plant's; its weights go back to the blocks for forecasts.
"""

import time
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noonward import constants as K
from noonward.operators import timeline as T
from noonward.operators.linear import FIT_SCHEMA, add_up, share_of_time, solve_sums
from noonward.operators.prepare import Prepared, scale

#: Positions of a plant in a block; about a year, so that sums are few beside the hours they stand for.
BLOCK_HOURS = 8192
#: Samples put together at a time where sums over neighbours do not do.
SLICE = 1024

_SUMS = "plant_id string, experiment_name string, slot int, width int, plant_rows long, sums array<double>"
_WEIGHTS = "plant_id string, experiment_name string, weights array<double>, param_count int, train_time_sec double, plant_rows long"


@dataclass(frozen=True)
class Shape:
    """Where the features and targets of a sample lie: columns of an hour, and hours before and from its start on."""

    hist: int
    fcst: int
    past: int
    future: int

    @property
    def offsets(self) -> range:
        return range(-self.past if self.hist else 0, self.future)

    @property
    def columns(self) -> np.ndarray:
        """Places of (features, targets) in the hours of a sample laid end to end: past, ahead, target."""
        first, d = self.offsets[0], self.hist + self.fcst + 1
        past = [(k - first) * d + c for k in self.offsets if k < 0 for c in range(self.hist)]
        ahead = [(k - first) * d + self.hist + c for k in range(self.future) for c in range(self.fcst)]
        target = [(k - first) * d + d - 1 for k in range(self.future)]
        return np.array([*past, *ahead, *target], np.int64)

    @property
    def width(self) -> int:
        return (self.past * self.hist if self.hist else 0) + self.future * self.fcst


def stretched(hours: np.ndarray, starts: np.ndarray, shape: Shape) -> np.ndarray:
    """(features, targets) of the samples that start at some rows."""
    at = starts[:, None] + np.array(shape.offsets)
    return hours[at].reshape(len(starts), -1)[:, shape.columns]


def sums_of_samples(hours: np.ndarray, starts: np.ndarray, shape: Shape) -> np.ndarray:
    """Products of (1, features, targets) summed over samples, a slice at a time."""
    side = len(shape.columns) + 1
    out = np.zeros((side, side))
    for k in range(0, len(starts), SLICE):
        part = stretched(hours, starts[k : k + SLICE], shape)
        z = np.hstack([np.ones((len(part), 1)), part])
        out += z.T @ z
    return out


def sums_of_range(hours: np.ndarray, first: int, last: int, shape: Shape) -> np.ndarray:
    """As sums_of_samples for all starts from `first` up to `last`, from products by lag."""
    low, n, d = shape.offsets[0], len(shape.offsets), hours.shape[1]
    every = np.zeros((n * d, n * d))
    blocks = every.reshape(n, d, n, d)
    for lag in range(n):
        base = hours[first + low : last + low].T @ hours[first + low + lag : last + low + lag]
        steps = np.arange(n - lag - 1)  # from one entry with this lag to the next
        leaves = hours[first + low + steps][:, :, None] * hours[first + low + steps + lag][:, None, :]
        enters = hours[last + low + steps][:, :, None] * hours[last + low + steps + lag][:, None, :]
        moved = base + np.concatenate([np.zeros((1, d, d)), np.cumsum(enters - leaves, axis=0)])
        i = np.arange(n - lag)
        blocks[i, :, i + lag, :] = moved
        blocks[i + lag, :, i, :] = moved.transpose(0, 2, 1)
    totals = np.concatenate([np.zeros((1, d)), np.cumsum(hours, axis=0)])
    at = np.array(shape.offsets)
    single = (totals[last + at] - totals[first + at]).ravel()[shape.columns]
    side = len(shape.columns) + 1
    out = np.empty((side, side))
    out[0, 0], out[0, 1:], out[1:, 0] = last - first, single, single
    out[1:, 1:] = every[np.ix_(shape.columns, shape.columns)]
    return out


def training_sums(hours: np.ndarray, starts: np.ndarray, trains: np.ndarray, shape: Shape) -> np.ndarray:
    """Sums over the training samples among `starts`, which rise."""
    own = starts[trains]
    runs = np.split(own, np.flatnonzero(np.diff(own) > 1) + 1)
    if len(runs) * len(shape.offsets) <= len(own):  # long stretches of neighbours
        return sum(sums_of_range(hours, int(r[0]), int(r[-1]) + 1, shape) for r in runs)
    neighbours = len(starts) == starts[-1] - starts[0] + 1
    if neighbours and 2 * len(own) > len(starts):
        return sums_of_range(hours, int(starts[0]), int(starts[-1]) + 1, shape) - sums_of_samples(hours, starts[~trains], shape)
    return sums_of_samples(hours, own, shape)


def sliding_hours(prepared: Prepared, past: int, future: int, split: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, Shape]:
    """Hourly rows in blocks: position, start number and part, target and scaled columns v0, v1, ..."""
    plan = prepared.plan
    hist = plan.hist if past and not plan.forecast_only else []
    shape = Shape(len(hist), len(plan.fcst), past, future)
    columns = [*hist, *plan.fcst, K.TARGET]
    lo, hi = f"lo_{K.TARGET}", f"hi_{K.TARGET}"
    bounds = [f"{side}_{c}" for c in dict.fromkeys(columns) for side in ("lo", "hi")]
    placed = T.add_position(prepared.hours, prepared.spine, *bounds)
    is_start = (F.col("pos") >= past) & (F.col("pos") + future <= F.col("plant_rows"))
    rows = placed.select(
        T.PLANT,
        "dt",
        "pos",
        "plant_rows",
        F.when(is_start, F.col("pos") - past).alias("sample_idx"),
        (F.col("plant_rows") - past - future + 1).alias("n_samples"),
        F.col(lo).alias("lo"),
        F.col(hi).alias("hi"),
        F.col(K.TARGET).cast("double").alias("t"),
        *[scale(c).alias(f"v{i}") for i, c in enumerate(columns)],
    )
    spread = T.spread_to_blocks(split(rows).drop("n_samples"), "pos", past, future - 1, max(BLOCK_HOURS, past + future))
    return spread, shape


def _block(rows: pd.DataFrame, shape: Shape) -> tuple[pd.DataFrame, np.ndarray]:
    """The rows of a block in order and their values."""
    rows = rows.sort_values("pos", ignore_index=True)
    values = rows[[f"v{i}" for i in range(shape.hist + shape.fcst + 1)]].to_numpy(float)
    return rows, np.nan_to_num(values, nan=0.0, posinf=1.0, neginf=-1.0)


def fit_sliding(spread: DataFrame, shape: Shape, name: str) -> tuple[DataFrame, DataFrame]:
    """Weights of each plant, and forecasts of its test samples, from hourly rows of `sliding_hours`."""

    def sums(rows: pd.DataFrame) -> pd.DataFrame:
        rows, hours = _block(rows, shape)
        starts = np.flatnonzero(rows["in_own_block"] & rows["sample_idx"].notna())
        trains = (rows["part"] == "train").to_numpy()[starts]
        out = []
        if trains.any():
            first = rows.iloc[0]
            total = training_sums(hours, starts, trains, shape)
            out = [[first["plant_id"], name, int(first["block"]) // 64, shape.width, int(first["plant_rows"]), total.ravel()]]
        return pd.DataFrame(out, columns=["plant_id", "experiment_name", "slot", "width", "plant_rows", "sums"])

    def solve(rows: pd.DataFrame) -> pd.DataFrame:
        started = time.perf_counter()
        weights = solve_sums(rows)
        first = rows.iloc[0]
        spent = time.perf_counter() - started
        row = [first["plant_id"], first["experiment_name"], weights.ravel(), shape.width, spent, first["plant_rows"]]
        return pd.DataFrame([row], columns=[f.split()[0] for f in _WEIGHTS.split(", ")])

    def forecast(rows: pd.DataFrame, fitted: pd.DataFrame) -> pd.DataFrame:
        names = [f.split()[0] for f in FIT_SCHEMA.split(", ")]
        if rows.empty or fitted.empty:
            return pd.DataFrame(columns=names)
        rows, hours = _block(rows, shape)
        starts = np.flatnonzero(rows["in_own_block"] & rows["sample_idx"].notna() & (rows["part"] == "test"))
        if not len(starts):
            return pd.DataFrame(columns=names)
        model = fitted.iloc[0]
        weights = np.asarray(model["weights"]).reshape(shape.width + 1, -1)
        guess, started = np.empty((len(starts), shape.future)), time.perf_counter()
        for k in range(0, len(starts), SLICE):
            x = stretched(hours, starts[k : k + SLICE], shape)[:, : shape.width]
            guess[k : k + SLICE] = x @ weights[1:] + weights[0]
        each = share_of_time(started, len(starts))
        truth = rows["t"].to_numpy(float)[starts[:, None] + np.arange(shape.future)]
        own = rows.iloc[starts]
        return pd.DataFrame(
            {
                "plant_id": own["plant_id"].to_numpy(),
                "experiment_name": name,
                "sample_idx": own["sample_idx"].to_numpy().astype(np.int64),
                "date": own["dt"].dt.date.to_numpy(),
                "end_dt": rows["dt"].to_numpy()[starts + shape.future - 1],
                "y_true": list(truth),
                "y_pred": list(guess),
                "lo": own["lo"].to_numpy(),
                "hi": own["hi"].to_numpy(),
                "param_count": shape.width,
                "train_time_sec": model["train_time_sec"],
                "inference_time_sec": each,
                "error": None,
            }
        )[names]

    blocks = spread.groupBy("plant_id", "block")
    slots = blocks.applyInPandas(sums, schema=_SUMS).groupBy("plant_id", "experiment_name", "slot").applyInPandas(add_up, schema=_SUMS)
    weights = slots.groupBy("plant_id", "experiment_name").applyInPandas(solve, schema=_WEIGHTS)
    size = max(BLOCK_HOURS, shape.past + shape.future)
    last = F.floor((F.col("plant_rows") - 1) / size)
    sent = weights.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), last)))
    return weights, blocks.cogroup(sent.groupBy("plant_id", "block")).applyInPandas(forecast, schema=FIT_SCHEMA)
