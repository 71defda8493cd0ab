"""Many levels of a linear fit from one table of sums.

Experiments that share their sample days differ in the columns they use (tiers of weather, time of day) and in how many
samples train. The products of (1, features, targets) are therefore summed once, by ranges of ranks: rows that merge
by addition. A training share is the sum of the first ranges, a tier a sub-matrix of it; nothing is read again. Levels
with fewer training samples than features, where the sums are the larger problem, are solved from their rows.
"""

import math
import time
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noonward import constants as K
from noonward.operators.linear import FIT_SCHEMA, add_up, clean_matrix, least_norm, share_of_time
from noonward.operators.prepare import FeaturePlan

SUMS_SCHEMA = "plant_id string, low long, high long, total long, width int, n long, sums array<double>"


@dataclass(frozen=True)
class Level:
    """An experiment: places of its features among those of the samples, and its shares for training and validation."""

    name: str
    columns: tuple[int, ...]
    train: float = K.TRAIN_RATIO
    val: float = K.VAL_RATIO

    def n_train(self, total: int) -> int:
        return math.floor(total * self.train)

    def first_test(self, total: int) -> int:
        return self.n_train(total) + math.floor(total * self.val)


def places(whole: FeaturePlan, own: FeaturePlan, past_hours: int) -> tuple[int, ...]:
    """Where the features of a plan lie among those of a plan that has all its columns."""
    past = [k * len(whole.hist) + whole.hist.index(c) for k in range(past_hours) for c in own.hist] if whole.hist else []
    start = past_hours * len(whole.hist)
    ahead = [start + k * len(whole.fcst) + whole.fcst.index(c) for k in range(K.HOURS_PER_DAY) for c in own.fcst]
    return (*past, *ahead)


def _range_sums(rows: pd.DataFrame, shares: list[float]) -> pd.DataFrame:
    """The sums of one plant, a row per range of ranks."""
    total = int(rows["n_samples"].iloc[0])
    ends = sorted({0, *(math.floor(total * s) for s in shares)})
    x, y, rank = clean_matrix(rows["features"]), clean_matrix(rows["y"]), rows["rank"].to_numpy()
    z = np.hstack([np.ones((len(x), 1)), x, y])
    out = []
    for low, high in zip(ends, ends[1:]):
        part = z[(rank >= low) & (rank < high)]
        out.append([rows["plant_id"].iloc[0], low, high, total, x.shape[1], len(part), (part.T @ part).ravel()])
    return pd.DataFrame(out, columns=[f.split()[0] for f in SUMS_SCHEMA.split(", ")])


def sums_by_rank(samples: DataFrame, shares: list[float]) -> DataFrame:
    """Sums of the products of (1, features, targets) per plant and range of ranks [low, high).

    Ranges end where one of the training shares ends; samples above the greatest are in none. `samples` has a row per
    plant and day with rank, n_samples, features and y.
    """
    used = samples.select("plant_id", "rank", "n_samples", "features", "y")
    return used.groupBy("plant_id").applyInPandas(lambda rows: _range_sums(rows, shares), schema=SUMS_SCHEMA)


def first_ranges(table: DataFrame, share: float) -> DataFrame:
    """The sums of all ranges below a training share, added up per plant."""
    own = table.filter(F.col("high") <= F.floor(F.col("total") * F.lit(share)))

    def add(rows: pd.DataFrame) -> pd.DataFrame:
        return add_up(rows).assign(low=rows["low"].min(), high=rows["high"].max(), n=rows["n"].sum())

    return own.groupBy("plant_id").applyInPandas(add, schema=SUMS_SCHEMA)


def solve_levels(sums: pd.DataFrame, levels: list[Level]) -> dict[str, tuple[np.ndarray, float]]:
    """(intercepts and weights, seconds) of the levels that have more training samples than features."""
    sums = sums.sort_values("low")
    total, width = int(sums["total"].iloc[0]), int(sums["width"].iloc[0])
    upto = np.cumsum(np.vstack(sums["sums"].to_numpy()), axis=0)
    side, high, out = math.isqrt(upto.shape[1]), sums["high"].tolist(), {}
    for level in levels:
        n, started = level.n_train(total), time.perf_counter()
        if n <= len(level.columns):
            continue
        z = upto[high.index(n)].reshape(side, side)
        x, y = np.array(level.columns, np.int64) + 1, np.arange(width + 1, side)
        mean = z[0] / n
        square = z[np.ix_(x, x)] - n * np.outer(mean[x], mean[x])
        right = z[np.ix_(x, y)] - n * np.outer(mean[x], mean[y])
        weights = least_norm(square, right)
        out[level.name] = np.vstack([mean[y] - mean[x] @ weights, weights]), time.perf_counter() - started
    return out


def fit_levels(samples: DataFrame, levels: list[Level]) -> DataFrame:
    """Forecasts of the test days of every level, in scaled units, as fit_daily gives them level by level.

    A group is a plant, with a row per calendar day at most; its rows are moved and read once for all levels.
    """
    names = [f.split()[0] for f in FIT_SCHEMA.split(", ")]
    carried = ["plant_id", "sample_idx", "date", "end_dt", "y_true", "lo", "hi"]

    def fit(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("rank", ignore_index=True)
        total, out = int(rows["n_samples"].iloc[0]), []
        features, y = clean_matrix(rows["features"]), clean_matrix(rows["y"])
        large = [level for level in levels if level.n_train(total) > len(level.columns)]
        solved = solve_levels(_range_sums(rows, [level.train for level in large]), large) if large else {}
        for level in levels:
            n, test = level.n_train(total), rows[level.first_test(total) :]
            if not n or test.empty:
                blank = dict.fromkeys(carried) | {"plant_id": rows["plant_id"].iloc[0]}
                failed = pd.DataFrame([blank]).assign(y_pred=None, param_count=0, train_time_sec=0.0, inference_time_sec=0.0, error="too few samples to train and test")
                out.append(failed.assign(experiment_name=level.name)[names])
                continue
            x = features[:, list(level.columns)]
            if level.name in solved:
                weights, spent = solved[level.name]
            else:
                started = time.perf_counter()
                x_mean, y_mean = x[:n].mean(axis=0), y[:n].mean(axis=0)
                slopes = np.linalg.lstsq(x[:n] - x_mean, y[:n] - y_mean, rcond=None)[0]
                weights, spent = np.vstack([y_mean - x_mean @ slopes, slopes]), time.perf_counter() - started
            started = time.perf_counter()
            guess = x[len(rows) - len(test) :] @ weights[1:] + weights[0]
            each = share_of_time(started, len(test))
            made = test[carried].assign(y_pred=list(guess), param_count=x.shape[1], train_time_sec=spent, inference_time_sec=each, error=None)
            out.append(made.assign(experiment_name=level.name)[names])
        return pd.concat(out, ignore_index=True)

    used = samples.select(*carried, "rank", "n_samples", "features", "y")
    return used.groupBy("plant_id").applyInPandas(fit, schema=FIT_SCHEMA)
