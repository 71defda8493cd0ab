"""Least-squares fits: one linear model per plant and experiment with 24 outputs."""

import time
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KEY = ["plant_id", "experiment_name"]
FIT_SCHEMA = (
    "plant_id string, experiment_name string, sample_idx long, date date, end_dt timestamp_ntz, y_true array<double>, "
    "y_pred array<double>, lo double, hi double, param_count int, train_time_sec double, inference_time_sec double, error string"
)
_CARRIED = [*KEY, "sample_idx", "date", "end_dt", "y_true", "lo", "hi"]
_INPUT = [*_CARRIED, "part", "features", "y"]
_OUTPUT = [f.split()[0] for f in FIT_SCHEMA.split(", ")]


def clean_matrix(column: pd.Series) -> np.ndarray:
    return np.nan_to_num(np.vstack(column.to_numpy()).astype(float), nan=0.0, posinf=1.0, neginf=-1.0)


def share_of_time(started: float, samples: int) -> float:
    """A sample's share of the seconds since `started`; the sum over samples is the time of the forecast."""
    return (time.perf_counter() - started) / max(samples, 1)


def _fit_group(rows: pd.DataFrame) -> pd.DataFrame:
    """Centre, solve by least squares of smallest norm, predict the test rows."""
    train, test = rows[rows["part"] == "train"], rows[rows["part"] == "test"]
    started = time.perf_counter()
    try:
        if train.empty or test.empty:
            raise ValueError("too few samples to train and test")
        x, y = clean_matrix(train["features"]), clean_matrix(train["y"])
        x_mean, y_mean = x.mean(axis=0), y.mean(axis=0)
        weights = np.linalg.lstsq(x - x_mean, y - y_mean, rcond=None)[0]
        spent, started = time.perf_counter() - started, time.perf_counter()
        guess = (clean_matrix(test["features"]) - x_mean) @ weights + y_mean
    except (ValueError, np.linalg.LinAlgError) as problem:  # becomes a failed result
        blank = dict.fromkeys(_CARRIED) | {k: rows.iloc[0][k] for k in KEY}
        return pd.DataFrame([blank]).assign(y_pred=None, param_count=0, train_time_sec=0.0, inference_time_sec=0.0, error=str(problem))[_OUTPUT]
    each = share_of_time(started, len(test))
    made = test[_CARRIED].assign(y_pred=list(guess), param_count=x.shape[1], train_time_sec=spent, inference_time_sec=each, error=None)
    return made[_OUTPUT]


def fit_daily(samples: DataFrame) -> DataFrame:
    """Fit each plant's daily samples and forecast its test days, in scaled units.

    A group holds at most one row per calendar day, whatever the size of the plant's table; samples
    are needed once for all 24 outputs, and the validation part stays behind.
    """
    return (
        samples.filter("part <> 'val'").select(*_INPUT).groupBy(*KEY).applyInPandas(_fit_group, schema=FIT_SCHEMA)
    )


_SUMS_SCHEMA = "plant_id string, experiment_name string, slot int, width int, sums array<double>"
_WEIGHTS_SCHEMA = "plant_id string, experiment_name string, weights array<double>, param_count int, train_time_sec double"
#: Samples whose products are added up in one group, and then per plant: both steps stay small as histories grow.
_SLOT_SAMPLES = 65_536


def _products(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Products of the columns (1, features, targets) summed over each batch and group."""
    for batch in batches:
        out = []
        for key, rows in batch.groupby(KEY, sort=False):
            x, y = clean_matrix(rows["features"]), clean_matrix(rows["y"])
            z = np.hstack([np.ones((len(x), 1)), x, y])
            slot = int(rows["sample_idx"].iloc[0]) // _SLOT_SAMPLES
            out.append([*key, slot, x.shape[1], (z.T @ z).ravel()])
        if out:
            yield pd.DataFrame(out, columns=[*KEY, "slot", "width", "sums"])


def add_up(rows: pd.DataFrame) -> pd.DataFrame:
    total = rows.iloc[:1].copy()
    total["sums"] = [np.sum(np.vstack(rows["sums"].to_numpy()), axis=0)]
    return total


def least_norm(square: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The solution of least norm of the normal equations; by Cholesky's method where they are well conditioned."""
    used = np.flatnonzero(square.diagonal() > 0)
    size = np.sqrt(square.diagonal()[used])
    out = np.zeros(right.shape)
    try:
        lower = np.linalg.cholesky(square[np.ix_(used, used)] / np.outer(size, size))
    except np.linalg.LinAlgError:
        lower = np.zeros((1, 1))
    if lower.size and lower.diagonal().min() > 1e-3:
        out[used] = np.linalg.solve(lower.T, np.linalg.solve(lower, right[used] / size[:, None])) / size[:, None]
        return out
    return np.linalg.pinv(square, rcond=1e-12, hermitian=True) @ right


def solve_sums(rows: pd.DataFrame) -> np.ndarray:
    """Intercepts (first row) and weights of all outputs from the products of (1, features, targets) in `sums`."""
    width = int(rows["width"].iloc[0])
    flat = np.sum(np.vstack(rows["sums"].to_numpy()), axis=0)
    side = int(round(np.sqrt(len(flat))))
    z = flat.reshape(side, side)
    n, sums = z[0, 0], z[0, 1:]
    centred = z[1:, 1:] - np.outer(sums, sums) / n
    weights = least_norm(centred[:width, :width], centred[:width, width:])
    intercept = (sums[width:] - sums[:width] @ weights) / n
    return np.vstack([intercept, weights])


def _solve(rows: pd.DataFrame) -> pd.DataFrame:
    started = time.perf_counter()
    both, first = solve_sums(rows).ravel(), rows.iloc[0]
    return pd.DataFrame(
        [[first["plant_id"], first["experiment_name"], both, int(first["width"]), time.perf_counter() - started]],
        columns=["plant_id", "experiment_name", "weights", "param_count", "train_time_sec"],
    )


def _apply(test: pd.DataFrame, fitted: pd.DataFrame) -> pd.DataFrame:
    if test.empty or fitted.empty:
        return pd.DataFrame(columns=_OUTPUT)
    started = time.perf_counter()
    x, model = clean_matrix(test["features"]), fitted.iloc[0]
    weights = np.asarray(model["weights"]).reshape(x.shape[1] + 1, -1)
    guess = x @ weights[1:] + weights[0]
    return test[_CARRIED].assign(
        y_pred=list(guess),
        param_count=model["param_count"],
        train_time_sec=model["train_time_sec"],
        inference_time_sec=share_of_time(started, len(test)),
        error=None,
    )[_OUTPUT]


def fit_hourly(samples: DataFrame) -> DataFrame:
    """As fit_daily for one sample per hour, where a plant's samples are too many for one task.

    The products the normal equations need are summed per Arrow batch, then in slots, then per group,
    so no task sees more than a batch of samples or a few product matrices. Weights meet the test
    samples year by year, each weight row once per group rather than once per sample.
    """
    used = samples.select(*_INPUT)
    partial = used.filter("part = 'train'").select(*KEY, "sample_idx", "features", "y").mapInPandas(
        _products, schema=_SUMS_SCHEMA
    )
    slots = partial.groupBy(*KEY, "slot").applyInPandas(add_up, schema=_SUMS_SCHEMA)
    weights = slots.groupBy(*KEY).applyInPandas(_solve, schema=_WEIGHTS_SCHEMA)
    test = used.filter("part = 'test'").drop("part", "y").withColumn("_year", F.year("date"))
    years = test.select(*KEY, F.col("_year").alias("_fitted_year")).distinct()
    grouped = weights.join(years, KEY).groupBy(*KEY, "_fitted_year")
    return test.groupBy(*KEY, "_year").cogroup(grouped).applyInPandas(_apply, schema=FIT_SCHEMA)


def fit_one_feature(rows: DataFrame, keys: list[str], feature: str, target: str) -> DataFrame:
    """Slope and intercept of a line per key; a flat line through the mean where the feature is constant."""
    slope = F.coalesce(F.regr_slope(target, feature), F.lit(0.0))
    mean = F.avg(target)
    return rows.groupBy(*keys).agg(
        slope.alias("slope"),
        F.coalesce(F.regr_intercept(target, feature), mean).alias("intercept"),
        F.count(F.lit(1)).alias("n"),
    )
