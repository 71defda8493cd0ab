"""Error measures as aggregate columns.

Each takes the truth and the prediction and can be used in groupBy().agg(), over a window or on a
whole table. A pair counts only when both sides are present. All of them are sums, counts, extremes
or moments, so Spark combines them before the shuffle and a large group costs no more than a small one.
"""

from pyspark.sql import Column
from pyspark.sql import functions as F

from noonward.functions.columns import absent_if_nan, half_even


def valid_pair(truth, guess) -> tuple[Column, Column]:
    """Both sides, emptied where either is missing."""
    t, g = absent_if_nan(truth), absent_if_nan(guess)
    both = t.isNotNull() & g.isNotNull()
    return F.when(both, t), F.when(both, g)


def pairs(truth="y_true", guess="y_pred") -> Column:
    t, _ = valid_pair(truth, guess)
    return F.count(t)


def mae(truth="y_true", guess="y_pred") -> Column:
    t, g = valid_pair(truth, guess)
    return F.avg(F.abs(t - g))


def mse(truth="y_true", guess="y_pred") -> Column:
    t, g = valid_pair(truth, guess)
    return F.avg((t - g) * (t - g))


def rmse(truth="y_true", guess="y_pred") -> Column:
    return F.sqrt(mse(truth, guess))


def value_range(truth="y_true", guess="y_pred") -> Column:
    t, _ = valid_pair(truth, guess)
    return F.max(t) - F.min(t)


def nrmse(truth="y_true", guess="y_pred") -> Column:
    """Error over the range of the truth; missing where the truth is constant."""
    return rmse(truth, guess) / F.nullif(value_range(truth, guess), F.lit(0.0))


def nrmse_or_inf(truth="y_true", guess="y_pred") -> Column:
    """Error over the range of the truth; infinite where the truth is constant."""
    spread = value_range(truth, guess)
    return F.when(spread == 0, F.lit(float("inf"))).otherwise(rmse(truth, guess) / F.nullif(spread, F.lit(0.0)))


def _squares(truth, guess) -> tuple[Column, Column]:
    t, g = valid_pair(truth, guess)
    return F.sum((t - g) * (t - g)), F.var_pop(t) * F.count(t)


def r2(truth="y_true", guess="y_pred") -> Column:
    """Share of variance explained; for a constant truth 1 if all predictions hit, else 0."""
    residual, total = _squares(truth, guess)
    return (
        F.when(total > 0, 1 - residual / F.nullif(total, F.lit(0.0)))
        .when(residual == 0, F.lit(1.0))
        .when(residual > 0, F.lit(0.0))
    )


def r2_or_zero(truth="y_true", guess="y_pred") -> Column:
    """Share of variance explained; 0 for a constant truth."""
    residual, total = _squares(truth, guess)
    return F.when(total > 0, 1 - residual / F.nullif(total, F.lit(0.0))).when(residual.isNotNull(), F.lit(0.0))


def smape(truth="y_true", guess="y_pred") -> Column:
    """Mean of 2|t-g| / (|t|+|g|) over pairs with a positive side."""
    t, g = valid_pair(truth, guess)
    size = F.abs(t) + F.abs(g)
    return F.avg(F.when((t > 0) | (g > 0), 2 * F.abs(t - g) / F.nullif(size, F.lit(0.0))))


def flat_metrics(places: int | None = 4) -> list[Column]:
    """All flat measures, rounded half-even unless `places` is None."""
    measures = {"mae": mae(), "rmse": rmse(), "mse": mse(), "nrmse": nrmse(), "r2": r2(), "smape": smape()}
    return [(m if places is None else half_even(m, places)).alias(name) for name, m in measures.items()]


def study_metrics() -> list[Column]:
    """Unrounded measures of the sliced studies."""
    return [
        mae().alias("mae"),
        rmse().alias("rmse"),
        r2_or_zero().alias("r2"),
        nrmse_or_inf().alias("nrmse"),
        pairs().alias("samples"),
    ]


def share_of_mae(rmse_col, mae_col) -> Column:
    """RMSE as a percentage of MAE, the ratio the season/hour summary stores as nRMSE."""
    return F.when(F.col(mae_col) > 0, F.col(rmse_col) / (F.col(mae_col) + 1e-8) * 100).otherwise(F.lit(0.0))


def twice_share_of_mae(mae_col) -> Column:
    """The ratio the season/hour summary stores as sMAPE."""
    return F.when(F.col(mae_col) > 0, 2 * F.col(mae_col) / (F.col(mae_col) + 1e-8) * 100).otherwise(F.lit(0.0))
