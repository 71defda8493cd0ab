import math

import pytest
from pyspark.sql import functions as F

from noonward.functions import metrics as M
from noonward.operators import evaluate as V
from noonward.plans import reports as R
from noonward.plans import studies as U

NAN = float("nan")


def score(spark, pairs):
    rows = spark.createDataFrame(pairs, "y_true double, y_pred double")
    extra = [M.nrmse_or_inf().alias("nrmse_inf"), M.r2_or_zero().alias("r2_zero"), M.pairs().alias("n")]
    return rows.agg(*M.flat_metrics(), *extra).first().asDict()


def test_flat_metrics(spark):
    got = score(spark, [(1.0, 2.0), (3.0, 3.0), (5.0, 1.0)])
    assert got["mae"] == 1.6667 and got["mse"] == 5.6667 and got["rmse"] == 2.3805
    assert got["nrmse"] == 0.5951 and got["r2"] == -1.125
    assert got["smape"] == round((2 / 3 + 0 + 8 / 6) / 3, 4)


def test_missing_side_leaves_the_pair_out(spark):
    whole = score(spark, [(1.0, 2.0), (3.0, 3.0), (5.0, 1.0)])
    assert score(spark, [(1.0, 2.0), (None, 9.0), (3.0, 3.0), (7.0, None), (5.0, 1.0), (NAN, 1.0), (8.0, NAN)]) == whole


def test_nothing_to_score(spark):
    assert all(v is None for k, v in score(spark, [(None, 1.0)]).items() if k != "n")


def test_constant_truth(spark):
    got = score(spark, [(4.0, 5.0), (4.0, 4.0)])
    assert got["nrmse"] is None and got["nrmse_inf"] == math.inf and got["r2"] == 0.0 and got["r2_zero"] == 0.0
    hit = score(spark, [(4.0, 4.0), (4.0, 4.0)])
    assert hit["r2"] == 1.0 and hit["r2_zero"] == 0.0


def test_smape_skips_pairs_without_a_positive_side(spark):
    assert score(spark, [(0.0, 0.0), (1.0, 1.0)])["smape"] == 0.0
    assert score(spark, [(0.0, 0.0)])["smape"] is None
    assert score(spark, [(-1.0, -3.0), (2.0, 0.0)])["smape"] == 2.0


def test_rounding_is_half_even(spark):
    assert spark.range(1).select(F.bround(F.lit(0.125), 2)).first()[0] == 0.12
    assert score(spark, [(0.0, 0.00005), (0.0, 0.00005)])["mae"] in (0.0, 0.0001)


def forecast_table(spark, days):
    rows = [("p", "e", "m", i, h, t, g) for i, pairs in enumerate(days) for h, (t, g) in enumerate(pairs)]
    schema = "plant_id string, experiment_name string, model string, sample_idx long, horizon int, y_true double, y_pred double"
    return spark.createDataFrame(rows, schema)


def test_daily_metrics(spark):
    days = [[(1.0, 2.0), (3.0, 3.0)], [(5.0, 1.0), (0.0, None)], [(None, 1.0)]]
    got = V.daily_metrics(forecast_table(spark, days), "plant_id").first()
    assert got["n_days"] == 2 and got["samples"] == 3
    assert got["mae"] == 2.25
    assert got["rmse"] == round((math.sqrt(0.5) + 4) / 2, 4)
    truth, guess = [1.0, 3.0, 5.0], [2.0, 3.0, 1.0]
    total = sum((t - 3.0) ** 2 for t in truth)
    assert got["r2"] == round(1 - sum((t - g) ** 2 for t, g in zip(truth, guess)) / total, 4)


def test_daily_metrics_of_constant_truth(spark):
    assert V.daily_metrics(forecast_table(spark, [[(2.0, 2.0)], [(2.0, 2.0)]]), "plant_id").first()["r2"] == 1.0
    assert V.daily_metrics(forecast_table(spark, [[(2.0, 1.0)], [(2.0, 2.0)]]), "plant_id").first()["r2"] == 0.0
    got = V.experiment_metrics(forecast_table(spark, [[(2.0, 1.0)]]), "plant_id").first()
    assert got["nrmse"] is None and got["mse"] == 1.0
    study = V.study_daily_metrics(forecast_table(spark, [[(2.0, 1.0)]]), "plant_id").first()
    assert study["nrmse"] == math.inf


def test_study_nrmse_is_flat(spark):
    days = [[(1.0, 2.0), (3.0, 3.0)], [(5.0, 1.0), (0.0, 0.0)]]
    got = V.study_daily_metrics(forecast_table(spark, days), "plant_id").first()
    assert got["nrmse"] == pytest.approx(math.sqrt(17 / 4) / 5) and got["test_samples"] == 4


def test_hours_ahead(spark):
    n = 30
    days = [[(float(i * 100 + h), float(i * 1000 + h)) for h in range(24)] for i in range(n)]
    got = V.hours_ahead(forecast_table(spark, days)).collect()
    for h in (1, 3, 6, 12, 24):
        pairs = {(r["y_pred"], r["y_true"]) for r in got if r["h"] == h}
        assert pairs == {(float((i - h + 1) * 1000 + h - 1), float(i * 100)) for i in range(h - 1, n)}


def test_by_hour_and_season(spark):
    from datetime import date

    table = forecast_table(spark, [[(1.0, 2.0), (3.0, 3.0)]]).withColumn("date", F.lit(date(2023, 12, 31)))
    assert [r["season"] for r in U.by_season(table, "model").collect()] == ["Winter"]
    assert {(r["hour"], r["mae"]) for r in U.by_hour(table, "model").collect()} == {(0, 1.0), (1, 0.0)}


def test_single_plant_has_no_deviation_and_pivot_shows_it(spark):
    detailed = spark.createDataFrame(
        [("a", "RF", "Fall", 1.0, 2.0), ("b", "RF", "Fall", 2.0, 4.0), ("a", "Linear", "Fall", 5.0, 1.0),
         ("a", "RF", "Spring", 7.0, 1.0)],
        "plant_id string, model string, season string, mae double, rmse double",
    )
    totals = R.aggregate_over_plants(detailed, "season", "model")
    one = totals.filter("model = 'Linear'").first()
    assert one["mae_std"] is None and one["n_plants"] == 1
    cells = {r["season"]: r.asDict() for r in R.pivot_formatted(totals, "season", "mae", ["Linear", "RF", "GRU"]).collect()}
    assert cells["Fall"] == {"season": "Fall", "Linear": "5.00", "RF": "1.50±0.71", "GRU": "N/A"}
    assert cells["Spring"]["RF"] == "7.00" and cells["Spring"]["Linear"] == "N/A"
    wide = {r["season"]: r["RF"] for r in R.pivot_models(totals, "season", "mae_mean", ["RF"]).collect()}
    assert wide == {"Fall": 1.5, "Spring": 7.0}


def test_aggregate_results(spark):
    rows = [("RF", "SUCCESS", 1.0, 2.0, 4.0), ("RF", "SUCCESS", 3.0, 6.0, 4.0), ("GRU", "FAILED", 9.0, 9.0, 9.0)]
    results = spark.createDataFrame(rows, "model string, status string, mae double, rmse double, mean_true double")
    got = R.aggregate_results(results, "model").collect()
    assert len(got) == 1 and got[0]["mae_mean"] == 2.0 and got[0]["nrmse_mean"] == 1.0
    overall = {r["metric"]: (r["mean"], r["std"]) for r in R.aggregate_results(results).collect()}
    assert overall == {"mae": (2.0, 1.41), "rmse": (4.0, 2.83), "nrmse": (1.0, 0.71)}
    assert R.aggregate_results(results.filter("status = 'FAILED'")).count() == 0
