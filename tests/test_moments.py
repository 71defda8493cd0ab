from datetime import date, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from noonward.operators.moments import deviation, merged, moments
from noonward.plans import experiments as E
from noonward.plans import reports as R
from noonward.session import store


def results_table(spark, n=200, seed=3, shift=0.0):
    rng = np.random.default_rng(seed)
    rows = [
        (
            str(i % 20),
            f"e{i // 20}",
            ["RF", "XGB", None][i % 3],
            ["low", "high"][i % 2],
            "FAILED" if i % 11 == 0 else "SUCCESS",
            None if i % 13 == 0 else float(shift + rng.random()),
            float(rng.random() * 9),
        )
        for i in range(n)
    ]
    return spark.createDataFrame(rows, "plant_id string, experiment_name string, model string, complexity string, status string, mae double, rmse double")


def cells(table, *keys):
    return {tuple(r[k] for k in keys): {c: r[c] for c in table.columns if c not in keys} for r in table.collect()}


@pytest.mark.parametrize("keys", [["model"], ["model", "complexity"], []])
def test_added_batches_give_the_full_aggregate(spark, tmp_path, keys):
    results, path = results_table(spark), str(tmp_path / "m")
    for part in (0, 1, 2, 1):  # the second batch is written twice
        some = results.filter(F.col("plant_id").cast("int") % 3 == part)
        R.add_to_aggregate(some, path, "model", "complexity")
    by = keys or ["metric"]
    wanted, got = cells(R.aggregate_results(results, *keys), *by), cells(R.stored_aggregate(spark, path, *keys), *by)
    assert got == wanted and len(wanted) == {0: 2, 1: 3, 2: 6}[len(keys)]


def test_moments_of_parts_keep_small_spreads_of_large_means(spark):
    table = results_table(spark, shift=1e9).filter("mae is not null")
    parts = table.withColumn("part", F.spark_partition_id() % 2 + F.hash("plant_id") % 5)
    found = merged(moments(parts, ["part"], ["mae"]).drop("part"), []).withColumn("std", deviation()).first()
    values = [r["mae"] for r in table.collect()]
    assert found["n"] == len(values) and abs(found["mean"] - np.mean(values)) < 1e-5
    assert abs(found["std"] - np.std(values, ddof=1)) < 1e-5


def test_empty_and_single_values(spark, tmp_path):
    rows = [("a", "e", "RF", "SUCCESS", 2.0, None), ("a", "e", "XGB", "FAILED", 3.0, 1.0)]
    table = spark.createDataFrame(rows, "plant_id string, experiment_name string, model string, status string, mae double, rmse double")
    R.add_to_aggregate(table, str(tmp_path / "m"), "model")
    R.add_to_aggregate(table.limit(0), str(tmp_path / "m"), "model")
    got = [r.asDict() for r in R.stored_aggregate(spark, str(tmp_path / "m"), "model").collect()]
    assert got == [{"model": "RF", "mae_mean": 2.0, "mae_std": None, "rmse_mean": None, "rmse_std": None}]


def test_season_hour_record_takes_what_is_recorded(spark):
    pairs = [("p", m, 0, h, None, float(h), float(h + 1)) for m in ("RF", "XGB") for h in range(24)]
    forecasts = spark.createDataFrame(pairs, "plant_id string, model string, sample_idx long, horizon int, forecast_datetime timestamp_ntz, y_true double, y_pred double")
    settings = spark.createDataFrame(
        [("p", "RF", "all_weather", 72, 4, "level2", True, 15, 0.01, 1.23456, 0.98765, 7, 3, 0.001, 12)],
        "plant_id string, model string, weather_category string, lookback_hours int, past_days int, complexity string, use_pv boolean, "
        "epochs int, learning_rate double, train_time_sec double, inference_time_sec double, param_count int, best_epoch int, final_lr double, gpu_memory_used int",
    )
    got = {r["model"]: r.asDict() for r in R.season_hour_summary(forecasts, settings).collect()}
    told = dict(weather_level="all_weather", lookback_hours=72, past_days=4, complexity_level="2", use_pv=True, use_forecast=False, epochs=15, batch_size=0)
    told |= dict(learning_rate=0.01, train_time_sec=1.2346, inference_time_sec=0.9876, param_count=7, best_epoch=3, final_lr=0.001, gpu_memory_used=12)
    assert {k: got["RF"][k] for k in told} == told and len(got["RF"]) == 30
    blank = dict(weather_level="unknown", lookback_hours=24, past_days=1, complexity_level="unknown", use_pv=False, epochs=0, inference_time_sec=0.0)
    assert {k: got["XGB"][k] for k in blank} == blank and got["XGB"]["selected_weather_features"] == "[]"


def test_time_of_forecasts_reaches_the_records(spark, hourly):
    rows = [("a", date(2022, 1, 1) + timedelta(days=k), h, 20 + 5.0 * ((k * 7 + h) % 11), float((k * 7 + h) % 11), float((k * 5 + h) % 13)) for k in range(40) for h in range(24)]
    few = {"weather_category": "solar_irradiance_only"}
    experiments = [E.base_experiment("Linear", **few), E.base_experiment("Linear", sliding=True, name="sliding", **few)]
    experiments += [E.base_experiment("Linear", name="family", **few), E.base_experiment("XGB", complexity="low", params={"n_estimators": 2.0}, **few)]
    results = store(E.run_experiments(hourly(rows), [*experiments, E.Experiment("LSTM", "PV")]))
    got = {r["experiment_name"]: (r["status"], r["inference_time_sec"]) for r in results.collect()}
    assert len(got) == 5 and sorted(v[0] for v in got.values()) == ["FAILED"] + ["SUCCESS"] * 4
    assert all((seconds > 0) == (status == "SUCCESS") and seconds < 60 for status, seconds in got.values())
    kept = {r["experiment_name"]: r["inference_time_sec"] for r in R.summary_rows(results).collect()}
    assert kept == {k: v[1] for k, v in got.items()}
