import random
from datetime import date, datetime, timedelta

import numpy as np
import pytest
from hours import full_days
from pyspark.sql import functions as F

from noonward import constants as K
from noonward.operators import gram as M
from noonward.operators import lagged as G
from noonward.operators import linear as L
from noonward.operators import splits as S
from noonward.operators import windows as W
from noonward.operators.trees import fit_trees, save_models, tree_model
from noonward.plans import experiments as E
from noonward.plans import studies as U
from noonward.session import cut_lineage
from noonward.sources.results import read_results


def driven(plant, seed, n=40, noise=0.0):
    """Days whose target follows the forecast."""
    rng = random.Random(seed)
    rows = []
    for k in range(n):
        for h in range(24):
            f = rng.random() * 10
            rows.append((plant, date(2022, 1, 1) + timedelta(days=k), h, 20 + 5 * f + noise * rng.random(), f, f))
    return rows


def samples_table(spark, plants=("a", "b"), n=60, d=5, seed=1):
    rng = np.random.default_rng(seed)
    rows = []
    for p in plants:
        x = rng.random((n, d))
        y = x @ rng.random((d, 24)) + rng.random(24) + 0.05 * rng.random((n, 24))
        for i in range(n):
            part = "train" if i < 0.8 * n else "val" if i < 0.9 * n else "test"
            day = date(2022, 1, 1) + timedelta(days=i)
            rows.append((p, "e", i, day, datetime(day.year, day.month, day.day, 23), part, x[i].tolist(), y[i].tolist(), (y[i] * 50).tolist(), 0.0, 50.0))
    schema = "plant_id string, experiment_name string, sample_idx long, date date, end_dt timestamp_ntz, part string, features array<double>, y array<double>, y_true array<double>, lo double, hi double"
    return spark.createDataFrame(rows, schema), rows


def by_hand(rows, plant):
    own = [r for r in rows if r[0] == plant]
    x = np.array([[1.0, *r[6]] for r in own if r[5] == "train"])
    y = np.array([r[7] for r in own if r[5] == "train"])
    w = np.linalg.lstsq(x, y, rcond=None)[0]
    return {r[2]: np.array([1.0, *r[6]]) @ w for r in own if r[5] == "test"}


@pytest.mark.parametrize("fit", [L.fit_daily, L.fit_hourly])
def test_linear_fit_per_plant(spark, fit):
    table, rows = samples_table(spark)
    got = fit(table.repartition(5)).collect()
    assert len(got) == 12 and all(r["error"] is None and r["param_count"] == 5 for r in got)
    for r in got:
        assert np.allclose(r["y_pred"], by_hand(rows, r["plant_id"])[r["sample_idx"]], atol=1e-8)


def test_linear_fit_with_more_features_than_samples(spark):
    table, rows = samples_table(spark, plants=("a",), n=20, d=40)
    own = [r for r in rows]
    x = np.array([r[6] for r in own if r[5] == "train"])
    y = np.array([r[7] for r in own if r[5] == "train"])
    w = np.linalg.pinv(x - x.mean(0)) @ (y - y.mean(0))
    for r in L.fit_daily(table).collect():
        features = np.array(next(o[6] for o in own if o[2] == r["sample_idx"]))
        assert np.allclose(r["y_pred"], (features - x.mean(0)) @ w + y.mean(0), atol=1e-8)


def test_group_without_training_rows_fails_alone(spark):
    table, _ = samples_table(spark)
    broken = table.filter("plant_id = 'a' or part = 'test'")
    got = L.fit_daily(broken).collect()
    assert {r["plant_id"] for r in got if r["error"]} == {"b"} and sum(r["error"] is None for r in got) == 6


def test_one_feature_fit(spark):
    rows = spark.createDataFrame([("a", 1.0, 3.0), ("a", 2.0, 5.0), ("b", 4.0, 1.0), ("b", 4.0, 3.0)], "k string, x double, y double")
    got = {r["k"]: (r["slope"], r["intercept"]) for r in L.fit_one_feature(rows, ["k"], "x", "y").collect()}
    assert got["a"] == pytest.approx((2.0, 1.0)) and got["b"] == (0.0, 2.0)


def test_linear_experiments_of_all_plants(spark, hourly):
    hours = hourly(driven("a", 1) + driven("b", 2) + full_days("short", "2022-01-01", 1))
    results = E.run_experiments(hours, [E.base_experiment("Linear"), E.base_experiment("Linear", shuffle=False, name="seq")])
    rows = {(r["plant_id"], r["experiment_name"]): r for r in results.collect()}
    assert len(rows) == 6
    for p in ("a", "b"):
        ok = rows[p, "seq"]
        assert ok["status"] == "SUCCESS" and ok["r2"] > 0.99 and ok["test_samples"] == 24 * 5 and ok["param_count"] == 24
        assert ok["scenario"] == "NWP" and ok["error"] is None and ok["nrmse"] >= 0
    bad = rows["short", "seq"]
    assert bad["status"] == "FAILED" and bad["scenario"] == "FAILED" and bad["mae"] is None and bad["test_samples"] == 0
    assert "valid samples" in bad["error"]


def test_resumed_run_does_only_what_is_left(spark, hourly):
    hours = hourly(driven("a", 1, n=15) + driven("b", 2, n=15))
    experiments = [E.base_experiment("Linear", name="x"), E.base_experiment("Linear", name="y", shuffle=False)]
    known = spark.createDataFrame(
        [("a", "x", "SUCCESS"), ("b", "x", "FAILED"), ("a", "y", "SUCCESS"), ("b", "y", "SUCCESS")],
        "plant_id string, experiment_name string, status string",
    )
    got = [(r["plant_id"], r["experiment_name"], r["status"]) for r in E.run_pending(hours, experiments, known).collect()]
    assert got == [("b", "x", "SUCCESS")]
    assert E.run_pending(hours, experiments, known.withColumn("status", F.lit("SUCCESS"))) is None


def test_a_broken_run_goes_on_where_it_ended(spark, hourly, tmp_path, monkeypatch):
    hours, path = hourly(driven("a", 1) + driven("b", 2)), str(tmp_path / "results")
    grid = [E.base_experiment("Linear", weather_category="solar_irradiance_only", time_encoding=te, name=f"te{te}") for te in (True, False)]
    real, ran = E.run_fits, []

    def breaking(hours, experiments, *args, **kwargs):
        ran.append([e.name for e in experiments])
        if len(ran) == 2:
            raise RuntimeError("lost")
        return real(hours, experiments, *args, **kwargs)

    monkeypatch.setattr(E, "run_fits", breaking)
    with pytest.raises(RuntimeError):
        E.run_saving(hours, grid, path)
    assert {r["experiment_name"] for r in spark.read.parquet(path).collect()} == {"teTrue"}
    E.run_saving(hours, grid, path)
    assert ran == [["teTrue"], ["teFalse"], ["teFalse"]]
    rows = spark.read.parquet(path).collect()
    assert len(rows) == 4 and {r["status"] for r in rows} == {"SUCCESS"}


def test_sums_over_neighbours_are_those_of_the_samples():
    rng = np.random.default_rng(4)
    for shape in (G.Shape(2, 3, 5, 4), G.Shape(0, 2, 0, 6), G.Shape(1, 0, 3, 2), G.Shape(0, 1, 0, 1)):
        hours = rng.random((200, shape.hist + shape.fcst + 1))
        starts = np.arange(shape.past, 200 - shape.future + 1)
        want = G.sums_of_samples(hours, starts, shape)
        assert np.allclose(G.sums_of_range(hours, starts[0], starts[-1] + 1, shape), want, atol=1e-10)
        x = G.stretched(hours, starts, shape)
        assert x.shape[1] == shape.width + shape.future and np.allclose(want[1:, 1:], x.T @ x)
        for trains in (starts < 150, rng.random(len(starts)) < 0.8, rng.random(len(starts)) < 0.2, (starts < 60) | (starts > 90)):
            got = G.training_sums(hours, starts, trains, shape)
            assert np.allclose(got, G.sums_of_samples(hours, starts[trains], shape), atol=1e-9)


@pytest.mark.parametrize("shuffle, scenario, past", [(True, "PV+NWP", 30), (False, "PV+NWP", 30), (True, "NWP", 0), (False, "PV", 24)])
def test_sliding_fit_without_windows_equals_that_of_windows(hourly, monkeypatch, shuffle, scenario, past):
    monkeypatch.setattr(G, "BLOCK_HOURS", 200)
    hours = hourly(driven("a", 3, n=40) + driven("b", 4, n=36) + full_days("short", "2022-01-01", 1))
    e = E.Experiment("Linear", scenario, lookback_hours=past, sliding=True, shuffle=shuffle)
    prepared = E.prepare_for(hours, [e])[e.sample_key]
    keys = ["plant_id", "sample_idx"]
    got = E.sliding_fit(prepared, e).orderBy(*keys).toPandas()
    want = L.fit_hourly(E._named(E.samples_of(prepared, e), e)).orderBy(*keys).toPandas()
    same = [*keys, "experiment_name", "date", "end_dt", "lo", "hi", "param_count", "error"]
    assert got[same].equals(want[same]) and len(got) > 100
    assert np.abs(np.vstack(got["y_pred"]) - np.vstack(want["y_pred"])).max() < 1e-8
    assert (np.vstack(got["y_true"]) == np.vstack(want["y_true"])).all()


def test_least_norm_of_singular_equations():
    rng = np.random.default_rng(2)
    x = rng.random((40, 6))
    y = rng.random((40, 2))
    for columns in ([0, 1, 2, 3], [0, 1, 1, 2], [0, 1, 2]):
        own = np.hstack([x[:, columns], np.zeros((40, 1))])
        assert np.allclose(L.least_norm(own.T @ own, own.T @ y), np.linalg.pinv(own) @ y, atol=1e-8)


def test_sliding_linear_experiment(spark, hourly):
    hours = hourly(driven("a", 3, n=20))
    experiments = [E.base_experiment("Linear", sliding=True, shuffle=s, name=str(s)) for s in (True, False)]
    fits = E.run_fits(hours, experiments)
    n = 20 * 24 - 23
    n_test = n - int(n * 0.8) - int(n * 0.1)
    last = E.forecasts_of(fits, experiments).filter("experiment_name = 'False'").orderBy(F.desc("forecast_datetime"), "sample_idx")
    row = last.first()
    assert (row["forecast_datetime"], row["horizon"], row["sample_idx"]) == (datetime(2022, 1, 20, 23), 23, n - 1)
    assert {r["experiment_name"]: r["count"] for r in fits.groupBy("experiment_name").count().collect()} == {"True": n_test, "False": n_test}
    assert all(r["r2"] > 0.99 for r in E.results_of(hours.select("plant_id").distinct(), fits, experiments).collect())


def test_shared_preparation_gives_the_same_samples(hourly):
    rows = [r if i % 97 else (*r[:5], None) for i, r in enumerate(driven("a", 5, n=15))]
    hours = hourly(rows)
    choices = [E.Experiment("RF", s, lookback_hours=h, time_encoding=t, shuffle=False) for s, h, t in
               [("PV", 24, True), ("PV+HW", 48, False), ("PV+NWP", 24, False), ("NWP", 0, True), ("NWP+", 0, False)]]
    together = E.prepare_for(hours, choices)
    for e in choices:
        alone = E.samples_of(E.prepare_for(hours, [e])[e.sample_key], e).orderBy("sample_idx").collect()
        shared = E.samples_of(together[e.sample_key], e).orderBy("sample_idx").collect()
        assert alone == shared and alone


def test_runs_follow_each_plants_settings(spark, hourly):
    hours = hourly(driven("a", 1, n=60) + driven("b", 2, n=60) + driven("c", 3, n=60))
    settings = spark.createDataFrame(
        [("a", "2022-01-11", None, None, None), ("b", None, "2022-02-10", 0.6, None), ("c", None, None, None, "solar_irradiance_only")],
        "plant_id string, start_date string, end_date string, train_ratio double, weather_category string",
    )
    linear = E.base_experiment("Linear", weather_category="solar_irradiance_only", shuffle=False)
    rows = {r["plant_id"]: r for r in E.run_experiments(hours, [linear], settings=settings).collect()}
    plain = {r["plant_id"]: r for r in E.run_experiments(hours, [linear]).collect()}
    assert {r["status"] for r in rows.values()} == {"SUCCESS"}
    assert rows["a"]["test_samples"] < plain["a"]["test_samples"] < rows["b"]["test_samples"]
    assert rows["c"]["test_samples"] == plain["c"]["test_samples"]
    insisting = E.base_experiment("Linear", weather_category="solar_irradiance_only", shuffle=False, insists=("train_ratio", "end"))
    again = {r["plant_id"]: r for r in E.run_experiments(hours, [insisting], settings=settings).collect()}
    assert again["b"]["test_samples"] == plain["b"]["test_samples"]


def test_levels_from_one_pass_equal_fits_one_by_one(spark, hourly, monkeypatch):
    hours = hourly(driven("a", 1, n=90, noise=4.0) + driven("b", 2, n=20, noise=4.0) + full_days("c", "2022-01-01", 2))
    other, weather = K.HIGH[1], K.IRRADIANCE[0]
    named = hours.withColumn(other + K.FORECAST_SUFFIX, F.col(weather + K.FORECAST_SUFFIX) * F.rand(3) + F.col("Hour"))
    missing = (F.col("plant_id") == "b") & (F.col("date") == "2022-01-07") & (F.col("Hour") == 5)
    named = named.withColumn(other + K.FORECAST_SUFFIX, F.when(~missing, F.col(other + K.FORECAST_SUFFIX)))
    tiers = [E.base_experiment("Linear", weather_category=w, time_encoding=t, train_ratio=r, shuffle=s, name=f"{w}-{t}-{r}-{s}")
             for w, t, r, s in [("solar_irradiance_only", False, 0.8, True), ("high_weather", False, 0.8, True), ("high_weather", True, 0.3, True),
                                ("solar_irradiance_only", False, 0.6, False), ("solar_irradiance_only", False, 0.2, False)]]
    assert sorted(map(len, E.families(tiers, named))) == [2, 3]
    keys = ["plant_id", "experiment_name", "sample_idx"]
    together = E.run_fits(named, tiers).orderBy(*keys).toPandas()
    monkeypatch.setattr(E, "families", lambda *a: [])
    apart = E.run_fits(named, tiers).orderBy(*keys).toPandas()
    same = [*keys, "date", "end_dt", "param_count", "error"]
    assert together[same].equals(apart[same])
    good = together["error"].isna()
    assert good.sum() > 100 and np.abs(np.vstack(together["y_pred"][good]) - np.vstack(apart["y_pred"][good])).max() < 1e-7
    counts = together[good].groupby(["plant_id", "experiment_name"]).size()
    assert counts["b", "solar_irradiance_only-False-0.8-True"] >= counts["b", "high_weather-False-0.8-True"]


def test_sums_by_rank_merge_by_addition(spark, hourly):
    hours = hourly(driven("a", 1, n=30))
    e = E.base_experiment("Linear", weather_category="solar_irradiance_only")
    prepared = E.prepare_for(hours, [e])[e.sample_key]
    samples = E.flat_samples(W.daily_samples(prepared, 0, split=S.daily_rank(F.lit(True))), "rank", "n_samples")
    table = M.sums_by_rank(samples, [0.2, 0.5, 0.8])
    rows = sorted(samples.collect(), key=lambda r: r["rank"])
    assert [r["rank"] for r in rows] == list(range(len(rows)))
    z = np.array([[1.0, *r["features"], *r["y"]] for r in rows])
    for share in (0.2, 0.5, 0.8):
        n = int(len(rows) * share)
        got = M.first_ranges(table, share).first()
        assert got["n"] == n and np.allclose(np.reshape(got["sums"], (49, 49)), z[:n].T @ z[:n])


SETTINGS = "plant_id string, start_date string, end_date string, train_ratio double, weather_category string"


def test_a_resumed_run_gives_the_rows_of_a_whole_one_with_settings(spark, hourly, tmp_path):
    hours, path = hourly(driven("a", 1, n=30) + driven("b", 2, n=30, noise=3.0)), str(tmp_path / "results")
    settings = spark.createDataFrame([("a", "2022-01-05", None, 0.7, None), ("b", None, "2022-01-28", None, "solar_irradiance_only")], SETTINGS)
    grid = [E.base_experiment("Linear", weather_category="solar_irradiance_only", time_encoding=te, name=f"te{te}") for te in (True, False)]
    shown = ["plant_id", "experiment_name", "mae", "rmse", "test_samples", "status", "settings_key"]
    rows = lambda df: sorted(map(tuple, df.select(*shown).collect()))
    whole = rows(E.run_experiments(hours, grid, settings=settings))
    E.run_saving(hours, grid[:1], path, settings=settings)
    E.run_saving(hours, grid, path, settings=settings)
    saved = read_results(spark, path)
    assert rows(saved) == whole and len(whole) == 4
    assert E.run_pending(hours, grid, saved, settings=settings) is None
    changed = settings.withColumn("end_date", F.when(F.col("plant_id") == "a", "2022-01-25").otherwise(F.col("end_date")))
    left = E.run_pending(hours, grid, saved, settings=changed)
    assert rows(left) == [r for r in rows(E.run_experiments(hours, grid, settings=changed)) if r[0] == "a"]
    E.run_saving(hours, grid, path, settings=changed)
    assert read_results(spark, path).count() == 6


def test_fingerprints_follow_what_decides_a_result(spark, hourly):
    plants = spark.createDataFrame([("a",)], "plant_id string")
    key = lambda e, s=None: E._settings(plants, [e], s).first()["settings_key"]
    own = lambda **c: spark.createDataFrame([("a", c.get("start"), None, c.get("train"), None)], SETTINGS)
    base = E.base_experiment("Linear")
    assert key(base) == key(base, own()) == key(E.base_experiment("Linear", name="other"), own(train=0.8))
    assert len({key(base), key(base, own(train=0.6)), key(base, own(start="2022-02-01")), key(E.base_experiment("Linear", order="mt19937"))}) == 4
    assert key(E.base_experiment("Linear", insists=("train_ratio",)), own(train=0.6)) == key(base)


def test_a_plants_own_tree_parameters_are_used(spark, hourly, monkeypatch):
    hours = hourly(driven("a", 1, n=12) + driven("b", 2, n=12))
    seen, real = [], E.fit_trees

    def watching(samples, model, params, *args, **kwargs):
        seen.append((sorted(r[0] for r in samples.select("plant_id").distinct().collect()), params["n_estimators"], params["max_depth"]))
        return real(samples, model, params, range(1))

    monkeypatch.setattr(E, "fit_trees", watching)
    settings = spark.createDataFrame([("a", {"low": {"n_estimators": 2.0}}), ("b", None)], "plant_id string, ml_params map<string,map<string,double>>")
    e = E.base_experiment("RF", weather_category="solar_irradiance_only", complexity="low")
    fits = [E.run_fits(rows, free, settings=own) for own, rows, free in E.by_settings(hours, [e], hours.select("plant_id").distinct(), settings)]
    trees, depth, _ = K.TREE_PRESETS["low"]
    assert sorted(seen) == [(["a"], 2.0, float(depth)), (["b"], float(trees), float(depth))] and len(fits) == 2


def test_a_study_follows_each_plants_settings(spark, hourly):
    hours = hourly(driven("a", 1, n=60) + driven("b", 2, n=60))
    settings = spark.createDataFrame([("a", "2022-01-21", None, None, "solar_irradiance_only"), ("b", None, None, 0.5, "solar_irradiance_only")], SETTINGS)
    scores, _ = U.run_study(hours, "training_scale", ["Linear"], settings)
    plain, _ = U.run_study(hours, "training_scale", ["Linear"])
    size = lambda df: {(r["plant_id"], r["training_scale"]): r["test_samples"] for r in df.collect()}
    got, want = size(scores), size(plain)
    assert all(got["b", level] == n for (plant, level), n in want.items() if plant == "b")  # the study's own shares
    assert all(got["a", level] < n for (plant, level), n in want.items() if plant == "a")


def test_grid_experiments():
    assert len(E.linear_grid()) == 4 and sum(len(E.tree_grid(m)) for m in K.TREE_MODELS) == 120
    assert {e.experiment_name for e in E.linear_grid()} == {"Linear_NWP_TE", "Linear_NWP_noTE", "Linear_NWP+_TE", "Linear_NWP+_noTE"}
    assert E.tree_grid("RF")[0].experiment_name == "RF_low_PV_24h_TE"


def test_failures_become_rows(spark, hourly):
    experiments = [E.Experiment("LSTM", "PV"), E.base_experiment("RF", weather_category="solar_irradiance_only")]
    results = E.run_experiments(hourly(full_days("a", "2022-01-01", 3)), experiments).collect()
    got = {r["model"]: r for r in results}
    assert {r["status"] for r in results} == {"FAILED"} and len(results) == 2
    assert got["LSTM"]["error"] == "no trainer for model LSTM" and got["RF"]["error"]
    only = E.run_experiments(hourly(full_days("a", "2022-01-01", 3)), experiments[:1]).collect()
    assert [r["status"] for r in only] == ["FAILED"]


def test_unknown_names_are_errors():
    with pytest.raises(ValueError):
        tree_model("GBM", {})
    with pytest.raises(ValueError):
        U.study_experiments("weekday")


def test_tree_parameters():
    xgb = tree_model("XGB", {"n_estimators": 7.0, "max_depth": 2.0, "learning_rate": 0.3, "random_state": 9.0})
    assert (xgb.getMaxIter(), xgb.getMaxDepth(), xgb.getStepSize(), xgb.getSeed()) == (7, 2, 0.3, K.RANDOM_SEED)
    lgbm = tree_model("LGBM", {"n_estimators": 7.0, "random_state": 9.0})
    assert lgbm.getSeed() == 9 and lgbm.getMinInstancesPerNode() == 20
    rf = tree_model("RF", {"n_estimators": 4.0, "learning_rate": 0.3})
    assert rf.getNumTrees() == 4


@pytest.mark.parametrize("model", ["RF", "XGB"])
def test_trees_beat_the_training_mean(spark, tmp_path, model):
    table, rows = samples_table(spark, n=80, d=3)
    samples = cut_lineage(table)
    forecast, fitted = fit_trees(samples, model, {"n_estimators": 5.0, "max_depth": 3.0, "learning_rate": 0.5}, range(3))
    got = forecast.collect()
    mean = np.mean([r[7][:3] for r in rows if r[5] == "train"], axis=0)
    ours = np.mean([np.abs(np.array(r["y_pred"]) - r["y"][:3]).mean() for r in got])
    assert len(got) == 16 and ours < np.mean([np.abs(mean - r["y"][:3]).mean() for r in got])
    save_models(fitted[:1], str(tmp_path / "m"))
    assert (tmp_path / "m" / "hour_00" / "metadata").exists()


def test_plants_of_opposite_behaviour_both_beat_their_mean(spark):
    table, _ = samples_table(spark, n=80, d=1)
    up = F.transform("y", lambda v: v * 0 + F.col("features")[0])
    down = F.transform("y", lambda v: v * 0 + 1 - F.col("features")[0])
    samples = cut_lineage(table.withColumn("y", F.when(F.col("plant_id") == "a", up).otherwise(down)))
    forecast, _ = fit_trees(samples, "RF", {"n_estimators": 5.0, "max_depth": 4.0}, range(1))
    rows = forecast.select("plant_id", F.abs(F.col("y_pred")[0] - F.col("y")[0]).alias("off"), F.col("y")[0].alias("y")).collect()
    mean = {r[0]: r[1] for r in samples.filter("part = 'train'").groupBy("plant_id").agg(F.avg(F.col("y")[0])).collect()}
    for plant in "ab":
        own = [r for r in rows if r["plant_id"] == plant]
        assert np.mean([r["off"] for r in own]) < 0.5 * np.mean([abs(r["y"] - mean[plant]) for r in own])


def test_study_lists():
    models = K.TREE_MODELS + ["Linear"]
    sizes = {s: len(U.study_experiments(s, models)) for s in K.STUDIES.values()}
    assert sizes == {
        "seasonal_effect": 4, "hourly_effect": 4, "weather_feature_adoption": 16, "lookback_window": 12,
        "model_complexity": 12, "training_scale": 16, "no_shuffle": 4, "dataset_extension": 4,
    }
    assert all(e.tags["level"] for e in U.study_experiments("training_scale"))
    names = [e.experiment_name for s in K.STUDIES.values() for e in U.study_experiments(s)]
    assert len(names) == len(set(names))


@pytest.mark.parametrize("study, dimension, levels", [
    ("seasonal_effect", "season", {"Winter"}),
    ("hourly_effect", "hour", set(range(24))),
    ("weather_feature_adoption", "feature_tier", {"SI", "H", "H+M", "H+M+L"}),
    ("training_scale", "training_scale", {"Low", "Medium", "High", "Full"}),
    ("no_shuffle", None, None),
    ("dataset_extension", None, None),
])
def test_studies_with_the_linear_model(spark, hourly, tmp_path, study, dimension, levels):
    hours = hourly(driven("a", 1, noise=5.0) + driven("b", 2, noise=5.0))
    scores, totals = U.run_study(hours, study, ["Linear"])
    rows = totals.collect()
    assert all(r["n_plants"] == 2 and r["mae_std"] is not None and r["train_time_mean"] is not None for r in rows)
    if dimension:
        assert {r[dimension] for r in rows} == levels
    if study == "dataset_extension":
        n = 40 * 24 - 23
        assert rows[0]["avg_windows"] == n - int(n * 0.8) - int(n * 0.1)
        assert {r["window_type"] for r in scores.collect()} == {"hourly_sliding"}
    U.save_study(study, scores, totals, str(tmp_path))
    made = {p.name for p in (tmp_path / study).iterdir()}
    pivots = {f"pivot_{m}" for m in ("mae", "rmse", "r2", "nrmse", "train_time")} if dimension else set()
    assert made == {"detailed", "aggregated"} | pivots


def test_study_runner_logs_failures(spark, hourly, tmp_path, monkeypatch):
    hours = hourly(driven("a", 1))
    real = U.run_study

    def broken(h, study, models):
        if study == "hourly_effect":
            raise RuntimeError("lost")
        return real(h, study, models)

    monkeypatch.setattr(U, "run_study", broken)
    log = U.run_studies(hours, str(tmp_path), [7, 2, 99], ["Linear"])
    assert {r["study"]: (r["status"], r["error"]) for r in log.collect()} == {
        "no_shuffle": ("SUCCESS", None),
        "hourly_effect": ("FAILED", "lost"),
    }


def test_bucketed_hours_are_not_moved_again(spark, hourly, tmp_path):
    from noonward.operators.prepare import plan_features, prepare, scaled_hours
    from noonward.sinks.tables import save_hours

    kept = save_hours(hourly(driven("a", 1, n=10)), "hours_by_day", str(tmp_path / "hours"), 4)
    plan = plan_features("PV+NWP", "solar_irradiance_only", True)
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        scaled = scaled_hours(prepare(kept, plan))
        text = scaled._jdf.queryExecution().executedPlan().toString()
        moved = [line for line in text.splitlines() if "Exchange hashpartitioning" in line and "Reused" not in line]
        assert "Bucketed: true" in text
        # only the day tables move: to plants for the lag, back to days, to plants for the spine, back to days
        assert len(moved) <= 4
        assert scaled.count() == 240
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
        spark.sql("drop table hours_by_day")


def test_user_changes():
    made = E.modified(["RF", "Linear"], lambda e: E.replace(e, weather_category="high_weather"))
    assert {e.weather_category for e in made} == {"high_weather"} and [e.lookback_hours for e in made] == [24, 0]
