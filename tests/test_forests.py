from datetime import date, datetime, timedelta

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import DecisionTreeRegressor
from pyspark.sql import functions as F

from noonward import constants as K
from noonward.operators import forests as T
from noonward.operators.trees import with_plant_behaviour
from noonward.plans import experiments as E
from noonward.plans import studies as U
from noonward.session import store


def samples_table(spark, plants=("a", "b"), n=120, d=4, hours=3, seed=1, levels=12):
    """Features on a grid of few values, targets that follow them."""
    rng = np.random.default_rng(seed)
    rows = []
    for p in plants:
        x = rng.integers(0, levels, (n, d)) / levels
        y = np.sin(3 * x @ rng.random((d, hours))) + 0.05 * rng.random((n, hours))
        for i in range(n):
            part = "train" if i < 0.8 * n else "test"
            day = date(2022, 1, 1) + timedelta(days=i)
            end = datetime(day.year, day.month, day.day, 23)
            rows.append((p, i, day, end, part, x[i].tolist(), y[i].tolist(), y[i].tolist(), 0.0, 1.0))
    schema = "plant_id string, sample_idx long, date date, end_dt timestamp_ntz, part string, features array<double>, y array<double>, y_true array<double>, lo double, hi double"
    return store(spark.createDataFrame(rows, schema))


def by_key(rows, column="y_pred"):
    return {(r["plant_id"], r["sample_idx"]): np.array(r[column]) for r in rows.collect()}


def plain_tree(x, y, depth, smallest, ridge):
    """A tree of least squares by trying every split, as a function of a sample."""

    def score(v):
        return v.sum() ** 2 / (len(v) + ridge)

    best = (1e-9, None, None)
    if depth:
        for f in range(x.shape[1]):
            for v in np.unique(x[:, f])[:-1]:
                left = x[:, f] <= v
                if min(left.sum(), (~left).sum()) >= smallest:
                    gain = score(y[left]) + score(y[~left]) - score(y)
                    if gain > best[0] + 1e-9:
                        best = gain, f, v
    if best[1] is None:
        return lambda row, value=y.sum() / (len(y) + ridge): value
    _, f, v = best
    left = x[:, f] <= v
    low = plain_tree(x[left], y[left], depth - 1, smallest, ridge)
    high = plain_tree(x[~left], y[~left], depth - 1, smallest, ridge)
    return lambda row: low(row) if row[f] <= v else high(row)


@pytest.mark.parametrize("depth", [1, 3, 5])
def test_one_tree_without_draws_is_that_of_mllib(spark, depth):
    samples = samples_table(spark)
    forest = T.fit_forest(samples, "RF", {"n_estimators": 1.0, "max_depth": float(depth)}, range(3), bootstrap=False)
    got = by_key(T.score(samples, forest))
    table = with_plant_behaviour(samples).withColumn("_v", array_to_vector("_x"))
    for h in range(3):
        tree = DecisionTreeRegressor(featuresCol="_v", labelCol="_label", predictionCol="_p", maxDepth=depth, maxBins=64)
        fitted = tree.fit(table.filter("part = 'train'").withColumn("_label", F.col("y")[h]))
        wanted = by_key(fitted.transform(table.filter("part = 'test'")), "_p")
        assert wanted.keys() == got.keys()
        off = [abs(got[k][h] - wanted[k]) for k in wanted]
        assert np.median(off) < 1e-5 and np.mean(np.array(off) < 1e-5) >= 0.9  # ties may fall to another feature


@pytest.mark.parametrize("model, smallest, ridge", [("XGB", 1, 1.0), ("LGBM", 20, 0.0)])
def test_boosted_trees_are_those_of_all_splits_tried(spark, model, smallest, ridge):
    samples = samples_table(spark, plants=("a",), hours=2)
    params = {"n_estimators": 12.0, "max_depth": 2.0, "learning_rate": 0.3}  # more rounds than between two rewrites
    got = by_key(T.score(samples, T.fit_forest(samples, model, params, range(2))))
    rows = T._ready(samples).collect()
    train, test = [r for r in rows if r["part"] == "train"], [r for r in rows if r["part"] == "test"]
    x = np.array([r["_x"] for r in train])
    for h in range(2):
        y = np.array([r["y"][h] for r in train])
        guess, left = {r["sample_idx"]: y.mean() for r in test}, y - y.mean()
        for _ in range(12):
            tree = plain_tree(x, left, 2, smallest, ridge)
            left = left - 0.3 * np.array([tree(v) for v in x])
            for r in test:
                guess[r["sample_idx"]] += 0.3 * tree(r["_x"])
        assert max(abs(got["a", i][h] - v) for i, v in guess.items()) < 1e-4


def test_partitioning_does_not_change_the_trees(spark):
    samples = samples_table(spark)
    params = {"n_estimators": 4.0, "max_depth": 3.0}
    texts = set()
    for parts in (1, 3, 7):
        moved = store(samples.repartition(parts, "sample_idx"))
        texts.add(T.fit_forest(moved, "RF", params, range(2)).to_json())
    assert len(texts) == 1


def test_small_blocks_of_sums_give_the_same_trees(spark, monkeypatch):
    samples = samples_table(spark)
    params = {"n_estimators": 3.0, "max_depth": 3.0}
    whole = T.fit_forest(samples, "RF", params, range(2)).to_json()
    monkeypatch.setattr(T, "SUMS_BYTES", 1)
    assert T.fit_forest(samples, "RF", params, range(2), parallelism=2).to_json() == whole


def test_draws_are_poisson_and_differ_by_tree():
    ids = np.random.default_rng(0).integers(-(2**63), 2**63 - 1, 50_000)
    w, other = T.weights(ids, 0, 42), T.weights(ids, 1, 42)
    assert abs(w.mean() - 1) < 0.02 and abs(w.var() - 1) < 0.03 and abs(np.corrcoef(w, other)[0, 1]) < 0.02
    assert (T.weights(ids[::-1], 0, 42)[::-1] == w).all()


def test_best_first_keeps_the_highest_gains():
    tree = T.Trees.blank([0], [0], 3)
    tree.feature[0, 1:8] = 0
    tree.gain[0, 1:8] = [9, 1, 5, 8, 2, 4, 3]  # node 4 is good but lies below node 2, the worst
    assert np.flatnonzero(T.best_first(tree, 4).feature[0] >= 0).tolist() == [1, 3, 6]
    assert np.flatnonzero(T.best_first(tree, 5).feature[0] >= 0).tolist() == [1, 3, 6, 7]
    assert np.flatnonzero(T.best_first(tree, 6).feature[0] >= 0).tolist() == [1, 2, 3, 6, 7]
    assert (T.best_first(tree, 31).feature == tree.feature).all()


def test_forests_beat_the_mean_and_come_back_from_the_registry(spark, tmp_path, monkeypatch):
    samples, params = samples_table(spark, n=200), {"n_estimators": 8.0, "max_depth": 4.0}
    forecast, forest = T.fit_trees(samples, "RF", params, range(3), registry=str(tmp_path / "r"))
    got = forecast.collect()
    mean = np.mean([r["y"] for r in samples.filter("part = 'train'").collect()], axis=0)
    assert np.mean([np.abs(r["y_pred"] - np.array(r["y"])) for r in got]) < 0.7 * np.mean([np.abs(mean - r["y"]) for r in got])
    fits = []
    real = T.fit_forest
    monkeypatch.setattr(T, "fit_forest", lambda *a, **k: fits.append(1) or real(*a, **k))
    again, same = T.fit_trees(store(samples.repartition(5)), "RF", params | {"verbosity": 1.0}, range(3), registry=str(tmp_path / "r"))
    assert not fits and same.to_json() == forest.to_json()
    assert all((by_key(again)[k] == v).all() for k, v in by_key(forecast).items())
    T.fit_trees(samples, "RF", params | {"max_depth": 2.0}, range(3), registry=str(tmp_path / "r"))
    more = store(samples.withColumn("y", F.transform("y", lambda v: v + 1)))
    T.fit_trees(more, "RF", params, range(3), registry=str(tmp_path / "r"))
    assert len(fits) == 2


def test_odd_values_and_no_training(spark):
    samples = samples_table(spark)
    odd = samples.withColumn(
        "features", F.when(F.col("sample_idx") % 7 == 0, F.array(F.lit(None).cast("double"), F.lit(float("nan")), F.lit(float("inf")), F.lit(0.5))).otherwise(F.col("features"))
    )
    forecast, _ = T.fit_trees(store(odd), "XGB", {"n_estimators": 2.0, "max_depth": 2.0}, range(3))
    assert all(np.isfinite(r["y_pred"]).all() for r in forecast.collect())
    flat = store(samples.withColumn("y", F.transform("y", lambda v: v * 0 + 2.0)))
    assert all(np.allclose(r["y_pred"], 2.0) for r in T.fit_trees(flat, "LGBM", {"n_estimators": 2.0}, range(3))[0].collect())
    with pytest.raises(ValueError):
        T.fit_trees(store(samples.filter("part = 'test'")), "RF", {}, range(1))
    with pytest.raises(ValueError):
        T.fit_trees(samples, "GBM", {}, range(1))


def test_study_of_complexity_on_trained_trees(spark, hourly):
    rng = np.random.default_rng(5)
    rows = []
    for plant in "ab":
        for k in range(60):
            for h in range(24):
                ahead = float(rng.random() * 10)
                rows.append((plant, date(2022, 1, 1) + timedelta(days=k), h, 20 + 5 * ahead, ahead, ahead))
    scores, totals = U.run_study(hourly(rows), "model_complexity", ["RF", "Linear"])
    got = {r["complexity"]: r for r in totals.collect()}
    assert set(got) == set(K.COMPLEXITY_LEVELS) and {r["model"] for r in got.values()} == {"RF"}
    assert all(r["n_plants"] == 2 and r["mae_std"] is not None for r in got.values())
    assert got["high"]["mae_mean"] < got["mid_low"]["mae_mean"] < got["low"]["mae_mean"]
    assert {r["test_samples"] for r in scores.collect()} == {24 * (58 - int(58 * 0.8) - int(58 * 0.1))}


def test_experiments_take_trees_from_their_registry(spark, hourly, tmp_path, monkeypatch):
    rows = [("a", date(2022, 1, 1) + timedelta(days=k), h, 20 + 5.0 * ((k * 7 + h) % 11), float((k * 7 + h) % 11), float((k * 7 + h) % 11)) for k in range(30) for h in range(24)]
    e = E.base_experiment("RF", weather_category="solar_irradiance_only", complexity="low", registry=str(tmp_path / "r"))
    fits, real = [], T.fit_forest
    monkeypatch.setattr(T, "fit_forest", lambda *a, **k: fits.append(1) or real(*a, **k))
    first, again = [E.run_experiments(hourly(rows), [e]).drop("train_time_sec", "inference_time_sec").collect() for _ in range(2)]
    assert len(fits) == 1 and first == again and first[0]["status"] == "SUCCESS"


def test_tasks_that_send_sums_follow_the_cores(spark):
    cores = spark.sparkContext.defaultParallelism
    table = spark.range(1000).repartition(16 * cores)
    assert T._few(table, 8).rdd.getNumPartitions() == -(-2 * cores // 8)
    assert T._few(table, 1).rdd.getNumPartitions() == cores


def test_sums_side_by_side_are_exact():
    rng = np.random.default_rng(3)
    for rows, top in ((500, 1 << 24), (4096, 1 << 24), (4096, 1 << 36)):
        w, ws = rng.integers(1, 5, rows).astype(float), rng.integers(-top, top, rows).astype(float)
        at = rng.integers(0, 40, (rows, 3))
        n, s = T._both(at.ravel(), w, ws, 3, 40)
        for cell in range(40):
            hit = (at == cell).sum(axis=1)
            assert n[cell] == (w * hit).sum() and s[cell] == (ws * hit).sum()
