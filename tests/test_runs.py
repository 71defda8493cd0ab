from pyspark.sql import functions as F

from noonward import constants as K
from noonward.functions import columns as C
from noonward.operators import sequences as E
from noonward.plans import grid as G
from noonward.plans import status as P


def plants(spark, *ids):
    return spark.createDataFrame([(i,) for i in ids], "plant_id string")


def results(spark, rows):
    return spark.createDataFrame(rows, "plant_id string, experiment_name string, status string")


def test_grid_has_284_distinct_experiments(spark):
    grid = G.experiment_grid(plants(spark, "1"))
    assert grid.count() == K.GRID_SIZE == grid.select("experiment_name").distinct().count()
    counts = {r["family"]: r["n_experiments"] for r in G.count_by_family(grid).collect()}
    assert counts == {"deep": 160, "tree": 120, "linear": 4, "all": 284}


def test_grid_names(spark):
    names = {r[0] for r in G.experiment_grid(plants(spark, "1")).select("experiment_name").collect()}
    assert {"LSTM_low_PV_24h_TE", "RF_high_PV+NWP+_72h_noTE", "XGB_low_NWP+_TE", "Linear_NWP_noTE"} <= names
    row = G.experiment_grid(plants(spark, "7")).filter("experiment_name = 'Linear_NWP_TE'").select(G.save_path()).first()
    assert row[0] == "7_results/Linear_NWP_TE"


def test_resume(spark):
    work = G.experiment_grid(plants(spark, "1", "2")).select("plant_id", "experiment_name")
    done = results(spark, [("1", "Linear_NWP_TE", "SUCCESS"), ("1", "Linear_NWP_noTE", "FAILED"), ("2", "RF_low_NWP_TE", None)])
    left = {tuple(r) for r in G.pending(work, done).collect()}
    assert len(left) == 2 * K.GRID_SIZE - 2 and ("1", "Linear_NWP_noTE") in left
    assert G.pending(work, done, any_status=True).count() == 2 * K.GRID_SIZE - 3
    assert G.pending(work, work.withColumn("status", F.lit("SUCCESS"))).count() == 0


def test_status_counts(spark):
    all_done = [("1", f"e{i}", "SUCCESS") for i in range(K.GRID_SIZE)]
    rows = results(spark, all_done + [("2", "a", "SUCCESS"), ("2", "b", "FAILED"), ("3", "a", "FAILED"), ("5", "x", None)])
    status = P.plant_status(plants(spark, "1", "2", "3", "4", "5"), rows)
    got = {r["plant_id"]: (r["status"], r["completed"], r["remaining"]) for r in status.collect()}
    assert got == {
        "1": ("COMPLETE", 284, 0), "2": ("IN_PROGRESS", 1, 283), "3": ("NOT_STARTED", 0, 284),
        "4": ("NOT_STARTED", 0, 284), "5": ("IN_PROGRESS", 1, 283),
    }
    fleet = P.fleet_status(status).first()
    assert fleet["hours_left"] == (2 + 2 * 0.5) * 2.5 and fleet["total"] == 5 * 284 and fleet["completed"] == 286
    assert [r["plant_id"] for r in G.pending_plants(plants(spark, "1", "2"), rows).collect()] == ["2"]
    assert [r["plant_id"] for r in P.in_progress(status).collect()] == ["2", "5"]


def test_unreadable_results(spark):
    rows = results(spark, [("1", "a", "SUCCESS"), ("2", "a", "SUCCESS")])
    broken = spark.createDataFrame([("2", "bad file")], "plant_id string, error string")
    status = P.plant_status(plants(spark, "1", "2"), rows, broken)
    got = {r["plant_id"]: (r["status"], r["completed"], r["error"]) for r in status.collect()}
    assert got == {"1": ("IN_PROGRESS", 1, None), "2": ("ERROR", 0, "bad file")}
    assert P.fleet_status(status).first()["n_error"] == 1


def test_batches_and_waiting_list(spark):
    ids = [f"{i:03d}" for i in range(60)] + ["1000", "10"]
    status = P.plant_status(plants(spark, *ids), results(spark, []))
    got = sorted((r["place"], r["plant_id"], r["batch"], r["skip"]) for r in P.batches(status).collect())
    assert [g[1] for g in got] == sorted(ids) and [g[0] for g in got] == list(range(62))
    assert got[25][2:] == (1, 25) and got[61][2:] == (2, 50)
    head = P.not_started_head(status).collect()
    assert [r["plant_id"] for r in head] == sorted(ids)[:20] and head[0]["more"] == 42


def test_remaining_time(spark):
    done = spark.createDataFrame([("1", 3600.0), ("1", 3600.0), ("2", 7200.0)], "plant_id string, train_time_sec double")
    got = P.remaining_time(done, plants(spark, "1", "2", "3")).first()
    assert tuple(got) == (4.0, 2, 1, 2.0, 6.0)


def test_run_summary(spark):
    runs = spark.sql(
        "select * from values ('a', 'SUCCESS', timestamp'2024-01-01 00:00:00', timestamp'2024-01-01 00:03:00'),"
        "('a', 'FAILED', timestamp'2024-01-01 00:00:00', timestamp'2024-01-01 01:00:00') t(study, status, started, ended)"
    )
    assert tuple(P.run_summary(runs).first()) == ("a", 1, 1, 3.0)


def test_scenario_labels(spark):
    rows = [(*flags, name) for name, flags in K.SCENARIOS.items()] + [(False, True, False, True, "Unknown")]
    table = spark.createDataFrame(rows, "a boolean, b boolean, c boolean, d boolean, want string")
    assert all(r[0] == r[1] for r in table.select("want", C.scenario_label("a", "b", "c", "d")).collect())


def test_finite_and_clip(spark):
    rows = spark.createDataFrame([(None,), (float("nan"),), (float("inf"),), (float("-inf"),), (2.5,)], "x double")
    assert [r[0] for r in rows.select(C.finite("x")).collect()] == [0.0, 0.0, 1.0, -1.0, 2.5]
    wide = spark.createDataFrame([(-3.0,), (50.0,), (120.0,)], "x double")
    assert [r[0] for r in wide.select(C.clip_percent(F.col("x"))).collect()] == [0.0, 50.0, 100.0]


def test_seasons(spark):
    got = [r[0] for r in spark.range(1, 13).select(C.season_of(F.col("id"))).collect()]
    assert got == ["Winter"] * 2 + ["Spring"] * 3 + ["Summer"] * 3 + ["Fall"] * 3 + ["Winter"]


def test_ranks(spark):
    rows = spark.createDataFrame([("Transformer",), ("Linear",), ("Mine",)], "model string")
    assert [r[0] for r in rows.select(C.model_rank()).collect()] == [8, 1, 9]


def test_recorded_ids(spark):
    schema = "model string, use_pv boolean, use_hist_weather boolean, use_forecast boolean, weather_category string, use_time_encoding boolean, past_days int, model_complexity string"
    rows = spark.createDataFrame(
        [("RF", True, False, True, "all_weather", True, 3, "low"), ("Linear", False, False, True, "none", False, 0, None)], schema
    )
    got = [r[0] for r in rows.select(C.recorded_experiment_id({c: c for c in rows.columns})).collect()]
    assert got == ["RF_pvtrue_histfalse_fcsttrue_all_weather_time_days3_complow", "Linear_pvfalse_histfalse_fcsttrue_none_notime_nohist"]


def test_presets_and_allowed_parameters(spark):
    grid = G.add_presets(G.vary(G.study_grid(plants(spark, "1")).drop("complexity"), "complexity", K.COMPLEXITY_LEVELS))
    rows = {(r["model"], r["complexity"]): r for r in grid.withColumn("kept", G.keep_allowed("params")).collect()}
    assert rows["LGBM", "mid_low"]["params"]["n_estimators"] == 20.0
    assert set(rows["RF", "low"]["kept"]) == {"n_estimators", "max_depth", "random_state"}
    assert rows["TCN", "mid_high"]["tcn_channels"] == [14, 28] and rows["GRU", "mid_low"]["params"]["epochs"] == 35.0
    assert rows["Linear", "high"]["params"] is None


def epochs(spark, losses):
    rows = [("p", "r", i + 1, 0.0, v, 2.0) for i, v in enumerate(losses)]
    return spark.createDataFrame(rows, "plant_id string, experiment_name string, epoch int, train_loss double, val_loss double, epoch_time double")


def test_best_epoch_is_the_first_of_equals(spark):
    assert E.best_epochs(epochs(spark, [3.0, 1.0, 2.0, 1.0])).first()["best_epoch"] == 2


def test_early_stop(spark):
    stop = lambda losses: E.early_stops(epochs(spark, losses)).first()["stop_epoch"]
    assert stop([1.0] + [0.9995] * 20) == 11
    assert stop([1.0 - 0.01 * i for i in range(20)]) == 20
    assert stop([1.0] * 5 + [0.5] + [0.6] * 30) == 16


def test_learning_rate_schedule(spark):
    final = lambda losses: E.final_rates(epochs(spark, losses)).first()["final_lr"]
    assert final([1.0] * 6) == 0.001
    assert final([1.0] * 7) == 0.0005
    assert final([1.0] * 13) == 0.00025
    assert final([1.0 / (i + 1) for i in range(20)]) == 0.001


def test_cumulative_time(spark):
    got = E.cumulative_time(epochs(spark, [1.0, 1.0, 1.0])).orderBy("epoch").collect()
    assert [r["cum_time"] for r in got] == [2.0, 4.0, 6.0]


def test_sequence_features(spark):
    assert E.dilated_offsets(3, 2) == [1, 2, 4] and E.dilated_offsets(2, 3) == [1, 2, 4]
    waves = spark.range(2).select(E.position_waves("id", 4)).collect()
    assert waves[0][0] == [0.0, 1.0, 0.0, 1.0]
    assert abs(waves[1][0][2] - 0.00999983) < 1e-7


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_a_grid_is_not_broadcast(spark, tmp_path):
    plants(spark, "1", "2").write.parquet(str(tmp_path / "plants"))
    stored = spark.read.parquet(str(tmp_path / "plants"))  # the estimate of a stored table goes by its bytes
    grid = G.experiment_grid(stored).select("plant_id", "experiment_name", "model")
    done = grid.filter("model = 'RF'").withColumn("status", F.lit("SUCCESS"))
    left = G.pending(grid, done)
    assert "BroadcastHashJoin" not in _plan(left) and left.count() == 2 * (K.GRID_SIZE - 40)
    assert "BroadcastHashJoin" not in _plan(G.pending(grid, done, any_status=True))


def test_known_rows_are_not_broadcast(spark, tmp_path):
    from noonward.sinks.tables import append_new

    plants(spark, "1", "2").write.parquet(str(tmp_path / "plants"))
    grid = G.experiment_grid(spark.read.parquet(str(tmp_path / "plants"))).select("plant_id", "experiment_name", "lookback_hours")
    both = append_new(grid.filter("plant_id = '1'"), grid, ["plant_id", "experiment_name"], "lookback_hours")
    assert "BroadcastHashJoin" not in _plan(both) and both.count() == 2 * K.GRID_SIZE


def test_a_grid_is_made_in_many_tasks(spark):
    few = plants(spark, *map(str, range(200))).coalesce(1)
    parts = G.experiment_grid(few).groupBy(F.spark_partition_id().alias("p")).agg(F.count_distinct("plant_id").alias("n")).collect()
    assert len(parts) == 4 and sum(r["n"] for r in parts) == 200
