import os
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from noonward import constants as K
from noonward.functions.columns import plant_id_from_file, plant_id_simple
from noonward.plans.reports import ABLATION_KEY
from noonward.session import cut_lineage, shared_folder
from noonward.sinks import tables as S
from noonward.sources import configs as C
from noonward.sources import hourly as H
from noonward.sources import results as R

HEADER = "Year,Month,Day,Hour,Capacity Factor,global_tilted_irradiance,global_tilted_irradiance_pred\n"


def write(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text, encoding="utf-8")


def test_read_hourly_files(spark, tmp_path):
    write(tmp_path / "Project7.csv", "﻿" + HEADER + "2022,1,1,0,1.5,10,11\n2022,1,1,1,,NaN,12\n")
    write(tmp_path / "plant8.CSV", HEADER + "2023,12,31,23,2.5,20,21\n")
    write(tmp_path / "notes.txt", "not a plant")
    rows = H.read_hourly(spark, str(tmp_path)).orderBy("plant_id", "dt").collect()
    assert [(r["plant_id"], r["dt"], r[K.TARGET]) for r in rows] == [
        ("7", datetime(2022, 1, 1, 0), 1.5),
        ("7", datetime(2022, 1, 1, 1), None),
        ("8", datetime(2023, 12, 31, 23), 2.5),
    ]
    assert rows[1]["global_tilted_irradiance"] is None
    assert "snow_depth" not in rows[0].asDict()


def test_missing_time_column_is_an_error(spark, tmp_path):
    write(tmp_path / "1.csv", "Year,Month,Day,Capacity Factor\n2022,1,1,3\n")
    with pytest.raises(ValueError, match="Hour"):
        H.read_hourly(spark, str(tmp_path))
    loose = H.date_ranges(H.read_hourly(spark, str(tmp_path), strict=False)).first()
    assert tuple(loose) == ("1", K.DEFAULT_START, K.DEFAULT_END, 1)


def test_layouts_are_joined_by_name(spark, tmp_path):
    write(tmp_path / "a" / "1.csv", HEADER + "2022,1,1,0,1,2,3\n")
    write(tmp_path / "b" / "2.csv", "Hour,Year,Month,Day,snow_depth,Capacity Factor\n5,2022,1,1,9,4\n")
    both = H.union_layouts(H.read_hourly(spark, str(tmp_path / "a")), H.read_hourly(spark, str(tmp_path / "b")))
    got = {r["plant_id"]: r for r in both.collect()}
    assert got["2"]["Hour"] == 5 and got["2"]["snow_depth"] == 9.0 and got["1"]["snow_depth"] is None


def test_each_file_is_read_by_its_own_header(spark, tmp_path):
    write(tmp_path / "1.csv", HEADER + "2022,1,1,0,1.5,10,11\n")
    write(tmp_path / "2.csv", "global_tilted_irradiance,Year,Month,Day,Hour,extra,Capacity Factor\n10,2022.0,1,1,0,x,1.5\n")
    write(tmp_path / "3.csv", "Hour,Year,Month,Day,snow_depth,Capacity Factor\n5,2022,1,1,9,4\n\n")
    got = {r["plant_id"]: r for r in H.read_hourly(spark, str(tmp_path)).collect()}
    assert len(got) == 3
    for plant in ("1", "2"):
        assert (got[plant]["global_tilted_irradiance"], got[plant][K.TARGET], got[plant]["Year"]) == (10.0, 1.5, 2022)
    assert got["3"]["global_tilted_irradiance"] is None and got["3"]["snow_depth"] == 9.0


def test_one_pruned_scan_per_layout(spark, tmp_path):
    for plant in (1, 2, 3):
        write(tmp_path / f"a {plant}" / f"Project{plant}.csv", HEADER + f"2022,1,1,0,{plant},2,3\n" + HEADER + "2022,1,1,1,7,8,9\n")
    write(tmp_path / "b" / "[4].csv", "\n" + '"Hour",Year,Month,Day,note,"Capacity Factor"\n5,2022,1,1,"x, y",4\n  \n5,2022\n')
    write(tmp_path / "b" / "empty5.csv", "")
    rows = H.read_hourly(spark, str(tmp_path))
    got = sorted((r["plant_id"], str(r["dt"]), r[K.TARGET]) for r in rows.collect())
    first = [(str(p), f"2022-01-01 0{h}:00:00", float(t)) for p in (1, 2, 3) for h, t in ((0, p), (1, 7))]
    assert got == sorted([*first, ("[4]", "2022-01-01 05:00:00", 4.0), ("[4]", "None", None)])
    plan = rows.select("plant_id", K.TARGET)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan csv") == 2 and "Join" not in plan and "Exchange" not in plan
    assert "c6:string" not in plan  # not asked for


def test_no_files(spark, tmp_path):
    (tmp_path / "none").mkdir()
    assert H.read_hourly(spark, str(tmp_path / "none")).columns[:2] == ["plant_id", "Year"]


def test_bad_cells_do_not_end_the_reading(spark, tmp_path):
    write(tmp_path / "1.csv", HEADER + "2022,1,1,0,1,2,3\n")
    write(tmp_path / "2.csv", HEADER + "2022,2,30,0,1,2,3\n2022,2,1,0,oops,2,3\n")
    write(tmp_path / "3.csv", "Year,Month,Day,Capacity Factor\n2022,1,1,3\n")
    rows = H.read_hourly(spark, str(tmp_path), strict=False).filter("plant_id = '2'").orderBy(F.col("dt").asc_nulls_first())
    assert [(r["dt"], r[K.TARGET]) for r in rows.collect()] == [(None, 1.0), (datetime(2022, 2, 1), None)]
    bad = dict(map(tuple, H.unreadable_plants(spark, str(tmp_path)).collect()))
    assert bad == {"2": "no such time", "3": "missing columns: Hour"} or bad == {"2": "not a number", "3": "missing columns: Hour"}


def test_plant_ids(spark):
    names = ["Project7.csv", "plant8.CSV", "9.csv", "abc.csv", "dir/PLANT10_x.csv", "12abc.csv", "x.CSV"]
    rows = spark.createDataFrame([(n,) for n in names], "n string")
    got = [r[0] for r in rows.select(plant_id_from_file(F.col("n"))).collect()]
    assert got == ["7", "8", "9", "abc", "10", "12", "x"]
    assert rows.select(plant_id_simple("n")).first()[0] == "7"


def test_date_ranges(spark, tmp_path):
    write(tmp_path / "1.csv", HEADER + "2022,3,1,0,1,2,3\n2022,5,9,4,1,2,3\n")
    got = H.date_ranges(H.read_hourly(spark, str(tmp_path))).first()
    assert tuple(got) == ("1", "2022-03-01", "2022-05-09", 2)
    bare = spark.createDataFrame([("9", None)], "plant_id string, dt timestamp_ntz")
    assert tuple(H.date_ranges(bare).first()) == ("9", K.DEFAULT_START, K.DEFAULT_END, 1)


def test_source_files_and_latest(spark, tmp_path):
    write(tmp_path / "Project7.csv", HEADER)
    write(tmp_path / "Project7b.csv", HEADER)
    write(tmp_path / "8.CSV", HEADER)
    os.utime(tmp_path / "Project7.csv", (2e9, 2e9))
    files = H.source_files(spark, str(tmp_path))
    assert H.count_source_files(spark, str(tmp_path)) == 3
    latest = {r["plant_id"]: r["file_name"] for r in H.latest_files(files).collect()}
    assert latest == {"7": "Project7.csv", "8": "8.CSV"}
    (tmp_path / "none").mkdir()
    with pytest.raises(ValueError):
        H.count_source_files(spark, str(tmp_path / "none"))


def test_settings_overlay(spark, tmp_path):
    pytest.importorskip("yaml")
    write(tmp_path / "Plant1.yaml", "plant_id: '1'\ndata_path: d/1.csv\nstart_date: 2023-05-01\ntrain_ratio: 0.6\nshuffle_split: false\n")
    write(tmp_path / "Plant2.yaml", "plant_id: 2\nsave_options: {save_model: true}\nml_params: {low: {n_estimators: 5}}\n")
    write(tmp_path / "Plant3.yaml", "plant_id: [1\n")
    read = C.read_settings(spark, str(tmp_path))
    assert read.filter("error is not null").count() == 1
    rows = {r["plant_id"]: r for r in C.overlay(read.filter("error is null"), C.TEMPLATE).collect()}
    assert rows["1"]["train_ratio"] == 0.6 and rows["1"]["start_date"] == "2023-05-01" and not rows["1"]["shuffle_split"]
    assert rows["2"]["train_ratio"] == 0.8 and rows["2"]["end_date"] == K.DEFAULT_END and rows["2"]["past_hours"] == 24
    assert rows["2"]["save_options"] == {"save_model": True} and rows["2"]["ml_params"] == {"low": {"n_estimators": 5.0}}


def test_new_settings_skip_known_plants(spark):
    files = spark.createDataFrame([("1", "d\\1.csv"), ("2", "d/2.csv")], "plant_id string, data_path string")
    ranges = spark.createDataFrame([("1", "2022-02-02", "2022-03-03", 9)], "plant_id string, start_date string, end_date string, data_length long")
    known = spark.createDataFrame([("2",)], "plant_id string")
    made = C.new_settings(ranges, files, known).collect()
    assert len(made) == 1 and made[0]["data_path"] == "d/1.csv" and made[0]["start_date"] == "2022-02-02"
    assert made[0]["plant_name"] == "Project 1" and made[0]["random_seed"] == 42
    both = {r["plant_id"]: r for r in C.new_settings(ranges, files).collect()}
    assert both["2"]["start_date"] == K.DEFAULT_START


def test_check_settings(spark):
    plants = spark.createDataFrame(
        [("1", "a", "x", "y"), ("2", "b", "x", None), ("3", "c", "x", "y"), ("4", None, "x", "y")],
        "plant_id string, data_path string, start_date string, end_date string",
    )
    files = spark.createDataFrame([("a",), ("b",), ("a",)], "data_path string")
    checked = C.check_settings(plants, files)
    assert {r["plant_id"]: r["valid"] for r in checked.collect()} == {"1": True, "2": False, "3": False, "4": False}
    assert {r["valid"]: r["n_plants"] for r in C.count_valid(checked).collect()} == {True: 1, False: 3}


def test_choose_plants(spark):
    plants = spark.createDataFrame([(f"{i:02d}",) for i in range(10)], "plant_id string")
    ids = lambda df: [r[0] for r in df.collect()]
    assert ids(C.choose_plants(plants, skip=2, first=3)) == ["02", "03", "04"]
    assert ids(C.choose_plants(plants, skip=8)) == ["08", "09"]
    assert sorted(ids(C.choose_plants(plants, ids=["03", "07", "xx"], skip=5))) == ["03", "07"]


def test_results_append_and_read(spark, tmp_path):
    one = spark.createDataFrame([("1", "e1", 2.0, "SUCCESS")], "plant_id string, experiment_name string, mae double, status string")
    path = str(tmp_path / "results")
    S.append_results(one, path)
    S.append_results(one.withColumn("experiment_name", F.lit("e2")), path)
    got = R.read_results(spark, path)
    assert got.columns == R.RESULTS_COLUMNS and {r["experiment_name"] for r in got.collect()} == {"e1", "e2"}
    write(tmp_path / "old.csv", "plant_id,experiment_name,mae\n1,e3,4.5\n")
    old = R.read_results_csv(spark, str(tmp_path / "old.csv")).first()
    assert old["mae"] == 4.5 and old["status"] is None
    assert R.union_results(got, R.read_results_csv(spark, str(tmp_path / "old.csv"))).count() == 3


def test_result_files_of_different_layouts(spark, tmp_path):
    write(tmp_path / "r" / "a.csv", "plant_id,model,status,mae,best_epoch\n1,RF,SUCCESS,2.5,3.0\n")
    write(tmp_path / "r" / "b.csv", "mae,plant_id,model\n4.5,2,GBT\n")
    got = {r["plant_id"]: r for r in R.read_results_csv(spark, str(tmp_path / "r")).collect()}
    assert (got["1"]["model"], got["1"]["status"], got["1"]["mae"], got["1"]["best_epoch"]) == ("RF", "SUCCESS", 2.5, 3)
    assert (got["2"]["model"], got["2"]["status"], got["2"]["mae"]) == ("GBT", None, 4.5)


def ablation(spark, rows):
    schema = "model string, use_pv boolean, use_hist_weather boolean, use_forecast boolean, weather_category string, use_time_encoding boolean, past_days int, model_complexity string, mae double"
    return spark.createDataFrame([(m, True, False, True, "all_weather", False, d, c, x) for m, d, c, x in rows], schema)


def test_append_new_keeps_existing_rows(spark):
    old = ablation(spark, [("RF", 1, "low", 1.0), ("Linear", 0, None, 2.0)])
    new = ablation(spark, [("RF", 1, "low", 9.0), ("Linear", 0, None, 9.0), ("RF", 3, "low", 3.0), ("RF", 3, "low", 4.0)])
    got = S.append_new(old, new, ABLATION_KEY, "mae")
    assert sorted(r["mae"] for r in got.collect()) == [1.0, 2.0, 3.0]
    first = S.append_new(old.limit(0), new.withColumn("late", -F.col("mae")), ABLATION_KEY, "late")
    assert sorted(r["mae"] for r in first.collect()) == [4.0, 9.0, 9.0]
    assert S.append_new(got, new, ABLATION_KEY, "mae").count() == 3
    assert S.append_new(old.limit(0), new, ABLATION_KEY, "mae").count() == 3
    with pytest.raises(ValueError):
        S.append_new(old, new, ABLATION_KEY)


def test_the_same_append_twice_leaves_no_row_twice(spark, tmp_path):
    path, schema = str(tmp_path / "r"), "plant_id string, experiment_name string, mae double, status string"
    one = spark.createDataFrame([("1", "a", 2.0, "SUCCESS"), ("2", "a", None, "FAILED")], schema)
    two = spark.createDataFrame([("3", "a", 5.0, "SUCCESS")], schema)
    for rows in (one, two, one.repartition(3), two):
        S.append_results(rows, path)
    assert sorted(r["plant_id"] for r in R.read_results(spark, path).collect()) == ["1", "2", "3"]
    S.append_results(two.withColumn("mae", F.lit(6.0)), path, "named")
    S.append_results(two.withColumn("mae", F.lit(7.0)), path, "named")
    assert sorted(r["mae"] for r in R.read_results(spark, path).collect() if r["mae"]) == [2.0, 5.0, 7.0]
    assert {r["batch"] for r in R.read_batches(spark, path, batches=True).collect()} >= {"named"}


def test_an_append_that_breaks_leaves_nothing_and_can_be_repeated(spark, tmp_path):
    path = str(tmp_path / "r")
    rows = spark.range(40).select(F.col("id").cast("string").alias("plant_id"), F.lit("e").alias("experiment_name"), F.lit(1.0).alias("mae"))
    S.append_batch(rows.limit(3), path, "first")
    broken = rows.repartition(4).withColumn("mae", F.when(F.col("plant_id") == "37", F.raise_error(F.lit("lost"))).otherwise(F.col("mae")).cast("double"))
    with pytest.raises(Exception, match="lost"):
        S.append_batch(broken, path, "second")
    assert R.read_batches(spark, path).count() == 3
    for _ in range(2):
        S.append_batch(rows, path, "second")
    assert R.read_batches(spark, path).count() == 43


def test_rows_from_before_there_were_batches_stay(spark, tmp_path):
    path = str(tmp_path / "r")
    rows = spark.createDataFrame([("1", "a")], "plant_id string, experiment_name string")
    rows.write.parquet(path)
    S.append_results(rows.withColumn("plant_id", F.lit("2")), path)
    assert sorted(r["plant_id"] for r in R.read_results(spark, path).collect()) == ["1", "2"]


def test_only_new_keys_are_saved_and_again(spark, tmp_path):
    path = str(tmp_path / "t")
    make = lambda *rows: spark.createDataFrame(rows, "k string, at int, x double")
    first, second = make(("a", 1, 1.0), (None, 1, 2.0)), make(("a", 2, 9.0), ("b", 2, 3.0), ("b", 1, 4.0), (None, 3, 9.0))
    for rows in (first, second, first, second):
        S.save_new(rows, path, ["k"], "at")
    assert sorted((str(r["k"]), r["x"]) for r in R.read_batches(spark, path).collect()) == [("None", 2.0), ("a", 1.0), ("b", 4.0)]


def test_study_tables_are_ordered_by_model(spark, tmp_path):
    table = spark.createDataFrame([("TCN", 1.0), ("RF", 2.0), ("Linear", 3.0), ("Own", 4.0)], "model string, mae_mean double")
    S.save_study_table(table, str(tmp_path / "a"), "no_shuffle", "aggregated", str(tmp_path / "b"))
    for base in ("a", "b"):
        text = next((tmp_path / base / "no_shuffle" / "aggregated").glob("part-*.csv")).read_text().split()
        assert [line.split(",")[0] for line in text] == ["model", "Linear", "RF", "TCN", "Own"]


def test_checkpoint_folder_comes_from_the_session(spark, tmp_path):
    assert cut_lineage(spark.range(3)).count() == 3
    assert shared_folder(spark) != shared_folder(spark)


def test_other_tables_are_saved(spark, tmp_path):
    rows = spark.createDataFrame([("1", "e", 1)], "plant_id string, experiment_name string, epoch int")
    S.save_epoch_log(rows, str(tmp_path / "log"))
    S.save_epoch_log(rows, str(tmp_path / "log"))
    S.save_forecasts(rows, str(tmp_path / "forecasts"))
    S.save_status_report(rows, str(tmp_path / "status"))
    S.save_epoch_log(rows.withColumn("epoch", F.lit(2)), str(tmp_path / "log"))
    assert spark.read.parquet(str(tmp_path / "log")).count() == 2
    assert spark.read.parquet(str(tmp_path / "forecasts")).count() == 1
    assert spark.read.option("header", True).csv(str(tmp_path / "status")).columns == rows.columns
