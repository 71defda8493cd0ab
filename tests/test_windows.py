import random
from datetime import date, timedelta

import numpy as np
import pytest
from hours import full_days
from pyspark.sql import Window
from pyspark.sql import functions as F

from noonward import constants as K
from noonward.operators import splits as S
from noonward.operators import timeline as T
from noonward.operators import windows as W
from noonward.operators.prepare import FeaturePlan, prepare

WEATHER = K.IRRADIANCE[0]
AHEAD = WEATHER + K.FORECAST_SUFFIX
PLAN = FeaturePlan([K.TARGET], [AHEAD], False)


def ragged(seed, plants=3, days=40):
    """Plants with missing days and missing hours."""
    rng = random.Random(seed)
    rows = []
    for p in range(plants):
        for k in range(days):
            if rng.random() < 0.1:
                continue
            lost = rng.randrange(24) if rng.random() < 0.15 else None
            for h in range(24):
                if h != lost:
                    v = round(rng.random() * 100, 3)
                    rows.append((str(p), date(2022, 1, 1) + timedelta(days=k), h, v, v * 2, v * 3))
    return rows


def expected_daily(rows, past_days):
    """Day-by-day construction in plain Python."""
    out = {}
    for plant in {r[0] for r in rows}:
        by_day = {}
        for r in rows:
            if r[0] == plant:
                by_day.setdefault(r[1], []).append(r)
        days = sorted(by_day)
        for k in range(past_days + 1, len(days)):
            chosen = days[k - past_days : k + 1]
            if all(len(by_day[d]) == 24 for d in chosen):
                hist = [[r[3]] for d in chosen[:-1] for r in sorted(by_day[d], key=lambda r: r[2])]
                target = sorted(by_day[days[k]], key=lambda r: r[2])
                out[plant, days[k]] = (hist, [[r[5]] for r in target], [r[3] for r in target])
    return out


@pytest.mark.parametrize("past_days", [0, 1, 3])
@pytest.mark.parametrize("block", [128, 4])
def test_daily_samples_against_brute_force(hourly, monkeypatch, past_days, block):
    monkeypatch.setattr(T, "DAYS_PER_BLOCK", block)
    rows = ragged(past_days)
    samples = W.daily_samples(prepare(hourly(rows), PLAN), 24 * past_days, scaled=False).collect()
    got = {(r["plant_id"], r["date"]): (r["x_hist"], r["x_fcst"], r["y_true"]) for r in samples}
    want = expected_daily(rows, past_days)
    assert got == want and len(want) > 10
    for plant in {r["plant_id"] for r in samples}:
        own = sorted((r["date"], r["sample_idx"]) for r in samples if r["plant_id"] == plant)
        assert [i for _, i in own] == list(range(len(own)))
        assert {r["n_samples"] for r in samples if r["plant_id"] == plant} == {len(own)}


def test_missing_day_is_bridged_and_partial_day_is_not(hourly):
    days = full_days("1", "2022-01-01", 3) + full_days("1", "2022-01-10", 3)
    found = [r["date"].day for r in W.daily_samples(prepare(hourly(days), PLAN), 24).orderBy("date").collect()]
    assert found == [3, 10, 11, 12]
    partial = [d for d in days if not (d[1].day == 3 and d[2] == 12)]
    found = [r["date"].day for r in W.daily_samples(prepare(hourly(partial), PLAN), 24).orderBy("date").collect()]
    assert found == [11, 12]


def test_sample_count_of_complete_days(hourly):
    prepared = prepare(hourly(full_days("1", "2022-01-01", 12)), PLAN)
    assert [W.daily_samples(prepared, 24 * p).count() for p in (0, 1, 3, 7)] == [11, 10, 8, 4]


def test_a_day_with_25_rows_is_not_complete(hourly):
    days = full_days("1", "2022-01-01", 4)
    days.append((*days[30][:3], 1.0, 1.0, 1.0))
    assert [r["date"].day for r in W.daily_samples(prepare(hourly(days), PLAN), 0).orderBy("date").collect()] == [3, 4]


def test_forecast_only_has_blank_history(hourly):
    prepared = prepare(hourly(full_days("1", "2022-01-01", 4)), FeaturePlan([], [AHEAD], True))
    row = W.daily_samples(prepared, 24).first()
    assert row["x_hist"] == [[0.0]] * 24
    assert W.daily_samples(prepared, 0).first()["x_hist"] == []
    assert W.daily_samples(prepared, 24).count() == 2 and W.daily_samples(prepared, 0).count() == 3


@pytest.mark.parametrize("past, future, block", [(24, 24, 672), (24, 24, 7), (5, 3, 10), (0, 24, 50)])
def test_sliding_samples_against_brute_force(hourly, monkeypatch, past, future, block):
    monkeypatch.setattr(T, "HOURS_PER_BLOCK", block)
    rows = ragged(7, plants=2, days=8)
    got = {
        (r["plant_id"], r["sample_idx"]): (r["x_hist"], r["x_fcst"], r["y_true"], r["hours"], r["n_samples"])
        for r in W.sliding_samples(prepare(hourly(rows), PLAN), past, future, scaled=False).collect()
    }
    want = {}
    for plant in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == plant), key=lambda r: (r[1], r[2]))
        n = len(own) - past - future + 1
        for i in range(past, len(own) - future + 1):
            hist, ahead = own[i - past : i], own[i : i + future]
            want[plant, i - past] = (
                [[r[3]] for r in hist] if past else [[0.0]],
                [[r[5]] for r in ahead],
                [r[3] for r in ahead],
                [r[2] for r in ahead],
                n,
            )
    assert got == want


def test_positions_and_lags_match_one_big_window(hourly, monkeypatch):
    monkeypatch.setattr(T, "HOURS_PER_BLOCK", 11)
    rows = hourly(ragged(3))
    placed = T.add_position(rows, T.day_spine(rows))
    w = Window.partitionBy("plant_id").orderBy("dt")
    assert placed.filter(F.col("pos") != F.col("pos")).count() == 0
    checked = placed.withColumn("plain", F.row_number().over(w) - 1)
    assert checked.filter("pos <> plain").count() == 0
    lagged = T.values_before(rows.select(*T.DAY, "dt", K.TARGET), T.day_spine(rows), K.TARGET, [1, 2, 4, 30])
    both = lagged.select("*", *[F.lag(K.TARGET, n).over(w).alias(f"want{n}") for n in (1, 2, 4, 30)])
    wrong = [~F.col(f"{K.TARGET}_lag{n}").eqNullSafe(F.col(f"want{n}")) for n in (1, 2, 4, 30)]
    assert lagged.count() == rows.count()
    assert both.filter(wrong[0] | wrong[1] | wrong[2] | wrong[3]).count() == 0


def test_split_sizes(spark):
    rows = spark.range(1, 30).select(F.col("id").alias("n"), F.explode(F.sequence(F.lit(0), F.col("id") - 1)).alias("i"))
    parts = rows.groupBy("n").agg(
        *[F.count(F.when(S.part_of("i", "n") == p, 1)).alias(p) for p in ("train", "val", "test")],
        F.count(F.when(S.part_by_boundary("i", "n") == "val", 1)).alias("val2"),
    )
    for r in parts.collect():
        assert r["train"] == int(r["n"] * 0.8) and r["val"] == int(r["n"] * 0.1)
        assert r["test"] == r["n"] - r["train"] - r["val"]
        assert r["val2"] == int(r["n"] * (0.8 + 0.1)) - r["train"]


def test_shuffled_parts_are_whole_and_repeatable(hourly):
    prepared = prepare(hourly(full_days("1", "2022-01-01", 32)), PLAN)
    split = S.daily_part(shuffle=True)
    once = {r["sample_idx"]: r["part"] for r in W.daily_samples(prepared, 24, split=split).collect()}
    again = {r["sample_idx"]: r["part"] for r in W.daily_samples(prepared, 24, split=split).collect()}
    assert once == again and sorted(once) == list(range(30))
    sizes = [list(once.values()).count(p) for p in ("train", "val", "test")]
    assert sizes == [24, 3, 3]
    plain = {r["sample_idx"]: r["part"] for r in W.daily_samples(prepared, 24, split=S.daily_part(False)).collect()}
    assert once != plain
    other = W.daily_samples(prepared, 24, split=S.daily_part(True, seed=7)).collect()
    assert {r["sample_idx"]: r["part"] for r in other} != once


# What NumPy's generator draws under seed 42.
DRAWN = {5: [1, 4, 2, 0, 3], 10: [8, 1, 5, 0, 7, 2, 9, 4, 3, 6], 12: [10, 9, 0, 8, 5, 2, 1, 11, 4, 7, 3, 6]}


def test_permutations_are_those_of_the_generator(spark):
    sizes = spark.createDataFrame([(42, n) for n in [*DRAWN, 10, 0]], "seed int, n_samples int")
    rows = S.permutations(sizes).collect()
    assert len(rows) == sum(DRAWN)
    for n, order in DRAWN.items():
        own = sorted((r["rank"], r["sample_idx"]) for r in rows if r["n_samples"] == n)
        assert [i for _, i in own] == order


def test_parts_by_the_generators_permutation(spark, hourly):
    rows = [r for plant, n in (("a", 11), ("b", 13), ("c", 6)) for r in full_days(plant, "2022-01-01", n)]
    prepared = prepare(hourly(rows), PLAN)
    split = S.daily_part(shuffle=True, order="mt19937")
    got = {(r["plant_id"], r["sample_idx"]): (r["n_samples"], r["part"]) for r in W.daily_samples(prepared, 0, split=split).collect()}
    assert {n for n, _ in got.values()} == set(DRAWN)
    for (_, i), (n, part) in got.items():
        at = DRAWN[n].index(i)
        assert part == ("train" if at < int(n * 0.8) else "val" if at < int(n * 0.8) + int(n * 0.1) else "test")
    hourly_rows = W.sliding_samples(prepared, 0, split=S.hourly_part(shuffle=True, order="mt19937")).filter("plant_id = 'c'").collect()
    n = 6 * 24 - 23
    order = np.random.RandomState(42).permutation(n)
    assert {r["sample_idx"] for r in hourly_rows if r["part"] == "train"} == set(order[: int(n * 0.8)].tolist())
    with pytest.raises(ValueError):
        S.daily_part(True, order="other")


def test_shuffled_hours_match_one_big_window(hourly):
    prepared = prepare(hourly(full_days("1", "2022-01-01", 6) + full_days("2", "2022-01-01", 4)), PLAN)
    samples = W.sliding_samples(prepared, 24, split=S.hourly_part(shuffle=True))
    w = Window.partitionBy("plant_id").orderBy(S.shuffle_key(K.RANDOM_SEED))
    ranked = samples.withColumn("_r", F.row_number().over(w) - 1)
    assert ranked.filter(F.col("part") != S.part_of("_r", "n_samples")).count() == 0
    assert samples.count() == 6 * 24 - 47 + 4 * 24 - 47


def test_flatten_goes_hour_by_hour(hourly):
    prepared = prepare(hourly(full_days("1", "2022-01-01", 3)), FeaturePlan([K.TARGET, WEATHER], [AHEAD], False))
    row = W.daily_samples(prepared, 24, scaled=False).select(W.flatten_sample().alias("x")).first()["x"]
    assert row[:4] == [24.0, 48.0, 25.0, 50.0] and row[48:50] == [48.0 * 3, 49.0 * 3] and len(row) == 72


def test_no_samples(hourly):
    assert W.daily_samples(prepare(hourly(full_days("1", "2022-01-01", 2)), PLAN), 72).count() == 0
    assert W.daily_samples(prepare(hourly([]), PLAN), 24).count() == 0
