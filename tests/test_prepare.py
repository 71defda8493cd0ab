from datetime import date

import pytest
from hours import full_days
from pyspark.sql import functions as F

from noonward import constants as K
from noonward.operators import timeline as T
from noonward.operators.prepare import (
    FeaturePlan,
    keep_dated,
    plan_features,
    prepare,
    scaled_hours,
    scaler_table,
    unscale,
)

WEATHER = K.IRRADIANCE[0]
AHEAD = WEATHER + K.FORECAST_SUFFIX


def test_end_date_is_midnight(hourly):
    rows = keep_dated(hourly(full_days("1", "2022-01-01", 3)), "2022-01-01", "2022-01-02")
    assert rows.count() == 25
    assert rows.filter(F.col("date") == F.lit(date(2022, 1, 2))).select("Hour").first()[0] == 0


def test_dates_are_optional(hourly):
    rows = hourly(full_days("1", "2021-12-31", 2))
    assert keep_dated(rows, None, None).count() == 48
    assert keep_dated(rows).count() == 24


def test_missing_target_dropped(hourly):
    days = full_days("1", "2022-01-01", 1)
    days[5] = (*days[5][:3], None, 0.0, 0.0)
    assert keep_dated(hourly(days)).count() == 23


def test_lag_crosses_days_and_starts_at_zero(hourly):
    days = full_days("1", "2022-01-01", 1) + full_days("1", "2022-01-05", 1, lambda d, h: 500.0 + h)
    prepared = prepare(hourly(days), FeaturePlan([K.LAG_FEATURE], [], False))
    got = {r["dt"]: r[K.LAG_FEATURE] for r in prepared.hours.collect()}
    lags = [got[k] for k in sorted(got)]
    assert lags == [0.0] + [float(h) for h in range(24)] + [500.0 + h for h in range(23)]


def test_rows_without_forecast_still_feed_the_lag(hourly):
    days = full_days("1", "2022-01-01", 1)
    days[7] = (*days[7][:5], None)
    prepared = prepare(hourly(days), FeaturePlan([K.LAG_FEATURE], [AHEAD], False))
    rows = {r["Hour"]: r[K.LAG_FEATURE] for r in prepared.hours.collect()}
    assert 7 not in rows and rows[8] == 7.0
    spine = prepared.spine.first()
    assert spine["n_rows"] == 23 and not spine["complete"]
    assert (spine[f"lo_{K.LAG_FEATURE}"], spine[f"hi_{K.LAG_FEATURE}"]) == (0.0, 22.0)


def test_lag_of_two_plants_do_not_mix(hourly):
    days = full_days("1", "2022-01-01", 2) + full_days("2", "2022-01-01", 2, lambda d, h: -1.0)
    rows = T.previous_value(hourly(days), K.TARGET, "p").filter("plant_id = '2'").collect()
    assert sorted((r["p"] is None, r["p"]) for r in rows)[-1] == (True, None)
    assert {r["p"] for r in rows} == {None, -1.0}


def test_scaled_values_and_constant_feature(hourly):
    days = [(p, d, h, t, 4.0, f) for p, d, h, t, _, f in full_days("1", "2022-01-01", 2)]
    prepared = prepare(hourly(days), FeaturePlan([WEATHER], [AHEAD], False))
    rows = scaled_hours(prepared).orderBy("dt").collect()
    assert {r[WEATHER] for r in rows} == {0.0}
    assert rows[0][AHEAD] == 0.0 and rows[-1][AHEAD] == 1.0
    assert all(0.0 <= r[K.TARGET] <= 1.0 for r in rows)


def test_unscale_reverses_scale(spark):
    row = spark.range(1).select(unscale(F.lit(0.25), F.lit(-2.0), F.lit(6.0)).alias("v")).first()
    assert row["v"] == 0.0


def test_gaps_of_history_become_zero(hourly):
    days = full_days("1", "2022-01-01", 1, lambda d, h: 5.0)
    days[3] = (*days[3][:4], None, 15.0)
    rows = prepare(hourly(days), FeaturePlan([WEATHER], [AHEAD], False)).hours
    assert {r[WEATHER] for r in rows.collect()} == {10.0, 0.0}


def test_scaler_table(hourly):
    rows = scaler_table(hourly(full_days("1", "2022-01-01", 1)), [K.TARGET, WEATHER]).collect()
    assert {(r["feature"], r["lo"], r["hi"], r["constant"]) for r in rows} == {
        (K.TARGET, 0.0, 23.0, False),
        (WEATHER, 0.0, 46.0, False),
    }


def test_plan_features():
    plan = plan_features("PV+HW", "high_weather", True)
    assert plan.hist == [K.LAG_FEATURE, *K.HIGH, *K.TIME_FEATURES] and plan.fcst == []
    plan = plan_features("NWP", "solar_irradiance_only", True)
    assert plan.fcst == [AHEAD, *K.TIME_FEATURES] and plan.hist == K.TIME_FEATURES and plan.forecast_only
    assert plan_features("NWP+", "solar_irradiance_only", False).fcst == [WEATHER]
    assert plan_features("PV", "none", False).hist == [K.LAG_FEATURE]
    assert plan_features("PV+NWP", "all_weather", False, available=[AHEAD]).fcst == [AHEAD]
    assert not plan_features("NWP", no_hist_power=False).forecast_only
    assert len(plan_features("PV+NWP", "all_weather", False).fcst) == 11


def test_unknown_names_are_errors():
    with pytest.raises(ValueError):
        plan_features("PV", "irradiance")
    with pytest.raises(ValueError):
        plan_features("HW")
