"""Reading, cleaning, scaling, windows and splits."""

from pyspark.sql import functions as F

from noonward import constants as K
from noonward.functions.columns import (
    clip_percent,
    finite,
    half_even,
    plant_id_from_file,
    plant_id_simple,
    season_of,
)
from noonward.operators import splits as S
from noonward.operators import timeline as T
from noonward.operators import windows as W
from noonward.operators.prepare import (
    FeaturePlan,
    clean_features,
    encode_time,
    keep_dated,
    own_weather,
    plan_features,
    prepare,
    scaled_hours,
    scaler_table,
    unscale,
)
from noonward.plans import sql as Q
from noonward.plans.fixtures import dense_hours, gappy_hours, plants, stored_hours, table
from noonward.plans.registry import query
from noonward.session import shared_folder
from noonward.sources.hourly import FILE_TARGET, TIME_COLUMNS, date_ranges, read_hourly, with_stamp

FILE_NAMES = {
    "sql": """case s_suppkey % 5 when 0 then 'data/Project' || s_suppkey || '.csv'
                 when 1 then 'plant' || s_suppkey || '.CSV' when 2 then s_suppkey || '_hourly.csv'
                 when 3 then s_name || '.csv' else 'PROJECT' || s_suppkey || 'b.csv' end""",
}


def _file_names(spark, folder):
    key = F.col("s_suppkey")
    text = key.cast("string")
    return table(spark, folder, "supplier").select(
        F.when(key % 5 == 0, F.concat(F.lit("data/Project"), text, F.lit(".csv")))
        .when(key % 5 == 1, F.concat(F.lit("plant"), text, F.lit(".CSV")))
        .when(key % 5 == 2, F.concat(text, F.lit("_hourly.csv")))
        .when(key % 5 == 3, F.concat("s_name", F.lit(".csv")))
        .otherwise(F.concat(F.lit("PROJECT"), text, F.lit("b.csv")))
        .alias("file_name")
    )


@query(
    "src_hourly",
    Q.chain(Q.DENSE)
    + """select plant_id, year(date) as year, month(date) as month, day(date) as day, "Hour" as hour, dt, date, capacity_factor from dense""",
    text="date dt",
)
def src_hourly(spark, folder):
    cells = dense_hours(spark, folder).drop("dt", "date")
    rows = with_stamp(cells)
    return rows.select(
        "plant_id",
        *[F.col(c).cast("long").alias(c.lower()) for c in ("Year", "Month", "Day", "Hour")],
        "dt",
        "date",
        K.TARGET,
    )


@query(
    "src_csv_layouts",
    Q.chain(Q.DENSE) + "select plant_id, dt, capacity_factor, temperature_2m, global_tilted_irradiance from dense",
    text="dt",
)
def src_csv_layouts(spark, folder):
    """The hourly rows written as text in two layouts, a folder per plant, and read back by name."""
    cells = dense_hours(spark, folder).withColumn("plant", F.col("plant_id")).withColumnRenamed(K.TARGET, FILE_TARGET)
    weather = ["temperature_2m", "global_tilted_irradiance"]
    even = F.col("plant_id").cast("int") % 2 == 0
    base = shared_folder(spark)
    first = cells.filter(even).select("plant", *TIME_COLUMNS, FILE_TARGET, *weather)
    other = cells.filter(~even).withColumn("Year", F.col("Year").cast("double"))
    other = other.select("plant", *reversed(weather), "Hour", "Day", "Month", "Year", F.lit("x").alias("note"), FILE_TARGET)
    for name, rows in (("first", first), ("other", other)):
        rows.repartition("plant").write.partitionBy("plant").option("header", True).csv(f"{base}/{name}")
    read = read_hourly(spark, base, plant_id=F.regexp_extract("file_path", "plant=([^/]*)/", 1))
    return read.select("plant_id", "dt", K.TARGET, *weather)


@query(
    "src_all_plants",
    Q.chain(Q.DENSE)
    + f"select plant_id, count(*) as n_rows, {', '.join(f'sum({w}) as {w}' for w in K.WEATHER)} from dense group by plant_id",
)
def src_all_plants(spark, folder):
    return dense_hours(spark, folder).groupBy("plant_id").agg(
        F.count(F.lit(1)).alias("n_rows"), *[F.sum(w).alias(w) for w in K.WEATHER]
    )


@query(
    "src_plant_id",
    f"""with f as (select {FILE_NAMES['sql']} as file_name from supplier),
 b as (select file_name, regexp_extract(file_name, '([^/]*)$', 1) as base from f)
 select file_name, coalesce(nullif(regexp_extract(base, '(?i)(project|plant)(\\d+)', 2), ''),
   nullif(regexp_extract(base, '^(\\d+)', 1), ''), replace(replace(base, '.csv', ''), '.CSV', '')) as plant_id from b""",
)
def src_plant_id(spark, folder):
    return _file_names(spark, folder).select("file_name", plant_id_from_file(F.col("file_name")).alias("plant_id"))


@query(
    "src_plant_id_simple",
    f"""with f as (select {FILE_NAMES['sql']} as file_name from supplier)
 select file_name, replace(replace(file_name, 'Project', ''), '.csv', '') as plant_id from f""",
)
def src_plant_id_simple(spark, folder):
    return _file_names(spark, folder).select("file_name", plant_id_simple("file_name").alias("plant_id"))


@query(
    "date_range",
    Q.chain(Q.GAPPY)
    + """select plant_id, strftime(min(dt), '%Y-%m-%d') as start_date, strftime(max(dt), '%Y-%m-%d') as end_date,
  count(*) as data_length from gappy group by plant_id""",
)
def date_range(spark, folder):
    return date_ranges(gappy_hours(spark, folder))


@query(
    "prep_filter",
    Q.chain(Q.DENSE, Q.kept(start="2022-02-20", end="2024-07-17"))
    + 'select plant_id, dt, capacity_factor from kept',
    text="dt",
)
def prep_filter(spark, folder):
    return keep_dated(dense_hours(spark, folder), "2022-02-20", "2024-07-17").select("plant_id", "dt", K.TARGET)


#: Settings of the plants; some end later than the default.
_OWN_SQL = f"""{Q.PLANTS}, own as (select * replace (case when cast(plant_id as int) % 4 = 3 then '2031-01-01' else end_date end as end_date) from plants)"""


def _own_settings(spark, folder):
    late = F.col("plant_id").cast("int") % 4 == 3
    return plants(spark, folder).withColumn("end_date", F.when(late, "2031-01-01").otherwise(F.col("end_date")))


@query(
    "prep_filter_per_plant",
    Q.chain(Q.DENSE, _OWN_SQL)
    + f"""select plant_id, dt, capacity_factor from dense left join own using (plant_id) where capacity_factor is not null
  and dt >= cast(coalesce(start_date, '{K.DEFAULT_START}') as timestamp) and dt <= cast(coalesce(end_date, '{K.DEFAULT_END}') as timestamp)""",
    text="dt",
)
def prep_filter_per_plant(spark, folder):
    rows = keep_dated(dense_hours(spark, folder), settings=_own_settings(spark, folder))
    return rows.select("plant_id", "dt", K.TARGET)


@query(
    "tier_per_plant",
    Q.chain(Q.DENSE, _OWN_SQL)
    + "select plant_id, dt, cast(case coalesce(weather_category, 'all_weather') "
    + " ".join(f"when '{c}' then {len(names)}" for c, names in K.WEATHER_CATEGORIES.items())
    + " end as bigint) as n_features, case coalesce(weather_category, 'all_weather') "
    + " ".join(f"when '{c}' then {' + '.join(names) or '0'}" for c, names in K.WEATHER_CATEGORIES.items())
    + " end as total from dense left join own using (plant_id)",
    text="dt",
)
def tier_per_plant(spark, folder):
    rows = own_weather(dense_hours(spark, folder), _own_settings(spark, folder))
    given = F.filter(F.array(*K.WEATHER), lambda x: x.isNotNull())
    total = F.aggregate(given, F.lit(0.0), lambda a, x: a + x)
    return rows.select("plant_id", "dt", F.size(given).cast("long").alias("n_features"), total.alias("total"))


@query(
    "time_encoding",
    Q.chain(Q.DENSE)
    + "select plant_id, dt, "
    + ", ".join(f"round_even({e}, 6) + 0.0 as {n}" for n, e in Q.TIME.items())
    + " from dense",
    text="dt",
)
def time_encoding(spark, folder):
    rows = encode_time(dense_hours(spark, folder))
    return rows.select("plant_id", "dt", *[half_even(c, 6).alias(c) for c in K.TIME_FEATURES])


def _tier_sum(category):
    return sum((F.col(w) for w in K.WEATHER_CATEGORIES[category]), F.lit(0.0))


@query(
    "tier_projection",
    Q.chain(Q.DENSE)
    + " union all ".join(
        f"select plant_id, dt, '{t}' as feature_tier, cast({len(K.WEATHER_CATEGORIES[c])} as bigint) as n_features, "
        f"{' + '.join(K.WEATHER_CATEGORIES[c])} as total from dense"
        for t, c in K.FEATURE_TIERS.items()
    ),
    text="dt",
)
def tier_projection(spark, folder):
    tiers = [
        F.struct(
            F.lit(t).alias("feature_tier"),
            F.lit(len(K.WEATHER_CATEGORIES[c])).cast("long").alias("n_features"),
            _tier_sum(c).alias("total"),
        )
        for t, c in K.FEATURE_TIERS.items()
    ]
    return dense_hours(spark, folder).select("plant_id", "dt", F.explode(F.array(*tiers)).alias("t")).select(
        "plant_id", "dt", "t.*"
    )


def _scenario_values(name):
    plan = plan_features(name, "high_weather", time_encoding=True)
    return plan.hist, plan.fcst


_SCENARIO_SQL = " union all ".join(
    f"""select plant_id, '{s}' as scenario, cast({len(h)} as bigint) as n_hist, cast({len(f)} as bigint) as n_fcst,
  round_even({" + ".join(f"coalesce(sum({c}), 0)" for c in h) or "0.0"}, 4) + 0.0 as hist_total,
  round_even({" + ".join(f"coalesce(sum({c}), 0)" for c in f) or "0.0"}, 4) + 0.0 as fcst_total from lagged group by plant_id"""
    for s, (h, f) in ((s, _scenario_values(s)) for s in K.SCENARIOS)
)


@query(
    "scenario_features",
    Q.chain(Q.DENSE, Q.kept(), Q.clean([], [])) + f"select plant_id, scenario, n_hist, n_fcst, cast(hist_total as double) as hist_total, cast(fcst_total as double) as fcst_total from ({_SCENARIO_SQL})",
)
def scenario_features(spark, folder):
    rows = encode_time(T.previous_value(keep_dated(stored_hours(spark, folder)), K.TARGET, K.LAG_FEATURE))
    used = dict.fromkeys(c for s in K.SCENARIOS for cols in _scenario_values(s) for c in cols)
    sums = rows.groupBy("plant_id").agg(*[F.coalesce(F.sum(c), F.lit(0.0)).alias(c) for c in used])
    total = lambda cols: half_even(sum((F.col(c) for c in cols), F.lit(0.0)), 4)
    options = []
    for s in K.SCENARIOS:
        plan = plan_features(s, "high_weather", True, available=rows.columns)
        options.append(
            F.struct(
                F.lit(s).alias("scenario"),
                F.lit(len(plan.hist)).cast("long").alias("n_hist"),
                F.lit(len(plan.fcst)).cast("long").alias("n_fcst"),
                total(plan.hist).alias("hist_total"),
                total(plan.fcst).alias("fcst_total"),
            )
        )
    return sums.select("plant_id", F.explode(F.array(*options)).alias("s")).select("plant_id", "s.*")


@query(
    "lag_target",
    Q.chain(Q.DENSE, Q.kept())
    + "select plant_id, dt, lag(capacity_factor) over (partition by plant_id order by dt) as previous from kept",
    text="dt",
)
def lag_target(spark, folder):
    rows = T.previous_value(keep_dated(stored_hours(spark, folder, weather=False)), K.TARGET, "previous")
    return rows.select("plant_id", "dt", "previous")


_PREP_PLAN = plan_features("PV+NWP", "high_weather", time_encoding=False)


@query(
    "prep_clean",
    Q.chain(Q.DENSE, Q.kept(), Q.clean(_PREP_PLAN.hist, _PREP_PLAN.fcst))
    + f"select plant_id, dt, capacity_factor, {', '.join(_PREP_PLAN.all_columns)} from clean",
    text="dt",
)
def prep_clean(spark, folder):
    rows = T.previous_value(keep_dated(stored_hours(spark, folder)), K.TARGET, K.LAG_FEATURE)
    return clean_features(rows, _PREP_PLAN).select("plant_id", "dt", K.TARGET, *_PREP_PLAN.all_columns)


@query(
    "nan_to_num",
    Q.chain(Q.DENSE)
    + """select plant_id, dt, case when "Hour" % 4 = 0 then 0.0 when "Hour" % 4 = 1 then 1.0
   when "Hour" % 4 = 2 then -1.0 else coalesce(capacity_factor, 0.0) end as cleaned from dense""",
    text="dt",
)
def nan_to_num(spark, folder):
    odd = (
        F.when(F.col("Hour") % 4 == 0, F.lit(float("nan")))
        .when(F.col("Hour") % 4 == 1, F.lit(float("inf")))
        .when(F.col("Hour") % 4 == 2, F.lit(float("-inf")))
        .otherwise(F.col(K.TARGET))
    )
    rows = dense_hours(spark, folder).withColumn("odd", odd)
    return rows.select("plant_id", "dt", finite("odd").alias("cleaned"))


@query(
    "clip_predictions",
    "select event_id, greatest(least(value * 3 - 20, 100.0), 0.0) as y_pred from events",
)
def clip_predictions(spark, folder):
    return table(spark, folder, "events").select("event_id", clip_percent(F.col("value") * 3 - 20).alias("y_pred"))


@query(
    "season_of",
    """select o_orderkey, case when month(o_orderdate) between 3 and 5 then 'Spring' when month(o_orderdate) between 6 and 8
  then 'Summer' when month(o_orderdate) between 9 and 11 then 'Fall' else 'Winter' end as season from orders""",
)
def season_of_orders(spark, folder):
    return table(spark, folder, "orders").select("o_orderkey", season_of(F.month("o_orderdate")).alias("season"))


_ALL = [*K.WEATHER, K.TARGET]


@query(
    "scaler_fit",
    Q.chain(Q.DENSE, Q.kept(), Q.clean([], [], extra=K.WEATHER))
    + " union all ".join(
        f"select plant_id, '{c}' as feature, min({c}) as lo, max({c}) as hi, min({c}) = max({c}) as constant from clean group by plant_id"
        for c in _ALL
    ),
)
def scaler_fit(spark, folder):
    return scaler_table(keep_dated(dense_hours(spark, folder)), _ALL)


@query(
    "constant_features",
    Q.chain(Q.DENSE, Q.kept(), Q.clean([], [], extra=K.WEATHER))
    + " union all ".join(
        f"select plant_id, '{c}' as feature from clean group by plant_id having min({c}) = max({c})" for c in _ALL
    ),
)
def constant_features(spark, folder):
    return scaler_table(keep_dated(dense_hours(spark, folder)), _ALL).filter("constant").select("plant_id", "feature")


_SCALE_PLAN = plan_features("PV+NWP", "medium_weather", time_encoding=True)
_SCALE_COLUMNS = [*_SCALE_PLAN.all_columns, K.TARGET]


@query(
    "minmax_scale",
    Q.chain(Q.DENSE, Q.kept(), Q.clean(_SCALE_PLAN.hist, _SCALE_PLAN.fcst), Q.scaled(_SCALE_COLUMNS))
    + "select plant_id, dt, "
    + ", ".join(f"round_even({c}, 8) + 0.0 as {c}" for c in _SCALE_COLUMNS)
    + " from scaled",
    text="dt",
)
def minmax_scale(spark, folder):
    rows = scaled_hours(prepare(stored_hours(spark, folder), _SCALE_PLAN))
    return rows.select("plant_id", "dt", *[half_even(c, 8).alias(c) for c in _SCALE_COLUMNS])


@query(
    "inverse_scale",
    Q.chain(Q.DENSE, Q.kept(), Q.clean([], []))
    + "select plant_id, dt, round_even(capacity_factor, 8) as restored from clean",
    text="dt",
)
def inverse_scale(spark, folder):
    prepared = prepare(stored_hours(spark, folder, weather=False), FeaturePlan([], [], True))
    bounds = prepared.spine.select(*T.DAY, "lo_capacity_factor", "hi_capacity_factor")
    rows = scaled_hours(prepared).join(bounds, T.DAY)
    restored = unscale(F.col(K.TARGET), F.col("lo_capacity_factor"), F.col("hi_capacity_factor"))
    return rows.select("plant_id", "dt", half_even(restored, 8).alias("restored"))


@query(
    "day_completeness",
    Q.chain(Q.GAPPY)
    + "select plant_id, date, count(*) as n_rows, count(*) = 24 as complete from gappy where capacity_factor is not null group by plant_id, date",
    text="date",
)
def day_completeness(spark, folder):
    return T.day_spine(keep_dated(gappy_hours(spark, folder))).select(*T.DAY, "n_rows", "complete")


@query(
    "day_index",
    Q.chain(Q.DENSE, Q.kept())
    + """select plant_id, date, row_number() over (partition by plant_id order by date) - 1 as day_pos,
  coalesce(sum(count(*)) over (partition by plant_id order by date rows between unbounded preceding and 1 preceding), 0)::bigint as row_offset
  from kept group by plant_id, date""",
    text="date",
)
def day_index(spark, folder):
    return T.day_spine(keep_dated(dense_hours(spark, folder))).select(*T.DAY, "day_pos", "row_offset")


def _weighted(col):
    """Sum of array entries weighted by the root of their place, so a wrong order shows."""
    weighted = F.transform(col, lambda v, i: v * F.sqrt(i + 1))
    return half_even(F.aggregate(weighted, F.lit(0.0), lambda a, v: a + v), 6)


def _summary(samples, *extra):
    hist, fcst = F.flatten("x_hist"), F.flatten("x_fcst")
    return samples.select(
        "plant_id",
        "date",
        "sample_idx",
        "n_samples",
        F.size(hist).cast("long").alias("hist_size"),
        F.size(fcst).cast("long").alias("fcst_size"),
        _weighted(hist).alias("hist_sum"),
        _weighted(fcst).alias("fcst_sum"),
        _weighted("y_true").alias("y_sum"),
        *extra,
    )


_WINDOW_PLAN = plan_features("PV+NWP", "high_weather", time_encoding=False)


def _window_sql(past_days, plan, blank=None, source=None):
    """Sizes and weighted sums of each daily sample."""
    hist = [] if blank is not None else plan.hist
    nh, nf = len(hist), len(plan.fcst)
    source = source or (Q.DENSE, Q.kept())
    head = Q.chain(*source, Q.clean(plan.hist, plan.fcst), Q.scaled(plan.all_columns), Q.numbered(past_days))
    hist_terms = " + ".join(
        f"""x.{c} * sqrt(((p.day_pos - s.day_pos + {past_days}) * 24 + x."Hour") * {nh} + {i} + 1)""" for i, c in enumerate(hist)
    )
    fcst_terms = " + ".join(f'y.{c} * sqrt(y."Hour" * {nf} + {i} + 1)' for i, c in enumerate(plan.fcst)) or "0.0"
    hist_sum = (
        f"""(select sum({hist_terms}) from present p join scaled x on x.plant_id = p.plant_id and x.date = p.date
     where p.plant_id = s.plant_id and p.day_pos between s.day_pos - {past_days} and s.day_pos - 1)"""
        if hist and past_days
        else "0.0"
    )
    size = blank if blank is not None else past_days * 24 * nh
    return head + f"""select s.plant_id, s.date, s.sample_idx, s.n_samples, cast({size} as bigint) as hist_size,
  cast({24 * nf} as bigint) as fcst_size, cast(round_even({hist_sum}, 6) + 0.0 as double) as hist_sum,
  cast(round_even(sum({fcst_terms}), 6) + 0.0 as double) as fcst_sum, round_even(sum(y.y_true * sqrt(y."Hour" + 1)), 6) as y_sum
  from samples s join scaled y on y.plant_id = s.plant_id and y.date = s.date
  group by s.plant_id, s.date, s.day_pos, s.sample_idx, s.n_samples"""


def _daily(past_days):
    @query(f"daily_windows_{past_days}d", _window_sql(past_days, _WINDOW_PLAN), text="date")
    def daily(spark, folder):
        prepared = prepare(stored_hours(spark, folder), _WINDOW_PLAN)
        return _summary(W.daily_samples(prepared, 24 * past_days))


for _p in (0, 1, 3, 5, 7):
    _daily(_p)


_GAPPY_PLAN = FeaturePlan([K.LAG_FEATURE], ["load"], False)


@query(
    "daily_windows_gappy",
    _window_sql(1, _GAPPY_PLAN, source=(Q.GAPPY, Q.kept("gappy"))),
    text="date",
)
def daily_windows_gappy(spark, folder):
    return _summary(W.daily_samples(prepare(gappy_hours(spark, folder), _GAPPY_PLAN), 24))


_NWP_PLAN = plan_features("NWP", "high_weather", time_encoding=True)


@query("nwp_only_windows", _window_sql(1, _NWP_PLAN, blank=24 * len(_NWP_PLAN.hist)), text="date")
def nwp_only_windows(spark, folder):
    return _summary(W.daily_samples(prepare(stored_hours(spark, folder), _NWP_PLAN), 24))


def _sliding_sql(past, future, plan, source):
    nh, nf = len(plan.hist), len(plan.fcst)
    hist_terms = " + ".join(f"x.{c} * sqrt((x.pos - s.pos + {past}) * {nh} + {i} + 1)" for i, c in enumerate(plan.hist))
    fcst_terms = " + ".join(f"x.{c} * sqrt((x.pos - s.pos) * {nf} + {i} + 1)" for i, c in enumerate(plan.fcst)) or "0.0"
    return (
        Q.chain(*source, Q.clean(plan.hist, plan.fcst), Q.scaled(plan.all_columns))
        + f""", placed as (select *, row_number() over (partition by plant_id order by dt) - 1 as pos,
    count(*) over (partition by plant_id) as n from scaled)
select s.plant_id, s.date, s.pos - {past} as sample_idx, s.n - {past + future} + 1 as n_samples, max(x.dt) as end_dt,
  cast({past * nh} as bigint) as hist_size, cast({future * nf} as bigint) as fcst_size,
  round_even(sum(case when x.pos < s.pos then {hist_terms} else 0.0 end), 6) + 0.0 as hist_sum,
  round_even(sum(case when x.pos >= s.pos then {fcst_terms} else 0.0 end), 6) + 0.0 as fcst_sum,
  round_even(sum(case when x.pos >= s.pos then x.y_true * sqrt(x.pos - s.pos + 1) else 0.0 end), 6) as y_sum
from placed s join placed x on x.plant_id = s.plant_id and x.pos between s.pos - {past} and s.pos + {future} - 1
where s.pos >= {past} and s.pos + {future} <= s.n
group by s.plant_id, s.date, s.pos, s.n"""
    )


@query("sliding_windows", _sliding_sql(24, 24, _WINDOW_PLAN, (Q.DENSE, Q.kept())), text="date end_dt")
def sliding_windows(spark, folder):
    samples = W.sliding_samples(prepare(stored_hours(spark, folder), _WINDOW_PLAN), 24, 24)
    return _summary(samples, "end_dt")


@query("sliding_windows_gappy", _sliding_sql(72, 24, _GAPPY_PLAN, (Q.GAPPY, Q.kept("gappy"))), text="date end_dt")
def sliding_windows_gappy(spark, folder):
    samples = W.sliding_samples(prepare(gappy_hours(spark, folder), _GAPPY_PLAN), 72, 24)
    return _summary(samples, "end_dt")


_MATRIX_PLAN = plan_features("PV+NWP", "solar_irradiance_only", time_encoding=False)


@query(
    "feature_matrix",
    Q.chain(
        Q.DENSE, Q.kept(), Q.clean(_MATRIX_PLAN.hist, _MATRIX_PLAN.fcst), Q.scaled(_MATRIX_PLAN.all_columns), Q.numbered(1)
    )
    + """select s.plant_id, s.sample_idx, cast(x."Hour" as bigint) as place, round_even(x.capacity_factor_hist, 6) + 0.0 as value
  from samples s join present p on p.plant_id = s.plant_id and p.day_pos = s.day_pos - 1
  join scaled x on x.plant_id = p.plant_id and x.date = p.date
 union all
 select s.plant_id, s.sample_idx, cast(24 + x."Hour" as bigint), round_even(x.global_tilted_irradiance_pred, 6) + 0.0
  from samples s join scaled x on x.plant_id = s.plant_id and x.date = s.date""",
)
def feature_matrix(spark, folder):
    samples = W.daily_samples(prepare(stored_hours(spark, folder), _MATRIX_PLAN), 24)
    return samples.select("plant_id", "sample_idx", F.posexplode(W.flatten_sample()).alias("place", "value")).select(
        "plant_id", "sample_idx", F.col("place").cast("long").alias("place"), half_even("value", 6).alias("value")
    )


@query(
    "array_flatten",
    Q.chain(Q.DENSE, Q.kept())
    + """select plant_id, date, cast(count(*) as bigint) as n_values, round_even(sum(capacity_factor), 4) as total,
  round_even(avg(capacity_factor), 4) as mean from kept group by plant_id, date having count(*) = 24""",
    text="date",
)
def array_flatten(spark, folder):
    prepared = prepare(stored_hours(spark, folder, weather=False), FeaturePlan([K.TARGET], [], False))
    days = W.day_rows(prepared.hours, prepared.spine.filter("complete"), prepared.plan, scaled=False)
    values = F.flatten("x_day")
    total = F.aggregate(values, F.lit(0.0), lambda a, v: a + v)
    return days.select(
        *T.DAY,
        F.size(values).cast("long").alias("n_values"),
        half_even(total, 4).alias("total"),
        half_even(total / F.size(values), 4).alias("mean"),
    )


_SAMPLES_SQL = Q.chain(Q.DENSE, Q.kept(), Q.clean([], []), Q.numbered(1))


def _numbered(spark, folder):
    prepared = prepare(stored_hours(spark, folder, weather=False), FeaturePlan([], [], True))
    return T.number_samples(prepared.spine, 1, need_history=False)


@query(
    "split_sequential",
    _SAMPLES_SQL + f"select plant_id, date, sample_idx, {Q.part('sample_idx', 'n_samples')} as part from samples",
    text="date",
)
def split_sequential(spark, folder):
    numbered = S.daily_part(shuffle=False)(_numbered(spark, folder))
    return numbered.filter("sample_idx is not null").select("plant_id", "date", "sample_idx", "part")


_SHUFFLED = ", ranked as (select *, row_number() over (partition by plant_id order by md5('42:' || sample_idx)) - 1 as rnk from samples)"


@query(
    "split_shuffled",
    _SAMPLES_SQL.rstrip() + _SHUFFLED + f" select plant_id, date, sample_idx, {Q.part('rnk', 'n_samples')} as part from ranked",
    text="date",
)
def split_shuffled(spark, folder):
    numbered = S.daily_part(shuffle=True)(_numbered(spark, folder))
    return numbered.filter("sample_idx is not null").select("plant_id", "date", "sample_idx", "part")


@query("split_permuted")
def split_permuted(spark, folder):
    """Parts by the permutation that NumPy's legacy generator draws under the seed; it has no counterpart in SQL."""
    numbered = S.daily_part(shuffle=True, order="mt19937")(_numbered(spark, folder))
    return numbered.filter("sample_idx is not null").select("plant_id", "date", "sample_idx", "part")


@query(
    "split_per_plant",
    _SAMPLES_SQL.rstrip()
    + f""", {_OWN_SQL}, ranked as (select s.*, coalesce(train_ratio, 0.8) as train, row_number() over (partition by plant_id
    order by case when coalesce(shuffle_split, true) then md5('42:' || sample_idx) end, sample_idx) - 1 as rnk
  from samples s left join own using (plant_id))
select plant_id, date, sample_idx, case when rnk < floor(n_samples * train) then 'train'
  when rnk < floor(n_samples * train) + floor(n_samples * cast(0.1 as double)) then 'val' else 'test' end as part from ranked""",
    text="date",
)
def split_per_plant(spark, folder):
    numbered = S.daily_part(shuffle=True, settings=_own_settings(spark, folder))(_numbered(spark, folder))
    return numbered.filter("sample_idx is not null").select("plant_id", "date", "sample_idx", "part")


@query(
    "split_shuffled_hours",
    Q.chain(Q.DENSE, Q.kept())
    + f""", samples as (select plant_id, dt, row_number() over (partition by plant_id order by dt) - 1 as sample_idx,
   count(*) over (partition by plant_id) as n_samples from kept){_SHUFFLED}
 select plant_id, dt, sample_idx, rnk, {Q.part('rnk', 'n_samples')} as part from ranked""",
    text="dt",
)
def split_shuffled_hours(spark, folder):
    prepared = prepare(stored_hours(spark, folder, weather=False), FeaturePlan([], [], True))
    placed = T.add_position(prepared.hours, prepared.spine).select(
        "plant_id", "dt", F.col("pos").alias("sample_idx"), F.col("plant_rows").alias("n_samples")
    )
    ranked = S.shuffled_rank(placed, out="rnk")
    return ranked.select("plant_id", "dt", "sample_idx", "rnk", S.part_of("rnk", "n_samples").alias("part"))


@query(
    "split_boundary",
    _SAMPLES_SQL
    + """select plant_id, date, sample_idx, case when sample_idx < floor(n_samples * cast(0.8 as double)) then 'train'
  when sample_idx < floor(n_samples * (cast(0.8 as double) + cast(0.1 as double))) then 'val' else 'test' end as part from samples""",
    text="date",
)
def split_boundary(spark, folder):
    return (
        _numbered(spark, folder)
        .filter("sample_idx is not null")
        .select("plant_id", "date", "sample_idx", S.part_by_boundary("sample_idx", "n_samples").alias("part"))
    )


@query(
    "split_scales",
    _SAMPLES_SQL
    + " union all ".join(
        f"select plant_id, '{n}' as training_scale, {Q.part('sample_idx', 'n_samples', r)} as part, count(*) as n from samples group by 1, 2, 3"
        for n, r in K.TRAINING_SCALES.items()
    ),
)
def split_scales(spark, folder):
    scales = [
        F.struct(F.lit(n).alias("training_scale"), S.part_of("sample_idx", "n_samples", r).alias("part"))
        for n, r in K.TRAINING_SCALES.items()
    ]
    samples = _numbered(spark, folder).filter("sample_idx is not null")
    return (
        samples.select("plant_id", F.explode(F.array(*scales)).alias("s"))
        .groupBy("plant_id", "s.training_scale", "s.part")
        .agg(F.count(F.lit(1)).alias("n"))
    )


@query(
    "scalar_time",
    """select o_orderkey, strftime(o_orderdate, '%Y-%m-%d') as day, month(o_orderdate) as month,
  o_orderdate + interval 1 hour * (o_orderkey % 24) as stamped,
  round_even(datediff('minute', o_orderdate, o_orderdate + interval 1 hour * (o_orderkey % 24)) / 1.0, 2) as minutes from orders""",
    text="stamped",
)
def scalar_time(spark, folder):
    hours = (F.col("o_orderkey") % 24).cast("int")
    stamped = F.col("o_orderdate") + F.make_dt_interval(F.lit(0), hours)
    seconds = F.unix_micros(stamped.cast("timestamp")) - F.unix_micros(F.col("o_orderdate").cast("timestamp"))
    return table(spark, folder, "orders").select(
        "o_orderkey",
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"),
        F.month("o_orderdate").cast("long").alias("month"),
        stamped.alias("stamped"),
        half_even(seconds / 60e6, 2).alias("minutes"),
    )


@query(
    "scalar_strings",
    """select s_suppkey, replace('data\\' || s_name || '.csv', '\\', '/') as path, lower(cast(s_suppkey % 2 = 0 as varchar)) as flag,
  regexp_extract(s_name, '(\\d+)', 1) as digits from supplier""",
)
def scalar_strings(spark, folder):
    from noonward.functions.columns import forward_slashes

    return table(spark, folder, "supplier").select(
        "s_suppkey",
        forward_slashes(F.concat(F.lit("data\\"), "s_name", F.lit(".csv"))).alias("path"),
        F.lower((F.col("s_suppkey") % 2 == 0).cast("string")).alias("flag"),
        F.regexp_extract("s_name", r"(\d+)", 1).alias("digits"),
    )


@query(
    "dilated_lags",
    Q.chain(Q.DENSE, Q.kept())
    + "select plant_id, dt, "
    + ", ".join(f"lag(capacity_factor, {n}) over (partition by plant_id order by dt) as capacity_factor_lag{n}" for n in (1, 2, 4))
    + " from kept",
    text="dt",
)
def dilated_lags(spark, folder):
    from noonward.operators.sequences import dilated_offsets

    rows = keep_dated(stored_hours(spark, folder, weather=False)).select(*T.DAY, "dt", K.TARGET)
    lagged = T.values_before(rows, T.day_spine(rows), K.TARGET, dilated_offsets(kernel=3, levels=2))
    return lagged.select("plant_id", "dt", *[f"{K.TARGET}_lag{n}" for n in (1, 2, 4)])


@query(
    "position_encoding",
    Q.chain(Q.DENSE, Q.kept())
    + """, placed as (select plant_id, dt, row_number() over (partition by plant_id order by dt) - 1 as pos from kept)
 select plant_id, dt, pos, cast(d as bigint) as dim,
   round_even(case when d % 2 = 0 then sin(pos * exp(-ln(10000.0) * d / 8)) else cos(pos * exp(-ln(10000.0) * (d - 1) / 8)) end, 5) + 0.0 as value
 from placed, range(8) t(d)""",
    text="dt",
)
def position_encoding(spark, folder):
    from noonward.operators.sequences import position_waves

    rows = keep_dated(stored_hours(spark, folder, weather=False)).select(*T.DAY, "dt", K.TARGET)
    placed = T.add_position(rows, T.day_spine(rows))
    return placed.select("plant_id", "dt", "pos", F.posexplode(position_waves("pos", 8)).alias("dim", "value")).select(
        "plant_id", "dt", "pos", F.col("dim").cast("long").alias("dim"), half_even("value", 5).alias("value")
    )
