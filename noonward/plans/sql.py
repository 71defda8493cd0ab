"""Building blocks of the SQL the registered queries are checked against."""

from noonward import constants as K

W = K.WEATHER

CELLS = """cells as (
  select cast(l_suppkey // 34 as varchar) as plant_id,
         datediff('day', date '1992-01-01', cast(l_shipdate as date)) % 60 as dd,
         cast(l_orderkey % 24 as int) as "Hour",
         2 * avg(l_quantity) as capacity_factor,
         sum(l_quantity) as global_tilted_irradiance,
         max(l_quantity) as vapour_pressure_deficit,
         min(l_quantity) as relative_humidity_2m,
         cast(sum(l_linenumber) as double) as temperature_2m,
         cast(max(l_linenumber) as double) as wind_gusts_10m,
         cast(count(case when l_returnflag = 'A' then 1 end) as double) as cloud_cover_low,
         cast(count(case when l_linestatus = 'F' then 1 end) as double) as wind_speed_100m,
         cast(0 as double) as snow_depth,
         cast(count(case when l_returnflag = 'R' then 1 end) as double) as dew_point_2m,
         cast(count(*) as double) as surface_pressure,
         cast(sum(cast(round(l_tax * 100) as int)) as double) as precipitation
  from lineitem group by 1, 2, 3)"""

_PRED = ",\n         ".join(
    (
        f"""case when cast(plant_id as int) % 3 = 2 and dd = 11 and "Hour" = 5 then null
              else {w} + "Hour" % 3 - 1 end as {w}_pred"""
        if w == "global_tilted_irradiance"
        else f'{w} + "Hour" % 3 - 1 as {w}_pred'
    )
    for w in W
)

DENSE = f"""{CELLS},
dense as (
  select plant_id, "Hour",
         cast(date '2022-01-01' + cast(dd * 16 as int) as date) as date,
         cast(date '2022-01-01' + cast(dd * 16 as int) as timestamp) + "Hour" * interval 1 hour as dt,
         month(date '2022-01-01' + cast(dd * 16 as int)) as "Month",
         case when cast(plant_id as int) % 3 = 1 and dd = 7 and "Hour" = 3 then null
              else capacity_factor end as capacity_factor,
         {", ".join(W)},
         {_PRED}
  from cells where not (cast(plant_id as int) % 3 = 0 and dd = 20))"""

GAPPY = """gappy as (
  select cast(user_id // 50 as varchar) as plant_id, cast(ts as date) as date, cast(hour(ts) as int) as "Hour",
         cast(cast(ts as date) as timestamp) + hour(ts) * interval 1 hour as dt,
         month(cast(ts as date)) as "Month",
         least(sum(cast(round(value * 100) as bigint)) / (cast(count(*) as double) * 100), 100.0) as capacity_factor, cast(count(*) as double) as load
  from events group by cast(user_id // 50 as varchar), cast(ts as date), hour(ts))"""

TIME = {
    "month_cos": 'cos(2 * pi() * "Month" / 12)',
    "month_sin": 'sin(2 * pi() * "Month" / 12)',
    "hour_cos": 'cos(2 * pi() * "Hour" / 24)',
    "hour_sin": 'sin(2 * pi() * "Hour" / 24)',
}


def chain(*parts: str) -> str:
    return "with " + ",\n".join(parts) + "\n"


def kept(source: str = "dense", start: str = K.DEFAULT_START, end: str = K.DEFAULT_END) -> str:
    return f"""kept as (
  select * from {source} where capacity_factor is not null
     and dt >= timestamp '{start} 00:00:00' and dt <= timestamp '{end} 00:00:00')"""


def clean(hist: list[str], fcst: list[str], source: str = "kept", extra: list[str] = ()) -> str:
    """Lagged, encoded and cleaned rows as `clean`."""
    names = list(dict.fromkeys([*hist, *fcst, *extra]))
    lagged = "lag(capacity_factor) over (partition by plant_id order by dt) as capacity_factor_hist"
    encoded = ", ".join(f"{e} as {n}" for n, e in TIME.items())
    drop = " and ".join(f"{c} is not null" for c in [*fcst, K.TARGET])
    cols = ", ".join(f"coalesce({c}, 0.0) as {c}" if c in hist else c for c in names if c != K.TARGET)
    return f"""lagged as (select *, {lagged}, {encoded} from {source}),
clean as (select plant_id, date, dt, "Hour", capacity_factor{", " + cols if cols else ""} from lagged where {drop})"""


def scaled(columns: list[str]) -> str:
    """Rows of `clean` scaled by the extremes of the plant, as `scaled`; `bounds` has the extremes."""
    columns = list(dict.fromkeys([*columns, K.TARGET]))
    ext = ", ".join(f"min({c}) as lo_{c}, max({c}) as hi_{c}" for c in columns)
    out = ", ".join(f"coalesce((c.{c} - b.lo_{c}) / nullif(b.hi_{c} - b.lo_{c}, 0), 0.0) as {c}" for c in columns)
    return f"""bounds as (select plant_id, {ext} from clean group by plant_id),
scaled as (
  select c.plant_id, c.date, c.dt, c."Hour", c.capacity_factor as y_true,
         b.lo_capacity_factor as lo, b.hi_capacity_factor as hi, {out}
  from clean c join bounds b on c.plant_id = b.plant_id)"""


def numbered(past_days: int, source: str = "clean") -> str:
    """Present days as `present`, sample days as `samples` with their number."""
    return f"""present as (
  select plant_id, date, count(*) as n_rows,
         row_number() over (partition by plant_id order by date) - 1 as day_pos
  from {source} group by plant_id, date),
hits as (
  select t.plant_id, t.date, t.day_pos from present t left join present h
    on h.plant_id = t.plant_id and h.n_rows = 24 and h.day_pos between t.day_pos - {past_days} and t.day_pos - 1
  where t.n_rows = 24 and t.day_pos > {past_days}
  group by t.plant_id, t.date, t.day_pos having count(h.date) = {past_days}),
samples as (
  select plant_id, date, day_pos,
         row_number() over (partition by plant_id order by date) - 1 as sample_idx,
         count(*) over (partition by plant_id) as n_samples from hits)"""


def part(rank: str, total: str, train: float = 0.8, val: float = 0.1) -> str:
    tr = f"cast(floor({total} * cast({train} as double)) as bigint)"
    va = f"cast(floor({total} * cast({val} as double)) as bigint)"
    return f"case when {rank} < {tr} then 'train' when {rank} < {tr} + {va} then 'val' else 'test' end"


def mean_past(past_days: int, name: str, source: str = "kept") -> str:
    """Forecasts by the mean of the same hour over the past present days, as `f_<name>`."""
    body = numbered(past_days, source).replace("present", f"present_{name}").replace("hits", f"hits_{name}")
    body = body.replace("samples as", f"samples_{name} as").replace("n_samples_", "n_samples_")
    return f"""{body},
f_{name} as (
  select s.plant_id, '{name}' as model, s.sample_idx, s.n_samples, s.date, y."Hour" as horizon, y.dt as forecast_datetime,
         y.capacity_factor as y_true, avg(x.capacity_factor) as y_pred
  from samples_{name} s
  join {source} y on y.plant_id = s.plant_id and y.date = s.date
  join present_{name} p on p.plant_id = s.plant_id and p.day_pos between s.day_pos - {past_days} and s.day_pos - 1
  join {source} x on x.plant_id = p.plant_id and x.date = p.date and x."Hour" = y."Hour"
  group by s.plant_id, s.sample_idx, s.n_samples, s.date, y."Hour", y.dt, y.capacity_factor)"""


FORECASTS = ",\n".join(
    [
        DENSE,
        kept(),
        mean_past(1, "persist"),
        mean_past(3, "mean3"),
        "forecasts as (select * from f_persist union all select * from f_mean3)",
    ]
)

R2 = """case when var_pop(y_true) * count(*) > 0
          then 1 - sum((y_true - y_pred) * (y_true - y_pred)) / (var_pop(y_true) * count(*)) else 0.0 end"""
MAE = "avg(abs(y_true - y_pred))"
RMSE = "sqrt(avg((y_true - y_pred) * (y_true - y_pred)))"
RANGE = "(max(y_true) - min(y_true))"
NRMSE = f"{RMSE} / nullif({RANGE}, 0)"


def daily(keys: str, source: str = "forecasts") -> str:
    """Daily-averaged metrics as `daily`."""
    return f"""per_day as (
  select {keys}, sample_idx, {MAE} as d_mae, {RMSE} as d_rmse from {source} group by {keys}, sample_idx),
averaged as (
  select {keys}, round_even(avg(d_mae), 4) as mae, round_even(avg(d_rmse), 4) as rmse, count(*) as n_days
  from per_day group by {keys}),
flat as (
  select {keys}, round_even({R2}, 4) as r2, {NRMSE} as flat_nrmse, {RANGE} as range_true, count(*) as samples
  from {source} group by {keys}),
daily as (select * from averaged join flat using ({keys}))"""


PLANTS = """plants as (
  select cast(s_suppkey as varchar) as plant_id, 'Project ' || s_suppkey as plant_name,
         case when s_suppkey % 10 <> 9 then 'data\\Project' || s_suppkey || '.csv' end as data_path,
         case when s_suppkey % 4 = 1 then '2023-01-01' end as start_date,
         case when s_suppkey % 4 = 2 then '2024-06-30' end as end_date,
         case when s_suppkey % 5 = 1 then cast(0.6 as double) end as train_ratio,
         case when s_suppkey % 6 = 1 then false when s_suppkey % 6 = 2 then true end as shuffle_split,
         case when s_suppkey % 7 = 3 then 'high_weather' end as weather_category,
         cast(floor(abs(s_acctbal)) as bigint) as size
  from supplier)"""


def _values(rows: list[tuple]) -> str:
    return ", ".join(
        "(" + ", ".join("null" if v is None else str(v).lower() if isinstance(v, bool) else repr(v) for v in row) + ")"
        for row in rows
    )


_LEVELS = [(m, c) for m in K.DEEP_MODELS + K.TREE_MODELS for c in K.GRID_COMPLEXITIES] + [("Linear", None)]
_CHOICES = [(s, h, *K.SCENARIOS[s]) for s in K.POWER_SCENARIOS for h in K.GRID_LOOKBACKS] + [
    (s, 0, *K.SCENARIOS[s]) for s in K.FORECAST_ONLY_SCENARIOS
]

GRID = f"""{PLANTS},
grid as (
  select p.plant_id, p.size, m.model, m.complexity, f.scenario, f.lookback_hours, f.use_pv, f.use_hist_weather,
         f.use_forecast, f.use_ideal_nwp, t.use_time_encoding, f.lookback_hours // 24 as past_days,
         f.lookback_hours = 0 as no_hist_power,
         m.model || coalesce('_' || m.complexity, '') || '_' || f.scenario
           || case when f.lookback_hours > 0 then '_' || f.lookback_hours || 'h' else '' end
           || case when t.use_time_encoding then '_TE' else '_noTE' end as experiment_name
  from plants p,
       (values {_values(_LEVELS)}) m(model, complexity),
       (values {_values(_CHOICES)}) f(scenario, lookback_hours, use_pv, use_hist_weather, use_forecast, use_ideal_nwp),
       (values (true), (false)) t(use_time_encoding)
  where m.model <> 'Linear' or f.lookback_hours = 0)"""

RESULTS = f"""{GRID},
marked as (
  select *, cast(plant_id as bigint) as key, length(experiment_name) as n,
    (length(experiment_name) * 37 + size * 13 + cast(plant_id as bigint) * 7 + lookback_hours * 3) % 4001 as mix from grid),
stated as (
  select *, case when key % 3 = 0 then 'SUCCESS' when key % 3 = 1 and (n + key) % 3 = 0 then 'SUCCESS'
    when key % 3 = 1 and (n + key) % 7 = 0 then 'FAILED' end as status from marked),
scored as (
  select *, case when status = 'SUCCESS' then 2 + mix / cast(977 as double) end as mae from stated where status is not null),
results as (
  select * exclude (key, n, mix, size), mae * (1 + (mix % 89) / cast(211 as double)) as rmse,
    case when status = 'SUCCESS' then 1 - (mix % 787) / cast(991 as double) end as r2,
    case when status = 'SUCCESS' then (mix % 503) / cast(7 as double) else 0 end as train_time_sec,
    case when status = 'SUCCESS' then 24 * (mix % 50 + 1) else 0 end as test_samples,
    case when status = 'SUCCESS' then mix % 20 else 0 end as best_epoch,
    case when status = 'SUCCESS' then n * 3 else 0 end as param_count,
    case when status <> 'SUCCESS' then 'no valid samples' end as error,
    mae * (1 + (mix % 89) / cast(211 as double)) / cast(53 as double) as nrmse
  from scored)"""

LOSSES = """losses as (
  select cast(p_partkey // 400 as varchar) as plant_id, 'run_' || (p_partkey // 40) as experiment_name,
    cast(p_partkey % 40 + 1 as int) as epoch,
    ((p_partkey * 7919) % 1009) / cast(1009 as double) / (p_partkey % 40 + 1) as train_loss,
    ((p_partkey * 104729) % 997) / cast(997 as double) / (1 + (p_partkey % 40) / cast(8 as double)) as val_loss,
    p_size / cast(10 as double) as epoch_time from part)"""


def mean_std(metrics: list[str]) -> str:
    return ", ".join(
        f"round_even(avg({m}), 2) as {m}_mean, round_even(stddev_samp({m}), 2) as {m}_std" for m in metrics
    )
