"""Settings, grids, work lists, results and status."""

from pyspark.sql import functions as F

from noonward import constants as K
from noonward.functions.columns import half_even, model_rank, rank_in, recorded_experiment_id
from noonward.operators import sequences as E
from noonward.plans import fixtures as X
from noonward.plans import grid as G
from noonward.plans import reports as R
from noonward.plans import sql as Q
from noonward.plans import status as P
from noonward.plans.registry import query
from noonward.session import discard, shared_folder, store
from noonward.sinks.tables import append_new, append_results
from noonward.sources import configs as C
from noonward.sources.hourly import date_ranges
from noonward.sources.results import read_results, union_results

_OVERLAID = f"""select plant_id, plant_name, data_path, coalesce(start_date, '{K.DEFAULT_START}') as start_date,
  coalesce(end_date, '{K.DEFAULT_END}') as end_date, coalesce(train_ratio, cast(0.8 as double)) as train_ratio,
  coalesce(shuffle_split, false) as shuffle_split, coalesce(weather_category, 'all_weather') as weather_category,
  24::bigint as past_hours from plants"""


@query("config_overlay", Q.chain(Q.PLANTS) + _OVERLAID)
def config_overlay(spark, folder):
    filled = C.overlay(X.plants(spark, folder), C.TEMPLATE)
    return filled.select(
        "plant_id", "plant_name", "data_path", "start_date", "end_date", "train_ratio", "shuffle_split",
        "weather_category", F.col("past_hours").cast("long").alias("past_hours"),
    )


@query(
    "config_create",
    Q.chain(Q.DENSE, Q.PLANTS)
    + """, ranges as (select plant_id, strftime(min(dt), '%Y-%m-%d') as s, strftime(max(dt), '%Y-%m-%d') as e, count(*) as n
  from dense group by plant_id)
 select p.plant_id, 'Project ' || p.plant_id as plant_name, replace(coalesce(p.data_path, 'none'), '\\', '/') as data_path,
   coalesce(r.s, '2022-01-01') as start_date, coalesce(r.e, '2024-09-28') as end_date, coalesce(r.n, 0) as data_length,
   24::bigint as past_hours, 42::bigint as random_seed, false as shuffle_split
 from plants p left join ranges r using (plant_id) where cast(p.plant_id as bigint) % 4 <> 0""",
)
def config_create(spark, folder):
    all_plants = X.plants(spark, folder)
    files = all_plants.select("plant_id", F.coalesce("data_path", F.lit("none")).alias("data_path"))
    existing = all_plants.filter(F.col("plant_id").cast("long") % 4 == 0)
    made = C.new_settings(date_ranges(X.dense_hours(spark, folder)), files, existing)
    return made.select(
        "plant_id", "plant_name", "data_path", "start_date", "end_date",
        F.coalesce("data_length", F.lit(0)).alias("data_length"), F.col("past_hours").cast("long").alias("past_hours"), F.col("random_seed").cast("long").alias("random_seed"),
        "shuffle_split",
    )


@query(
    "config_verify",
    Q.chain(Q.PLANTS)
    + """select data_path is not null and start_date is not null and end_date is not null
   and cast(plant_id as bigint) % 8 <> 0 as valid, count(*) as n_plants
 from (select plant_id, data_path, coalesce(start_date, end_date) as start_date, coalesce(end_date, start_date) as end_date from plants)
 group by 1""",
)
def config_verify(spark, folder):
    checked = C.check_settings(_dated_plants(spark, folder), _plant_files(spark, folder))
    return C.count_valid(checked)


def _dated_plants(spark, folder):
    return X.plants(spark, folder).withColumns(
        {"start_date": F.coalesce("start_date", "end_date"), "end_date": F.coalesce("end_date", "start_date")}
    )


def _plant_files(spark, folder):
    return X.plants(spark, folder).filter(F.col("plant_id").cast("long") % 8 != 0).select("data_path")


@query("plants_list", Q.chain(Q.PLANTS) + "select plant_id, plant_name, data_path, start_date, end_date, (select count(*) from plants) as total from plants")
def plants_list(spark, folder):
    listed = X.plants(spark, folder)
    return (
        listed.select("plant_id", "plant_name", "data_path", "start_date", "end_date")
        .withColumn("total", listed.agg(F.count(F.lit(1))).scalar())
        .orderBy("plant_id")
    )


@query(
    "plant_slice",
    Q.chain(Q.PLANTS) + "select plant_id, plant_name from plants order by plant_id offset 5 limit 25",
)
def plant_slice(spark, folder):
    return C.choose_plants(X.plants(spark, folder), skip=5, first=25).select("plant_id", "plant_name")


_GRID_COLUMNS = [
    "plant_id", "experiment_name", "model", "complexity", "scenario", "use_pv", "use_hist_weather", "use_forecast",
    "use_ideal_nwp", "use_time_encoding", "no_hist_power",
]


@query(
    "grid_284",
    Q.chain(Q.GRID)
    + f"select {', '.join(_GRID_COLUMNS)}, lookback_hours::bigint as lookback_hours, past_days::bigint as past_days from grid",
)
def grid_284(spark, folder):
    grid = G.experiment_grid(X.plants(spark, folder).select("plant_id"))
    return grid.select(*_GRID_COLUMNS, *[F.col(c).cast("long").alias(c) for c in ("lookback_hours", "past_days")])


@query(
    "grid_names",
    Q.chain(Q.GRID) + "select plant_id, experiment_name, plant_id || '_results/' || experiment_name as save_dir from grid",
)
def grid_names(spark, folder):
    grid = G.experiment_grid(X.plants(spark, folder).select("plant_id"))
    return grid.select("plant_id", "experiment_name", G.save_path().alias("save_dir"))


@query(
    "grid_counts",
    Q.chain(Q.GRID)
    + """select plant_id, coalesce(family, 'all') as family, count(*) as n_experiments
 from (select plant_id, case when model in ('LSTM', 'GRU', 'Transformer', 'TCN') then 'deep' when model in ('RF', 'XGB', 'LGBM')
   then 'tree' else 'linear' end as family from grid) group by grouping sets ((plant_id, family), (plant_id))""",
)
def grid_counts(spark, folder):
    return G.count_by_family(G.experiment_grid(X.plants(spark, folder).select("plant_id")))


@query(
    "scenario_label",
    Q.chain(Q.GRID)
    + """select plant_id, experiment_name, scenario as scenario_label, coalesce(no_hist_power, false) as forecast_only from grid
 where use_time_encoding union all
 select plant_id, experiment_name, scenario, not use_pv and not use_hist_weather from grid where not use_time_encoding""",
)
def scenario_label(spark, folder):
    grid = G.experiment_grid(X.plants(spark, folder).select("plant_id"))
    given = grid.withColumn("no_hist_power", F.when(F.col("use_time_encoding"), F.col("no_hist_power")))
    return G.label_scenarios(given).select("plant_id", "experiment_name", "scenario_label", "forecast_only")


@query(
    "worklist",
    Q.chain(Q.GRID)
    + "select p.plant_id, p.data_path, g.experiment_name, g.model from plants p join grid g using (plant_id) where p.data_path is not null",
)
def worklist(spark, folder):
    ready = X.plants(spark, folder).filter("data_path is not null")
    return G.experiment_grid(ready.select("plant_id", "data_path")).select(
        "plant_id", "data_path", "experiment_name", "model"
    )


def _work(spark, folder):
    return G.experiment_grid(X.plants(spark, folder).select("plant_id")).select(*G.RESULT_KEY, "model")


@query(
    "resume_pending",
    Q.chain(Q.RESULTS)
    + """, done as (select distinct plant_id, experiment_name from results where coalesce(status, 'SUCCESS') = 'SUCCESS')
select plant_id, experiment_name, model from grid g anti join done using (plant_id, experiment_name)""",
)
def resume_pending(spark, folder):
    return G.pending(_work(spark, folder), X.results(spark, folder))


@query(
    "resume_pending_any",
    Q.chain(Q.RESULTS)
    + """, done as (select distinct plant_id, experiment_name from results)
select plant_id, experiment_name, model from grid g anti join done using (plant_id, experiment_name)""",
)
def resume_pending_any(spark, folder):
    return G.pending(_work(spark, folder), X.results(spark, folder), any_status=True)


_KEYED = ["start_date", "end_date", "train_ratio", "shuffle_split", "weather_category"]
_DEFAULTS = [K.DEFAULT_START, K.DEFAULT_END, str(K.TRAIN_RATIO), "true", "all_weather"]


@query(
    "resume_changed",
    Q.chain(Q.RESULTS)
    + f""", keyed as (
  select g.plant_id, g.experiment_name, g.model, cast(g.plant_id as bigint) as key,
    md5(concat_ws('|', {', '.join(f"coalesce(cast({c} as varchar), '{d}')" for c, d in zip(_KEYED, _DEFAULTS))}, g.experiment_name)) as now,
    md5(concat_ws('|', {', '.join(f"'{d}'" if c == 'end_date' else f"coalesce(cast({c} as varchar), '{d}')" for c, d in zip(_KEYED, _DEFAULTS))}, g.experiment_name)) as before
  from grid g join plants p using (plant_id)
), done as (
  select k.plant_id, k.experiment_name, k.before as settings_key from results r join keyed k using (plant_id, experiment_name)
  where coalesce(r.status, 'SUCCESS') = 'SUCCESS'
) select plant_id, experiment_name, model, now as settings_key from keyed k
  where not exists (select 1 from done d where d.plant_id = k.plant_id and d.experiment_name = k.experiment_name and d.settings_key = k.now)""",
)
def resume_changed(spark, folder):
    """What is to be run again, or for the first time, after some plants have got end dates of their own."""
    own = X.plants(spark, folder).select("plant_id", *_KEYED)

    def keyed(plants):
        values = [F.coalesce(F.col(c).cast("string"), F.lit(d)) for c, d in zip(_KEYED, _DEFAULTS)]
        work = _work(spark, folder).join(plants.hint("merge"), "plant_id")
        return work.select("plant_id", "experiment_name", "model", G.settings_key(*values, "experiment_name").alias("settings_key"))

    before = keyed(own.withColumn("end_date", F.lit(None)))
    results = X.results(spark, folder).join(before.drop("model").hint("merge"), ["plant_id", "experiment_name"])
    return G.pending(keyed(own), results).select("plant_id", "experiment_name", "model", "settings_key")


@query(
    "resume_plants",
    Q.chain(Q.RESULTS)
    + """select plant_id, plant_name from plants p where (select count(*) from results r
  where r.plant_id = p.plant_id and coalesce(r.status, 'SUCCESS') = 'SUCCESS') < 284""",
)
def resume_plants(spark, folder):
    return G.pending_plants(X.plants(spark, folder).select("plant_id", "plant_name"), X.results(spark, folder))


_STATUS = f"""{Q.RESULTS},
done as (select p.plant_id, count(r.plant_id) as completed from plants p left join results r
  on r.plant_id = p.plant_id and r.status = 'SUCCESS' group by p.plant_id),
status as (select plant_id, completed, 284 - completed as remaining, completed / cast(284 as double) * 100 as progress,
  case when completed >= 284 then 'COMPLETE' when completed > 0 then 'IN_PROGRESS' else 'NOT_STARTED' end as status from done)"""


def _status(spark, folder):
    return P.plant_status(X.plants(spark, folder), X.results(spark, folder))


@query("plant_status", Q.chain(_STATUS) + "select * from status")
def plant_status(spark, folder):
    return _status(spark, folder)


@query(
    "fleet_status",
    Q.chain(_STATUS)
    + """select count(*) as n_plants, count(*) filter (status = 'COMPLETE') as n_complete,
  count(*) filter (status = 'IN_PROGRESS') as n_in_progress, count(*) filter (status = 'NOT_STARTED') as n_not_started,
  0::bigint as n_error, sum(completed)::bigint as completed, count(*) * 284 as total,
  (count(*) * 284 - sum(completed))::bigint as remaining,
  round_even(sum(completed)::double / (count(*) * 284)::double * 100, 1) as percent,
  (count(*) filter (status = 'NOT_STARTED') + count(*) filter (status = 'IN_PROGRESS') * 0.5::double) * 2.5::double as hours_left
 from status""",
)
def fleet_status(spark, folder):
    return P.fleet_status(_status(spark, folder))


@query(
    "status_worklists",
    Q.chain(_STATUS)
    + """select 'in progress' as list, plant_id, completed as number from status where status = 'IN_PROGRESS' union all
 select * from (select 'not started', plant_id, greatest((select count(*) from status where status = 'NOT_STARTED') - 20, 0)
   from status where status = 'NOT_STARTED' order by plant_id limit 20)""",
)
def status_worklists(spark, folder):
    status = _status(spark, folder)
    going = P.in_progress(status).select(F.lit("in progress").alias("list"), "plant_id", F.col("completed").alias("number"))
    waiting = P.not_started_head(status).select(F.lit("not started").alias("list"), "plant_id", F.col("more").alias("number"))
    return going.unionByName(waiting)


@query(
    "batch_plan",
    Q.chain(_STATUS)
    + """, n as (select plant_id, row_number() over (order by plant_id) - 1 as place from status where status = 'NOT_STARTED')
 select plant_id, place, place // 25 as batch, place // 25 * 25 as skip from n""",
)
def batch_plan(spark, folder):
    return P.batches(_status(spark, folder))


@query(
    "eta",
    Q.chain(Q.RESULTS)
    + """, s as (select sum(train_time_sec) / 3600 as elapsed, count(distinct plant_id) as processed,
   (select count(*) from plants) as total from results)
 select round_even(elapsed, 2) as elapsed_hours, processed, total - processed as remaining_plants,
   round_even(elapsed / processed * (total - processed), 2) as remaining_hours,
   round_even(elapsed + elapsed / processed * (total - processed), 2) as total_hours from s""",
)
def eta(spark, folder):
    return P.remaining_time(X.results(spark, folder), X.plants(spark, folder))


_RUNS = """select (user_id % 8 + 1)::bigint as study, count(*) filter (event_type <> 'error') as n_success,
  count(*) filter (event_type = 'error') as n_failed,
  round_even(sum(case when event_type <> 'error' then cast(round(value * 100) as bigint) end) / cast(100 as double), 4) as minutes
 from events group by 1"""


@query("run_summary", _RUNS)
def run_summary(spark, folder):
    events = X.table(spark, folder, "events")
    cents = F.round(F.col("value") * 100).cast("long")
    started = F.col("ts").cast("timestamp")
    runs = events.select(
        (F.col("user_id") % 8 + 1).alias("study"),
        F.when(F.col("event_type") == "error", "FAILED").otherwise("SUCCESS").alias("status"),
        started.alias("started"),
        F.timestamp_micros(F.unix_micros(started) + cents * 600000).alias("ended"),
    )
    return P.run_summary(runs, places=4)


_RESULT_OUT = """plant_id, experiment_name, model, complexity, scenario, lookback_hours::bigint as lookback_hours, use_time_encoding,
  round_even(mae, 6) as mae, round_even(rmse, 6) as rmse, round_even(r2, 6) as r2, round_even(nrmse, 6) as nrmse,
  round_even(train_time_sec, 6) as train_time_sec, test_samples::bigint as test_samples, best_epoch::bigint as best_epoch,
  param_count::bigint as param_count, status, error"""


def _shown(results):
    whole = ["lookback_hours", "test_samples", "best_epoch", "param_count"]
    rounded = ["mae", "rmse", "r2", "nrmse", "train_time_sec"]
    return results.withColumns(
        {**{c: F.col(c).cast("long") for c in whole}, **{c: half_even(c, 6) for c in rounded}}
    )


@query("results_roundtrip", Q.chain(Q.RESULTS) + f"select {_RESULT_OUT} from results")
def results_roundtrip(spark, folder):
    path = shared_folder(spark)
    made = X.results(spark, folder)
    append_results(made.filter("status = 'SUCCESS'"), path)
    append_results(made.filter("status <> 'SUCCESS'"), path)
    return _shown(read_results(spark, path))


@query(
    "results_union",
    Q.chain(Q.RESULTS)
    + f"select {_RESULT_OUT} from (select * from results union all select * replace (null as status) from results where status = 'SUCCESS')",
)
def results_union(spark, folder):
    made = X.results(spark, folder)
    return _shown(union_results(made, made.filter("status = 'SUCCESS'").drop("status")))


@query(
    "summary_row",
    Q.chain(Q.RESULTS)
    + """select plant_id, experiment_name, model, use_hist_weather, use_forecast, past_days::bigint as past_days,
  coalesce(complexity, 'low') as model_complexity, 'high' as correlation_level, use_time_encoding,
  lookback_hours::bigint as past_hours, 24::bigint as future_hours, round_even(rmse * rmse, 6) as mse, round_even(rmse, 6) as rmse,
  round_even(mae, 6) as mae, round_even(r2, 6) as r_square, round_even(train_time_sec, 6) as train_time_sec,
  null::double as inference_time_sec, param_count::bigint as param_count, test_samples::bigint as samples_count
 from results where status = 'SUCCESS'""",
)
def summary_row(spark, folder):
    rows = R.summary_rows(X.results(spark, folder).filter("status = 'SUCCESS'"))
    whole = ["past_days", "past_hours", "future_hours", "param_count", "samples_count"]
    rounded = ["mse", "rmse", "mae", "r_square", "train_time_sec"]
    return rows.withColumns({**{c: F.col(c).cast("long") for c in whole}, **{c: half_even(c, 6) for c in rounded}})


_ABLATION = """plant_id, model, use_pv, use_hist_weather, use_forecast, 'all_weather' as weather_category, use_time_encoding,
  past_days::bigint as past_days, complexity as model_complexity, 15::bigint as epochs, 32::bigint as batch_size,
  0.001::double as learning_rate, use_ideal_nwp, round_even(train_time_sec, 4) as train_time_sec, 0::double as inference_time_sec,
  param_count::bigint as param_count, test_samples::bigint as samples_count, best_epoch::double as best_epoch,
  null::double as final_lr, round_even(rmse * rmse, 4) as mse, round_even(rmse, 4) as rmse, round_even(mae, 4) as mae,
  round_even(nrmse, 4) as nrmse, round_even(r2, 4) as r_square, null::double as smape, 0::bigint as gpu_memory_used"""


def _ablation(spark, folder):
    absent = {"weather_category": F.lit("all_weather"), "epochs": F.lit(None).cast("int"),
              "batch_size": F.lit(None).cast("int"), "learning_rate": F.lit(None).cast("double")}
    rows = R.ablation_table(X.results(spark, folder).filter("status = 'SUCCESS'").withColumns(absent))
    whole = ["past_days", "epochs", "batch_size", "param_count", "samples_count", "gpu_memory_used"]
    return rows.withColumns({c: F.col(c).cast("long") for c in whole})


@query("ablation_table", Q.chain(Q.RESULTS) + f"select {_ABLATION} from results where status = 'SUCCESS'")
def ablation_table(spark, folder):
    return _ablation(spark, folder)


_KEYS = ["plant_id", *R.ABLATION_KEY]


@query(
    "dedup_append",
    Q.chain(Q.RESULTS)
    + f""", abl as (select {_ABLATION} from results where status = 'SUCCESS'),
 old as (select * from abl where not use_ideal_nwp and past_days < 3),
 fresh as (select * exclude rn from (select *, row_number() over (partition by {', '.join(_KEYS)}
     order by param_count, mae, rmse, use_ideal_nwp) as rn from abl) f
   where rn = 1 and not exists (select 1 from old o where {' and '.join(f'o.{k} is not distinct from f.{k}' for k in _KEYS)}))
 select {', '.join(_KEYS)}, use_ideal_nwp, mae, rmse from old union all
 select {', '.join(_KEYS)}, use_ideal_nwp, mae, rmse from fresh""",
)
def dedup_append(spark, folder):
    shown = [*_KEYS, "use_ideal_nwp", "mae", "rmse"]
    rows = _ablation(spark, folder).select(*shown, "param_count")
    old = rows.filter(~F.col("use_ideal_nwp") & (F.col("past_days") < 3)).select(*shown)
    return append_new(old, rows, _KEYS, "param_count", "mae", "rmse", "use_ideal_nwp")


@query(
    "legacy_exp_id",
    Q.chain(Q.RESULTS)
    + """select distinct plant_id, model || '_pv' || use_pv::varchar || '_hist' || use_hist_weather::varchar || '_fcst' || use_forecast::varchar
  || '_all_weather_' || case when use_time_encoding then 'time' else 'notime' end
  || case when past_days = 0 then '_nohist' else '_days' || past_days end
  || case when model = 'Linear' then '' else '_comp' || complexity end as exp_id from results where status = 'SUCCESS'""",
)
def legacy_exp_id(spark, folder):
    rows = _ablation(spark, folder)
    return rows.select("plant_id", recorded_experiment_id({k: k for k in R.ABLATION_KEY}).alias("exp_id")).distinct()


_M = ["mae", "rmse", "r2", "nrmse"]


@query(
    "agg_results",
    Q.chain(Q.RESULTS)
    + f", r as (select * replace (rmse / (mae + 40) as nrmse) from results where status = 'SUCCESS') select model, {Q.mean_std(_M)} from r group by model",
)
def agg_results(spark, folder):
    return R.aggregate_results(X.results(spark, folder).withColumn("mean_true", F.col("mae") + 40), "model")


_PARTS = 4


@query(
    "agg_results_stored",
    Q.chain(Q.RESULTS)
    + f", r as (select * replace (rmse / (mae + 40) as nrmse) from results where status = 'SUCCESS') select model, {Q.mean_std(_M)} from r group by model",
)
def agg_results_stored(spark, folder):
    """The aggregate per model from moments of batches of plants, one of them added twice."""
    results = store(X.results(spark, folder).withColumn("mean_true", F.col("mae") + 40))
    path = shared_folder(spark)
    for part in [*range(_PARTS), 0]:
        some = results.filter(F.col("plant_id").cast("long") % _PARTS == part)
        R.add_to_aggregate(some, path, "model", "complexity", batch=f"plants-{part}")
    discard(results)
    return R.stored_aggregate(spark, path, "model")


@query(
    "agg_overall",
    Q.chain(Q.RESULTS)
    + " union all ".join(
        f"select '{m}' as metric, round_even(avg({m}), 2) as mean, round_even(stddev_samp({m}), 2) as std from results where status = 'SUCCESS'"
        for m in _M
    ),
)
def agg_overall(spark, folder):
    return R.aggregate_results(X.results(spark, folder))


@query(
    "ordered_models",
    Q.chain(Q.RESULTS)
    + f"""select model, list_position({K.MODEL_ORDER!r}, model)::bigint as model_rank, count(*) as n_results, round_even(avg(mae), 2) as mae
 from results where status = 'SUCCESS' group by model""",
)
def ordered_models(spark, folder):
    found = X.results(spark, folder).filter("status = 'SUCCESS'").groupBy("model").agg(
        F.count(F.lit(1)).alias("n_results"), half_even(F.avg("mae"), 2).alias("mae")
    )
    return found.withColumn("model_rank", model_rank().cast("long")).orderBy("model_rank")


@query(
    "ordered_tiers",
    Q.chain(Q.RESULTS)
    + f"""select scenario, lookback_hours::bigint as lookback_hours, complexity, list_position({K.COMPLEXITY_LEVELS!r}, complexity)::bigint as level_rank,
  list_position({list(K.SCENARIOS)!r}, scenario)::bigint as scenario_rank, round_even(avg(mae), 2) as mae
 from results where status = 'SUCCESS' and complexity is not null group by scenario, lookback_hours, complexity""",
)
def ordered_tiers(spark, folder):
    found = (
        X.results(spark, folder)
        .filter("status = 'SUCCESS' and complexity is not null")
        .groupBy("scenario", F.col("lookback_hours").cast("long").alias("lookback_hours"), "complexity")
        .agg(half_even(F.avg("mae"), 2).alias("mae"))
    )
    return found.withColumns(
        {
            "level_rank": rank_in(K.COMPLEXITY_LEVELS, "complexity").cast("long"),
            "scenario_rank": rank_in(list(K.SCENARIOS), "scenario").cast("long"),
        }
    ).orderBy("scenario_rank", "lookback_hours", "level_rank")


_BEST = "select plant_id, experiment_name, round_even(mae, 6) as mae from results where status = 'SUCCESS'"


@query("best_config", Q.chain(Q.RESULTS) + f"{_BEST} order by results.mae, plant_id, experiment_name limit 1")
def best_config(spark, folder):
    return R.best_configuration(X.results(spark, folder)).withColumn("mae", half_even("mae", 6))


@query(
    "best_config_per_plant",
    Q.chain(Q.RESULTS) + f"{_BEST} qualify row_number() over (partition by plant_id order by results.mae, experiment_name) = 1",
)
def best_config_per_plant(spark, folder):
    return R.best_configuration(X.results(spark, folder), "plant_id").withColumn("mae", half_even("mae", 6))


_PRESET_ROWS = ", ".join(
    [f"('tree', '{lv}', {t}, {d}, {r}, null)" for lv, (t, d, r) in K.TREE_PRESETS.items()]
    + [f"('deep', '{lv}', null, null, 0.001, {e})" for lv, (e, *_) in K.DEEP_PRESETS.items()]
)


@query(
    "complexity_presets",
    Q.chain(Q.PLANTS)
    + f"""select p.plant_id, m.model, v.complexity, v.trees::double as n_estimators, v.depth::double as max_depth, v.rate::double as learning_rate,
   v.epochs::double as epochs
 from plants p, (values ('RF', 'tree'), ('XGB', 'tree'), ('LGBM', 'tree'), ('LSTM', 'deep'), ('GRU', 'deep'), ('Transformer', 'deep'), ('TCN', 'deep')) m(model, family)
 join (values {_PRESET_ROWS}) v(family, complexity, trees, depth, rate, epochs) on v.family = m.family""",
)
def complexity_presets(spark, folder):
    base = G.study_grid(X.plants(spark, folder).select("plant_id"), K.DEEP_MODELS + K.TREE_MODELS)
    levels = G.add_presets(G.vary(base.drop("complexity"), "complexity", K.COMPLEXITY_LEVELS))
    take = lambda k: F.col("params")[k].alias(k)
    return levels.select("plant_id", "model", "complexity", *[take(k) for k in ("n_estimators", "max_depth", "learning_rate", "epochs")])


_DEEP_NAMES = ["d_model", "hidden_dim", "num_layers", *[k for k in K.DEEP_SHARED if k != "learning_rate"]]
_ALL_PRESETS = ", ".join(
    [
        f"('tree', '{lv}', {t}, {d}, {r}, {K.RANDOM_SEED}, -1, null, {', '.join('null' for _ in _DEEP_NAMES)}, null)"
        for lv, (t, d, r) in K.TREE_PRESETS.items()
    ]
    + [
        f"('deep', '{lv}', null, null, {K.DEEP_SHARED['learning_rate']}, null, null, {e}, {w}, {h}, {n}, "
        + ", ".join(str(K.DEEP_SHARED[k]) for k in _DEEP_NAMES[3:])
        + f", '{','.join(map(str, c))}')"
        for lv, (e, w, h, n, c) in K.DEEP_PRESETS.items()
    ]
)
_PRESET_NAMES = ["n_estimators", "max_depth", "learning_rate", "random_state", "verbosity", "epochs", *_DEEP_NAMES]


@query(
    "complexity_presets_all",
    Q.chain(Q.PLANTS)
    + f"""select p.plant_id, m.model, v.complexity, {', '.join(f'v.{k}::double as {k}' for k in _PRESET_NAMES)}, v.channels
 from plants p, (values ('RF', 'tree'), ('XGB', 'tree'), ('LGBM', 'tree'), ('LSTM', 'deep'), ('GRU', 'deep'), ('Transformer', 'deep'), ('TCN', 'deep')) m(model, family)
 join (values {_ALL_PRESETS}) v(family, complexity, {', '.join(_PRESET_NAMES)}, channels) on v.family = m.family""",
)
def complexity_presets_all(spark, folder):
    """Every parameter of the presets, and the channel widths."""
    base = G.study_grid(X.plants(spark, folder).select("plant_id"), K.DEEP_MODELS + K.TREE_MODELS)
    levels = G.add_presets(G.vary(base.drop("complexity"), "complexity", K.COMPLEXITY_LEVELS))
    channels = F.array_join(F.col("tcn_channels").cast("array<string>"), ",").alias("channels")
    return levels.select("plant_id", "model", "complexity", *[F.col("params")[k].alias(k) for k in _PRESET_NAMES], channels)


@query(
    "param_whitelist",
    Q.chain(Q.GRID)
    + """select plant_id, experiment_name, case model when 'RF' then 'max_depth,n_estimators,random_state'
   when 'XGB' then 'learning_rate,max_depth,n_estimators,verbosity' when 'LGBM' then 'learning_rate,max_depth,n_estimators,random_state'
   else '' end as kept, case when model = 'Linear' then 0 when complexity = 'low' then 10 else 30 end::bigint as n_estimators
 from grid where model in ('RF', 'XGB', 'LGBM', 'Linear')""",
)
def param_whitelist(spark, folder):
    grid = G.add_presets(G.experiment_grid(X.plants(spark, folder).select("plant_id")))
    own = grid.filter(F.col("model").isin([*K.TREE_MODELS, K.LINEAR_MODEL]))
    kept = own.withColumn("kept", F.coalesce(G.keep_allowed("params"), F.create_map().cast("map<string,double>")))
    return kept.select(
        "plant_id",
        "experiment_name",
        F.array_join(F.array_sort(F.map_keys("kept")), ",").alias("kept"),
        F.coalesce(F.col("kept")["n_estimators"], F.lit(0)).cast("long").alias("n_estimators"),
    )


@query(
    "study_grid",
    Q.chain(Q.PLANTS)
    + f"""select plant_id, model, 'high' as complexity, model <> 'Linear' as use_pv, false as use_hist_weather, true as use_forecast,
  case when model = 'Linear' then 0 else 24 end::bigint as lookback_hours, model = 'Linear' as forecast_only
 from plants, (values {', '.join(f"('{m}')" for m in K.MODEL_ORDER)}) m(model)""",
)
def study_grid(spark, folder):
    grid = G.label_scenarios(G.study_grid(X.plants(spark, folder).select("plant_id")))
    return grid.select(
        "plant_id", "model", "complexity", "use_pv", "use_hist_weather", "use_forecast",
        F.col("lookback_hours").cast("long").alias("lookback_hours"), "forecast_only",
    )


@query(
    "custom_study",
    Q.chain(Q.PLANTS)
    + """select plant_id, model, h::bigint as lookback_hours, model || '_' || h || 'h' as experiment_name
 from plants, (values ('RF'), ('Linear')) m(model), (values (48), (96)) l(h)""",
)
def custom_study(spark, folder):
    def modify(grid):
        longer = G.vary(grid.drop("lookback_hours"), "lookback_hours", [48, 96], "long")
        name = F.concat("model", F.lit("_"), F.col("lookback_hours").cast("string"), F.lit("h"))
        return longer.withColumn("experiment_name", name)

    grid = G.custom_study(X.plants(spark, folder).select("plant_id"), ["RF", "Linear"], modify)
    return grid.select("plant_id", "model", "lookback_hours", "experiment_name")


@query(
    "epoch_cum_time",
    Q.chain(Q.LOSSES)
    + """select plant_id, experiment_name, epoch::bigint as epoch, round_even(sum(epoch_time) over (partition by plant_id, experiment_name order by epoch), 4) as cum_time from losses""",
)
def epoch_cum_time(spark, folder):
    return E.cumulative_time(X.losses(spark, folder)).select(
        "plant_id", "experiment_name", F.col("epoch").cast("long").alias("epoch"), half_even("cum_time", 4).alias("cum_time")
    )


@query(
    "best_epoch",
    Q.chain(Q.LOSSES)
    + """select plant_id, experiment_name, epoch::bigint as best_epoch, round_even(val_loss, 8) as best_loss from losses
 qualify row_number() over (partition by plant_id, experiment_name order by val_loss, epoch) = 1""",
)
def best_epoch(spark, folder):
    return E.best_epochs(X.losses(spark, folder)).select(
        "plant_id", "experiment_name", F.col("best_epoch").cast("long").alias("best_epoch"),
        half_even("best_loss", 8).alias("best_loss"),
    )


_PLACED_LOSSES = """with recursive losses_base as (select 1), """ + Q.LOSSES + """,
placed as (select *, row_number() over (partition by plant_id, experiment_name order by epoch) as rn,
   count(*) over (partition by plant_id, experiment_name) as n from losses)"""


@query(
    "early_stop_epoch",
    _PLACED_LOSSES
    + """, walk(plant_id, experiment_name, rn, n, epoch, best, waited) as (
   select plant_id, experiment_name, rn, n, epoch, val_loss, 0 from placed where rn = 1
   union all
   select p.plant_id, p.experiment_name, p.rn, p.n, p.epoch,
     case when p.val_loss < w.best - cast(0.001 as double) then p.val_loss else w.best end,
     case when p.val_loss < w.best - cast(0.001 as double) then 0 else w.waited + 1 end
   from walk w join placed p on p.plant_id = w.plant_id and p.experiment_name = w.experiment_name and p.rn = w.rn + 1
   where w.waited < 10)
 select plant_id, experiment_name, max(epoch)::bigint as stop_epoch, max(n)::bigint as n_epochs from walk group by plant_id, experiment_name""",
)
def early_stop_epoch(spark, folder):
    return E.early_stops(X.losses(spark, folder)).select(
        "plant_id", "experiment_name", F.col("stop_epoch").cast("long").alias("stop_epoch"),
        F.col("n_epochs").cast("long").alias("n_epochs"),
    )


@query(
    "final_lr",
    _PLACED_LOSSES
    + """, walk(plant_id, experiment_name, rn, n, best, bad, rate) as (
   select plant_id, experiment_name, rn, n, val_loss, 0, cast(0.001 as double) from placed where rn = 1
   union all
   select plant_id, experiment_name, rn, n, case when better then val_loss else best end, case when worse > 5 then 0 else worse end,
     case when worse > 5 and rate - greatest(rate * 0.5::double, 1e-7::double) > 1e-8::double then greatest(rate * 0.5::double, 1e-7::double) else rate end
   from (select p.plant_id, p.experiment_name, p.rn, p.n, p.val_loss, w.best, w.rate,
       p.val_loss < w.best * (1 - 1e-4::double) as better,
       case when p.val_loss < w.best * (1 - 1e-4::double) then 0 else w.bad + 1 end as worse
     from walk w join placed p on p.plant_id = w.plant_id and p.experiment_name = w.experiment_name and p.rn = w.rn + 1) s)
 select plant_id, experiment_name, round_even(rate, 10) as final_lr from walk where rn = n""",
)
def final_lr(spark, folder):
    return E.final_rates(X.losses(spark, folder)).withColumn("final_lr", half_even("final_lr", 10))
