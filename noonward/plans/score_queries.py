"""Forecast tables, scores, aggregates, pivots, studies and models."""

import re

from pyspark.sql import functions as F

from noonward import constants as K
from noonward.functions import metrics as M
from noonward.functions.columns import half_even
from noonward.operators import evaluate as V
from noonward.operators import splits as S
from noonward.operators import windows as W
from noonward.operators.gram import Level, first_ranges, fit_levels, sums_by_rank
from noonward.operators.lagged import fit_sliding, sliding_hours
from noonward.operators.linear import fit_one_feature
from noonward.operators.prepare import FeaturePlan, plan_features, prepare, scaled_hours
from noonward.plans import experiments as E
from noonward.plans import fixtures as X
from noonward.plans import reports as R
from noonward.plans import sql as Q
from noonward.plans import studies as U
from noonward.plans.registry import query
from noonward.session import store

_KEYS = ["plant_id", "model"]


def _rounded(frame, places, *cols):
    return frame.withColumns({c: half_even(c, places) for c in cols})


@query(
    "predictions_long",
    Q.chain(Q.FORECASTS)
    + """select plant_id, model, sample_idx, date, horizon::bigint as horizon, forecast_datetime, round_even(y_true, 6) as y_true,
  round_even(y_pred, 6) as y_pred from forecasts""",
    text="date forecast_datetime",
)
def predictions_long(spark, folder):
    rows = X.forecasts(spark, folder).withColumn("horizon", F.col("horizon").cast("long"))
    return _rounded(rows.drop("experiment_name", "n_samples"), 6, "y_true", "y_pred")


@query(
    "predictions_sliding",
    Q.chain(Q.GAPPY, Q.kept("gappy"))
    + """, placed as (select *, row_number() over (partition by plant_id order by dt) - 1 as pos, count(*) over (partition by plant_id) as n from kept),
 ends as (select s.plant_id, s.pos - 24 as sample_idx, e.dt as end_dt, s.pos from placed s join placed e
   on e.plant_id = s.plant_id and e.pos = s.pos + 23 where s.pos >= 24)
 select e.plant_id, e.sample_idx, h::bigint as horizon, e.end_dt - (23 - h) * interval 1 hour as forecast_datetime,
   x."Hour"::bigint as hour, round_even(x.capacity_factor, 6) as y_true
 from ends e, range(24) t(h) join placed x on x.plant_id = e.plant_id and x.pos = e.pos + h""",
    text="forecast_datetime",
)
def predictions_sliding(spark, folder):
    prepared = prepare(X.gappy_hours(spark, folder), FeaturePlan([K.TARGET], [], False))
    samples = W.sliding_samples(prepared, 24, 24, scaled=False)
    long = samples.select(
        "plant_id", "sample_idx", "end_dt", F.posexplode(F.arrays_zip("hours", "y_true")).alias("horizon", "v")
    )
    return long.select(
        "plant_id",
        "sample_idx",
        F.col("horizon").cast("long").alias("horizon"),
        V.stamps_from_end("end_dt", "horizon").alias("forecast_datetime"),
        F.col("v.hours").cast("long").alias("hour"),
        half_even("v.y_true", 6).alias("y_true"),
    )


_RECORDED = """select p.plant_id, m.model, case when p.size % 2 = 0 then 'all_weather' end as weather_category, m.hours as lookback_hours,
  m.hours div 24 as past_days, 'level' || p.size % 4 as complexity, true as use_pv, p.size % 3 = 0 as use_hist_weather,
  m.hours > 24 as use_forecast, p.size % 5 = 0 as use_time_encoding, false as use_ideal_nwp, '[' || m.model || ']' as selected_weather_features,
  p.size % 50 + 1 as epochs, m.hours % 64 as batch_size, p.size / cast(1000 as double) as learning_rate, p.size / cast(7 as double) as train_time_sec,
  p.size / cast(70 as double) as inference_time_sec, p.size * m.hours as param_count, p.size % 50 as best_epoch, p.size / cast(10000 as double) as final_lr,
  p.size % 11 as gpu_memory_used from plants p, m where m.model = 'mean3' or p.size % 3 > 0"""


@query(
    "season_hour_record",
    Q.chain(Q.FORECASTS, Q.PLANTS, "m(model, hours) as (values ('persist', 24), ('mean3', 72))", f"s as ({_RECORDED.replace(' div ', ' // ')})")
    + f""", f as (select plant_id, model, avg((y_true - y_pred) * (y_true - y_pred)) as mse, {Q.RMSE} as rmse, {Q.MAE} as mae,
   {Q.R2} as r2, count(distinct sample_idx) as n from forecasts group by plant_id, model)
 select f.plant_id, f.model, coalesce(weather_category, 'unknown') as weather_level, coalesce(lookback_hours, 24)::bigint as lookback_hours,
  replace(coalesce(complexity, 'unknown'), 'level', '') as complexity_level, '80%' as dataset_scale, coalesce(use_pv, false) as use_pv,
  coalesce(use_hist_weather, false) as use_hist_weather, coalesce(use_forecast, false) as use_forecast,
  coalesce(use_time_encoding, false) as use_time_encoding, coalesce(use_ideal_nwp, false) as use_ideal_nwp, coalesce(past_days, 1)::bigint as past_days,
  coalesce(selected_weather_features, '[]') as selected_weather_features, coalesce(epochs, 0)::bigint as epochs, coalesce(batch_size, 0)::bigint as batch_size,
  coalesce(learning_rate, 0) as learning_rate, round_even(coalesce(train_time_sec, 0), 4) as train_time_sec,
  round_even(coalesce(inference_time_sec, 0), 4) as inference_time_sec, coalesce(param_count, 0)::bigint as param_count, n as samples_count,
  coalesce(best_epoch, 0)::bigint as best_epoch, coalesce(final_lr, 0) as final_lr, round_even(mse, 4) as mse, round_even(rmse, 4) as rmse,
  round_even(mae, 4) as mae, round_even(rmse / (mae + 1e-8::double) * 100, 4) as nrmse, round_even(r2, 4) as r_square,
  round_even(2 * mae / (mae + 1e-8::double) * 100, 4) as smape, coalesce(gpu_memory_used, 0)::bigint as gpu_memory_used,
  'season_hour_' || lower(f.model) || '.yaml' as config_file from f left join s on s.plant_id = f.plant_id and s.model = f.model""",
)
def season_hour_record(spark, folder):
    """All fields of the season and hour record, from recorded settings and figures that some plants lack."""
    plants = X.plants(spark, folder)
    models = F.explode(F.array(F.struct(F.lit("persist").alias("model"), F.lit(24).alias("hours")), F.struct(F.lit("mean3").alias("model"), F.lit(72).alias("hours"))))
    source = plants.withColumn("m", models)
    picked = _RECORDED[len("select ") : _RECORDED.index(" from plants")]
    settings = source.alias("p").filter("m.model = 'mean3' or p.size % 3 > 0").selectExpr(*_expressions(picked))
    rows = R.season_hour_summary(X.forecasts(spark, folder), settings)
    whole = [f.name for f in rows.schema if f.dataType.simpleString() == "int"]
    return rows.withColumns({c: F.col(c).cast("long") for c in whole})


def _expressions(text: str) -> list[str]:
    """The items of a select list without commas inside of them."""
    return [part.strip() for part in text.split(",")]


@query(
    "season_hour_predictions",
    Q.chain(Q.FORECASTS)
    + """select strftime(forecast_datetime, '%Y-%m-%d %H:%M:%S') as date, round_even(y_true, 6) as ground_truth,
  round_even(y_pred, 6) as prediction, model, plant_id as project_id, sample_idx as window_index, horizon::bigint as hour from forecasts""",
)
def season_hour_predictions(spark, folder):
    rows = R.season_hour_forecasts(X.forecasts(spark, folder)).withColumn("hour", F.col("hour").cast("long"))
    return _rounded(rows, 6, "ground_truth", "prediction")


@query(
    "season_hour_summary",
    Q.chain(Q.FORECASTS)
    + f""", f as (select plant_id, model, avg((y_true - y_pred) * (y_true - y_pred)) as mse, {Q.RMSE} as rmse, {Q.MAE} as mae,
   {Q.R2} as r2, count(distinct sample_idx) as n from forecasts group by plant_id, model)
 select plant_id, model, 'unknown' as weather_level, 24::bigint as lookback_hours, 'unknown' as complexity_level,
  '80%' as dataset_scale, false as use_pv, 1::bigint as past_days, n as samples_count, round_even(mse, 4) as mse, round_even(rmse, 4) as rmse,
  round_even(mae, 4) as mae, round_even(rmse / (mae + 1e-8::double) * 100, 4) as nrmse, round_even(r2, 4) as r_square,
  round_even(2 * mae / (mae + 1e-8::double) * 100, 4) as smape, 'season_hour_' || lower(model) || '.yaml' as config_file from f""",
)
def season_hour_summary(spark, folder):
    no_settings = spark.createDataFrame(
        [],
        "plant_id string, model string, weather_category string, lookback_hours int, complexity string, use_pv boolean, "
        "use_hist_weather boolean, use_forecast boolean, use_time_encoding boolean, use_ideal_nwp boolean",
    )
    rows = R.season_hour_summary(X.forecasts(spark, folder), no_settings)
    whole = {c: F.col(c).cast("long") for c in ("lookback_hours", "past_days")}
    return rows.withColumns(whole).select(
        "plant_id", "model", "weather_level", "lookback_hours", "complexity_level", "dataset_scale", "use_pv", "past_days",
        "samples_count", "mse", "rmse", "mae", "nrmse", "r_square", "smape", "config_file",
    )


_GAPS = "gaps as (select * replace (case when not (horizon = 3 and sample_idx % 11 = 0) then y_pred end as y_pred) from forecasts)"


@query(
    "metrics_flat",
    Q.chain(Q.FORECASTS, _GAPS)
    + f"""select plant_id, model, round_even({Q.MAE}, 4) as mae, round_even({Q.RMSE}, 4) as rmse,
  round_even(avg((y_true - y_pred) * (y_true - y_pred)), 4) as mse, round_even({Q.NRMSE}, 4) as nrmse, round_even({Q.R2}, 4) as r2,
  round_even(avg(case when y_true > 0 or y_pred > 0 then 2 * abs(y_true - y_pred) / nullif(abs(y_true) + abs(y_pred), 0) end), 4) as smape
 from gaps where y_pred is not null group by plant_id, model""",
)
def metrics_flat(spark, folder):
    gap = (F.col("horizon") == 3) & (F.col("sample_idx") % 11 == 0)
    rows = X.forecasts(spark, folder).withColumn("y_pred", F.when(~gap, F.col("y_pred")))
    return rows.groupBy(*_KEYS).agg(*M.flat_metrics())


@query("metrics_daily_avg", Q.chain(Q.FORECASTS, Q.daily("plant_id, model")) + "select plant_id, model, mae, rmse, r2, n_days from daily")
def metrics_daily_avg(spark, folder):
    return V.daily_metrics(X.forecasts(spark, folder), *_KEYS).select(*_KEYS, "mae", "rmse", "r2", "n_days")


@query(
    "result_row",
    Q.chain(Q.FORECASTS, Q.daily("plant_id, model"))
    + """select plant_id, model, mae, rmse, r2, round_even(rmse * rmse, 6) as mse, round_even(rmse / nullif(range_true, 0), 6) as nrmse,
  samples as test_samples, 0::bigint as best_epoch, 'SUCCESS' as status from daily""",
)
def result_row(spark, folder):
    scores = V.experiment_metrics(X.forecasts(spark, folder), *_KEYS)
    return scores.select(
        *_KEYS, "mae", "rmse", "r2", half_even("mse", 6).alias("mse"), half_even("nrmse", 6).alias("nrmse"),
        F.col("samples").alias("test_samples"), F.lit(0).cast("long").alias("best_epoch"), F.lit("SUCCESS").alias("status"),
    )


def _study_sql(keys, source="forecasts", places=6):
    return f"""select {keys}, round_even({Q.MAE}, {places}) as mae, round_even({Q.RMSE}, {places}) as rmse,
  round_even({Q.R2}, {places}) as r2, round_even({Q.NRMSE}, {places}) as nrmse, count(*) as samples from {source} group by {keys}"""


_SEASON = """seasons as (select *, case when month(date) between 3 and 5 then 'Spring' when month(date) between 6 and 8 then 'Summer'
  when month(date) between 9 and 11 then 'Fall' else 'Winter' end as season from forecasts)"""
_HOURS = "hours as (select * exclude horizon, horizon::bigint as hour from forecasts)"


@query("metrics_by_season", Q.chain(Q.FORECASTS, _SEASON) + _study_sql("plant_id, model, season", "seasons"))
def metrics_by_season(spark, folder):
    return _rounded(U.by_season(X.forecasts(spark, folder), *_KEYS), 6, "mae", "rmse", "r2", "nrmse")


@query("metrics_by_hour", Q.chain(Q.FORECASTS, _HOURS) + _study_sql("plant_id, model, hour", "hours"))
def metrics_by_hour(spark, folder):
    rows = U.by_hour(X.forecasts(spark, folder), *_KEYS).withColumn("hour", F.col("hour").cast("long"))
    return _rounded(rows, 6, "mae", "rmse", "r2", "nrmse")


_TIER_PLAN = plan_features("NWP", "all_weather", time_encoding=False)
_TIERS = ",\n".join(
    [
        Q.DENSE,
        Q.kept(),
        Q.clean([], _TIER_PLAN.fcst),
        Q.scaled(_TIER_PLAN.fcst),
        Q.numbered(0),
        "tiers as ("
        + " union all ".join(
            f"""select s.plant_id, 'blend' as model, '{t}' as feature_tier, s.sample_idx, x.y_true,
    greatest(least((({' + '.join('x.' + w + '_pred' for w in K.WEATHER_CATEGORIES[c])}) / {len(K.WEATHER_CATEGORIES[c])}) * (x.hi - x.lo) + x.lo, 100.0), 0.0) as y_pred
    from samples s join scaled x on x.plant_id = s.plant_id and x.date = s.date"""
            for t, c in K.FEATURE_TIERS.items()
        )
        + ")",
    ]
)


@query("metrics_by_tier", Q.chain(_TIERS) + _study_sql("plant_id, model, feature_tier", "tiers"))
def metrics_by_tier(spark, folder):
    return _rounded(U.by_tier(X.tier_forecasts(spark, folder), *_KEYS), 6, "mae", "rmse", "r2", "nrmse")


_M = ["mae", "rmse", "r2", "nrmse"]


def _agg_sql(dimension, detail):
    by = ", ".join(filter(None, [dimension, "model"]))
    return f"select {by}, {Q.mean_std(_M)}, count(*) as n_plants from ({detail}) group by {by}"


_AGG_SEASON = Q.chain(Q.FORECASTS, _SEASON) + _agg_sql("season", _study_sql("plant_id, model, season", "seasons", 15))
_AGG_HOUR = Q.chain(Q.FORECASTS, _HOURS) + _agg_sql("hour", _study_sql("plant_id, model, hour", "hours", 15))


def _agg_season(spark, folder):
    return R.aggregate_over_plants(U.by_season(X.forecasts(spark, folder), *_KEYS), "season", "model")


def _agg_hour(spark, folder):
    rows = U.by_hour(X.forecasts(spark, folder), *_KEYS).withColumn("hour", F.col("hour").cast("long"))
    return R.aggregate_over_plants(rows, "hour", "model")


@query("agg_seasonal", _AGG_SEASON)
def agg_seasonal(spark, folder):
    return _agg_season(spark, folder)


@query("agg_hourly", _AGG_HOUR)
def agg_hourly(spark, folder):
    return _agg_hour(spark, folder)


@query("agg_tier", Q.chain(_TIERS) + _agg_sql("feature_tier", _study_sql("plant_id, model, feature_tier", "tiers", 15)))
def agg_tier(spark, folder):
    scores = U.by_tier(X.tier_forecasts(spark, folder), *_KEYS)
    return R.aggregate_over_plants(scores, "feature_tier", "model")


_MODELS = ["persist", "mean3"]


@query(
    "pivot_mae",
    f"""select season, max(mae_mean) filter (model = 'persist') as persist, max(mae_mean) filter (model = 'mean3') as mean3
 from ({_AGG_SEASON}) group by season""",
)
def pivot_mae(spark, folder):
    return R.pivot_models(_agg_season(spark, folder), "season", "mae_mean", _MODELS)


_CELL = "case when rmse_std is not null then printf('%.2f', rmse_mean) || '±' || printf('%.2f', rmse_std) else printf('%.2f', rmse_mean) end"


@query(
    "pivot_formatted",
    f"""select hour, coalesce(max({_CELL}) filter (model = 'persist'), 'N/A') as persist,
  coalesce(max({_CELL}) filter (model = 'mean3'), 'N/A') as mean3, 'N/A' as "Linear" from ({_AGG_HOUR}) group by hour""",
)
def pivot_formatted(spark, folder):
    return R.pivot_formatted(_agg_hour(spark, folder), "hour", "rmse", [*_MODELS, "Linear"])


@query(
    "hourly_summary_chosen",
    f"""select hour, max(mae_mean) as mean3, cast(null as double) as "Linear" from ({_AGG_HOUR}) where model in ('mean3', 'Linear') group by hour""",
)
def hourly_summary_chosen(spark, folder):
    """A choice of models that leaves one of the table's out."""
    chosen = ["mean3", "Linear"]
    return R.pivot_models(_agg_hour(spark, folder).filter(F.col("model").isin(chosen)), "hour", "mae_mean", chosen)


_CHOSEN = ["persist", "mean3", "Linear"]


@query(
    "hourly_summary",
    f"""select hour, {", ".join(f"max(mae_mean) filter (model = '{m}') as {m}" for m in _MODELS)}, cast(null as double) as "Linear"
  from ({_AGG_HOUR}) where model in ('persist', 'mean3', 'Linear') group by hour""",
)
def hourly_summary(spark, folder):
    chosen = _agg_hour(spark, folder).filter(F.col("model").isin(_CHOSEN))
    return R.pivot_models(chosen, "hour", "mae_mean", _CHOSEN)


@query(
    "multi_horizon",
    Q.chain(Q.FORECASTS)
    + f""", aligned as (select a.plant_id, a.model, a.horizon + 1 as h, b.y_true, a.y_pred from forecasts a join forecasts b
   on b.plant_id = a.plant_id and b.model = a.model and b.sample_idx = a.sample_idx + a.horizon and b.horizon = 0
   where a.horizon + 1 in (1, 3, 6, 12, 24))
 select plant_id, model, h::bigint as h, round_even({Q.MAE}, 6) as mae, round_even({Q.RMSE}, 6) as rmse, count(*) as n_samples
 from aligned group by plant_id, model, h""",
)
def multi_horizon(spark, folder):
    return V.hours_ahead(X.forecasts(spark, folder)).groupBy(*_KEYS, F.col("h").cast("long").alias("h")).agg(
        half_even(M.mae(), 6).alias("mae"), half_even(M.rmse(), 6).alias("rmse"), F.count(F.lit(1)).alias("n_samples")
    )


def _daily_study_sql(dimension, ctes, source):
    keys = ", ".join(filter(None, ["plant_id", "model", dimension]))
    by = ", ".join(filter(None, [dimension, "model"]))
    return (
        Q.chain(ctes, Q.daily(keys, source))
        + f"""select {by}, {Q.mean_std(['mae', 'rmse', 'r2'])}, round_even(avg(flat_nrmse), 2) as nrmse_mean,
  round_even(stddev_samp(flat_nrmse), 2) as nrmse_std, count(*) as n_plants from daily group by {by}"""
    )


def _daily_study(rows, dimension=None):
    keys = [*_KEYS, *([dimension] if dimension else [])]
    scores = V.study_daily_metrics(rows, *keys)
    return R.aggregate_over_plants(scores, *[k for k in (dimension, "model") if k])


_LOOKBACK = ",\n".join(
    [Q.DENSE, Q.kept()]
    + [Q.mean_past(h // 24, f"m{h}") for h in K.STUDY_LOOKBACKS]
    + [
        "lookbacks as ("
        + " union all ".join(
            f"select * replace ('mean' as model), {h}::bigint as lookback_hours from f_m{h}" for h in K.STUDY_LOOKBACKS
        )
        + ")"
    ]
)


@query("study_lookback", _daily_study_sql("lookback_hours", _LOOKBACK, "lookbacks"))
def study_lookback(spark, folder):
    prepared = prepare(X.stored_hours(spark, folder, weather=False), FeaturePlan([K.TARGET], [], False))
    made = None
    for hours in K.STUDY_LOOKBACKS:
        samples = W.daily_samples(prepared, hours, scaled=False).withColumns(
            {"model": F.lit("mean"), "lookback_hours": F.lit(hours).cast("long")}
        )
        long = V.long_forecasts(samples, V.mean_of_past_days(hours // 24), "model", "lookback_hours")
        made = long if made is None else made.unionByName(long)
    return _daily_study(made, "lookback_hours")


_DAYS = ",\n".join(
    [
        Q.DENSE,
        Q.kept(),
        Q.numbered(1, "kept"),
        """days as (select s.plant_id, s.sample_idx, s.n_samples, y."Hour" as horizon, y.capacity_factor as y_true
  from samples s join kept y on y.plant_id = s.plant_id and y.date = s.date)""",
    ]
)


def _means_sql(source, out, *extra):
    keys = ", ".join(["plant_id", *extra, "horizon"])
    return f"""{out} as (select t.*, m.y_pred from {source} t
  join (select {keys}, avg(y_true) as y_pred from {source} where part = 'train' group by {keys}) m using ({keys}) where t.part = 'test')"""


_SHUFFLED_DAYS = """ranks as (select plant_id, sample_idx, row_number() over (partition by plant_id order by md5('42:' || sample_idx)) - 1 as rnk from samples)"""
_COMPLEX = ",\n".join(
    [
        _DAYS,
        _SHUFFLED_DAYS,
        f"parted as (select d.*, {Q.part('r.rnk', 'd.n_samples')} as part from days d join ranks r using (plant_id, sample_idx))",
        _means_sql("parted", "climate"),
        "levels as ("
        + " union all ".join(
            f"select * replace (y_pred * (1 - pow(1 - {r}::double, {t})) as y_pred), 'boosted' as model, '{c}' as complexity from climate"
            for c, (t, _, r) in K.TREE_PRESETS.items()
        )
        + ")",
    ]
)


@query("study_complexity", _daily_study_sql("complexity", _COMPLEX, "levels"))
def study_complexity(spark, folder):
    """Stand-in model: an hourly mean approached in n steps of the learning rate."""
    prepared = prepare(X.stored_hours(spark, folder, weather=False), FeaturePlan([K.TARGET], [], False))
    samples = W.daily_samples(prepared, 24, scaled=False, split=S.daily_part(shuffle=True))
    means = X.hourly_means(V.long_forecasts(samples, "y_true", "part").drop("y_pred"))
    levels = [
        F.struct(F.lit(c).alias("complexity"), F.lit(float(t)).alias("trees"), F.lit(r).alias("rate"))
        for c, (t, _, r) in K.TREE_PRESETS.items()
    ]
    spread = means.withColumn("p", F.explode(F.array(*levels)))
    share = 1 - F.pow(1 - F.col("p.rate"), F.col("p.trees"))
    rows = spread.withColumns({"y_pred": F.col("y_pred") * share, "model": F.lit("boosted"), "complexity": F.col("p.complexity")})
    return _daily_study(rows, "complexity")


_SCALES = ",\n".join(
    [
        _DAYS,
        "scales as ("
        + " union all ".join(
            f"select *, '{n}' as training_scale, {Q.part('sample_idx', 'n_samples', r)} as part from days"
            for n, r in K.TRAINING_SCALES.items()
        )
        + ")",
        _means_sql("scales", "scaled_means", "training_scale"),
        "scale_rows as (select *, 'hourly' as model from scaled_means)",
    ]
)


@query("study_scale", _daily_study_sql("training_scale", _SCALES, "scale_rows"))
def study_scale(spark, folder):
    scales = [
        F.struct(F.lit(n).alias("training_scale"), S.part_of("sample_idx", "n_samples", r).alias("part"))
        for n, r in K.TRAINING_SCALES.items()
    ]
    days = X.target_days(spark, folder).withColumn("s", F.explode(F.array(*scales))).select("*", "s.*").drop("s")
    return _daily_study(X.hourly_means(days, "training_scale").withColumn("model", F.lit("hourly")), "training_scale")


_SEQUENTIAL = ",\n".join(
    [
        Q.FORECASTS,
        f"parts as (select *, {Q.part('sample_idx', 'n_samples')} as part from forecasts)",
        "tests as (select * from parts where part = 'test')",
    ]
)


#: Over plants, of the daily metrics; the RMSE that nRMSE is taken from is that over all pairs.
_AGG_DAILY = f"""select model, {Q.mean_std(['mae', 'rmse', 'r2', 'nrmse'])}, count(*) as n_plants from (
  select * exclude flat_nrmse, case when range_true = 0 then 'inf'::double else flat_nrmse end as nrmse from daily)"""


def _sequential_test(spark, folder):
    rows = X.forecasts(spark, folder)
    return rows.withColumn("part", S.part_of("sample_idx", "n_samples")).filter("part = 'test'")


@query("study_no_shuffle", _daily_study_sql("", _SEQUENTIAL, "tests"))
def study_no_shuffle(spark, folder):
    return _daily_study(_sequential_test(spark, folder))


@query(
    "agg_no_shuffle",
    Q.chain(_SEQUENTIAL, Q.daily("plant_id, model", "tests")) + _AGG_DAILY + " group by model",
)
def agg_no_shuffle(spark, folder):
    return R.aggregate_over_plants(V.study_daily_metrics(_sequential_test(spark, folder), *_KEYS), "model")


_SLIDING = ",\n".join(
    [
        Q.DENSE,
        Q.kept(),
        """placed as (select *, row_number() over (partition by plant_id order by dt) - 1 as pos, count(*) over (partition by plant_id) as n from kept),
slides as (select s.plant_id, 'persist' as model, s.pos - 24 as sample_idx, s.n - 47 as n_samples, y.capacity_factor as y_true, x.capacity_factor as y_pred
  from placed s join placed y on y.plant_id = s.plant_id and y.pos between s.pos and s.pos + 23
  join placed x on x.plant_id = s.plant_id and x.pos = y.pos - 24 where s.pos >= 24 and s.pos + 24 <= s.n)""",
        f"slide_tests as (select * from slides where {Q.part('sample_idx', 'n_samples')} = 'test')",
    ]
)


def _sliding_test(spark, folder):
    prepared = prepare(X.stored_hours(spark, folder, weather=False), FeaturePlan([K.TARGET], [], False))
    samples = W.sliding_samples(prepared, 24, 24, scaled=False, split=S.hourly_part(shuffle=False)).filter("part = 'test'")
    yesterday = F.transform("x_hist", lambda x: x[0])
    return V.long_forecasts(samples.withColumn("model", F.lit("persist")), yesterday, "model")


@query("study_sliding", _daily_study_sql("", _SLIDING, "slide_tests"))
def study_sliding(spark, folder):
    return _daily_study(_sliding_test(spark, folder))


@query(
    "agg_sliding",
    Q.chain(_SLIDING, Q.daily("plant_id, model", "slide_tests"))
    + _AGG_DAILY.replace("count(*)", "avg(n_days) as avg_windows, count(*)")
    + " group by model",
)
def agg_sliding(spark, folder):
    scores = V.study_daily_metrics(_sliding_test(spark, folder), *_KEYS, days="n_days")
    return R.aggregate_over_plants(scores, "model", windows="n_days")


@query(
    "feature_counts",
    Q.chain(Q.DENSE, Q.kept(), Q.clean([], _TIER_PLAN.fcst), Q.numbered(1))
    + " union all ".join(
        f"select plant_id, '{s}' as scenario, max({n})::bigint as param_count, count(*) as n_samples from samples group by plant_id"
        for s, n in (("PV+NWP", 24 + 24 * 11), ("NWP", 24 + 24 * 11))
    ),
)
def feature_counts(spark, folder):
    hours, made = X.stored_hours(spark, folder), None
    for scenario in ("PV+NWP", "NWP"):
        plan = plan_features(scenario, "all_weather", time_encoding=False)
        samples = W.daily_samples(prepare(hours, plan), 24)
        counts = samples.groupBy("plant_id", F.lit(scenario).alias("scenario")).agg(
            F.max(F.size(W.flatten_sample())).cast("long").alias("param_count"), F.count(F.lit(1)).alias("n_samples")
        )
        made = counts if made is None else made.unionByName(counts)
    return made


_OLS_PLAN = plan_features("NWP", "solar_irradiance_only", time_encoding=False)


@query(
    "ols_simple",
    Q.chain(Q.DENSE, Q.kept(), Q.clean([], _OLS_PLAN.fcst), Q.scaled(_OLS_PLAN.fcst))
    + """select plant_id, "Hour"::bigint as horizon, round_even(regr_slope(capacity_factor, global_tilted_irradiance_pred), 6) as slope,
  round_even(regr_intercept(capacity_factor, global_tilted_irradiance_pred), 6) as intercept, count(*) as n from scaled group by plant_id, "Hour\"""",
)
def ols_simple(spark, folder):
    rows = scaled_hours(prepare(X.stored_hours(spark, folder), _OLS_PLAN)).withColumn("horizon", F.col("Hour").cast("long"))
    fitted = fit_one_feature(rows, ["plant_id", "horizon"], "global_tilted_irradiance_pred", K.TARGET)
    return _rounded(fitted, 6, "slope", "intercept")


@query("ols_multi")
def ols_multi(spark, folder):
    """Forecasts of the four linear experiments."""
    experiments = E.linear_grid()
    return E.forecasts_of(E.run_fits(X.stored_hours(spark, folder), experiments), experiments)


@query("ols_sliding")
def ols_sliding(spark, folder):
    """Forecasts of the linear model on hourly sliding samples."""
    experiments = [E.base_experiment(K.LINEAR_MODEL, sliding=True)]
    return E.forecasts_of(E.run_fits(X.stored_hours(spark, folder), experiments), experiments)


_TWO_PLAN = plan_features("PV+NWP", "solar_irradiance_only", time_encoding=False)
_TWO = [K.LAG_FEATURE, *_TWO_PLAN.fcst]
_TWO_SQL = Q.chain(Q.DENSE, Q.kept(), Q.clean(_TWO_PLAN.hist, _TWO_PLAN.fcst), Q.scaled(_TWO), f"""placed as (
  select plant_id, row_number() over w - 1 as sample_idx, count(*) over (partition by plant_id) - 1 as n_samples,
    lag({_TWO[0]}) over w as a, {_TWO[1]} as b, capacity_factor as y from scaled window w as (partition by plant_id order by dt)
), train as (
  select * from placed where a is not null and sample_idx - 1 < cast(floor(n_samples * cast(0.8 as double)) as bigint)
), m as (
  select plant_id, count(*) as n, var_pop(a) as aa, var_pop(b) as bb, covar_pop(a, b) as ab, covar_pop(a, y) as ay, covar_pop(b, y) as by_,
    avg(a) as ma, avg(b) as mb, avg(y) as my from train group by plant_id
), w as (select *, (ay * bb - by_ * ab) / (aa * bb - ab * ab) as wa, (by_ * aa - ay * ab) / (aa * bb - ab * ab) as wb from m)""") + """
select plant_id, n, round_even(wa, 6) as w_past, round_even(wb, 6) as w_ahead, round_even(my - wa * ma - wb * mb, 6) as intercept from w"""


@query("ols_sliding_two", _TWO_SQL)
def ols_sliding_two(spark, folder):
    """Weights of the hour before and of the forecast, from sliding samples of one hour."""
    prepared = prepare(X.stored_hours(spark, folder), _TWO_PLAN)
    rows, shape = sliding_hours(prepared, 1, 1, S.hourly_part(shuffle=False))
    weights, _ = fit_sliding(store(rows), shape, "two")
    trained = rows.filter("part = 'train' and in_own_block").groupBy("plant_id").agg(F.count(F.lit(1)).alias("n"))
    names = [F.col("weights")[i].alias(c) for i, c in enumerate(("intercept", "w_past", "w_ahead"))]
    return _rounded(weights.join(trained, "plant_id").select("plant_id", "n", *names), 6, "intercept", "w_past", "w_ahead")


@query("run_experiment")
def run_experiment(spark, folder):
    return E.run_experiments(X.stored_hours(spark, folder), E.linear_grid())


def _linear_rows_sql():
    """What each linear experiment of the grid must report, from the numbers of its samples."""
    parts, ctes = [], []
    for e in E.linear_grid():
        plan = plan_features(e.scenario, e.weather_category, e.time_encoding)
        weather = [c for c in plan.fcst if c not in K.TIME_FEATURES]
        name = f"n_{len(parts)}"
        body = f"{Q.clean([], weather)}, {Q.numbered(0)}"
        for word in ("lagged", "clean", "present", "hits", "samples"):
            body = re.sub(rf"\b{word}\b", f"{word}_{len(parts)}", body)
        ctes.append(f"{body}, {name} as (select plant_id, count(*) as n from samples_{len(parts)} group by plant_id)")
        parts.append(
            f"select plant_id, '{e.experiment_name}' as experiment_name, '{e.scenario}' as scenario, {24 * len(plan.fcst)} as width,"
            f" coalesce(n, 0) as n from (select distinct plant_id from dense) left join {name} using (plant_id)"
        )
    ctes.append(f"runs as ({' union all '.join(parts)})")
    ctes.append(
        "sized as (select *, cast(floor(n * cast(0.8 as double)) as bigint) as n_train,"
        " n - cast(floor(n * cast(0.8 as double)) as bigint) - cast(floor(n * cast(0.1 as double)) as bigint) as n_test from runs)"
    )
    ok = "n_train > 0 and n_test > 0"
    return Q.chain(Q.DENSE, Q.kept(), *ctes) + (
        f"select plant_id, experiment_name, case when {ok} then scenario else 'FAILED' end as scenario,"
        f" case when {ok} then 'SUCCESS' else 'FAILED' end as status, cast(case when {ok} then 24 * n_test else 0 end as bigint) as test_samples,"
        f" cast(case when {ok} then width else 0 end as bigint) as param_count, {ok} as in_range from sized"
    )


@query("run_experiment_rows", _linear_rows_sql())
def run_experiment_rows(spark, folder):
    """Names, states and sizes of the linear runs, and whether all their forecasts lie within 0 and 100."""
    experiments, hours = E.linear_grid(), X.stored_hours(spark, folder)
    fits = E.run_fits(hours, experiments)
    rows = E.results_of(hours.select("plant_id").distinct(), fits, experiments)
    within = F.min(F.col("y_pred").between(0.0, 100.0)).alias("in_range")
    told = E.forecasts_of(fits, experiments).groupBy("plant_id", "experiment_name").agg(within)
    return rows.join(told, ["plant_id", "experiment_name"], "left").select(
        "plant_id",
        "experiment_name",
        "scenario",
        "status",
        F.col("test_samples").cast("long").alias("test_samples"),
        F.col("param_count").cast("long").alias("param_count"),
        F.coalesce("in_range", F.lit(False)).alias("in_range"),
    )


def _trees(spark, folder, *models):
    return E.run_experiments(X.stored_hours(spark, folder), [E.base_experiment(m) for m in models])


@query("rf_forecast")
def rf_forecast(spark, folder):
    return _trees(spark, folder, "RF")


@query("gbt_forecast")
def gbt_forecast(spark, folder):
    return _trees(spark, folder, "XGB")


@query("lgbm_forecast")
def lgbm_forecast(spark, folder):
    return _trees(spark, folder, "LGBM")


@query("study_tiers_linear")
def study_tiers_linear(spark, folder):
    return U.run_study(X.stored_hours(spark, folder), "weather_feature_adoption", [K.LINEAR_MODEL])[1]


#: The hour whose forecast and target the levels below look at.
_NOON = 12
_NOON_SQL = Q.chain(
    Q.DENSE,
    Q.kept(),
    Q.clean([], _OLS_PLAN.fcst),
    Q.scaled(_OLS_PLAN.fcst),
    Q.numbered(0),
    f"""days as (
  select s.plant_id, s.sample_idx, s.n_samples, r.{_OLS_PLAN.fcst[0]} as x, r.capacity_factor as y
  from samples s join scaled r on r.plant_id = s.plant_id and r.date = s.date and r."Hour" = {_NOON})""",
    "levels as ("
    + " union all ".join(
        f"select *, '{n}' as training_scale, cast(floor(n_samples * cast({r} as double)) as bigint) as n_train from days"
        for n, r in K.TRAINING_SCALES.items()
    )
    + ")",
)


def _noon_samples(spark, folder):
    prepared = prepare(X.stored_hours(spark, folder), _OLS_PLAN)
    return E.flat_samples(W.daily_samples(prepared, 0, split=S.daily_rank(F.lit(False))), "rank", "n_samples")


@query(
    "scale_sums",
    _NOON_SQL
    + """select plant_id, training_scale, count(*) as n, round_even(sum(x), 6) as sum_x, round_even(sum(y), 6) as sum_y,
  round_even(sum(x * x), 6) as sum_xx, round_even(sum(x * y), 6) as sum_xy from levels where sample_idx < n_train group by plant_id, training_scale""",
)
def scale_sums(spark, folder):
    """What each training share has of the table of sums, for one feature and one target."""
    table = store(sums_by_rank(_noon_samples(spark, folder), list(K.TRAINING_SCALES.values())))
    side = F.col("width") + K.HOURS_PER_DAY + 1
    x, y = F.lit(_NOON + 1), F.col("width") + 1 + _NOON
    cells = {"sum_x": x, "sum_y": y, "sum_xx": x * side + x, "sum_xy": x * side + y}
    parts = None
    for name, share in K.TRAINING_SCALES.items():
        own = first_ranges(table, share).filter("n > 0")
        made = own.select("plant_id", F.lit(name).alias("training_scale"), "n", *[F.get("sums", at).alias(c) for c, at in cells.items()])
        parts = made if parts is None else parts.unionByName(made)
    return _rounded(parts, 6, *cells)


@query(
    "scale_lines",
    _NOON_SQL.rstrip()
    + """, fitted as (
  select plant_id, training_scale, coalesce(regr_slope(y, x), 0) as slope, coalesce(regr_intercept(y, x), avg(y)) as start
  from levels where sample_idx < n_train group by plant_id, training_scale)
select plant_id, training_scale, sample_idx, round_even(start + slope * x, 6) as y_pred from levels join fitted using (plant_id, training_scale)
where sample_idx >= n_train + cast(floor(n_samples * cast(0.1 as double)) as bigint)""",
)
def scale_lines(spark, folder):
    """Forecasts of a line through each training share, all from one pass over the samples."""
    levels = [Level(n, (_NOON,), r) for n, r in K.TRAINING_SCALES.items()]
    fits = fit_levels(_noon_samples(spark, folder), levels).filter("error is null")
    shown = fits.select("plant_id", F.col("experiment_name").alias("training_scale"), "sample_idx", F.col("y_pred")[_NOON].alias("y_pred"))
    return _rounded(shown, 6, "y_pred")


def _trained(study):
    def run(spark, folder):
        return U.run_study(X.stored_hours(spark, folder), study, [K.LINEAR_MODEL])[0]

    return run


for _name, _study in (
    ("study_seasonal_linear", "seasonal_effect"),
    ("study_hourly_linear", "hourly_effect"),
    ("study_scale_linear", "training_scale"),
    ("study_no_shuffle_linear", "no_shuffle"),
    ("study_sliding_linear", "dataset_extension"),
):
    query(_name)(_trained(_study))


def _tree_levels_sql(dimension: str, days: dict) -> str:
    """Test samples per plant and level of a study on trees, from the numbers of its samples; `days` back by level."""
    fcst, ctes, parts = plan_features("PV+NWP", "all_weather", False).fcst, [], []
    for i, past in enumerate(sorted(set(days.values()))):
        body = Q.numbered(past)
        for word in ("present", "hits", "samples"):
            body = re.sub(rf"\b{word}\b", f"{word}_{i}", body)
        ctes.append(body)
        parts += [
            f"select plant_id, '{level}' as {dimension}, count(*) as n from samples_{i} group by plant_id" for level, d in days.items() if d == past
        ]
    test = "n - cast(floor(n * cast(0.8 as double)) as bigint) - cast(floor(n * cast(0.1 as double)) as bigint)"
    rows = f"select plant_id, {dimension}, {test} as test_samples from ({' union all '.join(parts)}) where floor(n * cast(0.8 as double)) > 0"
    whole = Q.chain(Q.DENSE, Q.kept(), Q.clean(["capacity_factor_hist"], fcst), *ctes)
    return whole + f"select plant_id, 'RF' as model, {dimension}, 24 * test_samples as test_samples, true as in_range from ({rows}) where test_samples > 0"


def _tree_levels(study):
    """What each trained level has forecast, and whether its scores are finite and its errors within the scale."""

    def run(spark, folder):
        dimension = U.DIMENSION[study]
        scores = U.run_study(X.stored_hours(spark, folder), study, ["RF"])[0]
        good = F.col("mae").between(0.0, 100.0) & (F.col("rmse") >= F.col("mae") - 1e-9) & F.col("r2").isNotNull()
        return scores.select("plant_id", "model", F.col(dimension).cast("string").alias(dimension), F.col("test_samples").cast("long").alias("test_samples"), good.alias("in_range"))

    return run


query("study_complexity_levels", _tree_levels_sql("complexity", {c: 1 for c in K.COMPLEXITY_LEVELS}))(_tree_levels("model_complexity"))
query("study_lookback_levels", _tree_levels_sql("lookback_hours", {h: h // 24 for h in K.STUDY_LOOKBACKS}))(_tree_levels("lookback_window"))


def _trained_trees(study):
    def run(spark, folder):
        return U.run_study(X.stored_hours(spark, folder), study, ["RF"])[1]

    return run


for _name, _study in (("study_complexity_trees", "model_complexity"), ("study_lookback_trees", "lookback_window")):
    query(_name)(_trained_trees(_study))
