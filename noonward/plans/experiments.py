"""Running experiments: samples, fits, forecasts and result rows of all plants at once."""

import json
import time
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.errors import IllegalArgumentException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noonward import constants as K
from noonward.functions.columns import all_present, clip_percent, half_even
from noonward.operators import windows as W
from noonward.operators.evaluate import experiment_metrics, long_forecasts
from noonward.operators.forests import fit_trees
from noonward.operators.gram import Level, fit_levels, places
from noonward.operators.lagged import fit_sliding, sliding_hours
from noonward.operators.linear import FIT_SCHEMA, KEY, fit_daily
from noonward.operators.prepare import FeaturePlan, Prepared, plan_features, plant_settings, prepare, unscale
from noonward.operators.splits import daily_part, daily_rank, hourly_part
from noonward.plans.grid import pending, settings_key, tree_params
from noonward.session import store, written
from noonward.sinks.tables import append_results, batch_of
from noonward.sources.results import as_results, read_results


TRAINED_MODELS = [*K.TREE_MODELS, K.LINEAR_MODEL]
_FIT_TYPES = [tuple(f.split()) for f in FIT_SCHEMA.split(", ")]


@dataclass(frozen=True)
class Experiment:
    """Settings of one experiment; the same for all plants."""

    model: str
    scenario: str
    complexity: str | None = "high"
    lookback_hours: int = 24
    time_encoding: bool = False
    weather_category: str = "all_weather"
    shuffle: bool = True
    seed: int = K.RANDOM_SEED
    train_ratio: float = K.TRAIN_RATIO
    val_ratio: float = K.VAL_RATIO
    sliding: bool = False
    #: Order of a shuffled split, see splits.ORDERS.
    order: str = "hash"
    start: str | None = K.DEFAULT_START
    end: str | None = K.DEFAULT_END
    name: str = ""
    tags: dict[str, str] = field(default_factory=dict)
    #: Fields that go before a plant's own settings, as for a study that varies them.
    insists: tuple[str, ...] = ()
    #: Parameters of a tree model that go before those of its complexity.
    params: dict[str, float] = field(default_factory=dict)
    #: Folder of fitted trees, by digest of samples and parameters: what is there is used again, what is not is added.
    registry: str | None = None

    def settings_for(self, settings: DataFrame | None) -> DataFrame | None:
        """A plant's settings without those that the experiment insists on."""
        if settings is None:
            return None
        names = {"start": "start_date", "end": "end_date", "shuffle": "shuffle_split", "seed": "random_seed"}
        return settings.drop(*[names.get(n, n) for n in self.insists])

    @property
    def sample_key(self) -> tuple:
        """Experiments with the same key have the same samples."""
        features = self.scenario, self.weather_category, self.time_encoding, self.start, self.end
        split = self.shuffle, self.seed, self.train_ratio, self.val_ratio, self.order
        return *features, self.lookback_hours, self.sliding, *split, self.insists

    @property
    def experiment_name(self) -> str:
        if self.name:
            return self.name
        features = f"{self.scenario}_{self.lookback_hours}h" if self.lookback_hours else self.scenario
        parts = [self.model, self.complexity, features, "TE" if self.time_encoding else "noTE"]
        return "_".join(p for p in parts if p)


def linear_grid() -> list[Experiment]:
    """The linear experiments of the grid."""
    return [
        Experiment(K.LINEAR_MODEL, s, None, 0, te) for s in K.FORECAST_ONLY_SCENARIOS for te in (True, False)
    ]


def tree_grid(model: str) -> list[Experiment]:
    """The grid experiments of a tree model."""
    choices = [(s, h) for s in K.POWER_SCENARIOS for h in K.GRID_LOOKBACKS] + [
        (s, 0) for s in K.FORECAST_ONLY_SCENARIOS
    ]
    return [
        Experiment(model, s, level, hours, te)
        for level in K.GRID_COMPLEXITIES
        for s, hours in choices
        for te in (True, False)
    ]


def base_experiment(model: str, **changes) -> Experiment:
    """Study default: power and forecast with one day back; the linear model uses the forecast alone."""
    base = Experiment(model, "NWP", lookback_hours=0) if model == K.LINEAR_MODEL else Experiment(model, "PV+NWP")
    return replace(base, **changes)


def prepare_for(
    hours: DataFrame, experiments: list[Experiment], settings: DataFrame | None = None
) -> dict[tuple, Prepared]:
    """Prepared hours per sample key.

    Which rows are kept depends only on the dates and the forecast columns that must be filled, so
    experiments that agree on these share one preparation with the columns of all of them (three for
    the whole grid). It is stored where several sample sets are cut from it.
    """
    groups: dict[tuple, dict[tuple, FeaturePlan]] = {}
    owns: dict[tuple, DataFrame | None] = {}
    for e in experiments:
        plan = plan_features(e.scenario, e.weather_category, e.time_encoding, hours.columns)
        rows = frozenset(plan.fcst) - set(K.TIME_FEATURES), e.start, e.end, e.insists
        owns[rows] = e.settings_for(settings)
        groups.setdefault(rows, {})[e.sample_key] = plan
    made = {}
    for rows, plans in groups.items():
        _, start, end, _ = rows
        hist = dict.fromkeys(c for plan in plans.values() for c in plan.hist)
        fcst = dict.fromkeys(c for plan in plans.values() for c in plan.fcst)
        prepared = prepare(hours, FeaturePlan(list(hist), list(fcst), False), start, end, owns[rows])
        if len(plans) > 1:
            prepared = replace(prepared, hours=store(prepared.hours), spine=store(prepared.spine))
        made |= {key: replace(prepared, plan=plan) for key, plan in plans.items()}
    return made


def samples_of(
    prepared: Prepared, e: Experiment, skip: DataFrame | None = None, settings: DataFrame | None = None
) -> DataFrame:
    """Samples of all plants with flat features, scaled targets and the part each belongs to.

    Plants in `skip` are taken out of the day spine, so their rows go no further than the first join.
    """
    if skip is not None:
        prepared = replace(prepared, spine=prepared.spine.join(skip, "plant_id", "left_anti"))
    if e.sliding:
        split = hourly_part(e.shuffle, e.train_ratio, e.val_ratio, e.seed, settings=e.settings_for(settings), order=e.order)
        samples = W.sliding_samples(prepared, e.lookback_hours, split=split)
    else:
        split = daily_part(e.shuffle, e.train_ratio, e.val_ratio, e.seed, settings=e.settings_for(settings), order=e.order)
        samples = W.daily_samples(prepared, e.lookback_hours, split=split)
    return flat_samples(samples, "part")


def flat_samples(samples: DataFrame, *carried: str) -> DataFrame:
    """Samples with flat features and scaled targets."""
    return samples.select(
        "plant_id",
        "sample_idx",
        "date",
        "end_dt",
        *carried,
        W.flatten_sample().alias("features"),
        W.scaled_target().alias("y"),
        "y_true",
        F.col(f"lo_{K.TARGET}").alias("lo"),
        F.col(f"hi_{K.TARGET}").alias("hi"),
    )


def families(experiments: list[Experiment], hours: DataFrame) -> list[list[Experiment]]:
    """Daily linear experiments that differ only in columns and training share, two or more together.

    In each family one plan has the columns of all, and is that of the first member.
    """
    found: dict[tuple, list[Experiment]] = {}
    for e in experiments:
        if e.model == K.LINEAR_MODEL and not e.sliding:
            found.setdefault((e.scenario, e.lookback_hours, e.start, e.end, e.shuffle, e.seed, e.order), []).append(e)
    out = []
    for same in found.values():
        plans = {e.experiment_name: _plan(e, hours) for e in same}
        same = sorted(same, key=lambda e: -len(plans[e.experiment_name].all_columns))
        whole = plans[same[0].experiment_name]
        nested = all(set(p.hist) <= set(whole.hist) and set(p.fcst) <= set(whole.fcst) for p in plans.values())
        # without a history the samples hold zeros in its place
        if len(same) > 1 and nested and (not same[0].lookback_hours or (whole.hist and not whole.forecast_only)):
            out.append(same)
    return out


def _plan(e: Experiment, hours: DataFrame) -> FeaturePlan:
    return plan_features(e.scenario, e.weather_category, e.time_encoding, hours.columns)


def fit_family(hours: DataFrame, same: list[Experiment]) -> tuple[DataFrame, DataFrame | None]:
    """Fits of a family from one set of samples, and the plants it cannot serve, if there may be any.

    Those are plants with hours that one member keeps and another drops, because a forecast that only the latter
    uses is missing there: their sample days differ.
    """
    plans = [_plan(e, hours) for e in same]
    first, whole = same[0], plans[0]
    forecasts = [[c for c in p.fcst if c not in K.TIME_FEATURES] for p in plans]
    shared = [c for c in forecasts[0] if all(c in f for f in forecasts)]
    odd, even = None, hours
    if len(shared) < len(forecasts[0]):
        differs = F.col(K.TARGET).isNotNull() & all_present(shared) & ~all_present(forecasts[0])
        odd = store(hours.filter(differs).select("plant_id").distinct())
        even = hours.join(odd, "plant_id", "left_anti")
    prepared = prepare(even, whole, first.start, first.end)
    split = daily_rank(F.lit(first.shuffle), first.seed, first.order)
    samples = flat_samples(W.daily_samples(prepared, first.lookback_hours, split=split), "rank", "n_samples")
    levels = [
        Level(e.experiment_name, places(whole, p, first.lookback_hours), e.train_ratio, e.val_ratio) for e, p in zip(same, plans)
    ]
    return fit_levels(samples, levels), odd


def sliding_fit(
    prepared: Prepared, e: Experiment, skip: DataFrame | None = None, settings: DataFrame | None = None
) -> DataFrame:
    """Forecasts of a linear experiment on sliding samples; plants in `skip` are left out as in samples_of."""
    if skip is not None:
        prepared = replace(prepared, spine=prepared.spine.join(skip, "plant_id", "left_anti"))
    split = hourly_part(e.shuffle, e.train_ratio, e.val_ratio, e.seed, settings=e.settings_for(settings), order=e.order)
    rows, shape = sliding_hours(prepared, e.lookback_hours, K.HOURS_PER_DAY, split)
    return fit_sliding(store(rows), shape, e.experiment_name)[1]


def _in_percent(fit: DataFrame) -> DataFrame:
    """Bring forecasts back by the plant's extremes and keep them within 0 and 100."""
    lo, hi = F.col("lo"), F.col("hi")
    restored = F.transform("y_pred", lambda p: clip_percent(unscale(p, lo, hi)))
    return fit.withColumn("y_pred", restored).drop("lo", "hi")


def _named(samples: DataFrame, e: Experiment) -> DataFrame:
    return samples.withColumn("experiment_name", F.lit(e.experiment_name))


def _fit_trees(samples: DataFrame, e: Experiment) -> DataFrame:
    """Forecasts of a tree experiment; if it cannot be fitted, one row per plant with the reason."""
    started = time.perf_counter()
    try:
        fit, _ = fit_trees(samples, e.model, tree_params(e.complexity or "high") | e.params, registry=e.registry)
    except (ValueError, IllegalArgumentException) as problem:  # becomes a failed result
        blank = samples.select("plant_id").distinct()
        error = F.lit(str(problem))
        values = {c: F.lit(None) for c in ("sample_idx", "date", "end_dt", "y_true", "y_pred", "lo", "hi")}
        spent, width, share = 0.0, F.lit(0), F.lit(0.0)
    else:
        blank, error = fit, F.lit(None)
        values = {c: F.col(c) for c in ("sample_idx", "date", "end_dt", "y_true", "y_pred", "lo", "hi")}
        spent, width, share = time.perf_counter() - started, F.size("features"), F.col("inference_time_sec")
    values |= {"param_count": width, "train_time_sec": F.lit(spent), "inference_time_sec": share, "error": error}
    return _named(blank, e).select(*KEY, *[values[c].cast(t).alias(c) for c, t in _FIT_TYPES if c not in KEY])


def _fit(
    hours: DataFrame, experiments: list[Experiment], done: DataFrame | None = None, settings: DataFrame | None = None
) -> Iterable[DataFrame]:
    """Fits of all experiments; samples used by several tree fits are built once and stored.

    Linear fits leave out the plants that are done. Tree models learn from all plants, so they are
    fitted on all as long as one is left. Daily linear experiments that differ only in columns and training share
    are fitted together.
    """
    by_key: dict[tuple, list[Experiment]] = {}
    linear: list[DataFrame] = []
    if settings is None:
        for same in families(experiments, hours):
            fits, odd = fit_family(hours, same)
            yield _in_percent(fits if done is None else fits.join(done, KEY, "left_anti").select(*[c for c, _ in _FIT_TYPES]))
            experiments = [e for e in experiments if e not in same]
            if odd is not None and not odd.isEmpty():
                yield from _apart(hours.join(odd, "plant_id", "left_semi"), same, done)
    if not experiments:
        return
    for e in experiments:
        by_key.setdefault(e.sample_key, []).append(e)
    prepared = prepare_for(hours, experiments, settings)
    for same in by_key.values():
        own = prepared[same[0].sample_key]
        trees = [e for e in same if e.model in K.TREE_MODELS]
        if trees:
            samples = store(samples_of(own, trees[0], settings=settings))
            yield from (_in_percent(_fit_trees(samples, e)) for e in trees)
        for e in same:
            if e.model == K.LINEAR_MODEL:
                skip = None
                if done is not None:
                    skip = done.filter(F.col("experiment_name") == e.experiment_name).select("plant_id")
                if e.sliding:
                    yield _in_percent(sliding_fit(own, e, skip, settings))
                else:
                    linear.append(_named(samples_of(own, e, skip, settings), e))
    if linear:
        yield _in_percent(fit_daily(reduce(DataFrame.unionByName, linear)))


def _apart(hours: DataFrame, same: list[Experiment], done: DataFrame | None) -> Iterable[DataFrame]:
    """Fits of the members of a family one by one."""
    for e in same:
        yield from _fit(hours, [e], done)


def run_fits(
    hours: DataFrame, experiments: list[Experiment], done: DataFrame | None = None, settings: DataFrame | None = None
) -> DataFrame:
    """Forecasts of the test part, one row per sample, stored in the shared folder.

    A group that cannot be fitted gives one row with its error instead; models without a trainer give none.
    """
    own = [e for e in experiments if e.model in TRAINED_MODELS]
    if not own:
        kept = [c for c in FIT_SCHEMA.split(", ") if c.split()[0] not in ("lo", "hi")]
        return hours.sparkSession.createDataFrame([], ", ".join(kept))
    return store(reduce(DataFrame.unionByName, _fit(hours, own, done, settings)))


#: Settings of a plant, and the fields of an experiment that stand in for those it lacks.
_OWN = {
    "start_date": "start",
    "end_date": "end",
    "train_ratio": "train_ratio",
    "val_ratio": "val_ratio",
    "shuffle_split": "shuffle",
    "random_seed": "seed",
    "weather_category": "weather_category",
}


def _settings(work: DataFrame, experiments: list[Experiment], settings: DataFrame | None = None) -> DataFrame:
    """Each plant with each experiment, and the fingerprint of all settings that decide its result."""
    tags = list(dict.fromkeys(t for e in experiments for t in e.tags))
    known = settings is not None
    own = work.select("plant_id").distinct()
    if known:
        given = plant_settings(settings, *_OWN, "ml_params").withColumn("_ml_params", F.to_json("_ml_params") if "ml_params" in settings.columns else F.lit(None))
        own = own.join(given, "plant_id", "left")

    def fingerprint(e: Experiment) -> Column:
        used = [
            F.coalesce(F.col(f"_{name}").cast("string"), F.lit(getattr(e, f)).cast("string")) if known and not {name, f} & set(e.insists) else F.lit(getattr(e, f))
            for name, f in _OWN.items()
        ]
        params = F.lit(str(sorted(e.params.items())))
        if known and e.model in K.TREE_MODELS:
            params = F.coalesce("_ml_params", params)
        fixed = [e.model, e.complexity, e.scenario, e.lookback_hours, e.time_encoding, e.sliding, e.order]
        return settings_key(*used, *[F.lit(v) for v in fixed], params)

    rows = [
        F.struct(
            F.lit(e.experiment_name).alias("experiment_name"),
            F.lit(e.model).alias("model"),
            F.lit(e.complexity).cast("string").alias("complexity"),
            F.lit(e.scenario).alias("scenario"),
            F.lit(e.lookback_hours).alias("lookback_hours"),
            F.lit(e.time_encoding).alias("use_time_encoding"),
            fingerprint(e).alias("settings_key"),
            *[F.lit(e.tags.get(t)).cast("string").alias(t) for t in tags],
        )
        for e in experiments
    ]
    return own.select("plant_id", F.explode(F.array(*rows)).alias("e")).select("plant_id", "e.*")


def forecasts_of(fits: DataFrame, experiments: list[Experiment]) -> DataFrame:
    """The forecast table of a run."""
    names = F.create_map(*[F.lit(v) for e in experiments for v in (e.experiment_name, e.model)])
    good = fits.filter("error is null").withColumn("model", names[F.col("experiment_name")])
    return long_forecasts(good, "y_pred", "experiment_name", "model")


def results_of(
    plants: DataFrame, fits: DataFrame, experiments: list[Experiment], settings: DataFrame | None = None
) -> DataFrame:
    """One row per plant and experiment; those without a forecast are failures with their reason."""
    meta = fits.groupBy(*KEY).agg(
        F.max("param_count").alias("param_count"),
        F.max("train_time_sec").alias("seconds"),
        F.sum("inference_time_sec").alias("inference_time_sec"),
        F.max("error").alias("problem"),
    )
    scores = experiment_metrics(forecasts_of(fits, experiments), *KEY)
    work = _settings(plants, experiments, settings)
    joined = work.join(meta, KEY, "left").join(scores, KEY, "left")
    ok = F.col("mae").isNotNull()
    no_trainer = F.when(~F.col("model").isin(TRAINED_MODELS), F.concat(F.lit("no trainer for model "), "model"))
    return joined.withColumns(
        {
            "status": F.when(ok, "SUCCESS").otherwise("FAILED"),
            "scenario": F.when(ok, F.col("scenario")).otherwise("FAILED"),
            "train_time_sec": half_even(F.coalesce("seconds", F.lit(0.0)), 2),
            "inference_time_sec": F.coalesce("inference_time_sec", F.lit(0.0)),
            "test_samples": F.coalesce("samples", F.lit(0)),
            "best_epoch": F.lit(0),
            "param_count": F.coalesce("param_count", F.lit(0)),
            "error": F.when(~ok, F.coalesce("problem", no_trainer, F.lit("unable to create any valid samples"))),
        }
    ).drop("seconds", "problem")


def by_settings(
    hours: DataFrame, experiments: list[Experiment], plants: DataFrame, settings: DataFrame
) -> Iterable[tuple[DataFrame, DataFrame, list[Experiment]]]:
    """(plants with settings, their hours, their experiments) of each weather category and set of tree parameters.

    There are a few such groups; within one, every plant follows its own dates, ratios, shuffling and seed.
    """
    own = plants.join(settings, "plant_id", "left")
    if "weather_category" not in own.columns:
        own = own.withColumn("weather_category", F.lit(None).cast("string"))
    told = F.to_json("ml_params") if "ml_params" in own.columns and any(e.model in K.TREE_MODELS for e in experiments) else F.lit(None).cast("string")
    own = own.withColumn("_params", told)
    groups = [tuple(r) for r in own.select("weather_category", "_params").distinct().collect()]
    for category, params in sorted(groups, key=str):
        chosen = own.filter(F.col("weather_category").eqNullSafe(F.lit(category)) & F.col("_params").eqNullSafe(F.lit(params))).drop("_params")
        rows = hours.join(chosen.select("plant_id"), "plant_id", "left_semi")
        levels = json.loads(params) if params else {}
        free = [
            replace(
                e,
                name=e.experiment_name,
                weather_category=e.weather_category if category is None or "weather_category" in e.insists else category,
                params=e.params | (levels.get(e.complexity or "high") or {}),
            )
            for e in experiments
        ]
        yield chosen, rows, free


def run_experiments(
    hours: DataFrame,
    experiments: list[Experiment],
    plants: DataFrame | None = None,
    settings: DataFrame | None = None,
    done: DataFrame | None = None,
) -> DataFrame:
    """Result rows of all plants and experiments.

    `settings` has one row per plant: its dates, ratios, shuffling, seed, weather_category and ml_params (by complexity)
    go before those of an experiment, unless this insists on its own. Plants are run by weather category and tree
    parameters, of which there are a few. Linear fits leave out the plants and experiments in `done`.
    """
    plants = hours.select("plant_id").distinct() if plants is None else plants.select("plant_id")
    if settings is None:
        return as_results(results_of(plants, run_fits(hours, experiments, done), experiments))
    parts = []
    for chosen, rows, free in by_settings(hours, experiments, plants, settings):
        fits = run_fits(rows, free, done, settings=chosen)
        made = results_of(chosen.select("plant_id"), fits, free).drop("settings_key")
        keys = _settings(chosen.select("plant_id"), experiments, chosen).select(*KEY, "settings_key")
        parts.append(as_results(made.join(keys, KEY)))
    return reduce(DataFrame.unionByName, parts)


def _left(
    hours: DataFrame, experiments: list[Experiment], results: DataFrame | None, plants: DataFrame | None, settings: DataFrame | None
) -> tuple[DataFrame, DataFrame, list[Experiment], DataFrame]:
    """The plants, what is still to do, the experiments it takes and what is done."""
    plants = hours.select("plant_id").distinct() if plants is None else plants.select("plant_id")
    work = _settings(plants, experiments, settings).select(*KEY, "settings_key")
    todo = store(work if results is None else pending(work, results))
    names = {r[0] for r in todo.select("experiment_name").distinct().collect()}
    return plants, todo, [e for e in experiments if e.experiment_name in names], work.join(todo, KEY, "left_anti").select(*KEY)


def run_pending(
    hours: DataFrame,
    experiments: list[Experiment],
    results: DataFrame,
    plants: DataFrame | None = None,
    settings: DataFrame | None = None,
) -> DataFrame | None:
    """Result rows of what has no success yet; None when all is done.

    If the results tell the settings they were made with (settings_key), those made with others do not count.
    """
    plants, todo, left, done = _left(hours, experiments, results, plants, settings)
    if not left:
        return None
    return run_experiments(hours, left, plants, settings, done).join(todo.select(*KEY), KEY, "left_semi")


def run_saving(
    hours: DataFrame,
    experiments: list[Experiment],
    path: str,
    plants: DataFrame | None = None,
    settings: DataFrame | None = None,
) -> None:
    """Run experiments and append their rows to the results at `path` as they come.

    Experiments that share their samples are a group; its rows are saved before the next group starts. What has a
    success at `path` already, made with the same settings, is left out, so that a run that was broken off goes on
    where it ended. A batch is known by what it was to do: if its write is repeated, it replaces itself.
    """
    groups: dict[tuple, list[Experiment]] = {}
    for e in experiments:
        groups.setdefault((e.model in K.TREE_MODELS, e.sample_key), []).append(e)
    for same in groups.values():
        known = read_results(hours.sparkSession, path) if written(hours.sparkSession, path) else None
        all_plants, todo, left, done = _left(hours, same, known, plants, settings)
        if left:
            rows = run_experiments(hours, left, all_plants, settings, done).join(todo.select(*KEY), KEY, "left_semi")
            append_results(rows, path, batch_of(todo))


def modified(models: list[str], modify: Callable[[Experiment], Experiment] | None = None, **base) -> list[Experiment]:
    """The base experiment of each model after a user's change."""
    made = [base_experiment(m, **base) for m in models]
    return [modify(e) for e in made] if modify else made
