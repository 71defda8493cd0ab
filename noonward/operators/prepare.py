"""From hourly rows to clean, encoded and scaled features."""

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noonward import constants as K
from noonward.functions.columns import all_present, cyclic
from noonward.operators.timeline import DAY, previous_value, spine_of, summarize_days


@dataclass(frozen=True)
class FeaturePlan:
    """Columns a scenario uses: of the past, of the day to predict, and whether the past is left out."""

    hist: list[str]
    fcst: list[str]
    forecast_only: bool

    @property
    def all_columns(self) -> list[str]:
        return list(dict.fromkeys(self.hist + self.fcst))


def weather_columns(category: str) -> list[str]:
    if category not in K.WEATHER_CATEGORIES:
        raise ValueError(f"unknown weather category: {category}")
    return list(K.WEATHER_CATEGORIES[category])


def plan_features(
    scenario: str,
    weather_category: str = "all_weather",
    time_encoding: bool = True,
    available: Iterable[str] | None = None,
    no_hist_power: bool | None = None,
) -> FeaturePlan:
    """Columns of a scenario; those missing from `available` are left out."""
    if scenario not in K.SCENARIOS:
        raise ValueError(f"unknown scenario: {scenario}")
    pv, hist_weather, forecast, ideal = K.SCENARIOS[scenario]
    weather = weather_columns(weather_category)
    encoded = K.TIME_FEATURES if time_encoding else []
    hist = ([K.LAG_FEATURE] if pv else []) + (weather if hist_weather else []) + encoded
    ahead = weather if ideal else [w + K.FORECAST_SUFFIX for w in weather]
    fcst = ahead + encoded if forecast else []
    if available is not None:
        known = set(available) | {K.LAG_FEATURE, *K.TIME_FEATURES}
        hist = [c for c in hist if c in known]
        fcst = [c for c in fcst if c in known]
    if no_hist_power is None:
        no_hist_power = not pv and not hist_weather
    return FeaturePlan(hist, fcst, no_hist_power)


def plant_settings(settings: DataFrame, *names: str) -> DataFrame:
    """plant_id and the named settings, each as `_<name>`; those that the table lacks are empty."""
    given = set(settings.columns)
    own = [(F.col(n) if n in given else F.lit(None)).alias(f"_{n}") for n in names]
    return settings.select("plant_id", *own)


def keep_dated(
    hours: DataFrame,
    start: str | None = K.DEFAULT_START,
    end: str | None = K.DEFAULT_END,
    settings: DataFrame | None = None,
) -> DataFrame:
    """Rows with a target from the start day on, up to midnight at the beginning of the end day.

    With `settings` (one row per plant) a plant's own start_date and end_date go before `start` and `end`.
    """
    kept = hours.filter(F.col(K.TARGET).isNotNull())
    low, high = (F.lit(day).cast("string") for day in (start, end))
    if settings is not None:
        kept = kept.join(plant_settings(settings, "start_date", "end_date"), "plant_id", "left")
        low, high = F.coalesce("_start_date", low), F.coalesce("_end_date", high)
    if start or settings is not None:
        kept = kept.filter(F.coalesce(F.col("dt") >= low.cast("timestamp_ntz"), F.lit(True)))
    if end or settings is not None:
        kept = kept.filter(F.coalesce(F.col("dt") <= high.cast("timestamp_ntz"), F.lit(True)))
    return kept.select(*hours.columns)


def own_weather(hours: DataFrame, settings: DataFrame, category: str = "all_weather") -> DataFrame:
    """Hourly rows in which weather outside the plant's own weather_category is empty."""
    joined = hours.join(plant_settings(settings, "weather_category"), "plant_id", "left")
    own = F.coalesce("_weather_category", F.lit(category))
    present = [w for w in K.WEATHER if w in hours.columns]
    holding = {w: [c for c, names in K.WEATHER_CATEGORIES.items() if w in names] for w in present}
    masked = {w: F.when(own.isin(holding[w]), F.col(w)) for w in present}
    return joined.withColumns(masked).select(*hours.columns)


def encode_time(hours: DataFrame) -> DataFrame:
    month_cos, month_sin = cyclic("Month", 12)
    hour_cos, hour_sin = cyclic("Hour", 24)
    return hours.withColumns(
        {"month_cos": month_cos, "month_sin": month_sin, "hour_cos": hour_cos, "hour_sin": hour_sin}
    )


def clean_features(hours: DataFrame, plan: FeaturePlan) -> DataFrame:
    """Drop rows lacking a forecast or the target, then fill the gaps of the past with 0."""
    kept = hours.dropna(subset=[*plan.fcst, K.TARGET])
    return kept.fillna(0.0, subset=plan.hist) if plan.hist else kept


def scale(col: str) -> Column:
    """To [0, 1] by the plant's extremes; a constant column becomes 0."""
    spread = F.col(f"hi_{col}") - F.col(f"lo_{col}")
    return F.coalesce((F.col(col) - F.col(f"lo_{col}")) / F.nullif(spread, F.lit(0.0)), F.lit(0.0))


def unscale(scaled, lo, hi) -> Column:
    return scaled * (hi - lo) + lo


@dataclass(frozen=True)
class Prepared:
    """Clean rows, their day spine with the plant extremes, and the features."""

    hours: DataFrame
    spine: DataFrame
    plan: FeaturePlan


def prepare(
    hours: DataFrame,
    plan: FeaturePlan,
    start: str | None = K.DEFAULT_START,
    end: str | None = K.DEFAULT_END,
    settings: DataFrame | None = None,
) -> Prepared:
    """Filter, encode, lag and clean hourly rows; `settings` as for keep_dated.

    The spine is summed up from the rows as they are read, 24 to 1 before any shuffle. Only the
    extremes of the lagged target need rows in order; that pass carries four short columns.
    """
    rows = keep_dated(hours, start, end, settings)
    features = plan.all_columns
    if any(c in features for c in K.TIME_FEATURES):
        rows = encode_time(rows)
    own = [c for c in features if c not in ("Hour", K.TARGET, K.LAG_FEATURE)]
    rows = rows.select(*DAY, "dt", "Hour", K.TARGET, *own)
    without_lag = FeaturePlan([c for c in plan.hist if c != K.LAG_FEATURE], plan.fcst, plan.forecast_only)
    to_scale = dict.fromkeys([*(c for c in features if c != K.LAG_FEATURE), K.TARGET])
    days = summarize_days(clean_features(rows, without_lag), to_scale)
    if K.LAG_FEATURE not in features:
        return Prepared(clean_features(rows, plan), spine_of(days), plan)
    marked = rows.withColumn("_kept", all_present([*plan.fcst, K.TARGET]))
    lagged = previous_value(marked, K.TARGET, K.LAG_FEATURE).filter("_kept").drop("_kept")
    filled = clean_features(lagged, plan)
    lags = summarize_days(filled.select(*DAY, K.LAG_FEATURE), [K.LAG_FEATURE], required=[])
    extremes = lags.select(*DAY, f"lo_{K.LAG_FEATURE}", f"hi_{K.LAG_FEATURE}")
    return Prepared(filled, spine_of(days.join(extremes, DAY)), plan)


def scaler_table(rows: DataFrame, features: list[str]) -> DataFrame:
    """Extremes of each feature per plant, one row per plant and feature."""
    wide = rows.groupBy("plant_id").agg(
        *[F.min(c).alias(f"lo_{c}") for c in features], *[F.max(c).alias(f"hi_{c}") for c in features]
    )
    pairs = F.array(
        *[
            F.struct(F.lit(c).alias("feature"), F.col(f"lo_{c}").alias("lo"), F.col(f"hi_{c}").alias("hi"))
            for c in features
        ]
    )
    return wide.select("plant_id", F.explode(pairs).alias("f")).select(
        "plant_id", "f.feature", "f.lo", "f.hi", (F.col("f.lo") == F.col("f.hi")).alias("constant")
    )


def scaled_hours(prepared: Prepared, extra: tuple[str, ...] = ()) -> DataFrame:
    """Rows with all features and the target scaled per plant."""
    columns = list(dict.fromkeys([*prepared.plan.all_columns, K.TARGET]))
    bounds = [f"{side}_{c}" for c in columns for side in ("lo", "hi")]
    joined = prepared.hours.join(prepared.spine.select(*DAY, *bounds), DAY)
    return joined.select(*DAY, "dt", "Hour", *extra, *[scale(c).alias(c) for c in columns])
