"""Scalar column expressions."""

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from noonward import constants as K


def half_even(col, places: int) -> Column:
    return F.bround(col, places)


def absent_if_nan(col) -> Column:
    """NaN read from a file counts as missing."""
    return F.nanvl(col, F.lit(None).cast("double"))


def hour_stamp(year, month, day, hour) -> Column:
    """The hour as a time stamp; null where there is no such date or hour."""
    zero = F.lit(0)
    return F.try_make_timestamp_ntz(year, month, day, hour, zero, zero)


def cyclic(col, period: int) -> tuple[Column, Column]:
    """Cosine and sine of a position on a cycle."""
    angle = 2 * F.pi() * F.col(col) / F.lit(period)
    return F.cos(angle), F.sin(angle)


def clip_percent(col) -> Column:
    return F.greatest(F.least(col, F.lit(100.0)), F.lit(0.0))


def finite(col) -> Column:
    """Missing becomes 0, the infinities 1 and -1."""
    c = F.col(col) if isinstance(col, str) else col
    return (
        F.when(c.isNull() | F.isnan(c), 0.0)
        .when(c == F.lit(float("inf")), 1.0)
        .when(c == F.lit(float("-inf")), -1.0)
        .otherwise(c)
    )


def season_of(month) -> Column:
    m = F.col(month) if isinstance(month, str) else month
    return (
        F.when(m.between(3, 5), "Spring")
        .when(m.between(6, 8), "Summer")
        .when(m.between(9, 11), "Fall")
        .otherwise("Winter")
    )


def scenario_label(pv, hist_weather, forecast, ideal) -> Column:
    pv, hist_weather, forecast, ideal = (F.col(c) for c in (pv, hist_weather, forecast, ideal))
    return (
        F.when(pv & hist_weather, "PV+HW")
        .when(pv & forecast & ideal, "PV+NWP+")
        .when(pv & forecast, "PV+NWP")
        .when(pv, "PV")
        .when(forecast & ideal, "NWP+")
        .when(forecast, "NWP")
        .otherwise("Unknown")
    )


def forecast_only(no_hist_power, pv, hist_weather) -> Column:
    """The given flag, or where it is not given: neither power nor weather history is used."""
    return F.coalesce(F.col(no_hist_power), ~F.col(pv) & ~F.col(hist_weather))


def experiment_name(model, complexity, scenario, lookback, time_encoding) -> Column:
    """Model, complexity (none for the linear model), features with their lookback, time encoding."""
    lookback = F.col(lookback)
    features = F.when(lookback > 0, F.concat(F.col(scenario), F.lit("_"), lookback.cast("string"), F.lit("h")))
    return F.concat_ws(
        "_",
        F.col(model),
        F.when(F.col(model) != K.LINEAR_MODEL, F.col(complexity)),
        F.coalesce(features, F.col(scenario)),
        F.when(F.col(time_encoding), "TE").otherwise("noTE"),
    )


def recorded_experiment_id(row: dict[str, str]) -> Column:
    """Identifier of a stored ablation row; `row` maps each part to its column."""
    c = {part: F.col(name) for part, name in row.items()}
    flag = lambda label, part: F.concat(F.lit(label), F.lower(c[part].cast("string")))
    return F.concat_ws(
        "_",
        c["model"],
        flag("pv", "use_pv"),
        flag("hist", "use_hist_weather"),
        flag("fcst", "use_forecast"),
        c["weather_category"],
        F.when(c["use_time_encoding"], "time").otherwise("notime"),
        F.when(c["past_days"] == 0, "nohist").otherwise(F.concat(F.lit("days"), c["past_days"].cast("string"))),
        F.when(c["model"] != K.LINEAR_MODEL, F.concat(F.lit("comp"), c["model_complexity"])),
    )


def plant_id_from_file(name) -> Column:
    """Digits after 'project' or 'plant', else leading digits, else the bare file name."""
    base = F.regexp_extract(name, r"([^/]*)$", 1)
    named = F.nullif(F.regexp_extract(base, r"(?i)project(\d+)", 1), F.lit(""))
    plant = F.nullif(F.regexp_extract(base, r"(?i)plant(\d+)", 1), F.lit(""))
    leading = F.nullif(F.regexp_extract(base, r"^(\d+)", 1), F.lit(""))
    bare = F.replace(F.replace(base, F.lit(".csv"), F.lit("")), F.lit(".CSV"), F.lit(""))
    return F.coalesce(named, plant, leading, bare)


def plant_id_simple(name) -> Column:
    c = F.col(name) if isinstance(name, str) else name
    return F.replace(F.replace(c, F.lit("Project"), F.lit("")), F.lit(".csv"), F.lit(""))


def forward_slashes(path) -> Column:
    c = F.col(path) if isinstance(path, str) else path
    return F.replace(c, F.lit("\\"), F.lit("/"))


def rank_in(values: list[str], col) -> Column:
    """Position of a value in a fixed order, starting at 1; values outside it come last."""
    position = F.array_position(F.array(*[F.lit(v) for v in values]), F.col(col))
    return F.when(position > 0, position).otherwise(F.lit(len(values) + 1)).cast("int")


def model_rank(col="model") -> Column:
    return rank_in(K.MODEL_ORDER, col)


def model_family(col="model") -> Column:
    c = F.col(col)
    return (
        F.when(c.isin(K.DEEP_MODELS), "deep").when(c.isin(K.TREE_MODELS), "tree").when(c == K.LINEAR_MODEL, "linear")
    )


def mean_and_spread(mean, spread) -> Column:
    """'m.mm±s.ss', or 'm.mm' where the spread is missing."""
    text = lambda c: F.call_function("format_number", F.col(c), F.lit("0.00"))
    return F.when(F.col(spread).isNotNull(), F.concat(text(mean), F.lit("±"), text(spread))).otherwise(text(mean))


def all_present(cols: list[str]) -> Column:
    return reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in cols], F.lit(True))
