"""Consumption periods of both providers in one shape, read by requests.

Periods: provider, sensor_id, date_debut, date_fin, consommation, unite (dates as text).
Requests: req_id, provider, sensor_id, from, to (all text but req_id, unique).
"""

from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql import types as T

from meterfold import fixed_values as fv
from meterfold.functions.dates import iso_day, parse_day
from meterfold.functions.text import clean, number
from meterfold.operators.outcomes import error, first_error, invalid
from meterfold.session import stored_once

SHAPE = ["provider", "sensor_id", "date_debut", "date_fin", "consommation", "unite"]
SENSOR = ["provider", "sensor_id"]


def _as_text(df: DataFrame, c: str) -> Column:
    """Typed dates and timestamps as ISO text, text as it is."""
    if isinstance(df.schema[c].dataType, T.StringType):
        return F.col(c)
    return iso_day(F.col(c).cast("date"))


def _as_day(df: DataFrame, c: str) -> Column:
    """Text parsed strictly, typed dates and timestamps as dates."""
    if isinstance(df.schema[c].dataType, T.StringType):
        return parse_day(F.col(c))
    return F.col(c).cast("date")


def _common(df: DataFrame, provider: str, sensor: str, value: str, unit: Column) -> DataFrame:
    """The common shape plus the bounds as dates (``first_day``, ``last_day``)."""
    return df.select(
        F.lit(provider).alias("provider"),
        F.col(sensor).alias("sensor_id"),
        _as_text(df, "date_debut").alias("date_debut"),
        _as_text(df, "date_fin").alias("date_fin"),
        F.col(value).alias("consommation"),
        unit.cast("string").alias("unite"),
        _as_day(df, "date_debut").alias("first_day"),
        _as_day(df, "date_fin").alias("last_day"),
    )


def electricity_total(measures: DataFrame) -> DataFrame:
    """TOTAL measurements in the common shape; the unit is not stored."""
    total = measures.where(F.col("label") == fv.TOTAL_LABEL)
    return _common(total, fv.ELECTRICITY, "id_pdl", "val", F.lit(None))


def gas_published(periods: DataFrame) -> DataFrame:
    unit = F.col("unite") if "unite" in periods.columns else F.lit(None)
    return _common(periods, fv.GAS, "id_pce", "consommation", unit)


def all_periods(gas_periods: DataFrame, measures: DataFrame) -> DataFrame:
    """Both providers; a filter on ``provider`` removes the other branch from the plan."""
    return gas_published(gas_periods).unionByName(electricity_total(measures))


def present(periods: DataFrame) -> DataFrame:
    """Periods as they are returned: cleaned text, NaN as null, default unit."""
    return periods.withColumns({
        "date_debut": clean(F.col("date_debut")),
        "date_fin": clean(F.col("date_fin")),
        "consommation": number(F.col("consommation")),
        "unite": F.coalesce(clean(F.col("unite")), F.lit(fv.DEFAULT_UNIT)),
    })


def contained(low: Column, high: Column) -> Column:
    """The whole period lies in [low, high]; an unparsable bound never does."""
    return (F.col("first_day") >= low) & (F.col("last_day") <= high)


def meter_periods(measures: DataFrame, id_pdl: str, low: str, high: str) -> DataFrame:
    """TOTAL periods of one meter inside [low, high] of a table with typed dates.

    All conditions are plain comparisons on stored columns: partition and file filters apply.
    """
    inside = measures.where(
        (F.col("id_pdl") == id_pdl)
        & (F.col("date_debut") >= F.lit(low).cast("date"))
        & (F.col("date_fin") <= F.lit(high).cast("date"))
    )
    return present(electricity_total(inside)).select(*SHAPE).orderBy(
        F.coalesce("date_debut", F.lit(""))
    )


def check_requests(requests: DataFrame) -> DataFrame:
    """Requests with normalised parameters and the first broken rule (``err``, null when fine)."""
    texts = requests.select(
        "req_id", F.lower(clean(F.col("provider"))).alias("provider"),
        clean(F.col("sensor_id")).alias("sensor_id"),
        clean(F.col("from")).alias("from_text"), clean(F.col("to")).alias("to_text"),
    )
    dated = texts.withColumns({
        "low": parse_day(F.col("from_text")),
        "high": parse_day(F.col("to_text")),
    })
    provider, low, high = F.col("provider"), F.col("low"), F.col("high")
    return dated.select(
        "req_id", "provider", "sensor_id", "low", "high",
        first_error(
            invalid(provider.isNull(), "provider", "required"),
            F.when(~provider.isin(*fv.PROVIDERS),
                   error(fv.INVALID_FIELD, "provider", fv.TEXT["provider_choice"])),
            invalid(F.col("sensor_id").isNull(), "sensor_id", "required"),
            invalid(low.isNull(), "from", "date"),
            invalid(high.isNull(), "to", "date"),
            F.when(high <= low, error(fv.INVALID_FIELD, "to", fv.TEXT["window"])),
        ).alias("err"),
    )


def _asked_bounds(windows: DataFrame) -> DataFrame:
    """Per asked sensor the earliest and the latest day of all its windows, what a period can count for, and
    the ``levels`` of the nodes that its windows are made of (see below)."""
    days = windows.groupBy(*SENSOR).agg(
        F.min("low").alias("from_day"), F.max("high").alias("to_day"), F.collect_set("high").alias("highs"))
    levels = F.transform("highs", lambda high: F.transform(_prefix_nodes(high), lambda x: x["level"]))
    return days.select(*SENSOR, "from_day", "to_day", F.array_distinct(F.flatten(levels)).alias("levels"))


def _in_reach(periods: DataFrame, windows: DataFrame) -> DataFrame:
    """Periods of asked sensors that lie inside the span of all their windows.

    One row per sensor meets the periods, so the periods are the side that adaptive execution may split.
    """
    return periods.join(_asked_bounds(windows), SENSOR).where(contained(F.col("from_day"), F.col("to_day")))


def requested_periods(requests: DataFrame, periods: DataFrame) -> DataFrame:
    """Periods inside the window of each valid request, one row per request and period.

    Joining on the start year as well spreads a busy sensor over its years and pairs a request only with
    years it asks for. Windows are cut to the years that the sensor has periods in, so a window without
    end costs no more rows than one that fits.
    """
    good = check_requests(requests).where(F.col("err").isNull())
    dated = periods.withColumn("start_year", F.year("first_day"))
    stored = dated.select(*SENSOR, "start_year").distinct()
    years = good.join(stored, SENSOR).where(F.col("start_year").between(F.year("low"), F.year("high")))
    found = years.join(dated, [*SENSOR, "start_year"]).where(contained(F.col("low"), F.col("high")))
    return present(found).select("req_id", *SHAPE)


# --- counting by a sweep -------------------------------------------------------------------
#
# How many periods start at or after ``low`` and end by ``high`` is a dominance count. End days are
# numbered from the sensor's first asked day; a prefix [0, n) of those numbers is a disjoint union of nodes
# (level, node) with 2**level days each, one per bit set in n. A period lies in one node of every level, so
# summing the nodes' running counts, taken over start days from the last to the first, answers every
# window exactly: (periods + windows) * log(days) rows and no pair of a window and a period. A period is sent to
# the levels that a window of its sensor has a node in: one for a sensor with one window, whatever its length.

def _node_counts(reached: DataFrame) -> DataFrame:
    """Periods per (sensor, level, node, start day), combined per task; a node has one row per start day at most."""
    end = F.greatest(F.datediff("last_day", "from_day"), F.lit(0))
    level = F.explode("levels")
    return reached.select(*SENSOR, F.col("first_day").alias("day"), end.alias("end"), level.alias("level")).groupBy(
        *SENSOR, "level", F.expr("shiftright(end, level)").alias("node"), "day").agg(F.count(F.lit(1)).alias("n"))


def _levels():
    """The level whose single node holds every end day of the sensor."""
    return F.length(F.bin(F.datediff("to_day", "from_day")))


def _prefix_nodes(high: Column) -> Column:
    """The nodes that make up the end days up to ``high``; those up to the last asked day are one."""
    n = F.datediff(high, F.col("from_day")) + 1
    whole = F.array(F.struct(_levels().alias("level"), F.lit(0).alias("node")))
    bits = F.filter(F.sequence(F.lit(0), _levels()), lambda b: F.call_function("bit_get", n, b) == 1)
    nodes = F.transform(bits, lambda b: F.struct(
        b.alias("level"), (F.call_function("shiftright", n, b) - 1).alias("node")))
    return F.when(high == F.col("to_day"), whole).otherwise(nodes)


def _window_nodes(windows: DataFrame) -> DataFrame:
    """The nodes that make up each window's end days."""
    return windows.join(_asked_bounds(windows), SENSOR).select(
        *SENSOR, "low", "high", F.inline(_prefix_nodes(F.col("high"))))


def window_counts(windows: DataFrame, periods: DataFrame) -> DataFrame:
    """(sensor, low, high, n_kept) of distinct windows; those that hold no period are absent.

    A sensor's node holds one row per start day and one per asked ``low``, so the sweep's windows are
    bounded by the calendar, however many periods and requests a sensor has.
    """
    windows = stored_once(windows)
    nodes = _window_nodes(windows)
    unit = [*SENSOR, "level", "node"]
    asked = nodes.select(*unit, F.col("low").alias("day"), F.lit(None).cast("bigint").alias("n")).distinct()
    # At one day the periods come first: a window holds what starts on its first day.
    order = Window.partitionBy(*unit).orderBy(F.desc("day"), F.col("n").isNull()).rowsBetween(
        Window.unboundedPreceding, 0)
    swept = _node_counts(_in_reach(periods, windows)).select(*unit, "day", "n").unionByName(asked).withColumn(
        "n_kept", F.sum("n").over(order))
    answers = swept.where(F.col("n").isNull() & F.col("n_kept").isNotNull()).select(
        *unit, F.col("day").alias("low"), "n_kept")
    return nodes.join(answers, [*unit, "low"]).groupBy(*SENSOR, "low", "high").agg(F.sum("n_kept").alias("n_kept"))


def kept_counts(requests: DataFrame, periods: DataFrame) -> DataFrame:
    """Number of periods inside each valid request's window (requests with none are absent)."""
    return _kept_counts(check_requests(requests).where(F.col("err").isNull()), periods)


def _kept_counts(good: DataFrame, periods: DataFrame) -> DataFrame:
    window = [*SENSOR, "low", "high"]
    return good.join(window_counts(good.select(*window).distinct(), periods), window).select("req_id", "n_kept")


def request_outcomes(
    requests: DataFrame, periods: DataFrame, known: DataFrame, checked: DataFrame | None = None,
) -> DataFrame:
    """One row per request: 400, 404 or 200 with the number of periods kept.

    ``known``: provider and sensor_id of everything stored, TOTAL or not; a sensor with rows but
    none kept answers 200 with zero. Requests are checked once and kept; ``checked``: what
    ``check_requests`` made of them, if the caller has it stored.
    """
    if checked is None:
        checked = stored_once(check_requests(requests))
    good = checked.where(F.col("err").isNull())
    # What is stored is narrowed to the asked sensors before it is made distinct.
    existing = known.select(*SENSOR).join(good.select(*SENSOR), SENSOR, "left_semi").distinct().withColumn(
        "known", F.lit(True))
    kept = _kept_counts(good, periods)
    found = F.col("known").isNotNull()
    judged = good.join(existing, SENSOR, "left").join(kept, "req_id", "left").select(
        "req_id", *SENSOR,
        F.when(found, 200).otherwise(404).alias("http_status"),
        F.when(~found, fv.SENSOR_NOT_FOUND).alias("erreur"),
        F.lit(None).cast("string").alias("champ"),
        F.when(~found, fv.TEXT["sensor_missing"]).alias("message"),
        F.when(found, F.coalesce("n_kept", F.lit(0))).cast("bigint").alias("n_kept"),
    )
    refused = checked.where(F.col("err").isNotNull()).select(
        "req_id", *SENSOR, F.lit(400).alias("http_status"), "err.*",
        F.lit(None).cast("bigint").alias("n_kept"),
    )
    return judged.unionByName(refused)


def known_sensors(gas_periods: DataFrame, measures: DataFrame) -> DataFrame:
    return gas_periods.select(
        F.lit(fv.GAS).alias("provider"), F.col("id_pce").alias("sensor_id")
    ).unionByName(measures.select(
        F.lit(fv.ELECTRICITY).alias("provider"), F.col("id_pdl").alias("sensor_id")
    ))
