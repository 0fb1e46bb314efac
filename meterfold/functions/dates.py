"""Day parsing, timestamp rendering and the measurement time conventions."""

from datetime import datetime

from pyspark.sql import Column, functions as F

from meterfold.fixed_values import (
    MEASURE_FORMAT, MEASURE_UUID_PREFIX, WHITESPACE,
)
from meterfold.functions.text import clean

# One capturing match tolerates surrounding whitespace, so the text is looked at once.
_SPACES = f"[{WHITESPACE}]*"
_DAY = f"^{_SPACES}((?!0000)[0-9]{{4}}-[0-9]{{1,2}}-[0-9]{{1,2}}){_SPACES}$"
_ISO_STAMP = (
    f"^{_SPACES}([0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}"
    r"([T ][0-9]{2}:[0-9]{2}(:[0-9]{2}(\.[0-9]+)?)?(Z|[+-][0-9]{2}:?[0-9]{2})?)?)"
    f"{_SPACES}$"
)


def parse_day(c: Column) -> Column:
    """Text ``YYYY-MM-DD`` (one-digit month or day accepted) to date; anything else is null."""
    return F.regexp_extract(c.cast("string"), _DAY, 1).try_cast("date")


def iso_day(c: Column) -> Column:
    """Date as ISO text."""
    return c.cast("string")


def lenient_iso_day(c: Column) -> Column:
    """Anything castable to a date, as ISO text; null when it is not a date."""
    return iso_day(c.try_cast("date"))


def show_stamp(c: Column) -> Column:
    """``YYYY-MM-DD HH:MM:SS``; a zone offset is dropped, unparsable text is kept as it is."""
    wall = F.regexp_extract(c, _ISO_STAMP, 1).try_cast("timestamp_ntz")
    return F.coalesce(show_typed_stamp(wall), clean(c))


def show_typed_stamp(c: Column) -> Column:
    """Same rendering for a date or timestamp column, whatever the session time zone."""
    return F.substring(c.cast("timestamp_ntz").cast("string"), 1, 19)


def stamp_literal(now: datetime) -> Column:
    """The run's ``now`` as a zone-less UTC literal."""
    return F.lit(now.isoformat(sep=" ")).cast("timestamp_ntz")


def iso_stamp(now: datetime) -> str:
    """The run's ``now`` as stored in text columns."""
    return now.strftime("%Y-%m-%dT%H:%M:%S.%f+00:00")


def measure_stamp(date_fin: Column) -> Column:
    return F.date_sub(date_fin, 1).cast("timestamp_ntz")


def measure_uuid(id_pdl: Column) -> Column:
    return F.concat(F.lit(MEASURE_UUID_PREFIX), id_pdl)


def measure_format() -> Column:
    return F.lit(MEASURE_FORMAT)
