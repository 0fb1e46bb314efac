"""The boolean spellings used by feeds, requests, views and stored rows."""

from pyspark.sql import Column, functions as F

from meterfold.fixed_values import BOOLEAN_DIALECTS
from meterfold.functions.text import strip


def parse_bool(c: Column, dialect: str, stripped: bool = False) -> Column:
    """Text to boolean; unknown spellings give null (``existing``: false)."""
    yes, no = BOOLEAN_DIALECTS[dialect]
    word = F.lower(c if stripped else strip(c.cast("string")))
    if dialect == "existing":
        # A non-zero number also counts as true in stored rows.
        nonzero = F.coalesce(word.try_cast("double"), F.lit(0.0)) != 0.0
        is_number = word.rlike(r"^[+-]?[0-9]+(\.[0-9]+)?$")
        return F.coalesce(word.isin(*yes) | (is_number & nonzero), F.lit(False))
    spellings = ", ".join([f"'{w}', true" for w in yes] + [f"'{w}', false" for w in no])
    return F.expr(f"map({spellings})")[word]


def bool_text(c: Column, default: Column | None = None) -> Column:
    """Request spelling to stored ``"true"``/``"false"``."""
    text = parse_bool(c, "input").cast("string")
    return text if default is None else F.coalesce(text, default)


def any_true(*flags: Column) -> Column:
    result = F.lit(False)
    for flag in flags:
        result = result | F.coalesce(flag, F.lit(False))
    return result
