"""Text cleaning, closed lists, length and pattern tests, bounded integers."""

from pyspark.sql import Column, functions as F

from meterfold.fixed_values import EMAIL_PATTERN, MAX_LENGTH, POSTAL_CODE_PATTERN, WHITESPACE


def strip(c: Column) -> Column:
    """Remove Unicode whitespace at both ends (``trim`` alone only removes spaces)."""
    return F.btrim(c, F.lit(WHITESPACE))


def strip_flat(c: Column) -> Column:
    """``strip`` for a plain column, which costs nothing to repeat.

    ``trim`` removes spaces cheaply; the slower set-based trim runs only when another whitespace
    character is left at an end.
    """
    t, spaces = F.trim(c), F.lit(WHITESPACE)
    edge = spaces.contains(F.substring(t, 1, 1)) | spaces.contains(F.substring(t, -1, 1))
    return F.when(edge, F.btrim(t, spaces)).otherwise(t)


def clean(c: Column) -> Column:
    """Strip; blank becomes null."""
    return F.nullif(strip(c.cast("string")), F.lit(""))


def is_filled(c: Column) -> Column:
    return clean(c).isNotNull()


def longer_than(c: Column, n: int) -> Column:
    """True when the text has more than ``n`` code points; null counts as short."""
    return F.coalesce(F.char_length(c) > n, F.lit(False))


def one_of(c: Column, choices) -> Column:
    """Membership in a closed list; null is not a member."""
    return F.coalesce(c.isin(*choices), F.lit(False))


def is_email(c: Column) -> Column:
    ok = c.rlike(EMAIL_PATTERN) & (F.char_length(c) <= MAX_LENGTH["courriel_titulaire"])
    return F.coalesce(ok, F.lit(False))


def is_postal_code(c: Column) -> Column:
    return F.coalesce(c.rlike(POSTAL_CODE_PATTERN), F.lit(False))


def whole_number(c: Column) -> Column:
    """The text as a whole number, else null."""
    return F.when(strip(c).rlike(r"^[+-]?[0-9]+$"), strip(c).try_cast("bigint"))


def bounded_int(c: Column, low: int, high: int | None = None) -> Column:
    """Whole number within bounds, else null."""
    n = whole_number(c)
    inside = n >= low if high is None else n.between(low, high)
    return F.when(inside, n)


def number(c: Column) -> Column:
    """NaN becomes null."""
    return F.when(~F.isnan(c), c)


def truncate(c: Column, n: int) -> Column:
    return F.substring(c, 1, n)
