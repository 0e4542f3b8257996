"""Small text expressions with the meaning of Python's str methods."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def strip(c: Column) -> Column:
    """Without white space (of Unicode) at both ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def has_outer_space(c: Column) -> Column:
    """Whether a text's first or last character is white space (of Unicode)."""
    return F.concat(F.substring(c, 1, 1), F.substring(c, -1, 1)).rlike(r"(?U)\s")


def strip_if_any(c: Column) -> Column:
    """strip, for many long texts of which few have outer white space: only these are looked through."""
    return F.when(has_outer_space(c), strip(c)).otherwise(c)


def squeeze(c: Column) -> Column:
    return strip(F.regexp_replace(c, r"(?U)\s+", " "))


def words(c: Column) -> Column:
    """Runs of non-space characters; none for a blank text."""
    return F.filter(F.split(squeeze(c), " "), lambda w: w != "")


def is_blank(c: Column) -> Column:
    return c.isNull() | (strip(c) == "")


def shorten(c: Column, most: int = 50) -> Column:
    return F.when(F.length(c) > most, F.concat(F.left(c, F.lit(most)), F.lit("..."))).otherwise(c)


def duration(seconds: Column) -> Column:
    """'3.2s', '2m 6s' or '1h 2m 3s'."""
    left = F.pmod(seconds, F.lit(60.0))
    # The seconds are rounded on their own, halves to even, so 119.7 seconds are '1m 60s'.
    h, m, s = F.floor(seconds / 3600).cast("bigint"), F.floor(F.pmod(seconds, F.lit(3600.0)) / 60).cast("bigint"), F.bround(left, 0).cast("bigint")
    text = F.when(seconds < 60, F.format_string("%.1fs", seconds)).when(seconds < 3600, F.format_string("%dm %ds", m, s))
    return text.otherwise(F.format_string("%dh %dm %ds", h, m, s))
