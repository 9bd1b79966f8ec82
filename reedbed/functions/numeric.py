"""Numbers as column expressions: missing values, guarded division, clamping, rounding."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def finite(c: Column) -> Column:
    """The value, or null for NaN and infinities: applied once at ingest, so that null alone means missing."""
    c = c.cast("double")
    return F.when(~F.isnan(c) & (F.abs(c) < float("inf")), c)


def plausible(c: Column) -> Column:
    """A reflectance within 0 to 1, else null."""
    return F.when((c >= 0) & (c <= 1), c)


def ratio(a: Column, b: Column) -> Column:
    """a / b; null where b is 0."""
    return F.try_divide(a, b)


def clamp(c: Column, low: float = 0.0, high: float = 1.0) -> Column:
    """Within the bounds; null stays null."""
    return F.when(c.isNotNull(), F.least(F.greatest(c, F.lit(low)), F.lit(high)))


def r6(c: Column) -> Column:
    """Six decimals, ties moved off the edge so that engines agree."""
    return F.round(c + 1e-9, 6)


def flag_of(text: Column) -> Column:
    """A flag as 1 or 0 from text or a boolean; null if it is none."""
    return number_of(text.cast("string")).cast("int")


def cover_of(x: Column, slope: float | None, intercept: float | None, a: float | None = None, b: float | None = None) -> Column:
    """Cover within 0 to 1 predicted from an index by a line, over (a + x) / (b + x) if a and b are given; null without a model or where the index is null or the ratio undefined."""
    if slope is None or intercept is None:
        return F.lit(None).cast("double")
    value = ratio(F.lit(a) + x, F.lit(b) + x) if a is not None and b is not None else x
    return clamp(F.lit(intercept) + F.lit(slope) * value)


def number_of(text: Column) -> Column:
    """A number from text; true and t count as 1, false and f as 0; null if it is none."""
    low = F.lower(F.trim(text))
    return F.when(low.isin("true", "t"), 1.0).when(low.isin("false", "f"), 0.0).otherwise(low.try_cast("double"))
