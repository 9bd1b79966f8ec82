"""Phenological calendar as column expressions: the season starts on 1 March."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def pheno_year(date: Column) -> Column:
    """Season of a date; null for null."""
    return F.year(date) - F.when(F.month(date) < 3, 1).otherwise(0)


def pheno_doy(date: Column) -> Column:
    """Day of the season, 1 March being day 1."""
    return F.datediff(date, F.make_date(pheno_year(date), F.lit(3), F.lit(1))) + 1


def day_bin(day: Column, width: int = 10) -> Column:
    """ceil(day / width), not capped."""
    return F.ceil(day / width).cast("int")


def capped_bin(day: Column, width: int = 10, last: int = 37) -> Column:
    """ceil(day / width), days beyond the last bin counted in it."""
    return F.when(day.isNotNull(), F.least(F.ceil(day / width), F.lit(last))).cast("int")
