"""Soil baselines and the phenology index that rests on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reedbed.functions.indices import CANOPY_MAX, FULL_COVER, LATITUDE_DEFAULT, cos_zenith, ppi
from reedbed.functions.numeric import clamp
from reedbed.operators.ranks import group_percentiles
from reedbed.session import materialise


def dvi() -> Column:
    return F.col("nir") - F.col("red")


def low_quantile_baseline(df: DataFrame, key: str = "location_id", p: float = 0.1, at_least: int = 5) -> DataFrame:
    """Soil value of each location: median of the DVI values at or below their p-quantile, of locations with enough values."""
    v = materialise(df.select(key, dvi().alias("v")).where("v is not null"), "dvi")
    counts = v.groupBy(key).agg(F.count("v").alias("n")).where(F.col("n") >= at_least)
    cut = group_percentiles(v, [key], {"q": "v"}, [p])
    return group_percentiles(v.join(cut, key).where("v <= q"), [key], {"soil": "v"}, [0.5]).join(counts, key)


def winter_baseline(df: DataFrame, key: str = "location_id", months: tuple[int, ...] = (1, 2, 3), at_least: int = 1) -> DataFrame:
    """Soil value of each location: mean DVI of the winter months."""
    v = F.when(F.month("date").isin(*months), dvi())
    return df.groupBy(key).agg(F.avg(v).alias("soil"), F.count(v).alias("n")).where(F.col("n") >= at_least)


def canopy_max(df: DataFrame, flag: Column, months: tuple[int, ...] = (7, 8, 9), at_least: int = 5) -> DataFrame:
    """One row: largest summer DVI of the flagged readings, null if there are too few."""
    v = F.when(flag & F.month("date").isin(*months), dvi())
    return df.agg(F.when(F.count(v) >= at_least, F.max(v)).alias("canopy_max"), F.count(v).alias("n"))


def with_ppi(df: DataFrame, soil: DataFrame | None = None, canopy: float = CANOPY_MAX, strict: bool = False) -> DataFrame:
    """Adds soil, zenith, ppi and ppi_norm (clamped to 0 to 1). Locations without a soil value are dropped; with ``strict`` a reading with a DVI at one of them is an error."""
    soil = (low_quantile_baseline(df) if soil is None else soil).select("location_id", "soil")
    if strict and not df.where(dvi().isNotNull()).join(soil.where("soil is not null"), "location_id", "left_anti").isEmpty():
        raise ValueError("readings at locations without a soil value")
    cosz = cos_zenith(F.coalesce("lat", F.lit(LATITUDE_DEFAULT)), F.col("doy_cal"))
    joined = df.join(soil, "location_id").withColumn("cosz", cosz)
    value = ppi(dvi(), F.col("cosz"), F.col("soil"), canopy)
    return joined.withColumns({"zenith": F.degrees(F.acos("cosz")), "ppi": value}).withColumn("ppi_norm", clamp(F.col("ppi"))).drop("cosz")


def barren_floor(peak_ppi: Column, full: float = FULL_COVER) -> Column:
    """Least share of bare ground that a summer peak of the phenology index leaves."""
    return F.greatest(F.lit(0.0), 1 - F.least(peak_ppi / full, F.lit(1.0)))


def ppi_scaler(df: DataFrame) -> DataFrame:
    """Median clamped index of each location and season, null as 0."""
    medians = group_percentiles(df, ["location_id", "py"], {"scaler": "ppi_norm"}, [0.5])
    return medians.withColumn("scaler", clamp(F.coalesce("scaler", F.lit(0.0))))


