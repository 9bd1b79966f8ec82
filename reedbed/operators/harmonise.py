"""Bringing sensors, positions and scales together."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reedbed.functions.indices import BANDS

NEWER = "LANDSAT_89"
KM_PER_DEGREE = 111.32


def coefficients(bias: DataFrame, only_significant: bool = True) -> dict[str, tuple[float, float]]:
    """Slope and intercept by band from the (ten-row) bias table; a term that is not finite is an error."""
    out = {}
    for row in bias.where(F.col("band").isin(*BANDS)).limit(100).collect():
        if only_significant and not row["significant"]:
            continue
        terms = (row["slope"], row["intercept"])
        if any(t is None or t != t or abs(t) == float("inf") for t in terms):
            raise ValueError(f"bias terms of {row['band']} are not finite")
        out[row["band"]] = terms
    return out


def affine_column(band: str, terms: dict[str, tuple[float, float]], satellite: str = "satellite") -> Column:
    """slope x band + intercept where the reading is the newer sensor's, else the band."""
    if band not in terms:
        return F.col(band)
    slope, intercept = terms[band]
    return F.when(F.lower(satellite) == NEWER.lower(), F.col(band) * slope + intercept).otherwise(F.col(band))


def affine(df: DataFrame, bias: DataFrame, only_significant: bool = True) -> DataFrame:
    """Bands of the newer sensor on the scale of the older one; a projection, no join."""
    terms = coefficients(bias, only_significant)
    return df.withColumns({b: affine_column(b, terms) for b in BANDS if b in df.columns})


def with_raw(df: DataFrame, columns: list[str]) -> DataFrame:
    """Keeps the present values of columns as <name>_raw."""
    return df.withColumns({f"{c}_raw": F.col(c) for c in columns if c in df.columns})


def snapped(c: Column, size: float = 0.01) -> Column:
    """Centre of the grid cell."""
    return F.round(F.floor(c / size) * size + size / 2 + 1e-9, 6)


def grid_mean(df: DataFrame, groups: list[str], value: str, size: float = 0.01) -> DataFrame:
    """Mean by group and grid cell; rows without a position are left out."""
    here = df.where("lat is not null and lon is not null")
    return here.groupBy(*groups, snapped(F.col("lat"), size).alias("cell_lat"), snapped(F.col("lon"), size).alias("cell_lon")).agg(F.avg(value).alias(value), F.count(F.lit(1)).alias("n"))


def block_cells(df: DataFrame, block_km: float) -> DataFrame:
    """Adds block: cell of block_km by block_km, longitudes scaled at the mean latitude. Rows without a position get null."""
    mean_lat = df.agg(F.avg("lat").alias("m")).first()["m"]
    if mean_lat is None or block_km <= 0:
        return df.withColumn("block", F.lit(None).cast("string"))
    height = block_km / KM_PER_DEGREE
    width = F.lit(block_km) / (KM_PER_DEGREE * F.cos(F.radians(F.lit(mean_lat))))
    cell = F.concat_ws("_", F.floor(F.col("lat") / height).cast("bigint"), F.floor(F.col("lon") / width).cast("bigint"))
    return df.withColumn("block", F.when(F.col("lat").isNotNull() & F.col("lon").isNotNull(), cell))


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * 6371.0 * F.asin(F.sqrt(F.least(a, F.lit(1.0))))
