"""Spectral indices, solar zenith and the plant phenology index as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reedbed.functions.numeric import ratio

EPS = 1e-9
BANDS = ("blue", "green", "red", "nir", "swir1", "swir2")
#: Weights of the bands, in the order of BANDS.
BRIGHTNESS = (0.3029, 0.2786, 0.4733, 0.5599, 0.508, 0.1872)
GREENNESS = (-0.2941, -0.243, -0.5424, 0.7276, 0.0713, -0.1608)
#: Fixed values of the phenology index.
CANOPY_MAX, FULL_COVER, SOIL_DEFAULT, LATITUDE_DEFAULT, OVERPASS_HOUR = 0.7, 0.584568, 0.0308, 40.2, 10.5


def _normalised(a: Column, b: Column, eps: float = EPS) -> Column:
    return ratio(a - b, a + b + eps)


def spectral_indices() -> dict[str, Column]:
    """Every index by name, from columns named like BANDS; null if a band it needs is null or a denominator is 0."""
    blue, green, red, nir, swir1, swir2 = (F.col(b) for b in BANDS)
    weighted = lambda w: sum((F.col(b) * x for b, x in zip(BANDS[1:], w[1:], strict=True)), F.col(BANDS[0]) * w[0])
    linear = 2 * nir + 1
    ndvi = _normalised(nir, red)
    return {
        "dvi": nir - red,
        "nddi": _normalised(red, nir),
        "evi": ratio(2.5 * (nir - red), nir + 6 * red - 7.5 * blue + 1),
        "psri": ratio(red - blue, nir + EPS),
        "ndmi": _normalised(nir, swir1),
        "ndti": _normalised(swir1, swir2),
        "msi": ratio(swir1, nir + EPS),
        "msavi": F.when(red.isNotNull(), (linear - F.sqrt(F.greatest(F.lit(0.0), linear * linear - 8 * (nir - red)))) / 2),
        "ndvi": ndvi,
        "osavi": ratio(nir - red, nir + red + 0.16),
        "nirv": nir * ndvi * 1.3,
        "nbr": _normalised(nir, swir2),
        "tcw": _normalised(swir1, swir2),
        "pri": _normalised(green, red),
        "mcari": ((red - green) - 0.2 * (red - blue)) * ratio(red, green + EPS),
        "tcb": weighted(BRIGHTNESS),
        "gvi": weighted(GREENNESS),
        "satvi": ratio(swir1 - red, swir1 + red + 0.5) * 1.5,
    }


def sensor_check_indices() -> dict[str, Column]:
    """The indices of the sensor check, whose denominators have no guard term and whose root is not floored."""
    blue, red, nir = F.col("blue"), F.col("red"), F.col("nir")
    linear = 2 * nir + 1
    inside = linear * linear - 8 * (nir - red)
    return {
        "ndvi": ratio(nir - red, nir + red),
        "evi": ratio(2.5 * (nir - red), nir + 6 * red - 7.5 * blue + 1),
        "msavi": F.when(inside >= 0, (linear - F.sqrt(inside)) / 2),
        "dvi": nir - red,
    }


def with_indices(df: DataFrame) -> DataFrame:
    """Adds every index, replacing columns of the same name."""
    return df.withColumns(spectral_indices())


def evi_or_fallback(df: DataFrame) -> DataFrame:
    """EVI; where a table has none at all, red stands in for a missing blue."""
    any_evi = df.agg(F.count("evi").alias("n")).first()["n"] > 0
    if any_evi:
        return df
    nir, red = F.col("nir"), F.col("red")
    blue = F.coalesce("blue", "red") if "blue" in df.columns else red
    return df.withColumn("evi", ratio(2.5 * (nir - red), nir + 6 * red - 7.5 * blue + 1))


def cos_zenith(lat: Column, doy: Column, hour: float = OVERPASS_HOUR) -> Column:
    """Cosine of the solar zenith angle at a latitude (degrees) and calendar day of year."""
    declination = F.radians(F.lit(23.45)) * F.sin(2 * math.pi * (284 + doy) / 365)
    angle = math.radians((hour - 12) * 15)
    phi = F.radians(lat)
    c = F.sin(phi) * F.sin(declination) + F.cos(phi) * F.cos(declination) * math.cos(angle)
    return F.when(c.isNotNull(), F.least(F.greatest(c, F.lit(-1.0)), F.lit(1.0)))


def solar_zenith(lat: Column, doy: Column, hour: float = OVERPASS_HOUR) -> Column:
    """Degrees."""
    return F.degrees(F.acos(cos_zenith(lat, doy, hour)))


def ppi(dvi: Column, cosz: Column, soil: Column, canopy: float = CANOPY_MAX) -> Column:
    """Plant phenology index, not clamped; null where an input is null or dvi equals the canopy maximum.

    The canopy maximum is lifted to soil + 0.001 where it does not exceed the soil value.
    """
    m = F.when(F.lit(canopy) <= soil, soil + 1e-3).otherwise(F.lit(canopy))
    d = 0.0336 + ratio(F.lit(0.0477), cosz)
    q = d + (1 - d) * ratio(F.lit(0.5), cosz)
    k = ratio(F.lit(1.0), 4 * q) * ratio(1 + m, 1 - m)
    inside = F.greatest(ratio(m - soil, m - dvi), F.lit(1e-6))
    return F.when((F.abs(m - dvi) > 1e-12) & soil.isNotNull(), k * F.log(inside))
