"""The tables that the queries start from: cleaned once at ingest, as DataFrames and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reedbed.functions.calendar import capped_bin, pheno_doy, pheno_year
from reedbed.functions.indices import BANDS
from reedbed.functions.labels import canonical_label, named_class
from reedbed.functions.numeric import finite, plausible
from reedbed.session import table


def obs(spark: SparkSession, folder: str) -> DataFrame:
    """Readings of the observation table, repeated deliveries once: labels and sensors in one spelling, bands null unless within 0 to 1,
    with calendar and phenological day, season and ten-day bin."""
    rows = table(spark, folder, "observation").where("location_id is not null and date is not null")
    d = F.col("date")
    once = rows.select("obs_id", "location_id", "date", F.upper(F.trim("satellite")).alias("satellite"), finite(F.col("lat")).alias("lat"), finite(F.col("lon")).alias("lon"),
                       canonical_label(F.col("vegetation")).alias("veg"), *[plausible(finite(F.col(b))).alias(b) for b in BANDS]).distinct()
    return once.withColumns({"py": pheno_year(d), "doy_cal": F.dayofyear(d), "doy": pheno_doy(d)}).withColumn("bin", capped_bin(F.col("doy")))


def scans(spark: SparkSession, folder: str) -> DataFrame:
    """Scans of the sensor table, repeated deliveries once."""
    rows = table(spark, folder, "sensor_obs").where("location_id is not null and date is not null")
    return rows.select("scan_id", "location_id", "date", F.upper(F.trim("satellite")).alias("satellite"), "year", "doy", *[plausible(finite(F.col(b))).alias(b) for b in BANDS]).distinct()


def coefs(spark: SparkSession, folder: str) -> DataFrame:
    """Usable coefficients: location, season, class and value present, each record once."""
    c = table(spark, folder, "coefficient")
    v = F.col("coef")
    rows = c.where((v >= 0) & (v <= 1) & F.col("pheno_year").between(1986, 2025) & F.col("location_id").isNotNull())
    named = rows.select("coef_row_id", "location_id", F.col("pheno_year").alias("py"), finite(F.col("lat")).alias("lat"), finite(F.col("lon")).alias("lon"),
                        named_class(F.col("veg")).alias("veg"), "variant_id", "coef", "rmse", "n_obs", "n_summer_obs")
    return named.where("veg is not null").distinct()


def places(spark: SparkSession, folder: str) -> DataFrame:
    """Each location of the dimension once: its first position and class that are given."""
    p = table(spark, folder, "location_dim").where("location_id is not null")
    lat, lon = finite(F.col("lat")), finite(F.col("lon"))
    there = lat.isNotNull() & lon.isNotNull() & ~((lat == 0) & (lon == 0))
    return p.groupBy("location_id").agg(F.min(F.when(there, F.struct(lat.alias("lat"), lon.alias("lon")))).alias("p"), F.min(named_class(F.col("veg"))).alias("veg")).select(
        "location_id", "p.lat", "p.lon", "veg"
    )


def water(spark: SparkSession, folder: str) -> DataFrame:
    """Stand-in for groundwater sheets: a depth for each order, its status as the sheet."""
    return table(spark, folder, "orders").select(F.col("o_orderstatus").alias("sheet"), F.year("o_orderdate").alias("year"), F.col("o_totalprice").alias("depth"))


def library(spark: SparkSession, folder: str) -> DataFrame:
    """Labelled vectors: vec_id, cls, x."""
    return table(spark, folder, "embeddings").select("vec_id", F.col("label").alias("cls"), F.col("embedding").cast("array<double>").alias("x"))


def _band(b: str) -> str:
    return f"CASE WHEN {b} >= 0 AND {b} <= 1 AND NOT isnan({b}) THEN {b} END AS {b}"


_CANON = """CASE WHEN lower(trim({c})) = 'tamairx' THEN 'tamarix' WHEN lower(trim({c})) IN ('herbs','alhagi','salicornia','halocnemum','phragmites') THEN 'herbs'
  WHEN lower(trim({c})) IN ('agri','agric','agriculture','agricultural') THEN 'agriculture' ELSE lower(trim({c})) END"""
_NAMED = """(SELECT CASE WHEN v IN ('barren','bare') THEN 'barren' WHEN v IN ('herbs','alhagi','salicornia','halocnemum','phragmites') THEN 'herbs' WHEN v IN ('populus','tamarix') THEN v
  WHEN length(v) NOT BETWEEN 5 AND 12 THEN NULL WHEN levenshtein(v,'barren')<=2 THEN 'barren' WHEN levenshtein(v,'herbs')<=2 THEN 'herbs' WHEN levenshtein(v,'populus')<=2 THEN 'populus'
  WHEN levenshtein(v,'tamarix')<=2 THEN 'tamarix' WHEN levenshtein(v,'alhagi')<=2 OR levenshtein(v,'salicornia')<=2 OR levenshtein(v,'halocnemum')<=2 OR levenshtein(v,'phragmites')<=2 THEN 'herbs' END
  FROM (SELECT lower(regexp_replace({c}, '\\s+', '', 'g')) AS v))"""
_FIN = "CASE WHEN NOT isnan({c}) AND abs({c}) < 1e300 THEN {c} END"

SQL_OBS = f"""
obs0 AS (SELECT DISTINCT obs_id, location_id, date, upper(trim(satellite)) AS satellite, {_FIN.format(c='lat')} AS lat, {_FIN.format(c='lon')} AS lon,
  {_CANON.format(c='vegetation')} AS veg, {', '.join(_band(b) for b in BANDS)} FROM observation WHERE location_id IS NOT NULL AND date IS NOT NULL),
obs1 AS (SELECT *, year(date) - CASE WHEN month(date) < 3 THEN 1 ELSE 0 END AS py, dayofyear(date) AS doy_cal FROM obs0),
obs2 AS (SELECT *, date_diff('day', make_date(py, 3, 1), date) + 1 AS doy FROM obs1),
obs AS (SELECT *, least(CAST(ceil(doy / 10.0) AS INTEGER), 37) AS bin FROM obs2)"""
SQL_SCANS = f"""
scans AS (SELECT DISTINCT scan_id, location_id, date, upper(trim(satellite)) AS satellite, year, doy, {', '.join(_band(b) for b in BANDS)}
  FROM sensor_obs WHERE location_id IS NOT NULL AND date IS NOT NULL)"""
SQL_COEFS = f"""
coefs0 AS (SELECT DISTINCT coef_row_id, location_id, pheno_year AS py, {_FIN.format(c='lat')} AS lat, {_FIN.format(c='lon')} AS lon, {_NAMED.format(c='veg')} AS veg,
  variant_id, coef, rmse, n_obs, n_summer_obs FROM coefficient WHERE coef >= 0 AND coef <= 1 AND NOT isnan(coef) AND pheno_year BETWEEN 1986 AND 2025 AND location_id IS NOT NULL),
coefs AS (SELECT * FROM coefs0 WHERE veg IS NOT NULL)"""
SQL_PLACES = f"""
places0 AS (SELECT location_id, min(CASE WHEN NOT isnan(lat) AND NOT isnan(lon) AND lat IS NOT NULL AND lon IS NOT NULL AND NOT (lat = 0 AND lon = 0) THEN {{'lat': lat, 'lon': lon}} END) AS p,
  min({_NAMED.format(c='veg')}) AS veg FROM location_dim WHERE location_id IS NOT NULL GROUP BY 1),
places AS (SELECT location_id, p.lat AS lat, p.lon AS lon, veg FROM places0)"""
SQL_WATER = "water AS (SELECT o_orderstatus AS sheet, year(o_orderdate) AS year, o_totalprice AS depth FROM orders)"
SQL_LIBRARY = "library AS (SELECT vec_id, label AS cls, CAST(embedding AS DOUBLE[]) AS x FROM embeddings)"


def with_(*parts: str) -> str:
    return "WITH " + ",".join(parts)


#: The index formulas in SQL, written from their definitions.
SQL_INDICES = {
    "dvi": "nir - red", "nddi": "(red - nir) / nullif(red + nir + 1e-9, 0)", "evi": "2.5 * (nir - red) / nullif(nir + 6 * red - 7.5 * blue + 1, 0)",
    "psri": "(red - blue) / nullif(nir + 1e-9, 0)", "ndmi": "(nir - swir1) / nullif(nir + swir1 + 1e-9, 0)", "ndti": "(swir1 - swir2) / nullif(swir1 + swir2 + 1e-9, 0)",
    "msi": "swir1 / nullif(nir + 1e-9, 0)", "msavi": "(2 * nir + 1 - sqrt(CASE WHEN pow(2 * nir + 1, 2) - 8 * (nir - red) > 0 THEN pow(2 * nir + 1, 2) - 8 * (nir - red) ELSE 0 * (nir - red) END)) / 2",
    "ndvi": "(nir - red) / nullif(nir + red + 1e-9, 0)", "osavi": "(nir - red) / nullif(nir + red + 0.16, 0)", "nirv": "nir * ((nir - red) / nullif(nir + red + 1e-9, 0)) * 1.3",
    "nbr": "(nir - swir2) / nullif(nir + swir2 + 1e-9, 0)", "tcw": "(swir1 - swir2) / nullif(swir1 + swir2 + 1e-9, 0)", "pri": "(green - red) / nullif(green + red + 1e-9, 0)",
    "mcari": "((red - green) - 0.2 * (red - blue)) * (red / nullif(green + 1e-9, 0))", "tcb": ".3029*blue+.2786*green+.4733*red+.5599*nir+.508*swir1+.1872*swir2",
    "gvi": "-.2941*blue-.243*green-.5424*red+.7276*nir+.0713*swir1-.1608*swir2", "satvi": "(swir1 - red) / nullif(swir1 + red + 0.5, 0) * 1.5",
}
