"""Queries of the general training-data operators: regular grid, neighbours, filled values, implausible readings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reedbed.operators.control_chart import flag_readings
from reedbed.operators.grid import ten_day_grid
from reedbed.operators.impute import fill_missing, filled_cells, held_out
from reedbed.operators.neighbours import radius_pairs
from reedbed.session import table

RADIUS_M = 90.0
BANDS = ["nir", "red", "swir1"]


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    grid = ten_day_grid(table(spark, folder, "observation"))
    return grid.where("state <> 'observed'").select("location_id", "pheno_year", "bin")


def p1_grid(spark: SparkSession, folder: str) -> DataFrame:
    grid = ten_day_grid(table(spark, folder, "observation"))
    rounded = [F.round(F.col(c) + 1e-9, 6).alias(c) for c in ("value", "filled")]
    return grid.select("location_id", "pheno_year", "bin", F.col("n").cast("bigint").alias("n"), *rounded, "state")


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return radius_pairs(table(spark, folder, "location_dim"), "location_id", RADIUS_M).select("location_id_1", "location_id_2")


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return filled_cells(fill_missing(table(spark, folder, "coefficient")))


def p5_filled(spark: SparkSession, folder: str) -> DataFrame:
    return fill_missing(table(spark, folder, "coefficient"))


def p5_held_out(spark: SparkSession, folder: str) -> DataFrame:
    return held_out(table(spark, folder, "coefficient"))


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    return p6_reasons(spark, folder).select("obs_id", "band")


def p6_reasons(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "observation").where(F.col("date").isNotNull())
    return flag_readings(rows, "location_id", "acquired_at", "obs_id", BANDS)


def p6_certain(spark: SparkSession, folder: str) -> DataFrame:
    """Impossible and stuck readings."""
    return p6_reasons(spark, folder).where("reason <> 'spike'")


QUERIES = {f.__name__: f for f in (p1_found, p1_grid, p3_found, p5_found, p5_filled, p5_held_out, p6_found, p6_reasons, p6_certain)}

_GRID = """
WITH r AS (SELECT DISTINCT obs_id, location_id, date, nir FROM observation
           WHERE location_id IS NOT NULL AND date IS NOT NULL AND nir >= 0 AND nir <= 1 AND NOT isnan(nir)),
s AS (SELECT *, year(date) - CASE WHEN month(date) < 3 THEN 1 ELSE 0 END AS py FROM r),
d AS (SELECT *, CAST(ceil((date_diff('day', make_date(py, 3, 1), date) + 1) / 10.0) AS INTEGER) AS bin FROM s),
b AS (SELECT location_id, py * 36 + bin - 1 AS slot, count(*) AS n, avg(nir) AS value FROM d WHERE bin <= 36 GROUP BY ALL),
e AS (SELECT location_id, min(slot) AS lo, max(slot) AS hi FROM b GROUP BY ALL),
g AS (SELECT location_id, unnest(generate_series(lo, hi)) AS slot FROM e),
j AS (SELECT g.location_id, g.slot, b.n, b.value FROM g LEFT JOIN b USING (location_id, slot))
"""

_P5 = """
WITH r AS (SELECT DISTINCT coef_row_id, location_id, coef, veg, pheno_year, lower(regexp_replace(veg, '\\s+', '', 'g')) AS v FROM coefficient),
f AS (SELECT coef_row_id, location_id,
        coalesce(coef >= 0 AND coef <= 1 AND NOT isnan(coef), false) AS has_coef,
        coalesce(v IN ('bare', 'alhagi') OR (length(v) >= 5 AND list_min([levenshtein(v, n) FOR n IN
          ['barren','herbs','populus','tamarix','alhagi','salicornia','halocnemum','phragmites']]) <= 2), false) AS has_veg,
        coalesce(pheno_year BETWEEN 1986 AND 2025, false) AS has_year FROM r WHERE location_id IS NOT NULL),
l AS (SELECT location_id, bool_or(has_coef) AS c, bool_or(has_veg) AS v, bool_or(has_year) AS y FROM f GROUP BY 1),
j AS (SELECT * FROM f JOIN l USING (location_id))
SELECT DISTINCT coef_row_id, 'coef' AS field FROM j WHERE NOT has_coef AND c
UNION SELECT coef_row_id, 'veg' FROM j WHERE NOT has_veg AND v
UNION SELECT coef_row_id, 'pheno_year' FROM j WHERE NOT has_year AND y
"""

SQL = {
    "p1_found": _GRID + "SELECT location_id, CAST(floor(slot / 36.0) AS INTEGER) AS pheno_year, CAST(slot % 36 + 1 AS INTEGER) AS bin FROM j WHERE n IS NULL",
    "p1_grid": _GRID + """, k AS (SELECT *, max(CASE WHEN n IS NOT NULL THEN slot END) OVER (PARTITION BY location_id ORDER BY slot) AS at FROM j)
SELECT k.location_id, CAST(floor(k.slot / 36.0) AS INTEGER) AS pheno_year, CAST(k.slot % 36 + 1 AS INTEGER) AS bin, coalesce(k.n, 0) AS n,
  round(k.value + 1e-9, 6) AS value, CASE WHEN k.slot - k.at <= 3 THEN round(b.value + 1e-9, 6) END AS filled,
  CASE WHEN k.n IS NOT NULL THEN 'observed' WHEN k.slot - k.at <= 3 THEN 'carried' ELSE 'missing' END AS state
FROM k JOIN b ON b.location_id = k.location_id AND b.slot = k.at""",
    "p3_found": """
WITH p AS (SELECT location_id AS id, min({'lat': lat, 'lon': lon}) AS p FROM location_dim
           WHERE location_id IS NOT NULL AND lat BETWEEN -90 AND 90 AND lon BETWEEN -180 AND 360 AND NOT (lat = 0 AND lon = 0) GROUP BY 1),
q AS (SELECT id, p.lat AS lat, p.lon AS lon FROM p)
SELECT a.id AS location_id_1, b.id AS location_id_2 FROM q a JOIN q b ON a.id < b.id AND abs(a.lat - b.lat) < 0.001
WHERE 2 * 6371000 * asin(sqrt(pow(sin(radians(b.lat - a.lat) / 2), 2)
      + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lon - a.lon) / 2), 2))) <= 90""",
    "p5_found": _P5,
    "p6_certain": """
WITH o AS (SELECT DISTINCT obs_id, location_id, acquired_at, nir, red, swir1 FROM observation WHERE location_id IS NOT NULL AND date IS NOT NULL AND acquired_at IS NOT NULL),
l AS (SELECT obs_id, location_id, acquired_at, 'nir' AS band, nir AS v FROM o UNION ALL SELECT obs_id, location_id, acquired_at, 'red', red FROM o UNION ALL SELECT obs_id, location_id, acquired_at, 'swir1', swir1 FROM o),
m AS (SELECT *, CASE WHEN v >= 0 AND v <= 1 AND NOT isnan(v) THEN v END AS p FROM l),
g AS (SELECT *, lag(p) OVER w AS before, row_number() OVER w AS r FROM m WINDOW w AS (PARTITION BY location_id, band ORDER BY acquired_at, obs_id)),
s AS (SELECT *, sum(CASE WHEN p = before THEN 0 ELSE 1 END) OVER (PARTITION BY location_id, band ORDER BY r) AS run FROM g),
c AS (SELECT *, count(p) OVER (PARTITION BY location_id, band, run) AS n FROM s)
SELECT obs_id, band, 'impossible' AS reason FROM c WHERE isfinite(v) AND (v < 0 OR v > 1) UNION ALL SELECT obs_id, band, 'stuck' FROM c WHERE p IS NOT NULL AND n >= 6""",
}
