"""Queries of the operators in this package, and SQL that gives the same rows where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reedbed.functions.calendar import pheno_year
from reedbed.llm.bpe import encode_corpus
from reedbed.llm.garble import find_garbled, regained
from reedbed.llm.nearest_time import nearest_in_time
from reedbed.llm.packing import pack, packed_line, packing_quality
from reedbed.llm.quantiles import combine, percentiles, summarise
from reedbed.session import materialise, table

TOLERANCE_S = 345_600
QUANTILES = {"p05": 0.05, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p95": 0.95}
CAPACITY = 2048


def p2_pairs(spark: SparkSession, folder: str) -> DataFrame:
    scans = table(spark, folder, "sensor_obs").select("scan_id", "location_id", "acquired_at", F.upper(F.trim("satellite")).alias("family"))
    older, newer = (scans.where(F.col("family") == f) for f in ("LANDSAT_457", "LANDSAT_89"))
    return nearest_in_time(older, newer, "location_id", "acquired_at", "scan_id", TOLERANCE_S)


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    ids = (F.col("left_id"), F.col("right_id"))
    return p2_pairs(spark, folder).select(F.least(*ids).alias("scan_id_1"), F.greatest(*ids).alias("scan_id_2"))


def _dvi(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "observation").where("location_id is not null")
    return rows.select("obs_id", "location_id", pheno_year(F.col("date")).alias("pheno_year"), "dvi")


def _rounded(df: DataFrame) -> DataFrame:
    return df.select(*[F.round(F.col(c) + 1e-9, 6).alias(c) if c in (*QUANTILES, "rank_error") else c for c in df.columns])


def p4_percentiles(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded(percentiles(_dvi(spark, folder), ["location_id"], "dvi", "obs_id", QUANTILES))


def p4_seasons(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded(percentiles(_dvi(spark, folder), ["location_id", "pheno_year"], "dvi", "obs_id", QUANTILES))


def p4_combined(spark: SparkSession, folder: str) -> DataFrame:
    seasons = summarise(_dvi(spark, folder), ["location_id", "pheno_year"], "dvi", "obs_id")
    return _rounded(combine(seasons, ["location_id"], QUANTILES))


def p7_ids(spark: SparkSession, folder: str) -> DataFrame:
    return encode_corpus(table(spark, folder, "documents"))


def p8_packed(spark: SparkSession, folder: str) -> DataFrame:
    return pack(table(spark, folder, "documents"), capacity=CAPACITY)


def p8_quality(spark: SparkSession, folder: str) -> DataFrame:
    return packing_quality(packed_line(table(spark, folder, "documents"), capacity=CAPACITY), CAPACITY)


def p8_whole(spark: SparkSession, folder: str) -> DataFrame:
    """Every document with its number of containers below two pieces' worth: each once, pieces counted from 0 without a gap, and no container above the capacity."""
    line = materialise(packed_line(table(spark, folder, "documents"), capacity=CAPACITY), "packed")
    full = line.groupBy("container").agg(F.sum("tokens").alias("s")).where(F.col("s") > CAPACITY).select("container")
    per = line.join(full.withColumn("over", F.lit(1)), "container", "left").groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("k"), F.countDistinct(F.coalesce("piece", F.lit(0))).alias("d"), (F.max(F.coalesce("piece", F.lit(0))) + 1).alias("m"), F.count("over").alias("over"))
    return per.select("doc_id", ((F.col("k") == F.col("d")) & (F.col("k") == F.col("m"))).alias("once"), F.col("over").alias("over"))


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    return find_garbled(table(spark, folder, "documents")).select("doc_id").distinct()


def p9_restored(spark: SparkSession, folder: str) -> DataFrame:
    return find_garbled(table(spark, folder, "documents"))


def p9_regained(spark: SparkSession, folder: str) -> DataFrame:
    return regained(table(spark, folder, "documents"))


QUERIES = {f.__name__: f for f in (p2_found, p2_pairs, p4_percentiles, p4_seasons, p4_combined, p7_ids, p8_packed, p8_quality, p8_whole, p9_found, p9_restored, p9_regained)}

_PAIRS = """
WITH s AS (SELECT DISTINCT scan_id, location_id, acquired_at, upper(trim(satellite)) AS family FROM sensor_obs
           WHERE location_id IS NOT NULL AND acquired_at IS NOT NULL AND satellite IS NOT NULL),
c AS (SELECT a.scan_id AS left_id, b.scan_id AS right_id, epoch_us(b.acquired_at) - epoch_us(a.acquired_at) AS gap_us
      FROM s a JOIN s b ON a.location_id = b.location_id AND a.family = 'LANDSAT_457' AND b.family = 'LANDSAT_89'
       AND abs(epoch_us(b.acquired_at) - epoch_us(a.acquired_at)) <= 345600000000),
r AS (SELECT *, row_number() OVER (PARTITION BY left_id ORDER BY abs(gap_us), gap_us, right_id) AS k FROM c)
"""
_VALUES = """
WITH o AS (SELECT DISTINCT obs_id, location_id, dvi, year(date) - CASE WHEN month(date) < 3 THEN 1 ELSE 0 END AS pheno_year
           FROM observation WHERE location_id IS NOT NULL AND dvi IS NOT NULL AND NOT isnan(dvi))
"""
_CONT = ", ".join(f"round(quantile_cont(dvi, {q}) + 1e-9, 6) AS {name}" for name, q in QUANTILES.items())
_DISC = ", ".join(f"round(min(CASE WHEN upto >= total * {q} THEN v END) + 1e-9, 6) AS {name}" for name, q in QUANTILES.items())

SQL = {
    "p2_found": _PAIRS + "SELECT least(left_id, right_id) AS scan_id_1, greatest(left_id, right_id) AS scan_id_2 FROM r WHERE k = 1",
    "p2_pairs": _PAIRS + "SELECT left_id, right_id, gap_us FROM r WHERE k = 1",
    "p8_whole": "SELECT doc_id, true AS once, 0 AS over FROM documents WHERE text <> ''",
    "p4_percentiles": _VALUES + f"SELECT location_id, count(*) AS n, {_CONT}, 0.0 AS rank_error FROM o GROUP BY 1",
    "p4_seasons": _VALUES + f"SELECT location_id, pheno_year, count(*) AS n, {_CONT}, 0.0 AS rank_error FROM o GROUP BY 1, 2",
    "p4_combined": _VALUES + f""",
k AS (SELECT location_id, pheno_year, dvi, row_number() OVER w AS r, count(*) OVER (PARTITION BY location_id, pheno_year) AS n FROM o
      WINDOW w AS (PARTITION BY location_id, pheno_year ORDER BY dvi, obs_id)),
p AS (SELECT *, r - coalesce(lag(r) OVER (PARTITION BY location_id, pheno_year ORDER BY r), 0) AS w FROM k WHERE n <= 64 OR r * 64 // n > (r - 1) * 64 // n),
v AS (SELECT location_id, dvi AS v, sum(w) AS w FROM p GROUP BY 1, 2),
h AS (SELECT *, sum(w) OVER (PARTITION BY location_id ORDER BY v) AS upto, sum(w) OVER (PARTITION BY location_id) AS total FROM v),
e AS (SELECT location_id, sum(CASE WHEN n > 64 THEN ceil(n / 64.0) ELSE 0 END) / sum(n) AS err FROM (SELECT DISTINCT location_id, pheno_year, n FROM k) GROUP BY 1)
SELECT h.location_id, CAST(max(total) AS BIGINT) AS n, {_DISC}, round(max(err) + 1e-9, 6) AS rank_error FROM h JOIN e USING (location_id) GROUP BY 1""",
}
