"""Queries of joins, aggregates, windows and reshaping."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reedbed.functions import indices as ix
from reedbed.functions.numeric import cover_of, r6
from reedbed.operators import filters, harmonise, relational as rel, soil
from reedbed.operators.ranks import group_percentiles
from reedbed.plans.expression_queries import _PPI, _SOIL, sr
from reedbed.plans.views import SQL_COEFS, SQL_INDICES, SQL_OBS, SQL_PLACES, SQL_SCANS, SQL_WATER, coefs, obs, places, scans, water, with_
from reedbed.session import table
from reedbed.sources.ingest import sensor_bias

QUERIES, SQL = {}, {}
BANDS = list(ix.BANDS)
INDEX4 = ["psri", "ndmi", "ndti", "msi"]


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.select(*[r6(F.col(c)).alias(c) if c in names else c for c in df.columns])


_PAIRS = SQL_SCANS + ", pairs AS (SELECT a.location_id, a.date, a.year, a.doy, " + ", ".join(f"a.{b} AS {b}_457, b.{b} AS {b}_89" for b in BANDS) + """
  FROM scans a JOIN scans b ON a.location_id = b.location_id AND a.date = b.date WHERE a.satellite = 'LANDSAT_457' AND b.satellite = 'LANDSAT_89'),
long AS (""" + " UNION ALL ".join(f"SELECT location_id, date, year, doy, '{b}' AS band, {b}_457 AS val_457, {b}_89 AS val_89 FROM pairs" for b in BANDS) + ")"


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    s = scans(spark, d)
    calendar = s.select("location_id", "date", "year", "doy").dropDuplicates(["location_id", "date"])
    return rel.sensor_pairs(s, BANDS).join(calendar, ["location_id", "date"], "left")


def _long(spark: SparkSession, d: str) -> DataFrame:
    return rel.melt_pairs(_pairs(spark, d), BANDS, ["location_id", "date", "year", "doy"])


@query(with_(_PAIRS) + f"SELECT location_id, count(*) AS n, {sr('avg(nir_457)', 'nir_457')}, {sr('avg(nir_89)', 'nir_89')} FROM pairs GROUP BY 1")
def sensor_pairs(spark: SparkSession, d: str) -> DataFrame:
    return rel.sensor_pairs(scans(spark, d), BANDS).groupBy("location_id").agg(F.count(F.lit(1)).alias("n"), *[r6(F.avg(c)).alias(c) for c in ("nir_457", "nir_89")])


@query(with_(_PAIRS) + f"SELECT band, year, count(*) AS n, {sr('sum(val_457)', 'val_457')}, {sr('sum(val_89)', 'val_89')} FROM long GROUP BY 1, 2")
def melt_pairs(spark: SparkSession, d: str) -> DataFrame:
    return _long(spark, d).groupBy("band", "year").agg(F.count(F.lit(1)).alias("n"), *[r6(F.sum(c)).alias(c) for c in ("val_457", "val_89")])


_MASK = """, ok AS (SELECT *, val_89 - val_457 AS d FROM long WHERE val_457 IS NOT NULL AND val_89 IS NOT NULL),
md AS (SELECT band, median(val_457) AS a, median(val_89) AS b, median(d) AS c, count(*) AS n FROM ok GROUP BY 1),
ad AS (SELECT band, median(abs(val_457 - a)) AS sa, median(abs(val_89 - b)) AS sb, median(abs(d - c)) AS sc FROM ok JOIN md USING (band) GROUP BY 1),
mask AS (SELECT ok.* FROM ok JOIN md USING (band) JOIN ad USING (band) WHERE n < 10 OR (abs(val_457 - a) <= 4*sa AND abs(val_89 - b) <= 4*sb AND abs(d - c) <= 4*sc))"""


@query(with_(_PAIRS) + _MASK + f", m AS (SELECT band, count(*) AS kept, {sr('regr_slope(val_457, val_89)', 'slope')}, {sr('regr_intercept(val_457, val_89)', 'intercept')}, {sr('corr(val_457, val_89)', 'r')} FROM mask GROUP BY 1) SELECT * FROM m")
def pair_mask(spark: SparkSession, d: str) -> DataFrame:
    kept = filters.robust_pair_mask(_long(spark, d), ["band"], "val_457", "val_89")
    return kept.groupBy("band").agg(F.count(F.lit(1)).alias("kept"), r6(F.regr_slope("val_457", "val_89")).alias("slope"), r6(F.regr_intercept("val_457", "val_89")).alias("intercept"), r6(F.corr("val_457", "val_89")).alias("r"))


def _stats_sql(groups: str) -> str:
    d = "(val_89 - val_457)"
    return f"""SELECT {groups}, count(*) AS n, {sr(f'median({d})', 'median_bias')}, {sr(f'stddev_samp({d})', 'sd_bias')}, {sr(f'sqrt(avg({d}*{d}))', 'rmse')}, {sr(f'avg(abs({d}))', 'mae')},
      {sr('CASE WHEN count(*) >= 3 AND stddev_samp(val_457) > 1e-9 AND stddev_samp(val_89) > 1e-9 THEN pow(corr(val_457, val_89), 2) END', 'r2')}, {sr(f'stddev_samp({d})/sqrt(count(*))', 'se')} FROM long WHERE val_457 IS NOT NULL AND val_89 IS NOT NULL GROUP BY ALL"""


_STATS = ("median_bias", "sd_bias", "rmse", "mae", "r2", "se")


@query(with_(_PAIRS) + _stats_sql("band"))
def bias_stats(spark: SparkSession, d: str) -> DataFrame:
    return rounded(rel.bias_stats(_long(spark, d), ["band"]), *_STATS)


@query(with_(_PAIRS) + _stats_sql("year, band"))
def bias_by_year(spark: SparkSession, d: str) -> DataFrame:
    return rounded(rel.bias_stats(_long(spark, d), ["year", "band"]), *_STATS)


@query(with_(_PAIRS) + """, u AS (SELECT *, CAST('0x' || substr(md5(location_id || '|' || CAST(date AS VARCHAR) || '/0/42'), 1, 8) AS BIGINT) AS u FROM long),
r AS (SELECT *, row_number() OVER (PARTITION BY band ORDER BY u, location_id || '|' || CAST(date AS VARCHAR)) AS r FROM u) SELECT location_id, CAST(date AS VARCHAR) AS day, band FROM r WHERE r <= 100""")
def pair_sample(spark: SparkSession, d: str) -> DataFrame:
    """A hundred pairs of each band."""
    long = _long(spark, d).withColumn("k", F.concat_ws("|", "location_id", F.col("date").cast("string")))
    return rel.sample_by(long, ["band"], "k", 100).select("location_id", F.col("date").cast("string").alias("day"), "band")


@query(with_(_PAIRS) + ", q AS (SELECT location_id, CASE WHEN doy <= 360 THEN CAST(ceil(doy/30.0) AS INTEGER) END AS bin30, band, val_89 - val_457 AS d FROM long) SELECT bin30, band, count(d) AS n, " + sr("avg(d)", "bias") + " FROM q WHERE d IS NOT NULL GROUP BY 1, 2")
def bias_by_bin(spark: SparkSession, d: str) -> DataFrame:
    long = _long(spark, d).withColumn("d", F.col("val_89") - F.col("val_457")).where("d is not null")
    return long.groupBy(F.when(F.col("doy") <= 360, F.ceil(F.col("doy") / 30)).cast("int").alias("bin30"), "band").agg(F.count("d").alias("n"), r6(F.avg("d")).alias("bias"))


@query(with_(_PAIRS) + "SELECT location_id, band, count(*) AS n, " + sr("avg(val_89 - val_457)", "bias") + " FROM long WHERE val_89 - val_457 IS NOT NULL GROUP BY 1, 2")
def bias_by_loc(spark: SparkSession, d: str) -> DataFrame:
    long = _long(spark, d).withColumn("d", F.col("val_89") - F.col("val_457")).where("d is not null")
    return long.groupBy("location_id", "band").agg(F.count("d").alias("n"), r6(F.avg("d")).alias("bias"))


@query(with_(SQL_SCANS) + ", f AS (" + " UNION ALL ".join(
    f"SELECT year, satellite, '{b}' AS band, 'raw' AS correction, {b} AS v FROM scans UNION ALL SELECT year, satellite, '{b}', 'corrected', CASE WHEN satellite = 'LANDSAT_89' AND coalesce(w.ols_significant, true) THEN {b} * w.ols_slope + w.ols_intercept ELSE {b} END FROM scans, sensor_bias w WHERE w.band = '{b}'"
    for b in BANDS) + f") SELECT year, satellite, band, correction, {sr('avg(v)', 'value')}, count(v) AS n FROM f GROUP BY 1, 2, 3, 4")
def raw_vs_corrected(spark: SparkSession, d: str) -> DataFrame:
    terms = harmonise.coefficients(sensor_bias(table(spark, d, "sensor_bias")))
    return rounded(rel.raw_and_corrected(scans(spark, d), BANDS, terms), "value")


@query(with_(SQL_OBS, SQL_PLACES) + f", j AS (SELECT coalesce(nullif(o.veg, ''), p.veg) AS veg, p.lat AS lat, o.nir FROM obs o LEFT JOIN places p USING (location_id)) SELECT veg, count(*) AS n, count(lat) AS with_lat, {sr('avg(nir)', 'nir')} FROM j GROUP BY 1")
def fill_veg(spark: SparkSession, d: str) -> DataFrame:
    j = rel.fill_class(obs(spark, d), places(spark, d))
    return j.groupBy("veg").agg(F.count(F.lit(1)).alias("n"), F.count("lat").alias("with_lat"), r6(F.avg("nir")).alias("nir"))


_DENSE = """, s AS (SELECT location_id, py, veg, sum(coef) AS coef FROM coefs GROUP BY 1, 2, 3), g AS (SELECT * FROM (SELECT DISTINCT location_id FROM coefs), (SELECT DISTINCT py FROM coefs), (SELECT DISTINCT veg FROM coefs)),
dense AS (SELECT location_id, py, veg, coalesce(coef, 0) AS coef FROM g LEFT JOIN s USING (location_id, py, veg))"""


@query(with_(SQL_COEFS) + _DENSE + f"SELECT py, veg, count(*) AS n, {sr('avg(coef)', 'coef')}, {sr('stddev_samp(coef)', 'sd')}, {sr('stddev_samp(coef) / sqrt(count(*))', 'se')} FROM dense GROUP BY 1, 2")
def densify(spark: SparkSession, d: str) -> DataFrame:
    dense = rel.densify(coefs(spark, d), "location_id", "py", "veg", "coef")
    return dense.groupBy("py", "veg").agg(F.count(F.lit(1)).alias("n"), r6(F.avg("coef")).alias("coef"), r6(F.stddev_samp("coef")).alias("sd"), r6(F.stddev_samp("coef") / F.sqrt(F.count(F.lit(1)))).alias("se"))


_SERIES = """, v AS (SELECT py, veg, avg(coef) AS coef, count(DISTINCT location_id) AS n_sites FROM coefs GROUP BY 1, 2),
w AS (SELECT sheet, year, avg(depth) AS gw_mean, median(depth) AS gw_median, count(*) AS n_obs FROM water GROUP BY 1, 2),
l AS (SELECT veg, sheet, lag, py, coef, gw_mean FROM w, (SELECT unnest(generate_series(-2, 3)) AS lag) JOIN v ON v.py = w.year + lag)"""


@query(with_(SQL_WATER) + f"SELECT sheet, year, {sr('avg(depth)', 'gw_mean')}, {sr('median(depth)', 'gw_median')}, count(*) AS n_obs FROM water GROUP BY 1, 2")
def gw_yearly(spark: SparkSession, d: str) -> DataFrame:
    return rounded(water_years(spark, d), "gw_mean", "gw_median")


def water_years(spark: SparkSession, d: str) -> DataFrame:
    return group_percentiles(water(spark, d), ["sheet", "year"], {"gw_median": "depth"}, [0.5], also={"gw_mean": F.avg("depth"), "n_obs": F.count(F.lit(1))})


def class_years(spark: SparkSession, d: str) -> DataFrame:
    return coefs(spark, d).groupBy("py", "veg").agg(F.avg("coef").alias("coef"), F.countDistinct("location_id").alias("n_sites"))


@query(with_(SQL_COEFS, SQL_WATER) + _SERIES + f"SELECT veg, sheet, CAST(lag AS INTEGER) AS lag, py, {sr('coef', 'coef')}, {sr('gw_mean', 'gw_mean')} FROM l")
def lag_join(spark: SparkSession, d: str) -> DataFrame:
    return rounded(rel.lag_join(class_years(spark, d), water_years(spark, d)).select("veg", "sheet", "lag", "py", "coef", "gw_mean"), "coef", "gw_mean")


@query(with_(SQL_COEFS, SQL_WATER) + _SERIES + f"SELECT py, veg, {sr('coef', 'coef')}, n_sites FROM v")
def region_years(spark: SparkSession, d: str) -> DataFrame:
    return rounded(class_years(spark, d).select("py", "veg", "coef", "n_sites"), "coef")


@query(with_(SQL_COEFS) + "SELECT veg, count(*) AS n FROM (SELECT CASE WHEN coef_row_id % 7 = 0 THEN veg || '_opt_1' ELSE veg END AS veg FROM coefs) WHERE veg NOT IN ('barren', 'herbs') AND NOT regexp_matches(veg, '_opt_[0-9]+$') GROUP BY 1")
def skip_classes(spark: SparkSession, d: str) -> DataFrame:
    """Rows that a comparison with groundwater keeps: no single variants, no excluded classes (a seventh of the labels is made a variant here)."""
    label = F.when(F.col("coef_row_id") % 7 == 0, F.concat("veg", F.lit("_opt_1"))).otherwise(F.col("veg"))
    return filters.skip_classes(coefs(spark, d).withColumn("veg", label), ("barren", "HERBS")).groupBy("veg").agg(F.count(F.lit(1)).alias("n"))


_COVER = "CASE WHEN msavi IS NOT NULL AND 0.9 + msavi <> 0 THEN least(greatest(-0.2 + 1.1 * (0.1 + msavi) / (0.9 + msavi), 0), 1) END"


@query(with_(SQL_OBS) + f", m AS (SELECT location_id, {SQL_INDICES['msavi']} AS msavi FROM obs) SELECT location_id, count(msavi) AS n, {sr(f'avg({_COVER})', 'cover')}, {sr('avg(CASE WHEN msavi IS NOT NULL THEN least(greatest(0.1 + 1.5 * msavi, 0), 1) END)', 'plain')} FROM m GROUP BY 1")
def cover_model(spark: SparkSession, d: str) -> DataFrame:
    m = obs(spark, d).select("location_id", ix.spectral_indices()["msavi"].alias("msavi"))
    cover, plain = cover_of(F.col("msavi"), 1.1, -0.2, 0.1, 0.9), cover_of(F.col("msavi"), 1.5, 0.1)
    return rounded(m.groupBy("location_id").agg(F.count("msavi").alias("n"), F.avg(cover).alias("cover"), F.avg(plain).alias("plain")), "cover", "plain")


_BINS = ", bins AS (" + " UNION ALL ".join(f"SELECT location_id, py, '{i}' AS index_name, bin, avg({SQL_INDICES[i]}) AS value FROM obs WHERE bin < 37 GROUP BY ALL HAVING count({SQL_INDICES[i]}) > 0" for i in ("ndmi", "psri")) + ")"


@query(with_(SQL_OBS) + _BINS + f"SELECT location_id, py, index_name, count(*) AS filled, {sr('avg(value)', 'value')} FROM bins GROUP BY 1, 2, 3")
def bin_means(spark: SparkSession, d: str) -> DataFrame:
    b = rel.bin_means(ix.with_indices(obs(spark, d)), ["ndmi", "psri"])
    return b.groupBy("location_id", "py", "index_name").agg(F.count(F.lit(1)).alias("filled"), r6(F.avg("value")).alias("value"))


_FILL = """, kk AS (SELECT DISTINCT location_id, py, index_name FROM bins), gg AS (SELECT *, unnest(generate_series(1, 36)) AS bin FROM kk),
hh AS (SELECT g.*, b.value, max(CASE WHEN b.value IS NOT NULL THEN g.bin END) OVER (PARTITION BY g.location_id, g.py, g.index_name ORDER BY g.bin) AS lo,
  min(CASE WHEN b.value IS NOT NULL THEN g.bin END) OVER (PARTITION BY g.location_id, g.py, g.index_name ORDER BY g.bin DESC) AS hi FROM gg g LEFT JOIN bins b USING (location_id, py, index_name, bin)),
filled AS (SELECT h.location_id, h.py, h.index_name, h.bin, CASE WHEN h.lo IS NULL THEN b2.value WHEN h.hi IS NULL OR h.hi = h.lo THEN b1.value ELSE b1.value + (h.bin - h.lo) * (b2.value - b1.value) / (h.hi - h.lo) END AS value
  FROM hh h LEFT JOIN bins b1 ON b1.location_id = h.location_id AND b1.py = h.py AND b1.index_name = h.index_name AND b1.bin = h.lo
  LEFT JOIN bins b2 ON b2.location_id = h.location_id AND b2.py = h.py AND b2.index_name = h.index_name AND b2.bin = h.hi)"""


@query(with_(SQL_OBS) + _BINS + _FILL + f"SELECT location_id, py, index_name, {sr('sum(value)', 'total')}, {sr('sum(value * bin)', 'moment')} FROM filled GROUP BY 1, 2, 3")
def gap_fill(spark: SparkSession, d: str) -> DataFrame:
    f = rel.fill_bins(rel.bin_means(ix.with_indices(obs(spark, d)), ["ndmi", "psri"]))
    return f.groupBy("location_id", "py", "index_name").agg(r6(F.sum("value")).alias("total"), r6(F.sum(F.col("value") * F.col("bin"))).alias("moment"))


@query(with_(SQL_OBS) + _SOIL + f"SELECT location_id, {sr('soil', 'soil')} FROM soil")
def soil_q10(spark: SparkSession, d: str) -> DataFrame:
    return soil.low_quantile_baseline(obs(spark, d)).select("location_id", r6(F.col("soil")).alias("soil"))


@query(with_(SQL_OBS) + f"SELECT location_id, {sr('avg(nir - red)', 'soil')}, count(nir - red) AS n FROM obs WHERE month(date) IN (1,2,3) GROUP BY 1 HAVING count(nir - red) >= 1")
def soil_jfm(spark: SparkSession, d: str) -> DataFrame:
    return soil.winter_baseline(obs(spark, d)).select("location_id", r6(F.col("soil")).alias("soil"), "n")


@query(with_(SQL_OBS) + f"SELECT {sr('CASE WHEN count(nir - red) >= 5 THEN max(nir - red) END', 'canopy_max')}, count(nir - red) AS n FROM obs WHERE month(date) IN (7,8,9) AND veg IN ('populus','tamarix')")
def canopy_max(spark: SparkSession, d: str) -> DataFrame:
    return rounded(soil.canopy_max(obs(spark, d), F.col("veg").isin("populus", "tamarix")), "canopy_max")


_Z = ", ".join(f"(SELECT avg({b}) FROM obs) AS m_{b}, (SELECT stddev_samp({b}) FROM obs) AS s_{b}" for b in BANDS)


@query(with_(SQL_OBS) + f", z AS (SELECT {_Z}) SELECT veg, " + ", ".join(sr(f"avg(({b} - m_{b}) / s_{b})", b) for b in BANDS) + " FROM obs, z GROUP BY 1")
def zscore_fit_apply(spark: SparkSession, d: str) -> DataFrame:
    z, _ = rel.standardised(obs(spark, d), BANDS)
    return z.groupBy("veg").agg(*[r6(F.avg(b)).alias(b) for b in BANDS])


@query(with_(SQL_OBS) + ", c AS (SELECT location_id, veg, count(*) AS n FROM obs WHERE veg IS NOT NULL GROUP BY 1, 2), q AS (SELECT *, row_number() OVER (PARTITION BY location_id ORDER BY n DESC, veg) AS r FROM c) SELECT location_id, veg, n FROM q WHERE r = 1")
def dominant_class(spark: SparkSession, d: str) -> DataFrame:
    return rel.dominant_label(obs(spark, d), "location_id")


@query(with_(SQL_OBS) + f"SELECT year(date) AS year, count(*) AS n, count(DISTINCT location_id) AS locations, {sr('count(*) / count(DISTINCT location_id)', 'ratio')} FROM obs GROUP BY 1 HAVING count(*) >= 10")
def images_per_year(spark: SparkSession, d: str) -> DataFrame:
    g = obs(spark, d).groupBy(F.year("date").alias("year")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("location_id").alias("locations"))
    return g.where("n >= 10").withColumn("ratio", r6(F.col("n") / F.col("locations")))


@query(with_(SQL_OBS) + """, c AS (SELECT location_id, py, count(*) AS n, count(DISTINCT doy) AS days, max(doy) - min(doy) AS span FROM obs GROUP BY 1, 2)
SELECT py, """ + ", ".join(sr(f"quantile_cont({c}, {q})", f"{c}_{int(q * 100)}") for c in ("n", "days", "span") for q in (0.25, 0.5, 0.75)) + " FROM c GROUP BY 1")
def coverage(spark: SparkSession, d: str) -> DataFrame:
    c = obs(spark, d).groupBy("location_id", "py").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("doy").alias("days"), (F.max("doy") - F.min("doy")).alias("span"))
    got = group_percentiles(c, ["py"], {x: x for x in ("n", "days", "span")}, [0.25, 0.5, 0.75])
    return got.select("py", *[r6(F.col(f"{x}_{i}")).alias(f"{x}_{q}") for x in ("n", "days", "span") for i, q in enumerate((25, 50, 75))])


@query(with_(SQL_COEFS) + f"SELECT location_id, py, lat, lon, veg, {sr('median(coef)', 'coef')}, count(*) AS n FROM coefs GROUP BY 1, 2, 3, 4, 5")
def collapse_variants(spark: SparkSession, d: str) -> DataFrame:
    return rounded(group_percentiles(coefs(spark, d).withColumnRenamed("coef", "c"), ["location_id", "py", "lat", "lon", "veg"], {"coef": "c"}, [0.5], also={"n": F.count(F.lit(1))}), "coef")


@query(with_(SQL_COEFS) + f"SELECT py, veg, {sr('avg(coef)', 'mean')}, {sr('stddev_samp(coef)', 'sd')}, count(*) AS n, {sr('stddev_samp(coef) / sqrt(count(*))', 'se')} FROM coefs GROUP BY 1, 2")
def trend_se(spark: SparkSession, d: str) -> DataFrame:
    return rounded(coefs(spark, d).groupBy("py", "veg").agg(F.avg("coef").alias("mean"), F.stddev_samp("coef").alias("sd"), F.count(F.lit(1)).alias("n"), (F.stddev_samp("coef") / F.sqrt(F.count(F.lit(1)))).alias("se")), "mean", "sd", "se")


@query(with_(SQL_OBS) + f", l AS (SELECT location_id, veg, avg(nir) AS nir, avg(red) AS red, count(*) AS n FROM obs GROUP BY 1, 2) SELECT veg, {sr('avg(nir)', 'nir')}, {sr('avg(red)', 'red')}, count(*) AS n_sites, sum(n)::BIGINT AS n FROM l GROUP BY 1")
def mean_of_means(spark: SparkSession, d: str) -> DataFrame:
    per = obs(spark, d).groupBy("location_id", "veg").agg(F.avg("nir").alias("nir"), F.avg("red").alias("red"), F.count(F.lit(1)).alias("n"))
    return per.groupBy("veg").agg(r6(F.avg("nir")).alias("nir"), r6(F.avg("red")).alias("red"), F.count(F.lit(1)).alias("n_sites"), F.sum("n").alias("n"))


@query(with_(SQL_OBS, SQL_PLACES) + f""", l AS (SELECT location_id, CASE WHEN month(date) IN (7,8,9) THEN 'summer' ELSE 'winter' END AS season, avg({SQL_INDICES['ndvi']}) AS m FROM obs WHERE month(date) IN (1,2,3,7,8,9) GROUP BY 1, 2)
SELECT p.veg, season, count(m) AS n, {sr('avg(m)', 'ndvi')}, {sr('median(m)', 'median')} FROM l LEFT JOIN places p USING (location_id) GROUP BY 1, 2""")  # fmt: skip
def class_summary(spark: SparkSession, d: str) -> DataFrame:
    season = F.when(F.month("date").isin(7, 8, 9), "summer").otherwise("winter")
    o = obs(spark, d).where(F.month("date").isin(1, 2, 3, 7, 8, 9)).withColumns({"season": season, "ndvi": ix.spectral_indices()["ndvi"]})
    per = o.groupBy("location_id", "season").agg(F.avg("ndvi").alias("m"))
    j = per.join(places(spark, d).select("location_id", "veg"), "location_id", "left")
    return rounded(group_percentiles(j, ["veg", "season"], {"median": "m"}, [0.5], also={"n": F.count("m"), "ndvi": F.avg("m")}), "ndvi", "median")


@query(with_(SQL_OBS) + _SOIL + _PPI + f" SELECT veg, {sr('quantile_cont(ppi, 0.9)', 'p90')}, count(ppi) AS n FROM p GROUP BY 1")
def p90_class(spark: SparkSession, d: str) -> DataFrame:
    rows = soil.with_ppi(obs(spark, d)).select("veg", "ppi")
    return rounded(group_percentiles(rows, ["veg"], {"p90": "ppi"}, [0.9], also={"n": F.count("ppi")}), "p90")


_SCALER = ", sc AS (SELECT location_id, py, least(greatest(coalesce(median(CASE WHEN ppi IS NOT NULL THEN least(greatest(ppi,0),1) END), 0), 0), 1) AS scaler FROM p GROUP BY 1, 2)"


@query(with_(SQL_OBS) + _SOIL + _PPI + _SCALER + f" SELECT location_id, py, {sr('scaler', 'scaler')} FROM sc")
def ppi_scaler(spark: SparkSession, d: str) -> DataFrame:
    return rounded(soil.ppi_scaler(soil.with_ppi(obs(spark, d))), "scaler")


@query(with_(SQL_OBS) + "SELECT " + ", ".join(sr(f"median({SQL_INDICES[i]})", i) for i in INDEX4) + ", " + ", ".join(sr(f"quantile_cont({SQL_INDICES[i]}, 0.02)", f"{i}_low") + ", " + sr(f"quantile_cont({SQL_INDICES[i]}, 0.98)", f"{i}_high") for i in INDEX4) + " FROM obs WHERE month(date) IN (7,8,9)")
def summer_medians(spark: SparkSession, d: str) -> DataFrame:
    o = ix.with_indices(obs(spark, d).where(filters.in_months((7, 8, 9))))
    got = group_percentiles(o, [], {i: i for i in INDEX4}, [0.02, 0.5, 0.98])
    return got.select(*[r6(F.col(f"{i}_{k}")).alias(i + end) for i in INDEX4 for k, end in enumerate(("_low", "", "_high"))])


@query(with_(SQL_OBS) + "SELECT py, " + ", ".join(sr(f"avg({SQL_INDICES[i]})", i) for i in INDEX4) + " FROM obs WHERE month(date) BETWEEN 6 AND 9 GROUP BY 1")
def summer_years(spark: SparkSession, d: str) -> DataFrame:
    return ix.with_indices(obs(spark, d).where(filters.in_months((6, 7, 8, 9)))).groupBy("py").agg(*[r6(F.avg(i)).alias(i) for i in INDEX4])


@query(with_(SQL_COEFS) + f"""SELECT coef_row_id, {sr("CASE WHEN sum(CASE WHEN veg <> 'barren' THEN coef END) OVER w > 1e-6 THEN coef / sum(CASE WHEN veg <> 'barren' THEN coef END) OVER w ELSE coef END", 'share')} FROM coefs WINDOW w AS (PARTITION BY location_id, py)""")
def shares(spark: SparkSession, d: str) -> DataFrame:
    return rel.shares(coefs(spark, d), ["location_id", "py"]).select("coef_row_id", r6(F.col("share")).alias("share"))


@query(with_(SQL_COEFS) + f""", q AS (SELECT *, row_number() OVER (PARTITION BY location_id, py, veg = 'barren' ORDER BY coef DESC, veg) AS r FROM (SELECT location_id, py, veg, max(coef) AS coef FROM coefs GROUP BY 1, 2, 3)),
k AS (SELECT *, CASE WHEN veg = 'barren' OR r <= 2 THEN coef ELSE 0 END AS kept FROM q)
SELECT location_id, py, veg, {sr('CASE WHEN sum(kept) OVER w > 0 THEN kept / sum(kept) OVER w ELSE kept END', 'kept')} FROM k WINDOW w AS (PARTITION BY location_id, py)""")
def sparsify_topk(spark: SparkSession, d: str) -> DataFrame:
    one = coefs(spark, d).groupBy("location_id", "py", "veg").agg(F.max("coef").alias("coef"))
    return rel.keep_largest(one, ["location_id", "py"], 2).select("location_id", "py", "veg", r6(F.col("kept")).alias("kept"))


@query("""WITH p AS (SELECT location_id, CASE WHEN NOT isnan(lat) THEN lat END AS lat, CASE WHEN NOT isnan(lon) THEN lon END AS lon FROM location_dim),
q AS (SELECT *, row_number() OVER (PARTITION BY location_id ORDER BY lat IS NULL OR lon IS NULL, lat NULLS FIRST, lon NULLS FIRST) AS r FROM p) SELECT location_id, lat, lon FROM q WHERE r = 1""")
def coord_dedup(spark: SparkSession, d: str) -> DataFrame:
    from reedbed.functions.numeric import finite

    p = table(spark, d, "location_dim").select("location_id", finite(F.col("lat")).alias("lat"), finite(F.col("lon")).alias("lon"))
    return rel.one_position(p)


@query(with_(SQL_COEFS) + f""", c AS (SELECT py, veg, round(floor(lat/0.01)*0.01+0.005+1e-9, 6) AS cell_lat, round(floor(lon/0.01)*0.01+0.005+1e-9, 6) AS cell_lon, avg(coef) AS coef FROM coefs WHERE lat IS NOT NULL AND lon IS NOT NULL GROUP BY ALL),
y AS (SELECT py, row_number() OVER (ORDER BY py) AS up, row_number() OVER (ORDER BY py DESC) AS down FROM (SELECT DISTINCT py FROM c)),
e AS (SELECT cell_lat, cell_lon, veg, avg(coef) AS early FROM c JOIN y USING (py) WHERE up <= 10 GROUP BY 1, 2, 3), l AS (SELECT cell_lat, cell_lon, veg, avg(coef) AS late FROM c JOIN y USING (py) WHERE down <= 10 GROUP BY 1, 2, 3)
SELECT cell_lat, cell_lon, veg, {sr('early', 'early')}, {sr('late', 'late')}, {sr('late - early', 'change')} FROM e JOIN l USING (cell_lat, cell_lon, veg)""")  # fmt: skip
def early_late_change(spark: SparkSession, d: str) -> DataFrame:
    cells = harmonise.grid_mean(coefs(spark, d), ["py", "veg"], "coef")
    return rounded(rel.early_late(cells, ["cell_lat", "cell_lon", "veg"], "coef", n=10), "early", "late", "change")


@query(with_(SQL_COEFS) + """, c AS (SELECT py, veg, round(floor(lat/0.01)*0.01+0.005+1e-9, 6) AS cell_lat, round(floor(lon/0.01)*0.01+0.005+1e-9, 6) AS cell_lon, round(avg(coef) + 1e-9, 6) AS coef FROM coefs WHERE lat IS NOT NULL AND lon IS NOT NULL GROUP BY ALL),
q AS (SELECT *, row_number() OVER (PARTITION BY cell_lat, cell_lon, py ORDER BY coef DESC, veg) AS r FROM c) SELECT cell_lat, cell_lon, py, veg, coef FROM q WHERE r = 1""")
def dominant_cell(spark: SparkSession, d: str) -> DataFrame:
    cells = harmonise.grid_mean(coefs(spark, d), ["py", "veg"], "coef").withColumn("coef", r6(F.col("coef")))
    best = F.min_by(F.struct("veg", "coef"), F.struct(-F.col("coef"), F.col("veg")))
    return cells.groupBy("cell_lat", "cell_lon", "py").agg(best.alias("b")).select("cell_lat", "cell_lon", "py", "b.veg", "b.coef")


_NUMBER = "CAST(coalesce(nullif(regexp_extract(location_id, '([0-9]+)$', 1), ''), '0') AS BIGINT)"


def _number():
    return F.coalesce(F.regexp_extract("location_id", "([0-9]+)$", 1).try_cast("bigint"), F.lit(0))


@query(with_(SQL_PLACES) + f""", k AS (SELECT location_id, veg FROM places WHERE veg IS NOT NULL), n AS (SELECT min(c) AS m FROM (SELECT count(*) AS c FROM k WHERE veg <> 'barren' GROUP BY veg)),
q AS (SELECT *, row_number() OVER (PARTITION BY veg ORDER BY ({_NUMBER} * 7919 + 42) % 10007, location_id) AS r FROM k) SELECT location_id, veg FROM q, n WHERE veg = 'barren' OR r <= m""")
def balance_sample(spark: SparkSession, d: str) -> DataFrame:
    return rel.balanced_sample(places(spark, d).where("veg is not null"), "location_id", "veg", _number())


@query(with_(SQL_PLACES) + f""", k AS (SELECT location_id, veg, count(*) OVER (PARTITION BY veg) AS n, row_number() OVER (PARTITION BY veg ORDER BY ({_NUMBER} * 7919 + 42) % 10007, location_id) AS r FROM places WHERE veg IS NOT NULL)
SELECT location_id, veg, r <= CASE WHEN n > 1 THEN least(ceil(n * 0.3), n - 1) ELSE 0 END AS held FROM k""")
def holdout_split(spark: SparkSession, d: str) -> DataFrame:
    return rel.holdout(places(spark, d).where("veg is not null"), "location_id", "veg", _number())


_CLS = ["barren", "herbs", "populus", "tamarix"]


@query(with_(SQL_COEFS) + f""", w AS (SELECT py, {', '.join(f"coalesce(sum(CASE WHEN veg = '{c}' THEN coef END), 0) AS {c}" for c in _CLS)} FROM coefs GROUP BY 1), t AS (SELECT *, {' + '.join(_CLS)} AS total FROM w)
""" + " UNION ALL ".join(f"SELECT py, '{c}' AS veg, {sr(f'{c} / total', 'share')} FROM t" for c in _CLS))
def pivot_shares(spark: SparkSession, d: str) -> DataFrame:
    return rounded(rel.class_shares(coefs(spark, d), ["py"], _CLS), "share")


@query(with_(SQL_COEFS) + f", l AS (SELECT veg, count(*) AS n FROM coefs GROUP BY 1) SELECT veg, n, CAST(sum(n) OVER (ORDER BY veg) AS BIGINT) AS \"end\", CAST(sum(n) OVER (ORDER BY veg) - n AS BIGINT) AS start FROM l")
def running_widths(spark: SparkSession, d: str) -> DataFrame:
    return rel.running_width(coefs(spark, d).groupBy("veg").agg(F.count(F.lit(1)).alias("n")), [], "veg", "n")


@query(with_(SQL_COEFS) + f"SELECT py, veg, {sr('sum(coef * n_obs)', 'weighted')}, sum(n_obs)::BIGINT AS weight FROM coefs GROUP BY 1, 2")
def weighted_sums(spark: SparkSession, d: str) -> DataFrame:
    return coefs(spark, d).groupBy("py", "veg").agg(r6(F.sum(F.col("coef") * F.col("n_obs"))).alias("weighted"), F.sum("n_obs").alias("weight"))


@query(with_(SQL_COEFS, SQL_PLACES) + """, t AS (SELECT * FROM coefs WHERE py IN (2023, 2024) AND veg <> 'herbs'), k AS (SELECT veg, count(*) AS n FROM t GROUP BY 1)
SELECT * FROM k UNION ALL SELECT 'herbs', least(greatest(5, (SELECT count(*) // 10 FROM t)), (SELECT count(*) FROM coefs WHERE veg = 'herbs'))""")
def augment_classes(spark: SparkSession, d: str) -> DataFrame:
    whole = coefs(spark, d)
    training = filters.training_seasons(whole).where("veg <> 'herbs'")
    return rel.complete_classes(training, whole, _CLS, F.col("coef_row_id")).groupBy("veg").agg(F.count(F.lit(1)).alias("n"))
