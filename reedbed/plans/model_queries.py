"""Queries of statistics, traces, unmixing, resampling and accuracy."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reedbed.functions import indices as ix
from reedbed.functions.numeric import r6
from reedbed.operators import filters, harmonise, relational as rel, resample, soil, stats, traces, unmix
from reedbed.operators.ranks import group_percentiles
from reedbed.plans.expression_queries import _PPI, _SOIL, sr
from reedbed.plans.relational_queries import _BINS, _FILL, _SCALER, _SERIES, BANDS, class_years, rounded, water_years
from reedbed.plans.views import SQL_COEFS, SQL_INDICES, SQL_LIBRARY, SQL_OBS, SQL_PLACES, SQL_WATER, coefs, library, obs, places, with_
from reedbed.session import materialise

QUERIES, SQL = {}, {}
CLASSES = ["barren", "herbs", "populus", "tamarix"]


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@query(with_(SQL_OBS) + f"SELECT count(*) AS n, {sr('regr_slope(nir, red)', 'slope')}, {sr('regr_intercept(nir, red)', 'intercept')} FROM obs WHERE veg = 'barren' AND nir IS NOT NULL AND red IS NOT NULL")
def soil_line(spark: SparkSession, d: str) -> DataFrame:
    o = obs(spark, d).where("veg = 'barren'")
    return stats.linear_fit(o, [], "red", "nir", 6).select("n", r6(F.col("slope")).alias("slope"), r6(F.col("intercept")).alias("intercept"))


_CORRS = [(a, b) for i, a in enumerate(BANDS) for b in BANDS[i + 1 :]]


@query(with_(SQL_OBS) + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, {sr(f'corr({a}, {b})', 'r')} FROM obs" for a, b in _CORRS))
def corr_matrix(spark: SparkSession, d: str) -> DataFrame:
    return rounded(stats.correlation_matrix(obs(spark, d), BANDS), "r")


@query()
def independent_features(spark: SparkSession, d: str) -> DataFrame:
    kept = stats.independent_features(ix.with_indices(obs(spark, d)), ["psri", "ndmi", "ndti", "msi", *BANDS])
    return spark.createDataFrame([(i, n) for i, n in enumerate(kept)], "pos int, feature string")


_LAGS = _SERIES + f", s AS (SELECT veg, sheet, CAST(lag AS INTEGER) AS lag, count(*) AS n, regr_slope(coef, gw_mean) * 1e6 AS slope, corr(gw_mean, coef) AS r FROM l GROUP BY 1, 2, 3 HAVING count(*) >= 3)"


def _lags(spark: SparkSession, d: str) -> DataFrame:
    t = stats.lag_table(class_years(spark, d), water_years(spark, d), ["veg", "sheet"], "coef", "gw_mean")
    return t.where("n >= 3").withColumn("slope", F.col("slope") * 1e6)


@query(with_(SQL_COEFS, SQL_WATER) + _LAGS + f"SELECT veg, sheet, lag, n, {sr('slope', 'slope')}, {sr('r', 'r')}, {sr('r * r', 'r2')} FROM s")
def lag_stats(spark: SparkSession, d: str) -> DataFrame:
    return rounded(_lags(spark, d).select("veg", "sheet", "lag", "n", "slope", "r", "r2"), "slope", "r", "r2")


@query(with_(SQL_COEFS, SQL_WATER) + _LAGS + f", q AS (SELECT *, row_number() OVER (PARTITION BY veg, sheet ORDER BY abs(r) DESC, lag) AS k FROM s) SELECT veg, sheet, lag, n, {sr('r', 'r')} FROM q WHERE k = 1")
def best_lag(spark: SparkSession, d: str) -> DataFrame:
    return rounded(stats.best_lag(_lags(spark, d), ["veg", "sheet"]).select("veg", "sheet", "lag", "n", "r"), "r")


# Student's t of a whole number of degrees of freedom k is a finite sum in the angle a = atan(t / sqrt(k)).
_TERM = "coalesce(list_aggregate(list_transform(generate_series(1, j), lambda i: {f}), 'product'), 1) * pow(cos(a), {p})"
_SUM = lambda top, f, p: f"coalesce(list_sum(list_transform(generate_series(0, {top}), lambda j: {_TERM.format(f=f, p=p)})), 0)"
_SHARE = f"CASE WHEN k % 2 = 1 THEN 2 / pi() * (a + sin(a) * CASE WHEN k > 1 THEN {_SUM('(k - 3) // 2', '2.0 * i / (2 * i + 1)', '2 * j + 1')} ELSE 0 END) ELSE sin(a) * {_SUM('(k - 2) // 2', '(2.0 * i - 1) / (2 * i)', '2 * j')} END"


@query(with_(SQL_COEFS, SQL_WATER) + _LAGS + f", t AS (SELECT *, n - 2 AS k, CASE WHEN r IS NOT NULL AND abs(r) < 1 THEN atan(abs(r) / sqrt(1 - r * r)) END AS a FROM s) SELECT veg, sheet, lag, n, {sr('r', 'r')}, {sr('CASE WHEN n >= 3 THEN 1 - ' + _SHARE + ' END', 'p')} FROM t")
def lag_p_values(spark: SparkSession, d: str) -> DataFrame:
    return rounded(_lags(spark, d).select("veg", "sheet", "lag", "n", "r", "p"), "r", "p")


_NDVI = SQL_INDICES["ndvi"]


@query(with_(SQL_OBS) + f""", s AS (SELECT obs_id, location_id, doy_cal AS x, {_NDVI} AS y FROM obs WHERE month(date) IN (7,8,9)), o AS (SELECT * FROM s WHERE y IS NOT NULL),
m AS (SELECT *, x - avg(x) OVER () AS p1, count(*) OVER () AS n FROM o), a AS (SELECT *, (x - sum(x*p1*p1) OVER () / sum(p1*p1) OVER ()) * p1 - sum(p1*p1) OVER () / n AS p2 FROM m),
b AS (SELECT *, (x - sum(x*p2*p2) OVER () / sum(p2*p2) OVER ()) * p2 - sum(p2*p2) OVER () / sum(p1*p1) OVER () * p1 AS p3 FROM a),
t AS (SELECT *, y - p1 * sum(y*p1) OVER () / sum(p1*p1) OVER () - p2 * sum(y*p2) OVER () / sum(p2*p2) OVER () - p3 * sum(y*p3) OVER () / sum(p3*p3) OVER () AS v FROM b)
SELECT location_id, count(*) AS n, {sr('avg(v)', 'ndvi')} FROM t GROUP BY 1""")  # fmt: skip
def detrend_poly3(spark: SparkSession, d: str) -> DataFrame:
    o = obs(spark, d).where(filters.in_months((7, 8, 9))).select("obs_id", "location_id", "doy_cal", ix.spectral_indices()["ndvi"].alias("ndvi"))
    t = stats.detrend_cubic(o, [], "doy_cal", "ndvi")
    return t.groupBy("location_id").agg(F.count(F.lit(1)).alias("n"), r6(F.avg("detrended")).alias("ndvi"))


_IDX = ("ndvi", "ndmi", "psri", "msi")


@query(with_(SQL_OBS) + ", m AS (SELECT location_id, veg, " + ", ".join(f"median({SQL_INDICES[i]}) AS {i}" for i in _IDX) + " FROM obs WHERE veg IN ('barren','populus') AND month(date) IN (7,8,9) GROUP BY 1, 2) "
       + " UNION ALL ".join(f"SELECT '{i}' AS index_name, {sr(f'''(avg(CASE WHEN veg='populus' THEN {i} END) - avg(CASE WHEN veg<>'populus' THEN {i} END)) / sqrt((var_samp(CASE WHEN veg='populus' THEN {i} END) + var_samp(CASE WHEN veg<>'populus' THEN {i} END)) / 2)''', 'separability')} FROM m" for i in _IDX))
def separability(spark: SparkSession, d: str) -> DataFrame:
    o = ix.with_indices(obs(spark, d).where(filters.in_months((7, 8, 9))).where("veg in ('barren', 'populus')"))
    medians = group_percentiles(o, ["location_id", "veg"], {i: i for i in _IDX}, [0.5])
    return rounded(stats.separability(medians, F.col("veg") == "populus", list(_IDX)), "separability")


@query(with_(SQL_OBS) + ", s AS (" + " UNION ALL ".join(f"SELECT '{i}' AS index_name, pow(quantile_cont({SQL_INDICES[i]}, .99) - quantile_cont({SQL_INDICES[i]}, .01), 2) AS signal FROM obs" for i in _IDX)
       + "), n AS (" + " UNION ALL ".join(f"SELECT '{i}' AS index_name, median(v) AS noise FROM (SELECT var_samp({SQL_INDICES[i]}) AS v FROM obs GROUP BY location_id)" for i in _IDX) + f") SELECT index_name, {sr('signal / (noise + 1e-9)', 'snr')} FROM s JOIN n USING (index_name)")
def snr(spark: SparkSession, d: str) -> DataFrame:
    return rounded(stats.signal_to_noise(ix.with_indices(obs(spark, d)), "location_id", list(_IDX)).select("index_name", "snr"), "snr")


_SITES = """, sites AS (SELECT location_id, min(lat) AS lat, min(lon) AS lon, avg(nir) AS v FROM obs WHERE lat IS NOT NULL AND lon IS NOT NULL GROUP BY 1 HAVING avg(nir) IS NOT NULL),
pairs AS (SELECT a.location_id AS a, b.location_id AS b, a.v AS va, b.v AS vb, 2*6371*asin(sqrt(least(1, pow(sin(radians(b.lat-a.lat)/2),2)+cos(radians(a.lat))*cos(radians(b.lat))*pow(sin(radians(b.lon-a.lon)/2),2)))) AS km
  FROM sites a JOIN sites b ON a.location_id < b.location_id)"""


def _sites(spark: SparkSession, d: str) -> DataFrame:
    o = obs(spark, d).where("lat is not null and lon is not null")
    return o.groupBy("location_id").agg(F.min("lat").alias("lat"), F.min("lon").alias("lon"), F.avg("nir").alias("v")).where("v is not null")


@query(with_(SQL_OBS) + _SITES + f"SELECT a, b, {sr('km', 'km')} FROM pairs")
def pairs_distance(spark: SparkSession, d: str) -> DataFrame:
    return stats.location_pairs(materialise(_sites(spark, d), "sites"), "v").select("a", "b", r6(F.col("km")).alias("km"))


@query(with_(SQL_OBS) + _SITES + f""", k AS (SELECT least(10, greatest(3, count(*) // 5)) AS bins FROM pairs), c AS (SELECT i, bins, (SELECT quantile_cont(km, i::DOUBLE / bins) FROM pairs) AS lo FROM k, (SELECT unnest(generate_series(0, 10)) AS i) WHERE i <= bins),
e AS (SELECT i + 1 AS bin, lo, lead(lo) OVER (ORDER BY i) AS hi FROM c)
SELECT CAST(bin AS INTEGER) AS bin, {sr('(lo + hi) / 2', 'km')}, {sr('median(pow(va - vb, 2) / 2) * 1e4', 'gamma')}, count(*) AS n FROM e JOIN pairs ON km >= lo AND km < hi GROUP BY bin, lo, hi""".replace("(SELECT quantile_cont(km, i::DOUBLE / bins) FROM pairs)", "list_extract((SELECT quantile_cont(km, [0.0,0.1,0.2,0.3,0.4,0.5,0.6,0.7,0.8,0.9,1.0]) FROM pairs), i + 1)"))
def semivariogram(spark: SparkSession, d: str) -> DataFrame:
    g = spark.createDataFrame(stats.semivariogram(stats.PairBlocks(_sites(spark, d), "v")), "bin int, km double, gamma double, n bigint")
    return g.select("bin", r6(F.col("km")).alias("km"), r6(F.col("gamma") * 1e4).alias("gamma"), "n")


@query()
def variogram_range(spark: SparkSession, d: str) -> DataFrame:
    pairs = stats.PairBlocks(_sites(spark, d), "v")
    bins = [(km, gamma) for _, km, gamma, _ in stats.semivariogram(pairs)]
    s = pairs.places.agg(F.var_samp("v").alias("v"), F.count("v").alias("n")).first()
    rng = stats.variogram_range(bins, s["v"] or 0.0, 500.0)
    return spark.createDataFrame([(rng, stats.effective_n(pairs, rng, s["n"]))], "range_km double, n_eff double")


@query(with_(SQL_OBS) + _SITES + f""", w AS (SELECT a AS k, va AS v, vb AS o, 1/greatest(km, 1e-3) AS w FROM pairs UNION ALL SELECT b, vb, va, 1/greatest(km, 1e-3) FROM pairs),
g AS (SELECT k, any_value(v) AS v, sum(w*o)/sum(w) AS lag FROM w GROUP BY 1), m AS (SELECT avg(v) AS m FROM g)
SELECT {sr('sum((v-m)*(lag-m))/sum((v-m)*(v-m))', 'i')}, {sr('-1.0/(count(*)-1)', 'expected')}, count(*) AS n FROM g, m""")  # fmt: skip
def moran_i(spark: SparkSession, d: str) -> DataFrame:
    return rounded(stats.moran_of_lags(stats.PairBlocks(_sites(spark, d), "v").lags()), "i", "expected")


@query(with_(SQL_OBS) + _SITES + f", m AS (SELECT avg(exp(-km / 20)) AS m FROM pairs), n AS (SELECT count(*) AS n FROM sites) SELECT n, {sr('n / (1 + (n - 1) * m)', 'n_eff')} FROM n, m")
def effective_sites(spark: SparkSession, d: str) -> DataFrame:
    """Number of independent locations under a correlation range of 20 km."""
    pairs = stats.PairBlocks(_sites(spark, d), "v")
    n = pairs.places.where("v is not null").count()
    return rounded(spark.createDataFrame([(n, stats.effective_n(pairs, 20.0, n))], "n bigint, n_eff double"), "n_eff")


@query()
def moran_blocks(spark: SparkSession, d: str) -> DataFrame:
    pairs = stats.PairBlocks(_sites(spark, d), "v")
    s = pairs.places.agg(F.var_pop("v").alias("v"), F.count("v").alias("n")).first()
    i, p = stats.moran_test(pairs)
    return spark.createDataFrame([(i, p, stats.block_km(p, s["n"], s["v"] or 0.0))], "i double, p double, block_km double")


@query(with_(SQL_PLACES) + """, m AS (SELECT avg(lat) AS m FROM places) SELECT CASE WHEN lat IS NOT NULL THEN CAST(CAST(floor(lat / (5/111.32)) AS BIGINT) AS VARCHAR) || '_' || CAST(CAST(floor(lon / (5/(111.32*cos(radians(m))))) AS BIGINT) AS VARCHAR) END AS block, count(*) AS n FROM places, m GROUP BY 1""")
def block_cells(spark: SparkSession, d: str) -> DataFrame:
    return harmonise.block_cells(places(spark, d), 5.0).groupBy("block").agg(F.count(F.lit(1)).alias("n"))


_TRUTH = """, dom AS (SELECT location_id, py, veg AS mapped, row_number() OVER (PARTITION BY location_id, py ORDER BY coef DESC, veg) AS r FROM coefs), cm AS (SELECT d.mapped, p.veg AS actual, count(*) AS n FROM dom d JOIN places p USING (location_id) WHERE r = 1 AND p.veg IS NOT NULL GROUP BY 1, 2)"""


@query(with_(SQL_COEFS, SQL_PLACES) + _TRUTH + f""", t AS (SELECT mapped, sum(n) AS t FROM cm GROUP BY 1), q AS (SELECT mapped, actual, n / t AS q, t FROM cm JOIN t USING (mapped)), s AS (SELECT py, veg, avg(coef) AS share FROM coefs GROUP BY 1, 2),
j AS (SELECT py, coalesce(actual, veg) AS veg, coalesce(share * q, share) AS w, coalesce(share * share * q * (1 - q) / nullif(t - 1, 0), 0) AS e FROM s LEFT JOIN q ON s.veg = q.mapped), a AS (SELECT py, veg, sum(w) AS adjusted, sqrt(sum(e)) AS se FROM j GROUP BY 1, 2)
SELECT py, veg, {sr('adjusted', 'adjusted')}, {sr('se', 'se')}, {sr('greatest(adjusted - 1.96*se, 0)', 'low')}, {sr('least(adjusted + 1.96*se, 1)', 'high')} FROM a""")  # fmt: skip
def area_correction(spark: SparkSession, d: str) -> DataFrame:
    c = coefs(spark, d)
    best = c.groupBy("location_id", "py").agg(F.min_by("veg", F.struct(-F.col("coef"), F.col("veg"))).alias("mapped"))
    counts = best.join(places(spark, d).where("veg is not null"), "location_id").groupBy("mapped", F.col("veg").alias("actual")).agg(F.count(F.lit(1)).alias("n"))
    shares = c.groupBy("py", "veg").agg(F.avg("coef").alias("share"))
    return rounded(stats.area_correction(shares, counts, ["py"]), "adjusted", "se", "low", "high")


def _bins(spark: SparkSession, d: str) -> DataFrame:
    return rel.bin_means(ix.with_indices(obs(spark, d)), ["ndmi", "psri"])


@query()
def whittaker(spark: SparkSession, d: str) -> DataFrame:
    return stats.smooth_traces(_bins(spark, d))


@query(with_(SQL_OBS) + _BINS + _FILL + f", v AS (SELECT location_id, py, list(value ORDER BY index_name, bin) AS x FROM filled GROUP BY 1, 2) SELECT location_id, py, len(x) AS n, {sr('list_sum(list_transform(x, lambda u: u * u))', 'square')}, {sr('x[1]', 'first')}, {sr('x[-1]', 'last')} FROM v")
def trace_vectors(spark: SparkSession, d: str) -> DataFrame:
    v = traces.trace_vectors(rel.fill_bins(_bins(spark, d)))
    x = F.col("x")
    return v.select("location_id", "py", F.size(x).cast("bigint").alias("n"), r6(F.aggregate(x, F.lit(0.0), lambda a, u: a + u * u)).alias("square"), r6(F.element_at(x, 1)).alias("first"), r6(F.element_at(x, -1)).alias("last"))


@query(with_(SQL_OBS) + _BINS + _FILL + f", s AS (SELECT index_name, avg(value) AS m, stddev_samp(value) AS sd FROM filled GROUP BY 1) SELECT location_id, py, index_name, {sr('sum((value - m) / sd)', 'total')}, {sr('sum(pow((value - m) / sd, 2))', 'square')} FROM filled JOIN s USING (index_name) GROUP BY 1, 2, 3")
def zscore_index(spark: SparkSession, d: str) -> DataFrame:
    f = rel.fill_bins(_bins(spark, d))
    z = traces.scaled(f, traces.index_scales(f))
    return z.groupBy("location_id", "py", "index_name").agg(r6(F.sum("value")).alias("total"), r6(F.sum(F.col("value") * F.col("value"))).alias("square"))


_NORM = "sqrt(list_sum(list_transform(x, lambda u: u * u)))"


@query(with_(SQL_LIBRARY) + f"SELECT vec_id, {sr(_NORM, 'length')}, {sr(f'x[1] / {_NORM}', 'first')} FROM library")
def l2_vectors(spark: SparkSession, d: str) -> DataFrame:
    v = library(spark, d)
    return v.select("vec_id", r6(traces.norm(F.col("x"))).alias("length"), r6(F.element_at(traces.unit(F.col("x")), 1)).alias("first"))


_LONG = ", long AS (SELECT vec_id, cls, x[i] AS v, i - 1 AS pos FROM library, (SELECT unnest(generate_series(1, 64)) AS i))"


@query(with_(SQL_LIBRARY) + _LONG + f", m AS (SELECT cls, pos, median(v) AS m FROM long GROUP BY 1, 2), q AS (SELECT cls, vec_id, sum(pow(v - m, 2)) AS d FROM long JOIN m USING (cls, pos) GROUP BY 1, 2) SELECT cls, vec_id, {sr('d', 'distance')} FROM q QUALIFY row_number() OVER (PARTITION BY cls ORDER BY d, vec_id) = 1")
def class_medoid(spark: SparkSession, d: str) -> DataFrame:
    return rounded(traces.medoids(library(spark, d), ["cls"], "vec_id"), "distance")


@query(with_(SQL_LIBRARY) + _LONG + f"SELECT cls, CAST(pos AS INTEGER) AS pos, {sr('avg(v)', 'mean')}, {sr('greatest(coalesce(var_samp(v), 0), 1e-12)', 'var')} FROM long GROUP BY 1, 2")
def bundle_stats(spark: SparkSession, d: str) -> DataFrame:
    return rounded(unmix.bundle_stats(library(spark, d)), "mean", "var")


@query(with_(SQL_OBS) + """, b AS (SELECT veg, bin, obs_id AS row_id, nir, red FROM obs WHERE veg IN ('barren','herbs','populus','tamarix') AND bin < 37 AND nir IS NOT NULL AND red IS NOT NULL), m AS (SELECT veg, bin, median(nir) AS mn, median(red) AS mr FROM b GROUP BY 1, 2),
q AS (SELECT veg, bin, row_id, round(pow(nir - mn, 2) + pow(red - mr, 2) + 1e-12, 9) AS distance FROM b JOIN m USING (veg, bin)) SELECT * FROM q QUALIFY row_number() OVER (PARTITION BY veg, bin ORDER BY distance, row_id) = 1""")
def bin_medoid(spark: SparkSession, d: str) -> DataFrame:
    b = filters.known_class(obs(spark, d)).where("bin < 37 and nir is not null and red is not null").select("veg", "bin", F.col("obs_id").alias("row_id"), "nir", "red")
    return traces.class_templates(b, ["nir", "red"])


_CURVE = np.linalg.inv(np.eye(36) + 1600.0 * np.diff(np.eye(36), n=2, axis=0).T @ np.diff(np.eye(36), n=2, axis=0) + 1e-12 * np.eye(36))
_ROW = lambda v: "[" + ", ".join(f"{u:.15g}" for u in v) + "]"


@query(with_(SQL_OBS) + _BINS + _FILL + f", v AS (SELECT location_id, py, index_name, list(value ORDER BY bin) AS y FROM filled GROUP BY 1, 2, 3) SELECT location_id, py, index_name, {sr(f'list_dot_product(y, {_ROW(_CURVE[0])})', 'first')}, {sr(f'list_dot_product(y, {_ROW(_CURVE[17])})', 'middle')}, {sr(f'list_dot_product(y, {_ROW(_CURVE.sum(axis=0))})', 'total')} FROM v")
def whittaker_filled(spark: SparkSession, d: str) -> DataFrame:
    """Smoothed traces without gaps, for which the curve is a fixed matrix times the trace."""
    s = stats.smooth_traces(rel.fill_bins(_bins(spark, d)).select("location_id", "py", "index_name", "bin", "value"))
    v = F.col("values")
    return s.select("location_id", "py", "index_name", r6(F.element_at(v, 1)).alias("first"), r6(F.element_at(v, 18)).alias("middle"), r6(F.aggregate(v, F.lit(0.0), lambda a, u: a + u)).alias("total"))


def _class_vectors(spark: SparkSession, d: str) -> list[tuple[str, str, np.ndarray]]:
    rows = group_percentiles(filters.known_class(obs(spark, d)), ["veg"], {b: b for b in BANDS}, [0.5]).orderBy("veg").collect()  # four rows
    return [(r["veg"], f"{r['veg']}_opt_1", np.array([r[b] for b in BANDS])) for r in rows]


def _season_vectors(spark: SparkSession, d: str) -> DataFrame:
    y = obs(spark, d).groupBy("location_id", "py").agg(*[F.avg(b).alias(b) for b in BANDS])
    return y.where(" and ".join(f"{b} is not null" for b in BANDS)).select("location_id", "py", F.array(*BANDS).alias("x"))


_KEYS = "location_id string, py int"
_Y = ", y AS (SELECT location_id, py, " + ", ".join(f"avg({b}) AS {b}" for b in BANDS) + " FROM obs GROUP BY 1, 2 HAVING " + " AND ".join(f"avg({b}) IS NOT NULL" for b in BANDS) + "), e AS (SELECT veg, " + ", ".join(f"median({b}) AS e_{b}" for b in BANDS) + " FROM obs WHERE veg IN ('barren','herbs','populus','tamarix') GROUP BY 1)"
_DOT = lambda p, q: "(" + " + ".join(f"{p}{b} * {q}{b}" for b in BANDS) + ")"
_TWO = _Y + f""", g AS (SELECT y.*, v.veg, 10000 * ({_DOT('b.e_', 'b.e_')} + {_DOT('v.e_', 'v.e_')}) / 12 AS dd, {_DOT('b.e_', 'b.e_')} AS bb, {_DOT('b.e_', 'v.e_')} AS bv, {_DOT('v.e_', 'v.e_')} AS vv, {_DOT('b.e_', 'y.')} AS yb, {_DOT('v.e_', 'y.')} AS yv,
  {', '.join(f'b.e_{b} AS b_{b}, v.e_{b} AS v_{b}' for b in BANDS)} FROM y, e b, e v WHERE b.veg = 'barren' AND v.veg <> 'barren'),
h AS (SELECT *, ((yb+dd)*(vv+dd) - (yv+dd)*(bv+dd)) AS xb, ((yv+dd)*(bb+dd) - (yb+dd)*(bv+dd)) AS xv FROM g), f AS (SELECT *, CASE WHEN xb < 0 THEN 0 WHEN xv < 0 THEN 1 ELSE xb / (xb + xv) END AS wb FROM h),
r AS (SELECT *, 1 - wb AS wv, sqrt(({' + '.join(f'pow({b} - wb * b_{b} - (1 - wb) * v_{b}, 2)' for b in BANDS)}) / 6) AS rmse FROM f)"""


@query(with_(SQL_OBS) + _TWO + f" SELECT location_id, py, 'barren' AS cls, {sr('wb', 'coef')}, {sr('rmse', 'rmse')} FROM r WHERE veg = 'populus' UNION ALL SELECT location_id, py, 'populus', {sr('wv', 'coef')}, {sr('rmse', 'rmse')} FROM r WHERE veg = 'populus'")
def fcls2(spark: SparkSession, d: str) -> DataFrame:
    two = [v for v in _class_vectors(spark, d) if v[0] in ("barren", "populus")]
    return rounded(unmix.unmix(_season_vectors(spark, d), two, _KEYS).select("location_id", "py", "cls", "coef", "rmse"), "coef", "rmse")


@query(with_(SQL_OBS) + _TWO + f", s AS (SELECT *, row_number() OVER (PARTITION BY location_id, py ORDER BY rmse, veg) AS k FROM r) SELECT location_id, py, veg, {sr('wv', 'coef')}, {sr('rmse', 'rmse')} FROM s WHERE k = 1")
def model_search(spark: SparkSession, d: str) -> DataFrame:
    """Bare ground with the one vegetated class that fits best."""
    got = unmix.unmix(_season_vectors(spark, d), _class_vectors(spark, d), _KEYS, active=1).where("cls <> 'barren' and variant_id is not null")
    return rounded(got.select("location_id", "py", F.col("cls").alias("veg"), "coef", "rmse"), "coef", "rmse")


_HALF = "CASE WHEN date_part('month', date) BETWEEN 6 AND 9 THEN 'summer' ELSE 'other' END"
_VARIANTS = _Y + f", lib AS (SELECT veg, {_HALF} AS half, " + ", ".join(f"median({b}) AS e_{b}" for b in BANDS) + f""" FROM obs WHERE veg IN ('barren','populus','tamarix') GROUP BY 1, 2),
g AS (SELECT y.*, v.veg, b.half AS bh, v.half AS vh, 10000 * ({_DOT('b.e_', 'b.e_')} + {_DOT('v.e_', 'v.e_')}) / 12 AS dd, {_DOT('b.e_', 'b.e_')} AS bb, {_DOT('b.e_', 'v.e_')} AS bv, {_DOT('v.e_', 'v.e_')} AS vv, {_DOT('b.e_', 'y.')} AS yb, {_DOT('v.e_', 'y.')} AS yv,
  {', '.join(f'b.e_{b} AS b_{b}, v.e_{b} AS v_{b}' for b in BANDS)} FROM y, lib b, lib v WHERE b.veg = 'barren' AND v.veg <> 'barren'),
h AS (SELECT *, ((yb+dd)*(vv+dd) - (yv+dd)*(bv+dd)) AS xb, ((yv+dd)*(bb+dd) - (yb+dd)*(bv+dd)) AS xv FROM g), f AS (SELECT *, CASE WHEN xb < 0 THEN 0 WHEN xv < 0 THEN 1 ELSE xb / (xb + xv) END AS wb FROM h),
r AS (SELECT *, 1 - wb AS wv, sqrt(({' + '.join(f'pow({b} - wb * b_{b} - (1 - wb) * v_{b}, 2)' for b in BANDS)}) / 6) AS rmse FROM f), s AS (SELECT location_id, py, min(rmse) AS rmse FROM r GROUP BY 1, 2)"""


@query(with_(SQL_OBS) + _VARIANTS + f" SELECT location_id, py, {sr('rmse', 'rmse')} FROM s")
def variant_search(spark: SparkSession, d: str) -> DataFrame:
    """Smallest rmse over all pairs of a variant of bare ground and one of a vegetated class; a class has a summer variant and another."""
    half = F.when(filters.in_months((6, 7, 8, 9)), "summer").otherwise("other")
    known = obs(spark, d).where("veg in ('barren', 'populus', 'tamarix')").withColumn("half", half)
    rows = group_percentiles(known, ["veg", "half"], {b: b for b in BANDS}, [0.5]).orderBy("veg", "half").collect()  # six rows
    lib = [(r["veg"], f"{r['veg']}_{r['half']}", np.array([r[b] for b in BANDS])) for r in rows]
    return rounded(unmix.unmix(_season_vectors(spark, d), lib, _KEYS, active=1).where("cls = 'barren'").select("location_id", "py", "rmse"), "rmse")


@query()
def fcls_batch(spark: SparkSession, d: str) -> DataFrame:
    return unmix.unmix(_season_vectors(spark, d), _class_vectors(spark, d), _KEYS, solver="sparse")


@query()
def iwlmm(spark: SparkSession, d: str) -> DataFrame:
    return unmix.unmix(_season_vectors(spark, d), _class_vectors(spark, d), _KEYS, solver="iwlmm_sparse")


@query()
def iwlmm_features(spark: SparkSession, d: str) -> DataFrame:
    return unmix.unmix(_season_vectors(spark, d), _class_vectors(spark, d), _KEYS, solver="iwlmm_features_sparse")


@query()
def mc_uncertainty(spark: SparkSession, d: str) -> DataFrame:
    return unmix.unmix(_season_vectors(spark, d), _class_vectors(spark, d), _KEYS, solver="fcls", draws=50)


@query()
def greedy_library(spark: SparkSession, d: str) -> DataFrame:
    v = library(spark, d).withColumn("cls", F.col("cls").cast("string"))
    return unmix.endmember_library(v, {str(c): 2 for c in range(10)}, "vec_id")


@query()
def library_search(spark: SparkSession, d: str) -> DataFrame:
    v = library(spark, d).where("cls is not null").select(F.col("cls").cast("string").alias("cls"), F.col("vec_id").alias("key"), "x", (F.pmod(F.xxhash64("vec_id"), F.lit(2)) == 1).alias("held"))
    return spark.createDataFrame(sorted(unmix.library_size(v, 2, "0").items()), "cls string, k int")


@query(with_(SQL_LIBRARY) + _LONG + f"SELECT CAST(a.pos AS INTEGER) AS i, CAST(b.pos AS INTEGER) AS j, {sr('sum(a.v * b.v)', 's')} FROM long a JOIN long b USING (vec_id) GROUP BY 1, 2")
def gram(spark: SparkSession, d: str) -> DataFrame:
    """The matrix whose axes the feature model rotates to."""
    v = library(spark, d)
    m, _ = traces.gram_matrix(v, "x", 64)
    return rounded(spark.createDataFrame([(i, j, float(m[i, j])) for i in range(64) for j in range(64)], "i int, j int, s double"), "s")


@query(with_(SQL_LIBRARY) + _LONG + f", w AS (SELECT 'part' || (pos // 16) AS index_name, abs(avg(v)) AS weight FROM long GROUP BY pos, 1), g AS (SELECT index_name, avg(weight) AS mean, max(weight) AS max FROM w GROUP BY 1) SELECT index_name, {sr('mean', 'mean')}, {sr('max', 'max')}, CAST(row_number() OVER (ORDER BY mean DESC, index_name) AS INTEGER) AS rank FROM g")
def weight_summary(spark: SparkSession, d: str) -> DataFrame:
    """Weights of features by index; the mean of a feature stands for its weight here."""
    long = library(spark, d).select(F.posexplode("x").alias("pos", "v"))
    w = long.groupBy("pos").agg(F.abs(F.avg("v")).alias("weight")).withColumn("index_name", F.concat(F.lit("part"), (F.col("pos") / 16).cast("int").cast("string")))
    return rounded(traces.weight_summary(w), "mean", "max")


@query(with_(SQL_LIBRARY) + f"SELECT vec_id, len(list_filter(x, lambda v, i: (i - 1) % 3 < 2)) AS n, {sr('list_sum(list_filter(x, lambda v, i: (i - 1) % 3 < 2))', 'total')} FROM library")
def pruned_vectors(spark: SparkSession, d: str) -> DataFrame:
    """Vectors without the features of no weight, which are every third here."""
    x = traces.pruned(F.col("x"), [i for i in range(64) if i % 3 < 2])
    return library(spark, d).select("vec_id", F.size(x).cast("bigint").alias("n"), r6(F.aggregate(x, F.lit(0.0), lambda a, u: a + u)).alias("total"))


@query(with_(SQL_OBS) + ", c AS (SELECT veg, location_id, count(*) AS n FROM obs GROUP BY 1, 2) SELECT CASE WHEN n >= 50 THEN veg || '__' || location_id ELSE veg END AS part, sum(n)::BIGINT AS n FROM c WHERE veg IS NOT NULL GROUP BY 1")
def label_groups(spark: SparkSession, d: str) -> DataFrame:
    g = traces.label_groups(obs(spark, d).where("veg is not null"), "veg", "location_id", 50)
    return g.groupBy("part").agg(F.count(F.lit(1)).alias("n"))


_DIAG = f""", k AS (SELECT *, bb + vv AS tr, sqrt(pow(bb - vv, 2) + 4 * bv * bv) AS root, ({' + '.join(BANDS)}) / 6 AS mean FROM r WHERE veg = 'populus')
SELECT location_id, py, {sr('ln(sqrt((tr + root) / (tr - root)))', 'log_condition')}, {sr('rmse * rmse * 6 * 1e4', 'rss')}, {sr('1 - rmse * rmse * 6 / (' + ' + '.join(f'pow({b} - mean, 2)' for b in BANDS) + ')', 'r2')} FROM k"""


@query(with_(SQL_OBS) + _TWO + _DIAG)
def fit_diagnostics(spark: SparkSession, d: str) -> DataFrame:
    """Condition number (log), residual sum of squares (x 1e4) and r2 of the two-endmember fits."""
    two = [v for v in _class_vectors(spark, d) if v[0] in ("barren", "populus")]
    y = _season_vectors(spark, d)
    w = unmix.unmix(y, two, _KEYS).groupBy("location_id", "py").pivot("cls", ["barren", "populus"]).agg(F.max("coef"))
    e = np.column_stack([v for _, _, v in two])

    def work(batches):
        for pdf in batches:
            rows = [unmix.diagnostics(np.asarray(x, float), e, np.array([a, b])) for x, a, b in zip(pdf["x"], pdf["barren"], pdf["populus"], strict=True)]
            yield pdf[["location_id", "py"]].assign(log_condition=[np.log(r["condition"]) for r in rows], rss=[r["rss"] * 1e4 for r in rows], r2=[r["r2"] for r in rows])

    got = y.join(w, ["location_id", "py"]).mapInPandas(work, "location_id string, py int, log_condition double, rss double, r2 double")
    return rounded(got, "log_condition", "rss", "r2")


@query()
def pca_lda(spark: SparkSession, d: str) -> DataFrame:
    m = traces.feature_model(library(spark, d), "cls")
    rows = [(i, float(w)) for i, w in enumerate(m["weights"])]
    return spark.createDataFrame(rows, "pos int, weight double")


@query()
def ld_scores(spark: SparkSession, d: str) -> DataFrame:
    v = library(spark, d)
    return traces.projected(v, traces.feature_model(v, "cls")["basis"]).select("vec_id", "cls", "score")


@query()
def index_importance(spark: SparkSession, d: str) -> DataFrame:
    v = library(spark, d)
    names = [f"part{i // 16}" for i in range(64)]
    return spark.createDataFrame(traces.importance(traces.feature_model(v, "cls")["basis"], names), "index_name string, share double")


def _medoid_library(spark: SparkSession, d: str) -> DataFrame:
    v = library(spark, d)
    return traces.medoids(v, ["cls"], "vec_id").select("vec_id").join(v, "vec_id").select(F.col("cls").cast("string").alias("cls"), F.col("vec_id").cast("string").alias("variant_id"), "x")


_MEDOID = _LONG + ", m AS (SELECT cls, pos, median(v) AS m FROM long GROUP BY 1, 2), q AS (SELECT cls, vec_id, sum(pow(v - m, 2)) AS d FROM long JOIN m USING (cls, pos) GROUP BY 1, 2), lib AS (SELECT library.* FROM q JOIN library USING (vec_id) QUALIFY row_number() OVER (PARTITION BY q.cls ORDER BY d, vec_id) = 1)"
_COSINE = "list_dot_product({a}, {b}) / (sqrt(list_dot_product({a}, {a})) * sqrt(list_dot_product({b}, {b})))"


@query(with_(SQL_LIBRARY) + _MEDOID + f", s AS (SELECT l.vec_id, CAST(e.cls AS VARCHAR) AS cls, {_COSINE.format(a='l.x', b='e.x')} AS s FROM library l, lib e) SELECT vec_id, cls, {sr('s', 'similarity')} FROM s QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY s DESC, cls) = 1")
def variant_rank(spark: SparkSession, d: str) -> DataFrame:
    r = unmix.variant_rank(library(spark, d).select("vec_id", "x"), _medoid_library(spark, d), "vec_id")
    return r.where("rank = 1").select("vec_id", "cls", r6(F.col("similarity")).alias("similarity"))


@query(with_(SQL_LIBRARY) + _MEDOID + f" SELECT CAST(a.vec_id AS VARCHAR) AS a, CAST(b.vec_id AS VARCHAR) AS b, {sr('least(greatest(' + _COSINE.format(a='a.x', b='b.x') + ', -0.01), 1.01)', 'similarity')} FROM lib a, lib b WHERE CAST(a.vec_id AS VARCHAR) < CAST(b.vec_id AS VARCHAR)")
def library_cosine(spark: SparkSession, d: str) -> DataFrame:
    return rounded(unmix.library_cosines(_medoid_library(spark, d)), "similarity")


_PEAK = _SOIL + _PPI + ", peak AS (SELECT location_id, py, max(CASE WHEN month(date) BETWEEN 6 AND 9 THEN ppi END) AS peak FROM p GROUP BY 1, 2)"
_ONE = ", one AS (SELECT location_id, py, veg, avg(coef) AS coef FROM coefs GROUP BY 1, 2, 3)"


def _one(spark: SparkSession, d: str) -> DataFrame:
    return coefs(spark, d).groupBy("location_id", "py", "veg").agg(F.avg("coef").alias("coef"))


@query(with_(SQL_OBS, SQL_COEFS) + _PEAK + _ONE + f""", s AS (SELECT location_id, py, sum(CASE WHEN veg <> 'barren' THEN coef END) AS v, count(CASE WHEN veg <> 'barren' THEN 1 END) AS k FROM one GROUP BY 1, 2),
t AS (SELECT s.*, least(greatest(1 - coalesce(v, 0), 0), 1) AS b, CASE WHEN peak IS NULL THEN 0 ELSE greatest(0, 1 - least(peak / 0.584568, 1)) END AS m FROM s LEFT JOIN peak USING (location_id, py)), u AS (SELECT *, CASE WHEN b > m + 1e-6 THEN b - m ELSE 0 END AS freed FROM t)
SELECT location_id, py, veg, {sr('coef', 'coef')}, {sr('CASE WHEN v > 1e-9 THEN coef * (v + freed) / v ELSE freed / k END', 'capped')} FROM one JOIN u USING (location_id, py) WHERE veg <> 'barren'
UNION ALL SELECT location_id, py, 'barren', {sr('b', 'coef')}, {sr('b - freed', 'capped')} FROM u""")  # fmt: skip
def barren_cap(spark: SparkSession, d: str) -> DataFrame:
    p = soil.with_ppi(obs(spark, d))
    peaks = p.groupBy("location_id", "py").agg(F.max(F.when(F.month("date").between(6, 9), F.col("ppi"))).alias("peak"))
    return rounded(unmix.barren_cap(_one(spark, d), peaks, ["location_id", "py"]), "coef", "capped")


@query(with_(SQL_OBS, SQL_COEFS) + _SOIL + _PPI + _SCALER + _ONE + f""", j AS (SELECT one.*, sc.scaler, sum(CASE WHEN veg <> 'barren' THEN coef END) OVER (PARTITION BY one.location_id, one.py) AS t FROM one JOIN sc ON sc.location_id = one.location_id AND sc.py = one.py)
SELECT location_id, py, veg, {sr("CASE WHEN veg = 'barren' THEN 1 - scaler WHEN t > 1e-6 THEN coef / t * scaler ELSE coef * scaler END", 'coef')} FROM j""")  # fmt: skip
def final_scaling(spark: SparkSession, d: str) -> DataFrame:
    scaler = soil.ppi_scaler(soil.with_ppi(obs(spark, d)))
    j = _one(spark, d).join(scaler, ["location_id", "py"])
    return rel.shares(j, ["location_id", "py"], scaler=F.col("scaler")).select("location_id", "py", "veg", r6(F.col("share")).alias("coef"))


@query(with_(SQL_OBS) + "SELECT location_id, py, sum(CASE WHEN month(date) BETWEEN 6 AND 9 THEN 1 ELSE 0 END)::BIGINT AS n_summer_obs, sum(CASE WHEN month(date) BETWEEN 6 AND 9 THEN 1 ELSE 0 END) < 10 AS low_data_flag FROM obs GROUP BY 1, 2")
def summer_flags(spark: SparkSession, d: str) -> DataFrame:
    n = F.sum(F.when(filters.in_months((6, 7, 8, 9)), 1).otherwise(0))
    return obs(spark, d).groupBy("location_id", "py").agg(n.alias("n_summer_obs"), (n < 10).alias("low_data_flag"))


@query(with_(SQL_COEFS) + ", p AS (SELECT 'v1' AS variant_id, 'v2' AS other UNION ALL SELECT 'v1', 'v3') SELECT veg, count(*) AS n, sum(CASE WHEN variant_id = 'v1' THEN 1 ELSE 0 END)::BIGINT AS flagged, max(CASE WHEN variant_id = 'v1' THEN 'v2, v3' END) AS details FROM coefs GROUP BY 1")
def inseparable_flags(spark: SparkSession, d: str) -> DataFrame:
    pairs = spark.createDataFrame([("v1", "v2"), ("v1", "v3")], "variant_id string, other string")
    f = unmix.inseparable_flags(coefs(spark, d), pairs)
    return f.groupBy("veg").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("inseparable_variant_flag").cast("int")).alias("flagged"), F.max("inseparable_variant_details").alias("details"))


_W = "list_count(list_filter([" + ", ".join(repr(t) for t in resample.POISSON) + "], lambda top: top <= CAST('0x' || substr(md5({k} || '/' || CAST(rep // 4 AS VARCHAR) || '/42'), CAST(rep % 4 * 8 + 1 AS INTEGER), 8) AS BIGINT) / 4294967296.0))"


def _boot(key: str, source: str, reps: int = 100) -> str:
    return f""", src AS ({source}), rep AS (SELECT unnest(generate_series(1, {reps})) AS rep), ks AS (SELECT {key} AS k, count(DISTINCT location_id) AS n FROM src GROUP BY 1), ws AS (SELECT k, n, rep, {_W.format(k='k')} AS w FROM ks, rep),
al AS (SELECT rep, sum(w * n) AS al FROM ws GROUP BY 1), per AS (SELECT location_id, py, veg, {key} AS k, avg(coef) AS v FROM src WHERE veg <> 'barren' GROUP BY 1, 2, 3, 4), vv AS (SELECT rep, py, veg, sum(v * w) AS s FROM per JOIN ws USING (k) WHERE w > 0 GROUP BY 1, 2, 3),
gr AS (SELECT location_id, py, k, greatest(0, least(1 - sum(v), 1)) AS b FROM per GROUP BY 1, 2, 3), bb AS (SELECT rep, py, 'barren' AS veg, sum(b * w) / sum(w) AS value FROM gr JOIN ws USING (k) WHERE w > 0 GROUP BY 1, 2),
bt AS (SELECT rep, py, veg, s / al AS value FROM vv JOIN al USING (rep) UNION ALL SELECT * FROM bb) SELECT py, veg, {sr('avg(value)', 'mean')}, {sr('stddev_samp(value)', 'sd')}, {sr('quantile_cont(value, 0.025)', 'coef_025')}, {sr('quantile_cont(value, 0.975)', 'coef_975')}, count(value) AS n FROM bt GROUP BY 1, 2"""


@query(with_(SQL_COEFS) + _boot("location_id", "SELECT * FROM coefs"))
def boot_compile(spark: SparkSession, d: str) -> DataFrame:
    reps = resample.location_bootstrap(coefs(spark, d), 100)
    return rounded(resample.compiled(reps, ["py", "veg"]), "mean", "sd", "coef_025", "coef_975")


_BLOCKS = "SELECT c.*, CASE WHEN p.lat IS NOT NULL THEN CAST(CAST(floor(p.lat / (5/111.32)) AS BIGINT) AS VARCHAR) || '_' || CAST(CAST(floor(p.lon / (5/(111.32*cos(radians(m.m))))) AS BIGINT) AS VARCHAR) END AS block FROM coefs c LEFT JOIN places p USING (location_id), (SELECT avg(lat) AS m FROM places) m"


@query(with_(SQL_COEFS, SQL_PLACES) + _boot("coalesce(block, location_id)", _BLOCKS))
def block_bootstrap(spark: SparkSession, d: str) -> DataFrame:
    """boot_compile with whole spatial blocks of 5 km drawn instead of single locations."""
    blocks = harmonise.block_cells(places(spark, d), 5.0).select("location_id", "block")
    reps = resample.location_bootstrap(coefs(spark, d).join(blocks, "location_id", "left"), 100, key="block")
    return rounded(resample.compiled(reps, ["py", "veg"]), "mean", "sd", "coef_025", "coef_975")


@query(with_(SQL_COEFS) + _ONE + f""", rep AS (SELECT unnest(generate_series(1, 100)) AS rep), ws AS (SELECT k, rep, {_W.format(k='k')} AS w FROM (SELECT DISTINCT location_id AS k FROM one), rep),
v AS (SELECT rep, py, veg, sum(coef * w) / sum(w) AS value FROM one JOIN ws ON k = location_id WHERE w > 0 GROUP BY 1, 2, 3) SELECT py, veg, {sr('avg(value)', 'mean')}, {sr('stddev_samp(value)', 'sd')}, {sr('quantile_cont(value, 0.025)', 'coef_025')}, {sr('quantile_cont(value, 0.975)', 'coef_975')}, count(value) AS n FROM v GROUP BY 1, 2""")
def aggregate_resample(spark: SparkSession, d: str) -> DataFrame:
    """The resampling half of aggregate_bootstrap for all classes and seasons."""
    return rounded(resample.compiled(resample.resampled_means(_one(spark, d), ["py", "veg"], "coef"), ["py", "veg"]), "mean", "sd", "coef_025", "coef_975")


@query()
def aggregate_bootstrap(spark: SparkSession, d: str) -> DataFrame:
    pairs = stats.PairBlocks(_sites(spark, d), "v")
    total = pairs.places.agg(F.var_samp("v").alias("v")).first()["v"] or 0.0
    km = stats.variogram_range([(x, gamma) for _, x, gamma, _ in stats.semivariogram(pairs)], total, 500.0)
    return resample.aggregate_bootstrap(_one(spark, d), "coef", places(spark, d), km)


@query()
def hier_bootstrap(spark: SparkSession, d: str) -> DataFrame:
    o = obs(spark, d).select("obs_id", "location_id", "veg", "nir")
    return resample.hierarchical_bootstrap(o, ["veg"], "location_id", "nir", "obs_id", 1000)


@query()
def index_bootstrap(spark: SparkSession, d: str) -> DataFrame:
    o = obs(spark, d).where(filters.in_months((7, 8, 9))).select("obs_id", "location_id", "py", "doy_cal", ix.spectral_indices()["ndvi"].alias("ndvi"))
    t = stats.detrend_cubic(o, [], "doy_cal", "ndvi")
    return resample.hierarchical_bootstrap(t, ["py"], "location_id", "detrended", "obs_id", 1000)


_INTERVAL = f""", per AS (SELECT location_id, CASE WHEN month(date) IN (7,8,9) THEN 'summer' ELSE 'winter' END AS season, avg({SQL_INDICES['ndvi']}) AS m FROM obs WHERE month(date) IN (1,2,3,7,8,9) GROUP BY 1, 2),
j AS (SELECT per.*, p.veg FROM per JOIN places p USING (location_id) WHERE m IS NOT NULL AND p.veg IS NOT NULL), rep AS (SELECT unnest(generate_series(1, 1000)) AS rep), ws AS (SELECT k, rep, {_W.format(k='k')} AS w FROM (SELECT DISTINCT location_id AS k FROM j), rep),
v AS (SELECT rep, veg, season, sum(m * w) / sum(w) AS value FROM j JOIN ws ON k = location_id WHERE w > 0 GROUP BY 1, 2, 3), b AS (SELECT veg, season, quantile_cont(value, 0.025) AS low, quantile_cont(value, 0.975) AS high FROM v GROUP BY 1, 2),
c AS (SELECT veg, season, count(*) AS n, avg(m) AS mean FROM j GROUP BY 1, 2)"""


@query(with_(SQL_OBS, SQL_PLACES) + _INTERVAL + f" SELECT veg, season, n, {sr('mean', 'mean')}, {sr('low', 'low')}, {sr('high', 'high')} FROM c JOIN b USING (veg, season)")
def class_interval(spark: SparkSession, d: str) -> DataFrame:
    """Mean index of a class in summer and winter over its locations, with the interval of 1,000 bootstrap replicates."""
    season = F.when(F.month("date").isin(7, 8, 9), "summer").otherwise("winter")
    o = obs(spark, d).where(F.month("date").isin(1, 2, 3, 7, 8, 9)).withColumns({"season": season, "ndvi": ix.spectral_indices()["ndvi"]})
    per = o.groupBy("location_id", "season").agg(F.avg("ndvi").alias("m")).where("m is not null")
    j = materialise(per.join(places(spark, d).where("veg is not null").select("location_id", "veg"), "location_id"), "means")
    ends = resample.compiled(resample.resampled_means(j, ["veg", "season"], "m", 1000), ["veg", "season"]).select("veg", "season", F.col("coef_025").alias("low"), F.col("coef_975").alias("high"))
    return rounded(j.groupBy("veg", "season").agg(F.count(F.lit(1)).alias("n"), F.avg("m").alias("mean")).join(ends, ["veg", "season"]), "mean", "low", "high")


@query()
def median_bootstrap(spark: SparkSession, d: str) -> DataFrame:
    """sd and bounds of the median summer index of each location and season."""
    o = obs(spark, d).where(filters.in_months((7, 8, 9))).select("obs_id", "location_id", "py", "doy_cal", ix.spectral_indices()["ndvi"].alias("ndvi"))
    m = resample.median_bootstrap(stats.detrend_cubic(o, [], "doy_cal", "ndvi"), ["location_id", "py"], "detrended").select("location_id", "py", "n", F.explode("medians").alias("value"))
    return resample.compiled(m, ["location_id", "py"])


_PRED = ", pred AS (SELECT o.location_id, o.py, o.veg, o.coef, p.veg AS actual FROM one o JOIN places p USING (location_id) WHERE p.veg IS NOT NULL)"


def _pred(spark: SparkSession, d: str) -> DataFrame:
    return _one(spark, d).join(places(spark, d).where("veg is not null").select("location_id", F.col("veg").alias("actual")), "location_id")


@query(with_(SQL_COEFS, SQL_PLACES) + _ONE + _PRED + f", m AS (SELECT actual, veg, avg(coef) AS m, count(*) AS n FROM pred GROUP BY 1, 2) SELECT actual, veg, {sr('m / sum(m) OVER (PARTITION BY actual)', 'share')}, n FROM m")
def confusion(spark: SparkSession, d: str) -> DataFrame:
    return rounded(resample.confusion(_pred(spark, d), CLASSES), "share")


@query(with_(SQL_COEFS, SQL_PLACES) + _ONE + _PRED + f", b AS (SELECT actual, veg FROM pred WHERE veg <> 'barren' QUALIFY row_number() OVER (PARTITION BY location_id, py ORDER BY coef DESC, veg) = 1) SELECT actual, count(*) AS n, {sr('avg(CASE WHEN veg = actual THEN 1.0 ELSE 0.0 END)', 'accuracy')} FROM b GROUP BY 1")
def argmax_accuracy(spark: SparkSession, d: str) -> DataFrame:
    return rounded(resample.argmax_accuracy(_pred(spark, d), ["location_id", "py"]), "accuracy")


@query(with_(SQL_OBS, SQL_COEFS, SQL_PLACES) + _ONE + _PRED + f", f AS (SELECT location_id, py, count(DISTINCT bin) AS filled FROM obs WHERE bin < 37 GROUP BY 1, 2) SELECT veg, count(*) AS n, {sr('corr(coef, filled)', 'r')}, {sr('avg(filled)', 'filled')} FROM pred JOIN f USING (location_id, py) WHERE veg = actual GROUP BY 1")
def fill_quality(spark: SparkSession, d: str) -> DataFrame:
    f = obs(spark, d).where("bin < 37").groupBy("location_id", "py").agg(F.countDistinct("bin").alias("filled"))
    j = _pred(spark, d).where("veg = actual").join(f, ["location_id", "py"])
    return j.groupBy("veg").agg(F.count(F.lit(1)).alias("n"), r6(F.corr("coef", F.col("filled").cast("double"))).alias("r"), r6(F.avg("filled")).alias("filled"))


@query(with_(SQL_OBS) + "SELECT location_id, py, max(veg) AS actual FROM obs WHERE veg IS NOT NULL GROUP BY 1, 2 HAVING count(DISTINCT veg) = 1")
def true_class(spark: SparkSession, d: str) -> DataFrame:
    return resample.only_class(obs(spark, d).where("veg is not null"), ["location_id", "py"])


@query(with_(SQL_COEFS) + "SELECT veg, replace(printf('%.3f', round(avg(coef) + 1e-9, 6)), '.', ',') || ' ± ' || replace(printf('%.3f', round((quantile_cont(coef, 0.975) - quantile_cont(coef, 0.025)) / 2 + 1e-9, 6)), '.', ',') AS text FROM coefs GROUP BY 1")
def summary_text(spark: SparkSession, d: str) -> DataFrame:
    q = group_percentiles(coefs(spark, d), ["veg"], {"q": "coef"}, [0.025, 0.975], also={"m": F.avg("coef")})
    half = r6((F.col("q_1") - F.col("q_0")) / 2)
    return q.select("veg", resample.summary_text(r6(F.col("m")), -half, half).alias("text"))
