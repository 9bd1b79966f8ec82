"""Queries of whole pipelines."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reedbed.functions.indices import spectral_indices, with_indices
from reedbed.functions.numeric import r6
from reedbed.operators import filters, pipeline, resample, traces
from reedbed.plans.expression_queries import sr
from reedbed.plans.relational_queries import _BINS, _FILL, _SERIES, class_years, rounded, water_years
from reedbed.plans.views import SQL_COEFS, SQL_INDICES, SQL_OBS, SQL_PLACES, SQL_WATER, coefs, obs, places, with_
from reedbed.operators.relational import lag_join
from reedbed.session import materialise, table
from reedbed.sources.ingest import sensor_bias

INDICES = ["psri", "ndmi", "ndti", "msi"]


def _prepared(spark: SparkSession, d: str, training: bool) -> DataFrame:
    return pipeline.prepare(obs(spark, d), sensor_bias(table(spark, d, "sensor_bias")), places(spark, d), ["nir", "red"], training)


def training_pipeline(spark: SparkSession, d: str) -> DataFrame:
    p = _prepared(spark, d, True)
    return p.groupBy("veg").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("location_id").alias("locations"), *[r6(F.avg(i)).alias(i) for i in (*INDICES, "ppi_norm")])


def fit_pipeline(spark: SparkSession, d: str) -> DataFrame:
    """Library and model from the readings of known classes, then fractions of every season that has enough readings."""
    rows = materialise(_prepared(spark, d, False), "prepared")
    model = pipeline.fit_fractions(filters.known_class(rows), INDICES, k_max=2)
    return pipeline.class_fractions(rows, model)


def fit_two(spark: SparkSession, d: str) -> DataFrame:
    """The fit with one endmember each of two classes and without axes, which SQL can follow."""
    rows = with_indices(obs(spark, d))
    model = pipeline.fit_fractions(rows, ["ndmi", "psri"], ("barren", "populus"), project=False)
    got = model.fractions(pipeline.season_vectors(rows, ["ndmi", "psri"]))
    return rounded(got.select("location_id", "py", "cls", "coef", "rmse"), "coef", "rmse")


def infer_pipeline(spark: SparkSession, d: str) -> DataFrame:
    """Fractions with uncertainty of locations named by their coordinates, from a model that was stored and read back."""
    training = materialise(_prepared(spark, d, True), "training")
    model = pipeline.FractionModel.from_params(json.loads(json.dumps(pipeline.fit_fractions(training, INDICES, k_max=2).params())))
    rows = materialise(pipeline.prepare_inference(obs(spark, d), sensor_bias(table(spark, d, "sensor_bias")), ["nir", "red"]), "inference")
    labels = traces.trace_class(training, ["location_id", "py"])
    oob = pipeline.held_out_residuals(model, pipeline.season_vectors(training, INDICES), labels)
    return model.fractions(pipeline.season_vectors(rows, INDICES), draws=50, bundles=True, oob=oob)


def fit_accuracy(spark: SparkSession, d: str) -> DataFrame:
    """part, interpolated, actual, n, accuracy: a model of half of the labelled locations, judged on either half, on filled and on unfilled traces."""
    rows = materialise(_prepared(spark, d, True), "labelled")
    held = F.pmod(F.xxhash64("location_id"), F.lit(2)) == 1
    model = pipeline.fit_fractions(rows.where(~held), INDICES)
    labels = traces.trace_class(rows, ["location_id", "py"]).withColumnRenamed("cls", "actual")
    out = None
    for filled in (True, False):
        got = model.fractions(pipeline.season_vectors(rows, INDICES, interpolate=filled)).withColumnRenamed("cls", "veg").join(labels, ["location_id", "py"])
        for part, of in (("train", ~held), ("validation", held)):
            one = resample.argmax_accuracy(got.where(of), ["location_id", "py"]).select(F.lit(part).alias("part"), F.lit(filled).alias("interpolated"), "actual", "n", "accuracy")
            out = one if out is None else out.unionByName(one)
    return out


def prototype_table(spark: SparkSession, d: str) -> DataFrame:
    """The library of the fit in long form."""
    return pipeline.fit_fractions(materialise(_prepared(spark, d, True), "training"), INDICES, k_max=2).prototypes(spark)


def scope_trends(spark: SparkSession, d: str) -> DataFrame:
    o = obs(spark, d).withColumns({"scope": F.coalesce("veg", F.lit("unknown")), "ndvi": spectral_indices()["ndvi"]})
    return rounded(pipeline.scope_trends(o, "scope", "ndvi", at_least=5), "mean", "se")


def known_positions(spark: SparkSession, d: str) -> DataFrame:
    return pipeline.known_positions(coefs(spark, d), obs(spark, d), coefs(spark, d), places(spark, d))


def water_overlay(spark: SparkSession, d: str) -> DataFrame:
    joined = lag_join(class_years(spark, d), water_years(spark, d), 0, 0).select("veg", "sheet", "py", "coef", "gw_mean")
    return rounded(pipeline.overlay(joined, ["veg", "sheet"], ["coef", "gw_mean"]), "coef", "gw_mean")


def weighted_means(spark: SparkSession, d: str) -> DataFrame:
    return rounded(pipeline.weighted_means(coefs(spark, d), ["coef", "rmse"], "n_obs"), "coef", "rmse")


QUERIES = {f.__name__: f for f in (training_pipeline, fit_pipeline, fit_two, infer_pipeline, fit_accuracy, prototype_table, scope_trends, known_positions, water_overlay, weighted_means)}

_NDVI = SQL_INDICES["ndvi"]
_LDOT = lambda a, b: f"list_dot_product({a}, {b})"
_TWO = _BINS.replace("FROM obs WHERE", "FROM obs SEMI JOIN many USING (location_id, py) WHERE") + _FILL.replace("SELECT DISTINCT location_id, py, index_name FROM bins", "SELECT location_id, py, unnest(['ndmi', 'psri']) AS index_name FROM many") + f""",
u AS (SELECT location_id, py, list(coalesce(value, 0) ORDER BY index_name, bin) AS x FROM filled GROUP BY 1, 2),
v AS (SELECT location_id, py, CASE WHEN {_LDOT('x', 'x')} < 1e-18 THEN x ELSE list_transform(x, lambda a: a / sqrt({_LDOT('x', 'x')})) END AS x FROM u),
n AS (SELECT location_id, py, veg AS cls FROM obs WHERE veg IN ('barren', 'populus') GROUP BY 1, 2, 3 QUALIFY row_number() OVER (PARTITION BY location_id, py ORDER BY count(*) DESC, veg) = 1),
s AS (SELECT avg(a) FILTER (i <= 36) AS m0, stddev_samp(a) FILTER (i <= 36) AS s0, avg(a) FILTER (i > 36) AS m1, stddev_samp(a) FILTER (i > 36) AS s1 FROM (SELECT unnest(x) AS a, generate_subscripts(x, 1) AS i FROM v JOIN n USING (location_id, py))),
z AS (SELECT location_id, py, list_transform(x, lambda a, i: CASE WHEN i <= 36 THEN (a - m0) / s0 ELSE (a - m1) / s1 END) AS x FROM v, s),
l AS (SELECT cls, location_id || '/' || py AS key, x, unnest(x) AS a, generate_subscripts(x, 1) AS i FROM z JOIN n USING (location_id, py)), med AS (SELECT cls, i, median(a) AS m FROM l GROUP BY 1, 2),
e AS (SELECT cls, any_value(x) AS x FROM l JOIN med USING (cls, i) GROUP BY cls, key QUALIFY row_number() OVER (PARTITION BY cls ORDER BY sum(pow(a - m, 2)), key) = 1),
g AS (SELECT location_id, py, z.x AS y, b.x AS b, p.x AS p, {_LDOT('b.x', 'b.x')} AS bb, {_LDOT('b.x', 'p.x')} AS bp, {_LDOT('p.x', 'p.x')} AS pp, {_LDOT('b.x', 'z.x')} AS yb, {_LDOT('p.x', 'z.x')} AS yp, 10000 * ({_LDOT('b.x', 'b.x')} + {_LDOT('p.x', 'p.x')}) / 144 AS dd
  FROM z, e b, e p WHERE b.cls = 'barren' AND p.cls = 'populus' AND {_LDOT('z.x', 'z.x')} >= 1e-18),
h AS (SELECT *, (yb + dd) * (pp + dd) - (yp + dd) * (bp + dd) AS xb, (yp + dd) * (bb + dd) - (yb + dd) * (bp + dd) AS xp FROM g), w AS (SELECT *, CASE WHEN xb < 0 THEN 0 WHEN xp < 0 THEN 1 ELSE xb / (xb + xp) END AS wb FROM h),
r AS (SELECT *, sqrt(list_sum(list_transform(list_zip(y, b, p), lambda t: pow(t[1] - wb * t[2] - (1 - wb) * t[3], 2))) / 72) AS rmse FROM w)"""
_OVER = "OVER (PARTITION BY scope)"
_CUBIC = f""", s AS (SELECT coalesce(veg, 'unknown') AS scope, location_id, py, doy_cal AS x, {_NDVI} AS y FROM obs WHERE month(date) IN (7,8,9)), o AS (SELECT * FROM s WHERE y IS NOT NULL),
m AS (SELECT *, x - avg(x) {_OVER} AS p1, count(*) {_OVER} AS n FROM o), a AS (SELECT *, coalesce(x - sum(x*p1*p1) {_OVER} / nullif(sum(p1*p1) {_OVER}, 0), 0) * p1 - sum(p1*p1) {_OVER} / n AS p2 FROM m),
b AS (SELECT *, coalesce(x - sum(x*p2*p2) {_OVER} / nullif(sum(p2*p2) {_OVER}, 0), 0) * p2 - coalesce(sum(p2*p2) {_OVER} / nullif(sum(p1*p1) {_OVER}, 0), 0) * p1 AS p3 FROM a),
t AS (SELECT *, y - p1 * coalesce(sum(y*p1) {_OVER} / nullif(sum(p1*p1) {_OVER}, 0), 0) - p2 * coalesce(sum(y*p2) {_OVER} / nullif(sum(p2*p2) {_OVER}, 0), 0) - p3 * coalesce(sum(y*p3) {_OVER} / nullif(sum(p3*p3) {_OVER}, 0), 0) AS f FROM b),
k AS (SELECT scope, count(DISTINCT x) AS k FROM o GROUP BY 1), q AS (SELECT t.scope, py, location_id, avg(CASE WHEN n >= 50 AND k >= 3 THEN f ELSE y END) AS v FROM t JOIN k USING (scope) GROUP BY 1, 2, 3)"""
SQL = {
    "scope_trends": with_(SQL_OBS) + _CUBIC + f" SELECT scope, py, count(v) AS n_locations, {sr('avg(v)', 'mean')}, {sr('stddev_samp(v) / sqrt(count(v))', 'se')} FROM q GROUP BY 1, 2 HAVING count(v) >= 5",
    "fit_two": with_(SQL_OBS) + ", many AS (SELECT location_id, py FROM obs GROUP BY 1, 2 HAVING count(*) >= 8)" + _TWO + f" SELECT location_id, py, 'barren' AS cls, {sr('wb', 'coef')}, {sr('rmse', 'rmse')} FROM r UNION ALL SELECT location_id, py, 'populus', {sr('1 - wb', 'coef')}, {sr('rmse', 'rmse')} FROM r",
    "known_positions": with_(SQL_OBS, SQL_COEFS, SQL_PLACES) + """, k AS (SELECT DISTINCT location_id FROM coefs), o AS (SELECT location_id, min({'lat': lat, 'lon': lon}) AS p FROM obs WHERE lat IS NOT NULL AND lon IS NOT NULL GROUP BY 1),
c AS (SELECT location_id, min({'lat': lat, 'lon': lon}) AS p FROM coefs WHERE lat IS NOT NULL AND lon IS NOT NULL GROUP BY 1), z AS (SELECT location_id, CASE WHEN lat IS NOT NULL AND lon IS NOT NULL THEN {'lat': lat, 'lon': lon} END AS p FROM places),
j AS (SELECT k.location_id, coalesce(o.p, c.p, z.p) AS p FROM k LEFT JOIN o USING (location_id) LEFT JOIN c ON c.location_id = k.location_id LEFT JOIN z ON z.location_id = k.location_id) SELECT location_id, p.lat AS lat, p.lon AS lon FROM j""",
    "water_overlay": with_(SQL_COEFS, SQL_WATER) + _SERIES + f", q AS (SELECT * FROM l WHERE lag = 0), m AS (SELECT veg, sheet, min(coef) AS a, max(coef) AS b, min(gw_mean) AS c, max(gw_mean) AS d FROM q GROUP BY 1, 2) SELECT veg, sheet, py, {sr('(coef - a) / nullif(b - a, 0)', 'coef')}, {sr('(gw_mean - c) / nullif(d - c, 0)', 'gw_mean')} FROM q JOIN m USING (veg, sheet)",
    "weighted_means": with_(SQL_COEFS) + f"SELECT {sr('sum(coef * n_obs) / sum(n_obs)', 'coef')}, {sr('sum(rmse * n_obs) / sum(CASE WHEN rmse IS NOT NULL THEN n_obs END)', 'rmse')} FROM coefs",
}
