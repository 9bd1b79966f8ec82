"""Queries of expressions and filters: indices, phenology index, calendar, labels, corrections, row and group filters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reedbed.functions import indices as ix
from reedbed.functions import labels
from reedbed.functions.calendar import capped_bin, day_bin
from reedbed.functions.numeric import finite, number_of, r6
from reedbed.operators import filters, harmonise, soil
from reedbed.plans.views import SQL_COEFS, SQL_INDICES, SQL_OBS, SQL_PLACES, SQL_SCANS, coefs, obs, places, scans, with_
from reedbed.session import table
from reedbed.sources.ingest import canonical_result, normalise_bands, rename_fixed, sensor_bias, unite

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def r(*names: str) -> list:
    return [r6(F.col(n)).alias(n) for n in names]


def sr(expr: str, name: str) -> str:
    return f"round({expr} + 1e-9, 6) AS {name}"


_NAMES = [n for n in SQL_INDICES if n != "satvi"]


@query(with_(SQL_OBS) + "SELECT location_id, " + ", ".join(sr(f"avg({SQL_INDICES[n]})", n) for n in _NAMES) + " FROM obs GROUP BY 1")
def idx_all(spark: SparkSession, d: str) -> DataFrame:
    return ix.with_indices(obs(spark, d)).groupBy("location_id").agg(*[r6(F.avg(n)).alias(n) for n in _NAMES])


@query(with_(SQL_SCANS) + f"""SELECT location_id, {sr('avg((nir - red) / nullif(nir + red, 0))', 'ndvi')}, {sr('avg(' + SQL_INDICES['evi'] + ')', 'evi')},
  {sr('avg(CASE WHEN pow(2*nir+1,2) - 8*(nir-red) >= 0 THEN (2*nir+1 - sqrt(CASE WHEN pow(2*nir+1,2) - 8*(nir-red) >= 0 THEN pow(2*nir+1,2) - 8*(nir-red) END)) / 2 END)', 'msavi')},
  {sr('avg(nir - red)', 'dvi')}, {sr('avg(' + SQL_INDICES['satvi'] + ')', 'satvi')} FROM scans GROUP BY 1""")  # fmt: skip
def idx_sensor_check(spark: SparkSession, d: str) -> DataFrame:
    s = scans(spark, d)
    s = s.withColumns(ix.sensor_check_indices() | {"satvi": ix.spectral_indices()["satvi"]})
    return s.groupBy("location_id").agg(*[r6(F.avg(n)).alias(n) for n in ("ndvi", "evi", "msavi", "dvi", "satvi")])


@query(with_(SQL_OBS) + f"SELECT location_id, {sr('avg(2.5 * (nir - red) / nullif(nir + 6 * red - 7.5 * red + 1, 0))', 'evi')} FROM obs GROUP BY 1")
def evi_fallback(spark: SparkSession, d: str) -> DataFrame:
    bare = obs(spark, d).withColumn("blue", F.lit(None).cast("double")).withColumn("evi", F.lit(None).cast("double"))
    return ix.evi_or_fallback(bare).groupBy("location_id").agg(r6(F.avg("evi")).alias("evi"))


_SOIL = """, q AS (SELECT location_id, quantile_cont(nir - red, 0.1) AS q, count(nir - red) AS n FROM obs GROUP BY 1),
soil AS (SELECT o.location_id, median(CASE WHEN nir - red <= q.q THEN nir - red END) AS soil FROM obs o JOIN q USING (location_id) WHERE q.n >= 5 GROUP BY 1)"""
_PPI = """, z AS (SELECT o.*, nir - red AS dvi, s.soil, least(greatest(sin(radians(coalesce(lat, 40.2))) * sin(radians(23.45) * sin(2*pi()*(284+doy_cal)/365))
   + cos(radians(coalesce(lat, 40.2))) * cos(radians(23.45) * sin(2*pi()*(284+doy_cal)/365)) * cos(radians(-22.5)), -1), 1) AS cz FROM obs o JOIN soil s USING (location_id)),
m AS (SELECT *, CASE WHEN 0.7 <= soil THEN soil + 1e-3 ELSE 0.7 END AS m, .0336+.0477/cz AS dd FROM z),
k AS (SELECT *, (1/(4*(dd+(1-dd)*0.5/cz)))*(1+m)/(1-m) AS kk FROM m),
p AS (SELECT *, CASE WHEN abs(m-dvi) > 1e-12 AND soil IS NOT NULL THEN kk * ln(greatest((m-soil)/nullif(m-dvi,0), 1e-6)) END AS ppi FROM k)"""


@query(with_(SQL_OBS) + _SOIL + _PPI + f""" SELECT location_id, count(ppi) AS n, {sr('avg(ppi)', 'ppi')}, {sr('avg(degrees(acos(cz)))', 'zenith')},
  {sr('avg(CASE WHEN ppi IS NOT NULL THEN least(greatest(ppi, 0), 1) END)', 'ppi_norm')} FROM p GROUP BY 1""")  # fmt: skip
def ppi(spark: SparkSession, d: str) -> DataFrame:
    p = soil.with_ppi(obs(spark, d))
    return p.groupBy("location_id").agg(F.count("ppi").alias("n"), *[r6(F.avg(c)).alias(c) for c in ("ppi", "zenith", "ppi_norm")])


@query(with_(SQL_OBS) + "SELECT CAST(date AS VARCHAR) AS date, py, doy, doy_cal, bin, count(*) AS n FROM obs GROUP BY ALL")
def pheno_calendar(spark: SparkSession, d: str) -> DataFrame:
    return obs(spark, d).groupBy(F.col("date").cast("string").alias("date"), "py", "doy", "doy_cal", "bin").agg(F.count(F.lit(1)).alias("n"))


@query(with_(SQL_OBS) + """SELECT bin AS bin10, least(CAST(ceil(doy/5.0) AS INTEGER), 73) AS bin5, CASE WHEN doy_cal <= 360 THEN CAST(ceil(doy_cal/30.0) AS INTEGER) END AS bin30, count(*) AS n
  FROM obs GROUP BY ALL""")  # fmt: skip
def doy_bins(spark: SparkSession, d: str) -> DataFrame:
    cal = F.col("doy_cal")
    cols = [F.col("bin").alias("bin10"), capped_bin(F.col("doy"), 5, 73).alias("bin5"), F.when(cal <= 360, day_bin(cal, 30)).alias("bin30")]
    return obs(spark, d).groupBy(*cols).agg(F.count(F.lit(1)).alias("n"))


@query(with_(SQL_PLACES) + "SELECT location_id, CASE WHEN lat IS NOT NULL THEN printf('L_%.6f_%.6f', round(lat, 6), round(lon, 6)) END AS code FROM places")
def location_id(spark: SparkSession, d: str) -> DataFrame:
    return places(spark, d).select("location_id", labels.location_code(F.col("lat"), F.col("lon")).alias("code"))


@query("""SELECT CASE WHEN lower(trim(veg)) = 'tamairx' THEN 'tamarix' WHEN lower(trim(veg)) IN ('herbs','alhagi','salicornia','halocnemum','phragmites') THEN 'herbs'
  WHEN lower(trim(veg)) LIKE 'agric%' OR lower(trim(veg)) = 'agri' THEN 'agriculture' ELSE lower(trim(veg)) END AS label, nullif(lower(trim(veg)), '') AS name, count(*) AS n FROM coefficient GROUP BY ALL""")  # fmt: skip
def canonical_labels(spark: SparkSession, d: str) -> DataFrame:
    v = F.col("veg")
    return table(spark, d, "coefficient").groupBy(labels.canonical_label(v).alias("label"), labels.blank_to_null(v).alias("name")).agg(F.count(F.lit(1)).alias("n"))


@query("""WITH p AS (SELECT '/data/' || source || '-' || CASE doc_id % 4 WHEN 0 THEN 'low' WHEN 1 THEN 'mid' WHEN 2 THEN 'kon' ELSE 'midway' END || '.csv' AS path FROM documents WHERE source IS NOT NULL)
SELECT CASE WHEN path LIKE '%-low.csv' THEN 'low' WHEN path LIKE '%-mid.csv' THEN 'mid' WHEN path LIKE '%-kon.csv' THEN 'kon' ELSE 'unknown' END AS scope,
  regexp_replace(replace(replace(path, '/data/', ''), '.csv', ''), '[^A-Za-z0-9]+', '_', 'g') AS tag, count(*) AS n FROM p GROUP BY ALL""")  # fmt: skip
def scope_token(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("doc_id") % 4
    scope = F.when(k == 0, "low").when(k == 1, "mid").when(k == 2, "kon").otherwise("midway")
    paths = table(spark, d, "documents").where("source is not null").select(F.concat(F.lit("/data/"), "source", F.lit("-"), scope, F.lit(".csv")).alias("path"))
    return paths.groupBy(labels.scope_token(F.col("path")).alias("scope"), labels.source_tag(F.col("path")).alias("tag")).agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT id, count(*) AS n FROM (SELECT CASE WHEN regexp_matches(trim(location_row), '^[0-9]+$') THEN CAST(CAST(trim(location_row) AS BIGINT) AS VARCHAR) ELSE nullif(trim(location_row), '') END AS id FROM location_dim
  UNION ALL SELECT CASE WHEN regexp_matches(location_id_seq, '^[0-9]+$') THEN CAST(CAST(location_id_seq AS BIGINT) AS VARCHAR) ELSE 'L_' || location_id_seq END FROM location_dim) GROUP BY 1""")  # fmt: skip
def id_canonical(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "location_dim")
    raw = p.select(F.concat(F.lit("  00"), "location_row").alias("raw")).unionByName(p.select(F.concat(F.lit("L_"), "location_id_seq").alias("raw")))
    return raw.groupBy(labels.canonical_id(F.col("raw")).alias("id")).agg(F.count(F.lit(1)).alias("n"))


_BANDS = ix.BANDS


@query(with_(SQL_OBS) + ", f AS (SELECT band, ols_slope AS s, ols_intercept AS i, coalesce(ols_significant, true) AS g FROM sensor_bias), w AS (SELECT "
       + ", ".join(f"max(CASE WHEN band='{b}' THEN s END) AS {b}_s, max(CASE WHEN band='{b}' THEN i END) AS {b}_i, bool_or(band='{b}' AND g) AS {b}_g" for b in _BANDS)
       + " FROM f) SELECT satellite, " + ", ".join(sr(f"avg(CASE WHEN satellite='LANDSAT_89' AND {b}_g THEN {b}*{b}_s+{b}_i ELSE {b} END)", b)
       + ", " + sr(f"avg(CASE WHEN satellite='LANDSAT_89' THEN {b}*{b}_s+{b}_i ELSE {b} END)", f"{b}_all") for b in _BANDS) + " FROM obs, w GROUP BY 1")
def affine_correction(spark: SparkSession, d: str) -> DataFrame:
    bias = sensor_bias(table(spark, d, "sensor_bias"))
    o = obs(spark, d)
    marked, every = (harmonise.coefficients(bias, only) for only in (True, False))
    means = [r6(F.avg(harmonise.affine_column(b, terms))).alias(b + end) for b in _BANDS for terms, end in ((marked, ""), (every, "_all"))]
    return o.groupBy("satellite").agg(*means)


@query(with_(SQL_OBS) + ", w AS (SELECT max(ols_slope) AS s, max(ols_intercept) AS i FROM sensor_bias WHERE band = 'nir' AND coalesce(ols_significant, true)) SELECT satellite, " + sr("avg(nir)", "nir_raw") + ", " + sr("avg(CASE WHEN satellite = 'LANDSAT_89' AND s IS NOT NULL THEN nir * s + i ELSE nir END)", "nir") + " FROM obs, w GROUP BY 1")
def raw_backup(spark: SparkSession, d: str) -> DataFrame:
    """A band before and after the sensor correction, the former kept beside it."""
    o = harmonise.affine(harmonise.with_raw(obs(spark, d), ["nir"]), sensor_bias(table(spark, d, "sensor_bias")))
    return o.groupBy("satellite").agg(r6(F.avg("nir_raw")).alias("nir_raw"), r6(F.avg("nir")).alias("nir"))


@query("SELECT count(*) AS n, " + ", ".join(sr(f"avg(CASE WHEN NOT isnan({b}) THEN {b} END)", b) for b in ("blue", "green", "red", "nir", "swir1", "swir2")) + ", " + sr("avg(CASE WHEN NOT isnan(lat) THEN lat END)", "lat") + " FROM observation")
def band_names(spark: SparkSession, d: str) -> DataFrame:
    """Columns of other spellings brought to their names."""
    o = table(spark, d, "observation").select(F.col("blue").alias("BLUE"), F.col("green").alias("Green"), F.col("red").alias("band_red"), F.col("nir").alias("BAND_NIR"), F.col("swir1").alias("Band_swir1"), F.col("swir2").alias("SWIR2"), F.col("lat").alias("target_lat"))
    named = rename_fixed(normalise_bands(o))
    return named.agg(F.count(F.lit(1)).alias("n"), *[r6(F.avg(finite(F.col(c)))).alias(c) for c in (*_BANDS, "lat")])


@query(with_(SQL_OBS) + "SELECT count(*) AS n, sum(CASE WHEN lower(veg) <> 'barren' THEN 1 ELSE 0 END)::BIGINT AS vegetated FROM obs WHERE trim(veg) <> '' AND upper(trim(veg)) <> 'NA'")
def valid_class(spark: SparkSession, d: str) -> DataFrame:
    o = obs(spark, d)
    return filters.valid_class(o).agg(F.count(F.lit(1)).alias("n")).crossJoin(filters.valid_class(o, exclude_barren=True).agg(F.count(F.lit(1)).alias("vegetated")))


@query(with_(SQL_COEFS) + f"""SELECT py, veg, {sr('floor(lat / 0.01) * 0.01 + 0.005', 'cell_lat')}, {sr('floor(lon / 0.01) * 0.01 + 0.005', 'cell_lon')}, {sr('avg(coef)', 'coef')}, count(*) AS n
  FROM coefs WHERE lat IS NOT NULL AND lon IS NOT NULL GROUP BY ALL""")  # fmt: skip
def grid_snap(spark: SparkSession, d: str) -> DataFrame:
    return harmonise.grid_mean(coefs(spark, d), ["py", "veg"], "coef").select("py", "veg", "cell_lat", "cell_lon", *r("coef"), "n")


@query(with_(SQL_OBS) + """SELECT py, count(*) AS before_n, sum(CASE WHEN (red-nir)/nullif(red+nir+1e-9,0) <= 0.28 THEN 1 ELSE 0 END)::BIGINT AS after_n, count(DISTINCT location_id) AS before_locations,
  count(DISTINCT CASE WHEN (red-nir)/nullif(red+nir+1e-9,0) <= 0.28 THEN location_id END) AS after_locations FROM obs WHERE py >= 1986 GROUP BY 1""")  # fmt: skip
def dust_filter(spark: SparkSession, d: str) -> DataFrame:
    o = obs(spark, d).where(filters.first_season(F.col("py")))
    keep = filters.not_dusty()
    return o.groupBy("py").agg(F.count(F.lit(1)).alias("before_n"), F.sum(F.when(keep, 1).otherwise(0)).alias("after_n"), F.countDistinct("location_id").alias("before_locations"),
                               F.countDistinct(F.when(keep, F.col("location_id"))).alias("after_locations"))


@query(with_(SQL_OBS) + """, k AS (SELECT location_id, py FROM obs WHERE month(date) IN (7,8,9) GROUP BY 1,2 HAVING count(*) >= 2)
SELECT location_id, py, count(*) AS n FROM obs WHERE (location_id, py) IN (SELECT (location_id, py) FROM k) GROUP BY 1, 2""")  # fmt: skip
def season_semi(spark: SparkSession, d: str) -> DataFrame:
    o = filters.with_summer(obs(spark, d), ["location_id", "py"], months=(7, 8, 9), at_least=2)
    return o.groupBy("location_id", "py").agg(F.count(F.lit(1)).alias("n"))


@query(with_(SQL_OBS) + ", k AS (SELECT *, count(*) OVER (PARTITION BY location_id, py) AS n FROM obs) SELECT py, sum(CASE WHEN n >= 5 THEN 1 ELSE 0 END)::BIGINT AS kept5, sum(CASE WHEN n >= 8 THEN 1 ELSE 0 END)::BIGINT AS kept8 FROM k GROUP BY 1")
def min_group(spark: SparkSession, d: str) -> DataFrame:
    o = obs(spark, d)
    five = filters.at_least(o, ["location_id", "py"], 5).groupBy("py").agg(F.count(F.lit(1)).alias("kept5"))
    eight = filters.at_least(o, ["location_id", "py"], 8).groupBy("py").agg(F.count(F.lit(1)).alias("kept8"))
    years = o.select("py").distinct()
    return years.join(five, "py", "left").join(eight, "py", "left").fillna(0, ["kept5", "kept8"])


@query(with_(SQL_OBS) + ", b AS (SELECT location_id FROM obs WHERE nir - red IS NOT NULL GROUP BY 1 HAVING count(*) >= 5) SELECT location_id, count(*) AS n FROM obs WHERE location_id IN (SELECT location_id FROM b) GROUP BY 1")
def baseline_anti(spark: SparkSession, d: str) -> DataFrame:
    o = obs(spark, d)
    return filters.drop_without_baseline(o, "location_id", F.col("nir") - F.col("red"), 5).groupBy("location_id").agg(F.count(F.lit(1)).alias("n"))


_COS = "(blue*mb+green*mg+red*mr+nir*mn+swir1*ms+swir2*mt)/nullif(sqrt(blue*blue+green*green+red*red+nir*nir+swir1*swir1+swir2*swir2)*sqrt(mb*mb+mg*mg+mr*mr+mn*mn+ms*ms+mt*mt),0)"


@query(with_(SQL_OBS) + f""", m AS (SELECT avg(blue) AS mb, avg(green) AS mg, avg(red) AS mr, avg(nir) AS mn, avg(swir1) AS ms, avg(swir2) AS mt FROM obs WHERE veg = 'barren')
SELECT veg, count(*) AS n, sum(CASE WHEN {_COS} > 0.99 THEN 1 ELSE 0 END)::BIGINT AS like_barren, {sr(f'avg({_COS})', 'similarity')} FROM obs, m WHERE veg IN ('herbs','populus','tamarix','barren') GROUP BY 1""")  # fmt: skip
def barren_prefilter(spark: SparkSession, d: str) -> DataFrame:
    o = filters.known_class(obs(spark, d))
    s = filters.barren_similarity(o, list(_BANDS))
    return s.groupBy("veg").agg(F.count(F.lit(1)).alias("n"), F.sum((F.coalesce("similarity", F.lit(0.0)) > 0.99).cast("int")).alias("like_barren"), r6(F.avg("similarity")).alias("similarity"))


_MADS = "SELECT location_id, py, " + ", ".join(f"median({b}) AS m_{b}, count({b}) AS n_{b}" for b in ("nir", "red")) + ", count(*) AS n FROM obs GROUP BY 1, 2"


@query(with_(SQL_OBS) + f""", m AS ({_MADS}), a AS (SELECT o.location_id, o.py, median(abs(nir - m_nir)) AS d_nir, median(abs(red - m_red)) AS d_red FROM obs o JOIN m USING (location_id, py) GROUP BY 1, 2)
SELECT o.py, count(*) AS kept, {sr('avg(nir)', 'nir')} FROM obs o JOIN m USING (location_id, py) JOIN a USING (location_id, py)
WHERE n >= 5 AND NOT coalesce(n_nir >= 3 AND abs(nir - m_nir) > 3.5 * 1.4826 * d_nir, false) AND NOT coalesce(n_red >= 3 AND abs(red - m_red) > 3.5 * 1.4826 * d_red, false) GROUP BY 1""")  # fmt: skip
def mad_outliers(spark: SparkSession, d: str) -> DataFrame:
    o = filters.without_mad_outliers(obs(spark, d), ["location_id", "py"], ["nir", "red"])
    return o.groupBy("py").agg(F.count(F.lit(1)).alias("kept"), r6(F.avg("nir")).alias("nir"))


@query()
def spline_outliers(spark: SparkSession, d: str) -> DataFrame:
    o = filters.without_spline_outliers(obs(spark, d).select("obs_id", "location_id", "py", "doy_cal", "nir", "red"), ["location_id", "py"], "obs_id", "doy_cal", ["nir", "red"])
    return o.groupBy("py").agg(F.count(F.lit(1)).alias("kept"))


@query(with_(SQL_OBS) + """, y AS (SELECT py, count(*) AS n, count(DISTINCT location_id) AS k FROM obs WHERE py BETWEEN 1986 AND 2025 AND (nir IS NOT NULL OR red IS NOT NULL OR swir1 IS NOT NULL) GROUP BY 1)
SELECT * FROM y WHERE n >= 10""")  # fmt: skip
def year_filters(spark: SparkSession, d: str) -> DataFrame:
    o = filters.any_present(obs(spark, d).where(F.col("py").between(1986, 2025)), ["nir", "red", "swir1"])
    return o.groupBy("py").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("location_id").alias("k")).where("n >= 10")


@query(with_(SQL_COEFS) + """, t AS (SELECT * FROM coefs WHERE py IN (2023, 2024))
SELECT veg, count(*) AS training, sum(CASE WHEN veg <> 'barren' THEN 1 ELSE 0 END)::BIGINT AS vegetated FROM t GROUP BY 1""")  # fmt: skip
def training_rows(spark: SparkSession, d: str) -> DataFrame:
    t = filters.training_seasons(coefs(spark, d), "py")
    kept = filters.not_barren(t)
    return t.groupBy("veg").agg(F.count(F.lit(1)).alias("training")).join(kept.groupBy("veg").agg(F.count(F.lit(1)).alias("vegetated")), "veg", "left").fillna(0, ["vegetated"])


@query(with_(SQL_PLACES) + "SELECT location_id FROM places ORDER BY (CAST(coalesce(regexp_extract(location_id, '([0-9]+)$', 1), '0') AS BIGINT) * 7919 + 42) % 10007, location_id LIMIT 200")
def sample_cap(spark: SparkSession, d: str) -> DataFrame:
    key = F.coalesce(F.regexp_extract("location_id", "([0-9]+)$", 1).cast("bigint"), F.lit(0))
    return filters.capped_locations(places(spark, d), "location_id", key, 200, seed=42).select("location_id")


@query("SELECT " + ", ".join(sr(f"avg(CASE WHEN {b} >= 0 AND {b} <= 1 AND NOT isnan({b}) THEN {b} END)", b) for b in _BANDS) + """, count(*) AS n, count(scan_id) AS with_scan
  FROM (SELECT * EXCLUDE (dvi) FROM observation UNION ALL BY NAME SELECT * FROM sensor_obs)""")  # fmt: skip
def union_by_name(spark: SparkSession, d: str) -> DataFrame:
    from reedbed.functions.numeric import plausible

    both = unite([table(spark, d, "observation").drop("dvi"), table(spark, d, "sensor_obs")])
    return both.agg(*[r6(F.avg(plausible(F.col(b)))).alias(b) for b in _BANDS], F.count(F.lit(1)).alias("n"), F.count("scan_id").alias("with_scan"))


@query("SELECT location_id, pheno_year, veg, coef_row_id, variant_id FROM coefficient WHERE coef BETWEEN 0 AND 1 AND NOT isnan(coef)")
def canonical_output(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "coefficient").where("coef between 0 and 1")
    return canonical_result(rows.select("coef_row_id", "variant_id", "veg", "pheno_year", "location_id"))


@query("""SELECT inference_source_tag AS tag, sum(CASE WHEN low_data_flag THEN 1.0 WHEN NOT low_data_flag THEN 0.0 END) AS low, count(*) AS n FROM coefficient GROUP BY 1""")
def text_numbers(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "coefficient").withColumn("low", number_of(F.col("low_data_flag").cast("string")))
    return rows.groupBy(F.col("inference_source_tag").alias("tag")).agg(F.sum("low").alias("low"), F.count(F.lit(1)).alias("n"))
