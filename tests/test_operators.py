"""Expressions, numeric kernels and operators against hand-computed values and brute force."""

import datetime as dt
import math
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from reedbed.functions import calendar, indices, labels
from reedbed.functions.numeric import number_of
from reedbed.operators import filters, harmonise, relational, resample, soil, stats, traces, unmix
from reedbed.sources import ingest


def test_calendar(spark):
    days = {"2024-02-28": (2023, 365), "2024-02-29": (2023, 366), "2024-03-01": (2024, 1), "2023-03-01": (2023, 1), "2023-02-28": (2022, 365), "2024-12-31": (2024, 306), "2025-01-01": (2024, 307)}
    df = spark.createDataFrame([(k,) for k in [*days, None]], "d string").withColumn("x", F.col("d").cast("date"))
    got = {r["d"]: (r["y"], r["n"]) for r in df.select("d", calendar.pheno_year(F.col("x")).alias("y"), calendar.pheno_doy(F.col("x")).alias("n")).collect()}
    assert got == {**days, None: (None, None)}
    b = spark.range(1).select(*[calendar.capped_bin(F.lit(x)).alias(str(x)) for x in (1, 10, 11, 360, 361, 366)]).first()
    assert list(b) == [1, 1, 2, 36, 37, 37]


def test_indices_by_hand(spark):
    row = (0.1, 0.12, 0.15, 0.35, 0.25, 0.2)
    df = spark.createDataFrame([row, (0.1, None, None, 0.35, 0.25, 0.2), (0.0, 0.0, -0.16, 0.0, 0.0, 0.0)], ", ".join(f"{b} double" for b in indices.BANDS))
    a, b, c = indices.with_indices(df).collect()
    blue, green, red, nir, swir1, swir2 = row
    want = {"dvi": nir - red, "ndvi": (nir - red) / (nir + red), "evi": 2.5 * (nir - red) / (nir + 6 * red - 7.5 * blue + 1), "psri": (red - blue) / nir, "msi": swir1 / nir, "osavi": (nir - red) / (nir + red + 0.16),
            "msavi": (2 * nir + 1 - math.sqrt((2 * nir + 1) ** 2 - 8 * (nir - red))) / 2, "mcari": ((red - green) - 0.2 * (red - blue)) * red / green, "nbr": (nir - swir2) / (nir + swir2)}
    assert all(abs(a[k] - v) < 1e-7 for k, v in want.items())
    assert b["ndvi"] is None and b["msavi"] is None and b["ndmi"] is not None and c["osavi"] is None


def test_ppi_limits(spark):
    df = spark.createDataFrame([(0.3, 0.03), (0.7, 0.03), (0.9, 0.03), (None, 0.03), (0.3, None), (0.3, 0.8)], "dvi double, soil double")
    got = [r[0] for r in df.select(indices.ppi(F.col("dvi"), F.lit(0.8), F.col("soil"))).collect()]
    d = 0.0336 + 0.0477 / 0.8
    q = d + (1 - d) * 0.5 / 0.8
    assert abs(got[0] - 1 / (4 * q) * 1.7 / 0.3 * math.log(0.67 / 0.4)) < 1e-9
    assert got[1] is None and got[3] is None and got[4] is None and got[2] < -1 and got[5] is not None


def test_labels(spark):
    raw = [" Tamairx", "PHRAGMITES", "Agri", "", None, "popolus", "none", "n/a", "bare", " HERBS ", "unknown"]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(raw)], "i int, v string").orderBy("i")
    rows = df.select(labels.canonical_label(F.col("v")), labels.named_class(F.col("v"))).collect()
    assert [r[0] for r in rows][:5] == ["tamarix", "herbs", "agriculture", "", None]
    assert [r[1] for r in rows] == ["tamarix", "herbs", None, None, None, "populus", None, None, "barren", "herbs", None]
    ids = spark.createDataFrame([(x,) for x in (" L_007 ", "0042", "PLOT-1", " ", None, "L12")], "v string").select(labels.canonical_id(F.col("v"))).collect()
    assert [r[0] for r in ids] == ["7", "42", "PLOT-1", None, None, "12"]
    scopes = spark.createDataFrame([(x,) for x in ("/a/run_mid.csv", "/a/lower-1.csv", "kon", "midway")], "v string").select(labels.scope_token(F.col("v"))).collect()
    assert [r[0] for r in scopes] == ["mid", "low", "kon", "unknown"]
    assert [r[0] for r in spark.createDataFrame([("TRUE",), ("f",), ("1.5",), ("x",)], "v string").select(number_of(F.col("v"))).collect()] == [1.0, 0.0, 1.5, None]
    code = spark.createDataFrame([(36.5, 73.25), (None, 1.0), (float("nan"), 1.0)], "a double, o double").select(labels.location_code(F.col("a"), F.col("o"))).collect()
    assert [r[0] for r in code] == ["L_36.500000_73.250000", None, None]


def test_sensor_correction_errors_and_modes(spark):
    bias = spark.createDataFrame([("nir", 0.9, 0.01, True), ("red", 0.5, 0.0, False), ("blue", 2.0, 0.0, None)], "band string, ols_slope double, ols_intercept double, ols_significant boolean")
    df = spark.createDataFrame([("LANDSAT_89", 0.4, 0.2, 0.1), ("LANDSAT_457", 0.4, 0.2, 0.1), (None, 0.4, 0.2, 0.1)], "satellite string, nir double, red double, blue double")
    got = [tuple(round(x, 6) for x in r[1:]) for r in harmonise.affine(df, ingest.sensor_bias(bias)).collect()]
    assert got == [(0.37, 0.2, 0.2), (0.4, 0.2, 0.1), (0.4, 0.2, 0.1)]
    assert round(harmonise.affine(df, ingest.sensor_bias(bias), only_significant=False).first()["red"], 6) == 0.1
    with pytest.raises(ValueError):
        harmonise.coefficients(ingest.sensor_bias(spark.createDataFrame([("nir", float("nan"), 0.0, True)], bias.schema)))


def test_ingest(spark, tmp_path):
    df = spark.createDataFrame([(1.0, 2.0, "x")], "Band_nir double, RED double, vegetation string")
    assert ingest.rename_fixed(ingest.normalise_bands(df)).columns == ["nir", "red", "veg"]
    assert ingest.find_coordinates(["id", "target_lon", "latitude"]) == ("target_lon", "latitude")
    assert ingest.find_water_columns(["Year", "gw_depth"])["date"] is None and ingest.find_water_columns(["Year", "gw_depth"])["year"] == "Year"
    with pytest.raises(ValueError):
        ingest.require_columns(df, ["nir2"])
    coefs = spark.createDataFrame([("b", 2001, "herbs", 0.5, None), ("a", 2002, "herbs", None, 1.0)], "location_id string, pheno_year int, veg string, coef double, extra double")
    assert ingest.metric_column(coefs) == "coef"
    with pytest.raises(ValueError):
        ingest.metric_column(coefs, "coef_raw")
    paths = ingest.write_result(coefs, str(tmp_path / "out"), "tag")
    back = ingest.scan_files(spark, paths, provenance=True)
    assert back.count() == 4 and "scope" in back.columns and back.where("coef is null").count() == 2
    ingest.write_sheets({"Alagan": coefs}, str(tmp_path))
    assert ingest.scan_sheet(spark, str(tmp_path), "Alagan").count() == 2
    ingest.write_by_location(coefs, str(tmp_path / "by"))
    assert (tmp_path / "by" / "location_id=a").exists()
    ingest.save_params({"k": [1, 2]}, str(tmp_path / "p.json"))
    assert ingest.load_params(str(tmp_path / "p.json")) == {"k": [1, 2]}
    assert ingest.find_date_column(spark.createDataFrame([("x", "2024-01-02")], "a string, b string")) == "b"
    (tmp_path / "run_mid.csv").write_text("a\n1")
    (tmp_path / "run_kon.csv").write_text("a\n1")
    assert [p[-7:] for p in ingest.sibling_scopes(str(tmp_path / "run_mid.csv"))] == ["mid.csv", "kon.csv"]


def _brute_nnls(a, b):
    best, at = np.inf, None
    for k in range(a.shape[1] + 1):
        for s in combinations(range(a.shape[1]), k):
            x = np.zeros(a.shape[1])
            if s:
                x[list(s)] = np.linalg.lstsq(a[:, s], b, rcond=None)[0]
            e = ((a @ x - b) ** 2).sum()
            if (x >= -1e-12).all() and e < best - 1e-12:
                best, at = e, x
    return at


def test_nnls_and_known_mixtures():
    rng = np.random.default_rng(1)
    for _ in range(60):
        a, b = rng.normal(size=(7, 4)), rng.normal(size=7)
        assert np.allclose(unmix.nnls(a, b), _brute_nnls(a, b), atol=1e-7)
    e = rng.uniform(0, 1, (6, 3))
    for w in ([1, 0, 0], [0.2, 0.3, 0.5], [0, 0.5, 0.5]):
        x, rmse = unmix.fcls(e, e @ np.array(w))
        assert np.allclose(x, w, atol=1e-4) and rmse < 1e-4 and abs(x.sum() - 1) < 1e-12
    x, _ = unmix.reweighted(e, e @ np.array([0.2, 0.3, 0.5]))
    assert np.allclose(x, [0.2, 0.3, 0.5], atol=0.02)
    assert np.allclose(unmix.sparsified(np.array([0.4, 0.3, 0.2, 0.1]), ["barren", "a", "b", "c"]), np.array([0.4, 0.3, 0.2, 0]) / 0.9)
    assert unmix.diagnostics(e @ np.array([1, 0, 0.0]), e, np.array([1, 0, 0.0]))["r2"] == pytest.approx(1)


def test_unmix_recovers_and_skips(spark):
    rng = np.random.default_rng(2)
    lib = [(c, f"{c}1", rng.uniform(0, 1, 8)) for c in ("barren", "herbs", "populus")]
    mixes = [(i, (0.5 * lib[0][2] + 0.5 * lib[1 + i % 2][2]).tolist()) for i in range(6)] + [(9, [None] * 8), (8, [0.0] * 8)]
    df = spark.createDataFrame(mixes, "k int, x array<double>")
    got = unmix.unmix(df, lib, "k int", solver="sparse").toPandas()
    assert set(got.k) == set(range(6)) and np.allclose(got.groupby("k").coef.sum(), 1)
    assert (got[got.cls == "barren"].coef - 0.5).abs().max() < 1e-3
    noisy = unmix.unmix(df, lib, "k int", draws=10).toPandas()
    assert noisy.sd.notna().all() and (noisy.low <= noisy.high).all()
    with pytest.raises(ValueError):
        unmix.unmix(df, lib, "k int", solver="magic")


def test_student_t():
    assert stats.student_t_p(np.array([2.0, 0.0, -2.228139]), np.array([10.0, 5.0, 10.0])) == pytest.approx([0.07338803, 1.0, 0.05], abs=1e-6)


def test_whittaker_and_splines():
    y = np.arange(37.0)
    y[[3, 4, 20]] = np.nan
    assert np.allclose(stats.whittaker(y), np.arange(37.0), atol=1e-6) and np.isnan(stats.whittaker(np.full(5, np.nan))).all()
    day = np.linspace(1, 360, 24)
    v = 0.3 + 0.1 * np.sin(day / 58) + np.random.default_rng(0).normal(0, 0.003, 24)
    v[[7, 15]] += [0.2, -0.2]
    assert list(np.flatnonzero(filters.spline_outlier_mask(day, v))) == [7, 15]


def test_min_group_and_outliers(spark):
    rows = [(i, "a", 2000, 10.0 * i, 0.3 + 0.001 * i) for i in range(24)] + [(50 + i, "b", 2000, 10.0 * i, 0.3) for i in range(4)]
    df = spark.createDataFrame(rows, "obs_id int, location_id string, py int, doy_cal double, nir double")
    assert filters.at_least(df, ["location_id", "py"], 5).count() == 24
    assert filters.without_mad_outliers(df.withColumn("nir", F.when(F.col("obs_id") == 5, 2.0).otherwise(F.col("nir"))), ["location_id", "py"], ["nir"]).count() == 23
    assert filters.without_spline_outliers(df, ["location_id", "py"], "obs_id", "doy_cal", ["nir"]).where("location_id = 'b'").count() == 0


def test_detrend_equals_polyfit(spark):
    rng = np.random.default_rng(0)
    x = rng.integers(180, 270, 200)
    y = 0.3 + 0.01 * (x - 220) - 1e-4 * (x - 220) ** 2 + 1e-6 * (x - 220) ** 3 + rng.normal(0, 0.02, 200)
    df = spark.createDataFrame([(i, int(a), float(b)) for i, (a, b) in enumerate(zip(x, y, strict=True))], "i int, x int, y double")
    got = stats.detrend_cubic(df, [], "x", "y").toPandas().sort_values("i").detrended.to_numpy()
    fit = np.polyval(np.polyfit(x - 220.0, y, 3), x - 220.0)
    assert np.allclose(got, y - fit + y.mean() - (fit - fit.mean()).mean(), atol=1e-8)


def test_gap_fill_equals_interp(spark):
    rows = [("a", 2000, "i", b, v) for b, v in ((3, 0.2), (7, 0.6), (20, 0.1))] + [("b", 2000, "i", 5, 0.4)]
    df = spark.createDataFrame(rows, "location_id string, py int, index_name string, bin int, value double")
    got = relational.fill_bins(df).toPandas()
    a = got[got.location_id == "a"].sort_values("bin").value
    assert np.allclose(a, np.interp(np.arange(1, 37), [3, 7, 20], [0.2, 0.6, 0.1])) and (got[got.location_id == "b"].value == 0.4).all()


def test_splits_are_disjoint_and_stratified(spark):
    df = spark.createDataFrame([(f"L{i}", ("herbs", "populus", "barren")[i % 3] if i else "tamarix", i) for i in range(40)], "k string, veg string, n bigint")
    got = relational.holdout(df, "k", "veg", F.col("n")).toPandas()
    assert got.k.is_unique and not got[got.veg == "tamarix"].held.any()
    for _, g in got[got.veg != "tamarix"].groupby("veg"):
        assert g.held.sum() == min(math.ceil(0.3 * len(g)), len(g) - 1)
    assert relational.balanced_sample(df.where("veg <> 'tamarix'"), "k", "veg", F.col("n")).where("veg <> 'barren'").groupBy("veg").count().select("count").distinct().count() == 1


def test_variogram_moran_blocks(spark):
    rng = np.random.default_rng(3)
    pts = [(f"p{i}", float(a), float(o), float(math.sin(a * 40) + o)) for i, (a, o) in enumerate(rng.uniform([36, 73], [36.3, 73.3], (40, 2)))]
    df = spark.createDataFrame(pts + [("n", None, 73.0, 1.0)], "location_id string, lat double, lon double, v double")
    pairs = stats.location_pairs(df, "v")
    assert pairs.count() == 780
    lat, lon, v = (np.array([p[i] for p in pts]) for i in (1, 2, 3))
    assert stats.moran(pairs).first()["i"] == pytest.approx(stats.moran_p(lat, lon, v, 3)[0], abs=1e-9)
    x = np.linspace(2, 40, 10)
    assert stats.variogram_range([(a, 0.5 * (1 - math.exp(-a / 12))) for a in x], 0.5, 50) == pytest.approx(12, rel=0.02)
    assert harmonise.block_cells(df, 5.0).where("block is null").count() == 1
    assert len(resample.block_sample(["a", "b", "c"], [3, 4, 5], 9)) >= 2
    with pytest.raises(ValueError):
        resample.block_sample(["a"], [3], 9)


def test_features_and_library(spark):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(3, 12)) * 3
    rows = [(i, "abc"[i % 3], (centres[i % 3] + rng.normal(size=12)).tolist()) for i in range(150)]
    df = spark.createDataFrame(rows, "vec_id int, cls string, x array<double>")
    m = traces.feature_model(df, "cls")
    scores = np.array([r[2] for r in rows]) @ m["basis"]
    near = [min(m["centroids"], key=lambda c: ((s - m["centroids"][c]) ** 2).sum()) for s in scores]
    assert np.mean([a == r[1] for a, r in zip(near, rows, strict=True)]) > 0.97
    got = traces.projected(df, m["basis"]).toPandas().sort_values("vec_id").score.tolist()
    assert np.allclose(got, scores)
    assert {r["cls"] for r in unmix.endmember_library(df, {"a": 2, "b": 1, "c": 1}, "vec_id").collect()} == {"a", "b", "c"}
    x = np.array([[0.0, 0], [1, 1], [0.1, 0], [5, 5]])
    assert unmix.greedy_endmembers(x, 2)[1] == 3


def test_pair_mask_and_lags(spark):
    rng = np.random.default_rng(6)
    x = rng.uniform(0.2, 0.4, 40)
    y = 0.95 * x + 0.01 + rng.normal(0, 0.002, 40)
    y[[3, 9]] += 0.3
    df = spark.createDataFrame([("nir", float(a), float(b)) for a, b in zip(x, y, strict=True)], "band string, a double, b double")
    kept = filters.robust_pair_mask(df, ["band"], "a", "b")
    fit = stats.linear_fit(kept, ["band"], "a", "b").first()
    assert kept.where("b > 0.5").count() == 0 and fit["slope"] == pytest.approx(0.95, abs=0.03) and fit["p"] < 1e-6
    a = {2000 + i: math.sin(i * 1.7) for i in range(9)}
    series = spark.createDataFrame([("s", y + 1, v) for y, v in a.items()], "k string, py int, v double")
    water = spark.createDataFrame(list(a.items()), "year int, w double")
    best = stats.best_lag(stats.lag_table(series, water, ["k"], "v", "w").where("n >= 5"), ["k"]).first()
    assert best["lag"] == 1 and best["r"] == pytest.approx(1)


def test_soil_and_cap(spark):
    rows = [("a", 0.1 + 0.01 * i, 0.05) for i in range(20)] + [("b", 0.2, 0.1)] * 3
    df = spark.createDataFrame(rows, "location_id string, nir double, red double")
    got = {r["location_id"]: r["soil"] for r in soil.low_quantile_baseline(df).collect()}
    v = np.array([0.05 + 0.01 * i for i in range(20)])
    assert set(got) == {"a"} and got["a"] == pytest.approx(np.median(v[v <= np.quantile(v, 0.1)]))
    c = spark.createDataFrame([("a", 1, "herbs", 0.2), ("a", 1, "populus", 0.2), ("a", 1, "barren", 0.6)], "location_id string, py int, veg string, coef double")
    p = spark.createDataFrame([("a", 1, 0.584568 * 0.8)], "location_id string, py int, peak double")
    capped = {r["veg"]: r["capped"] for r in unmix.barren_cap(c, p, ["location_id", "py"]).collect()}
    assert capped["barren"] == pytest.approx(0.2) and sum(capped.values()) == pytest.approx(1) and len(capped) == 3


def test_stream_equals_batch(spark, tmp_path):
    from reedbed.streaming import bins

    base = dt.datetime(2024, 1, 1)
    rows = [(i, "a", base + dt.timedelta(days=i), 0.3 + i / 1000) for i in range(120)] + [(5, "a", base + dt.timedelta(days=5), 0.305)]
    df = spark.createDataFrame(rows, "obs_id bigint, location_id string, acquired_at timestamp, nir double")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    q = bins.write_bins(bins.stream_bins(bins.read_stream(spark, str(tmp_path / "in"), df.schema)), str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "out")).toPandas()
    want = df.dropDuplicates(["obs_id"]).groupBy(F.window("acquired_at", "10 days").alias("w")).agg(F.count("*").alias("n"), F.avg("nir").alias("v")).select(F.col("w.start").alias("start"), "n", "v").toPandas()
    joined = got.merge(want, on="start")
    assert len(got) == len(joined) >= 7 and (joined.n_x == joined.n_y).all() and np.allclose(joined.value, joined.v)
