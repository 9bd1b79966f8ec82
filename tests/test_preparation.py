"""Regular grid, neighbours, filled values, implausible readings: brute force, edge cases, planted faults."""

import datetime as dt
import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from reedbed.operators import control_chart, neighbours
from reedbed.operators.control_chart import flag_readings, judge
from reedbed.operators.grid import regular_grid, ten_day_grid
from reedbed.operators.impute import fill_missing, filled_cells
from reedbed.operators.neighbours import VantageTree, great_circle, radius_pairs
from reedbed.operators.skew import join_key_stats, with_block

OBS = "obs_id bigint, location_id string, date date, acquired_at timestamp, nir double, red double, swir1 double, source string, slot string"


def test_grid_marks_carries_and_counts_once(spark):
    rows = [(1, "a", 0, 0.2), (1, "a", 0, 0.2), (2, "a", 0, 0.4), (3, "a", 6, 0.5), (4, None, 1, 0.3), (5, "a", None, 0.3), (6, "a", 2, float("nan")), (7, "b", 3, 0.1)]
    df = spark.createDataFrame(rows, "rid bigint, src string, t int, v double")
    got = {(r["src"], r["t"]): r for r in regular_grid(df, "src", "t", "v", "rid", 2).collect()}
    assert len(got) == 8 and got["a", 0]["n"] == 2 and abs(got["a", 0]["value"] - 0.3) < 1e-12
    assert [got["a", i]["state"] for i in range(7)] == ["observed", "carried", "carried", "missing", "missing", "missing", "observed"]
    assert got["a", 2]["filled"] == got["a", 0]["value"] and got["a", 3]["filled"] is None and got["b", 3]["state"] == "observed"


def test_grid_calendar_edges_and_clashing_columns(spark):
    d = dt.date
    days = [d(2024, 2, 23), d(2024, 2, 24), d(2024, 2, 29), d(2024, 3, 1), d(2024, 3, 10), d(2024, 3, 11)]
    df = spark.createDataFrame([(i, "a", x, None, 0.5, None, None, "s", "t") for i, x in enumerate(days)], OBS)
    got = sorted((r["pheno_year"], r["bin"], r["n"]) for r in ten_day_grid(df).collect())
    assert got == [(2023, 36, 1), (2024, 1, 2), (2024, 2, 1)]  # 23 February is day 360; the 24th and 29th fall in bin 37
    assert ten_day_grid(df.where("false")).count() == 0


def test_grid_does_not_depend_on_chunks(spark):
    rng = np.random.default_rng(12)
    rows = [(i, f"s{i % 3}", int(t), float(i)) for i, t in enumerate(rng.choice(np.arange(-200, 300), 120))]
    df = spark.createDataFrame(rows, "rid bigint, src string, t int, v double")
    whole, cut = ({tuple(r) for r in regular_grid(df, "src", "t", "v", "rid", 3, chunk=c).collect()} for c in (10_000, 7))
    assert whole == cut and {r[5] for r in whole} == {"observed", "carried", "missing"}


def test_grid_hot_source(spark):
    df = spark.range(6000).selectExpr("id as rid", "if(id % 3 = 0, 'hot', concat('s', id % 50)) as src", "cast(id % 400 as int) as t", "cast(id as double) as v")
    got = regular_grid(df, "src", "t", "v", "rid", 3).toPandas()
    want = df.toPandas().groupby(["src", "t"]).v.mean()
    assert np.allclose(got[got.n > 0].set_index(["src", "t"]).value.sort_index(), want.sort_index())
    assert (got.groupby("src").t.count() == got.groupby("src").t.agg(lambda x: x.max() - x.min() + 1)).all()


def _brute(points, r):
    out = set()
    for i, (a, x, y) in enumerate(points):
        for b, u, v in points[i + 1 :]:
            if a != b and great_circle(*map(math.radians, (x, y, u, v))) <= r:
                out.add(tuple(sorted((a, b))))
    return out


def test_radius_pairs_against_brute_force(spark):
    rng = np.random.default_rng(5)
    centres = rng.uniform([36, 73], [36.3, 73.3], (25, 2))
    points = [(f"p{i:04d}", *map(float, centres[i % 25] + rng.normal(0, 8e-4, 2))) for i in range(500)] + [(f"q{i}", 36.1, 73.1) for i in range(40)]
    df = spark.createDataFrame(points + [("p0000", *points[0][1:]), (None, 36.1, 73.1), ("n1", None, 73.1), ("n2", float("nan"), 73.1), ("n3", 0.0, 0.0)], "k string, lat double, lon double")
    for cell, block in ((10, 10_000), (200, 60), (5000, 10_000)):
        got = [(r["k_1"], r["k_2"]) for r in radius_pairs(df, "k", 90.0, points_per_cell=cell, block=block).collect()]
        assert len(got) == len(set(got)) and set(got) == _brute(points, 90.0)
    assert radius_pairs(df.where("false"), "k", 90.0).count() == 0


def test_vantage_tree_copies():
    lat = np.radians(np.full(500, 36.0))
    pairs = [p for p in VantageTree(lat, lat).within(lat[:3], lat[:3], 1.0)]
    assert sum(len(a) for a, _ in pairs) == 1500


COEF = "coef_row_id bigint, location_id string, pheno_year int, veg string, coef double, rmse double, coef_median double, coef_025 double, coef_975 double, coef_sd double, n_obs int, n_summer_obs int"


def _coefficients(n=60):
    rng, rows, i = np.random.default_rng(3), [], 0
    level = {"barren": 0.45, "herbs": 0.3, "populus": 0.2, "tamarix": 0.05}
    for loc in range(n):
        for year in range(2000, 2012):
            for veg, base in level.items():
                c = float(np.clip(base + rng.normal(0, 0.01), 0, 1))
                rows.append([i, f"L{loc}", year, veg, c, 0.02, c, c - 0.05, c + 0.05, 0.02, 20, 8])
                i += 1
    return rows


def test_fill_missing_is_accurate_marks_and_keeps(spark):
    rows = _coefficients()
    truth = {r[0]: list(r) for r in rows}
    for r in rows:
        if r[0] % 40 == 0:
            r[4] = (None, float("nan"), -9999.0)[r[0] % 3]
            r[6:10] = [None] * 4
        elif r[0] % 40 == 1:
            r[3] = ("?", "", None)[r[0] % 3]
        elif r[0] % 40 == 2:
            r[2] = (0, None, 9999)[r[0] % 3]
    rows.append(list(rows[5]))
    got = fill_missing(spark.createDataFrame(rows, COEF)).toPandas().set_index("coef_row_id")
    assert len(got) == len(truth)
    c, v, y = got[got.coef_imputed], got[got.veg_imputed], got[got.pheno_year_imputed]
    assert len(c) == len(v) == len(y) == 72
    assert np.mean([abs(x - truth[i][4]) for i, x in c.coef.items()]) < 0.03
    assert np.mean([x == truth[i][3] for i, x in v.veg.items()]) > 0.95
    assert np.mean([x == truth[i][2] for i, x in y.pheno_year.items()]) > 0.8
    same = got[~got.coef_imputed]
    assert all(x == truth[i][4] for i, x in same.coef.items()) and got.coef.between(0, 1).all() and got.pheno_year.between(1986, 2025).all()


def test_fill_missing_cases(spark):
    z = [None] * 6
    rows = [(1, "A", 2000, "herbs", None, *z, None), (1, "A", 2000, "herbs", None, *z, None), (2, "A", 1900, "POPOLUS", 0.5, *z, None), (3, None, None, "herbs", 0.4, *z, None), (4, "B", 2001, "n/a", 0.2, *z, None), (5, "C", None, None, None, *z, None)]
    rows = [r[:12] for r in rows]
    df = spark.createDataFrame(rows, COEF)
    filled = fill_missing(df)
    assert sorted(map(tuple, filled_cells(filled).collect())) == [(1, "coef"), (2, "pheno_year")]
    got = {r["coef_row_id"]: r for r in filled.collect()}
    assert got[4]["veg_imputed"] and not got[4]["veg_supported"] and not got[3]["pheno_year_supported"] and got[2]["veg"] == "populus"
    assert fill_missing(df.where("false")).count() == 0


def _series(n=300, level=0.3, noise=0.005, seed=0):
    day = np.arange(n) * 8.0 + 6000
    return day, level + 0.05 * np.sin(2 * np.pi * day / 365.25) + np.random.default_rng(seed).normal(0, noise, n)


def test_chart_finds_spikes_not_changes():
    day, v = _series()
    v[200:] += 0.12  # a lasting change
    v[[30, 120]] += 0.09
    v[[60, 61]] -= 0.08
    v[140:145] += 0.1  # an episode
    v[250] = 1.4
    v[251] = np.nan
    v[150:157] = v[150]
    flags = judge(np.zeros(len(v), dtype=np.int64), day, [v], 6.5)[0]
    assert sorted(np.flatnonzero(flags == 3)) == [30, 60, 61, 120]
    assert list(np.flatnonzero(flags == 1)) == [250] and list(np.flatnonzero(flags == 2)) == list(range(150, 157))


def test_flag_readings_slices_agree_with_whole_series(spark):
    day, v = _series(1200, seed=2)
    rng = np.random.default_rng(4)
    hit = rng.choice(np.arange(10, 1190, 7), 30, replace=False)
    v[hit] += rng.choice([-1, 1], 30) * 0.08
    v[700:710] = 0.31
    rows = pd.DataFrame({"i": range(1200), "src": "m", "at": pd.to_datetime(day, unit="D"), "v": v})
    rows = pd.concat([rows, rows.iloc[100:120], pd.DataFrame({"i": [5000, 5001], "src": [None, "m"], "at": [rows["at"][0], pd.NaT], "v": [5.0, 5.0]})])
    df = spark.createDataFrame(rows)
    run = lambda k: {(r["i"], r["reason"]) for r in flag_readings(df, "src", "at", "i", ["v"], slice_rows=k, rows_per_task=500).collect()}
    whole = run(100_000)
    assert {i for i, r in whole if r == "spike"} >= set(hit.tolist()) - set(range(699, 711)) and {(i, "stuck") for i in range(700, 710)} <= whole
    assert run(200) == whole
    assert flag_readings(df.where("false"), "src", "at", "i", ["v"]).count() == 0


def test_skew_helpers(spark):
    df = spark.range(4000).selectExpr("if(id % 3 = 0, 'hot', if(id % 101 = 0, null, concat('k', id % 40))) as k", "id as v")
    blocks = with_block(df, ["k"], df["v"], 200).groupBy("k").agg({"_block": "max"}).toPandas().set_index("k")
    assert blocks.loc["hot"].iloc[0] > 2 and (blocks.drop("hot") == 0).all().iloc[0]
    stats = df.where("k is not null").groupBy("k").agg({"v": "count"}).withColumnRenamed("count(v)", "n")
    joined = join_key_stats(df, stats, ["k"], "n").toPandas()
    assert len(joined) == 4000 and (joined[joined.k == "hot"].n == 1334).all() and joined[joined.k.isna()].n.isna().all()


def _uneven(spark, n=9000):
    """A long source whose scatter grows fivefold half way, with spikes of twelve times the scatter of their time; a short source; repeated deliveries."""
    rng = np.random.default_rng(11)
    day = np.sort(rng.uniform(0, 6000, n))
    sd = np.where(np.arange(n) < n // 2, 0.004, 0.02)
    v = 0.4 + 0.08 * np.sin(2 * np.pi * day / 365.2425) + rng.normal(0, sd)
    at = rng.choice(np.arange(50, n - 50, 40), 60, replace=False)
    v[at] += 12 * sd[at] * rng.choice([-1, 1], 60)
    start = dt.datetime(2000, 1, 1)
    rows = [(i, "long", start + dt.timedelta(days=float(d)), float(x), float(x) if i % 7 else None) for i, (d, x) in enumerate(zip(day, v, strict=True))]
    rows += [(n + i, "short", start + dt.timedelta(days=9 * i), float(x), 0.2) for i, x in enumerate(0.3 + rng.normal(0, 0.01, 80))] + rows[100:140]
    return spark.createDataFrame(rows, "rid bigint, src string, at timestamp, nir double, red double"), at


def test_flags_do_not_depend_on_the_cuts_of_a_long_source(spark, monkeypatch):
    df, at = _uneven(spark)
    flags = lambda n: {tuple(r) for r in flag_readings(df, "src", "at", "rid", ["nir", "red"], slice_rows=n).collect()}
    whole, cut = flags(100_000), flags(4000)
    assert whole == cut
    spikes = {i for i, band, reason in whole if band == "nir" and reason == "spike"}
    assert len(spikes & set(at.tolist())) >= 57 and len(spikes - set(at.tolist())) <= 2
    quiet = set(at[at < 4500].tolist())
    assert len(quiet & spikes) >= len(quiet) - 2  # the noisy half does not hide those of the quiet one
    monkeypatch.setattr(control_chart, "is_short", lambda df, rows=0: False)  # the way without broadcasts
    assert flags(4000) == whole


def test_fit_from_sums_equals_fit_in_one_place(spark):
    df, _ = _uneven(spark, 3000)
    rows = df.where("src = 'long'").select("src", F.unix_micros("at").alias("t"), "rid", F.col("nir").alias("b0"), F.col("red").alias("b1"))
    got = np.array(control_chart._fitted_sources(control_chart._sliced(rows, 700, 90), 2).first()["kept"]).reshape(2, control_chart.KEPT)
    pdf = rows.dropDuplicates(["rid"]).orderBy("t", "rid").toPandas()
    for band, column in enumerate(("b0", "b1")):
        own = pdf[pdf[column].notna()]
        want = control_chart._fitted(np.zeros(len(own), int), own["t"].to_numpy() / 86_400e6, own[column].to_numpy(float), 1)[0]
        assert np.allclose(got[band], want, rtol=1e-9, atol=1e-12)


def _brute_pairs(rows, radius):
    ids, lat, lon = zip(*rows, strict=True)
    a, o = np.radians(lat), np.radians(lon)
    i, j = np.triu_indices(len(ids), 1)
    near = great_circle(a[i], o[i], a[j], o[j]) <= radius
    return {tuple(sorted((ids[x], ids[y]))) for x, y in zip(i[near], j[near], strict=True)}


def test_radius_pairs_of_split_cells(spark, monkeypatch):
    """A line of points, a crowd that pivots can split, and a cluster within a few radii that they cannot."""
    rng = np.random.default_rng(6)
    rows = [(f"r{i}", 36 + i * 4e-4, 73.0) for i in range(300)] + [(f"c{i}", *xy) for i, xy in enumerate(rng.normal([36.05, 73.1], 0.01, (600, 2)))] + [(f"d{i}", *xy) for i, xy in enumerate(rng.uniform([36.2, 73.3], [36.2006, 73.3006], (150, 2)))]
    df = spark.createDataFrame([(k, float(a), float(o)) for k, a, o in rows], "location_id string, lat double, lon double")
    want = _brute_pairs(rows, 90.0)
    for short in (True, False):
        if not short:
            monkeypatch.setattr(neighbours, "is_short", lambda d: False)
        got = radius_pairs(df, "location_id", 90.0, points_per_cell=100, block=40).select("location_id_1", "location_id_2").collect()
        assert len(got) == len(set(got)) and {tuple(sorted(r)) for r in got} == want
    points = df.select(F.col("location_id").alias("id"), "lat", "lon")
    cells = neighbours.voronoi_cells(points, 90.0, 100, 40).toPandas()
    assert cells[cells.home].groupby("id").cell.count().eq(1).all() and cells.home.sum() == len(rows) and len(cells) < 6 * len(rows)
    assert cells[~cells.id.str.startswith("d")].groupby("cell").id.count().max() <= 120
