"""Queries and operators take all of their input: no row, location, class or replicate is left out."""

import datetime as dt

import numpy as np
import pytest

from reedbed.operators import resample, stats, unmix
from reedbed.plans import model_queries

BANDS = ("blue", "green", "red", "nir", "swir1", "swir2")


def _places(spark, n):
    rng = np.random.default_rng(5)
    rows = [(f"p{i:05d}", float(a), float(o), float(v)) for i, (a, o, v) in enumerate(rng.uniform([36, 73, 0], [37, 74, 1], (n, 3)))]
    return spark.createDataFrame(rows, "location_id string, lat double, lon double, v double"), np.array([r[1:] for r in rows])


def test_pair_statistics_take_all_locations(spark, monkeypatch):
    monkeypatch.setattr(stats, "PAIR_BLOCK", 100)
    monkeypatch.setattr(stats, "RANK_FETCH", 500)
    df, (lat, lon, v) = (x := _places(spark, 500))[0], x[1].T
    blocks = stats.PairBlocks(df, "v")
    i, j = np.triu_indices(500, 1)
    a, o = np.radians(lat), np.radians(lon)
    km = 2 * 6371 * np.arcsin(np.sqrt(np.sin((a[j] - a[i]) / 2) ** 2 + np.cos(a[i]) * np.cos(a[j]) * np.sin((o[j] - o[i]) / 2) ** 2))
    cuts = np.quantile(km, np.linspace(0, 1, 11))
    for k, (number, middle, gamma, n) in enumerate(stats.semivariogram(blocks)):
        of = (km >= cuts[k]) & (km < cuts[k + 1])
        assert number == k + 1 and n == of.sum() and middle == pytest.approx((cuts[k] + cuts[k + 1]) / 2) and gamma == pytest.approx(np.median((v[i] - v[j])[of] ** 2 / 2))
    assert stats.moran_test(blocks, 19) == pytest.approx(stats.moran_p(lat, lon, v, 19))
    assert stats.moran_of_lags(blocks.lags()).first()["i"] == pytest.approx(stats.moran_p(lat, lon, v, 1)[0])
    assert stats.effective_n(blocks, 20.0, 500) == pytest.approx(500 / (1 + 499 * np.exp(-km / 20).mean()))


def test_pairs_of_more_than_two_thousand_locations(spark):
    pairs = stats.location_pairs(_places(spark, 2100)[0], "v")
    assert pairs.where("a < b").count() == pairs.select("a", "b").distinct().count() == 2100 * 2099 // 2


def test_spatial_queries_take_all_locations(spark, tmp_path):
    day = dt.date(2020, 7, 1)
    rows = [(i, f"L{i}", day, "S2", 36 + i / 1000, 73.0, "herbs", *[0.1 + i / 1000] * 6) for i in range(330)]
    spark.createDataFrame(rows, "obs_id bigint, location_id string, date date, satellite string, lat double, lon double, vegetation string, " + ", ".join(f"{b} double" for b in BANDS)).write.parquet(str(tmp_path / "observation.parquet"))
    assert model_queries.pairs_distance(spark, str(tmp_path)).count() == 330 * 329 // 2
    assert model_queries.moran_i(spark, str(tmp_path)).first()["n"] == 330


def test_queries_draw_the_replicates_of_the_reference(spark, monkeypatch):
    seen = {}
    for name in ("obs", "coefs", "_season_vectors", "_class_vectors"):
        monkeypatch.setattr(model_queries, name, lambda s, d: spark.createDataFrame([], "obs_id int, location_id string, py int, doy_cal int, date date, veg string, " + ", ".join(f"{b} double" for b in BANDS)))
    monkeypatch.setattr(resample, "compiled", lambda reps, keys: reps)
    monkeypatch.setattr(model_queries, "rounded", lambda df, *columns: df)
    monkeypatch.setattr(resample, "location_bootstrap", lambda df, n: seen.update(boot_compile=n))
    monkeypatch.setattr(unmix, "unmix", lambda *a, draws=0, **k: seen.update(mc_uncertainty=draws))
    monkeypatch.setattr(resample, "hierarchical_bootstrap", lambda df, groups, key, value, number, n: seen.update({{"nir": "hier_bootstrap", "detrended": "index_bootstrap"}[value]: n}))
    for name in ("boot_compile", "mc_uncertainty", "hier_bootstrap", "index_bootstrap"):
        model_queries.QUERIES[name](spark, "")
    assert seen == {"boot_compile": 100, "mc_uncertainty": 50, "hier_bootstrap": 1000, "index_bootstrap": 1000}


def test_greedy_library_takes_all_vectors(spark, monkeypatch):
    monkeypatch.setattr(unmix, "GREEDY_BLOCK", 700)
    x = np.random.default_rng(7).normal(size=(2500, 3)) ** 3
    x[5, 1] = np.nan
    df = spark.createDataFrame([(i, "a", r.tolist()) for i, r in enumerate(x)] + [(9000 + i, "b", [float(i), 0.0, 0.0]) for i in range(9)], "vec_id int, cls string, x array<double>")
    got = unmix.endmember_library(df, {"a": 4, "b": 1}, "vec_id").orderBy("variant_id").collect()
    assert [r["vec_id"] for r in got] == [*unmix.greedy_endmembers(x, 4), 9004]
    assert [r["n_samples"] for r in got] == [625] * 4 + [9]


def test_library_search_scores_all_classes(spark, tmp_path):
    rng = np.random.default_rng(8)
    e, y = rng.uniform(0, 1, (9, 5)), rng.uniform(0, 1, (60, 9))
    assert np.allclose(unmix.fcls_rows(e, y), [unmix.fcls(e, r)[0] for r in y], atol=1e-6)
    rows = [(i, i % 5, (rng.normal(size=8) * 0.1 + 3 * np.eye(8)[i % 5]).tolist()) for i in range(100)]
    spark.createDataFrame(rows, "vec_id bigint, label int, embedding array<float>").write.parquet(str(tmp_path / "embeddings.parquet"))
    assert [r["cls"] for r in model_queries.library_search(spark, str(tmp_path)).orderBy("cls").collect()] == list("01234")
