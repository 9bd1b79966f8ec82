"""Fit of class fractions: planted mixtures, model search against all combinations, stored models, noisy repeats."""

import json
from itertools import product

import numpy as np
import pytest
from pyspark.sql import functions as F

from reedbed.functions.labels import CLASSES
from reedbed.operators import pipeline, unmix

SCHEMA = "obs_id bigint, location_id string, py int, bin int, veg string, a double, b double"


def _courses():
    day = np.arange(1, 37)
    return {
        "barren": (0.20 + 0 * day, 0.30 + 0 * day),
        "herbs": (0.2 + 0.5 * np.exp(-((day - 8) ** 2) / 30), 0.3 - 0.2 * np.exp(-((day - 8) ** 2) / 30)),
        "populus": (0.2 + 0.5 * np.exp(-((day - 16) ** 2) / 60), 0.3 + 0.2 * np.exp(-((day - 16) ** 2) / 60)),
        "tamarix": (0.2 + 0.5 * np.exp(-((day - 26) ** 2) / 40), 0.3 - 0.2 * np.exp(-((day - 26) ** 2) / 40)),
    }


def _table(spark, noise=0.004):
    """Twelve pure seasons of each class, and mixtures of bare ground with one class."""
    rng, c, rows, truth = np.random.default_rng(3), _courses(), [], {}
    plan = [(f"{k}{i}", {k: 1.0}, k) for k in CLASSES for i in range(12)]
    plan += [(f"mix{k}{i}", {k: w, "barren": 1 - w}, None) for k in CLASSES[1:] for i, w in enumerate((0.2, 0.4, 0.6, 0.8))]
    for name, mix, veg in plan:
        truth[name] = mix
        course = [sum(w * c[k][j] for k, w in mix.items()) for j in (0, 1)]
        for b in range(36):
            rows.append((len(rows), name, 2020, b + 1, veg, *(float(x[b] + rng.normal(0, noise)) for x in course)))
    return spark.createDataFrame(rows, SCHEMA), truth


def test_planted_mixtures_come_back(spark):
    df, truth = _table(spark)
    for project in (True, False):
        model = pipeline.fit_fractions(df, ["a", "b"], project=project)
        got = model.fractions(pipeline.season_vectors(df, ["a", "b"])).toPandas()
        wide = got.pivot_table(index="location_id", columns="cls", values="coef", aggfunc="sum")
        assert len(wide) == len(truth) and np.allclose(wide.sum(axis=1), 1)
        error = [abs(wide.loc[n, k] - mix.get(k, 0.0)) for n, mix in truth.items() for k in CLASSES]
        # A unit vector is no longer linear in the shares: mixtures of courses of unequal length are moved a little.
        assert np.mean(error) < 0.05 and np.median(error) < 0.02
        norms = [np.linalg.norm(v) for _, _, v in model.library]
        seen = model.represent(pipeline.season_vectors(df, ["a", "b"])).select("x").toPandas()["x"].map(np.linalg.norm)
        assert seen.min() > 0.2 * min(norms) and seen.max() < 5 * max(norms)  # both sides on one scale
    again = pipeline.FractionModel.from_params(json.loads(json.dumps(model.params())))
    other = again.fractions(pipeline.season_vectors(df, ["a", "b"])).toPandas().sort_values(["location_id", "cls"]).coef
    assert np.allclose(other, got.sort_values(["location_id", "cls"]).coef)
    assert model.prototypes(spark).count() == 4 * 72
    with pytest.raises(ValueError):
        pipeline.fit_fractions(df.where("location_id like 'herbs%' and obs_id < 0"), ["a", "b"])


def test_held_out_residuals_and_gaps(spark):
    df, _ = _table(spark, 0.03)
    model = pipeline.fit_fractions(df, ["a", "b"], k_max=2)
    labels = df.where("veg is not null").select("location_id", "py", F.col("veg").alias("cls")).distinct()
    oob = pipeline.held_out_residuals(model, pipeline.season_vectors(df, ["a", "b"]), labels, bound=5)
    assert set(oob) == set(CLASSES) and all(r.shape == (5, 4) and np.allclose(r.sum(axis=1), 0) for r in oob.values())
    got = model.fractions(pipeline.season_vectors(df.where("bin % 3 > 0"), ["a", "b"], interpolate=False), draws=20, bundles=True, oob=oob).toPandas()
    assert np.isfinite(got[["coef", "sd", "low", "high"]].to_numpy()).all() and (got.low <= got.high + 1e-12).all() and np.allclose(got.groupby("location_id").coef.sum(), 1)


def _slow_search(y, library, active):
    by = {}
    for i, (c, _, _) in enumerate(library):
        by.setdefault(c, []).append(i)
    best = np.inf
    for subset in unmix.class_subsets(list(by), active):
        for model in product(*[by[c] for c in subset]):
            x, rmse = unmix.fcls(np.column_stack([library[i][2] for i in model]), y)
            best = min(best, rmse + unmix.SPARSE_PENALTY * max(0, int((x > 1e-6).sum()) - 2))
    return best


def test_search_equals_all_combinations(monkeypatch):
    rng = np.random.default_rng(1)
    library = [(c, f"{c}{i}", rng.normal(size=6)) for c in CLASSES for i in range(3)]
    y = rng.normal(size=(15, 6))
    y[3, 2] = np.nan
    x, rmse, member = unmix.search_models(y, library, None, "fcls", active=2)
    score = rmse + unmix.SPARSE_PENALTY * np.maximum(0, (x > 1e-6).sum(axis=1) - 2)
    assert np.allclose(score, [_slow_search(r, library, 2) for r in y], atol=1e-9) and (x[~member] == 0).all()


def test_descent_reaches_variants_beyond_the_coarse_grid(monkeypatch):
    """A variant that is least similar by cosine but fits exactly in a mixture is found although the grid stops at three."""
    rng = np.random.default_rng(5)
    library = [(c, f"{c}{i}", rng.normal(size=8)) for c in CLASSES[:3] for i in range(8)]
    y = np.stack([0.5 * library[i][2] + 0.5 * library[8 + j][2] for i in range(8) for j in range(8)])
    whole = unmix.search_models(y, library, None, "fcls", active=1)[1]
    monkeypatch.setattr(unmix, "COMBINATIONS_MAX", 10)
    x, rmse, _ = unmix.search_models(y, library, None, "fcls", active=1)
    assert (rmse < 1e-3).mean() > 0.9 and (whole < 1e-3).all()
    at = x.argmax(axis=1)
    assert len({library[i][1] for i in at}) > 6


def test_weights_missing_and_solvers():
    rng = np.random.default_rng(2)
    e, w = rng.uniform(0, 1, (9, 3)), rng.uniform(0.2, 2, 9)
    y = rng.uniform(0, 1, (40, 9))
    y[rng.random(y.shape) < 0.15] = np.nan
    x, rmse = unmix.solve_rows(e, y, w)
    for r, z, s in zip(y, x, rmse, strict=True):
        ok = np.isfinite(r)
        a, b = np.where(ok[:, None], e, 0) * w[:, None], np.where(ok, r, 0) * w
        delta = 100 * np.sqrt((a**2).mean())
        want = unmix.nnls(np.vstack([a, np.full(3, delta)]), np.append(b, delta))
        assert np.allclose(z, want / want.sum(), atol=1e-6) and s == pytest.approx(np.sqrt(((r - e @ z)[ok] ** 2).mean()))
    stacked, _ = unmix.solve_rows(np.broadcast_to(e, (40, 9, 3)), y, w)
    assert np.allclose(stacked, x, atol=1e-8)
    for solver in unmix.SOLVERS:
        z, r, _ = unmix.search_models(y, [(c, c, v) for c, v in zip(CLASSES, e.T, strict=False)], w, solver)
        assert np.allclose(z.sum(axis=1), 1) and np.isfinite(r).all()


def test_unmix_skips_bad_rows_and_keeps_all_classes(spark):
    rng = np.random.default_rng(2)
    lib = [(c, f"{c}1", rng.uniform(0, 1, 8)) for c in CLASSES]
    rows = [(1, (0.5 * lib[0][2] + 0.5 * lib[1][2]).tolist()), (2, [0.1] * 7), (3, None), (4, [0.0] * 8), (5, [float("nan")] * 8), (1, (0.5 * lib[0][2] + 0.5 * lib[1][2]).tolist())]
    got = unmix.unmix(spark.createDataFrame(rows, "k int, x array<double>"), lib, "k int", solver="sparse").toPandas()
    assert set(got.k) == {1} and len(got) == 8 and got[got.cls == "populus"].variant_id.isna().all() and (got[got.cls == "populus"].coef == 0).all()
    assert unmix.unmix(spark.createDataFrame([], "k int, x array<double>"), lib, "k int").count() == 0
