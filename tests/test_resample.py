"""Bootstrap: draws are Poisson numbers, independent between keys and replicates; spreads are those of real resampling."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from reedbed.operators import resample


def test_draws_vary_like_poisson_numbers(spark):
    reps = 200
    df = spark.range(2000).select(F.concat(F.lit("L_"), F.col("id")).alias("k"), F.explode(F.sequence(F.lit(1), F.lit(reps))).alias("r"))
    w = df.select("k", "r", resample.draw_weight(F.col("k"), F.col("r")).alias("w")).toPandas().pivot(index="k", columns="r", values="w").to_numpy()
    assert w.mean() == pytest.approx(1, abs=0.01) and w.var() == pytest.approx(1, abs=0.02)
    assert w.sum(axis=0).std() == pytest.approx(np.sqrt(2000), rel=0.2)  # totals of replicates
    assert abs(np.corrcoef(w.T[:40]) - np.eye(40)).max() < 0.12 and abs(np.corrcoef(w[:40]) - np.eye(40)).max() < 0.4
    trend = np.arange(2000) / 2000
    assert ((w * trend[:, None]).sum(axis=0) / w.sum(axis=0)).std() == pytest.approx(trend.std() / np.sqrt(2000), rel=0.2)


def test_hashed_numbers_in_numpy():
    h = np.random.default_rng(0).integers(-(2**63), 2**63 - 1, 3000)
    w = resample.hashed_draws(h, 400)
    assert w.shape == (3000, 400) and w.mean() == pytest.approx(1, abs=0.01) and w.var() == pytest.approx(1, abs=0.02)
    assert abs(np.corrcoef(w[:, :40].T.astype(float)) - np.eye(40)).max() < 0.1
    assert np.array_equal(resample.hashed_draws(h[5:6], 400)[0], w[5])  # of the row alone
    ends = np.arange(0, 2000, 2000 // 41)
    near = resample.hashed_draws(np.arange(len(ends)), 400).astype(float)  # neighbouring hashes
    assert abs(np.corrcoef(near) - np.eye(len(ends))).max() < 0.3


def test_resampled_sums_small_and_large():
    rng = np.random.default_rng(1)
    sizes = [1, 2, 20, 500, 9000]
    value = rng.normal(size=sum(sizes))
    start = np.cumsum([0, *sizes[:-1]])
    total, number = resample.resampled_sums(value, start, rng.integers(0, 2**62, len(value)), rng.integers(0, 2**62, 5), 600)
    assert (number[:3] == np.array(sizes[:3])[:, None]).all() and (total[0] == value[0]).all()
    for g, n in enumerate(sizes):
        means, own = total[g] / number[g], value[start[g] : start[g] + n]
        assert means.mean() == pytest.approx(own.mean(), abs=5 * own.std() / np.sqrt(n * 600) + 1e-12)
        assert means.std() == pytest.approx(own.std() / np.sqrt(n), rel=0.15, abs=1e-12)


def _skewed(spark, locations=60, rows=25):
    rng = np.random.default_rng(2)
    level = rng.normal(0, 1, locations)
    data = [(i * rows + j, f"L{i}", "a", float(level[i] + rng.exponential())) for i in range(locations) for j in range(rows if i else 40 * rows)]
    return data, spark.createDataFrame([(k, *r[1:]) for k, r in enumerate(data)], "rid bigint, location_id string, veg string, v double")


def test_hierarchical_spread_equals_simulation(spark, monkeypatch):
    data, df = _skewed(spark)
    got = resample.hierarchical_bootstrap(df, ["veg"], "location_id", "v", "rid", 800).first()
    values = {}
    for _, k, _, v in data:
        values.setdefault(k, []).append(v)
    groups, rng = [np.array(v) for v in values.values()], np.random.default_rng(3)
    real = [np.mean([rng.choice(groups[i], len(groups[i])).mean() for i in rng.integers(0, len(groups), len(groups))]) for _ in range(800)]
    assert got["mean"] == pytest.approx(np.mean(real), abs=0.03) and got["sd"] == pytest.approx(np.std(real), rel=0.15) and got["n"] == 800
    monkeypatch.setattr(resample, "ROWS_PER_TASK", 300)  # the long location is resampled in several tasks
    split = resample.hierarchical_bootstrap(df, ["veg"], "location_id", "v", "rid", 800).first()
    assert split["mean"] == pytest.approx(got["mean"], abs=1e-6) and split["sd"] == pytest.approx(got["sd"], abs=1e-6)
    assert resample.hierarchical_bootstrap(df.where("false"), ["veg"], "location_id", "v", "rid", 50).count() == 0
    order = sorted(values, key=lambda k: np.mean(values[k]))  # blocks of locations on one level
    blocks = spark.createDataFrame([(k, f"b{i // 12}") for i, k in enumerate(order)], "location_id string, block string")
    wide = resample.hierarchical_bootstrap(df.join(blocks, "location_id"), ["veg"], "location_id", "v", "rid", 400, drawn="block").first()
    assert wide["sd"] > got["sd"]  # few blocks, drawn whole, vary more


def test_medians(spark):
    rng = np.random.default_rng(4)
    rows = [("a", 2000, float(v)) for v in rng.normal(size=15)] + [("b", 2000, 1.0), ("b", 2000, 3.0), ("c", None, None)]
    got = {r["k"]: r for r in resample.median_bootstrap(spark.createDataFrame(rows, "k string, y int, v double"), ["k", "y"], "v", 300).collect()}
    own = np.array([v for k, _, v in rows if k == "a"])
    real = np.median(rng.choice(own, (4000, 15)), axis=1)
    assert np.std(got["a"]["medians"]) == pytest.approx(real.std(), rel=0.2) and set(got["b"]["medians"]) == {2.0} and got["c"]["n"] == 0


def test_aggregate_bootstrap_small_groups_widen_with_correlation(spark):
    rng = np.random.default_rng(5)
    rows = [(f"L{i}", "herbs", 2000 + y, float(v)) for y in range(4) for i, v in enumerate(rng.uniform(0, 1, 6))] + [(f"L{i}", "herbs", 2010, float(v)) for i, v in enumerate(rng.exponential(0.2, 300))]
    df = spark.createDataFrame(rows, "location_id string, veg string, py int, coef double")
    near = spark.createDataFrame([(f"L{i}", 36 + i * 1e-5, 73.0) for i in range(300)], "location_id string, lat double, lon double")
    tight, loose = (resample.aggregate_bootstrap(df, "coef", near, km, 400).toPandas().set_index("py") for km in (50.0, 1e-7))
    assert tight.loc[2000, "n_eff"] == pytest.approx(1, abs=0.01) and loose.loc[2000, "n_eff"] == pytest.approx(6, abs=0.01) and tight.loc[2000, "se"] > 2 * loose.loc[2000, "se"]
    own = np.array([r[3] for r in rows if r[2] == 2010])
    assert tight.loc[2010, "se"] == pytest.approx(own.std() / np.sqrt(300), rel=0.2) and (tight.coef_025 >= 0).all() and (tight.coef_975 <= 1).all() and tight.n_locations.sort_index().tolist() == [6] * 4 + [300]
