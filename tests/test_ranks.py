"""Percentiles by group: equal to numpy whatever the size of a group, the values and the keys."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from reedbed.operators import ranks
from reedbed.operators.ranks import group_percentiles


def _table(spark):
    rng = np.random.default_rng(0)
    rows = [("big", 1, float(v), float(w)) for v, w in zip(rng.lognormal(0, 6, 3000), rng.integers(0, 4, 3000), strict=True)]
    rows += [(None, None, float(v), None) for v in rng.normal(size=900)] + [("same", 2, 5.0, 5.0)] * 700 + [("small", 3, float(v), float("nan")) for v in range(9)] + [("empty", 4, None, None)]
    rows += [("big", 1, 1e300, -1e300), ("big", 1, float("inf"), 2.0)]
    return rows, spark.createDataFrame(rows, "k string, j int, v double, w double")


@pytest.mark.parametrize(("limit", "short"), [(40, True), (1000, True), (40, False), (10**9, True)])
def test_equals_numpy(spark, monkeypatch, limit, short):
    rows, df = _table(spark)
    monkeypatch.setattr(ranks, "BUCKETS", 16)
    if not short:
        monkeypatch.setattr(ranks, "is_short", lambda d: False)
    shares = [0.0, 0.1, 0.5, 0.977, 1.0]
    got = {r["k"]: r for r in group_percentiles(df, ["k", "j"], {"v": "v", "twice": F.col("w") * 2}, shares, also={"n": F.count(F.lit(1))}, limit=limit).collect()}
    assert set(got) == {"big", None, "same", "small", "empty"}
    for key, r in got.items():
        own = [x for x in rows if x[0] == key]
        assert r["n"] == len(own)
        for name, values in (("v", [x[2] for x in own]), ("twice", [None if x[3] is None else 2 * x[3] for x in own])):
            values = np.minimum([x for x in values if x is not None and x == x], 1.7e308)
            seen = [r[f"{name}_{i}"] for i in range(len(shares))]
            assert seen == [None] * 5 if not len(values) else np.allclose(seen, np.quantile(values, shares), rtol=1e-12)


def test_whole_table_and_empty(spark):
    _, df = _table(spark)
    whole = df.where("v < 1e299")
    got = group_percentiles(whole, [], {"v": "v"}, [0.5], limit=100).collect()
    assert len(got) == 1 and got[0]["v"] == pytest.approx(np.median([r["v"] for r in whole.collect()]))
    assert [tuple(r) for r in group_percentiles(df.where("false"), [], {"v": "v"}, [0.5]).collect()] == [(None,)]
    assert group_percentiles(df.where("false"), ["k"], {"v": "v"}, [0.5], also={"n": F.count(F.lit(1))}).count() == 0
