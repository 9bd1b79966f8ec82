"""SQL functions, sampling, cover models, skipped classes."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from reedbed.functions import registry
from reedbed.functions.numeric import cover_of
from reedbed.operators import filters, relational, stats, unmix


def test_registered_functions(spark):
    names = registry.register(spark)
    assert set(names) == {"fcls", "nnls", "whittaker", "spline", "student_t_p", "bootstrap_ci"}
    row = spark.sql("""SELECT fcls(array(0.5D, 0.5D), array(array(1D, 0D), array(0D, 1D))) AS f, nnls(array(array(1D, 0D), array(0D, 1D)), array(2D, -1D)) AS n, whittaker(array(1D, NULL, 3D, 4D), 10D) AS w,
        student_t_p(2.228139D, 10D) AS p, fcls(CAST(NULL AS array<double>), array(array(1D))) AS none, bootstrap_ci(transform(sequence(1, 100), x -> double(x)), 500, 1) AS b,
        spline(array(1D, 2D, 3D, 4D, 5D, 6D), array(1D, 2D, 3D, 4D, 5D, 6D), 4D) AS s""").first()
    assert np.allclose(row["f"], [0.5, 0.5], atol=1e-3) and np.allclose(row["n"], [2, 0]) and row["none"] is None and row["p"] == pytest.approx(0.05, abs=1e-6)
    assert np.allclose(row["w"], stats.whittaker(np.array([1, np.nan, 3, 4.0]), 10.0)) and np.allclose(row["s"], range(1, 7), atol=0.01)
    assert row["b"][0] == pytest.approx(50.5, abs=1) and row["b"][1] == pytest.approx(2.9, rel=0.15) and row["b"][2] < row["b"][0] < row["b"][3]
    assert np.allclose(unmix.fcls(np.eye(2), np.array([0.5, 0.5]))[0], 0.5, atol=1e-3)


def test_sample_is_exact_and_seeded(spark):
    df = spark.range(5000).select(F.concat(F.lit("k"), "id").alias("k"), F.when(F.col("id") % 5 > 0, "many").otherwise("few").alias("g"), "id")
    got = relational.sample_by(df, ["g"], "k", 1500).toPandas()
    assert got.groupby("g").id.count().to_dict() == {"few": 1000, "many": 1500} and got.k.is_unique
    u = df.select("k", "g", relational.uniform(F.col("k"), F.lit(0)).alias("u")).toPandas()
    want = u[u.g == "many"].sort_values(["u", "k"]).k.head(1500)
    assert set(got[got.g == "many"].k) == set(want)
    assert relational.sample_by(df.where("false"), ["g"], "k", 10).count() == 0


def test_cover_and_skipped_classes(spark):
    df = spark.createDataFrame([(0.5,), (2.0,), (None,), (-0.9,)], "x double")
    got = [tuple(r) for r in df.select(cover_of(F.col("x"), 0.5, 0.1), cover_of(F.col("x"), 1.0, 0.0, 0.1, 0.9), cover_of(F.col("x"), None, 0.1)).collect()]
    assert got[0] == (pytest.approx(0.35), pytest.approx(0.6 / 1.4), None) and got[1][0] == 1.0 and got[2] == (None, None, None) and got[3] == (0.0, None, None)
    labels = spark.createDataFrame([(v,) for v in ("herbs", "Herbs_opt_2", None, "barren ", "populus")], "veg string")
    assert [r[0] for r in filters.skip_classes(labels, ("Barren",)).collect()] == ["herbs", None, "populus"]
    assert filters.skip_classes(labels, variants=False).count() == 5


def test_scratch_tables_can_be_released(spark):
    from reedbed import session

    session.release(spark)
    kept = [session.materialise(spark.range(10), "a"), session.materialise(spark.range(5), "b")]
    assert [d.count() for d in kept] == [10, 5] and session.release(spark) == 2 and session.release(spark) == 0
    with pytest.raises(Exception):  # noqa: B017
        session.materialise(spark.range(3), "c").unionByName(kept[0]).count()
