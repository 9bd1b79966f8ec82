"""Traces as vectors: one vector of bins x indices for each location and season; scaling, templates, feature weights."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reedbed.functions.numeric import ratio
from reedbed.operators.ranks import group_percentiles


def trace_vectors(filled: DataFrame, last_bin: int = 36) -> DataFrame:
    """location_id, py, x: values in the order of index name and bin; a vector has a fixed length."""
    return filled.groupBy("location_id", "py").agg(F.transform(F.array_sort(F.collect_list(F.struct("index_name", "bin", "value"))), lambda s: s["value"]).alias("x"))


def norm(x: Column) -> Column:
    return F.sqrt(F.aggregate(x, F.lit(0.0), lambda a, v: a + F.coalesce(F.when(~F.isnan(v), v), F.lit(0.0)) ** 2))


def dot(a: Column, b: Column) -> Column:
    """Sum of products over the shorter of both; missing values count as 0."""
    clean = lambda v: F.coalesce(F.when(~F.isnan(v), v), F.lit(0.0))
    return F.aggregate(F.zip_with(a, b, lambda u, v: clean(u) * clean(v)), F.lit(0.0), lambda s, v: s + v)


def unit(x: Column) -> Column:
    """Divided by its length; unchanged if that is below 1e-9."""
    lengths = F.array_repeat(norm(x), F.size(x))  # the length is computed once, not for every feature
    return F.zip_with(x, lengths, lambda v, n: F.when(n < 1e-9, v).otherwise(v / n))


def cosine(a: Column, b: Column) -> Column:
    return ratio(dot(a, b), norm(a) * norm(b))


def index_scales(filled: DataFrame) -> DataFrame:
    """index_name, mean, sd over all bins of all traces; a missing or zero sd counts as 1."""
    sd = F.stddev_samp("value")
    return filled.groupBy("index_name").agg(F.avg("value").alias("mean"), F.when(F.coalesce(sd, F.lit(0.0)) == 0, 1.0).otherwise(F.greatest(sd, F.lit(1e-8))).alias("sd"))


def scaled(filled: DataFrame, scales: DataFrame) -> DataFrame:
    """value as a z-score of its index, missing as 0. There is one row of scales for each index."""
    joined = filled.join(F.broadcast(scales), "index_name")
    return joined.withColumn("value", F.coalesce((F.col("value") - F.col("mean")) / F.col("sd"), F.lit(0.0))).drop("mean", "sd")


def label_groups(df: DataFrame, label: str, place: str, at_least: int) -> DataFrame:
    """Adds part: label__place where that has at least ``at_least`` rows, else the label."""
    joined = F.concat_ws("__", label, place)
    counts = df.groupBy(label, place).agg(F.count(F.lit(1)).alias("_n"))
    return df.join(counts, [label, place], "left").withColumn("part", F.when(F.col("_n") >= at_least, joined).otherwise(F.col(label))).drop("_n")


def medoids(df: DataFrame, groups: list[str], key: str, x: str = "x") -> DataFrame:
    """groups, key, distance: the vector of each group nearest to its column medians; of equals the smallest key."""
    long = df.select(*groups, key, F.posexplode(x).alias("pos", "v"))
    med = group_percentiles(long, [*groups, "pos"], {"m": "v"}, [0.5])
    d = long.join(med, [*groups, "pos"]).groupBy(*groups, key).agg(F.sum(F.pow(F.coalesce(F.col("v"), F.col("m")) - F.col("m"), F.lit(2.0))).alias("distance"))
    return d.groupBy(*groups).agg(F.min(F.struct("distance", key)).alias("b")).select(*groups, f"b.{key}", "b.distance")


def class_templates(bins: DataFrame, columns: list[str]) -> DataFrame:
    """veg, bin, row_id: the standardised row nearest to the column medians of its class and bin. bins: veg, bin, row_id, columns."""
    med = group_percentiles(bins, ["veg", "bin"], {f"_m_{c}": c for c in columns}, [0.5])
    d = sum((F.pow(F.coalesce(F.col(c) - F.col(f"_m_{c}"), F.lit(0.0)), F.lit(2.0)) for c in columns[1:]), F.pow(F.coalesce(F.col(columns[0]) - F.col(f"_m_{columns[0]}"), F.lit(0.0)), F.lit(2.0)))
    rows = bins.join(med, ["veg", "bin"]).withColumn("d", F.round(d + 1e-12, 9))
    return rows.groupBy("veg", "bin").agg(F.min(F.struct("d", "row_id")).alias("b")).select("veg", "bin", "b.row_id", F.col("b.d").alias("distance"))


def weight_summary(weights: DataFrame) -> DataFrame:
    """index_name, mean, max, rank of the feature weights."""
    g = weights.groupBy("index_name").agg(F.avg("weight").alias("mean"), F.max("weight").alias("max"))
    return g.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("mean"), "index_name")))  # one row an index


def pruned(x: Column, kept: list[int]) -> Column:
    """Features at the kept positions, in order."""
    keep = [False] * (max(kept, default=-1) + 1)
    for i in kept:
        keep[i] = True
    return F.filter(x, lambda v, i: F.coalesce(F.get(F.lit(keep), i), F.lit(False)))


def trace_class(rows: DataFrame, keys: list[str], label: str = "veg") -> DataFrame:
    """keys, cls: the most frequent label of each trace, of equally frequent ones the first in order; traces without a label have no row."""
    counts = rows.where(F.col(label).isNotNull()).groupBy(*keys, F.col(label).alias("cls")).agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy(*keys).agg(F.min_by("cls", F.struct(-F.col("n"), F.col("cls"))).alias("cls"))


def gram_matrix(df: DataFrame, x: str, width: int) -> tuple[np.ndarray, int]:
    """X'X and the number of rows: partial sums in the tasks, one width x width matrix at the driver."""

    def sums(batches):
        total, n = np.zeros((width, width)), 0
        for pdf in batches:
            m = np.array(pdf[x].tolist(), dtype=float)
            if len(m):
                total += m.T @ m
                n += len(m)
        import pandas as pd

        yield pd.DataFrame({"row": range(width), "s": list(total), "n": [n] * width})

    parts = df.select(x).mapInPandas(sums, "row int, s array<double>, n bigint").select("row", "n", F.posexplode("s").alias("col", "s"))
    cells = parts.groupBy("row", "col").agg(F.sum("s").alias("s"), F.sum("n").alias("n")).collect()
    out, n = np.zeros((width, width)), 0
    for c in cells:
        out[c["row"], c["col"]], n = c["s"], c["n"]
    return out, n


def principal_axes(gram: np.ndarray, n: int, classes: int, smallest: int, share: float = 0.95) -> tuple[np.ndarray, np.ndarray]:
    """Axes (width x k) and singular values of the uncentred matrix, on features with a variance above 1e-9.

    k: first axis at which the cumulative variance passes ``share``, at most 20 and max(classes - 1, smallest - 2); fewer than classes - 1 is an error.
    """
    values, vectors = np.linalg.eigh(gram)
    order = np.argsort(values)[::-1]
    values, vectors = np.clip(values[order], 0, None), vectors[:, order]
    cum = np.cumsum(values) / max(values.sum(), 1e-30)
    k = int(np.searchsorted(cum, share, side="right")) + 1
    k = min(max(k, classes - 1), 20, max(classes - 1, smallest - 2), int((values > 1e-9).sum()))
    if k < classes - 1:
        raise ValueError("fewer principal axes than classes - 1")
    return vectors[:, :k], np.sqrt(values[:k] / max(n - 1, 1))


def discriminant_axes(scores: np.ndarray, labels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Linear discriminant axes of PCA scores and the share of the between-class variance on each; columns are dropped until it works."""
    classes = np.unique(labels)
    for k in range(scores.shape[1], 0, -1):
        x = scores[:, :k]
        means = np.stack([x[labels == c].mean(axis=0) for c in classes])
        inside = x - means[np.searchsorted(classes, labels)]
        within = inside.T @ inside / max(len(x) - len(classes), 1)
        values, vectors = np.linalg.eigh(within)
        if values[0] <= 1e-12 * max(values[-1], 1e-30):
            continue
        white = vectors / np.sqrt(values)
        prior = np.array([(labels == c).mean() for c in classes])
        between = np.sqrt(prior * len(x) / max(len(classes) - 1, 1))[:, None] * (means - prior @ means) @ white
        _, s, vt = np.linalg.svd(between, full_matrices=False)
        r = min(len(classes) - 1, int((s > 1e-8).sum()))
        axes = np.zeros((scores.shape[1], r))
        axes[:k] = white @ vt[:r].T
        return axes, s[:r] ** 2 / max((s[:r] ** 2).sum(), 1e-30)
    raise ValueError("no discriminant axes")


def feature_model(vectors: DataFrame, label: str, x: str = "x", bound: int = 20_000) -> dict:
    """PCA over all vectors, then LDA of their scores: basis (width x axes), weights of features and axes, centroids.

    The scores of at most ``bound`` labelled vectors (in hash order) go to the driver for the small dense problem; the Gram matrix covers all.
    """
    width = len(vectors.select(x).first()[x])
    gram, n = gram_matrix(vectors, x, width)
    rows = vectors.where(F.col(label).isNotNull()).orderBy(F.xxhash64(x)).limit(bound).select(label, x).toPandas()
    labels, m = rows[label].astype(str).to_numpy(), np.array(rows[x].tolist(), float)
    names, counts = np.unique(labels, return_counts=True)
    rotation, _ = principal_axes(gram, n, len(names), int(counts.min()))
    axes, share = discriminant_axes(m @ rotation, labels)
    basis = rotation @ axes
    scores = m @ basis
    return {"basis": basis, "axis_share": share, "weights": np.abs(basis) @ share, "centroids": {c: scores[labels == c].mean(axis=0) for c in names}}


def projected(df: DataFrame, basis: np.ndarray, x: str = "x") -> DataFrame:
    """Adds score: the vector on each axis."""
    return df.withColumn("score", F.array(*[dot(F.col(x), F.lit(basis[:, j].tolist())) for j in range(basis.shape[1])]))


def importance(basis: np.ndarray, names: list[str]) -> list[tuple[str, float]]:
    """Share of squared loadings that falls on each index."""
    square = (basis**2).sum(axis=1)
    total = {n: float(square[[i for i, m in enumerate(names) if m == n]].sum()) for n in dict.fromkeys(names)}
    return [(n, float(v / max(square.sum(), 1e-30))) for n, v in total.items()]
