"""Row and group filters."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reedbed.functions.indices import EPS
from reedbed.functions.labels import CLASSES
from reedbed.functions.numeric import ratio
from reedbed.operators.ranks import group_percentiles
from reedbed.session import materialise

FIRST_SEASON = 1986
TRAINING_SEASONS = (2023, 2024)
MAD_SCALE, MAD_LIMIT = 1.4826, 3.5
NDDI_MAX = 0.28


def first_season(py: Column, year: int = FIRST_SEASON) -> Column:
    """From the first season on; rows without a season are kept."""
    return py.isNull() | (py >= year)


def not_dusty(limit: float = NDDI_MAX) -> Column:
    """NDDI at most the limit; a missing index does not pass."""
    red, nir = F.col("red"), F.col("nir")
    return F.coalesce(ratio(red - nir, red + nir + EPS) <= limit, F.lit(False))


def known_class(df: DataFrame, column: str = "veg") -> DataFrame:
    return df.where(F.lower(column).isin(*CLASSES))


def skip_classes(df: DataFrame, excluded: tuple[str, ...] = (), variants: bool = True, column: str = "veg") -> DataFrame:
    """Without the excluded classes and, with ``variants``, without rows of single variants (class_opt_1, ...); rows without a label are kept."""
    patterns = [f"^{re.escape(e.lower())}$" for e in excluded] + ["_opt_[0-9]+$"] * variants
    out = F.lower(F.trim(column)).rlike("|".join(patterns)) if patterns else F.lit(False)
    return df.where(F.coalesce(~out, F.lit(True)))


def valid_class(df: DataFrame, column: str = "veg", exclude_barren: bool = False) -> DataFrame:
    """Label not null, blank or NA; without bare ground on request."""
    kept = df.where((F.trim(column) != "") & (F.upper(F.trim(column)) != "NA"))
    return kept.where(F.lower(column) != "barren") if exclude_barren else kept


def not_barren(df: DataFrame, column: str = "veg") -> DataFrame:
    """Without bare ground; rows without a label are kept."""
    return df.where(F.col(column).isNull() | (F.lower(column) != "barren"))


def training_seasons(df: DataFrame, column: str = "py", seasons: tuple[int, ...] = TRAINING_SEASONS) -> DataFrame:
    return df.where(F.col(column).isin(*seasons))


def in_months(months: tuple[int, ...]) -> Column:
    return F.month("date").isin(*months)


def with_summer(df: DataFrame, keys: list[str], months: tuple[int, ...], at_least: int) -> DataFrame:
    """Groups with enough readings in the given months."""
    enough = df.where(in_months(months)).groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= at_least)
    return df.join(enough.select(*keys), keys, "left_semi")


def at_least(df: DataFrame, keys: list[str], n: int) -> DataFrame:
    """Rows of groups of at least n: by a count joined back, so that a large group is not gathered in one task's window."""
    return df.join(df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= n).select(*keys), keys, "left_semi")


def drop_without_baseline(df: DataFrame, key: str, value: Column, n: int) -> DataFrame:
    """Without the locations that have fewer than n values."""
    poor = df.groupBy(key).agg(F.count(value).alias("_n")).where(F.col("_n") < n).select(key)
    return df.join(poor, key, "left_anti")


def any_present(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.where(F.coalesce(*columns).isNotNull())


def capped_locations(df: DataFrame, key: str, number: Column, cap: int, seed: int = 42) -> DataFrame:
    """Rows of ``cap`` locations chosen by seeded arithmetic on ``number``."""
    chosen = df.select(key, ((number * 7919 + seed) % 10007).alias("_o")).distinct().orderBy("_o", key).limit(cap)
    return df.join(F.broadcast(chosen.select(key)), key, "left_semi")


def barren_similarity(df: DataFrame, columns: list[str], label: str = "veg") -> DataFrame:
    """Adds similarity: cosine between a row and the mean row of bare ground; null if a column is null."""
    mean = df.where(F.col(label) == "barren").agg(*[F.avg(c).alias(f"_m_{c}") for c in columns])
    dot = sum((F.col(c) * F.col(f"_m_{c}") for c in columns[1:]), F.col(columns[0]) * F.col(f"_m_{columns[0]}"))
    norm = lambda names: F.sqrt(sum((F.col(c) * F.col(c) for c in names[1:]), F.col(names[0]) * F.col(names[0])))
    joined = df.crossJoin(F.broadcast(mean))  # one row
    return joined.withColumn("similarity", ratio(dot, norm(columns) * norm([f"_m_{c}" for c in columns]))).drop(*[f"_m_{c}" for c in columns])


def without_mad_outliers(df: DataFrame, keys: list[str], columns: list[str], limit: float = MAD_LIMIT, group_min: int = 5, value_min: int = 3) -> DataFrame:
    """Rows of groups of at least group_min, without those that lie off a column's group median by more than limit scaled MADs."""
    df = materialise(df, "readings")
    counts = df.groupBy(*keys).agg(*[F.count(c).alias(f"_n_{c}") for c in columns], F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= group_min)
    medians = group_percentiles(df, keys, {f"_m_{c}": c for c in columns}, [0.5])
    near = df.join(counts, keys).join(medians, keys)
    mads = group_percentiles(near, keys, {f"_d_{c}": F.abs(F.col(c) - F.col(f"_m_{c}")) for c in columns}, [0.5])
    out = F.lit(False)
    for c in columns:
        far = (F.col(f"_n_{c}") >= value_min) & (F.abs(F.col(c) - F.col(f"_m_{c}")) > limit * MAD_SCALE * F.col(f"_d_{c}"))
        out = out | F.coalesce(far, F.lit(False))
    return near.join(mads, keys).where(~out).select(*df.columns)


def penalised_spline(x: np.ndarray, y: np.ndarray, df: float) -> np.ndarray:
    """Fitted values of a cubic spline in a truncated power basis, its ridge penalty chosen so that the trace of the hat matrix is df."""
    order = np.unique(x)
    t = (x - order[0]) / max(order[-1] - order[0], 1e-9)
    knots = np.quantile((order - order[0]) / max(order[-1] - order[0], 1e-9), np.linspace(0, 1, min(len(order), 12) + 2)[1:-1])
    basis = np.column_stack([np.ones_like(t), t, t**2, t**3, *[np.clip(t - k, 0, None) ** 3 for k in knots]])
    q, s, vt = np.linalg.svd(basis, full_matrices=False)
    keep = s > 1e-10 * s[0]
    penalty = np.diag([0.0] * 4 + [1.0] * len(knots))
    w = vt[keep] / s[keep, None]
    d, u = np.linalg.eigh(w @ penalty @ w.T)
    d = np.clip(d, 0, None)
    lo, hi = -12.0, 12.0
    for _ in range(50):  # trace falls as the penalty rises
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if (1 / (1 + 10**mid * d)).sum() > df else (lo, mid)
    z = q[:, keep] @ u
    return z @ ((z.T @ y) / (1 + 10**lo * d))


def spline_outlier_mask(day: np.ndarray, value: np.ndarray, limit: float = MAD_LIMIT, max_df: int = 10) -> np.ndarray:
    """Values off a smooth seasonal curve by more than ``limit`` MADs of its residuals, after one refit without gross ones."""
    out = np.zeros(len(value), dtype=bool)
    ok = np.isfinite(value) & np.isfinite(day)
    if ok.sum() < 5 or len(np.unique(day[ok])) < 4:
        return out
    x, y = day[ok], value[ok]
    df = min(max_df, len(y) / 2, len(np.unique(x)) - 1)
    centre_scale = lambda r: (np.median(r), 1.4826 * np.median(np.abs(r - np.median(r))))
    res = y - penalised_spline(x, y, df)
    med, mad = centre_scale(res)
    if mad <= 1e-6:
        return out
    good = np.abs(res - med) <= 1.5 * limit * mad
    if good.sum() >= 5 and not good.all() and len(np.unique(x[good])) >= 4:
        curve = penalised_spline(x[good], y[good], min(df, len(np.unique(x[good])) - 1))
        res = y - np.interp(x, *(np.array(sorted(dict(zip(x[good], curve, strict=True)).items())).T))
        med, mad = centre_scale(res[good])
        if mad <= 1e-6:
            return out
    out[np.flatnonzero(ok)[np.abs(res - med) > limit * mad]] = True
    return out


def without_spline_outliers(df: DataFrame, keys: list[str], row_id: str, day: str, columns: list[str], group_min: int = 5, spline_min: int = 10) -> DataFrame:
    """Rows of groups of at least group_min, without those off the seasonal spline of a column (groups of at least spline_min).

    A group is one location in one season, so it stays small whatever the table; rows of a group are judged together.
    """

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        if len(pdf) < group_min:
            return pdf.iloc[:0]
        if len(pdf) < spline_min:
            return pdf
        out = np.zeros(len(pdf), dtype=bool)
        for c in columns:
            out |= spline_outlier_mask(pdf[day].to_numpy(float), pdf[c].to_numpy(float))
        return pdf[~out]

    return df.groupBy(*keys).applyInPandas(work, df.schema)


def robust_pair_mask(df: DataFrame, group: list[str], x: str, y: str, limit: float = 4.0, enough: int = 10) -> DataFrame:
    """Pairs whose x, y and y - x lie within limit (unscaled) MADs of their group medians; a group with fewer than ``enough`` pairs keeps all."""
    pairs = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).withColumn("_d", F.col(y) - F.col(x))
    parts = [x, y, "_d"]
    with_ = lambda left, right: left.join(right, group) if group else left.crossJoin(F.broadcast(right))  # noqa: E731  # no group: one row
    pairs = materialise(pairs, "pairs")
    near = with_(with_(pairs, group_percentiles(pairs, group, {f"_m{i}": c for i, c in enumerate(parts)}, [0.5])), pairs.groupBy(*group).agg(F.count(F.lit(1)).alias("_n")))
    mad = group_percentiles(near, group, {f"_s{i}": F.abs(F.col(c) - F.col(f"_m{i}")) for i, c in enumerate(parts)}, [0.5])
    ok = F.lit(True)
    for i, c in enumerate(parts):
        ok = ok & (F.abs(F.col(c) - F.col(f"_m{i}")) <= limit * F.col(f"_s{i}"))
    return with_(near, mad).where((F.col("_n") < enough) | ok).select(*df.columns)


