"""Numeric kernels as SQL functions."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from reedbed.operators import filters, resample, stats, unmix


def _array(v) -> np.ndarray:
    return np.array([np.nan if u is None else u for u in v], dtype=float)


def register(spark: SparkSession) -> list[str]:
    """Registers the scalar kernels for SQL and gives their names. A null argument gives null; missing values within arrays are missing.

    fcls(y, endmembers): fractions; nnls(a, b): coefficients (a: array of rows); whittaker(y, lambda); spline(day, value, df): fitted values; student_t_p(t, df); bootstrap_ci(values, replicates, seed): array of mean, sd,
    2.5 and 97.5 percent of the bootstrapped means.
    """

    def rows(f):
        """f on each row whose arguments are all there."""
        return lambda *columns: pd.Series([None if any(v is None for v in row) else f(*row) for row in zip(*columns, strict=True)], dtype=object)

    def fractions(y, e):
        return unmix.fcls(np.column_stack([_array(v) for v in e]), _array(y))[0].tolist()

    def ends(values, replicates, seed):
        v = _array(values)
        v = v[np.isfinite(v)]
        if not len(v):
            return None
        total, n = resample.resampled_sums(v, np.array([0]), np.arange(len(v)) + np.int64(seed), np.array([int(seed)]), int(replicates))
        m = total[0][n[0] > 0] / n[0][n[0] > 0]
        return [float(m.mean()), float(m.std(ddof=1)), *np.quantile(m, [0.025, 0.975]).tolist()]

    kernels = {
        "fcls": (rows(fractions), "array<double>"),
        "nnls": (rows(lambda a, b: unmix.nnls(np.stack([_array(r) for r in a]), _array(b)).tolist()), "array<double>"),
        "whittaker": (rows(lambda y, lam: stats.whittaker(_array(y), float(lam)).tolist()), "array<double>"),
        "spline": (rows(lambda day, value, df: filters.penalised_spline(_array(day), _array(value), float(df)).tolist()), "array<double>"),
        "student_t_p": (lambda t, df: pd.Series(stats.student_t_p(t.to_numpy(float), df.to_numpy(float))), "double"),
        "bootstrap_ci": (rows(ends), "array<double>"),
    }
    for name, (f, kind) in kernels.items():
        arity = {"whittaker": 2, "fcls": 2, "nnls": 2, "student_t_p": 2}.get(name, 3)
        fixed = (lambda g: (lambda a, b: g(a, b)))(f) if arity == 2 else (lambda g: (lambda a, b, c: g(a, b, c)))(f)
        spark.udf.register(name, F.pandas_udf(fixed, kind, F.PandasUDFType.SCALAR))
    return list(kernels)
