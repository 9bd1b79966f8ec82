"""Filling missing values from similar records: low-rank alternating least squares over mixed encoded cells.

Every record is a row of encoded cells: its own numbers (standardised), its class (one cell a class), its season, and what the other records of its location, class and
season hold (means without the record itself, and how near its value lies to the mean of each class). Records x cells is factored as U V' over the present cells.
V has one short row for each kind of cell and is all that moves between the driver and the tasks; a record's row of U follows
from V and its own present cells. Missing cells are read from U V' and decoded to valid values: a number from 0 to 1, a class, a season of the range. A location has at most one record of a class and season,
so the decoded class or season is one that keeps this, if there is one.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reedbed.functions.labels import CLASSES, named_class
from reedbed.operators.skew import join_key_stats
from reedbed.session import materialise

FIRST_YEAR, LAST_YEAR = 1986, 2025
PLAIN = ("coef", "coef_median", "coef_025", "coef_975", "coef_sd", "rmse", "n_obs", "n_summer_obs", "year")
CONTEXT = ("class_mean", "season_sum", "season_n", "place_mean", "place_year", "year_mean")
CELLS = (*PLAIN, *(f"is_{c}" for c in CLASSES), *CONTEXT, *(f"like_{c}" for c in CLASSES))
RANK, RIDGE, SWEEPS, WEIGHT_MAX = 6, 0.05, 5, 30.0
#: Width of the nearness of a value to the mean of a class.
NEAR = 0.05
#: Patterns of present cells whose second moments go to the driver.
MAX_PATTERNS = 4096


def _rows(coefficient: DataFrame) -> DataFrame:
    """Each record once, with coef, cls and year null where missing and standardisable numbers elsewhere."""
    c = F.col
    number = lambda n: F.when(~F.isnan(c(n).cast("double")) & (F.abs(c(n).cast("double")) < 1e4), c(n).cast("double"))
    unit = lambda n: F.when((c(n) >= 0) & (c(n) <= 1), c(n))
    return coefficient.select(
        "coef_row_id",
        "location_id",
        unit("coef").alias("coef"),
        named_class(c("veg")).alias("cls"),
        F.when(c("pheno_year").between(FIRST_YEAR, LAST_YEAR), c("pheno_year")).cast("int").alias("year"),
        *[unit(n).alias(n) for n in ("coef_median", "coef_025", "coef_975", "coef_sd", "rmse")],
        *[number(n).alias(n) for n in ("n_obs", "n_summer_obs")],
    ).dropDuplicates()


def _with_context(rows: DataFrame) -> DataFrame:
    """Adds what the records of the location hold, of a fixed size: sums and numbers, by class as well, and the seasons of each class as bits; sums of its season; and the mean of class and season over all locations."""
    c = F.col
    bit = F.expr(f"shiftleft(1L, year - {FIRST_YEAR})")
    of = lambda cls: c("cls") == cls
    by_location = rows.where("location_id is not null").groupBy("location_id").agg(
        F.count(F.lit(1)).alias("l_n"), F.count("coef").alias("l_coef"), F.sum("coef").alias("l_sum"), F.count("cls").alias("l_veg"),
        F.count("year").alias("l_pheno_year"), F.sum("year").alias("l_years"), F.min("year").alias("l_first"), F.max("year").alias("l_last"),
        *[F.sum(F.when(of(k), c("coef"))).alias(f"s_{k}") for k in CLASSES],
        *[F.count(F.when(of(k), c("coef"))).alias(f"n_{k}") for k in CLASSES],
        *[F.bit_or(F.when(of(k), bit)).alias(f"y_{k}") for k in CLASSES],
    )
    by_season = rows.where("location_id is not null and year is not null").groupBy("location_id", "year").agg(F.count(F.lit(1)).alias("t_n"), F.count("coef").alias("t_held"), F.sum("coef").alias("t_sum"))
    by_year = rows.where("cls is not null and year is not null").groupBy("cls", "year").agg(F.avg("coef").alias("year_mean"))  # classes x seasons, 160 rows at most
    joined = join_key_stats(join_key_stats(rows, materialise(by_location, "places"), ["location_id"], "l_n"), materialise(by_season, "seasons"), ["location_id", "year"], "t_n")
    return joined.join(F.broadcast(by_year), ["cls", "year"], "left")


def _encoded(rows: DataFrame) -> DataFrame:
    """Cells as doubles x0, x1, ..., null where missing; gaps: seasons (bits) within the location's span in which the class has no record; free: classes (bits) that the season lacks."""
    names = [f"x{i}" for i in range(len(CELLS))]

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            col = {n: pdf[n].to_numpy(float) for n in pdf.columns if n not in ("coef_row_id", "location_id", "cls")}
            zero = lambda n: np.nan_to_num(col[n])
            coef, year, label = col["coef"], col["year"], pdf["cls"].to_numpy(object)
            here, mine, dated = (~np.isnan(coef)).astype(float), np.nan_to_num(coef), (~np.isnan(year)).astype(float)
            of = np.stack([label == k for k in CLASSES], axis=1)
            some = of.any(axis=1)

            def others(total: np.ndarray, n: np.ndarray, value: np.ndarray, own: np.ndarray) -> np.ndarray:
                """Mean without the record itself; NaN without another."""
                return np.where(n > own, (total - value) / np.where(n > own, n - own, 1.0), np.nan)

            mean = np.stack([others(zero(f"s_{k}"), zero(f"n_{k}"), np.where(of[:, i], mine, 0.0), np.where(of[:, i], here, 0.0)) for i, k in enumerate(CLASSES)], axis=1)
            seasons = np.stack([zero(f"y_{k}") for k in CLASSES], axis=1).astype(np.int64)  # 40 bits
            at = np.nan_to_num(year, nan=FIRST_YEAR).astype(np.int64) - FIRST_YEAR
            taken = (dated[:, None] > 0) & ((seasons >> at[:, None]) & 1 == 1)
            first, last = (np.nan_to_num(col[n], nan=FIRST_YEAR).astype(np.int64) - FIRST_YEAR for n in ("l_first", "l_last"))
            span = np.where(np.isnan(col["l_first"]), 0, (np.int64(2) << last) - (np.int64(1) << first))
            cells = [coef, *[col[n] for n in PLAIN[1:-1]], year, *[np.where(some, of[:, i], np.nan) for i in range(len(CLASSES))]]
            cells += [np.where(some, np.where(of, np.nan_to_num(mean), 0.0).sum(axis=1) + np.where((of & np.isnan(mean)).any(axis=1), np.nan, 0.0), np.nan)]
            cells += [np.where(np.isnan(col["t_n"]), np.nan, zero("t_sum") - mine), np.where(np.isnan(col["t_n"]), np.nan, col["t_held"] - here)]
            cells += [others(zero("l_sum"), zero("l_coef"), mine, here), others(zero("l_years"), zero("l_pheno_year"), np.nan_to_num(year), dated), col["year_mean"]]
            cells += [np.where(here > 0, np.exp(-(((coef - mean[:, i]) / NEAR) ** 2) / 2), np.nan) for i in range(len(CLASSES))]
            gaps = span & ~np.where(of, seasons, 0).sum(axis=1)
            out = pdf[["coef_row_id", "location_id", "coef", "cls", "year", "l_coef", "l_veg", "l_pheno_year"]].assign(**dict(zip(names, cells, strict=True)))
            out["gaps"] = pd.array(np.where(dated > 0, 0, gaps), dtype="Int64")
            out.loc[(dated > 0) | ~some | np.isnan(col["l_n"]), "gaps"] = pd.NA
            out["free"] = (~taken @ (1 << np.arange(len(CLASSES)))).astype("int32")
            yield out

    kinds = dict(rows.dtypes)
    kept = ", ".join(f"{n} {kinds[n]}" for n in ("coef_row_id", "location_id", "coef", "cls", "year", "l_coef", "l_veg", "l_pheno_year"))
    return rows.mapInPandas(work, f"{kept}, {', '.join(f'{n} double' for n in names)}, gaps bigint, free int")


def _open_years(gaps: np.ndarray) -> np.ndarray:
    """Seasons set in each bit field, as a matrix of booleans."""
    return (gaps[:, None] >> np.arange(LAST_YEAR - FIRST_YEAR + 1)) & 1 == 1


def _matrix(pdf: pd.DataFrame) -> np.ndarray:
    return np.column_stack([pdf[f"x{i}"].to_numpy(float) for i in range(len(CELLS))])


def _records(x: np.ndarray, v: np.ndarray, w: np.ndarray) -> np.ndarray:
    """U for given V and weights of the cells, one solve for each pattern of present cells."""
    here = ~np.isnan(x)
    code = here @ (1 << np.arange(x.shape[1], dtype=np.int64))
    u = np.zeros((len(x), v.shape[1]))
    for pattern in np.unique(code):
        rows = np.flatnonzero(code == pattern)
        on = here[rows[0]]
        vo = v[on]
        wo = w[on][:, None] * vo
        u[rows] = np.linalg.solve(vo.T @ wo + RIDGE * np.eye(v.shape[1]), wo.T @ x[rows][:, on].T).T
    return u


def _summed(inputs: DataFrame, part: Callable[[pd.DataFrame], np.ndarray]) -> np.ndarray | None:
    """Sum over all rows of an array computed from batches: partial sums in the tasks, a fixed number of values at the driver."""

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = None
        for pdf in batches:
            if len(pdf):
                s = part(pdf)
                total = s if total is None else total + s
        if total is not None:
            yield pd.DataFrame({"s": [total]})

    parts = inputs.mapInPandas(sums, "s array<double>").select(F.posexplode("s").alias("i", "s"))
    total = {r["i"]: r["s"] for r in parts.groupBy("i").agg(F.sum("s").alias("s")).collect()}
    return np.array([total[i] for i in range(len(total))]) if total else None


def _patterns(inputs: DataFrame, mean: np.ndarray, scale: np.ndarray) -> dict[int, tuple[int, np.ndarray]] | None:
    """Number of records and second moments (cells x cells) of each pattern of present cells; None if there are more than MAX_PATTERNS patterns."""
    width = len(CELLS)

    def moments(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[int, list] = {}
        for pdf in batches:
            x = (_matrix(pdf) - mean) / scale
            here = ~np.isnan(x)
            code, x = here @ (1 << np.arange(width, dtype=np.int64)), np.nan_to_num(x)
            kinds, which = np.unique(code, return_inverse=True)
            order = np.argsort(which, kind="stable")
            for kind, rows in zip(kinds.tolist(), np.split(order, np.cumsum(np.bincount(which))[:-1]), strict=True):
                own = held.setdefault(kind, [0, np.zeros((width, width))])
                own[0] += len(rows)
                own[1] += x[rows].T @ x[rows]
            if len(held) > 1000:
                yield pd.DataFrame([(k, n, m.ravel()) for k, (n, m) in held.items()], columns=["code", "n", "s"])
                held = {}
        yield pd.DataFrame([(k, n, m.ravel()) for k, (n, m) in held.items()], columns=["code", "n", "s"]).astype({"code": "int64", "n": "int64"})

    said = materialise(inputs.mapInPandas(moments, "code bigint, n bigint, s array<double>"), "moments")
    if said.select("code").distinct().limit(MAX_PATTERNS + 1).count() > MAX_PATTERNS:
        return None
    cells = said.select("code", "n", F.posexplode("s").alias("i", "v")).groupBy("code", "i").agg(F.sum("n").alias("n"), F.sum("v").alias("v"))
    whole = cells.groupBy("code").agg(F.max("n").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("i", "v"))), lambda c: c["v"]).alias("s"))
    return {r["code"]: (r["n"], np.array(r["s"]).reshape(width, width)) for r in whole.collect()}  # at most MAX_PATTERNS


def _fit(cells: DataFrame, sweeps: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Means, scales, V and the weights of the cells (inverse residual variances, so that a telling cell outweighs a noisy one).

    V starts from the leading axes of the pairwise-complete second moments. A record's row of U is a linear function of its present cells, the same for all records with the same pattern of them, so a sweep needs
    only the second moments of each pattern: the table is read once for these. If there are too many patterns, every sweep reads the table and sums in the tasks.
    """
    width = len(CELLS)
    at = lambda i: F.col(f"x{i}")
    row = cells.agg(*[F.avg(at(i)).alias(f"m{i}") for i in range(width)], *[F.stddev_pop(at(i)).alias(f"s{i}") for i in range(width)]).first()
    mean = np.array([row[f"m{i}"] or 0.0 for i in range(width)])
    scale = np.array([row[f"s{i}"] or 0.0 for i in range(width)])
    scale[scale < 1e-9] = 1.0
    inputs = cells.select(*[f"x{i}" for i in range(width)])
    v, w = np.zeros((width, RANK)), np.ones(width)
    patterns = _patterns(inputs, mean, scale)

    def pairs(pdf: pd.DataFrame) -> np.ndarray:
        x = (_matrix(pdf) - mean) / scale
        here = (~np.isnan(x)).astype(float)
        x = np.nan_to_num(x)
        return np.concatenate([(x.T @ x).ravel(), (here.T @ here).ravel()])

    on = lambda code: (code >> np.arange(width)) & 1 == 1
    if patterns is None:
        flat = _summed(inputs, pairs)
    else:
        flat = sum((np.concatenate([s.ravel(), n * np.outer(on(code), on(code)).ravel()]) for code, (n, s) in patterns.items()), np.zeros(2 * width * width)) if patterns else None
    if flat is None:
        return mean, scale, v, w
    values, vectors = np.linalg.eigh(flat[: width * width].reshape(width, width) / np.maximum(flat[width * width :].reshape(width, width), 1))
    v = vectors[:, ::-1][:, :RANK] * np.sqrt(np.maximum(values[::-1][:RANK], 1e-3))
    for sweep in range(sweeps):

        def normal(pdf: pd.DataFrame, v: np.ndarray = v, w: np.ndarray = w) -> np.ndarray:
            x = (_matrix(pdf) - mean) / scale
            u = _records(x, v, w)
            here = ~np.isnan(x)
            outer = (u[:, :, None] * u[:, None, :]).reshape(len(u), -1)
            return np.concatenate([(here.T.astype(float) @ outer).ravel(), (np.nan_to_num(x).T @ u).ravel(), np.nansum((x - u @ v.T) ** 2, axis=0), here.sum(axis=0)])

        if patterns is None:
            flat = _summed(inputs, normal)
        else:
            flat = sum(_normal_of(on(code), n, s, v, w) for code, (n, s) in patterns.items())
        a, b, squares, n = np.split(flat, np.cumsum([width * RANK * RANK, width * RANK, width]))
        if sweep >= 2:
            w = np.clip(1 / np.maximum(squares / np.maximum(n, 1), 1e-12), 1.0, WEIGHT_MAX)
        v = np.linalg.solve(a.reshape(width, RANK, RANK) + RIDGE * np.eye(RANK), b.reshape(width, RANK, 1))[:, :, 0]
    return mean, scale, v, w


def _normal_of(on: np.ndarray, n: int, s: np.ndarray, v: np.ndarray, w: np.ndarray) -> np.ndarray:
    """What the records of one pattern add to the normal equations of V: sums of u u' and x u' by cell, squared residuals and numbers."""
    wo = np.where(on, w, 0.0)[:, None] * v
    u = np.linalg.solve(v.T @ wo + RIDGE * np.eye(v.shape[1]), wo.T)  # rank x cells: U is this times x
    xu, uu = s @ u.T, u @ s @ u.T
    squares = np.where(on, np.diag(s) - 2 * (xu * v).sum(axis=1) + ((v @ uu) * v).sum(axis=1), 0.0)
    return np.concatenate([(on[:, None] * uu.ravel()).ravel(), np.where(on[:, None], xu, 0.0).ravel(), np.maximum(squares, 0.0), on * float(n)])


def fill_missing(coefficient: DataFrame, sweeps: int = SWEEPS) -> DataFrame:
    """Every record once, with missing coef, veg and pheno_year filled and marked.

    Missing: coef that is no number from 0 to 1; veg that names no class; pheno_year null or outside 1986 to 2025.
    Columns: coef_row_id, location_id, coef, veg, pheno_year (all filled) and for each field f: f_imputed (the value was filled) and
    f_supported (filled, and some other record of the location has the field). A filled coef lies in 0 to 1; a filled veg is the likeliest of the
    classes that no other record of that location and season has if there is such a class; a filled pheno_year lies in the range, the nearest season to the fitted one
    of those of the location's span in which the class has no record if there is one. Repeated rows count once; records with a null
    location are filled from all other records (supported: false); an empty table gives an empty table.
    """
    cells = materialise(_encoded(_with_context(materialise(_rows(coefficient), "records"))), "cells")
    mean, scale, v, w = _fit(cells, sweeps)
    at = {name: i for i, name in enumerate(CELLS)}
    first_class = at[f"is_{CLASSES[0]}"]

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            x = (_matrix(pdf) - mean) / scale
            fitted = _records(x, v, w) @ v.T * scale + mean
            coef, year = pdf["coef"].to_numpy(float), pdf["year"].to_numpy(float)
            no_coef, no_veg, no_year = np.isnan(coef), pdf["cls"].isna().to_numpy(), np.isnan(year)
            coef = np.where(no_coef, np.clip(fitted[:, at["coef"]], 0, 1), coef)
            veg = pdf["cls"].to_numpy(object).copy()
            free = (pdf["free"].to_numpy(int)[:, None] >> np.arange(len(CLASSES))) & 1 == 1
            free[~free.any(axis=1)] = True
            best = np.where(free, fitted[:, first_class : first_class + len(CLASSES)], -np.inf).argmax(axis=1)
            veg[no_veg] = np.array(CLASSES, dtype=object)[best[no_veg]]
            guess = np.clip(np.rint(fitted[:, at["year"]]), FIRST_YEAR, LAST_YEAR)
            rows = np.flatnonzero(no_year & pdf["gaps"].notna().to_numpy())
            open_ = _open_years(pdf["gaps"].to_numpy(float)[rows].astype(np.int64))
            far = np.where(open_, np.abs(np.arange(FIRST_YEAR, LAST_YEAR + 1) - fitted[rows, at["year"]][:, None]), np.inf)
            guess[rows] = np.where(open_.any(axis=1), FIRST_YEAR + far.argmin(axis=1), guess[rows])
            out = pd.DataFrame({"coef_row_id": pdf["coef_row_id"], "location_id": pdf["location_id"], "coef": coef, "veg": veg, "pheno_year": np.where(no_year, guess, year).astype("int32")})
            for name, gone in (("coef", no_coef), ("veg", no_veg), ("pheno_year", no_year)):
                out[f"{name}_imputed"] = gone
                out[f"{name}_supported"] = gone & (pdf[f"l_{name}"].fillna(0).to_numpy() > 0) & pdf["location_id"].notna().to_numpy()
            yield out

    flags = ", ".join(f"{n}_imputed boolean, {n}_supported boolean" for n in ("coef", "veg", "pheno_year"))
    return cells.mapInPandas(decode, f"coef_row_id bigint, location_id string, coef double, veg string, pheno_year int, {flags}")


def held_out(coefficient: DataFrame, every: int = 20) -> DataFrame:
    """field, n, error, plain_error, spread: how well values come back that were hidden, one in ``every`` of each field by a hash of the row id.

    coef: mean absolute error (its interval columns are hidden with it), against the mean of the location and class; spread is the sd of the true values. veg: share of wrong classes, against the most frequent class of the
    location. pheno_year: share of wrong seasons, against the median season of the location. Only values that other records of the location support count.
    """
    hide = lambda name: F.pmod(F.xxhash64(F.lit(name), "coef_row_id"), F.lit(every)) == 0
    masked = coefficient.withColumns({n: F.when(~hide("coef"), F.col(n)) for n in ("coef", "coef_median", "coef_025", "coef_975", "coef_interval") if n in coefficient.columns})
    masked = materialise(masked.withColumns({n: F.when(~hide(n), F.col(n)) for n in ("veg", "pheno_year")}), "masked")
    truth = _rows(coefficient).dropDuplicates(["coef_row_id"]).select("coef_row_id", F.col("coef").alias("t_coef"), F.col("cls").alias("t_veg"), F.col("year").alias("t_pheno_year"))
    seen = _rows(masked)
    by_class = seen.groupBy("location_id", "cls").agg(F.avg("coef").alias("p_coef"))
    modes = seen.where("cls is not null").groupBy("location_id", "cls").agg(F.count(F.lit(1)).alias("k")).groupBy("location_id").agg(F.min_by("cls", F.struct(-F.col("k"), F.col("cls"))).alias("p_veg"))
    years = seen.groupBy("location_id").agg(F.percentile_approx("year", 0.5).alias("p_pheno_year"), F.avg("coef").alias("p_any"))
    j = fill_missing(masked).join(truth, "coef_row_id").join(years, "location_id", "left").join(modes, "location_id", "left")
    j = materialise(j.join(by_class.withColumnRenamed("cls", "veg"), ["location_id", "veg"], "left").withColumn("p_coef", F.coalesce("p_coef", "p_any")), "judged")
    out = None
    for name in ("coef", "veg", "pheno_year"):
        own = j.where(hide(name) & F.col(f"{name}_supported") & F.col(f"t_{name}").isNotNull())
        miss = (lambda a: F.abs(F.col(a) - F.col("t_coef"))) if name == "coef" else (lambda a, t=f"t_{name}": (~F.col(a).eqNullSafe(F.col(t))).cast("double"))
        spread = F.stddev_pop("t_coef") if name == "coef" else F.lit(None).cast("double")
        one = own.agg(F.lit(name).alias("field"), F.count(F.lit(1)).alias("n"), F.avg(miss(name)).alias("error"), F.avg(miss(f"p_{name}")).alias("plain_error"), spread.alias("spread"))
        out = one if out is None else out.unionByName(one)
    return out


def filled_cells(filled: DataFrame) -> DataFrame:
    """One row for each filled value that other records of the location support: coef_row_id, field."""
    fields = F.array(*[F.when(F.col(f"{n}_supported"), F.lit(n)) for n in ("coef", "veg", "pheno_year")])
    return filled.select("coef_row_id", F.explode(F.array_compact(fields)).alias("field")).distinct()
