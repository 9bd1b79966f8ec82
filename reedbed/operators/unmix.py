"""Unmixing of vectors into class fractions with a small library of class endmembers.

The library travels to the tasks as small arrays; an Arrow batch of vectors is solved at once by stacked normal equations.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, product

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reedbed.operators.ranks import group_percentiles
from reedbed.operators.soil import barren_floor
from reedbed.operators.traces import cosine, unit
from reedbed.session import materialise

SPARSE_PENALTY, ACTIVE_MAX, SUM_WEIGHT = 0.01, 2, 100.0
REWEIGHT_LOW, REWEIGHT_HIGH, REWEIGHT_STEPS, REWEIGHT_TOL = 0.1, 10.0, 5, 1e-4
FEATURE_STEPS = 3
COMBINATIONS_MAX, COARSE = 500, 3
BARE = "barren"
#: Vectors of a block of the greedy choice: a task compares one block of a class with another.
GREEDY_BLOCK = 2000
#: Numbers that one step of the Monte Carlo repeats holds.
DRAW_CELLS = 4_000_000

#: class, variant, vector
Library = list[tuple[str, str, np.ndarray]]


def nnls(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least squares with coefficients of at least 0, by active sets (Lawson and Hanson)."""
    return nnls_rows((a.T @ a)[None], (a.T @ b)[None])[0]


def nnls_rows(gram: np.ndarray, target: np.ndarray) -> np.ndarray:
    """nnls of many problems of one size by their normal equations: gram (n or 1) x k x k, target n x k."""
    rows, n = target.shape
    gram = np.broadcast_to(gram, (rows, n, n))
    x, free = np.zeros(target.shape), np.zeros(target.shape, dtype=bool)
    tol = 1e-10 * np.maximum(np.abs(target).max(axis=1, initial=0.0), 1e-30)
    going = np.arange(rows)
    for _ in range(10 * n + 10):
        slope = np.where(free[going], -np.inf, target[going] - np.einsum("rk,rkj->rj", x[going], gram[going]))
        open_ = slope.max(axis=1) > tol[going]
        going, slope = going[open_], slope[open_]
        if not len(going):
            break
        free[going, slope.argmax(axis=1)] = True
        todo = going
        while len(todo):
            f = free[todo]
            inner = np.where(f[:, :, None] & f[:, None, :], gram[todo], 0.0) + (~f)[:, :, None] * np.eye(n)
            z = _solved(inner, np.where(f, target[todo], 0.0))
            bad = f & (z <= 0)
            step = np.where(bad, x[todo] / np.maximum(x[todo] - z, 1e-300), np.inf).min(axis=1)
            moved = x[todo] + np.minimum(step, 1.0)[:, None] * (z - x[todo])
            over = bad.any(axis=1)
            free[todo] = np.where(over[:, None], f & (moved > 1e-14), f)
            x[todo] = np.where(over[:, None], np.where(free[todo], moved, 0.0), z)
            todo = todo[over]
    return x


def _solved(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Solutions of stacked systems; of singular ones (equal endmembers) the shortest."""
    try:
        z = np.linalg.solve(a, b[:, :, None])[:, :, 0]
        if np.isfinite(z).all():
            return z
    except np.linalg.LinAlgError:
        pass
    return (np.linalg.pinv(a, hermitian=True) @ b[:, :, None])[:, :, 0]


def solve_rows(e: np.ndarray, y: np.ndarray, weights: np.ndarray | None = None, pull: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Fractions (at least 0, sum 1) of endmembers in each row of y, and the rmse on unweighted residuals.

    e: features x endmembers, or one such matrix a row; weights: by feature, or by row and feature. The sum is a heavily weighted extra row, then enforced; missing features
    carry no weight; all-zero fractions become equal ones. pull (rows x endmembers): weights of extra rows that draw each fraction to 0.
    """
    n, k = len(y), e.shape[-1]
    whole = np.isfinite(e).all(axis=-1)
    ok = np.isfinite(y) & whole
    w = np.ones(y.shape[1]) if weights is None else np.maximum(np.nan_to_num(weights), 0)
    e0, y0 = np.where(whole[..., None], e, 0.0), np.where(ok, y, 0.0)
    square = np.broadcast_to(ok * w**2, y.shape)
    if e.ndim == 3:
        gram, target = np.einsum("rf,rfi,rfj->rij", square, e0, e0, optimize=True), np.einsum("rf,rfi->ri", square * y0, e0)
    else:
        same = (square == square[:1]).all() if n else True
        outer = (e0[:, :, None] * e0[:, None, :]).reshape(len(e0), k * k)
        gram, target = ((square[:1] if same else square) @ outer).reshape(-1, k, k), (square * y0) @ e0
    cells = (y.shape[1] + (0 if pull is None else k)) * k
    if pull is not None:
        gram = gram + (pull**2)[:, :, None] * np.eye(k)
    delta = SUM_WEIGHT**2 * np.trace(gram, axis1=1, axis2=2) / max(cells, 1)
    delta = np.where(delta >= 1e-16, delta, 1.0)
    x = nnls_rows(gram + delta[:, None, None], target + delta[:, None])
    total = x.sum(axis=1, keepdims=True)
    x = np.where(total > 0, x / np.where(total > 0, total, 1.0), 1 / k)
    fit = np.einsum("rfk,rk->rf", e0, x) if e.ndim == 3 else x @ e0.T
    m = ok.sum(axis=1)
    rss = (np.where(ok, y0 - fit, 0.0) ** 2).sum(axis=1)
    return x, np.where(m > 0, np.sqrt(rss / np.maximum(m, 1)), np.nan)


def fcls(e: np.ndarray, y: np.ndarray, weights: np.ndarray | None = None) -> tuple[np.ndarray, float]:
    """solve_rows of one vector."""
    x, rmse = solve_rows(e, y[None], weights)
    return x[0], float(rmse[0])


def fcls_rows(e: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Fractions as of fcls for all rows of y at once."""
    return solve_rows(e, y)[0]


def reweighted_rows(e: np.ndarray, y: np.ndarray, weights: np.ndarray | None = None, steps: int = REWEIGHT_STEPS, tol: float = REWEIGHT_TOL, pull: float = 1e-4) -> tuple[np.ndarray, np.ndarray]:
    """FCLS with a light pull of each fraction towards 0, repeated with the pull weighted by 1 / (|fraction| + 1e-6), kept within 0.1 to 10, until
    fractions settle: small fractions are driven out, large ones hardly moved."""
    x, rmse = solve_rows(e, y, weights)
    ok = np.isfinite(y) & np.isfinite(e).all(axis=1)
    size = np.sqrt(pull * (ok @ (np.nan_to_num(e) ** 2).sum(axis=1)) / max(e.shape[1], 1))
    going = np.arange(len(y))
    for _ in range(steps):
        scale = np.clip(1 / (np.abs(x[going]) + 1e-6), REWEIGHT_LOW, REWEIGHT_HIGH)
        z, r = solve_rows(e, y[going], weights, size[going, None] * scale)
        moving = np.abs(z - x[going]).max(axis=1) >= tol
        x[going], rmse[going] = z, r
        going = going[moving]
        if not len(going):
            break
    return x, rmse


def reweighted(e: np.ndarray, y: np.ndarray, weights: np.ndarray | None = None) -> tuple[np.ndarray, float]:
    """reweighted_rows of one vector."""
    x, rmse = reweighted_rows(e, y[None], weights)
    return x[0], float(rmse[0])


def feature_reweighted_rows(e: np.ndarray, y: np.ndarray, weights: np.ndarray | None = None, steps: int = FEATURE_STEPS) -> tuple[np.ndarray, np.ndarray]:
    """FCLS repeated with weights of features: 1 / (|fraction| + 1e-6) of the endmembers, dealt to the features in turn, times the given ones and kept within 0.1 to 10."""
    x, rmse = solve_rows(e, y, weights)
    turn = np.arange(y.shape[1]) % e.shape[1]
    for _ in range(steps):
        w = 1 / (np.abs(x[:, turn]) + 1e-6)
        x, rmse = solve_rows(e, y, np.clip(w if weights is None else w * weights, REWEIGHT_LOW, REWEIGHT_HIGH))
    return x, rmse


def sparsified(x: np.ndarray, classes: list[str], k: int = ACTIVE_MAX) -> np.ndarray:
    """The k largest vegetated fractions and bare ground, scaled to sum 1. x: one vector or rows."""
    rows = np.atleast_2d(x)
    veg = sorted((i for i, c in enumerate(classes) if c != BARE), key=lambda i: classes[i])
    out = rows.copy()
    if len(veg) > k:
        order = np.argsort(-rows[:, veg], axis=1, kind="stable")[:, k:]
        np.put_along_axis(out, np.array(veg)[order], 0.0, axis=1)
    total = out.sum(axis=1, keepdims=True)
    out = np.where(total > 0, out / np.where(total > 0, total, 1.0), out)
    return out if x.ndim == 2 else out[0]


SOLVERS = ("fcls", "sparse", "iwlmm", "iwlmm_sparse", "iwlmm_features", "iwlmm_features_sparse")


def _solver(solver: str):
    if solver.startswith("iwlmm_features"):
        return feature_reweighted_rows
    return reweighted_rows if solver.startswith("iwlmm") else solve_rows


def class_subsets(classes: list[str], active: int | None) -> list[list[str]]:
    """Bare ground, if there is any, with every choice of 1 to ``active`` (none: all) vegetated classes."""
    bare, veg = [c for c in classes if c == BARE], sorted(c for c in classes if c != BARE)
    most = len(veg) if active is None else min(active, len(veg))
    return [bare + list(s) for n in range(1, most + 1) for s in combinations(veg, n)] or [bare]


def search_models(y: np.ndarray, library: Library, weights: np.ndarray | None = None, solver: str = "fcls", penalty: float = SPARSE_PENALTY, active: int | None = ACTIVE_MAX) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each row of y the fractions of the best model (rows x library, zeros elsewhere), its rmse and its members; rmse NaN where no model fits.

    A model is one variant each of a subset of classes (class_subsets); its score is the rmse plus ``penalty`` for each active fraction beyond two. Subsets with at most COMBINATIONS_MAX
    choices are tried whole. Of others the variants of each class are ranked by their cosine with the row; all choices among the COARSE most similar ones are tried, then from the
    best of them one class after the other is given each of its other variants, until no change lowers the score (coordinate descent over all variants).
    """
    vectors, by = np.stack([v for _, _, v in library]).astype(float), {}
    for i, (cls, _, _) in enumerate(library):
        by.setdefault(cls, []).append(i)
    fit, n = _solver(solver), len(y)
    score, rmse, x, member = np.full(n, np.inf), np.full(n, np.nan), np.zeros((n, len(library))), np.zeros((n, len(library)), dtype=bool)

    def offered(model: tuple[int, ...], rows: np.ndarray) -> np.ndarray:
        """Scores of one model for some rows; the best of all models are kept."""
        at = list(model)
        z, r = fit(vectors[at].T, y[rows], weights)
        s = r + penalty * np.maximum(0, (z > 1e-6).sum(axis=1) - ACTIVE_MAX)
        s = np.where(np.isfinite(s), s, np.inf)
        better = s < score[rows] - 1e-15
        hit = rows[better]
        score[hit], rmse[hit], x[hit], member[hit] = s[better], r[better], 0.0, False
        x[np.ix_(hit, at)], member[np.ix_(hit, at)] = z[better], True
        return s

    def each(models: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Scores of one model a row."""
        out = np.empty(len(rows))
        kinds, which = np.unique(models, axis=0, return_inverse=True)
        which = which.reshape(-1)
        for i, model in enumerate(kinds):
            own = np.flatnonzero(which == i)
            out[own] = offered(tuple(model), rows[own])
        return out

    every = np.arange(n)
    ranked: dict[str, np.ndarray] = {}
    for subset in class_subsets(list(by), active):
        groups = [by[c] for c in subset]
        if np.prod([len(g) for g in groups], dtype=float) <= COMBINATIONS_MAX:
            for model in product(*groups):
                offered(model, every)
            continue
        for c in subset:
            if c not in ranked:
                ranked[c] = np.array(by[c])[np.argsort(-_similarity(y, vectors[by[c]], weights), axis=1, kind="stable")]
        at, low = np.zeros((n, len(subset)), dtype=int), np.full(n, np.inf)
        for pick in product(*[range(min(COARSE, len(g))) for g in groups]):
            trial = np.column_stack([ranked[c][:, p] for c, p in zip(subset, pick, strict=True)])
            s = each(trial, every)
            at[s < low], low = trial[s < low], np.minimum(s, low)
        going = every[np.isfinite(low)]
        while len(going):
            moved = np.zeros(n, dtype=bool)
            for j, g in enumerate(groups):
                for v in g:
                    rows = going[at[going, j] != v]
                    if len(rows):
                        trial = at[rows].copy()
                        trial[:, j] = v
                        s = each(trial, rows)
                        better = s < low[rows] * (1 - 1e-12)
                        at[rows[better]], low[rows[better]], moved[rows[better]] = trial[better], s[better], True
            going = np.flatnonzero(moved)
    if solver.endswith("sparse"):
        x = sparsified(x, [c for c, _, _ in library])
    return x, rmse, member


def _similarity(y: np.ndarray, variants: np.ndarray, weights: np.ndarray | None) -> np.ndarray:
    """Cosine of each row with each variant (rows x variants); rows are weighted by the roots of the weights, missing values count as 0."""
    w = 1.0 if weights is None else np.sqrt(np.maximum(weights, 0))
    a, b = np.nan_to_num(y) * w, np.nan_to_num(variants)
    size = lambda m: np.maximum(np.linalg.norm(m, axis=1), 1e-12)
    return (a @ b.T) / size(a)[:, None] / size(b)


def _repeats(y: np.ndarray, x: np.ndarray, member: np.ndarray, rmse: np.ndarray, library: Library, weights: np.ndarray | None, draws: int, seed: int, scale: float, bundles: bool, oob: dict[str, np.ndarray] | None):
    """sd, low and high (rows x classes) of ``draws`` solutions of noisy copies of each row with its own model.

    Noise: N(0, rmse x scale) on the features. bundles: endmembers of classes with at least three variants are drawn from mean and variance of the variants of the class and brought to unit length.
    oob: by class the residuals (rows x classes in sorted order) of fractions of held-out vectors; one of the largest class is added to each solution. Seeds follow from the row itself.
    """
    owner = np.array([c for c, _, _ in library])
    classes = sorted(set(owner))
    vectors = np.stack([v for _, _, v in library]).astype(float)
    kind = np.array([classes.index(c) for c in owner])
    spread = {c: (vectors[owner == c].mean(axis=0), np.sqrt(np.maximum(vectors[owner == c].var(axis=0, ddof=1), 1e-12))) for c in classes if bundles and (owner == c).sum() >= 3}
    out = np.full((3, len(y), len(classes)), np.nan)
    models, which = np.unique(member, axis=0, return_inverse=True)
    which = which.reshape(-1)
    for m, model in enumerate(models):
        at = np.flatnonzero(model)
        rows = np.flatnonzero((which == m) & np.isfinite(rmse))
        step = max(1, DRAW_CELLS // max(1, draws * y.shape[1] * (len(at) if spread else 1)))
        for part in np.split(rows, range(step, len(rows), step)) if len(at) else []:
            rngs = [np.random.default_rng([seed, *np.frombuffer(np.round(np.nan_to_num(r), 9).tobytes(), dtype=np.uint32)]) for r in y[part]]
            noisy = np.stack([r + g.normal(0, max(s, 0.0), (draws, y.shape[1])) for r, s, g in zip(y[part], rmse[part] * scale, rngs, strict=True)])
            e = vectors[at].T
            if any(owner[i] in spread for i in at):
                e = np.broadcast_to(e, (len(part), draws, *e.shape)).copy()
                for j, i in enumerate(at):
                    if owner[i] in spread:
                        mean, sd = spread[owner[i]]
                        drawn = np.stack([mean + sd * g.normal(size=(draws, len(mean))) for g in rngs])
                        length = np.linalg.norm(drawn, axis=2, keepdims=True)
                        e[:, :, :, j] = np.where(length < 1e-9, mean, drawn / np.maximum(length, 1e-9))
                e = e.reshape(-1, *e.shape[2:])
            z, _ = solve_rows(e, noisy.reshape(-1, y.shape[1]), weights)
            full = np.zeros((len(z), len(classes)))
            for j, i in enumerate(at):
                full[:, kind[i]] += z[:, j]
            full = full.reshape(len(part), draws, -1)
            if oob:
                largest = np.array([classes[k] for k in np.stack([x[part][:, kind == k].sum(axis=1) for k in range(len(classes))], 1).argmax(axis=1)])
                for r, c in enumerate(largest):
                    if len(oob.get(c, ())):
                        moved = np.maximum(full[r] + oob[c][rngs[r].integers(len(oob[c]), size=draws)], 0.0)
                        total = moved.sum(axis=1, keepdims=True)
                        full[r] = np.where(total > 1e-9, moved / np.maximum(total, 1e-9), moved)
            out[0][part] = full.std(axis=1, ddof=1)
            out[1][part], out[2][part] = np.quantile(full, [0.025, 0.975], axis=1)
    return out


def unmix(df: DataFrame, library: Library, keys: str, x: str = "x", weights: np.ndarray | None = None, basis: np.ndarray | None = None, solver: str = "fcls", draws: int = 0, seed: int = 42,
          penalty: float = SPARSE_PENALTY, active: int | None = None, noise: float = 1.0, bundles: bool = False, oob: dict[str, np.ndarray] | None = None) -> DataFrame:
    """keys, cls, variant_id, coef, rmse (and sd, low, high from ``draws`` noisy repeats) of each vector: one row for each class, coef 0 and no variant for the classes outside the best model.

    library: (class, variant, vector); the vectors must be in the representation of the observations. With a basis both sides are projected first, missing features as 0 and each axis of the
    observation times the share of its loadings that falls on present features; ``weights`` then are those of the axes. active: vegetated classes of a model at most (default: two for sparse solvers, else all).
    A vector without a finite value, of another width than the library or of length below 1e-9 has no rows. The seed of the repeats follows from the row itself, so results do not depend on partitioning.
    """
    if solver not in SOLVERS:
        raise ValueError(f"unknown solver {solver}")
    width = len(library[0][2])
    if basis is not None:
        library = [(c, v, np.nan_to_num(e) @ basis) for c, v, e in library]
    active = active if active is not None else ACTIVE_MAX if solver.endswith("sparse") and penalty > 0 else None
    names = [k.strip().split(" ")[0] for k in keys.split(",")]
    classes = sorted({c for c, _, _ in library})
    load = np.abs(basis) if basis is not None else None

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            fits = np.array([v is not None and len(v) == width for v in pdf[x]], dtype=bool)
            pdf = pdf[fits]
            y = np.array([np.asarray(v, dtype=float) for v in pdf[x]]).reshape(len(pdf), width)
            ok = np.isfinite(y)
            use = (np.where(ok, y, 0.0) ** 2).sum(axis=1) >= 1e-18
            pdf, y, ok = pdf[use], np.where(ok, y, np.nan)[use], ok[use]
            if basis is not None:
                y = np.where(ok, y, 0.0) @ basis * (ok @ load) / np.maximum(load.sum(axis=0), 1e-30)
            z, rmse, member = search_models(y, library, weights, solver, penalty, active)
            spread = _repeats(y, z, member, rmse, library, weights, draws, seed, noise, bundles, oob) if draws else None
            for k, cls in enumerate(classes):
                at = [i for i, (c, _, _) in enumerate(library) if c == cls]
                ids = np.array([*[library[i][1] for i in at], None], dtype=object)
                of = np.where(member[:, at].any(axis=1), member[:, at].argmax(axis=1), len(at))
                out = pdf[names].assign(cls=cls, variant_id=ids[of], coef=z[:, at].sum(axis=1), rmse=rmse)
                out = out.assign(**{n: spread[i][:, k] if spread is not None else None for i, n in enumerate(("sd", "low", "high"))})
                yield out[np.isfinite(rmse)]

    return df.select(*names, x).mapInPandas(work, f"{keys}, cls string, variant_id string, coef double, rmse double, sd double, low double, high double")


def variant_rank(df: DataFrame, library: DataFrame, key: str) -> DataFrame:
    """key, cls, variant_id, similarity, rank of the library variants for each vector. The library has a few rows by construction; it is checked before it is broadcast."""
    if library.limit(10_001).count() > 10_000:
        raise ValueError("a library has at most 10,000 variants")
    from pyspark.sql import Window

    pairs = df.select(key, "x").crossJoin(F.broadcast(library.select("cls", "variant_id", F.col("x").alias("e"))))
    sim = pairs.select(key, "cls", "variant_id", cosine(unit(F.col("x")), unit(F.col("e"))).alias("similarity"))
    return sim.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("similarity"), "cls", "variant_id")))


def library_cosines(library: DataFrame) -> DataFrame:
    """a, b, similarity of all variants of a library (at most 10,000), within -0.01 to 1.01."""
    if library.limit(10_001).count() > 10_000:
        raise ValueError("a library has at most 10,000 variants")
    a, b = library.select(F.col("variant_id").alias("a"), F.col("x").alias("xa")), library.select(F.col("variant_id").alias("b"), F.col("x").alias("xb"))
    pairs = a.join(F.broadcast(b), F.col("a") < F.col("b"))
    return pairs.select("a", "b", F.least(F.greatest(cosine(F.col("xa"), F.col("xb")), F.lit(-0.01)), F.lit(1.01)).alias("similarity"))


def greedy_endmembers(x: np.ndarray, k: int, weights: np.ndarray | None = None) -> list[int]:
    """Rows chosen as endmembers: the one nearest to the column medians, then each time the one that most reduces the summed distance to the nearest."""
    m = x * (1.0 if weights is None else np.sqrt(np.maximum(weights, 0)))
    med = np.nanmedian(m, axis=0)
    m = np.where(np.isfinite(m), m, med)
    chosen = [int(((m - med) ** 2).sum(axis=1).argmin())]
    d = lambda i: ((m - m[i]) ** 2).sum(axis=1)
    near = d(chosen[0])
    while len(chosen) < min(k, len(m)):
        gains = np.array([np.maximum(near - d(i), 0).sum() if i not in chosen else -1.0 for i in range(len(m))])
        chosen.append(int(gains.argmax()))
        near = np.minimum(near, d(chosen[-1]))
    return chosen


def endmember_library(vectors: DataFrame, counts: dict[str, int], key: str, label: str = "cls") -> DataFrame:
    """cls, variant_id, key, n_samples: the greedy endmembers of each class, as greedy_endmembers chooses them from all its vectors in order of their keys."""
    kind, spark = dict(vectors.dtypes)[key], vectors.sparkSession
    v = materialise(vectors.select(F.col(label).cast("string").alias("cls"), F.col(key).alias("key"), F.col("x").cast("array<double>").alias("x")).where("cls is not null"), "vectors")
    sizes = {r["cls"]: r["n"] for r in v.groupBy("cls").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row a class
    numbers = {c: max(1, min(counts.get(c, 1), n // 4)) for c, n in sizes.items()}
    chosen = _greedy(v, sizes, numbers, kind)
    rows = [(c, f"{c}_opt_{i + 1}", k, sizes[c] // len(keys)) for c, keys in sorted(chosen.items()) for i, (k, _) in enumerate(keys)]
    return spark.createDataFrame(rows, f"cls string, variant_id string, {key} {kind}, n_samples bigint")


def _greedy(v: DataFrame, sizes: dict[str, int], numbers: dict[str, int], kind: str) -> dict[str, list[tuple]]:
    """Keys and vectors of the endmembers of each class of v (cls, key, x).

    The first is the nearest to the column medians; for each further one every vector is a candidate and every vector counts: blocks of a class are compared with blocks, only sums of gains leave a task.
    Of equal gains (ten digits) the smallest key counts.
    """
    long = v.select("cls", F.posexplode("x").alias("pos", "v")).where("v is not null and not isnan(v)")
    med = {}
    for r in group_percentiles(long, ["cls", "pos"], {"m": "v"}, [0.5]).collect():  # classes x features
        med.setdefault(r["cls"], {})[r["pos"]] = r["m"]
    length = v.agg(F.max(F.size("x"))).first()[0]
    med = {c: np.array([med.get(c, {}).get(i, 0.0) for i in range(length)]) for c in sizes}

    def matrix(pdf: pd.DataFrame, m: np.ndarray) -> np.ndarray:
        x = np.array(pdf["x"].tolist(), float).reshape(len(pdf), -1)
        return np.where(np.isfinite(x), x, m) - m

    def distances(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for c, g in pdf.groupby("cls"):
                yield pd.DataFrame({"cls": c, "key": g["key"], "d": (matrix(g, med[c]) ** 2).sum(axis=1)})

    def fetched(best: DataFrame) -> list[tuple]:
        keys = [(r["cls"], r["b"]["key"]) for r in best.collect()]  # one a class
        at = v.join(F.broadcast(v.sparkSession.createDataFrame(keys, f"cls string, key {kind}")), ["cls", "key"]).dropDuplicates(["cls", "key"])
        return [(r["cls"], (r["key"], np.array([np.nan if u is None else u for u in r["x"]], float))) for r in at.collect()]

    near = v.mapInPandas(distances, f"cls string, key {kind}, d double").groupBy("cls").agg(F.min(F.struct("d", "key")).alias("b"))
    chosen: dict[str, list[tuple]] = {c: [x] for c, x in fetched(near)}
    while growing := [c for c in chosen if len(chosen[c]) < numbers[c]]:
        blocks = {c: -(-sizes[c] // GREEDY_BLOCK) for c in growing}
        ends = {c: np.array([np.where(np.isfinite(x), x, med[c]) - med[c] for _, x in chosen[c]]) for c in growing}
        of = F.create_map(*[F.lit(u) for pair in blocks.items() for u in pair])[F.col("cls")]
        own = v.where(F.col("cls").isin(growing)).withColumn("_n", of).withColumn("_b", F.pmod(F.xxhash64("key"), F.col("_n")).cast("int"))
        first = own.select("cls", F.col("_b").alias("_i"), F.explode(F.sequence(F.col("_b"), F.col("_n") - 1)).alias("_j"), F.lit(0).alias("_side"), "key", "x")
        second = own.select("cls", F.explode(F.sequence(F.lit(0), F.col("_b"))).alias("_i"), F.col("_b").alias("_j"), F.lit(1).alias("_side"), "key", "x").where("_i < _j")
        tasks = min(sum(n * (n + 1) // 2 for n in blocks.values()), 1000)

        def gains(pdf: pd.DataFrame) -> pd.DataFrame:
            c = pdf["cls"].iloc[0]
            square = lambda a, b: np.maximum((a**2).sum(axis=1)[:, None] + (b**2).sum(axis=1) - 2 * a @ b.T, 0)
            pair = [g.reset_index(drop=True) for g in (pdf[pdf["_side"] == 0], pdf[pdf["_side"] == 1])]
            keys, x = [g["key"] for g in pair], [matrix(g, med[c]) if len(g) else g for g in pair]
            if pdf["_i"].iloc[0] == pdf["_j"].iloc[0]:
                return pd.DataFrame({"cls": c, "key": keys[0], "gain": np.maximum(square(x[0], ends[c]).min(axis=1) - square(x[0], x[0]), 0).sum(axis=1)})
            if not len(x[0]) or not len(x[1]):
                return pd.DataFrame({"cls": [], "key": [], "gain": []})
            d, left = square(x[0], x[1]), [square(a, ends[c]).min(axis=1) for a in x]
            parts = [(keys[0], np.maximum(left[1] - d, 0).sum(axis=1)), (keys[1], np.maximum(left[0][:, None] - d, 0).sum(axis=0))]
            return pd.concat([pd.DataFrame({"cls": c, "key": k, "gain": g}) for k, g in parts])

        rows = first.unionByName(second).repartition(tasks, "cls", "_i", "_j").groupBy("cls", "_i", "_j").applyInPandas(gains, f"cls string, key {kind}, gain double")
        taken = v.sparkSession.createDataFrame([(c, k) for c in growing for k, _ in chosen[c]], f"cls string, key {kind}")
        total = rows.groupBy("cls", "key").agg(F.sum("gain").alias("gain")).join(F.broadcast(taken), ["cls", "key"], "left_anti")
        for c, x in fetched(total.groupBy("cls").agg(F.min(F.struct((-F.format_string("%.9e", "gain").cast("double")).alias("g"), "key")).alias("b"))):
            chosen[c].append(x)
    return chosen


def library_size(vectors: DataFrame, k_max: int, bare: str, penalty: float = 0.005) -> dict[str, int]:
    """Endmembers by class with the best min(held-out, training) share of the true class less the penalty for each endmember.

    vectors: cls, key, x, held. All vectors are scored in tasks against the broadcast candidates; only sums by configuration and class come back.
    """
    v = materialise(vectors, "search")
    training = v.where("not held")
    sizes = {r["cls"]: r["n"] for r in training.groupBy("cls").agg(F.count(F.lit(1)).alias("n")).collect()}
    classes = sorted(sizes)
    options = [range(1, max(1, min(k_max, sizes[c] // 4)) + 1) for c in classes]
    picks = _greedy(training.select("cls", "key", "x"), sizes, {c: max(o) for c, o in zip(classes, options, strict=True)}, dict(v.dtypes)["key"])
    grid = list(product(*options))

    def hits(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            y = np.array(pdf["x"].tolist(), float)
            for g, counts in enumerate(grid):
                owner = np.array([c for c, k in zip(classes, counts, strict=True) for _ in range(k)])
                e = np.column_stack([x for c, k in zip(classes, counts, strict=True) for _, x in picks[c][:k]])
                share = (fcls_rows(e, y) * (owner == pdf["cls"].to_numpy()[:, None])).sum(axis=1)
                own = pd.DataFrame({"g": g, "held": pdf["held"], "cls": pdf["cls"], "s": share})
                yield own.groupby(["g", "held", "cls"])["s"].agg(["sum", "count"]).reset_index()

    sums = v.where(F.col("cls") != bare).where(F.col("cls").isin(classes)).repartition(v.sparkSession.sparkContext.defaultParallelism).mapInPandas(hits, "g int, held boolean, cls string, sum double, count bigint")
    means = sums.groupBy("g", "held", "cls").agg((F.sum("sum") / F.sum("count")).alias("m")).groupBy("g", "held").agg(F.avg("m").alias("m"))
    score = {(r["g"], r["held"]): r["m"] for r in means.collect()}  # two numbers a configuration
    best = max(range(len(grid)), key=lambda g: (min(score.get((g, True), 0.0), score.get((g, False), 0.0)) - penalty * sum(grid[g]), [-x for x in grid[g]]))
    return dict(zip(classes, grid[best], strict=True))


def bundle_stats(vectors: DataFrame, label: str = "cls") -> DataFrame:
    """cls, pos, mean, var (at least 1e-12) of the features of each class."""
    long = vectors.select(label, F.posexplode("x").alias("pos", "v"))
    return long.groupBy(label, "pos").agg(F.avg("v").alias("mean"), F.greatest(F.coalesce(F.var_samp("v"), F.lit(0.0)), F.lit(1e-12)).alias("var"))


def barren_cap(coefs: DataFrame, peaks: DataFrame, keys: list[str]) -> DataFrame:
    """Adds capped: where bare ground (1 less the vegetated sum) exceeds the least share that the season's peak leaves, vegetated values are scaled up to fill the difference.

    peaks: keys, peak. One row 'barren' for each group replaces what bare ground there was.
    """
    veg = F.col("veg") != "barren"
    sums = coefs.groupBy(*keys).agg(F.sum(F.when(veg, F.col("coef"))).alias("_v"), F.count(F.when(veg, 1)).alias("_k"))
    rest = F.least(F.greatest(1 - F.coalesce("_v", F.lit(0.0)), F.lit(0.0)), F.lit(1.0))
    state = sums.join(peaks, keys, "left").withColumn("_b", rest).withColumn("_m", F.coalesce(barren_floor(F.col("peak")), F.lit(0.0)))
    state = state.withColumn("_freed", F.when(F.col("_b") > F.col("_m") + 1e-6, F.col("_b") - F.col("_m")).otherwise(0.0))
    joined = coefs.where(veg).join(state, keys)
    grown = F.when(F.col("_v") > 1e-9, F.col("coef") * (F.col("_v") + F.col("_freed")) / F.col("_v")).otherwise(F.col("_freed") / F.col("_k"))
    vegetated = joined.select(*keys, "veg", "coef", grown.alias("capped"))
    bare = state.select(*keys, F.lit("barren").alias("veg"), F.col("_b").alias("coef"), (F.col("_b") - F.col("_freed")).alias("capped"))
    return vegetated.unionByName(bare)


def inseparable_flags(coefs: DataFrame, pairs: DataFrame) -> DataFrame:
    """Adds inseparable_variant_flag and _details from a table of variant pairs that cannot be told apart (variant_id, other)."""
    twins = pairs.groupBy("variant_id").agg(F.array_join(F.array_sort(F.collect_set("other")), ", ").alias("inseparable_variant_details"))
    return coefs.join(twins, "variant_id", "left").withColumn("inseparable_variant_flag", F.col("inseparable_variant_details").isNotNull())


def diagnostics(y: np.ndarray, e: np.ndarray, w: np.ndarray) -> dict[str, float]:
    """Condition number of the endmembers, residual sum of squares, r2."""
    s = np.linalg.svd(e, compute_uv=False)
    rss = float(((y - e @ w) ** 2).sum())
    tss = float(((y - y.mean()) ** 2).sum())
    return {"condition": float(s[0] / s[-1]) if s[-1] > 0 else np.inf, "rss": rss, "r2": 1 - rss / tss if tss > 0 else np.nan}


