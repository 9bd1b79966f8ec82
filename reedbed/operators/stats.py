"""Statistics: regression, correlation at lags, spatial autocorrelation, seasonal detrending, area correction, smoothing."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reedbed.functions.numeric import ratio
from reedbed.operators.harmonise import haversine_km
from reedbed.operators.ranks import group_percentiles
from reedbed.operators.relational import lag_join
from reedbed.session import materialise


def student_t_p(t: np.ndarray, df: np.ndarray) -> np.ndarray:
    """Two-sided p-value of Student's t: the incomplete beta function by its continued fraction."""
    t, df = np.broadcast_arrays(np.asarray(t, float), np.asarray(df, float))
    out = np.full(t.shape, np.nan)
    for i in np.ndindex(t.shape):
        if np.isfinite(t[i]) and df[i] > 0:
            out[i] = _incomplete_beta(df[i] / 2, 0.5, df[i] / (df[i] + t[i] ** 2))
    return out


def _incomplete_beta(a: float, b: float, x: float) -> float:
    if x <= 0 or x >= 1:
        return min(max(x, 0.0), 1.0)
    if x > (a + 1) / (a + b + 2):
        return 1 - _incomplete_beta(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log(1 - x)) / a
    f, c, d = 1.0, 1.0, 0.0
    for i in range(300):
        m = i // 2
        step = 1.0 if i == 0 else m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)) if i % 2 == 0 else -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1 / max(1 + step * d, 1e-300) if 1 + step * d > 0 else 1 / (1 + step * d)
        c = 1 + step / c
        f *= c * d
        if abs(1 - c * d) < 1e-12:
            break
    return front * (f - 1)


def linear_fit(df: DataFrame, groups: list[str], x: str, y: str, at_least: int = 3) -> DataFrame:
    """n, slope, intercept, r, r2, p of y on x by group, from pairs that are both present; nulls below ``at_least`` pairs."""
    ok = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    enough = lambda c: F.when(F.count(F.lit(1)) >= at_least, c)
    fit = ok.groupBy(*groups).agg(
        F.count(F.lit(1)).alias("n"), enough(F.regr_slope(y, x)).alias("slope"), enough(F.regr_intercept(y, x)).alias("intercept"), enough(F.corr(x, y)).alias("r"), enough(F.regr_r2(y, x)).alias("r2")
    )
    t = F.col("r") * F.sqrt(ratio((F.col("n") - 2).cast("double"), 1 - F.col("r") * F.col("r")))
    p = F.pandas_udf(lambda t, n: pd.Series(student_t_p(t.to_numpy(float), n.to_numpy(float) - 2)), "double")
    return fit.withColumn("p", p(t, F.col("n").cast("double")))


def lag_table(series: DataFrame, water: DataFrame, groups: list[str], metric: str, depth: str, low: int = -2, high: int = 3) -> DataFrame:
    """linear_fit of the metric on the depth for every lag."""
    return linear_fit(lag_join(series, water, low, high), [*groups, "lag"], depth, metric)


def best_lag(table: DataFrame, groups: list[str]) -> DataFrame:
    """The row of each group with the largest \\|r\\|, of equals the smallest lag."""
    columns = [c for c in table.columns if c not in groups]
    best = F.min_by(F.struct(*columns), F.struct(-F.abs("r"), F.col("lag")))
    return table.where("r is not null").groupBy(*groups).agg(best.alias("b")).select(*groups, *[f"b.{c}" for c in columns])


def correlation_matrix(df: DataFrame, columns: list[str]) -> DataFrame:
    """a, b, r over rows where both are present, for all pairs of columns; one aggregation."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    row = df.agg(*[F.corr(F.when(F.col(b).isNotNull(), F.col(a)), F.when(F.col(a).isNotNull(), F.col(b))).alias(f"{a}~{b}") for a, b in pairs])
    return row.select(F.inline(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"`{a}~{b}`").alias("r")) for a, b in pairs])))


def independent_features(df: DataFrame, columns: list[str], limit: float = 0.9) -> list[str]:
    """Columns in order, without those correlated by more than the limit with an earlier kept one."""
    r = {(x["a"], x["b"]): x["r"] for x in correlation_matrix(df, columns).collect()}
    kept: list[str] = []
    for c in columns:
        if all(abs(r.get((k, c)) or 0.0) <= limit for k in kept):
            kept.append(c)
    return kept


def detrend_cubic(df: DataFrame, groups: list[str], x: str, y: str, at_least: int = 50, distinct: int = 3) -> DataFrame:
    """Adds detrended: y less a cubic in x, plus the mean of the cubic; y where a group has too few points.

    Orthogonal polynomials by the three-term recurrence: a few grouped sums, no matrix is gathered.
    """
    ok = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).withColumn("_x", F.col(x).cast("double"))
    stat = ok.groupBy(*groups).agg(F.avg("_x").alias("_mean"), F.count(F.lit(1)).alias("_n"), F.countDistinct("_x").alias("_k"))
    rows = ok.join(stat, groups) if groups else ok.crossJoin(F.broadcast(stat))
    rows = rows.withColumn("_p1", F.col("_x") - F.col("_mean"))

    def with_sums(rows: DataFrame, **sums: Column) -> DataFrame:
        s = rows.groupBy(*groups).agg(*[F.sum(c).alias(k) for k, c in sums.items()])
        return rows.join(s, groups) if groups else rows.crossJoin(F.broadcast(s))

    c = F.col
    rows = with_sums(rows, _s1=c("_p1") ** 2, _x1=c("_x") * c("_p1") ** 2)
    rows = rows.withColumn("_p2", (c("_x") - ratio(c("_x1"), c("_s1"))) * c("_p1") - c("_s1") / c("_n"))
    rows = with_sums(rows, _s2=c("_p2") ** 2, _x2=c("_x") * c("_p2") ** 2)
    rows = rows.withColumn("_p3", (c("_x") - ratio(c("_x2"), c("_s2"))) * c("_p2") - ratio(c("_s2"), c("_s1")) * c("_p1"))
    rows = with_sums(rows, _s3=c("_p3") ** 2, _c1=c(y) * c("_p1"), _c2=c(y) * c("_p2"), _c3=c(y) * c("_p3"))
    trend = sum((F.coalesce(ratio(c(f"_c{i}"), c(f"_s{i}")), F.lit(0.0)) * c(f"_p{i}") for i in (2, 3)), F.coalesce(ratio(c("_c1"), c("_s1")), F.lit(0.0)) * c("_p1"))
    out = rows.withColumn("detrended", F.when((c("_n") >= at_least) & (c("_k") >= distinct), c(y) - trend).otherwise(c(y)))
    return out.select(*df.columns, "detrended")


def separability(medians: DataFrame, flag: Column, columns: list[str]) -> DataFrame:
    """index_name, separability: difference of the means of two kinds of location medians over their pooled spread."""
    out = []
    for name in columns:
        a, b = F.when(flag, F.col(name)), F.when(~flag, F.col(name))
        out.append(((F.avg(a) - F.avg(b)) / F.nullif(F.sqrt((F.var_samp(a) + F.var_samp(b)) / 2), F.lit(0.0))).alias(name))
    return medians.agg(*out).unpivot([], columns, "index_name", "separability")


def signal_to_noise(df: DataFrame, key: str, columns: list[str], eps: float = 1e-9) -> DataFrame:
    """index_name, snr: squared span of the 1st to 99th percentile over the median variance within locations."""
    df = materialise(df.select(key, *columns), "indices")
    ends = group_percentiles(df, [], {c: c for c in columns}, [0.01, 0.99])
    span = ends.select(*[F.pow(F.col(f"{c}_1") - F.col(f"{c}_0"), F.lit(2.0)).alias(c) for c in columns]).unpivot([], columns, "index_name", "signal")
    noise = group_percentiles(df.groupBy(key).agg(*[F.var_samp(c).alias(c) for c in columns]), [], {c: c for c in columns}, [0.5]).unpivot([], columns, "index_name", "noise")
    return span.join(noise, "index_name").withColumn("snr", F.col("signal") / (F.col("noise") + eps))


#: Locations of a block: pairs are worked off one block of locations against another, so a task holds at most about PAIR_BLOCK ** 2 of them.
PAIR_BLOCK = 1000
#: Values of pairs that are fetched to read off the last ranks, and parts that an interval of values is split into before.
RANK_FETCH, RANK_PARTS = 100_000, 2048


def _sides(places: DataFrame, value: str, key: str) -> tuple[DataFrame, DataFrame, int]:
    """_i, _j, k, lat, lon, v of the locations with a position and a value as first and as second of all pairs of blocks, each pair once (_i <= _j); number of tasks."""
    p = places.where(F.col("lat").isNotNull() & F.col("lon").isNotNull() & F.col(value).isNotNull()).select(F.col(key).alias("k"), "lat", "lon", F.col(value).alias("v"))
    n = p.count()
    blocks = max(1, -(-n // PAIR_BLOCK), min(8, n // 50))
    own = p.withColumn("_b", F.pmod(F.xxhash64("k"), F.lit(blocks)).cast("int"))
    first = own.select(F.col("_b").alias("_i"), F.explode(F.sequence(F.col("_b"), F.lit(blocks - 1))).alias("_j"), "k", "lat", "lon", "v")
    second = own.select(F.explode(F.sequence(F.lit(0), F.col("_b"))).alias("_i"), F.col("_b").alias("_j"), "k", "lat", "lon", "v")
    return first, second, min(blocks * (blocks + 1) // 2, 1000)


def location_pairs(places: DataFrame, value: str, key: str = "location_id") -> DataFrame:
    """a, b, va, vb, km of all pairs of locations with a position and a value."""
    first, second, tasks = _sides(places, value, key)
    side = lambda df, end: df.select("_i", "_j", *[F.col(c).alias(f"{c}{end}") for c in ("k", "lat", "lon", "v")]).repartition(tasks, "_i", "_j")
    pairs = side(first, "a").join(side(second, "b"), ["_i", "_j"]).where((F.col("_i") < F.col("_j")) | (F.col("ka") < F.col("kb")))
    swap = F.col("ka") > F.col("kb")
    pick = lambda x, y: F.when(swap, F.col(y)).otherwise(F.col(x))
    return pairs.select(pick("ka", "kb").alias("a"), pick("kb", "ka").alias("b"), pick("va", "vb").alias("va"), pick("vb", "va").alias("vb"), haversine_km(F.col("lata"), F.col("lona"), F.col("latb"), F.col("lonb")).alias("km"))


def _kilometres(x: pd.DataFrame, y: pd.DataFrame) -> np.ndarray:
    (a, o), (b, q) = ((np.radians(t["lat"].to_numpy(float)), np.radians(t["lon"].to_numpy(float))) for t in (x, y))
    h = np.sin((a[:, None] - b) / 2) ** 2 + np.cos(a)[:, None] * np.cos(b) * np.sin((o[:, None] - q) / 2) ** 2
    return 2 * 6371 * np.arcsin(np.sqrt(np.minimum(h, 1)))


class PairBlocks:
    """All pairs of locations in blocks against blocks; only what a task makes of its block leaves it."""

    def __init__(self, places: DataFrame, value: str, key: str = "location_id"):
        self.places = materialise(places.select(key, "lat", "lon", value), "locations")
        self.value, self.key = value, key
        first, second, tasks = _sides(self.places, value, key)
        self.rows = first.withColumn("_side", F.lit(0)).unionByName(second.withColumn("_side", F.lit(1))).repartition(tasks, "_i", "_j")

    def map(self, work: Callable[[pd.DataFrame, pd.DataFrame, np.ndarray, np.ndarray], pd.DataFrame], schema: str) -> DataFrame:
        """What work makes of the locations of two blocks, their distances and a mask of the pairs that count."""

        def block(pdf: pd.DataFrame) -> pd.DataFrame:
            x, y = (pdf[pdf["_side"] == s].sort_values("k") for s in (0, 1))
            once = np.ones((len(x), len(y)), dtype=bool)
            return work(x, y, _kilometres(x, y), np.triu(once, 1) if pdf["_i"].iloc[0] == pdf["_j"].iloc[0] else once)

        return self.rows.groupBy("_i", "_j").applyInPandas(block, schema)

    def percentiles(self, values: Callable[..., tuple[np.ndarray, np.ndarray]], shares: Callable[[int, int], list[float]]) -> dict[int, tuple[int, list[float]]]:
        """Number and exact percentiles (linear between ranks) of values of at least 0 by group of pairs; values gives groups and values of a block's pairs, shares the percentiles of a group and its number.

        Values are compared as the integers of their bits, which have the same order: intervals around the ranks are split and counted until few values are left in them.
        """

        def sorted_bits(x: pd.DataFrame, y: pd.DataFrame, km: np.ndarray, once: np.ndarray) -> dict[int, np.ndarray]:
            group, v = values(x, y, km, once)
            bits = (v + 0.0).view(np.int64)
            return {int(g): np.sort(bits[group == g]) for g in np.unique(group)}

        def extent(*block) -> pd.DataFrame:
            return pd.DataFrame([(g, len(b), b[0], b[-1]) for g, b in sorted_bits(*block).items()], columns=["g", "n", "lo", "hi"])

        ends = self.map(extent, "g int, n bigint, lo bigint, hi bigint").groupBy("g").agg(F.sum("n"), F.min("lo"), F.max("hi")).collect()
        sizes = {g: n for g, n, _, _ in ends}
        places = {g: [(n - 1) * q for q in shares(g, n)] for g, n in sizes.items()}
        ranks = {g: sorted({r for p in places[g] for r in (math.floor(p), math.ceil(p))}) for g in sizes}
        found: dict[tuple[int, int], int] = {}
        open_ = [(g, lo, hi + 1, 0, n, ranks[g]) for g, n, lo, hi in ends if ranks[g]]  # values, numbers below and within, ranks
        while open_:
            if sum(o[4] for o in open_) <= RANK_FETCH:

                def within(*block, spans=[o[:3] for o in open_]) -> pd.DataFrame:
                    bits, out = sorted_bits(*block), []
                    for t, (g, lo, hi) in enumerate(spans):
                        b = bits.get(g, np.zeros(0, np.int64))
                        out += [(t, int(v)) for v in b[np.searchsorted(b, lo) : np.searchsorted(b, hi)]]
                    return pd.DataFrame(out, columns=["t", "bits"])

                got = self.map(within, "t int, bits bigint").toPandas()  # at most RANK_FETCH rows
                by = {t: np.sort(x["bits"].to_numpy()) for t, x in got.groupby("t")}
                found |= {(o[0], r): by[t][r - o[3]] for t, o in enumerate(open_) for r in o[5]}
                break

            def counted(*block, spans=[o[:3] for o in open_]) -> pd.DataFrame:
                bits, out = sorted_bits(*block), []
                for t, (g, lo, hi) in enumerate(spans):
                    b = bits.get(g, np.zeros(0, np.int64))
                    part, n = np.unique((b[np.searchsorted(b, lo) : np.searchsorted(b, hi)] - lo) // -((lo - hi) // RANK_PARTS), return_counts=True)
                    out += zip([t] * len(part), part.tolist(), n.tolist())
                return pd.DataFrame(out, columns=["t", "part", "n"])

            counts = self.map(counted, "t int, part bigint, n bigint").groupBy("t", "part").agg(F.sum("n").alias("n")).toPandas().sort_values(["t", "part"])  # intervals x RANK_PARTS
            narrower = []
            for t, c in counts.groupby("t"):
                g, lo, hi, below, _, wanted = open_[t]
                width, part, upto = -((lo - hi) // RANK_PARTS), c["part"].to_numpy(), below + np.cumsum(c["n"].to_numpy())
                at = np.searchsorted(upto, wanted, side="right")
                for k in np.unique(at):
                    own = [r for r, a in zip(wanted, at, strict=True) if a == k]
                    a = lo + int(part[k]) * width
                    if width == 1:
                        found |= {(g, r): a for r in own}
                    else:
                        narrower.append((g, a, min(a + width, hi), int(upto[k] - c["n"].iloc[k]), int(c["n"].iloc[k]), own))
            open_ = narrower
        value = lambda g, r: float(np.int64(found[g, r]).view(np.float64))
        between = lambda g, p: value(g, math.floor(p)) if p == math.floor(p) else (math.ceil(p) - p) * value(g, math.floor(p)) + (p - math.floor(p)) * value(g, math.ceil(p))
        return {g: (sizes[g], [between(g, p) for p in places[g]]) for g in sizes}

    def lags(self) -> DataFrame:
        """k, v, lag, w: of each location its value, the mean of all others by inverse distance (at least 1 m), and the sum of these weights."""

        def sums(x: pd.DataFrame, y: pd.DataFrame, km: np.ndarray, once: np.ndarray) -> pd.DataFrame:
            w = np.where(once, 1 / np.maximum(km, 1e-3), 0.0)
            both = [pd.DataFrame({"k": s["k"], "v": s["v"], "w": m.sum(axis=1), "wo": m @ o["v"].to_numpy(float)}) for s, o, m in ((x, y, w), (y, x, w.T))]
            return pd.concat(both).query("w > 0")

        per = self.map(sums, f"k {dict(self.places.dtypes)[self.key]}, v double, w double, wo double")
        return per.groupBy("k").agg(F.first("v").alias("v"), (F.sum("wo") / F.sum("w")).alias("lag"), F.sum("w").alias("w"))


def semivariogram(blocks: PairBlocks) -> list[tuple[int, float, float, int]]:
    """bin, km (middle), gamma (median half squared difference), n: at most ten distance bins at quantiles, the last border excluded."""
    number = lambda n: min(10, max(3, n // 5))
    got = blocks.percentiles(lambda x, y, km, once: (np.zeros(once.sum(), np.int64), km[once]), lambda g, n: [i / number(n) for i in range(number(n) + 1)])
    if not got:
        return []
    cuts = np.array(got[0][1])

    def halves(x: pd.DataFrame, y: pd.DataFrame, km: np.ndarray, once: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        once = once & (km >= cuts[0]) & (km < cuts[-1])
        return np.searchsorted(cuts, km[once], side="right"), (x["v"].to_numpy(float)[:, None] - y["v"].to_numpy(float))[once] ** 2 / 2

    gammas = blocks.percentiles(halves, lambda g, n: [0.5])
    return [(g, float(cuts[g - 1] + cuts[g]) / 2, q[0], n) for g, (n, q) in sorted(gammas.items())]


def variogram_range(bins: list[tuple[float, float]], total_var: float, max_km: float, fallback_km: float = 5.0) -> float:
    """Range of an exponential variogram fitted by bounded Gauss-Newton over at most ten points, kept within 1 to 500 km."""
    pts = np.array([b for b in bins if np.isfinite(b).all()], dtype=float).reshape(-1, 2)
    if len(pts) < 3 or not total_var > 0:
        return fallback_km
    x, g = pts.T
    sill, rng = total_var, max(x.mean(), 1e-3)
    lam, error = 1e-2, np.inf
    for _ in range(200):
        e = np.exp(-x / rng)
        res = g - sill * (1 - e)
        j = np.column_stack([1 - e, -sill * x / rng**2 * e])
        step = np.linalg.solve(j.T @ j + lam * np.eye(2) * np.maximum(np.diag(j.T @ j), 1e-12), j.T @ res)
        s2, r2 = np.clip(sill + step[0], 1e-12, 10 * total_var), np.clip(rng + step[1], 1e-3, 10 * max_km)
        new = ((g - s2 * (1 - np.exp(-x / r2))) ** 2).sum()
        if new < error:
            done = error - new < 1e-14 * max(error, 1e-30)
            sill, rng, error, lam = s2, r2, new, lam / 3
            if done:
                break
        else:
            lam *= 5
            if lam > 1e12:
                break
    if not np.isfinite(error):
        over = x[g >= 0.5 * total_var]
        rng = over[0] if len(over) else max_km
    return float(np.clip(rng, 1.0, 500.0))


def moran(pairs: DataFrame) -> DataFrame:
    """One row: i, expected, n. Weights are inverse distances, each location's own summing to 1; pairs at distance 0 count as 1 m."""
    w = 1 / F.greatest(F.col("km"), F.lit(1e-3))
    both = pairs.select(F.col("a").alias("k"), F.col("va").alias("v"), F.col("vb").alias("o"), w.alias("w")).unionByName(pairs.select(F.col("b").alias("k"), F.col("vb").alias("v"), F.col("va").alias("o"), w.alias("w")))
    return moran_of_lags(both.groupBy("k").agg(F.first("v").alias("v"), (F.sum(F.col("w") * F.col("o")) / F.sum("w")).alias("lag")))


def moran_of_lags(per: DataFrame) -> DataFrame:
    """moran from v and lag of each location."""
    s = per.agg(F.avg("v").alias("m"))
    c = per.crossJoin(F.broadcast(s)).withColumn("d", F.col("v") - F.col("m"))
    total = c.agg(F.sum(F.col("d") * (F.col("lag") - F.col("m"))).alias("top"), F.sum(F.col("d") * F.col("d")).alias("low"), F.count(F.lit(1)).alias("n"))
    return total.select(ratio(F.col("top"), F.col("low")).alias("i"), (-1 / (F.col("n") - 1)).alias("expected"), "n")


def moran_p(lat: np.ndarray, lon: np.ndarray, values: np.ndarray, draws: int = 199, seed: int = 42) -> tuple[float, float]:
    """Moran's I and its one-sided permutation p-value, of a matrix of all pairs; moran_test does the same in blocks."""
    a, o = np.radians(lat), np.radians(lon)
    h = np.sin((a[:, None] - a) / 2) ** 2 + np.cos(a)[:, None] * np.cos(a) * np.sin((o[:, None] - o) / 2) ** 2
    km = np.maximum(2 * 6371 * np.arcsin(np.sqrt(np.minimum(h, 1))), 1e-3)
    w = 1 / km
    np.fill_diagonal(w, 0)
    w /= w.sum(axis=1, keepdims=True)
    stat = lambda v: ((v - v.mean()) @ w @ (v - v.mean())) / ((v - v.mean()) ** 2).sum()
    observed, rng = stat(values), np.random.default_rng(seed)
    return float(observed), float((1 + sum(stat(rng.permutation(values)) >= observed for _ in range(draws))) / (draws + 1))


def moran_test(blocks: PairBlocks, draws: int = 199, seed: int = 42) -> tuple[float, float]:
    """moran_p of locations in order of their keys: each block adds its part to the statistic of every permutation.

    Tasks get keys, values and sums of weights of all locations (three numbers a location) and permute the values themselves.
    """
    per = blocks.lags().select("k", "v", "w").orderBy("k").toPandas()
    if len(per) < 2:
        return np.nan, np.nan
    sent = blocks.places.sparkSession.sparkContext.broadcast((per["k"].to_numpy(), per["v"].to_numpy(float) - per["v"].mean(), per["w"].to_numpy(float)))

    def parts(x: pd.DataFrame, y: pd.DataFrame, km: np.ndarray, once: np.ndarray) -> pd.DataFrame:
        keys, z, total = sent.value
        i, j = (np.searchsorted(keys, s["k"].to_numpy()) for s in (x, y))
        rng, zx, zy = np.random.default_rng(seed), [z[i]], [z[j]]
        for _ in range(draws):
            p = rng.permutation(z)
            zx.append(p[i])
            zy.append(p[j])
        zx, zy = np.column_stack(zx), np.column_stack(zy)
        w = np.where(once, 1 / np.maximum(km, 1e-3), 0.0)
        w = w / total[i][:, None] + w / total[j]
        return pd.DataFrame({"draw": range(draws + 1), "s": (zx * (w @ zy)).sum(axis=0)})

    sums = blocks.map(parts, "draw int, s double").groupBy("draw").agg(F.sum("s").alias("s")).orderBy("draw").toPandas()["s"].to_numpy()
    return float(sums[0] / (sent.value[1] ** 2).sum()), float((1 + (sums[1:] >= sums[0]).sum()) / (draws + 1))


def block_km(p: float, n: int, variance: float, alpha: float = 0.05, fallback_km: float = 5.0) -> float:
    """Size of resampling blocks: the fallback if values are spatially autocorrelated (p of moran_test), else 0."""
    return fallback_km if n >= 5 and variance > 0 and p < alpha else 0.0


def effective_n(blocks: PairBlocks, range_km: float, n: int) -> float:
    """n / (1 + (n - 1) x mean correlation) under exponential decay."""
    part = lambda x, y, km, once: pd.DataFrame({"s": [np.exp(-km[once] / range_km).sum()], "n": [int(once.sum())]})
    mean = blocks.map(part, "s double, n bigint").agg((F.sum("s") / F.nullif(F.sum("n"), F.lit(0))).alias("m")).first()["m"]
    return n / (1 + (n - 1) * (mean or 0.0))


def whittaker(y: np.ndarray, lam: float = 1600.0, order: int = 2) -> np.ndarray:
    """Smoothed values; missing ones are filled. All missing: all missing."""
    ok = np.isfinite(y)
    if not ok.any():
        return np.full(len(y), np.nan)
    if len(y) <= order:
        return np.where(ok, y, np.nanmean(y))
    d = np.diff(np.eye(len(y)), n=order, axis=0)
    return np.linalg.solve(np.diag(ok.astype(float)) + lam * d.T @ d + 1e-12 * np.eye(len(y)), np.where(ok, y, 0.0))


def smooth_traces(bins: DataFrame, last_bin: int = 36, lam: float = 1600.0) -> DataFrame:
    """location_id, py, index_name, values: the Whittaker curve of each trace over all bins; traces are packed whole into Arrow batches."""
    packed = bins.groupBy("location_id", "py", "index_name").agg(F.map_from_entries(F.collect_list(F.struct("bin", "value"))).alias("m"))
    wide = packed.select("location_id", "py", "index_name", F.transform(F.sequence(F.lit(1), F.lit(last_bin)), lambda b: F.try_element_at("m", b)).alias("y"))

    @F.pandas_udf("array<double>")
    def curve(y: pd.Series) -> pd.Series:
        return pd.Series([whittaker(np.array([np.nan if v is None else v for v in row], float), lam).tolist() for row in y])

    return wide.select("location_id", "py", "index_name", curve("y").alias("values"))


def area_correction(mapped: DataFrame, counts: DataFrame, keys: list[str]) -> DataFrame:
    """Area shares corrected by a count matrix of mapped against true classes: keys, veg, adjusted, se, low, high.

    mapped: keys, veg, share; counts: mapped, actual, n. Classes without counts pass through unchanged.
    """
    total = counts.groupBy("mapped").agg(F.sum("n").alias("t"))
    q = counts.join(total, "mapped").select("mapped", "actual", (F.col("n") / F.col("t")).alias("q"), "t")
    joined = mapped.join(F.broadcast(q) if q.limit(100_001).count() <= 100_000 else q, F.col("veg") == F.col("mapped"), "left")
    w, p = F.col("share"), F.col("q")
    actual = F.coalesce("actual", "veg")
    out = joined.groupBy(*keys, actual.alias("veg")).agg(F.sum(F.coalesce(w * p, w)).alias("adjusted"), F.sqrt(F.sum(F.coalesce(w * w * p * (1 - p) / F.nullif(F.col("t") - 1, F.lit(0)), F.lit(0.0)))).alias("se"))
    low, high = F.greatest(F.col("adjusted") - 1.96 * F.col("se"), F.lit(0.0)), F.least(F.col("adjusted") + 1.96 * F.col("se"), F.lit(1.0))
    return out.withColumns({"low": low, "high": high})


