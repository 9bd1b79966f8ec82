"""Implausible readings: robust exponentially weighted control charts with run-length counters and physical limits.

A series is one band of one source in time order. Its seasonal course (two harmonics, fitted robustly) is taken off; a chart then
follows level and scale. A suspected reading is clipped to the control limit before it updates either, so a spike moves
neither; after three suspected readings in a row on one side the chart restarts at their median, because that is a real change.
The chart runs in both directions of time: a spike stands off from what came before and from what comes after, by more than ``spike`` times
the chart's scale at that time in both, a lasting change only from one of them, and a run-length counter drops departures of more than two readings.

Course and ordinary scatter of a source are computed from sums and from histograms of fixed bins only, so a long source is fitted once, by partial sums of all tasks,
and its slices get the result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from reedbed.operators.skew import hot_keys, is_short, join_key_stats
from reedbed.session import materialise

LEVEL_WEIGHT, SCALE_WEIGHT, CLIP, RESTART = 0.15, 0.04, 3.5, 3
STUCK_RUN = 6
#: Records of a slice of a long series; an eighth of that is lent to either neighbour as warm-up.
SLICE, LENT = 4_000, 500
#: Fits of the course; bins of values (steps of 1/GRID) and of sizes of residuals (factors of RATIO from SMALLEST to 1).
FITS, GRID, SMALLEST, RATIO = 5, 1000, 1e-5, 1.02
SIZES = int(np.ceil(np.log(1 / SMALLEST) / np.log(RATIO))) + 1
TERMS = 5
#: Numbers kept of a series: centre, course, scale of the residuals, scatter.
KEPT = TERMS + 3


def _harmonics(day: np.ndarray) -> np.ndarray:
    t = 2 * np.pi * day / 365.2425
    return np.column_stack([np.ones_like(t), np.cos(t), np.sin(t), np.cos(2 * t), np.sin(2 * t)])


def _group_median(group: np.ndarray, value: np.ndarray, groups: int) -> np.ndarray:
    """Median of each group (numbers 0 to groups - 1); NaN where empty."""
    order = np.lexsort((value, group))
    n = np.bincount(group, minlength=groups)
    start = np.cumsum(n) - n
    v = np.append(value[order], np.nan)
    lo, hi = start + np.maximum(n - 1, 0) // 2, start + n // 2
    return np.where(n > 0, (v[np.minimum(lo, len(value))] + v[np.minimum(hi, len(value))]) / 2, np.nan)


def _size_bin(r: np.ndarray) -> np.ndarray:
    return np.minimum(np.log(np.maximum(np.abs(r), SMALLEST) / SMALLEST) / np.log(RATIO), SIZES - 1).astype(np.int64)


def _size(bin_: np.ndarray) -> np.ndarray:
    """Middle of a bin of sizes."""
    return SMALLEST * RATIO ** (bin_ + 0.5)


def _binned_sizes(r: np.ndarray) -> np.ndarray:
    return _size(_size_bin(r))


def _median_of_counts(value: np.ndarray, count: np.ndarray) -> float:
    """Median of ascending values that occur ``count`` times; NaN without any."""
    upto, n = np.cumsum(count), int(count.sum())
    return float((value[np.searchsorted(upto, (n - 1) // 2, "right")] + value[np.searchsorted(upto, n // 2, "right")]) / 2) if n else np.nan


def _weights(r: np.ndarray, scale: np.ndarray) -> np.ndarray:
    return 1 / np.maximum(1.0, (np.abs(r) / (2 * scale)) ** 2)


_PAIRS = [(i, j) for i in range(TERMS) for j in range(i, TERMS)]


def _course(sums: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Coefficients (rows x TERMS) from weighted sums (rows x products of terms, then terms x value); ridge-stabilised, a level only below 12 readings."""
    gram = np.empty((len(sums), TERMS, TERMS))
    for k, (i, j) in enumerate(_PAIRS):
        gram[:, i, j] = gram[:, j, i] = sums[:, k]
    ridge = np.eye(TERMS) * np.where(np.arange(TERMS) == 0, 1e-6, 1.0)
    beta = np.linalg.solve(gram + ridge, sums[:, len(_PAIRS) :, None])[:, :, 0]
    beta[n < 12] *= np.arange(TERMS) == 0
    return beta


def _products(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> Iterator[np.ndarray]:
    """The summands of _course."""
    for i, j in _PAIRS:
        yield w * x[:, i] * x[:, j]
    for i in range(TERMS):
        yield w * x[:, i] * y


def _scatter(steps: np.ndarray, spread: np.ndarray) -> np.ndarray:
    """Ordinary scatter from the median differences of neighbours, which lasting changes leave alone, and from the median residual; the smaller."""
    ordinary = np.fmin(1.1 * 1.4826 / np.sqrt(2) * steps, 1.4826 * spread)
    return np.maximum(np.where(np.isfinite(ordinary), ordinary, 0), 1e-4)


def _fitted(series: np.ndarray, day: np.ndarray, value: np.ndarray, groups: int) -> np.ndarray:
    """centre, course, scale and scatter of whole series (groups x KEPT)."""
    x, n = _harmonics(day), np.bincount(series, minlength=groups)
    grid = np.rint(value * GRID) / GRID
    centre = _group_median(series, grid, groups)
    scale = 1.4826 * _group_median(series, np.abs(grid - centre[series]), groups) + 1e-6
    y, beta = value - centre[series], np.zeros((groups, TERMS))
    for _ in range(FITS):
        r = y - (x * beta[series]).sum(axis=1)
        sums = np.column_stack([np.bincount(series, p, groups) for p in _products(x, y, _weights(r, scale[series]))])
        scale = 1.4826 * _group_median(series, _binned_sizes(r), groups) + 1e-6
        beta = _course(sums, n)
    r = y - (x * beta[series]).sum(axis=1)
    inner = series[1:] == series[:-1]
    steps = _group_median(series[1:][inner], _binned_sizes(np.diff(r))[inner], groups) if inner.any() else np.full(groups, np.nan)
    return np.column_stack([centre, beta, scale, _scatter(steps, _group_median(series, _binned_sizes(r), groups))])


def _residual(day: np.ndarray, value: np.ndarray, kept: np.ndarray) -> np.ndarray:
    """Value less the course of its series; kept: a row a reading."""
    return value - kept[:, 0] - (_harmonics(day) * kept[:, 1 : 1 + TERMS]).sum(axis=1)


def _chart(z: np.ndarray, length: np.ndarray, scale0: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Departure of each reading from the level before it over the scale before it, and the number of suspected readings in a row on its side so far.

    z: time x series, series sorted by length, longest first.
    """
    steps, width = z.shape
    out, counts = np.zeros_like(z), np.zeros_like(z)
    head = np.where(np.arange(min(steps, 9))[:, None] < length[None, :], z[:9], np.nan)
    level = np.nanmedian(head, axis=0)
    scale, floor = scale0.copy(), 0.5 * scale0
    run, side = np.zeros(width), np.zeros(width)
    last1, last2 = level.copy(), level.copy()
    alive = np.searchsorted(-length, -np.arange(steps), side="left")  # series longer than t
    for t in range(steps):
        m = alive[t]
        v, s = z[t, :m], scale[:m]
        d = v - level[:m]
        u = d / s
        out[t, :m] = u
        clipped = np.clip(u, -CLIP, CLIP)
        far = np.abs(u) > CLIP
        sign = np.sign(u)
        run[:m] = np.where(far, np.where(sign == side[:m], run[:m] + 1, 1), 0)
        side[:m] = np.where(far, sign, 0)
        counts[t, :m] = run[:m]
        level[:m] += LEVEL_WEIGHT * clipped * s * np.where(far, 0.5, 1.0)
        var = (1 - SCALE_WEIGHT) * s**2 + SCALE_WEIGHT * (np.minimum(np.abs(clipped), 2.5) * s) ** 2 * 1.06
        scale[:m] = np.clip(np.sqrt(var), floor[:m], 3 * scale0[:m])
        again = run[:m] >= RESTART
        if again.any():
            i = np.flatnonzero(again)
            level[i] = np.median(np.stack([v[i], last1[i], last2[i]]), axis=0)
            run[i] = 0
        last2[:m], last1[:m] = last1[:m], v
    return out, counts


def _runs(series: np.ndarray, value: np.ndarray, usable: np.ndarray) -> np.ndarray:
    """Length of the run of equal usable values in a row that each record belongs to; 0 for unusable ones."""
    if not len(value):
        return np.zeros(0, dtype=np.int64)
    new = np.ones(len(value), dtype=bool)
    new[1:] = (series[1:] != series[:-1]) | ~usable[1:] | ~usable[:-1] | (value[1:] != value[:-1])
    number = np.cumsum(new) - 1
    return np.where(usable, np.bincount(number)[number], 0)


def _plausible(value: np.ndarray) -> np.ndarray:
    return np.isfinite(value) & (value >= 0) & (value <= 1)


def _prepared(series: np.ndarray, day: np.ndarray, value: np.ndarray, given: np.ndarray | None) -> dict | None:
    """Residuals and ordinary scatter of the plausible readings of each series; None if there are none.

    given: what was fitted before, a row a series, NaN in those to be fitted here."""
    at = np.flatnonzero(_plausible(value))
    if not len(at):
        return None
    group, first = np.unique(series[at], return_index=True)
    g = np.searchsorted(group, series[at])
    kept = np.full((len(group), KEPT), np.nan) if given is None else given[group].copy()
    new = np.isnan(kept[:, 0])
    if new.any():
        number = np.cumsum(new) - 1
        own = new[g]
        kept[new] = _fitted(number[g[own]], day[at[own]], value[at[own]], int(new.sum()))
    return {"at": at, "g": g, "first": first, "n": np.diff(np.append(first, len(at))), "resid": _residual(day[at], value[at], kept[g]), "ordinary": kept[:, -1]}


def judge(series: np.ndarray, day: np.ndarray, values: list[np.ndarray], spike: float, given: np.ndarray | None = None) -> list[np.ndarray]:
    """Flags of the records of whole series in time order, for each band: 0 none, 1 impossible, 2 stuck, 3 spike.

    series: numbers from 0, ascending; given: series x bands x KEPT, see _prepared. A null, NaN or infinite value is no reading.
    """
    flags, ready = [], []
    for i, value in enumerate(values):
        finite, plausible = np.isfinite(value), _plausible(value)
        f = np.where(finite & ~plausible, 1, 0).astype(np.int8)
        f[_runs(series, value, plausible) >= STUCK_RUN] = 2
        flags.append(f)
        ready.append(_prepared(series, day, value, None if given is None else given[:, i]))
    offset, total = [], 0
    for r in ready:  # the series of all bands are columns of one chart
        offset.append(total)
        total += len(r["n"]) if r else 0
    if not total:
        return flags
    n = np.concatenate([r["n"] for r in ready if r])
    ordinary = np.concatenate([r["ordinary"] for r in ready if r])
    g = np.concatenate([r["g"] + o for r, o in zip(ready, offset, strict=True) if r])
    t = np.concatenate([np.arange(len(r["at"])) - r["first"][r["g"]] for r in ready if r])
    resid = np.concatenate([r["resid"] for r in ready if r])
    by_length = np.argsort(-n, kind="stable")
    place = np.empty(total, dtype=np.int64)
    place[by_length] = np.arange(total)
    both = []
    for back in (False, True):
        z = np.zeros((int(n.max()), total))
        row = n[g] - 1 - t if back else t
        z[row, place[g]] = resid
        d, counts = _chart(z, n[by_length], ordinary[by_length])
        both.append((d[row, place[g]], counts[row, place[g]]))
    (ahead, run_before), (behind, run_after) = both
    off = np.where(np.sign(ahead) == np.sign(behind), np.minimum(np.abs(ahead), np.abs(behind)), 0.0)
    out = (off > spike) & (n[g] >= 5)
    # The run that a reading belongs to, as the counters of both directions see it: the third of five is no spike.
    short = out & (run_before + run_after - 1 <= 2) & (_runs(g, np.where(out, np.sign(ahead), 0.0), out) <= 2)
    start = 0
    for f, r in zip(flags, ready, strict=True):
        if r:
            at, hit = r["at"], short[start : start + len(r["at"])]
            f[at[hit & (f[at] == 0)]] = 3
            start += len(at)
    return flags


def _sliced(rows: DataFrame, slice_rows: int, lent: int) -> DataFrame:
    """_slice, _core, src, t, rid and bands: the records of long series, each once, in slices of slice_rows in time order with ``lent`` records of either neighbour.

    Records are ranked by a range partition of source and time, so neither a source nor an instant is gathered anywhere.
    """
    ordered = rows.dropDuplicates(["src", "t", "rid"]).repartitionByRange("src", "t", "rid").sortWithinPartitions("src", "t", "rid")
    ordered = materialise(ordered.withColumn("_p", F.spark_partition_id()).withColumn("_i", F.monotonically_increasing_id()), "ordered")
    runs = ordered.groupBy("src", "_p").agg(F.min("_i").alias("_first"), F.count(F.lit(1)).alias("_m"))
    by = Window.partitionBy("src").orderBy("_p")  # a row a partition that holds the source
    runs = runs.withColumn("_before", F.sum("_m").over(by) - F.col("_m")).withColumn("_n", F.sum("_m").over(Window.partitionBy("src")))
    runs = materialise(runs.select("src", "_p", "_first", "_before", "_n"), "runs")
    rank = F.col("_i") - F.col("_first") + F.col("_before")
    placed = ordered.join(F.broadcast(runs) if is_short(runs) else runs, ["src", "_p"])
    own, at, last = F.floor(rank / slice_rows).cast("int"), rank % slice_rows, F.floor((F.col("_n") - 1) / slice_rows).cast("int")
    slices = F.array_compact(F.array(own, F.when((at >= slice_rows - lent) & (own < last), own + 1), F.when((at < lent) & (own > 0), own - 1)))
    return placed.withColumn("_own", own).withColumn("_slice", F.explode(slices)).withColumn("_core", F.col("_slice") == F.col("_own")).drop("_p", "_i", "_first", "_before", "_n", "_own")


def _with_kept(rows: DataFrame, kept: DataFrame) -> DataFrame:
    """rows with what is known of their source in the column kept."""
    return rows.join(F.broadcast(kept.drop("_n")), "src") if is_short(kept) else join_key_stats(rows, kept, ["src"], "_n").drop("_n")


def _slots(names: np.ndarray, band: int, src: np.ndarray, slot: np.ndarray, value: np.ndarray | None, width: int) -> pd.DataFrame:
    """Sums by source (its number in src) and slot; sums of 0 are left out."""
    total = np.bincount(src * width + slot, value, minlength=0)
    at = np.flatnonzero(total)
    return pd.DataFrame({"src": names[at // width], "band": band, "slot": at % width, "s": total[at].astype(float)})


def _fitted_sources(sliced: DataFrame, bands: int) -> DataFrame:
    """src, kept (bands x KEPT numbers) and _n of each source of _sliced: the steps of _fitted, each a sum over all slices."""
    columns = [f"b{i}" for i in range(bands)]
    core = sliced.where("_core").select("src", "t", *columns)

    def summed(rows: DataFrame, work: Callable[[np.ndarray, pd.DataFrame], Iterator[pd.DataFrame]], by_slice: bool = False) -> DataFrame:
        schema = "src string, band int, slot int, s double"

        def batch(pdf: pd.DataFrame) -> pd.DataFrame:
            src, names = pd.factorize(pdf["src"])
            parts = list(work(src, pdf))
            out = pd.concat(parts) if parts else pd.DataFrame({"src": [], "band": [], "slot": [], "s": []})
            return out.assign(src=names.to_numpy(object)[out["src"].to_numpy(int)]).astype({"band": "int32", "slot": "int32"})

        said = rows.groupBy("src", "_slice").applyInPandas(batch, schema) if by_slice else rows.mapInPandas(lambda batches: (batch(p) for p in batches if len(p)), schema)
        return said.groupBy("src", "band", "slot").agg(F.sum("s").alias("s"))

    def solved(sums: DataFrame, of: Callable[[int, np.ndarray, np.ndarray, np.ndarray | None], np.ndarray], before: DataFrame | None = None) -> DataFrame:
        """kept of each source from its sums: at most bands x slots rows a source."""
        held = sums.groupBy("src").agg(F.collect_list(F.struct("band", "slot", "s")).alias("sums"))
        joined = held.join(before, "src") if before is not None else held.withColumn("kept", F.lit(None).cast("array<double>")).withColumn("_n", F.lit(0).cast("bigint"))

        def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                out, count = [], []
                for sums_, kept, n in zip(pdf["sums"], pdf["kept"], pdf["_n"], strict=True):
                    band, slot, s = (np.array([r[c] for r in sums_]) for c in ("band", "slot", "s"))
                    old = np.full((bands, KEPT), np.nan) if kept is None else np.array(kept, float).reshape(bands, KEPT)
                    for i in range(bands):
                        at = band == i
                        if at.any():
                            order = np.argsort(slot[at])
                            old[i] = of(i, slot[at][order], s[at][order], old[i])
                    out.append(old.ravel())
                    count.append(int(n) or int(max(s[(slot <= GRID) & (band == i)].sum() for i in range(bands))))
                yield pd.DataFrame({"src": pdf["src"], "kept": out, "_n": count})

        return materialise(joined.mapInPandas(work, "src string, kept array<double>, _n bigint"), "kept")

    def values(src: np.ndarray, pdf: pd.DataFrame) -> Iterator[pd.DataFrame]:
        for i, c in enumerate(columns):
            v = pdf[c].to_numpy(float)
            ok = _plausible(v)
            yield _slots(np.arange(src.max() + 1), i, src[ok], np.rint(v[ok] * GRID).astype(np.int64), None, GRID + 1)

    def start(i: int, slot: np.ndarray, s: np.ndarray, old: np.ndarray) -> np.ndarray:
        v = slot / GRID
        centre = _median_of_counts(v, s)
        off = np.abs(v - centre)
        order = np.argsort(off, kind="stable")
        return np.concatenate([[centre], np.zeros(TERMS), [1.4826 * _median_of_counts(off[order], s[order]) + 1e-6, np.nan]])

    def numbers(src: np.ndarray, pdf: pd.DataFrame) -> Iterator[pd.DataFrame]:
        kept = np.array([np.asarray(k, float) for k in pdf["kept"]]).reshape(len(pdf), bands, KEPT)
        day, every = pdf["t"].to_numpy() / 86_400e6, np.arange(src.max() + 1)
        for i, c in enumerate(columns):
            v = pdf[c].to_numpy(float)
            ok = _plausible(v)
            own, k = src[ok], kept[ok, i]
            r = _residual(day[ok], v[ok], k)
            yield _slots(every, i, own, _size_bin(r), None, SIZES)
            for j, p in enumerate(_products(_harmonics(day[ok]), v[ok] - k[:, 0], _weights(r, k[:, TERMS + 1]))):
                yield _slots(every, i, own, np.full(len(own), SIZES + j), p, SIZES + j + 1)

    def step(i: int, slot: np.ndarray, s: np.ndarray, old: np.ndarray) -> np.ndarray:
        sizes = slot < SIZES
        sums = np.zeros((1, len(_PAIRS) + TERMS))
        sums[0, slot[~sizes] - SIZES] = s[~sizes]
        scale = 1.4826 * _median_of_counts(_size(slot[sizes]), s[sizes]) + 1e-6
        return np.concatenate([old[:1], _course(sums, np.array([s[sizes].sum()]))[0], [scale, np.nan]])

    def departures(src: np.ndarray, pdf: pd.DataFrame) -> Iterator[pd.DataFrame]:
        pdf = pdf.sort_values(["t", "rid"])
        core, kept = pdf["_core"].to_numpy(bool), np.asarray(pdf["kept"].iloc[0], float).reshape(bands, KEPT)
        day, one = pdf["t"].to_numpy() / 86_400e6, np.arange(1)
        for i, c in enumerate(columns):
            v = pdf[c].to_numpy(float)
            ok = _plausible(v)
            if ok.any():
                r, own = _residual(day[ok], v[ok], kept[i][None]), core[ok]
                yield _slots(one, i, np.zeros(own.sum(), np.int64), _size_bin(r[own]), None, 2 * SIZES)
                steps = _size_bin(np.diff(r)[own[1:]])
                yield _slots(one, i, np.zeros(len(steps), np.int64), SIZES + steps, None, 2 * SIZES)

    def scatter(i: int, slot: np.ndarray, s: np.ndarray, old: np.ndarray) -> np.ndarray:
        near, far = slot < SIZES, slot >= SIZES
        spread, steps = _median_of_counts(_size(slot[near]), s[near]), _median_of_counts(_size(slot[far] - SIZES), s[far])
        return np.append(old[:-1], _scatter(np.array([steps]), np.array([spread])))

    kept = solved(summed(core, values), start)
    for _ in range(FITS):
        kept = solved(summed(_with_kept(core, kept), numbers), step, kept)
    return solved(summed(_with_kept(sliced, kept), departures, by_slice=True), scatter, kept)


def flag_readings(
    df: DataFrame, source: str, at: str, row_id: str, bands: list[str], spike: float = 5.0, slice_rows: int = SLICE, rows_per_task: int = 60_000
) -> DataFrame:
    """Flagged readings: row_id, band, reason ('impossible', 'stuck' or 'spike').

    Records with a null source or time are left out; repeated deliveries (same row_id) count once; records at the same instant
    are ordered by row_id. impossible: finite and below 0 or above 1. stuck: in a run of at least six records in a row with
    the same value within 0 to 1; any other value, null included, ends the run. spike: see the module; only values within 0 to 1,
    at most two readings in a row, off by more than ``spike`` scales of the chart. A series of fewer than five readings has no spikes;
    an empty table gives no rows.

    A source with more than ``slice_rows`` records is cut in time, with a warm-up of an eighth of a slice from either side. Its course and scatter are those of the whole source; level and scale of a chart
    depend on the records of the last few hundred steps, so the flags do not depend on the cuts.
    """
    rows = df.where(F.col(source).isNotNull() & F.col(at).isNotNull()).select(
        F.col(source).cast("string").alias("src"), F.unix_micros(F.col(at).cast("timestamp")).alias("t"), F.col(row_id).alias("rid"), *[F.col(b).cast("double").alias(f"b{i}") for i, b in enumerate(bands)]
    )
    long = materialise(hot_keys(rows, ["src"], slice_rows).select("src", "_n"), "long")
    ordinary, sliced = rows.select("*", F.lit(0).alias("_slice"), F.lit(True).alias("_core")), None
    if not long.isEmpty():
        names = F.broadcast(long.select("src")) if is_short(long) else long.select("src")
        sliced = materialise(_sliced(rows.join(names, "src", "left_semi"), slice_rows, max(STUCK_RUN, slice_rows * LENT // SLICE)), "slices")
        sliced, ordinary = _with_kept(sliced, _fitted_sources(sliced, len(bands))), ordinary.join(names, "src", "left_anti")
    tasks = max(1, -(-rows.count() // rows_per_task))

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.drop_duplicates(["src", "_slice", "rid"])
        names = pd.factorize(pdf["src"])[0].astype(np.int64)
        key = names * (int(pdf["_slice"].max()) + 1 if len(pdf) else 1) + pdf["_slice"].to_numpy(np.int64)
        order = np.lexsort((pdf["rid"].to_numpy(), pdf["t"].to_numpy(), key))
        first, series = np.unique(key[order], return_index=True, return_inverse=True)[1:]
        day = pdf["t"].to_numpy()[order] / 86_400e6
        core, rid = pdf["_core"].to_numpy(bool)[order], pdf["rid"].to_numpy()[order]
        given = np.full((len(first), len(bands), KEPT), np.nan)
        if "kept" in pdf:
            given[:] = np.stack([np.asarray(k, float) for k in pdf["kept"].to_numpy(object)[order[first]]]).reshape(given.shape)
        found = []
        values = [pdf[f"b{i}"].to_numpy(float)[order] for i in range(len(bands))]
        for band, flags in zip(bands, judge(series, day, values, spike, given), strict=True):
            hit = np.flatnonzero(core & (flags > 0))
            found.append(pd.DataFrame({row_id: rid[hit], "band": band, "reason": np.array(["", "impossible", "stuck", "spike"], dtype=object)[flags[hit]]}))
        return pd.concat(found)

    def flagged(part: DataFrame) -> DataFrame:
        keyed = part.withColumn("bucket", F.pmod(F.xxhash64("src", "_slice"), F.lit(tasks)).cast("int"))
        return keyed.repartition(tasks, "bucket").groupBy("bucket").applyInPandas(work, f"{row_id} bigint, band string, reason string")

    return flagged(ordinary) if sliced is None else flagged(ordinary).unionByName(flagged(sliced))
