"""Percentiles of very large numeric columns by group: distributed multi-select.

The values of a group lie in parts. In every round the parts propose the medians of what is still possible in them, the weighted median of the proposals becomes
the pivot, values below, equal to and above it are counted, and the ranges that cannot hold the wanted rank are discarded, until the value of
that rank is found. Every group goes through these rounds: one of at most BLOCK values within a task (``select``), a larger one over tasks, which exchange
only proposals and counts (``multi_select``); the state of the rounds is a table, nothing of it is at the driver but the number of open ranks.

The results are exact. For results that shall be combined later (single days, years, partitions), ``summarise`` keeps m values of a group at
equal distances of rank; ``combine`` merges such summaries with an error of at most 1/m of the rank.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from reedbed.operators.skew import is_short, join_key_stats, with_block
from reedbed.session import materialise

#: Values of a block, one part of a large group; parts of a group within a task; values that the last round of a rank takes to one task.
BLOCK, PART, LAST = 2048, 256, 512
#: States of so many groups are broadcast, those of more are joined by a shuffle.
SHORT_STATE = 4096


def _within(values: np.ndarray, start: np.ndarray, stop: np.ndarray, x: np.ndarray, right: bool) -> np.ndarray:
    """searchsorted of each x in its own sorted stretch of values."""
    lo, hi = start.copy(), stop.copy()
    while (open_ := lo < hi).any():
        mid = (lo + hi) // 2
        v = values[np.minimum(mid, len(values) - 1)]
        up = (v <= x) if right else (v < x)
        lo, hi = np.where(open_ & up, mid + 1, lo), np.where(open_ & ~up, mid, hi)
    return lo


def _weighted_medians(target: np.ndarray, value: np.ndarray, weight: np.ndarray, targets: int) -> np.ndarray:
    """Weighted median of the proposals of each target; NaN without proposals."""
    order = np.lexsort((value, target))
    t, w = target[order], weight[order]
    total = np.bincount(t, w, targets)
    upto = np.cumsum(w) - (np.cumsum(total) - total)[t]
    enough = np.flatnonzero(upto >= total[t] / 2)
    out = np.full(targets, np.nan)
    found, first = np.unique(t[enough], return_index=True)
    out[found] = value[order][enough[first]]
    return out


def select(groups: list[np.ndarray], wanted: list[np.ndarray], part: int = PART) -> list[np.ndarray]:
    """Values of the wanted ranks (from 0) of each group of values, by the rounds over parts of ``part`` values; all ranks of all groups at once."""
    sizes = np.array([len(g) for g in groups], dtype=np.int64)
    if not len(groups) or not sizes.sum():
        return [np.full(len(w), np.nan) for w in wanted]
    values = np.concatenate(groups).astype(float)
    parts = -(-sizes // part)
    first_part, first = np.cumsum(parts) - parts, np.cumsum(sizes) - sizes
    at = np.arange(len(values)) - np.repeat(first, sizes)
    block = np.repeat(first_part, sizes) + at // part
    values = values[np.lexsort((values, block))]
    stop = np.cumsum(np.bincount(block, minlength=int(parts.sum())))
    start = stop - np.diff(np.append(0, stop))
    counts = np.array([len(w) for w in wanted])
    rank = np.concatenate([np.asarray(w, dtype=np.int64) for w in wanted])
    of = np.repeat(np.arange(len(groups)), counts)
    target = np.repeat(np.arange(len(rank)), parts[of])
    own = first_part[of][target] + np.arange(len(target)) - np.repeat(np.cumsum(parts[of]) - parts[of], parts[of])
    a, b, found = start[own], stop[own], np.full(len(rank), np.nan)
    while len(target):
        keep = a < b
        target, a, b = target[keep], a[keep], b[keep]
        pivot = _weighted_medians(target, values[np.minimum((a + b) // 2, len(values) - 1)], (b - a).astype(float), len(rank))
        below, upto = _within(values, a, b, pivot[target], False), _within(values, a, b, pivot[target], True)
        low, equal = np.bincount(target, below - a, len(rank)), np.bincount(target, upto - below, len(rank))
        left, right = rank < low, rank >= low + equal
        hit = np.zeros(len(rank), dtype=bool)
        hit[target] = True
        hit &= ~left & ~right
        found[hit] = pivot[hit]
        rank = np.where(right, rank - (low + equal).astype(np.int64), rank)
        a, b = np.where(right[target], upto, a), np.where(left[target], below, b)
        going = ~hit[target]
        target, a, b = target[going], a[going], b[going]
    return np.split(found, np.cumsum(counts)[:-1])


def _selected(values: str, ranks: Column | str) -> Column:
    """select for each row."""
    return F.pandas_udf(lambda v, r: pd.Series(select(v.tolist(), r.tolist())), ArrayType(DoubleType()))(values, ranks)


def _blocks(df: DataFrame, groups: list[str], value: str, row_id: str, block: int) -> DataFrame:
    """groups, _block, _many (the group has several blocks), vals: each row_id once. One shuffle, on the block, which is bounded for every group."""
    v = F.col(value).cast("double")
    rows = df.where(v.isNotNull() & ~F.isnan(v)).select(*groups, v.alias("_v"), F.col(row_id).alias("_id"))
    placed = with_block(rows, groups, F.col("_id"), block)
    once = placed.repartition(*groups, "_block").groupBy(*groups, "_block", "_id").agg(F.min("_v").alias("_v"), F.min("_many").alias("_many"))
    return once.groupBy(*groups, "_block").agg(F.sort_array(F.collect_list("_v")).alias("vals"), F.min("_many").alias("_many"))


def _median_of(proposals: Column) -> Column:
    """Weighted median of an array of (v, w), lowest v with half of the weight at or below it."""
    real = F.array_sort(F.filter(proposals, lambda p: p["w"] > 0))
    half = F.aggregate(real, F.lit(0.0), lambda s, p: s + p["w"]) / 2
    start = F.struct(F.lit(0.0).alias("upto"), F.lit(None).cast("double").alias("v"))
    step = lambda s, p: F.struct((s["upto"] + p["w"]).alias("upto"), F.when(s["v"].isNull() & (s["upto"] + p["w"] >= half), p["v"]).otherwise(s["v"]).alias("v"))
    return F.aggregate(real, start, step)["v"]


def multi_select(blocks: DataFrame, wanted: DataFrame, last: int = LAST) -> DataFrame:
    """key, rank, value. blocks: key (string), vals (ascending); wanted: key, rank (from 0, below the number of values), n (values of the key).

    A round reads the blocks of open keys once: tasks send one proposal for either side and the counts of each open rank, and the next state is computed from
    their sums. Ranks with at most ``last`` possible values left are settled by ``select`` over these.
    """
    none = F.lit(None).cast("double")
    state = materialise(wanted.select("key", "rank", "n", F.lit(0).cast("bigint").alias("passed"), none.alias("lo"), none.alias("hi"), none.alias("pivot"), F.col("n").alias("left"), none.alias("value")), "ranks")
    while True:
        todo = state.where(F.col("value").isNull() & (F.col("left") > last))
        packed = todo.groupBy("key").agg(F.collect_list(F.struct("rank", "lo", "hi", "pivot")).alias("open"), F.max("n").alias("_n"))
        if packed.isEmpty():
            break
        said = _joined(blocks, packed).mapInPandas(_propose, "key string, rank bigint, below bigint, equal bigint, left double, n_left double, right double, n_right double")
        sides = {s: F.collect_list(F.struct(F.col(s).alias("v"), F.col(f"n_{s}").alias("w"))) for s in ("left", "right")}
        summed = said.groupBy("key", "rank").agg(F.sum("below").alias("below"), F.sum("equal").alias("equal"), *[sides[s].alias(f"p_{s}") for s in sides], *[F.sum(f"n_{s}").cast("bigint").alias(f"m_{s}") for s in sides])
        j = todo.join(summed, ["key", "rank"])
        first, hit = F.col("pivot").isNull(), (F.col("below") <= F.col("rank")) & (F.col("rank") < F.col("below") + F.col("equal"))
        up = ~first & (F.col("rank") >= F.col("below") + F.col("equal"))
        moved = j.select(
            "key", "rank", "n",
            F.when(up, F.col("below") + F.col("equal")).otherwise(F.col("passed")).alias("passed"),
            F.when(up, F.col("pivot")).otherwise(F.col("lo")).alias("lo"),
            F.when(~first & ~up & ~hit, F.col("pivot")).otherwise(F.col("hi")).alias("hi"),
            F.when(up, _median_of(F.col("p_right"))).otherwise(_median_of(F.col("p_left"))).alias("pivot"),
            F.when(up, F.col("m_right")).otherwise(F.col("m_left")).alias("left"),
            F.when(~first & hit, F.col("pivot")).alias("value"),
        )
        state = materialise(moved.unionByName(state.where(F.col("value").isNotNull() | (F.col("left") <= last))), "ranks")
    rest = state.where("value is null")
    packed = rest.groupBy("key").agg(F.collect_list(F.struct("rank", "lo", "hi", "pivot")).alias("open"), F.max("n").alias("_n"))
    held = _joined(blocks, packed).mapInPandas(_remaining, "key string, rank bigint, vals array<double>").groupBy("key", "rank").agg(F.flatten(F.collect_list("vals")).alias("vals"))
    settled = rest.join(held, ["key", "rank"]).select("key", "rank", F.get(_selected("vals", F.array(F.col("rank") - F.col("passed"))), F.lit(0)).alias("value"))
    return settled.unionByName(state.where("value is not null").select("key", "rank", "value"))


def _joined(blocks: DataFrame, packed: DataFrame) -> DataFrame:
    """Blocks of the keys that have open ranks, with these."""
    if is_short(packed, SHORT_STATE):
        return blocks.join(F.broadcast(packed.drop("_n")), "key")
    return join_key_stats(blocks, packed, ["key"], "_n").where("open is not null").drop("_n")


def _bounds(vals: np.ndarray, o: dict) -> tuple[int, int]:
    a = 0 if o["lo"] is None else int(np.searchsorted(vals, o["lo"], "right"))
    return a, len(vals) if o["hi"] is None else int(np.searchsorted(vals, o["hi"], "left"))


def _propose(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Counts and the proposals of a task for each open rank: the weighted median of the medians of its blocks, left and right of the pivot."""
    held: dict[tuple, list[tuple]] = {}

    def said() -> pd.DataFrame:
        targets = list(held)
        rows = np.array([r for t in targets for r in held[t]], dtype=float)
        of = np.repeat(np.arange(len(targets)), [len(held[t]) for t in targets])
        out = pd.DataFrame({"key": [t[0] for t in targets], "rank": [t[1] for t in targets]})
        for i, name in enumerate(("below", "equal")):
            out[name] = np.bincount(of, rows[:, i], len(targets)).astype("int64")
        for i, side in ((2, "left"), (4, "right")):
            some = rows[:, i + 1] > 0
            out[side] = _weighted_medians(of[some], rows[some, i], rows[some, i + 1], len(targets))
            out[f"n_{side}"] = np.bincount(of, rows[:, i + 1], len(targets))
        held.clear()
        return out

    for pdf in batches:
        for key, vals, ranks in zip(pdf["key"], pdf["vals"], pdf["open"], strict=True):
            vals = np.asarray(vals)
            for o in ranks:
                a, b = _bounds(vals, o)
                p = o["pivot"]
                below, equal = (b, b) if p is None else (int(np.searchsorted(vals, p, "left")), int(np.searchsorted(vals, p, "right")))
                left = vals[(a + below) // 2] if a < below else np.nan
                right = vals[(equal + b) // 2] if equal < b else np.nan
                held.setdefault((key, o["rank"]), []).append((below, equal - below, left, max(0, below - a), right, max(0, b - equal)))
        if len(held) > 20_000:
            yield said()
    if held:
        yield said()


def _remaining(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Values of each block that are still possible for the open ranks."""
    for pdf in batches:
        out = []
        for key, vals, ranks in zip(pdf["key"], pdf["vals"], pdf["open"], strict=True):
            vals = np.asarray(vals)
            for o in ranks:
                a, b = _bounds(vals, o)
                if a < b:
                    out.append((key, o["rank"], vals[a:b]))
        yield pd.DataFrame(out, columns=["key", "rank", "vals"])


def ranked(df: DataFrame, groups: list[str], value: str, row_id: str, ranks, block: int = BLOCK) -> DataFrame:
    """groups, n, ranks (ascending, from 0) and found (their values) of each group; ranks: the array of wanted ranks as an expression of n."""
    blocks = materialise(_blocks(df, groups, value, row_id, block), "blocks")
    n = F.size("vals").cast("bigint")
    single = blocks.where("not _many").select(*groups, n.alias("n"), "vals").withColumn("ranks", ranks(F.col("n"))).withColumn("found", _selected("vals", "ranks")).drop("vals")
    split = blocks.where("_many")
    if split.isEmpty():
        return single
    keyed = materialise(split.select(F.to_json(F.struct(*groups), {"ignoreNullFields": "false"}).alias("key"), *groups, "vals"), "split")
    sizes = materialise(keyed.groupBy("key").agg(*[F.first(g).alias(g) for g in groups], F.sum(F.size("vals")).cast("bigint").alias("n")).withColumn("ranks", ranks(F.col("n"))), "sizes")
    got = multi_select(keyed.select("key", "vals"), sizes.select("key", "n", F.explode(F.array_distinct("ranks")).alias("rank")))
    found = got.groupBy("key").agg(F.map_from_entries(F.collect_list(F.struct("rank", "value"))).alias("m"))
    several = sizes.join(found, "key").select(*groups, "n", "ranks", F.transform("ranks", lambda r: F.element_at("m", r)).alias("found"))
    return single.unionByName(several)


def percentiles(df: DataFrame, groups: list[str], value: str, row_id: str, quantiles: dict[str, float], block: int = BLOCK) -> DataFrame:
    """Exact percentiles of each group, linear between neighbouring ranks (the usual type 7).

    Null and NaN values are left out; repeated deliveries (same row_id) count once; a group without values has no row, groups with a null
    key form a group; infinite values are values; an empty table gives no rows. Columns: groups, n, one for each quantile,
    rank_error (the bound on the error of rank as a share of n: 0).
    """
    ends = lambda n, q: ((n - 1) * F.lit(q), F.floor((n - 1) * F.lit(q)), F.ceil((n - 1) * F.lit(q)))
    got = ranked(df, groups, value, row_id, lambda n: F.array(*[r.cast("bigint") for q in quantiles.values() for r in ends(n, q)[1:]]), block)

    def of(i: int, q: float) -> Column:
        h, lo, _ = ends(F.col("n"), q)
        a, b = F.get("found", F.lit(2 * i)), F.get("found", F.lit(2 * i + 1))
        return F.when(a == b, a).otherwise(a + (h - lo) * (b - a))

    return got.select(*groups, "n", *[of(i, q).alias(name) for i, (name, q) in enumerate(quantiles.items())], F.lit(0.0).alias("rank_error"))


def summarise(df: DataFrame, groups: list[str], value: str, row_id: str, points: int = 64, block: int = BLOCK) -> DataFrame:
    """Mergeable summary of each group: n, and ``points`` values at equal distances of rank (all values of a smaller group).

    Each kept value stands for the ranks from the previous one (excluded) to its own; ``weights`` are their numbers.
    Columns: groups, n, points (array), weights (array). Nulls and repeats as in ``percentiles``.
    """
    steps = lambda n: F.transform(F.sequence(F.lit(1), F.lit(points)), lambda i: F.ceil(i * n / points).cast("bigint") - 1)
    every = lambda n: F.sequence(F.lit(0).cast("bigint"), n - 1)
    got = ranked(df, groups, value, row_id, lambda n: F.when(n <= points, every(n)).otherwise(steps(n)), block)
    weights = F.transform("ranks", lambda r, i: r - F.when(i == 0, F.lit(-1).cast("bigint")).otherwise(F.get("ranks", i - 1)))
    return got.select(*groups, "n", F.col("found").alias("points"), weights.alias("weights"))


def combine(summaries: DataFrame, groups: list[str], quantiles: dict[str, float], points: int = 64) -> DataFrame:
    """Percentiles of the union of summaries: the smallest kept value with at least q x n of all weights at or below it.

    Its rank is off by at most rank_error x n, where rank_error = (sum of ceil(n_i / points) over the summaries that are not whole) / n.
    """
    from pyspark.sql import Window

    loose = F.when(F.col("n") > points, F.ceil(F.col("n") / points)).otherwise(0)
    totals = summaries.groupBy(*groups).agg(F.sum("n").alias("total"), F.sum(loose).alias("loose"))
    each = summaries.select(*groups, F.explode(F.arrays_zip("points", "weights")).alias("p")).groupBy(*groups, F.col("p.points").alias("v")).agg(F.sum("p.weights").alias("w"))
    order = Window.partitionBy(*groups).orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    heap = each.withColumn("upto", F.sum("w").over(order)).withColumn("all", F.sum("w").over(Window.partitionBy(*groups)))
    found = heap.groupBy(*groups).agg(*[F.min(F.when(F.col("upto") >= F.col("all") * q, F.col("v"))).alias(name) for name, q in quantiles.items()])
    joined = found.join(totals, groups)
    return joined.select(*groups, F.col("total").alias("n"), *quantiles, (F.col("loose") / F.col("total")).alias("rank_error"))
