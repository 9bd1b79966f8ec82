"""Exact percentiles by group that no group's size can break.

Spark's own exact percentile keeps every distinct value of a group in one task, which is right for small groups. In groups of more than LIMIT values
the range is cut into BUCKETS equal parts, whose values are counted with partial sums; each wanted rank lies in one of them, and
that part's smallest and largest value are the next range, until at most LIMIT values are left, which are then sorted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reedbed.operators.skew import is_short
from reedbed.session import materialise

LIMIT, BUCKETS = 200_000, 2048


def group_percentiles(df: DataFrame, groups: list[str], values: dict[str, Column | str], shares: list[float], also: dict[str, Column] | None = None, limit: int | None = None) -> DataFrame:
    """groups, and for each name of ``values`` a column <name> with its percentile, or <name>_0, <name>_1, ... for several ``shares``; linear between neighbouring ranks.

    Null and NaN values are left out, infinite ones count as the largest numbers; a group without values has nulls; null keys form a group; no groups: one row, also of an empty table. ``also``: further aggregates of the groups. ``limit``: see LIMIT.
    """
    limit = LIMIT if limit is None else limit
    names = list(values)
    largest = 1.7e308
    clean = lambda v: F.when(v.isNotNull() & ~F.isnan(v), F.greatest(F.least(v, F.lit(largest)), F.lit(-largest)))
    column = lambda v: (F.col(v) if isinstance(v, str) else v).cast("double")
    if also:
        df = materialise(df, "rows")  # read for the percentiles and for the other aggregates
        by = lambda d: d.withColumn("_g", F.struct(F.lit(0), *groups))
        left = by(group_percentiles(df, groups, values, shares, limit=limit))
        right = by(df.groupBy(*groups).agg(*[c.alias(n) for n, c in also.items()])).drop(*groups)
        return left.join(right, "_g").drop("_g")
    rows = materialise(df.select(*groups, *[clean(column(v)).alias(f"_v{i}") for i, v in enumerate(values.values())]), "values")
    label = lambda name, k: name if len(shares) == 1 else f"{name}_{k}"
    plain = lambda d: d.groupBy(*groups).agg(*[F.percentile(f"_v{i}", F.lit(q)).alias(label(n, k)) for i, n in enumerate(names) for k, q in enumerate(shares)])
    counts = rows.groupBy(*groups).agg(*[F.count(f"_v{i}").alias(f"_n{i}") for i in range(len(names))])
    big = materialise(counts.where(F.greatest(*[F.col(f"_n{i}") for i in range(len(names))], F.lit(0)) > limit).select(F.struct(F.lit(0), *groups).alias("_g"), F.monotonically_increasing_id().alias("_id"), *[f"_n{i}" for i in range(len(names))]), "large")
    if big.isEmpty():
        return plain(rows)
    keyed = rows.withColumn("_g", F.struct(F.lit(0), *groups))
    near = F.broadcast(big.select("_g", "_id")) if is_short(big) else big.select("_g", "_id")
    long = keyed.join(near, "_g").select("_id", F.posexplode(F.array(*[f"_v{i}" for i in range(len(names))])).alias("_c", "_v")).where("_v is not null")
    found = _ranked(materialise(long, "long"), big.select("_id", F.posexplode(F.array(*[f"_n{i}" for i in range(len(names))])).alias("_c", "_n")).where("_n > 0"), shares, limit)
    wide = found.groupBy("_id").agg(*[F.max(F.when(F.col("_c") == i, F.col(f"_p{k}"))).alias(label(n, k)) for i, n in enumerate(names) for k in range(len(shares))])
    large = wide.join(big.select("_id", "_g"), "_id").select(*[F.col(f"_g.{g}").alias(g) for g in groups], *[label(n, k) for n in names for k in range(len(shares))])
    return large if not groups else large.unionByName(plain(keyed.join(near.drop("_id"), "_g", "left_anti").drop("_g")))


def _ranked(long: DataFrame, sizes: DataFrame, shares: list[float], limit: int) -> DataFrame:
    """_id, _c, _p0, _p1, ...: percentiles of the values _v of each _id and _c (_n of them)."""
    key = ["_id", "_c"]
    hint = lambda d: F.broadcast(d) if is_short(d) else d
    place = lambda q: F.col("_n").cast("double") - 1 if q == 1 else (F.col("_n") - 1) * F.lit(q)
    ranks = F.array_distinct(F.array(*[r.cast("bigint") for q in shares for r in (F.floor(place(q)), F.ceil(place(q)))]))
    ends = long.groupBy(*key).agg(F.min("_v").alias("lo"), F.max("_v").alias("hi"))
    targets = sizes.select(*key, F.explode(ranks).alias("rank"), F.col("_n").alias("left")).join(ends, key).withColumn("passed", F.lit(0).cast("bigint"))
    targets, first = materialise(targets, "targets"), True
    while not (todo := targets.where((F.col("left") > limit) & (F.col("lo") < F.col("hi")))).isEmpty():
        # The first range is the same for all ranks of a group: its buckets are counted once.
        ranges = todo.select(*key, "lo", "hi").distinct() if first else todo.select(*key, "rank", "lo", "hi")
        by = key if first else [*key, "rank"]
        inside = long.join(hint(ranges), key).where(F.col("_v").between(F.col("lo"), F.col("hi")))
        bucket = F.least(F.floor((F.col("_v") / 2 - F.col("lo") / 2) / (F.col("hi") / 2 - F.col("lo") / 2) * BUCKETS), F.lit(BUCKETS - 1))
        counted = inside.groupBy(*by, bucket.alias("b")).agg(F.count(F.lit(1)).alias("m"), F.min("_v").alias("a"), F.max("_v").alias("z"))
        counted = counted.withColumn("upto", F.sum("m").over(Window.partitionBy(*by).orderBy("b")))
        hit = todo.drop("lo", "hi", "left").join(counted, by).where((F.col("rank") - F.col("passed") < F.col("upto")) & (F.col("rank") - F.col("passed") >= F.col("upto") - F.col("m")))
        moved = hit.select(*key, "rank", F.col("m").alias("left"), F.col("a").alias("lo"), F.col("z").alias("hi"), (F.col("passed") + F.col("upto") - F.col("m")).alias("passed"))
        targets, first = materialise(moved.unionByName(targets.where((F.col("left") <= limit) | (F.col("lo") == F.col("hi")))), "targets"), False
    open_ = targets.where("lo < hi")
    held = long.join(hint(open_), key).where(F.col("_v").between(F.col("lo"), F.col("hi"))).groupBy(*key, "rank").agg(F.sort_array(F.collect_list("_v")).alias("vals"), F.first("passed").alias("passed"))
    settled = held.select(*key, "rank", F.get("vals", (F.col("rank") - F.col("passed")).cast("int")).alias("value")).unionByName(targets.where("lo = hi").select(*key, "rank", F.col("lo").alias("value")))
    m = settled.groupBy(*key).agg(F.map_from_entries(F.collect_list(F.struct("rank", "value"))).alias("m")).join(sizes, key)
    at = lambda r: F.element_at("m", r.cast("bigint"))

    def of(q: float) -> Column:
        a, b = at(F.floor(place(q))), at(F.ceil(place(q)))
        return F.when(a == b, a).otherwise(a + (place(q) - F.floor(place(q))) * (b - a))

    return m.select(*key, *[of(q).alias(f"_p{k}") for k, q in enumerate(shares)])
