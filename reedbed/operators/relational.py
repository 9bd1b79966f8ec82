"""Joins, aggregates, windows and reshaping of observation and coefficient tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reedbed.functions.numeric import ratio
from reedbed.operators.harmonise import affine_column
from reedbed.operators.ranks import group_percentiles
from reedbed.operators.resample import uniform
from reedbed.session import materialise


def sensor_pairs(df: DataFrame, bands: list[str], keys: tuple[str, ...] = ("location_id", "date")) -> DataFrame:
    """Readings of the older and the newer sensor family at the same place on the same day, all combinations of such readings.

    Both sides are partitioned by place and day, so a hot place is spread over its days.
    """
    side = lambda name, end: df.where(F.col("satellite") == name).select(*keys, *[F.col(b).alias(f"{b}_{end}") for b in bands])
    return side("LANDSAT_457", "457").join(side("LANDSAT_89", "89"), list(keys), "inner")


def melt_pairs(pairs: DataFrame, bands: list[str], keep: list[str]) -> DataFrame:
    """keep, band, val_457, val_89: one row for each band of a pair."""
    rows = F.array(*[F.struct(F.lit(b).alias("band"), F.col(f"{b}_457").alias("val_457"), F.col(f"{b}_89").alias("val_89")) for b in bands])
    return pairs.select(*keep, F.inline(rows))


def melt(df: DataFrame, columns: list[str], keep: list[str], name: str = "band", value: str = "value") -> DataFrame:
    """One row for each of the columns."""
    return df.unpivot(keep, columns, name, value)


def fill_class(df: DataFrame, places: DataFrame) -> DataFrame:
    """Missing or blank class from the location dimension; its latitude replaces the row's."""
    p = places.select("location_id", F.col("lat").alias("_lat"), F.col("veg").alias("_veg"))
    joined = df.join(p, "location_id", "left")
    return joined.withColumns({"veg": F.coalesce(F.when(F.trim("veg") != "", F.col("veg")), F.col("_veg")), "lat": F.col("_lat")}).drop("_lat", "_veg")


def densify(df: DataFrame, key: str, season: str, label: str, value: str) -> DataFrame:
    """Sum for every combination of key, season and label that occur at all; 0 where there is none.

    The seasons and labels are few (their combinations are broadcast behind a check); the keys are only expanded, never joined with each other.
    """
    sums = df.groupBy(key, season, label).agg(F.sum(value).alias(value))
    grid = df.select(season).distinct().crossJoin(df.select(label).distinct())
    bound = 100_000
    if grid.limit(bound + 1).count() <= bound:
        grid = F.broadcast(grid)
    return df.select(key).distinct().crossJoin(grid).join(sums, [key, season, label], "left").fillna(0.0, [value])


def lag_join(series: DataFrame, water: DataFrame, low: int = -2, high: int = 3, season: str = "py", year: str = "year") -> DataFrame:
    """Every season with the water year it follows by each lag: season = year + lag. Positive lags mean that the water comes first."""
    lagged = water.withColumn("lag", F.explode(F.sequence(F.lit(low), F.lit(high)))).withColumn(season, F.col(year) + F.col("lag"))
    return series.join(lagged, season)


def bias_stats(pairs: DataFrame, groups: list[str]) -> DataFrame:
    """n, median, sd, rmse, mae, r2 and se of val_89 - val_457 by group; no r2 below three pairs or where a side does not vary (sd up to 1e-9)."""
    d = F.col("val_89") - F.col("val_457")
    ok = pairs.where(d.isNotNull())
    moves = (F.count(F.lit(1)) >= 3) & (F.stddev_samp("val_457") > 1e-9) & (F.stddev_samp("val_89") > 1e-9)
    corr = F.corr("val_457", "val_89")
    return group_percentiles(ok, groups, {"median_bias": d}, [0.5], also={
        "n": F.count(F.lit(1)), "sd_bias": F.stddev_samp(d), "rmse": F.sqrt(F.avg(d * d)), "mae": F.avg(F.abs(d)), "r2": F.when(moves, corr * corr), "se": F.stddev_samp(d) / F.sqrt(F.count(F.lit(1)))})


def raw_and_corrected(df: DataFrame, bands: list[str], terms: dict) -> DataFrame:
    """Mean of each band by year and sensor before and after the sensor correction."""
    keep = ["year", "satellite"]
    raw = melt(df.select(*keep, *bands), bands, keep).withColumn("correction", F.lit("raw"))
    fixed = melt(df.select(*keep, *[affine_column(b, terms).alias(b) for b in bands]), bands, keep).withColumn("correction", F.lit("corrected"))
    return raw.unionByName(fixed).groupBy(*keep, "band", "correction").agg(F.avg("value").alias("value"), F.count("value").alias("n"))


def bin_means(df: DataFrame, indices: list[str]) -> DataFrame:
    """location_id, py, index_name, bin, value: mean by ten-day bin; bin 37 is left out."""
    long = melt(df.where(F.col("bin") < 37).select("location_id", "py", "bin", *indices), indices, ["location_id", "py", "bin"], "index_name", "v")
    return long.where("v is not null").groupBy("location_id", "py", "index_name", "bin").agg(F.avg("v").alias("value"))


def fill_bins(bins: DataFrame, traces: DataFrame | None = None, indices: list[str] | None = None, last_bin: int = 36) -> DataFrame:
    """Every bin of every trace and index: linear between filled bins, constant beyond the first and the last, 0 if there is none.

    A trace has at most ``last_bin`` rows for each index, whatever the table's size.
    """
    keys = bins.select("location_id", "py", "index_name").distinct() if traces is None else traces.crossJoin(F.broadcast(bins.sparkSession.createDataFrame([(i,) for i in indices], "index_name string")))
    grid = keys.withColumn("bin", F.explode(F.sequence(F.lit(1), F.lit(last_bin))))
    rows = grid.join(bins, ["location_id", "py", "index_name", "bin"], "left")
    by = Window.partitionBy("location_id", "py", "index_name").orderBy("bin")
    here = F.when(F.col("value").isNotNull(), F.struct("bin", "value"))
    before = F.last(here, ignorenulls=True).over(by.rowsBetween(Window.unboundedPreceding, 0))
    after = F.first(here, ignorenulls=True).over(by.rowsBetween(0, Window.unboundedFollowing))
    rows = rows.withColumns({"_a": before, "_b": after})
    share = ratio((F.col("bin") - F.col("_a.bin")).cast("double"), (F.col("_b.bin") - F.col("_a.bin")).cast("double"))
    between = F.col("_a.value") + F.coalesce(share, F.lit(0.0)) * (F.col("_b.value") - F.col("_a.value"))
    filled = F.coalesce(between, F.col("_a.value"), F.col("_b.value"), F.lit(0.0))
    return rows.select("location_id", "py", "index_name", "bin", filled.alias("value"), F.col("value").isNotNull().alias("observed"))


def standardised(df: DataFrame, columns: list[str]) -> tuple[DataFrame, dict[str, tuple[float, float]]]:
    """The table with z-scores and the mean and sd of each column (an sd below 1e-10 counts as 1)."""
    row = df.agg(*[F.avg(c).alias(f"m_{c}") for c in columns], *[F.stddev_samp(c).alias(f"s_{c}") for c in columns]).first()
    params = {c: (row[f"m_{c}"] or 0.0, row[f"s_{c}"] if (row[f"s_{c}"] or 0.0) >= 1e-10 else 1.0) for c in columns}
    return apply_standard(df, params), params


def apply_standard(df: DataFrame, params: dict[str, tuple[float, float]]) -> DataFrame:
    """z-scores by stored parameters; a parameter that is not finite or not positive is an error."""
    for c, (m, s) in params.items():
        if m != m or s != s or s <= 0 or abs(m) == float("inf") or s == float("inf"):
            raise ValueError(f"bad parameters for {c}")
    return df.withColumns({c: (F.col(c) - m) / s for c, (m, s) in params.items()})


def dominant_label(df: DataFrame, key: str, label: str = "veg") -> DataFrame:
    """Most frequent label of each key; of equally frequent ones the first in order."""
    counts = df.where(F.col(label).isNotNull()).groupBy(key, label).agg(F.count(F.lit(1)).alias("n"))
    best = F.min_by(F.struct(F.col(label), F.col("n")), F.struct(-F.col("n"), F.col(label)))
    return counts.groupBy(key).agg(best.alias("b")).select(key, f"b.{label}", "b.n")


def shares(df: DataFrame, keys: list[str], value: str = "coef", label: str = "veg", scaler: Column | None = None) -> DataFrame:
    """Adds share: value over the sum of the vegetated classes of its group if that exceeds 1e-6; times the scaler if given, bare ground then
    being 1 - scaler."""
    total = df.where(F.col(label) != "barren").groupBy(*keys).agg(F.sum(value).alias("_t"))
    joined = df.join(total, keys, "left")
    share = F.when(F.col("_t") > 1e-6, F.col(value) / F.col("_t")).otherwise(F.col(value))
    if scaler is not None:
        share = F.when(F.col(label) == "barren", 1 - scaler).otherwise(share * scaler)
    return joined.withColumn("share", share).drop("_t")


def keep_largest(df: DataFrame, keys: list[str], k: int, value: str = "coef", label: str = "veg") -> DataFrame:
    """The k largest vegetated values of each group stay, the others become 0; all are scaled to sum 1 (bare ground is always kept)."""
    order = Window.partitionBy(*keys, F.col(label) == "barren").orderBy(F.desc(value), label)
    kept = df.withColumn("_r", F.row_number().over(order)).withColumn("kept", F.when((F.col(label) == "barren") | (F.col("_r") <= k), F.col(value)).otherwise(0.0))
    total = F.sum("kept").over(Window.partitionBy(*keys))
    return kept.withColumn("kept", F.when(total > 0, F.col("kept") / total).otherwise(F.col("kept"))).drop("_r")


def one_position(df: DataFrame, key: str = "location_id") -> DataFrame:
    """One row for each key, one with both coordinates if there is any; the smallest of equals."""
    there = F.col("lat").isNotNull() & F.col("lon").isNotNull()
    columns = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.min(F.struct((~there).alias("_x"), *columns)).alias("r")).select(key, *[f"r.{c}" for c in columns])


def early_late(df: DataFrame, keys: list[str], value: str, season: str = "py", n: int = 3) -> DataFrame:
    """Mean over the first and the last n seasons of the table, and the change, for keys that have both."""
    seasons = df.select(season).distinct()
    ranked = seasons.withColumn("_up", F.row_number().over(Window.orderBy(season))).withColumn("_down", F.row_number().over(Window.orderBy(F.desc(season))))
    rows = df.join(F.broadcast(ranked), season)  # one row a season
    early = rows.where(F.col("_up") <= n).groupBy(*keys).agg(F.avg(value).alias("early"))
    late = rows.where(F.col("_down") <= n).groupBy(*keys).agg(F.avg(value).alias("late"))
    return early.join(late, keys).withColumn("change", F.col("late") - F.col("early"))


def hash_order(key: Column, seed: int = 42) -> Column:
    """Seeded pseudo-random order by plain arithmetic."""
    return F.pmod(key * 7919 + seed, F.lit(10007))


def _leading(keys: DataFrame, label: str, key: str, limits: DataFrame) -> DataFrame:
    """keys (key, label, _o) with _lead: whether the key is among the first _limit of its label in order of _o and key.

    Keys are counted by the numbers of their order first (hash_order has 10,007), so that only those with the number at the limit are put in order.
    """
    counts = keys.groupBy(label, "_o").agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(label).orderBy("_o").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = counts.withColumn("_before", before).join(F.broadcast(limits), label, "left")  # a row a label
    joined = keys.join(placed, [label, "_o"])
    at_limit = (F.col("_before") < F.col("_limit")) & (F.col("_before") + F.col("_n") > F.col("_limit"))
    plain = joined.where(F.coalesce(~at_limit, F.lit(True))).withColumn("_lead", F.coalesce(F.col("_before") + F.col("_n") <= F.col("_limit"), F.lit(False)))
    border = joined.where(at_limit).withColumn("_r", F.row_number().over(Window.partitionBy(label, "_o").orderBy(key)))
    border = border.withColumn("_lead", F.col("_before") + F.col("_r") <= F.col("_limit"))
    return plain.select(key, label, "_lead").unionByName(border.select(key, label, "_lead"))


def balanced_sample(df: DataFrame, key: str, label: str, number: Column, seed: int = 42) -> DataFrame:
    """Keys of each vegetated class cut to the number of the smallest class; bare ground is kept whole."""
    keys = materialise(df.select(key, label, hash_order(number, seed).alias("_o")).distinct(), "keys")
    counts = keys.groupBy(label).agg(F.count(F.lit(1)).alias("_m"))
    least = counts.where(F.col(label) != "barren").agg(F.min("_m").alias("_least"))
    limits = counts.crossJoin(F.broadcast(least)).select(label, F.when(F.col(label) == "barren", F.col("_m")).otherwise(F.col("_least")).alias("_limit"))
    return _leading(keys.where(F.col(label).isNotNull()), label, key, limits).where("_lead").select(key, label)


def holdout(df: DataFrame, key: str, label: str, number: Column, fraction: float = 0.3, seed: int = 42) -> DataFrame:
    """key, label, held: min(ceil(fraction x n), n - 1) keys of each class are held out, none of a class of one."""
    keys = materialise(df.select(key, label, hash_order(number, seed).alias("_o")).distinct(), "keys")
    n = F.count(F.lit(1))
    limits = keys.groupBy(label).agg(F.when(n > 1, F.least(F.ceil(n * fraction), n - 1)).otherwise(0).alias("_limit"))
    return _leading(keys, label, key, limits).select(key, label, F.col("_lead").alias("held"))


def complete_classes(df: DataFrame, whole: DataFrame, classes: list[str], order: Column, label: str = "veg") -> DataFrame:
    """Training rows plus, for each class they lack, up to max(5, a tenth of them) rows of the whole table."""
    n = df.count()
    have = [r[label] for r in df.select(label).distinct().limit(1000).collect()]
    out = df
    for cls in classes:
        if cls not in have:
            out = out.unionByName(whole.where(F.col(label) == cls).orderBy(order).limit(max(5, n // 10)))
    return out


def class_shares(df: DataFrame, keys: list[str], classes: list[str], value: str = "coef", label: str = "veg") -> DataFrame:
    """One column for each class, as shares of their sum, and back to rows."""
    wide = df.groupBy(*keys).pivot(label, classes).agg(F.sum(value)).fillna(0.0, classes)
    total = sum((F.col(c) for c in classes[1:]), F.col(classes[0]))
    shared = wide.select(*keys, *[F.when(total > 0, F.col(c) / total).otherwise(0.0).alias(c) for c in classes])
    return shared.unpivot(keys, classes, label, "share")


def sample_by(df: DataFrame, group: list[str], key: str, cap: int, seed: int = 42) -> DataFrame:
    """At most ``cap`` rows of each group: those with the smallest hashed number of their key (resample.uniform), of equal ones the smallest keys.

    Groups are counted by 1,024 ranges of that number first, so that only the range that the limit falls into is put in order.
    """
    rows = df.withColumn("_u", uniform(F.col(key), F.lit(0), seed)).withColumn("_b", F.floor(F.col("_u") * 1024))
    counts = rows.groupBy(*group, "_b").agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(*group).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranges = counts.withColumn("_before", before).where(F.col("_before") < cap)
    near = rows.join(ranges, [*group, "_b"])
    whole, border = near.where(F.col("_before") + F.col("_n") <= cap), near.where(F.col("_before") + F.col("_n") > cap)
    cut = border.withColumn("_r", F.row_number().over(Window.partitionBy(*group).orderBy("_u", key))).where(F.col("_before") + F.col("_r") <= cap)
    return whole.select(*df.columns).unionByName(cut.select(*df.columns))


def running_width(df: DataFrame, group: list[str], order: str, width: str) -> DataFrame:
    """Adds start and end of each item laid side by side in order."""
    w = Window.partitionBy(*group).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("end", F.sum(width).over(w)).withColumn("start", F.col("end") - F.col(width))
