"""Bootstrap and accuracy: resampling by weights, never by copies of rows."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reedbed.operators.skew import with_block
from reedbed.session import materialise

#: Share of a Poisson(1) number of at most 0, 1, 2, ...: the number of times that a bootstrap replicate draws one of many keys.
POISSON = tuple(sum(math.exp(-1) / math.factorial(k) for k in range(n + 1)) for n in range(9))
#: Groups of up to so many rows are resampled by exact draws, larger ones by Poisson numbers.
FEW = 32
#: Rows of a group that one task resamples.
ROWS_PER_TASK = 50_000


def uniform(key: Column, replicate: Column, seed: int = 42) -> Column:
    """A number from 0 to 1 (excluded) of a key in a replicate, from the whole text of the key: 32 bits of an MD5 that serves four replicates, which any engine can repeat."""
    r = replicate.cast("int")
    text = F.concat_ws("/", key.cast("string"), (r / 4).cast("int").cast("string"), F.lit(str(seed)))
    return F.conv(F.substring(F.md5(text), (r % 4) * 8 + 1, F.lit(8)), 16, 10).cast("double") / 4294967296.0


def draw_weight(key: Column, replicate: Column, seed: int = 42) -> Column:
    """How often a bootstrap replicate draws a key: a Poisson(1) number; keys and replicates are independent."""
    return F.size(F.filter(F.lit(list(POISSON)), lambda top: top <= uniform(key, replicate, seed)))


def location_bootstrap(coefs: DataFrame, replicates: int = 100, seed: int = 42, key: str = "location_id") -> DataFrame:
    """replicate, py, veg, value: mean class fraction with each location weighted by its number of draws.

    Vegetated sums are divided by all drawn locations, bare ground (1 less the vegetated sum) by those drawn that have the season. Locations are summed before they are
    multiplied by replicates, and a replicate's partial sums are merged before the shuffle. key: what is drawn, the locations or a column with their spatial blocks, which are then drawn whole;
    locations without a block are drawn one by one.
    """
    c = coefs.withColumn("_k", F.coalesce(F.col(key), F.col("location_id")))
    per = c.where("veg <> 'barren'").groupBy("location_id", "_k", "py", "veg").agg(F.avg("coef").alias("v"))
    reps = F.explode(F.sequence(F.lit(1), F.lit(replicates))).alias("replicate")
    keys = c.select("_k", "location_id").distinct().groupBy("_k").agg(F.count(F.lit(1)).alias("n")).select("_k", "n", reps).withColumn("w", draw_weight(F.col("_k"), F.col("replicate"), seed))
    keys = materialise(keys, "draws")  # computed once, not for every season and class
    locations = keys.groupBy("replicate").agg(F.sum(F.col("w") * F.col("n")).alias("all"))
    drawn = keys.where("w > 0").groupBy("_k").agg(F.collect_list(F.struct("replicate", "w")).alias("d"))
    # Of one key and season there is one row for each class; a third of the locations is not drawn at all.
    sums = per.groupBy("_k", "py", "veg").agg(F.sum("v").alias("v"))
    veg = sums.join(drawn, "_k").select("py", "veg", "v", F.inline("d")).groupBy("replicate", "py", "veg").agg(F.sum(F.col("v") * F.col("w")).alias("s")).join(F.broadcast(locations), "replicate")
    green = per.groupBy("location_id", "_k", "py").agg(F.greatest(F.lit(0.0), F.least(1 - F.sum("v"), F.lit(1.0))).alias("b")).groupBy("_k", "py").agg(F.sum("b").alias("b"), F.count(F.lit(1)).alias("n"))
    bare = green.join(drawn, "_k").select("py", "b", "n", F.inline("d")).groupBy("replicate", "py").agg((F.sum(F.col("b") * F.col("w")) / F.sum(F.col("w") * F.col("n"))).alias("value"))
    return veg.select("replicate", "py", "veg", (F.col("s") / F.col("all")).alias("value")).unionByName(bare.select("replicate", "py", F.lit("barren").alias("veg"), "value"))


def compiled(replicates: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """Mean, sd, 2.5 and 97.5 percent over the replicates."""
    return replicates.groupBy(*keys).agg(
        F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"), F.percentile(value, F.lit(0.025)).alias("coef_025"), F.percentile(value, F.lit(0.975)).alias("coef_975"), F.count(value).alias("n")
    )



def hashed_numbers(h: np.ndarray, count: int, stream: int = 0) -> np.ndarray:
    """16-bit numbers (rows x count) from 64-bit hashes of the rows: a counter mixed with the hash, so that they depend on nothing else."""
    word = (-(-count // 4) * np.uint64(stream) + np.arange(-(-count // 4), dtype=np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    z = h.astype(np.uint64)[:, None] + word
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        z = (z ^ (z >> np.uint64(shift))) * np.uint64(factor)
    return (z ^ (z >> np.uint64(31))).view(np.uint16)[:, :count]


_COUNTS = np.searchsorted(np.array(POISSON), (np.arange(65_536) + 0.5) / 65_536, side="right").astype(np.uint8)


def hashed_draws(h: np.ndarray, replicates: int) -> np.ndarray:
    """Poisson(1) numbers (rows x replicates)."""
    return _COUNTS[hashed_numbers(h, replicates)]


def resampled_sums(value: np.ndarray, start: np.ndarray, h: np.ndarray, group_h: np.ndarray, replicates: int) -> tuple[np.ndarray, np.ndarray]:
    """Sum and number (groups x replicates) of resampled values of each group; groups are consecutive and begin at ``start``.

    Groups of up to FEW values: exactly as many draws as values, by the hash of the group; larger ones: a Poisson number for each value, by its own hash.
    """
    size = np.diff(np.append(start, len(value)))
    total, number = np.zeros((len(start), replicates)), np.zeros((len(start), replicates))
    few = np.flatnonzero(size <= FEW)
    for k in range(size[few].max(initial=0)):
        own = few[size[few] > k]
        pick = (hashed_numbers(group_h[own], replicates, k + 1).astype(np.int64) * size[own, None]) >> 16
        total[own] += value[start[own, None] + pick]
        number[own] += 1
    for g in np.flatnonzero(size > FEW):
        for part in np.array_split(np.arange(start[g], start[g] + size[g]), -(-int(size[g]) // 4096)):
            w = hashed_draws(h[part], replicates)
            total[g] += value[part] @ w
            number[g] += w.sum(axis=0)
    return total, number


def bootstrap_medians(value: np.ndarray, h: int, replicates: int) -> np.ndarray:
    """Bootstrapped medians: missing without values, constant below three."""
    x = value[np.isfinite(value)]
    if len(x) < 3:
        return np.full(replicates, np.median(x) if len(x) else np.nan)
    pick = np.stack([(hashed_numbers(np.array([h]), replicates, k)[0].astype(np.int64) * len(x)) >> 16 for k in range(len(x))], axis=1)
    return np.median(x[pick], axis=1)


def median_bootstrap(df: DataFrame, groups: list[str], value: str, replicates: int = 100, seed: int = 42) -> DataFrame:
    """groups, n, medians (array): bootstrapped medians of each group; groups are small (the readings of one location in one season)."""
    schema = ", ".join(f"{g} {dict(df.dtypes)[g]}" for g in groups) + ", n bigint, medians array<double>"
    h = F.xxhash64(F.lit(seed), *groups)

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for own in (pdf.iloc[i] for i in pdf.groupby(groups, dropna=False).indices.values()):
            v = np.sort(own[value].to_numpy(float))
            rows.append((*own[groups].iloc[0], int(np.isfinite(v).sum()), bootstrap_medians(v, int(own["_h"].iloc[0]), replicates)))
        return pd.DataFrame(rows, columns=[*groups, "n", "medians"])

    rows = df.select(*groups, value, h.alias("_h"))
    tasks = max(1, rows.count() // ROWS_PER_TASK)
    return rows.withColumn("_b", F.pmod("_h", F.lit(tasks))).groupBy("_b").applyInPandas(work, schema)


def hierarchical_bootstrap(df: DataFrame, groups: list[str], key: str, value: str, row_id: str, replicates: int = 200, seed: int = 42, drawn: str | None = None) -> DataFrame:
    """groups, mean, sd, low, high, n of the mean of location means: locations are resampled, then the rows within each location.

    drawn: a column with what is drawn instead of single locations (their spatial block). Rows of a location and group that exceed a block of ROWS_PER_TASK are resampled in several tasks, whose sums are added;
    all others give their mean at once, and only sums by group and replicate leave a task.
    """
    rows = df.where(F.col(value).isNotNull()).withColumn("_row", F.xxhash64(F.lit(seed), F.col(row_id)))
    rows = with_block(rows.select(*groups, key, F.col(value).cast("double").alias("_v"), "_row", F.xxhash64(F.lit(seed), F.coalesce(F.col(drawn), F.col(key)) if drawn else F.col(key)).alias("_draw")), [*groups, key], F.col("_row"), ROWS_PER_TASK)
    keyed = rows.withColumn("_key", F.xxhash64(F.lit(seed), *groups, key))
    tasks = max(1, -(-df.count() // ROWS_PER_TASK))
    types = dict(df.dtypes)
    fields = ", ".join(f"{g} {types[g]}" for g in groups)

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["_key", "_block", "_row"], kind="stable")
        cut = np.append(True, (np.diff(pdf["_key"].to_numpy()) != 0) | (np.diff(pdf["_block"].to_numpy()) != 0))
        start = np.flatnonzero(cut)
        total, number = resampled_sums(pdf["_v"].to_numpy(float), start, pdf["_row"].to_numpy(), pdf["_key"].to_numpy()[start], replicates)
        one = pdf.iloc[start].reset_index(drop=True)
        many, out = one["_many"].to_numpy(bool), []
        for i in np.flatnonzero(many):
            out.append((*one.loc[i, groups], int(one.loc[i, "_key"]), int(one.loc[i, "_draw"]), total[i], number[i]))
        rest = np.flatnonzero(~many)
        w = hashed_draws(one["_draw"].to_numpy()[rest], replicates) * (number[rest] > 0)
        mean = total[rest] / np.maximum(number[rest], 1)
        for of in one.iloc[rest].reset_index(drop=True).groupby(groups, dropna=False).indices.values():
            out.append((*one.loc[rest[of[0]], groups], None, None, (mean[of] * w[of]).sum(axis=0), w[of].sum(axis=0).astype(float)))
        made = pd.DataFrame(out, columns=[*groups, "_key", "_draw", "s", "n"], dtype=object)
        return made.assign(**{c: pd.array(made[c].tolist(), dtype="Int64") for c in ("_key", "_draw")})  # whole numbers, not by way of floats

    parts = keyed.repartition(tasks, *groups, key, "_block").withColumn("_b", F.pmod(F.xxhash64(*groups, key, "_block"), F.lit(tasks))).groupBy("_b").applyInPandas(work, f"{fields}, _key bigint, _draw bigint, s array<double>, n array<double>")
    parts = materialise(parts, "resampled")
    long = lambda d, *more: d.select(*groups, *more, F.posexplode(F.arrays_zip("s", "n")).alias("replicate", "x")).select(*groups, *more, "replicate", "x.s", "x.n")
    few = long(parts.where("_key is null"))
    split = parts.where("_key is not null")
    if not split.isEmpty():
        whole = long(split, "_key", "_draw").groupBy(*groups, "_key", "_draw", "replicate").agg(F.sum("s").alias("s"), F.sum("n").alias("n")).where("n > 0")

        def weigh(batches):
            for pdf in batches:
                w = _COUNTS[[hashed_numbers(np.array([h]), r + 1)[0, r] for h, r in zip(pdf["_draw"], pdf["replicate"], strict=True)]] if len(pdf) else np.zeros(0)
                yield pdf[groups].assign(replicate=pdf["replicate"], s=pdf["s"] / pdf["n"] * w, n=w.astype(float))

        few = few.unionByName(whole.mapInPandas(weigh, f"{fields}, replicate int, s double, n double"))
    means = few.groupBy(*groups, "replicate").agg(F.sum("s").alias("s"), F.sum("n").alias("n")).where("n > 0").select(*groups, "replicate", (F.col("s") / F.col("n")).alias("value"))
    return compiled(means, groups).select(*groups, "mean", "sd", F.col("coef_025").alias("low"), F.col("coef_975").alias("high"), "n")


def resampled_means(per_location: DataFrame, groups: list[str], value: str, replicates: int = 100, seed: int = 42, key: str = "location_id") -> DataFrame:
    """replicate, groups, value: mean over the drawn locations (draw_weight)."""
    reps = F.explode(F.sequence(F.lit(1), F.lit(replicates))).alias("replicate")
    keys = per_location.select(key).distinct().select(key, reps).withColumn("w", draw_weight(F.col(key), F.col("replicate"), seed)).where("w > 0")
    drawn = materialise(keys.groupBy(key).agg(F.collect_list(F.struct("replicate", "w")).alias("d")), "draws")
    rows = per_location.where(F.col(value).isNotNull()).join(drawn, key).select(*groups, F.col(value).alias("_v"), F.inline("d"))
    return rows.groupBy("replicate", *groups).agg((F.sum(F.col("_v") * F.col("w")) / F.sum("w")).alias("value"))


def aggregate_bootstrap(per_location: DataFrame, value: str, places: DataFrame, range_km: float, replicates: int = 100, small: int = 15, seed: int = 42) -> DataFrame:
    """veg, py, global_coef, se, coef_025, coef_975, n_locations, n_eff from one value for each location (location_id, veg, py, value).

    From ``small`` locations on the values are resampled (resampled_means). Below, draws are N(mean, sd / sqrt(n_eff)): sd is the median of the yearly ones of the class (years with at least 3) or else the group's own, and
    n_eff = n / (1 + (n - 1) x mean of exp(-distance / range_km) over the pairs), locations without a position (places: location_id, lat, lon) being independent. Mean and lower bound are at least 0, the upper one at most 1.
    """
    yearly = per_location.where(F.col(value).isNotNull()).groupBy("veg", "py").agg(F.avg(value).alias("m"), F.stddev_samp(value).alias("s"), F.count(value).alias("n"))
    yearly = materialise(yearly, "yearly")
    pooled = yearly.where("n >= 3").groupBy("veg").agg(F.median("s").alias("pooled"))  # a value a year
    many, few = yearly.where(F.col("n") >= small), yearly.where(F.col("n") < small).join(F.broadcast(pooled), "veg", "left")
    large = compiled(resampled_means(per_location.join(many.select("veg", "py"), ["veg", "py"], "left_semi"), ["veg", "py"], value, replicates, seed), ["veg", "py"])
    held = per_location.where(F.col(value).isNotNull()).join(few.select("veg", "py", "m", "n", F.coalesce("pooled", "s", F.lit(0.0)).alias("sd")), ["veg", "py"]).join(places.select("location_id", "lat", "lon"), "location_id", "left")

    def draw(pdf: pd.DataFrame) -> pd.DataFrame:
        a, o = np.radians(pdf["lat"].to_numpy(float)), np.radians(pdf["lon"].to_numpy(float))
        h = np.sin((a[:, None] - a) / 2) ** 2 + np.cos(a)[:, None] * np.cos(a) * np.sin((o[:, None] - o) / 2) ** 2
        near = np.nan_to_num(np.exp(-2 * 6371 * np.arcsin(np.sqrt(np.minimum(h, 1))) / range_km))
        n = len(pdf)
        n_eff = n / (1 + (near.sum() - np.trace(near)) / n) if n else np.nan  # (n - 1) x mean over the n (n - 1) pairs
        r = pdf.iloc[0]
        d = np.random.default_rng([seed, int(r["py"]), *str(r["veg"]).encode()]).normal(r["m"], r["sd"] / np.sqrt(n_eff), replicates)
        low, high = np.quantile(d, [0.025, 0.975])
        return pd.DataFrame({"veg": [r["veg"]], "py": [r["py"]], "m": [r["m"]], "se": [d.std(ddof=1)], "low": [low], "high": [high], "n": [n], "n_eff": [n_eff]})

    kinds = dict(per_location.dtypes)
    drawn = held.groupBy("veg", "py").applyInPandas(draw, f"veg {kinds['veg']}, py {kinds['py']}, m double, se double, low double, high double, n bigint, n_eff double")
    got = large.join(many.select("veg", "py", "m", F.col("n").alias("k")), ["veg", "py"]).select("veg", "py", "m", F.col("sd").alias("se"), F.col("coef_025").alias("low"), F.col("coef_975").alias("high"), F.col("k").alias("n"), F.lit(None).cast("double").alias("n_eff"))
    clipped = F.greatest(F.col("m"), F.lit(0.0)).alias("global_coef"), "se", F.greatest(F.col("low"), F.lit(0.0)).alias("coef_025"), F.least(F.col("high"), F.lit(1.0)).alias("coef_975")
    return got.unionByName(drawn).select("veg", "py", *clipped, F.col("n").alias("n_locations"), "n_eff")


def block_sample(blocks: list[str], sizes: list[int], n_draw: int, seed: int = 42) -> list[str]:
    """Whole blocks drawn with repeats until n_draw locations are reached; too few blocks or locations are an error."""
    total = sum(sizes)
    if len(blocks) < 2 or total < max(3, -(-n_draw // 3)):
        raise ValueError("too few blocks or locations")
    rng, out, have = np.random.default_rng(seed), [], 0
    while have < n_draw:
        i = int(rng.integers(len(blocks)))
        out.append(blocks[i])
        have += sizes[i]
    return out


def confusion(predictions: DataFrame, classes: list[str], true: str = "actual", label: str = "veg", value: str = "coef") -> DataFrame:
    """actual, veg, share, n: mean predicted fraction of each class by true class, each true class scaled to sum 1."""
    means = predictions.groupBy(F.col(true).alias("actual"), F.col(label).alias("veg")).agg(F.avg(value).alias("m"), F.count(F.lit(1)).alias("n"))
    total = means.groupBy("actual").agg(F.sum("m").alias("t"))
    return means.join(F.broadcast(total), "actual").select("actual", "veg", (F.col("m") / F.nullif(F.col("t"), F.lit(0.0))).alias("share"), "n")  # classes x classes rows


def argmax_accuracy(predictions: DataFrame, keys: list[str], true: str = "actual", label: str = "veg", value: str = "coef") -> DataFrame:
    """actual, n, accuracy: share of traces whose largest vegetated fraction is the true class."""
    best = predictions.where(F.col(label) != "barren").groupBy(*keys, true).agg(F.min_by(label, F.struct(-F.col(value), F.col(label))).alias("p"))
    return best.groupBy(F.col(true).alias("actual")).agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("p") == F.col(true)).cast("double")).alias("accuracy"))


def only_class(df: DataFrame, keys: list[str], label: str = "veg") -> DataFrame:
    """keys, actual: the class of groups that have exactly one."""
    return df.groupBy(*keys).agg(F.countDistinct(label).alias("k"), F.max(label).alias("actual")).where("k = 1").drop("k")


def summary_text(mean: Column, low: Column, high: Column, digits: int = 3) -> Column:
    """mean ± half of the interval, with a decimal comma."""
    number = lambda c: F.translate(F.format_string(f"%.{digits}f", c), ".", ",")
    return F.when(mean.isNotNull(), F.concat(number(mean), F.lit(" ± "), number((high - low) / 2)))
