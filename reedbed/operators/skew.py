"""Splitting of hot keys: shares of a table that one key may hold are never handed to one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reedbed.session import materialise

#: Tables of at most so many keys are broadcast; longer ones are joined by a shuffle (join_key_stats).
MAX_HOT_KEYS = 65_536


def hot_keys(df: DataFrame, keys: list[str], rows_per_block: int) -> DataFrame:
    """Keys with more rows than a block, with the number of blocks each is split into: ``keys``, ``_n``, ``_blocks`` (int). Null keys form a group."""
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > rows_per_block)
    return counts.withColumn("_blocks", F.ceil(F.col("_n") / rows_per_block).cast("int"))


def is_short(df: DataFrame, rows: int = MAX_HOT_KEYS) -> bool:
    """Whether a table is short enough to be broadcast."""
    return df.limit(rows + 1).count() <= rows


def with_block(df: DataFrame, keys: list[str], spread: Column, rows_per_block: int) -> DataFrame:
    """Adds ``_block`` (int) and ``_many`` (whether the key has several): 0 for ordinary keys, a hash of ``spread`` modulo the number of blocks for keys with more rows than a block.

    Equal values of ``spread`` (repeated deliveries) stay in one block. The number of blocks travels under a hash of the key: of colliding keys the larger
    number counts for both, which changes the split only.
    """
    hot = hot_keys(df, keys, rows_per_block).groupBy(F.xxhash64(*keys).alias("_h")).agg(F.max("_blocks").alias("_blocks"), F.sum("_n").alias("_n"))
    hot = materialise(hot, "hot-keys")
    hashed = df.withColumn("_h", F.xxhash64(*keys))
    joined = hashed.join(F.broadcast(hot.drop("_n")), "_h", "left") if is_short(hot) else join_key_stats(hashed, hot, ["_h"], "_n").drop("_n")
    block = F.when(F.col("_blocks").isNull(), F.lit(0)).otherwise(F.pmod(F.xxhash64(spread), F.col("_blocks"))).cast("int")
    return joined.withColumn("_block", block).withColumn("_many", F.col("_blocks").isNotNull()).drop("_blocks", "_h")


def join_key_stats(df: DataFrame, stats: DataFrame, keys: list[str], count: str, max_hot: int = 4096) -> DataFrame:
    """Left join of per-key statistics onto the rows of ``df`` without sending a hot key to one task.

    ``count`` is the column of ``stats`` that holds the rows of each key. Keys with more than 1/max_hot of all rows
    (at most ``max_hot`` of them, by counting) are joined by broadcast, all others by a shuffle whose largest key is then bounded.
    Rows with a null key get nulls.
    """
    total = stats.agg(F.sum(count).alias("_total"))
    marked = stats.crossJoin(F.broadcast(total)).withColumn("_hot", F.col(count) * max_hot > F.col("_total")).drop("_total")
    values = [c for c in stats.columns if c not in keys]
    hot = F.broadcast(marked.where("_hot").select(*keys, F.struct(*values).alias("_h")))
    cold = marked.where("not _hot").select(*keys, F.struct(*values).alias("_c"))
    first = df.join(hot, keys, "left")
    # Hot rows are scattered over all partitions of the second join by a key that nothing matches.
    spread = F.when(F.col("_h").isNull(), F.lit(0)).otherwise(F.pmod(F.xxhash64(*df.columns), F.lit(1 << 20)) + 1)
    second = first.withColumn("_s", spread.cast("int")).join(cold.withColumn("_s", F.lit(0)), [*keys, "_s"], "left")
    return second.select(*df.columns, *[F.coalesce(F.col(f"_h.{v}"), F.col(f"_c.{v}")).alias(v) for v in values])
