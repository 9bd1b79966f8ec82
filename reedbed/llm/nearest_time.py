"""Matching records of two tables by nearest time.

Both tables are cut by entity and time range; rows of the second are lent to a neighbouring range within the tolerance of its border.
The two sides of many (entity, range) cells are co-grouped at once and matched by one vectorised binary search.
Entities with a range that holds too many rows are cut by rank instead: into runs of so many records in time order, to which the nearest row
of the second table before and after the run is lent, so that no rate of records makes a cell large.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from reedbed.operators.skew import is_short
from reedbed.session import materialise

#: Records of a range of an entity, of both tables together, beyond which the entity is cut by rank, and of a cell then.
CELL_ROWS = 50_000


def _rank_cells(both: DataFrame, cell_rows: int) -> DataFrame:
    """side, e, c, t, i of all records (side 0 or 1), c: rank in time over cell_rows; with the nearest record of side 1 before and after each cell.

    Records are ranked by a range partition of entity and time, so no entity and no instant is gathered.
    """
    order = ["e", "t", "side", "i"]
    ordered = both.dropDuplicates(order).repartitionByRange(*order).sortWithinPartitions(*order)
    ordered = materialise(ordered.withColumn("_p", F.spark_partition_id()).withColumn("_i", F.monotonically_increasing_id()), "ordered")
    by = Window.partitionBy("e").orderBy("_p")  # a row a partition that holds the entity
    runs = ordered.groupBy("e", "_p").agg(F.min("_i").alias("_first"), F.count(F.lit(1)).alias("_m")).withColumn("_before", F.sum("_m").over(by) - F.col("_m")).drop("_m")
    runs = materialise(runs, "runs")
    placed = ordered.join(F.broadcast(runs) if is_short(runs) else runs, ["e", "_p"])
    placed = materialise(placed.select("side", "e", F.floor((F.col("_i") - F.col("_first") + F.col("_before")) / cell_rows).cast("int").alias("c"), "t", "i"), "ranked")
    second = lambda column: F.when(F.col("side") == 1, column)
    # Of rows at one instant the smallest id serves.
    ends = placed.groupBy("e", "c").agg(F.min(second(F.struct("t", "i"))).alias("head"), F.max(second(F.struct("t", (-F.col("i")).alias("i")))).alias("tail"))
    up, down = (Window.partitionBy("e").orderBy(o).rowsBetween(Window.unboundedPreceding, -1) for o in (F.asc("c"), F.desc("c")))
    near = ends.select("e", "c", F.last("tail", ignorenulls=True).over(up).alias("tail"), F.last("head", ignorenulls=True).over(down).alias("head"))
    lent = [near.where(f"{n} is not null").select(F.lit(1).alias("side"), "e", "c", f"{n}.t", i.alias("i")) for n, i in (("head", F.col("head.i")), ("tail", -F.col("tail.i")))]
    return placed.unionByName(lent[0]).unionByName(lent[1])


def nearest_in_time(
    left: DataFrame, right: DataFrame, entity: str, at: str, row_id: str, tolerance_s: int, span_s: int | None = None, rows_per_task: int = 100_000, cell_rows: int = CELL_ROWS
) -> DataFrame:
    """For each row of ``left`` the row of ``right`` with the same entity and the smallest time difference, if at most ``tolerance_s``.

    Ties: of two equally near rows the earlier; of several at one instant the smallest id. A row of ``right`` may serve several rows of
    ``left``. Repeated deliveries (same id) count once; rows with a null entity, time or id take no part; an empty side gives no rows.
    Columns: left_id, right_id, gap_us (right minus left, microseconds).

    A cell is one entity in one time range of ``span_s`` (default: eight tolerances), so that a hot entity is spread over its ranges and
    the rows lent across borders stay a quarter of the table; entities with more than ``cell_rows`` records in a range are cut by rank. The number of tasks follows the number of rows.
    """
    span = (span_s or 8 * tolerance_s) * 1_000_000
    tolerance = tolerance_s * 1_000_000

    def prepared(df: DataFrame, side: int) -> DataFrame:
        t = F.unix_micros(F.col(at).cast("timestamp"))
        rows = df.select(F.lit(side).alias("side"), F.col(entity).cast("string").alias("e"), t.alias("t"), F.col(row_id).cast("bigint").alias("i"))
        return rows.where("e is not null and t is not null and i is not null")

    both = prepared(left, 0).unionByName(prepared(right, 1))
    cell = F.floor(F.col("t") / span).cast("int")
    counts = materialise(both.groupBy("e", cell.alias("c")).agg(F.count(F.lit(1)).alias("n")).groupBy("e").agg(F.sum("n").alias("n"), F.max("n").alias("most")), "counts")
    tasks = max(1, -(-(counts.agg(F.sum("n")).first()[0] or 0) // rows_per_task))
    dense = counts.where(F.col("most") > cell_rows).select("e")
    ranked = None
    if not dense.isEmpty():
        small = F.broadcast(dense) if is_short(dense) else dense
        ranked = _rank_cells(both.join(small, "e", "left_semi"), cell_rows)
        both = both.join(small, "e", "left_anti")
    first, last = F.floor((F.col("t") - tolerance) / span).cast("int"), F.floor((F.col("t") + tolerance) / span).cast("int")
    ends = F.when(F.col("side") == 0, F.array(cell)).otherwise(F.sequence(first, last))
    rows = both.withColumn("c", F.explode(ends)).select("side", "e", "c", "t", "i")
    if ranked is not None:
        rows = rows.unionByName(ranked)
    bucket = F.pmod(F.xxhash64("e", "c"), F.lit(tasks)).cast("int").alias("bucket")
    # Cells of the two kinds never meet: an entity is of one kind.
    # The aliases keep the columns of the two sides apart, which come from one table.
    asking, asked = (rows.where(F.col("side") == s).select(bucket, *[F.col(n).alias(n) for n in ("e", "c", "t", "i")]).repartition(tasks, "bucket") for s in (0, 1))

    def match(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        empty = pd.DataFrame({"left_id": np.array([], "int64"), "right_id": np.array([], "int64"), "gap_us": np.array([], "int64")})
        if not len(x) or not len(y):
            return empty
        x, y = x.drop_duplicates(["e", "c", "i"]), y.drop_duplicates(["e", "c", "i"])
        names = pd.factorize(pd.concat([x["e"], y["e"]]))[0].astype(np.int64)
        ranges = np.concatenate([x["c"].to_numpy(np.int64), y["c"].to_numpy(np.int64)])
        number = np.unique(names * (ranges.max() - ranges.min() + 1) + ranges - ranges.min(), return_inverse=True)[1]
        times = np.concatenate([x["t"].to_numpy(np.int64), y["t"].to_numpy(np.int64)])
        # Cells side by side on one line of time, further apart than the tolerance.
        start, stop = np.full(number.max() + 1, np.iinfo(np.int64).max), np.full(number.max() + 1, np.iinfo(np.int64).min)
        np.minimum.at(start, number, times)
        np.maximum.at(stop, number, times)
        width = stop - start + tolerance + 1
        key = times - start[number] + (np.cumsum(width) - width)[number]
        kx, ky, ix, iy = key[: len(x)], key[len(x) :], x["i"].to_numpy(np.int64), y["i"].to_numpy(np.int64)
        order = np.lexsort((iy, ky))
        ky, iy = ky[order], iy[order]
        keep = np.append(True, ky[1:] != ky[:-1])  # of rows at one instant the smallest id
        ky, iy = ky[keep], iy[keep]
        after = np.searchsorted(ky, kx, side="left")
        before = after - 1
        far = np.int64(tolerance + 1)
        d_before = np.where(before >= 0, kx - ky[np.clip(before, 0, len(ky) - 1)], far)
        d_after = np.where(after < len(ky), ky[np.clip(after, 0, len(ky) - 1)] - kx, far)
        pick = np.where(d_before <= d_after, before, after)
        hit = np.minimum(d_before, d_after) <= tolerance
        if not hit.any():
            return empty
        return pd.DataFrame({"left_id": ix[hit], "right_id": iy[pick[hit]], "gap_us": (ky[pick[hit]] - kx[hit])})

    return asking.groupBy("bucket").cogroup(asked.groupBy("bucket")).applyInPandas(match, "left_id bigint, right_id bigint, gap_us bigint")
