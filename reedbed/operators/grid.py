"""Irregular readings onto a regular grid."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from reedbed.functions.calendar import day_bin, pheno_doy, pheno_year
from reedbed.session import materialise

#: Bins of a season; the last, incomplete bin is left out.
BINS_PER_SEASON = 36
#: Slots of a source that are carried forward together.
CHUNK = 4096


def regular_grid(df: DataFrame, source: str, slot: str, value: str, row_id: str, max_gap: int, chunk: int = CHUNK) -> DataFrame:
    """One row for each source and slot from its first to its last slot with a reading.

    ``slot`` is an integer period number. Repeated deliveries (same ``row_id``) count once. Rows with a null source,
    slot or value, or a NaN value, are no readings; a source without readings has no rows; an empty table gives none.
    Columns: source, slot, n (readings, 0 in a missing slot), value (mean of the readings, null if missing),
    filled (the value, else the last one if at most ``max_gap`` slots old), state: 'observed', 'carried' or 'missing'.

    The rows of a slot are merged by (source, slot, row_id) first, so a hot source or slot is spread over all tasks. The line of slots is worked off in chunks of ``chunk`` slots: readings of the last
    ``max_gap`` slots of a chunk are lent to the next, so a source with a very long span is no single task's work.
    """
    chunk = max(chunk, max_gap + 1)
    rows = df.select(F.col(source).alias("source"), F.col(slot).cast("long").alias("slot"), F.col(value).alias("v"), F.col(row_id).alias("rid"))
    rows = rows.where("source is not null and slot is not null and v is not null and not isnan(v)")
    once = rows.groupBy("source", "slot", "rid").agg(F.min("v").alias("v"))
    binned = once.groupBy("source", "slot").agg(F.count("v").alias("n"), F.avg("v").alias("value"))
    binned = materialise(binned, "bins")  # read three times: for the spans, for the join and for what is lent
    spans = binned.groupBy("source").agg(F.min("slot").alias("lo"), F.max("slot").alias("hi"))
    of = lambda s: F.floor(s / chunk)
    chunks = spans.select("source", "lo", "hi", F.explode(F.sequence(of(F.col("lo")), of(F.col("hi")))).alias("chunk"))
    slots = chunks.select("source", "chunk", F.explode(F.sequence(F.greatest("lo", F.col("chunk") * chunk), F.least("hi", F.col("chunk") * chunk + chunk - 1))).alias("slot"))
    joined = slots.join(binned, ["source", "slot"], "left").withColumn("lent", F.lit(False))
    lent = binned.where(F.pmod("slot", F.lit(chunk)) >= chunk - max_gap).withColumns({"chunk": of(F.col("slot")) + 1, "lent": F.lit(True)})
    past = Window.partitionBy("source", "chunk").orderBy("slot").rowsBetween(Window.unboundedPreceding, 0)
    last = F.last(F.when(F.col("n").isNotNull(), F.struct("slot", "value")), ignorenulls=True).over(past)
    carried = joined.unionByName(lent).withColumn("last", last).where("not lent")
    near = F.col("slot") - F.col("last.slot") <= max_gap
    return carried.select(
        F.col("source").alias(source),
        F.col("slot").alias(slot),
        F.coalesce("n", F.lit(0)).alias("n"),
        "value",
        F.when(near, F.col("last.value")).alias("filled"),
        F.when(F.col("n").isNotNull(), "observed").when(near, "carried").otherwise("missing").alias("state"),
    )


def ten_day_grid(observation: DataFrame, value: str = "nir", max_gap: int = 3) -> DataFrame:
    """Ten-day bins of each location, counted by season: 36 bins from 1 March, day 361 and later left out.

    A reading counts if location_id and date are not null and the value is finite and within 0 to 1.
    Columns: location_id, pheno_year, bin, n, value, filled, state.
    """
    season, bin_ = pheno_year(F.col("date")), day_bin(pheno_doy(F.col("date")))
    v = F.col(value)
    readings = observation.where(F.col("location_id").isNotNull() & F.col("date").isNotNull() & (v >= 0) & (v <= 1)).select(
        "obs_id", "location_id", v.alias("value"), season.alias("season"), bin_.alias("bin")
    )
    readings = readings.where(F.col("bin") <= BINS_PER_SEASON).withColumn("slot", F.col("season") * BINS_PER_SEASON + F.col("bin") - 1)
    grid = regular_grid(readings, "location_id", "slot", "value", "obs_id", max_gap)
    return grid.select(
        "location_id",
        F.floor(F.col("slot") / BINS_PER_SEASON).cast("int").alias("pheno_year"),
        (F.pmod(F.col("slot"), F.lit(BINS_PER_SEASON)) + 1).cast("int").alias("bin"),
        "n", "value", "filled", "state",
    )
