"""Ten-day bins of a stream of readings (an addition to the batch bins).

A state row is one location and one window; late readings are dropped after the watermark. Repeated deliveries inside the watermark count once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType


def read_stream(spark: SparkSession, folder: str, schema: StructType, files_per_trigger: int = 100) -> DataFrame:
    """Parquet files that arrive in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def stream_bins(readings: DataFrame, value: str = "nir", lateness: str = "30 days") -> DataFrame:
    """location_id, start, n, value: mean of the plausible values of each location and ten-day window."""
    v = F.col(value)
    usable = readings.where(F.col("location_id").isNotNull() & F.col("acquired_at").isNotNull() & (v >= 0) & (v <= 1))
    at = usable.withColumn("at", F.col("acquired_at").cast("timestamp")).withWatermark("at", lateness)
    once = at.dropDuplicatesWithinWatermark(["obs_id"])
    bins = once.groupBy("location_id", F.window("at", "10 days").alias("w")).agg(F.count(F.lit(1)).alias("n"), F.avg(v).alias("value"))
    return bins.select("location_id", F.col("w.start").alias("start"), "n", "value")


def write_bins(bins: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Closed windows appended as parquet; everything that has arrived is worked off, then the query ends."""
    return bins.writeStream.outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).format("parquet").start(out)
