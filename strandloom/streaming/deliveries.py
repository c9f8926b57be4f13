"""Node and path deliveries as streams: repeated deliveries dropped, late ones kept within a watermark.

The batch operators take whole tables; these functions keep such tables up to date from a stream of
arriving files, with the same rule that a repeated delivery counts once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

#: How long after the newest delivery a repetition is still recognised.
LATENESS = "45 days"


def first_deliveries(stream: DataFrame, key: str, loaded: str = "loaded_at", lateness: str = LATENESS) -> DataFrame:
    """Each key once, at its first arrival; state is bounded by the watermark. Rows with a null key or time are left out."""
    rows = stream.where(F.col(key).isNotNull() & F.col(loaded).isNotNull())
    timed = rows.withColumn("__at", F.col(loaded).cast("timestamp"))
    return timed.withWatermark("__at", lateness).dropDuplicatesWithinWatermark([key]).drop("__at")


def block_arrivals(stream: DataFrame, every: str = "1 day", lateness: str = LATENESS) -> DataFrame:
    """Nodes of each block per interval of delivery, closed when the watermark passes the interval."""
    rows = stream.where(F.col("block_id").isNotNull()).withColumn("__at", F.col("loaded_at").cast("timestamp"))
    counted = rows.withWatermark("__at", lateness).groupBy(F.window("__at", every), "block_id").agg(F.count("*").alias("n_nodes"))
    return counted.select(F.col("window.start").alias("begin"), "block_id", "n_nodes")


def append_table(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Appends a stream to a Parquet table, each row once, with what has arrived by now."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
