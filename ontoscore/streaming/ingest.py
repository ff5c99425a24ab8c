"""Structured Streaming: resumable ingestion of job results, and event-time windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def ingest(spark: SparkSession, source: str, schema: str, target: str, checkpoint: str, key: str = "job_id", time: str | None = None, late: str = "1 day") -> StreamingQuery:
    """Appends the first row of each key from JSON files in `source` to Parquet in `target`. The checkpoint is what a resumed run knows.

    With an event time the state of keys is kept for `late` only; without one it grows with the keys.
    """
    rows = spark.readStream.schema(schema).json(source)
    rows = rows.withWatermark(time, late).dropDuplicatesWithinWatermark([key]) if time else rows.dropDuplicates([key])
    return rows.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def append_once(rows: DataFrame, target: str, batch: int, column: str = "batch") -> None:
    """Appends a batch as a folder of its own. A batch that is written again, because its run ended before it was known to be done, replaces
    itself, so every row is there once however often a run is repeated; what a broken run left is gone with it."""
    rows.write.mode("overwrite").parquet(f"{target}/{column}={batch}")


def durable_append(rows: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """Appends a stream to a table so that a repeated batch adds nothing. The checkpoint numbers the batches; the table's `batch` tells them."""
    return rows.writeStream.foreachBatch(lambda df, batch: append_once(df, target, batch)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed(events: DataFrame, time: str = "ts", length: str = "1 hour", late: str = "1 hour", by: str = "event_type", value: str = "value") -> DataFrame:
    """Count and sum by window and type; works on streams and tables."""
    rows = events.withWatermark(time, late) if events.isStreaming else events
    return rows.groupBy(F.window(time, length).alias("w"), by).agg(F.count("*").alias("n"), F.sum(value).alias("total")).select(F.col("w.start").alias("start"), by, "n", "total")


def sessions(events: DataFrame, time: str = "ts", gap: str = "30 minutes", user: str = "user_id", late: str = "1 hour") -> DataFrame:
    rows = events.withWatermark(time, late) if events.isStreaming else events
    return rows.groupBy(F.session_window(time, gap).alias("w"), user).agg(F.count("*").alias("n")).select(user, F.col("w.start").alias("start"), "n")
