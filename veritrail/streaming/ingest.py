"""Additive, idempotent ingest of chunk files as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from veritrail.operators.transcripts import new_chunks
from veritrail.sources.store import read_optional


def ingest_stream(spark: SparkSession, source: str, target: str, checkpoint: str, schema: str) -> StreamingQuery:
    """Appends chunks (with video_ord and content_hash) whose hash target does not have yet.

    Redelivered files add nothing. Each micro-batch is an anti-join on hashes; it reads only that column of target.
    """

    def add(batch: DataFrame, _: int) -> None:
        known = read_optional(spark, target, schema).select("content_hash")
        new_chunks(batch, known).write.mode("append").parquet(target)

    return spark.readStream.schema(schema).parquet(source).writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def activity(events: DataFrame, late: str = "10 minutes", window: str = "5 minutes") -> DataFrame:
    """Counts and sums by window and type, with a watermark for late rows."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", window), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
