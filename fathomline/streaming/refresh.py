"""Keeping tables current from files as they arrive, with Structured Streaming: each micro-batch is one commit."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from fathomline.operators.index import upsert


def arriving(spark: SparkSession, folder: str, schema: str, files: int = 100) -> DataFrame:
    """Rows of Parquet files as they come into a folder, at most `files` a batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", str(files)).parquet(folder)


def index_stream(corpus: DataFrame, folder: str, checkpoint: str, profile: str = "full") -> StreamingQuery:
    """Bring arriving documents (key, name, text, mtime), all there are, into the index of a folder, then stop.

    Each micro-batch is one segment and one version of the same index that refresh() keeps; a batch that is run again
    after a failure changes nothing.
    """
    def take(batch: DataFrame, number: int) -> None:
        if not batch.isEmpty():
            upsert(batch.sparkSession, folder, batch, profile=profile)

    return corpus.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_activity(events: DataFrame, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """(starts, event_type, n, total) of events (ts, event_type, value), batch or stream; what comes later than `late` is dropped."""
    timed = events.withWatermark("ts", late)
    return timed.groupBy(F.window("ts", window).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("starts"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes") -> DataFrame:
    """(user_id, starts, ends, n): runs of a user's events no further apart than the gap."""
    return events.withWatermark("ts", gap).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("starts"), F.col("w.end").alias("ends"), "n")
