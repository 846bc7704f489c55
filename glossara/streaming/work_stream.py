"""Structured Streaming forms of the queue and message operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.text import key
from ..operators.classify import classify, text_emotion
from ..operators.work import rank


def deduplicated(stream: DataFrame, ts: str = "ts", within: str = "1 hour") -> DataFrame:
    """Items of a stream once for each normalised key; state is dropped behind the watermark."""
    return stream.withColumn("key", key(F.col("item"))).withWatermark(ts, within).dropDuplicatesWithinWatermark(["key"])


def windowed_counts(stream: DataFrame, by: str, ts: str = "ts", late: str = "10 minutes", size: str = "5 minutes") -> DataFrame:
    return stream.withWatermark(ts, late).groupBy(F.window(ts, size), by).agg(F.count(F.lit(1)).alias("n"))


def message_emotions(stream: DataFrame) -> DataFrame:
    """Label and confidence of each message."""
    e = text_emotion(F.col("text"))
    return classify(stream.withColumns(e)).select(F.col("id").alias("message_id"), "label", "confidence", "timestamp")


def drain(stream: DataFrame, handle, checkpoint: str):
    """Runs ``handle(batch ordered by priority, epoch)`` over all that is there, then stops."""

    def batch(df: DataFrame, epoch: int) -> None:
        handle(df.orderBy(rank(F.col("priority")), "seq"), epoch)

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
