"""Equivalence-class counts kept up to date as alignments arrive."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def class_counts(reads: DataFrame, late: str = "10 minutes") -> DataFrame:
    """(sample, class_key, count) of a stream of (ts, sample, read, class_key); a read that comes again within `late` counts once."""
    return reads.withWatermark("ts", late).dropDuplicatesWithinWatermark(["sample", "read"]).groupBy("sample", "class_key").agg(F.count("*").alias("count"))


def windowed_counts(events: DataFrame, width: str, late: str = "10 minutes") -> DataFrame:
    """(start, event_type, n) in tumbling windows, final once the watermark has passed them."""
    windows = events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"))
    return windows.select(F.col("window.start").alias("start"), "event_type", "n")


def keep_updated(counts: DataFrame, checkpoint: str, update: Callable[[DataFrame, int], None]):
    """Start the query that hands each batch of changed counts to update."""
    return counts.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(update).start()
