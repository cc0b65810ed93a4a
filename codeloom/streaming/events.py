"""Streams: windows over timestamped events, and the incremental sync of changed files."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def tumbling(events: DataFrame, size: str, late: str | None = None) -> DataFrame:
    """(start, event_type, n, total) per window; batch or stream, with a watermark if asked for."""
    e = events.withWatermark("ts", late) if late else events
    return e.groupBy(F.window("ts", size), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")


def sliding(events: DataFrame, size: str, slide: str) -> DataFrame:
    return events.groupBy(F.window("ts", size, slide)).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "n")


def sessions(events: DataFrame, gap: str) -> DataFrame:
    """(user_id, start, end, n): runs of a user's events with less than `gap` between."""
    return events.groupBy("user_id", F.session_window("ts", gap)).agg(F.count("*").alias("n")).select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def deduplicated(events: DataFrame, key: str, late: str) -> DataFrame:
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark([key])


def sync(changes: DataFrame, read: Callable[[], DataFrame], write: Callable[[DataFrame], None], key: str, checkpoint: str):
    """Apply a stream of changed rows: each batch replaces the rows of its keys; what is pending when the stream starts is applied first, then it ends."""

    def apply(batch: DataFrame, _: int) -> None:
        last = batch.dropDuplicates([key])
        write(read().join(last.select(key), key, "left_anti").unionByName(last))

    return changes.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
