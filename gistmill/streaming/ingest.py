"""Streams of messages and of index changes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def first_deliveries(messages: DataFrame, delay: str = "7 days") -> DataFrame:
    """Each (user_id, external_source, external_id) once; state is kept for the watermark's delay."""
    return messages.withWatermark("created_at", delay).dropDuplicatesWithinWatermark(["user_id", "external_source", "external_id"])


def latest_changes(changes: DataFrame) -> DataFrame:
    """The last change of each entity in a batch of an ordered log."""
    nth = F.row_number().over(Window.partitionBy("collection", "entity_id").orderBy(F.desc("id")))
    return changes.withColumn("nth", nth).filter("nth = 1").drop("nth")


def applied(table: DataFrame, changes: DataFrame) -> DataFrame:
    """A table after a batch of changes: later changes win, deletions remove, older ones than what is there do nothing."""
    latest = latest_changes(changes).select("collection", "entity_id", "id", "operation", "payload")
    key = ["collection", "entity_id"]
    merged = table.select(*key, F.col("id").alias("had"), F.col("payload").alias("old")).join(latest, key, "full")
    newer = F.col("id").isNotNull() & (F.col("had").isNull() | (F.col("id") > F.col("had")))
    kept = merged.filter(~newer | (F.col("operation") != "delete"))
    return kept.select(*key, F.when(newer, F.col("id")).otherwise(F.col("had")).alias("id"), F.when(newer, F.col("payload")).otherwise(F.col("old")).alias("payload"))


def apply_stream(changes: DataFrame, read: Callable[[], DataFrame], write: Callable[[DataFrame, int], None], checkpoint: str):
    """Apply a stream of changes batch by batch; ``write`` gets the next version with the batch number, so that a repeated batch writes the same version."""

    def batch(rows: DataFrame, number: int) -> None:
        write(applied(read(), rows), number)

    return changes.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def closed_sessions(messages: DataFrame, gap: str = "30 minutes", delay: str = "1 hour") -> DataFrame:
    """session_id, start, end, n: sessions by a gap in event time, an extension for streams that send no end."""
    w = messages.withWatermark("created_at", delay).groupBy("session_id", F.session_window("created_at", gap).alias("w"))
    return w.agg(F.count("*").alias("n")).select("session_id", "w.start", "w.end", "n")
