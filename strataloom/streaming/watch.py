"""Continuous maintenance: change events are debounced for each file and applied in micro-batches."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import paths

WATERMARK = "10 seconds"
GAP = "300 milliseconds"


def relevant(events: DataFrame, include: tuple[str, ...], exclude: tuple[str, ...]) -> DataFrame:
    """Events of files that a scan would take."""
    return events.where(paths.any_glob(F.col("filename"), include) & ~paths.any_glob(F.col("filename"), exclude))


def debounced(events: DataFrame, gap: str = GAP, watermark: str | None = None) -> DataFrame:
    """filename, last_at, events: a row for each burst of events (filename, at), apart by at least the gap.

    The same plan serves tables and streams; on a stream a burst comes out once the watermark has passed its end.
    """
    own = events.withWatermark("at", watermark) if watermark else events
    return own.groupBy("filename", F.session_window("at", gap)).agg(F.max("at").alias("last_at"), F.count(F.lit(1)).alias("events")).select("filename", "last_at", "events")


def watch(events: DataFrame, apply: Callable[[DataFrame, int], None], checkpoint: str, gap: str = GAP, watermark: str = WATERMARK, **trigger) -> StreamingQuery:
    """Runs apply(changed files, batch id) on each micro-batch of debounced changes.

    Batches may be repeated after a failure; apply should write under its batch id or be idempotent, as upserts by path are.
    """
    own = debounced(events, gap, watermark)
    return own.writeStream.foreachBatch(apply).outputMode("append").option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
