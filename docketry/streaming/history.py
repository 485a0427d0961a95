"""Streams of answer-log rows: windowed statistics with late data, and removal of re-delivered rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def windowed_stats(rows: DataFrame, window: Column, late: str | None = "1 hour", by: tuple[str, ...] = ("route_taken",)) -> DataFrame:
    """H8: per event-time window and route the count, refusal rate, mean latency and tokens; rows later than ``late`` behind the newest are dropped (None: the rows have a watermark already).

    Works on streams and on tables. ``window``: ``F.window("ts", "1 day")``, a sliding one, or ``F.session_window("ts", gap)`` (with a user in ``by``).
    """
    rows = rows if late is None else rows.withWatermark("ts", late)
    stats = rows.groupBy(window.alias("window"), *by).agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.col("is_refused").cast("double")).alias("refusal_rate"), F.avg("total_latency_ms").alias("mean_latency_ms"), F.sum("total_tokens").alias("tokens"),
    )
    return stats.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), *by, "n", "refusal_rate", "mean_latency_ms", "tokens")


def deduplicated(rows: DataFrame, key: str = "id", late: str = "1 hour") -> DataFrame:
    """H9: one row per key; a re-delivery within ``late`` is dropped, and state is kept no longer than that."""
    return rows.withWatermark("ts", late).dropDuplicatesWithinWatermark([key])


def upsert_each_batch(stats: DataFrame, checkpoint: str, write: Callable[[DataFrame, int], None], once: bool = True) -> StreamingQuery:
    """Hand every micro-batch of updated windows to ``write`` (batch, number); ``once``: take all that is there, then end."""
    writer = stats.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(write)
    return (writer.trigger(availableNow=True) if once else writer).start()
