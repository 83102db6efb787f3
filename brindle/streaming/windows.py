"""Buckets of a stream of events. An extension: the request language itself has no streaming operator."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def date_histogram(stream: DataFrame, time: str, interval: str, late: str, keys: tuple[str, ...] = (), metrics: dict[str, str] | None = None, slide: str | None = None) -> DataFrame:
    """doc_count and metrics (name -> SQL aggregate) for each window of event time and each key. Events later than `late` behind the newest are dropped, and a window's state goes with them."""
    window = F.window(time, interval, slide) if slide else F.window(time, interval)
    marked = stream.withWatermark(time, late)
    grouped = marked.groupBy(window, *keys).agg(F.count(F.lit(1)).alias("doc_count"), *(F.expr(e).alias(n) for n, e in (metrics or {}).items()))
    return grouped.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), *keys, "doc_count", *(metrics or {}))


def sessions(stream: DataFrame, time: str, gap: str, late: str, key: str) -> DataFrame:
    """doc_count of each session of a key: events with less than `gap` between them."""
    grouped = stream.withWatermark(time, late).groupBy(F.session_window(time, gap), key).agg(F.count(F.lit(1)).alias("doc_count"))
    return grouped.select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), key, "doc_count")
