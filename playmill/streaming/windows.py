"""Event-time windows that work on batch and streaming tables alike."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def windowed(df: DataFrame, time: str, size: str, slide: str | None, keys: list[str], aggs: list[Column], late: str | None = None) -> DataFrame:
    """Tumbling or sliding windows; with ``late`` rows behind the watermark are dropped on a stream."""
    if late:
        df = df.withWatermark(time, late)
    return df.groupBy(F.window(time, size, slide), *keys).agg(*aggs)


def sessions(df: DataFrame, time: str, gap: str, keys: list[str], aggs: list[Column], late: str | None = None) -> DataFrame:
    """Session windows per key."""
    if late:
        df = df.withWatermark(time, late)
    return df.groupBy(F.session_window(time, gap), *keys).agg(*aggs)
