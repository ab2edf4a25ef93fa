"""Streaming tables: bars of events with a watermark, and sinks."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def bars(events: DataFrame, key: str, time: str, value: str, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Open, high, low, close and count of each key and window, emitted when the watermark passes the window's end."""
    ranked = events.withWatermark(time, late)
    per = ranked.groupBy(F.window(time, width), F.col(key).alias("series")).agg(
        F.min_by(value, time).alias("open"), F.max(value).alias("high"), F.min(value).alias("low"), F.max_by(value, time).alias("close"), F.count("*").cast("double").alias("volume")
    )
    return per.select("series", F.col("window.start").alias("start"), "open", "high", "low", "close", "volume")


def sink(df: DataFrame, path: str, checkpoint: str, kind: str = "parquet", once: bool = False, **options: Any) -> StreamingQuery:
    """Append to files (or another sink); ``once`` takes what is there and ends."""
    writer = df.writeStream.format(kind).option("checkpointLocation", checkpoint).options(**options).outputMode("append")
    writer = writer.trigger(availableNow=True) if once else writer
    return writer.start(path) if path else writer.start()
