"""Streams: extraction is stateless; reports by event time keep state under a watermark."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from metrolith.operators.extract import extract


def extract_stream(texts: DataFrame, text_col: str = "text", id_cols: Sequence[str] = ()) -> DataFrame:
    """extract() of a stream: the same plan, in append mode without state."""
    return extract(texts, text_col, id_cols)


def windowed(q: DataFrame, time_col: str, size: str, slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Tumbling (or, with slide, sliding) windows by change and unit; rows later than `late` are dropped."""
    q = q.withWatermark(time_col, late) if q.isStreaming else q
    window = F.window(time_col, size, slide) if slide else F.window(time_col, size)
    out = q.groupBy(window.alias("w"), "change", "unit_norm").agg(F.count("*").alias("n"), F.sum("lower").alias("total"))
    return out.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "change", "unit_norm", "n", "total")


def sessions(q: DataFrame, time_col: str, gap: str, key: str, late: str = "10 minutes") -> DataFrame:
    """Session windows of a key's quantities."""
    q = q.withWatermark(time_col, late) if q.isStreaming else q
    out = q.groupBy(F.session_window(time_col, gap).alias("w"), key).agg(F.count("*").alias("n"))
    return out.select(key, F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "n")


def run_once(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Writes all that is there to Parquet and ends."""
    return stream.writeStream.format("parquet").outputMode(mode).option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
