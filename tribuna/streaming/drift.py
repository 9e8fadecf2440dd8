"""Drift per time window over an event stream; the same code for batch and Structured Streaming sources."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.drift import EPS


def windowed_counts(events: DataFrame, ts: str = "ts", category: str = "event_type", width: str = "1 day", late: str = "2 hours") -> DataFrame:
    """window_start, category, n. A watermark bounds the state of a stream and is ignored in batch."""
    df = events.withWatermark(ts, late) if events.isStreaming else events
    return df.groupBy(F.window(ts, width), category).agg(F.count("*").alias("n")).select(F.col("window.start").alias("window_start"), category, "n")


def windowed_psi(counts: DataFrame, expected: dict[str, float], category: str = "event_type", eps: float = EPS) -> DataFrame:
    """window_start, n, psi against expected shares (a few categories); one aggregate, no window over the stream."""
    share = lambda c: F.greatest(F.sum(F.when(F.col(category) == c, F.col("n")).otherwise(0)) / F.sum("n"), F.lit(eps))
    parts = [(share(c) - F.lit(max(e, eps))) * F.log(share(c) / F.lit(max(e, eps))) for c, e in sorted(expected.items())]
    return counts.groupBy("window_start").agg(F.sum("n").alias("n"), sum(parts[1:], parts[0]).alias("psi"))


def write_stream(counts: DataFrame, path: str, checkpoint: str):
    """Append finished windows to Parquet, exactly once by the checkpoint."""
    return counts.writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
