"""The append-only log as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def latest_values(stream: DataFrame, keys: list[str], seq: str = "seq") -> DataFrame:
    """The latest row of each key so far; for update or complete output. Works on batches too."""
    rest = [c for c in stream.columns if c not in (*keys, seq)]
    return stream.groupBy(*keys).agg(F.max(F.struct(seq, *rest)).alias("_last")).select(*keys, *(F.col(f"_last.{c}").alias(c) for c in (seq, *rest)))


def once(stream: DataFrame, key: str = "record_id", ts: str = "ts", lateness: str = "10 minutes") -> DataFrame:
    """Drops repeated records that come within the lateness; state older than that goes."""
    return stream.withWatermark(ts, lateness).dropDuplicatesWithinWatermark([key])


def windowed_counts(stream: DataFrame, ts: str, by: list[str], size: str = "1 hour", lateness: str = "10 minutes") -> DataFrame:
    """Counts by tumbling window; late rows beyond the lateness are left out."""
    return stream.withWatermark(ts, lateness).groupBy(F.window(ts, size), *by).agg(F.count("*").alias("n"))
