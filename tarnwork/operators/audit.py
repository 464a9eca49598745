"""An append-only log: its latest and as-of states, summaries and orders. Insertion order (seq), never time, decides."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DECISIONS = ("BLOCK", "REVIEW", "AUTO_ACCEPT")


def latest_by_key(log: DataFrame, keys: list[str], seq: str = "seq") -> DataFrame:
    """The last row of each key. Rows meet in a partial aggregate, so a hot key sends one row per task."""
    rest = [c for c in log.columns if c not in (*keys, seq)]
    last = log.groupBy(*keys).agg(F.max(F.struct(seq, *rest)).alias("_last"))
    return last.select(*keys, *(F.col(f"_last.{c}").alias(c) for c in (seq, *rest)))


def as_of(log: DataFrame, keys: list[str], value: str, cut: Column, edit: Column, seq: str = "seq") -> DataFrame:
    """Per key: cut_seq (the last row for which cut holds), original (first value), certified (last value up to the cut), edited. Keys without a cut drop out."""
    cuts = log.filter(cut).groupBy(*keys).agg(F.max(seq).alias("cut_seq"))
    rows = log.join(cuts, keys)
    return rows.groupBy(*keys).agg(
        F.first("cut_seq").alias("cut_seq"),
        F.min_by(value, seq).alias("original"),
        F.max_by(F.when(F.col(seq) <= F.col("cut_seq"), F.col(value)), F.when(F.col(seq) <= F.col("cut_seq"), F.col(seq))).alias("certified"),
        F.max(edit.cast("int")).cast("boolean").alias("edited"),
    )


def summarize_distances(rows: DataFrame, distance: str, edited: str, by: list[str] | None = None) -> DataFrame:
    """n, n_edited, mean over all, mean over edited ones (null without any)."""
    return rows.groupBy(*(by or [])).agg(
        F.count("*").alias("n"), F.count_if(F.col(edited)).alias("n_edited"), F.avg(distance).alias("mean_distance"), F.avg(F.when(F.col(edited), F.col(distance))).alias("mean_edited")
    )


def decision_counts(rows: DataFrame, by: list[str], decision: str = "decision") -> DataFrame:
    """A column per decision, zero-filled, and the sorted runs."""
    counts = [F.count_if(F.col(decision) == d).alias(f"n_{d.lower()}") for d in DECISIONS]
    return rows.groupBy(*by).agg(F.count("*").alias("n_records"), *counts)


def risk_rank(decision: Column) -> Column:
    """BLOCK before REVIEW (and unknown ones) before AUTO_ACCEPT."""
    return F.when(decision == "BLOCK", 0).when(decision == "AUTO_ACCEPT", 2).otherwise(1)


def risk_sorted(rows: DataFrame, decision: str = "decision", confidence: str = "confidence", seq: str = "seq") -> DataFrame:
    """Riskiest first: by decision, then confidence (null is 0), then insertion."""
    return rows.orderBy(risk_rank(F.col(decision)), F.coalesce(F.col(confidence), F.lit(0.0)), seq)


def append_new(log: DataFrame, rows: DataFrame, key: str = "record_id") -> DataFrame:
    """Rows whose key the log does not have yet, once each: the first by seq."""
    fresh = rows.join(log.select(key).distinct(), key, "left_anti")
    return fresh.groupBy(key).agg(F.min(F.struct("seq", *(c for c in rows.columns if c not in (key, "seq")))).alias("_first")).select(key, "_first.*")
