"""Exact duplicates by a 128-bit content hash, confirmed byte by byte. DataFrame functions only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z only; in a text of ASCII alone that is lower(), which is faster."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def duplicate_groups(docs: DataFrame, normal: Callable[[Column], Column] = lambda text: text, keep: str = "min", digest: Callable[[Column], Column] = F.md5) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256.

    Rows are grouped by (128-bit hash, normalised text): the hash finds the group, the comparison of the key's bytes inside it keeps texts
    apart whose hashes collide. Copies meet in a partial aggregate before the shuffle, so a text that holds a third of all rows sends one
    row per task. The groups go back to the rows by hash and SHA-256 alone, without texts; skewed hashes are split there by Spark.

    Null text counts as empty. keep is "min" or "max": the doc_id that stays; a null doc_id stays only if its group has no other. Rows
    that repeat the kept doc_id with the same text are all kept. An empty table gives no rows. Other columns are ignored.
    """
    rows = docs.select("doc_id", normal(F.coalesce("text", F.lit(""))).alias("_text")).withColumn("_hash", digest("_text"))
    best = F.max("doc_id") if keep == "max" else F.min("doc_id")
    groups = rows.groupBy("_hash", "_text").agg(best.alias("keep_id"), F.count("*").alias("group_size"))
    groups = groups.select("_hash", F.sha2("_text", 256).alias("text_sha256"), "keep_id", "group_size")
    members = rows.select("doc_id", "_hash", F.sha2("_text", 256).alias("text_sha256"))
    return members.join(groups, ["_hash", "text_sha256"]).select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def drop_duplicates(docs: DataFrame) -> DataFrame:
    """Rows of docs whose text has no copy with a smaller doc_id; of rows with equal doc_id and text the least by its other columns stays.

    Columns stay as they are; maps, which have no order, are compared as JSON. Null text counts as empty, after a text that is empty; a null doc_id
    stays only without any other.
    """
    extra = [c for c in docs.columns if c not in ("doc_id", "text")]
    maps = [c for c in extra if "map<" in docs.schema[c].dataType.simpleString()]
    rest = [F.to_json(F.struct(F.col(f"`{c}`"))).alias(c) if c in maps else F.col(f"`{c}`") for c in extra]
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").alias("id"), F.col("text").isNull().alias("null_text"), F.struct(F.lit(0).alias("0"), *rest).alias("rest"))
    rows = docs.select(F.coalesce("text", F.lit("")).alias("_text"), order.alias("_row"), F.struct(F.lit(0).alias("0"), *(F.col(f"`{c}`") for c in maps)).alias("_maps"))
    best = [F.min("_row").alias("_row")] + ([F.min_by("_maps", "_row").alias("_maps")] if maps else [])
    one = rows.groupBy(F.md5("_text").alias("_hash"), "_text").agg(*best)
    got = {c: F.col(f"_maps.`{c}`") if c in maps else F.col(f"_row.rest.`{c}`") for c in extra} | {"doc_id": F.col("_row.id"), "text": F.when(~F.col("_row.null_text"), F.col("_text"))}
    return one.select(*(got[c].alias(c) for c in docs.columns))
