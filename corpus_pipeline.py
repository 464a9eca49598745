"""A corpus from documents to packed sequences: quality rules, exact dedup, near-duplicate dedup, removal of personal data, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next stage's docs. All but
the last return the columns of documents. Null texts count as empty, which the quality rules reject.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tarnwork.llm.common import Held, deleted, new_dir
from tarnwork.llm.exact_dedup import drop_duplicates
from tarnwork.llm.ngram_jaccard import one_of_each_group
from tarnwork.llm.packing import pack_documents
from tarnwork.llm.pii import redact
from tarnwork.llm.quality_rules import quality_filter
from tarnwork.llm.tokens import public_tokenizer


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the quality rules reject."""
    return quality_filter(docs)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest doc_id of each text."""
    return drop_duplicates(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest doc_id of each group linked by a Jaccard similarity of 0.8 or more over five-word shingles."""
    return one_of_each_group(docs, n=5, percent=80)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data by its kind; no document goes."""
    return redact(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs all documents into sequences of at most 2048 tokens, a row for each piece."""
    return pack_documents(docs, public_tokenizer("byte_bpe_50k.json"), end_id=0, size=2048)


STAGES = [("quality_rules", quality_rules), ("exact_dedup", exact_dedup), ("near_dedup", near_dedup), ("personal_data", personal_data), ("packing", packing)]

#: No SQL: similarity links need their closure, the field and the tokenizer run outside SQL. tests/llm holds run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents. Each is stored before the next, and what it needed is removed then."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        path = new_dir(spark, f"stage-{name}")
        with Held(spark) as held:
            stage(spark, docs, sf_dir).write.parquet(path)
        held.released()
        if before:
            deleted(spark, before)
        docs, before = spark.read.parquet(path), path
    return docs
