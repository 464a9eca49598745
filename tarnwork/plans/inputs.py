"""How the test tables stand for the operators' inputs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.blocks import text_blocks

#: text of SQL for the same
LINES_SQL = """
lines AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS l, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) - 1 AS ord FROM documents),
blocks AS (SELECT doc_id, ord::INT AS ord, (ord // 8 + 1)::INT AS page, (ord % 8 * 12)::DOUBLE AS y0, CASE WHEN length(t) < 60 AND NOT regexp_matches(t, '[.,;:]$') THEN 14.0 ELSE 10.0 END::DOUBLE AS size, t AS text
  FROM (SELECT *, trim(regexp_replace(l, '\\s+', ' ', 'g')) AS t FROM lines) WHERE t <> '')
"""
SECTIONS_SQL = LINES_SQL + """,
sections AS (SELECT doc_id, ord, page, y0, 1 + length(text) % 3 AS level, text AS title, CASE length(text) % 5 WHEN 0 THEN 'eligibility' WHEN 1 THEN 'objectives' WHEN 2 THEN 'history' END AS type FROM blocks WHERE length(text) < 60)
"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_blocks(table(spark, sf_dir, "documents"))


def sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Short lines stand for headings; their length gives level and type."""
    n = F.char_length("text")
    kind = F.when(n % 5 == 0, "eligibility").when(n % 5 == 1, "objectives").when(n % 5 == 2, "history")
    return blocks(spark, sf_dir).filter(n < 60).select("doc_id", "ord", "page", "y0", (1 + n % 3).alias("level"), F.col("text").alias("title"), kind.alias("type"))
