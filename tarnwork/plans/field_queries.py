"""Queries over fields and nested studies, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import fields as X
from .inputs import table


def field_sanity(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, k = table(spark, sf_dir, "part"), F.col("p_size") % 5
    field = F.when(k == 0, "phase").when(k == 1, "sponsor").when(k == 2, "identifier").when(k == 3, "arm").otherwise("title")
    value = F.when(k == 0, F.concat(F.lit("Phase "), (F.col("p_partkey") % 3 + 1).cast("string"))).when(k == 1, F.concat("p_name", F.lit(" Road"))).when(k == 2, F.col("p_brand")).when(k == 3, F.col("p_type")).otherwise(F.concat("p_name", F.lit(" and more words")))
    return p.select("p_partkey", X.sanity(field, value, F.lit("A phase 2 trial")).alias("sanity"))


FIELD_SANITY = r"""
WITH t AS (SELECT p_partkey, p_size % 5 AS k, CASE p_size % 5 WHEN 0 THEN 'Phase ' || (p_partkey % 3 + 1) WHEN 1 THEN p_name || ' Road' WHEN 2 THEN p_brand WHEN 3 THEN p_type ELSE p_name || ' and more words' END AS v FROM part)
SELECT p_partkey, CASE k WHEN 0 THEN CASE WHEN regexp_extract(lower(v), 'phase\s+([1-4])', 1) = regexp_extract(lower('A phase 2 trial'), 'phase\s+([1-4])', 1) THEN 'confirmed' ELSE 'failed' END WHEN 1 THEN CASE WHEN length(v) > 80 OR regexp_matches(lower(v), '[0-9]{4,}|street|road|avenue') THEN 'failed' ELSE 'neutral' END
  WHEN 2 THEN CASE WHEN length(v) BETWEEN 3 AND 40 AND len(string_split(v, ' ')) <= 6 AND regexp_matches(v, '[0-9]') AND NOT regexp_matches(lower(v), 'template|xxx') THEN 'confirmed' ELSE 'failed' END
  WHEN 3 THEN CASE WHEN length(v) BETWEEN 2 AND 60 AND length(regexp_replace(v, '[^\p{L}]', '', 'g')) >= 3 AND NOT regexp_matches(lower(v), '^[0-9.,]+\s*(mg|ml|g|µg)$') THEN 'confirmed' ELSE 'failed' END
  ELSE CASE WHEN length(v) >= 15 AND length(regexp_replace(v, '[^\p{L}]', '', 'g')) >= 10 AND len(regexp_split_to_array(v, '\s+')) >= 3 AND NOT regexp_matches(v, '\.{4,}') THEN 'confirmed' ELSE 'failed' END END AS sanity FROM t
"""


def arms(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    s = F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("Arm A: "), F.col("p_name"), F.lit("\nArm B: placebo\nArm a: again"))).otherwise(F.concat(F.lit("Subjects are randomized to either "), F.col("p_name"), F.lit(" 10 mg, a placebo or Placebo. More.")))
    names = p.select("p_partkey", X.arm_names(s).alias("a"))
    return names.select("p_partkey", F.array_join("a", "|").alias("arms"), F.array_join(F.transform("a", lambda x: X.arm_type(x)), "|").alias("types"))


ARMS = "SELECT p_partkey, CASE p_size % 2 WHEN 0 THEN 'Arm A|Arm B' ELSE p_name || '|placebo' END AS arms, CASE p_size % 2 WHEN 0 THEN 'experimental|experimental' ELSE 'experimental|placebo' END AS types FROM part"


def objective_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    s = F.concat(F.lit("Intro\nPrimary objective: "), F.col("p_name"), F.lit("\nSecondary Objectives\n  "), F.col("p_type"), F.lit("\nend"))
    return p.select("p_partkey", X.objectives(s).alias("o")).select("p_partkey", "o.*")


OBJECTIVE_LINES = "SELECT p_partkey, p_name AS primary, p_type AS secondary, NULL::VARCHAR AS exploratory FROM part"


def objective_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Brands as documents, parts as rows: a tier's name, an objective or a continuation by size."""
    p, k = table(spark, sf_dir, "part"), F.col("p_size") % 4
    rows = p.select(F.substring("p_brand", 7, 3).cast("long").alias("doc_id"), F.col("p_partkey").alias("row"), F.when(k == 0, F.lit("Secondary objectives")).when(k == 1, F.col("p_name")).otherwise(F.lit("")).alias("objective"), F.col("p_type").alias("endpoint"))
    return X.objective_rows(rows)


OBJECTIVE_TABLE = """
WITH r AS (SELECT substr(p_brand, 7, 3)::BIGINT AS doc_id, p_partkey AS row, p_size % 4 AS k, p_name, p_type FROM part), t AS (SELECT *, CASE WHEN bool_or(k = 0) OVER w THEN 'secondary' END AS tier, (sum((k = 1)::INT) OVER w)::BIGINT AS record FROM r WINDOW w AS (PARTITION BY doc_id ORDER BY row))
SELECT doc_id, record, arg_min(coalesce(tier, '-'), row) AS t0, CASE WHEN arg_min(coalesce(tier, '-'), row) <> '-' THEN 'secondary' END AS tier, arg_min(p_name, row) AS objective, string_agg(p_type, '; ' ORDER BY row) AS endpoints FROM t WHERE k > 0 AND record > 0 GROUP BY doc_id, record
"""
OBJECTIVE_TABLE = f"SELECT doc_id, record, tier, objective, endpoints FROM ({OBJECTIVE_TABLE})"


def estimands(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, k = table(spark, sf_dir, "part"), F.col("p_partkey")
    lines = F.array(F.lit("Population: all"), F.concat(F.lit("Treatment: "), F.col("p_name")), F.lit("other: x"), F.lit("Variable: change"), F.when(k % 2 == 0, F.lit("Summary: mean")).otherwise(F.lit("Intercurrent events: death (composite strategy)")), F.lit("Population: none"))
    return X.estimand_groups(p.select(k.alias("doc_id"), F.posexplode(lines).alias("ord", "text")))


ESTIMANDS = "SELECT p_partkey AS doc_id, 0 AS \"group\", 'all' AS population, p_name AS treatment, 'change' AS variable, CASE WHEN p_partkey % 2 = 0 THEN 'mean' END AS summary, CASE WHEN p_partkey % 2 = 1 THEN 'death (composite strategy)' END AS events, CASE WHEN p_partkey % 2 = 1 THEN 'composite' END AS strategy FROM part"


def study_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    study = F.struct(F.col("c_name").alias("title"), F.lit("").alias("phase"), F.array(F.struct(F.lit("i1").alias("id"), F.lit("o1").alias("scopeId"), F.col("c_mktsegment").alias("text"))).alias("identifiers"), F.array(F.struct(F.lit("o1").alias("id"), F.lit("Org").alias("name"))).alias("organizations"), F.array(F.struct(F.lit("c1").alias("id"), F.lit("t1").alias("itemId"), F.lit("inclusion").alias("category")), F.struct(F.lit("c2").alias("id"), F.lit("t9").alias("itemId"), F.lit("exclusion").alias("category"))).alias("criteria"), F.array(F.struct(F.lit("t1").alias("id"), F.col("c_name").alias("text"))).alias("items"))
    return X.flatten_study(c.select(F.col("c_custkey").alias("study_id"), F.to_json(study).alias("json")))


STUDY_LABELS = "SELECT c_custkey AS study_id, unnest(['metadata', 'identifiers', 'eligibility']) AS domain, unnest(['title', 'Org', 'inclusion_1']) AS field, unnest([c_name, c_mktsegment, c_name]) AS label FROM customer"


def glyphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation")
    return X.glyph_rows(n.select(F.col("n_regionkey").alias("doc_id"), F.lit(1).alias("page"), F.floor(F.col("n_nationkey") / 10).alias("block"), F.col("n_nationkey").alias("span"), F.col("n_name").alias("text"), F.lit(0.0).alias("x0"), F.char_length("n_name").cast("double").alias("x1"))).select("doc_id", "page", "offset", "char", "x0")


GLYPHS = """
WITH s AS (SELECT *, lag(n_nationkey // 10) OVER w AS b, coalesce(lag(length(n_name)) OVER w, 0) AS e FROM nation WINDOW w AS (PARTITION BY n_regionkey ORDER BY n_nationkey)),
t AS (SELECT *, CASE WHEN b IS NULL THEN '' WHEN b <> n_nationkey // 10 THEN chr(10) ELSE ' ' END AS sep FROM s), u AS (SELECT *, sum(length(sep) + length(n_name)) OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - length(sep) - length(n_name) AS pos FROM t),
c AS (SELECT *, unnest(range(0, length(sep) + length(n_name))) AS i FROM u)
SELECT n_regionkey AS doc_id, 1 AS page, (pos + i)::BIGINT AS "offset", substr(sep || n_name, i + 1, 1) AS char, CASE WHEN i < length(sep) THEN e ELSE i - length(sep) END::DOUBLE AS x0 FROM c
"""


def completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, n = table(spark, sf_dir, "part"), F.col("p_size")
    return X.completeness(p.select(F.col("p_partkey").alias("study_id"), F.when(n % 2 == 0, F.lit("1:1")).alias("ratio"), (n % 3).alias("n_arms"), (n % 4).alias("n_visits"), F.lit(1).alias("n_activities"), (n % 5).alias("n_primary"), (n % 7).alias("n_endpoints"), (n % 11).alias("n_inclusion"), F.lit(2).alias("n_exclusion")))


COMPLETENESS = """
SELECT p_partkey AS study_id, 'arms_differ_from_ratio' AS kind, 'ERROR' AS severity FROM part WHERE p_size % 2 = 0 AND p_size % 3 <> 2 UNION ALL SELECT p_partkey, 'no_schedule', 'ERROR' FROM part WHERE p_size % 4 = 0
UNION ALL SELECT p_partkey, 'no_primary_objective', 'ERROR' FROM part WHERE p_size % 5 = 0 UNION ALL SELECT p_partkey, 'objective_without_endpoint', 'ERROR' FROM part WHERE p_size % 5 > 0 AND p_size % 7 = 0 UNION ALL SELECT p_partkey, 'criteria_missing', 'WARNING' FROM part WHERE p_size % 11 = 0
"""


def invariants(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    return X.invariants(li.select("l_orderkey", (F.col("l_linenumber") - 1).alias("activity"), (F.col("l_suppkey") % 3).alias("visit"), F.lit(6).alias("n_activities"), F.lit(3).alias("n_visits")), "l_orderkey")


INVARIANTS = """
WITH o AS (SELECT l_orderkey, bool_and(l_linenumber <= 6) AS a, count(DISTINCT l_suppkey % 3) = 3 AS b, count(DISTINCT l_linenumber) >= 3.6 AS c FROM lineitem GROUP BY 1)
SELECT l_orderkey, unnest(['marks_in_range', 'every_visit_marked', 'most_activities_scheduled']) AS invariant, unnest([a, b, c]) AS holds FROM o
"""


def rederived_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as pages with one cell; a line's flag R stands for a mark."""
    o, li = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    box = lambda v: F.when(F.col("o_custkey") % 9 > 0, F.lit(v))
    cells = o.select(F.col("o_orderkey").alias("page"), F.lit(0).alias("box_id"), box(0.0).alias("x0"), box(0.0).alias("y0"), box(25.0).alias("x1"), box(9.0).alias("y1"), (F.col("o_orderstatus") == "O").alias("claimed"))
    marks = li.select(F.col("l_orderkey").alias("page"), F.when(F.col("l_returnflag") == "R", "x").otherwise("o").alias("char"), F.col("l_quantity").alias("x0"), F.col("l_quantity").alias("x1"), F.col("l_linenumber").cast("double").alias("y0"), F.col("l_linenumber").cast("double").alias("y1"))
    return X.rederived_marks(cells, marks, ["page"]).select("page", "claimed", "rederived", "agrees")


REDERIVED_MARKS = """
WITH m AS (SELECT l_orderkey, bool_or(l_returnflag = 'R' AND l_quantity <= 25) AS m FROM lineitem GROUP BY 1), r AS (SELECT o_orderkey AS page, o_orderstatus = 'O' AS claimed, CASE WHEN o_custkey % 9 = 0 THEN o_orderstatus = 'O' ELSE coalesce(m, false) END AS rederived FROM orders LEFT JOIN m ON o_orderkey = l_orderkey)
SELECT *, claimed = rederived AS agrees FROM r
"""

QUERIES = {"field_sanity": field_sanity, "arms": arms, "objective_lines": objective_lines, "objective_table": objective_table, "estimands": estimands, "study_labels": study_labels, "glyphs": glyphs, "completeness": completeness, "invariants": invariants, "rederived_marks": rederived_marks}
SQL = {"field_sanity": FIELD_SANITY, "arms": ARMS, "objective_lines": OBJECTIVE_LINES, "objective_table": OBJECTIVE_TABLE, "estimands": ESTIMANDS, "study_labels": STUDY_LABELS, "glyphs": GLYPHS, "completeness": COMPLETENESS, "invariants": INVARIANTS, "rederived_marks": REDERIVED_MARKS}
