"""Queries over assembly shapes and caches, with their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shared import shared_dir
from ..sources import files, latest
from ..streaming.log import windowed_counts
from . import assembly as A
from . import nested as N
from . import routes as R
from .full import full_loop, produced
from .inputs import table
from .spine import metadata


def sanitized_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select("p_partkey", F.when(F.col("p_size") % 3 > 0, F.concat(F.lit("  "), F.col("p_name"))).alias("name"), F.when(F.col("p_size") % 4 > 0, F.col("p_type")).otherwise(F.lit(" ")).alias("kind"))
    return A.sanitize(p, ["p_partkey"], {"name": ("unnamed", "ERROR"), "kind": ("", "INFO")})[0]


SANITIZED_PARTS = "SELECT p_partkey, CASE WHEN p_size % 3 > 0 THEN p_name ELSE 'unnamed' END AS name, CASE WHEN p_size % 4 > 0 THEN p_type ELSE '' END AS kind FROM part"


def sanitizer_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select("p_partkey", F.when(F.col("p_size") % 3 > 0, F.col("p_name")).alias("name"), F.when(F.col("p_size") % 4 > 0, F.col("p_type")).alias("kind"))
    return A.sanitize(p, ["p_partkey"], {"name": ("unnamed", "ERROR"), "kind": ("", "INFO")})[1]


SANITIZER_FINDINGS = "SELECT p_partkey, 'name' AS field, 'ERROR' AS severity FROM part WHERE p_size % 3 = 0 UNION ALL SELECT p_partkey, 'kind', 'INFO' FROM part WHERE p_size % 4 = 0"


def unique_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.unique_names(table(spark, sf_dir, "part").select("p_brand", "p_partkey", F.col("p_name").alias("name")), ["p_brand"], "name", "p_partkey")


UNIQUE_NAMES = "WITH n AS (SELECT p_brand, p_partkey, p_name, row_number() OVER (PARTITION BY p_brand, lower(p_name) ORDER BY p_partkey) AS i FROM part) SELECT p_brand, p_partkey, CASE WHEN i > 1 THEN p_name || ' (' || i || ')' ELSE p_name END AS name FROM n"


def _nested_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as nested studies: a title, identifiers with a scope, criteria; some of them blank at each depth."""
    li = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_suppkey").alias("s"), F.max("l_partkey").alias("p"), F.max("l_quantity").cast("int").alias("q"))
    name = F.when(F.col("p") % 5 > 0, F.concat(F.lit(" n  "), (F.col("p") % 3).cast("string")))
    one = F.struct("l_linenumber", F.struct(F.when(F.col("s") % 3 > 0, F.concat(F.lit("L"), F.col("l_linenumber").cast("string"))).otherwise(" ").alias("id"), name.alias("name"), F.struct(F.col("q").alias("size"), F.array(F.lit("a"), F.when(F.col("q") > 25, F.lit("\tb"))).alias("labels")).alias("scope")).alias("x"))
    many = li.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.transform(F.array_sort(F.collect_list(one)), lambda e: e["x"]).alias("identifiers"))
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_custkey") % 4 == 1, "  A\t study ").when(F.col("o_custkey") % 4 > 1, F.concat(F.lit("Study "), F.col("o_custkey").cast("string"))).alias("title"), F.when(F.col("o_orderstatus") == "F", F.lit(True)).alias("healthy"))
    return o.join(many, "o_orderkey", "left")


def nested_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    gaps = {"title": ("", "ERROR"), "identifiers": (None, "ERROR"), "identifiers[].id": ("", "WARNING"), "healthy": (False, "WARNING")}
    return N.sanitize_nested(_nested_orders(spark, sf_dir), "o_orderkey", gaps, unique=("identifiers[].name",))[1]


NESTED_SQL = """l AS (SELECT l_orderkey AS o_orderkey, l_linenumber, max(l_suppkey) % 3 = 0 AS no_id, max(l_partkey) AS p, max(l_quantity)::INT AS q FROM lineitem GROUP BY ALL),
e AS (SELECT *, CASE WHEN p % 5 > 0 THEN 'n ' || p % 3 END AS name, row_number() OVER (PARTITION BY o_orderkey ORDER BY l_linenumber) - 1 AS i, 'identifiers[' || (row_number() OVER (PARTITION BY o_orderkey ORDER BY l_linenumber) - 1) || ']' AS loc FROM l),
n AS (SELECT *, row_number() OVER (PARTITION BY o_orderkey, name ORDER BY i) AS nth FROM e WHERE name IS NOT NULL)"""
NESTED_FINDINGS = f"""
WITH {NESTED_SQL}
SELECT o_orderkey, 'title' AS path, 'missing' AS kind, 'ERROR' AS severity FROM orders WHERE o_custkey % 4 = 0 UNION ALL SELECT o_orderkey, 'title', 'trimmed', 'INFO' FROM orders WHERE o_custkey % 4 = 1
UNION ALL SELECT o_orderkey, 'healthy', 'missing', 'WARNING' FROM orders WHERE o_orderstatus <> 'F' UNION ALL SELECT o_orderkey, 'identifiers', 'missing', 'ERROR' FROM orders WHERE o_orderkey NOT IN (SELECT o_orderkey FROM e)
UNION ALL SELECT o_orderkey, loc || '.id', 'missing', 'WARNING' FROM e WHERE no_id UNION ALL SELECT o_orderkey, loc || '.name', CASE WHEN name IS NULL THEN 'missing' ELSE 'trimmed' END, 'INFO' FROM e
UNION ALL SELECT o_orderkey, loc || '.name', 'renamed', 'INFO' FROM n WHERE nth > 1
UNION ALL SELECT o_orderkey, loc || '.scope.labels[1]', CASE WHEN q > 25 THEN 'trimmed' ELSE 'dropped' END, 'INFO' FROM e
"""


def nested_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    clean = N.sanitize_nested(_nested_orders(spark, sf_dir), "o_orderkey", {"healthy": (False, "WARNING")}, unique=("identifiers[].name",))[0]
    return clean.select("o_orderkey", "title", "healthy", F.explode_outer("identifiers").alias("x")).select("o_orderkey", "title", "healthy", "x.id", "x.name", F.col("x.scope.size").alias("size"), F.array_join("x.scope.labels", ",").alias("labels"))


NESTED_VALUES = f"""
WITH {NESTED_SQL}
SELECT o.o_orderkey, CASE o_custkey % 4 WHEN 0 THEN '' WHEN 1 THEN 'A study' ELSE 'Study ' || o_custkey END AS title, o_orderstatus = 'F' AS healthy, CASE WHEN e.i IS NULL THEN NULL WHEN e.no_id THEN '' ELSE 'L' || e.l_linenumber END AS id,
  CASE WHEN e.i IS NOT NULL THEN coalesce(e.name || CASE WHEN nth > 1 THEN ' (' || nth || ')' ELSE '' END, '') END AS name, e.q AS size, CASE WHEN e.i IS NOT NULL THEN 'a' || CASE WHEN e.q > 25 THEN ',b' ELSE '' END END AS labels
FROM orders o LEFT JOIN e ON o.o_orderkey = e.o_orderkey LEFT JOIN n ON n.o_orderkey = e.o_orderkey AND n.i = e.i
"""
#: rules over the nested orders, as rows of a table
NESTED_RULES = [
    ("has_title", "title", "all", "trim(x) <> ''", "ERROR"),
    ("has_identifiers", "identifiers[]", "some", "x is not null", "ERROR"),
    ("ids_are_given", "identifiers[].id", "all", "trim(x) <> ''", "WARNING"),
    ("names_differ", "identifiers[].name", "unique", "lower(x)", "WARNING"),
    ("no_large_scope", "identifiers[].scope.size", "none", "x > 45", "INFO"),
    ("some_second_label", "identifiers[].scope.labels[]", "some", "x like '%b'", "INFO"),
    ("named_if_large", "identifiers[]", "all", "x.scope.size <= 40 or x.name is not null", "ERROR"),
    ("small_in_open_orders", "identifiers[].scope.size", "all", "healthy or x < 49", "INFO"),
]


def broken_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(NESTED_RULES, "rule string, path string, quantifier string, predicate string, severity string")
    return N.broken_rules(_nested_orders(spark, sf_dir), "o_orderkey", rules)


BROKEN_RULES = f"""
WITH {NESTED_SQL}, o AS (SELECT o_orderkey, o_custkey, o_orderstatus = 'F' AS f FROM orders),
r AS (
  SELECT o_orderkey, 'has_title' AS rule, 'ERROR' AS severity, (o_custkey % 4 = 0)::INT AS n FROM o UNION ALL SELECT o.o_orderkey, 'has_identifiers', 'ERROR', (count(e.i) = 0)::INT FROM o LEFT JOIN e ON o.o_orderkey = e.o_orderkey GROUP BY 1
  UNION ALL SELECT o_orderkey, 'ids_are_given', 'WARNING', count(*) FILTER (no_id) FROM e GROUP BY 1 UNION ALL SELECT o_orderkey, 'names_differ', 'WARNING', count(name) - count(DISTINCT name) FROM e GROUP BY 1
  UNION ALL SELECT o_orderkey, 'no_large_scope', 'INFO', count(*) FILTER (q > 45) FROM e GROUP BY 1 UNION ALL SELECT o.o_orderkey, 'some_second_label', 'INFO', (count(*) FILTER (q > 25) = 0)::INT FROM o LEFT JOIN e ON o.o_orderkey = e.o_orderkey GROUP BY 1
  UNION ALL SELECT o_orderkey, 'named_if_large', 'ERROR', count(*) FILTER (q > 40 AND name IS NULL) FROM e GROUP BY 1 UNION ALL SELECT e.o_orderkey, 'small_in_open_orders', 'INFO', count(*) FILTER (NOT f AND q >= 49) FROM e JOIN o ON o.o_orderkey = e.o_orderkey GROUP BY 1)
SELECT o_orderkey, rule, severity, n::INT AS n FROM r WHERE n > 0
"""
def salvaged_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame([*NESTED_RULES, ("no_huge_scope", "identifiers[].scope.size", "none", "x > 46", "ERROR"), ("is_healthy", "healthy", "all", "x", "INFO")], "rule string, path string, quantifier string, predicate string, severity string")
    kept = N.salvaged(_nested_orders(spark, sf_dir), "o_orderkey", rules, required=("title",), degrade={"identifiers": "scope"})
    counts = {"n_identifiers": F.when(F.col("identifiers").isNotNull(), F.size("identifiers")), "n_scopes": F.when(F.col("identifiers").isNotNull(), F.size(F.filter("identifiers", lambda x: x["scope"].isNotNull())))}
    return kept.withColumns(counts).select("o_orderkey", "title", "healthy", "n_identifiers", "n_scopes", "ok", F.col("statuses")["identifiers"].alias("identifiers"), F.round("reliance", 6).alias("reliance"))


SALVAGED_ORDERS = f"""
WITH {NESTED_SQL}, i AS (SELECT o_orderkey, count(*) AS n, count(*) FILTER (q > 40 AND name IS NULL) > 0 AS bad, count(*) FILTER (q > 46) > 0 AS huge FROM e GROUP BY 1),
s AS (SELECT o.o_orderkey, CASE o_custkey % 4 WHEN 1 THEN '  A' || chr(9) || ' study ' WHEN 0 THEN NULL ELSE 'Study ' || o_custkey END AS t, CASE WHEN o_orderstatus = 'F' THEN true END AS h, n, CASE WHEN n IS NULL THEN NULL WHEN bad THEN 'dropped' WHEN huge THEN 'degraded' ELSE 'kept' END AS st FROM orders o LEFT JOIN i ON o.o_orderkey = i.o_orderkey)
SELECT o_orderkey, t AS title, CASE WHEN t IS NOT NULL THEN h END AS healthy, CASE WHEN t IS NOT NULL AND st <> 'dropped' THEN n END::INT AS n_identifiers, CASE WHEN t IS NOT NULL AND st = 'kept' THEN n WHEN t IS NOT NULL AND st = 'degraded' THEN 0 END::INT AS n_scopes, t IS NOT NULL AS ok, st AS identifiers,
  CASE WHEN t IS NULL AND h IS NULL AND st IS NULL THEN NULL WHEN t IS NULL THEN 0 ELSE round((1 + (h IS NOT NULL)::INT + coalesce((st <> 'dropped')::INT, 0)) / (1.0 + (h IS NOT NULL)::INT + (st IS NOT NULL)::INT), 6) END::DOUBLE AS reliance FROM s
"""
#: rules for fields of customers; families are their market segments, phases the last digits of their nations
ROUTE_RULES = [
    (1, "title", "primary", None, None, ["header"], None, None), (2, "title", "primary", "BUILDING", None, ["summary"], None, None), (3, "title", "primary", None, "1", ["design"], None, None), (4, "title", "primary", "BUILDING", "1", ["population"], ["main"], None),
    (5, "title", "prohibited", None, None, None, ["history"], None), (6, "arms", "supporting", "MACHINERY", None, ["design", "summary"], None, ["part a"]), (7, "arms", "supporting", "MACHINERY", None, ["header"], None, None), (8, "title", "supporting", None, None, ["summary", "design"], None, None),
]


def route_plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _route_plans(spark, sf_dir).select("doc_id", "field", *(F.col(f"{r}.rule").alias(r) for r in R.ROLES))


def _route_plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("doc_id"), F.col("c_mktsegment").alias("family"), F.when(F.col("c_nationkey") % 10 > 0, (F.col("c_nationkey") % 10).cast("string")).alias("phase"))
    return R.study_plans(c, spark.createDataFrame(ROUTE_RULES, R.RULE))


ROUTE_PLANS_SQL = """c AS (SELECT c_custkey AS doc_id, c_mktsegment AS f, c_nationkey % 10 = 1 AS one FROM customer),
p AS (SELECT doc_id, 'title' AS field, 5 AS prohibited, CASE WHEN f = 'BUILDING' AND one THEN 4 WHEN f = 'BUILDING' THEN 2 WHEN one THEN 3 ELSE 1 END AS "primary", 8 AS supporting FROM c UNION ALL SELECT doc_id, 'arms', NULL, NULL, 6 FROM c WHERE f = 'MACHINERY')"""
ROUTE_PLANS = f"WITH {ROUTE_PLANS_SQL} SELECT * FROM p"


def routed_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of a customer as sections, typed by their priority, and what they are to each field."""
    kind = F.element_at(F.array(*map(F.lit, ("header", "summary", "design", "population", "other"))), F.left("o_orderpriority", F.lit(1)).cast("int"))
    s = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("doc_id"), F.col("o_orderkey").alias("ord"), kind.alias("type"), F.when(F.col("o_orderstatus") == "P", "history").when(F.col("o_orderstatus") == "F", "main").alias("subtype"), F.when(F.col("o_orderkey") % 2 == 0, "part a").alias("scope"))
    return R.routed(_route_plans(spark, sf_dir), s)


ROUTED_SECTIONS = f"""
WITH {ROUTE_PLANS_SQL}, s AS (SELECT o_custkey AS doc_id, o_orderkey AS ord, ['header', 'summary', 'design', 'population', 'other'][left(o_orderpriority, 1)::INT] AS t, o_orderstatus AS u, o_orderkey % 2 = 0 AS a FROM orders),
m AS (SELECT doc_id, ord, field, CASE WHEN prohibited = 5 AND u = 'P' THEN 'prohibited' WHEN ("primary" = 1 AND t = 'header') OR ("primary" = 2 AND t = 'summary') OR ("primary" = 3 AND t = 'design') OR ("primary" = 4 AND t = 'population' AND u = 'F') THEN 'primary'
  WHEN (supporting = 8 AND t IN ('summary', 'design')) OR (supporting = 6 AND t IN ('summary', 'design') AND a) THEN 'supporting' END AS role FROM s JOIN p USING (doc_id))
SELECT * FROM m WHERE role IS NOT NULL
"""


def activity_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_linenumber").alias("activity_ord"), F.concat(F.lit("a"), F.col("l_linenumber").cast("string")).alias("activity"), F.col("l_suppkey").alias("visit"), (F.col("l_quantity") > 25).alias("marked"))
    return A.timeline(li, ["l_orderkey"]).withColumn("visits", F.array_join(F.transform("visits", lambda v: v.cast("string")), ","))


ACTIVITY_LINKS = """
WITH a AS (SELECT l_orderkey, l_linenumber AS o, coalesce(array_to_string(list_sort(list(DISTINCT l_suppkey) FILTER (l_quantity > 25)), ','), '') AS visits FROM lineitem GROUP BY ALL)
SELECT l_orderkey, 'a' || o AS activity, visits, 'a' || lag(o) OVER w AS previous, 'a' || lead(o) OVER w AS next FROM a WINDOW w AS (PARTITION BY l_orderkey ORDER BY o)
"""


def assembled_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, li = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k")), table(spark, sf_dir, "lineitem")
    parts = {"open": li.filter("l_linestatus = 'O'"), "closed": li.filter("l_linestatus = 'F' and l_quantity > 25")}
    out = A.assemble(o, {n: p.select(F.col("l_orderkey").alias("k"), "l_linenumber") for n, p in parts.items()}, "k")
    return out.select("k", F.size("open").alias("n_open"), F.size("closed").alias("n_closed"), "produced").withColumns({c: F.when(F.col(c) > 0, F.col(c)) for c in ("n_open", "n_closed")})


ASSEMBLED_ORDERS = """
WITH s AS (SELECT o_orderkey AS k, nullif(count(*) FILTER (l_linestatus = 'O'), 0)::INT AS n_open, nullif(count(*) FILTER (l_linestatus = 'F' AND l_quantity > 25), 0)::INT AS n_closed FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1)
SELECT *, ((n_open IS NOT NULL)::INT + (n_closed IS NOT NULL)::INT) / 2.0::DOUBLE AS produced FROM s
"""


def failed_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", F.array_compact(F.array(F.when(F.col("l_tax") > 0.06, F.lit("TAX")), F.when(F.col("l_quantity") > 40, F.lit("QTY")))).alias("rules"))
    return A.failed_rules(li, "l_orderkey").withColumn("failed", F.array_join("failed", ","))


FAILED_RULES = "SELECT l_orderkey, concat_ws(',', CASE WHEN bool_or(l_quantity > 40) THEN 'QTY' END, CASE WHEN bool_or(l_tax > 0.06) THEN 'TAX' END) AS failed FROM lineitem GROUP BY 1"


def cached_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replies from a cache of events on disk, the latest of a user over earlier ones; errors are blank and not stored. A third of the events come late, after a compaction."""
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("key"), F.when(F.col("event_type") != "error", F.col("event_type")).otherwise(F.lit(" ")).alias("response"), F.col("event_id").alias("seq"))
    path = f"{shared_dir(spark)}/cache-{uuid.uuid4().hex}"
    e = e.withColumn("key", F.col("key").cast("string"))
    old, new = e.filter("seq % 3 = 0"), e.filter("seq % 3 > 0")
    files.write_cache(new, path)
    latest.compact(spark, path, ["key"], files.CACHE)
    files.write_cache(old, path)
    return files.cached(e.select("key").distinct(), files.read_cache(spark, path)).withColumn("key", F.col("key").cast("long"))


CACHED_REPLIES = "SELECT user_id AS key, arg_max(event_type, event_id) FILTER (event_type <> 'error') AS response FROM events GROUP BY 1"


def parsed_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit('Sure: [{"field": "name", "value": "'), F.col("p_name"), F.lit('", "quote": ""}, {"field": "other", "value": "x"}, {"field": "kind", "value": " "}] done')).alias("prompt"))
    fields = spark.createDataFrame([("name",), ("kind",)], "field string")
    return A.parse_candidates(A.complete(p, lambda prompts: prompts), ["p_partkey"], fields)


PARSED_REPLIES = r"""
WITH r AS (SELECT p_partkey, 'Sure: [{"field": "name", "value": "' || p_name || '", "quote": ""}, {"field": "other", "value": "x"}, {"field": "kind", "value": " "}] done' AS reply FROM part),
c AS (SELECT p_partkey, unnest(from_json(regexp_extract(reply, '(\[.*\])', 1), '[{"field": "VARCHAR", "value": "VARCHAR", "quote": "VARCHAR"}]')) AS c FROM r)
SELECT p_partkey, c.field AS field, c.value AS value, nullif(trim(c.quote), '') AS quote FROM c WHERE trim(c.value) <> '' AND c.field IN ('name', 'kind')
"""


def reply_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    reply = F.when(F.col("p_size") % 3 == 0, F.lit("Unsupported.")).when(F.col("p_size") % 3 == 1, F.lit("it is SUPPORTED")).otherwise(F.lit("no idea"))
    return p.select("p_partkey", A.parse_verdict(reply).alias("verdict"))


REPLY_VERDICTS = r"""
WITH r AS (SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN 'Unsupported.' WHEN 1 THEN 'it is SUPPORTED' ELSE 'no idea' END AS reply FROM part) SELECT p_partkey, nullif(regexp_extract(lower(reply), '(^|[^a-z])(unsupported|supported|partial)([^a-z]|$)', 2), '') AS verdict FROM r
"""


def hourly_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windowed_counts(table(spark, sf_dir, "events"), "ts", ["event_type"]).select(F.col("window.start").alias("hour"), "event_type", "n")


HOURLY_EVENTS = "SELECT date_trunc('hour', ts) AS hour, event_type, count(*) AS n FROM events GROUP BY ALL"

def vision_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    page = F.concat(F.lit('{"is_schedule": '), (F.col("p_size") % 4 > 0).cast("string"), F.lit(', "columns": [{"visit": "V", "epoch": "E1"}, {"visit": " v ", "epoch": ""}, {"visit": "W", "epoch": "E2"}], "rows": [{"activity": "'), F.col("p_name"), F.lit('", "marks": [1, 1, 7]}, {"activity": "b", "marks": [2]}]}'))
    return A.schedule_pages(p.select("p_partkey", F.lit(1).alias("page"), page.alias("reply")), ["p_partkey"])


VISION_PAGES = "SELECT p_partkey, 1 AS page, unnest([p_name, 'b']) AS activity, unnest(['v#2', 'w#1']) AS visit_key, unnest(['E1', 'E2']) AS epoch, unnest([1, 2])::INT AS ord FROM part WHERE p_size % 4 > 0"


def gate_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select("p_partkey", F.when(F.col("p_size") % 3 > 0, F.col("p_name")).alias("title"), (F.col("p_size") % 2).alias("n_arms"), F.lit(4).alias("n_visits"))
    rules = p.filter("n_arms > 0").select("p_partkey", F.lit("R1").alias("rule"))
    return A.failed_rules(A.gates(p, "p_partkey", rules), "p_partkey").withColumn("failed", F.array_join("failed", ","))


GATE_RULES = "SELECT p_partkey, CASE WHEN p_size % 3 > 0 AND p_size % 2 > 0 THEN 'R1' ELSE concat_ws(',', CASE WHEN p_size % 2 = 0 THEN 'has_arms' END, CASE WHEN p_size % 3 = 0 THEN 'has_title' END) END AS failed FROM part"


def metadata_spine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From texts to decided fields; each document gets labelled lines in front, and a second method that reads its columns."""
    docs = table(spark, sf_dir, "documents")
    lines = F.concat(F.lit("Sponsor: Firm "), F.col("source"), F.lit("\nPhase: tbd\n"), F.coalesce("text", F.lit("")))
    other = docs.select("doc_id", F.lit("sponsor").alias("field"), F.concat(F.lit("firm "), F.col("source")).alias("value"), F.lit("m1").alias("method"), F.lit(True).alias("is_model"), F.lit(9).alias("ord"))
    labels = spark.createDataFrame([("sponsor", "^sponsor"), ("phase", "^phase")], "field string, pattern string")
    return metadata(docs.select("doc_id", lines.alias("text")), labels, other)


METADATA_SPINE = "SELECT doc_id, unnest(['sponsor', 'phase']) AS field, unnest(['Firm ' || source, NULL]) AS value, unnest([1.0, 0.0])::DOUBLE AS confidence, unnest(['AUTO_ACCEPT', 'BLOCK']) AS decision FROM documents"

def full_studies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole loop over documents, with a title page and a few sections in front of each text: which parts its study has, how its fields were decided, and its findings."""
    d = table(spark, sf_dir, "documents")
    front = F.concat(F.lit("Sponsor: Firm "), F.col("source"), F.lit("\nPhase: Phase 2\nSTUDY DESIGN\nThis is how it is done.\nSubjects are randomized to drug A 5 mg or placebo.\nOBJECTIVES AND ENDPOINTS\nPrimary objective: to see it work.\nAnd more of it.\n"))
    labels = spark.createDataFrame([("sponsor", "^sponsor"), ("phase", "^phase")], "field string, pattern string")
    got = full_loop(d.select("doc_id", F.concat(front, F.coalesce("text", F.lit(""))).alias("text")), labels)
    fields = got["fields"].groupBy("doc_id").agg(F.count_if(F.col("decision") == "AUTO_ACCEPT").alias("n_auto"), F.count_if(F.col("decision") == "REVIEW").alias("n_review"), F.count_if(F.col("decision") == "BLOCK").alias("n_block"))
    findings = got["findings"].groupBy("doc_id").agg(F.count("*").alias("n_findings"))
    studies = got["studies"].select("doc_id", F.array_join(produced(got["studies"]), ",").alias("parts"), "produced")
    return studies.join(fields, "doc_id", "left").join(findings, "doc_id", "left")


QUERIES = {
    "nested_findings": nested_findings, "nested_values": nested_values, "broken_rules": broken_rules, "salvaged_orders": salvaged_orders, "route_plans": route_plans, "routed_sections": routed_sections,
    "full_studies": full_studies, "vision_pages": vision_pages, "gate_rules": gate_rules, "metadata_spine": metadata_spine,
    "sanitized_parts": sanitized_parts, "sanitizer_findings": sanitizer_findings, "unique_names": unique_names, "activity_links": activity_links, "assembled_orders": assembled_orders, "failed_rules": failed_rules, "cached_replies": cached_replies, "parsed_replies": parsed_replies, "reply_verdicts": reply_verdicts, "hourly_events": hourly_events,
}
SQL = {
    "nested_findings": NESTED_FINDINGS, "nested_values": NESTED_VALUES, "broken_rules": BROKEN_RULES, "salvaged_orders": SALVAGED_ORDERS, "route_plans": ROUTE_PLANS, "routed_sections": ROUTED_SECTIONS,
    "vision_pages": VISION_PAGES, "gate_rules": GATE_RULES, "metadata_spine": METADATA_SPINE,
    "sanitized_parts": SANITIZED_PARTS, "sanitizer_findings": SANITIZER_FINDINGS, "unique_names": UNIQUE_NAMES, "activity_links": ACTIVITY_LINKS, "assembled_orders": ASSEMBLED_ORDERS, "failed_rules": FAILED_RULES, "cached_replies": CACHED_REPLIES, "parsed_replies": PARSED_REPLIES, "reply_verdicts": REPLY_VERDICTS, "hourly_events": HOURLY_EVENTS,
}
