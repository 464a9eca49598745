"""Queries over logs, scores and relations, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import audit, scoring
from .inputs import table
from .text_queries import ASSURED_SQL, SCORES_SQL, assured_fields, scores


def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("user_id", F.col("event_id").alias("seq"), "event_type", "value")


def latest_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.latest_by_key(_log(spark, sf_dir), ["user_id"])


LATEST_BY_KEY = "SELECT user_id, event_id AS seq, event_type, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1"


def certified_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.as_of(_log(spark, sf_dir), ["user_id"], "event_type", F.col("event_type") == "purchase", F.col("event_type") == "error")


CERTIFIED_SQL = """
cut AS (SELECT user_id, max(event_id) AS cut_seq FROM events WHERE event_type = 'purchase' GROUP BY user_id),
cert AS (SELECT user_id, any_value(cut_seq) AS cut_seq, arg_min(event_type, event_id) AS original, arg_max(event_type, event_id) FILTER (event_id <= cut_seq) AS certified, bool_or(event_type = 'error') AS edited FROM events JOIN cut USING (user_id) GROUP BY user_id)
"""
CERTIFIED_STATE = f"WITH {CERTIFIED_SQL} SELECT * FROM cert"


def edit_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..functions.text import edit_share

    rows = certified_state(spark, sf_dir).withColumn("distance", edit_share(F.col("original"), F.col("certified")))
    return audit.summarize_distances(rows, "distance", "edited").withColumns({c: F.round(c, 9) for c in ("mean_distance", "mean_edited")})


EDIT_SUMMARY = f"""
WITH {CERTIFIED_SQL}, d AS (SELECT *, levenshtein(original, certified)::DOUBLE / greatest(length(original), length(certified)) AS d FROM cert)
SELECT count(*) AS n, count(*) FILTER (edited) AS n_edited, round(avg(d), 9) AS mean_distance, round(avg(d) FILTER (edited), 9) AS mean_edited FROM d
"""


def edit_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edited keys with a certified value, as labels."""
    return certified_state(spark, sf_dir).filter("edited and certified is not null").select("user_id", F.col("certified").alias("label"))


EDIT_LABELS = f"WITH {CERTIFIED_SQL} SELECT user_id, certified AS label FROM cert WHERE edited AND certified IS NOT NULL"


def decision_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = _log(spark, sf_dir)
    decision = F.when(F.col("event_type") == "error", "BLOCK").when(F.col("event_type") == "purchase", "AUTO_ACCEPT").otherwise("REVIEW")
    return audit.decision_counts(log.withColumn("decision", decision), ["user_id"])


DECISION_COUNTS = """
SELECT user_id, count(*) AS n_records, count(*) FILTER (event_type = 'error') AS n_block, count(*) FILTER (event_type NOT IN ('error', 'purchase')) AS n_review, count(*) FILTER (event_type = 'purchase') AS n_auto_accept FROM events GROUP BY user_id
"""


def risk_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The place of each field in the risk order of its customer."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("study"), "o_custkey")
    rows = assured_fields(spark, sf_dir).join(orders, "study")
    w = Window.partitionBy("o_custkey").orderBy(audit.risk_rank(F.col("decision")), F.coalesce("confidence", F.lit(0.0)), "study")
    return rows.select("study", "o_custkey", F.row_number().over(w).alias("place"))


RISK_ORDER = f"""
WITH {ASSURED_SQL} SELECT study, o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY CASE decision WHEN 'BLOCK' THEN 0 WHEN 'AUTO_ACCEPT' THEN 2 ELSE 1 END, coalesce(confidence, 0), study)::INT AS place FROM assured JOIN orders ON study = o_orderkey
"""


def append_new(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that are new to a log of sign-ups; a user and a whole value make a record."""
    log = _log(spark, sf_dir).select((F.col("user_id") * 1000 + F.floor("value")).alias("record_id"), "seq", "event_type", "value")
    return audit.append_new(log.filter("event_type = 'signup'"), log.filter("event_type <> 'signup'"))


APPEND_NEW = """
WITH l AS (SELECT user_id * 1000 + floor(value)::BIGINT AS record_id, event_id AS seq, event_type, value FROM events)
SELECT * FROM l WHERE event_type <> 'signup' AND record_id NOT IN (SELECT record_id FROM l WHERE event_type = 'signup') QUALIFY row_number() OVER (PARTITION BY record_id ORDER BY seq) = 1
"""


def _decided(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    decision = F.when(F.col("p_size") < 10, "BLOCK").when(F.col("p_size") < 25, "REVIEW").otherwise("AUTO_ACCEPT")
    domains = F.explode(F.array(F.lit("brand"), F.lit("size"), F.lit("name"), F.lit("unlabelled"))).alias("domain")
    return p.select(F.col("p_partkey").alias("study"), domains, decision.alias("decision"), F.col("p_name").alias("value"))


DECIDED_SQL = "dec AS (SELECT p_partkey AS study, unnest(['brand', 'size', 'name', 'unlabelled']) AS domain, CASE WHEN p_size < 10 THEN 'BLOCK' WHEN p_size < 25 THEN 'REVIEW' ELSE 'AUTO_ACCEPT' END AS decision, p_name AS value FROM part)"


def scoreboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scoring.scoreboard(_decided(spark, sf_dir), scores(spark, sf_dir), ["study", "domain"])
    return out.withColumns({c: F.round(c, 9) for c in ("coverage", "burden", "realized_error")})


SCOREBOARD = f"""
WITH {SCORES_SQL}, {DECIDED_SQL}, r AS (SELECT dec.*, s.verdict FROM dec LEFT JOIN s USING (study, domain))
SELECT domain, count(*) AS n, count(*) FILTER (decision = 'AUTO_ACCEPT') AS n_auto, count(*) FILTER (decision = 'REVIEW') AS n_review, count(*) FILTER (decision = 'BLOCK') AS n_block,
  round(count(*) FILTER (decision = 'AUTO_ACCEPT')::DOUBLE / count(*), 9) AS coverage, round(count(*) FILTER (decision = 'REVIEW')::DOUBLE / count(*), 9) AS burden,
  round(1 - count(*) FILTER (decision = 'AUTO_ACCEPT' AND verdict IN ('exact', 'normalized', 'fuzzy'))::DOUBLE / nullif(count(*) FILTER (decision = 'AUTO_ACCEPT' AND verdict IS NOT NULL), 0), 9) AS realized_error
FROM r GROUP BY ROLLUP (domain)
"""


def field_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders by status against their items by status, as two runs over the same fields."""
    a = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("study"), F.col("o_orderpriority").alias("value"), F.col("o_orderstatus").alias("decision")).filter("decision <> 'P'")
    b = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("study")).agg(F.min("l_returnflag").alias("value"), F.max("l_linestatus").alias("decision"))
    return scoring.diff_fields(a, b, ["study"])


FIELD_DIFF = """
WITH a AS (SELECT o_orderkey AS study, o_orderpriority AS value, o_orderstatus AS decision FROM orders WHERE o_orderstatus <> 'P'), b AS (SELECT l_orderkey AS study, min(l_returnflag) AS value, max(l_linestatus) AS decision FROM lineitem GROUP BY l_orderkey)
SELECT coalesce(a.study, b.study) AS study, a.value AS value_a, coalesce(a.decision, 'absent') AS decision_a, b.value AS value_b, coalesce(b.decision, 'absent') AS decision_b FROM a FULL JOIN b ON a.study = b.study
WHERE a.value IS DISTINCT FROM b.value OR coalesce(a.decision, 'absent') <> coalesce(b.decision, 'absent')
"""


def training_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    features = _decided(spark, sf_dir).withColumn("has_value", F.col("decision") != "BLOCK").select("study", "domain", "has_value")
    return scoring.training_pairs(features, scores(spark, sf_dir), ["study", "domain"])


TRAINING_PAIRS = f"WITH {SCORES_SQL}, {DECIDED_SQL} SELECT study, domain, true AS has_value, verdict IN ('exact', 'normalized', 'fuzzy') AS correct FROM dec JOIN s USING (study, domain) WHERE decision <> 'BLOCK' AND verdict <> 'absent'"


def scored_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as scored decisions: a probability from the discount, right or wrong by the flag."""
    li = table(spark, sf_dir, "lineitem")
    return li.select(F.col("l_returnflag").alias("stratum"), (1 - F.col("l_discount") - F.col("l_tax")).alias("_p"), (F.col("l_linestatus") == "O").alias("correct"), "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").withColumn("probability", F.round("_p", 6)).drop("_p")


ITEMS_SQL = "it AS (SELECT l_returnflag AS stratum, round(1 - l_discount - l_tax, 6) AS p, l_linestatus = 'O' AS ok FROM lineitem)"


def risk_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.risk_coverage(scored_items(spark, sf_dir), ["stratum"], "probability", "correct", "l_orderkey").withColumn("risk", F.round("risk", 9))


RISK_COVERAGE = f"""
WITH {ITEMS_SQL}, g AS (SELECT stratum, p, count(*) AS n, count(*) FILTER (NOT ok) AS bad FROM it GROUP BY stratum, p)
SELECT stratum, p AS probability, (sum(n) OVER w)::BIGINT AS n_covered, round(sum(bad) OVER w / sum(n) OVER w, 9) AS risk FROM g WINDOW w AS (PARTITION BY stratum ORDER BY p DESC)
"""


def prefix_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AURC per segment of customers; scores are balances, distinct within a segment but for ties by key."""
    c = table(spark, sf_dir, "customer").select("c_mktsegment", "c_custkey", F.col("c_acctbal").alias("score"), (F.col("c_nationkey") % 3 != 0).alias("correct"))
    return scoring.aurc(c, ["c_mktsegment"], "score", "correct", "c_custkey").withColumn("aurc", F.round("aurc", 9))


PREFIX_RISK = """
WITH r AS (SELECT c_mktsegment, avg((c_nationkey % 3 = 0)::INT) OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal DESC, c_custkey ROWS UNBOUNDED PRECEDING) AS risk FROM customer) SELECT c_mktsegment, round(avg(risk), 9) AS aurc FROM r GROUP BY c_mktsegment
"""


def brier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.brier(scored_items(spark, sf_dir), ["stratum"], "probability", "correct").withColumn("brier", F.round("brier", 9))


BRIER = f"WITH {ITEMS_SQL} SELECT stratum, round(avg(pow(p - ok::INT, 2)), 9) AS brier FROM it GROUP BY stratum"


def rubric(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as studies, priorities as categories: items of flag R are the reference, O the delivered, matches the smaller count."""
    li = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("study"), F.col("l_returnflag").alias("category")).agg(F.count("*").alias("n_reference"), F.count_if(F.col("l_linestatus") == "O").alias("n_delivered"), F.count_if((F.col("l_linestatus") == "O") & (F.col("l_quantity") > 25)).alias("n_matched"))
    return scoring.rubric(li).withColumns({c: F.round(c, 9) for c in ("accuracy", "recall")})


RUBRIC = """
WITH c AS (SELECT l_suppkey AS study, l_returnflag, count(*) AS r, count(*) FILTER (l_linestatus = 'O') AS d, count(*) FILTER (l_linestatus = 'O' AND l_quantity > 25) AS m FROM lineitem GROUP BY ALL)
SELECT study, sum(r)::BIGINT AS n_reference, sum(m)::BIGINT AS n_matched, sum(greatest(d - m, 0))::BIGINT AS n_spurious, round(sum(m) / (sum(r) + sum(greatest(d - m, 0))), 9) AS accuracy, round(sum(m) / sum(r), 9) AS recall FROM c GROUP BY ROLLUP (study)
"""


def greedy_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Large parts matched one to one with small ones of their brand, by name."""
    from ..functions.text import tokens

    p = table(spark, sf_dir, "part").select("p_brand", "p_partkey", "p_size", tokens(F.col("p_name")).alias("tokens"))
    refs, items = p.filter("p_size > 25").withColumnRenamed("p_partkey", "ref"), p.filter("p_size <= 25").withColumnRenamed("p_partkey", "item")
    return scoring.greedy_match_sets(refs, items, ["p_brand"], 0.3)


#: references of a brand go in order and carry the items taken so far; each has its partners sorted by likeness, then id
GREEDY_MATCH = r"""
WITH RECURSIVE t AS (SELECT p_brand, p_partkey AS id, p_size > 25 AS ref, list_distinct(regexp_extract_all(lower(p_name), '[\p{L}\p{N}_]+')) AS t FROM part),
s AS (SELECT a.p_brand, a.id AS ref, b.id AS item, len(list_intersect(a.t, b.t))::DOUBLE / len(list_distinct(a.t || b.t)) AS similarity FROM t a JOIN t b ON a.p_brand = b.p_brand AND a.ref AND NOT b.ref),
r AS (SELECT p_brand, ref, list(struct_pack(item, similarity) ORDER BY similarity DESC, item) AS ways FROM s WHERE similarity >= 0.3 GROUP BY ALL), n AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY ref) AS i FROM r),
w AS (SELECT p_brand, i, ref, ways[1] AS got, [ways[1].item] AS used FROM n WHERE i = 1
  UNION ALL SELECT p_brand, i, ref, got, CASE WHEN got IS NULL THEN used ELSE used || [got.item] END FROM (SELECT n.p_brand, n.i, n.ref, list_filter(n.ways, lambda x: NOT list_contains(w.used, x.item))[1] AS got, w.used FROM w JOIN n ON n.p_brand = w.p_brand AND n.i = w.i + 1))
SELECT p_brand, ref, got.item AS item, got.similarity AS similarity FROM w WHERE got IS NOT NULL
"""


def pricing_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").filter(F.col("l_shipdate") <= "2000-09-02")
    net = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    return li.groupBy("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum(net), 2).alias("sum_net"), F.round(F.avg("l_discount"), 9).alias("avg_disc"), F.count("*").alias("n"))


PRICING_SUMMARY = "SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_net, round(avg(l_discount), 9) AS avg_disc, count(*) AS n FROM lineitem WHERE l_shipdate <= DATE '2000-09-02' GROUP BY ALL"


def region_revenue(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lambda n: table(spark, sf_dir, n)
    rows = t("lineitem").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return rows.rollup("r_name", "n_name").agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.countDistinct("o_orderkey").alias("n_orders"))


REGION_REVENUE = "SELECT r_name, n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(DISTINCT o_orderkey) AS n_orders FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ROLLUP (r_name, n_name)"


def idle_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Semi join, anti join and set operations on keys."""
    c, o = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders")
    active = c.join(o, c.c_custkey == o.o_custkey, "left_semi").select("c_custkey")
    idle = c.join(o, c.c_custkey == o.o_custkey, "left_anti").select("c_custkey")
    rich = c.filter("c_acctbal > 5000").select("c_custkey")
    part = lambda df, name: df.select("c_custkey", F.lit(name).alias("part"))
    return part(active.intersect(rich), "active_rich").unionByName(part(active.exceptAll(rich), "active_other")).unionByName(part(idle, "idle"))


IDLE_CUSTOMERS = "SELECT c_custkey, CASE WHEN c_custkey NOT IN (SELECT o_custkey FROM orders) THEN 'idle' WHEN c_acctbal > 5000 THEN 'active_rich' ELSE 'active_other' END AS part FROM customer"

QUERIES = {
    "latest_by_key": latest_by_key, "certified_state": certified_state, "edit_summary": edit_summary, "edit_labels": edit_labels, "decision_counts": decision_counts, "risk_order": risk_order, "append_new": append_new, "scoreboard": scoreboard, "field_diff": field_diff, "training_pairs": training_pairs, "risk_coverage": risk_coverage,
    "prefix_risk": prefix_risk, "brier": brier, "rubric": rubric, "greedy_match": greedy_match, "pricing_summary": pricing_summary, "region_revenue": region_revenue, "idle_customers": idle_customers,
}
SQL = {
    "latest_by_key": LATEST_BY_KEY, "certified_state": CERTIFIED_STATE, "edit_summary": EDIT_SUMMARY, "edit_labels": EDIT_LABELS, "decision_counts": DECISION_COUNTS, "risk_order": RISK_ORDER, "append_new": APPEND_NEW, "scoreboard": SCOREBOARD, "field_diff": FIELD_DIFF, "training_pairs": TRAINING_PAIRS, "risk_coverage": RISK_COVERAGE,
    "prefix_risk": PREFIX_RISK, "brier": BRIER, "rubric": RUBRIC, "greedy_match": GREEDY_MATCH, "pricing_summary": PRICING_SUMMARY, "region_revenue": REGION_REVENUE, "idle_customers": IDLE_CUSTOMERS,
}
