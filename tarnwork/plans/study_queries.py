"""Queries over titles, features, findings, rubrics and small relations of studies, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import blocks as B
from ..operators import features as V
from ..operators import fields as X
from ..operators import grids as G
from ..operators import matching as M
from ..operators import schedules as Z
from ..operators import scoring
from ..operators import sections as S
from ..operators import titles as T
from ..schemas import LABEL
from ..sources import files
from . import assembly as A
from .inputs import LINES_SQL, SECTIONS_SQL, blocks, sections, table

#: titles that parts stand for, by size
TITLES = (
    "Appendix 1 Protocol Amendment History", "5. Study Population", "Schedule of Activities", "Clinical Laboratory Tests", "Statistical Analysis", "Overview of things", "Benefit/Risk Assessment", "10.2 Data Monitoring Committee", "Objectives and Endpoints", "Summary of Changes", "Synopsis", "Annex B: Dosage",
    "Estimands", "Early Termination", "Other matters", "Populations for Analyses", "List of Tables", "Informed Consent", "RECIST and response", "Investigator's Signature", "Attachment 3 Response Criteria", "Screen Failures", "Physical Examination", "Study Flowchart",
)


def _titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of 60 parts as documents, parts as sections, up to nine levels deep."""
    p = table(spark, sf_dir, "part")
    title = F.element_at(F.array(*map(F.lit, TITLES)), (F.col("p_size") % len(TITLES) + 1).cast("int"))
    return p.select(F.floor(F.col("p_partkey") / 60).alias("doc_id"), F.col("p_partkey").alias("ord"), F.lit(1).alias("page"), F.lit(0.0).alias("y0"), (F.col("p_partkey") % 9 + 1 - F.when(F.col("p_size") % 5 == 0, F.col("p_partkey") % 9).otherwise(0)).alias("level"), title.alias("title"))


def _case(text: str, rules: list[tuple[str, str | None]], other: str = "NULL") -> str:
    quoted = lambda s: "NULL" if s is None else "'" + s.replace("'", "''") + "'"
    return "CASE " + " ".join(f"WHEN regexp_matches({text}, {quoted(p)}) THEN {quoted(v)}" for p, v in rules) + f" ELSE {other} END"


_axis = lambda k: _case("lower(title)", [(rf"\b(?:{rule[0]})", rule[k]) for rule in T.TITLE_AXES])
_HIT = _case("lower(title)", [(rf"\b(?:{rule[0]})", "x") for rule in T.TITLE_AXES])
TITLES_SQL = f"""
raw AS (SELECT p_partkey // 60 AS doc_id, p_partkey AS ord, p_partkey % 9 + 1 - CASE WHEN p_size % 5 = 0 THEN p_partkey % 9 ELSE 0 END AS level, {list(t.replace("'", "`") for t in TITLES)}[p_size % {len(TITLES)} + 1] AS t0 FROM part),
ts AS (SELECT doc_id, ord, level, replace(t0, '`', chr(39)) AS title FROM raw),
own AS (SELECT *, CASE WHEN {_HIT} IS NOT NULL AND regexp_matches(lower(title), '^\\s*(?:appendix|attachment|annex)\\b') THEN 'appendix' ELSE {_axis(1)} END AS type, {_axis(2)} AS subtype, {_axis(3)} AS authority,
  (SELECT max(p.ord) FROM ts p WHERE p.doc_id = ts.doc_id AND p.ord < ts.ord AND p.level < ts.level) AS parent_ord FROM ts)
"""


def title_axes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _titles(spark, sf_dir).select("doc_id", "ord", T.title_labels(F.col("title")).alias("l")).select("doc_id", "ord", "l.*")


TITLE_AXES_SQL = f"WITH {TITLES_SQL} SELECT doc_id, ord, type, subtype, authority FROM own"


def labelled_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.label_sections(S.nest(_titles(spark, sf_dir))).select("doc_id", "ord", "type", "subtype", "authority")


LABELLED_SECTIONS = f"""
WITH RECURSIVE {TITLES_SQL}, r AS (SELECT doc_id, ord, type, subtype, authority FROM own WHERE parent_ord IS NULL
  UNION ALL SELECT o.doc_id, o.ord, CASE WHEN o.type IS NULL OR a.type = 'appendix' THEN a.type ELSE o.type END, CASE WHEN o.type IS NULL OR a.subtype = 'amendment_history' THEN a.subtype ELSE o.subtype END,
  CASE WHEN o.type IS NULL THEN a.authority WHEN a.subtype = 'amendment_history' THEN CASE WHEN o.subtype IN ('soa_main', 'soa_followup') THEN 'soa_table_historic' ELSE a.authority END ELSE o.authority END FROM r a JOIN own o ON o.doc_id = a.doc_id AND o.parent_ord = a.ord)
SELECT * FROM r
"""


def deep_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A label of few sections, inherited over up to nine levels."""
    rows = _titles(spark, sf_dir).withColumn("type", F.when(F.col("title") == "Synopsis", "summary"))
    return S.inherit(S.nest(rows), "type").select("doc_id", "ord", "type")


DEEP_TYPES = f"""
WITH RECURSIVE {TITLES_SQL}, r AS (SELECT doc_id, ord, CASE WHEN title = 'Synopsis' THEN 'summary' END AS type FROM own WHERE parent_ord IS NULL UNION ALL SELECT o.doc_id, o.ord, CASE WHEN title = 'Synopsis' THEN 'summary' ELSE r.type END FROM r JOIN own o ON o.doc_id = r.doc_id AND o.parent_ord = r.ord)
SELECT * FROM r
"""

#: title pages that customers stand for, by nation
PAGES = (
    "A Phase 1b/2 study of x", "A seamless Phase 2/3 trial", "Umbrella study", "Vaccine sub-study", "A master protocol for vaccines", "Phase III study in adolescents", "Pharmacokinetics of y, Phase I", "Maintenance therapy, phase iv", "A randomised-withdrawal and titration study", "Investigator's choice, Phase 2a", "Phase 3 trial of z", "Extension study, phase 1/2b/3",
    "Safety run-in and efficacy",
)


def fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as documents, orders as their sections."""
    c, o = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders")
    pages = c.select(F.col("c_custkey").alias("doc_id"), F.element_at(F.array(*map(F.lit, PAGES)), (F.col("c_nationkey") % len(PAGES) + 1).cast("int")).alias("title_page"))
    k = F.col("o_orderkey") % 11
    rows = o.select(F.col("o_custkey").alias("doc_id"), F.when(k == 0, "Part A design").when(k == 1, "Part B").when(k == 2, "DDI cohort").otherwise("Methods").alias("title"), F.when(k == 3, "appendix").alias("type"), F.when(k == 3, "amendment_history").when(k == 4, "analysis_sets").when(k == 5, "estimands_table").alias("subtype"))
    out = T.fingerprint(pages, rows)
    return out.withColumns({c: F.array_join(c, ",") for c in ("phases", "tags")})


FINGERPRINTS = rf"""
WITH p AS (SELECT c_custkey AS doc_id, lower(replace({list(t.replace("'", "`") for t in PAGES)}[c_nationkey % {len(PAGES)} + 1], '`', chr(39))) AS page FROM customer),
s AS (SELECT o_custkey AS doc_id, bool_or(o_orderkey % 11 = 0) AS a, bool_or(o_orderkey % 11 = 1) AS b, bool_or(o_orderkey % 11 = 2) AS ddi, bool_or(o_orderkey % 11 = 3) AS hist, bool_or(o_orderkey % 11 = 4) AS sets, bool_or(o_orderkey % 11 = 5) AS est FROM orders GROUP BY 1),
ph0 AS (SELECT doc_id, page, list_transform(flatten(list_transform(regexp_extract_all(page, '\bphase\s+((?:[1-4]|iv|i{{1,3}})[ab]?(?:\s*/\s*(?:[1-4]|iv|i{{1,3}})[ab]?)*)\b', 1), lambda x: string_split(x, '/'))),
  lambda x: 'phase_' || CASE regexp_replace(trim(x), '[ab]$', '') WHEN 'i' THEN '1' WHEN 'ii' THEN '2' WHEN 'iii' THEN '3' WHEN 'iv' THEN '4' ELSE regexp_replace(trim(x), '[ab]$', '') END || CASE WHEN regexp_matches(trim(x), '^(1|i)b$') THEN 'b' ELSE '' END) AS every FROM p),
ph AS (SELECT doc_id, page, list_filter(every, lambda x, i: list_position(every, x) = i) AS phases FROM ph0),
f AS (SELECT ph.*, coalesce(hist, false) AS hist, coalesce(sets, false) AS sets, coalesce(est, false) AS est, CASE WHEN regexp_matches(page, 'master protocol') AND regexp_matches(page, '\bvaccin') THEN 'master_vaccine_protocol' WHEN regexp_matches(page, '\bumbrella\b') THEN 'umbrella_substudy_protocol'
  WHEN regexp_matches(page, '\bvaccin') AND regexp_matches(page, '\bsub-?study\b') THEN 'vaccine_substudy_protocol' WHEN regexp_matches(page, '\bseamless\b') AND regexp_matches(page, '\bphase (?:2b|ii b|2/3|2b/3|iib/iii)\b') THEN 'seamless_phase2b3'
  WHEN regexp_matches(page, '\bsafety (?:lead|run)-in\b') THEN 'sli_plus_randomized_phase3' WHEN list_contains(phases, 'phase_1b') AND list_contains(phases, 'phase_2') THEN 'phase1b_phase2_split' WHEN a AND b THEN 'multi_part_randomized_oncology' WHEN ddi THEN 'ddi_cohort_embedded'
  WHEN regexp_matches(page, '\brandomi[sz]ed[- ]withdrawal\b') AND regexp_matches(page, '\btitration\b') THEN 'randomized_withdrawal_extension' WHEN regexp_matches(page, '\bextension\b|\btitration\b') THEN 'randomized_blinded_extension' WHEN contains(page, 'investigator' || chr(39) || 's choice') THEN 'physician_choice_comparator_oncology'
  WHEN regexp_matches(page, '\bmaintenance (?:therapy|treatment)\b') THEN 'maintenance_randomized_oncology' WHEN regexp_matches(page, '\badolescents?\b') AND regexp_matches(page, '\bphase (?:3|iii)\b') THEN 'pediatric_inclusive_phase3' WHEN regexp_matches(page, '\bpharmacokinetic') THEN 'clinical_pharmacology_table_driven' END AS family FROM ph LEFT JOIN s USING (doc_id))
SELECT doc_id, coalesce(family, 'standard_randomized_phase3') AS archetype, family IS NOT NULL AS detected, array_to_string(phases, ',') AS phases,
  coalesce(family NOT IN ('randomized_blinded_extension', 'physician_choice_comparator_oncology', 'maintenance_randomized_oncology', 'pediatric_inclusive_phase3', 'clinical_pharmacology_table_driven'), false) AS multi_part, est AS explicit_estimands,
  concat_ws(',', CASE WHEN hist THEN 'historical_amendment_appendix' END, CASE WHEN sets THEN 'explicit_analysis_sets' END) AS tags, CASE WHEN family IS NULL THEN 0.4 ELSE 0.7 END::DOUBLE AS confidence FROM f
"""


def feature_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as fields of studies of their own, lines as the candidates of the methods, dates as pages."""
    o, li = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    key = lambda c: [c.alias("study_id"), F.when(c % 3 == 0, "soa").when(c % 3 == 1, "metadata").otherwise("design").alias("domain"), F.concat(F.lit("f"), (c % 5).cast("string")).alias("field")]
    k, quoted = F.col("o_orderkey"), F.col("o_orderkey") % 4 == 0
    fields = o.select(*key(k), F.when(F.col("o_orderstatus") != "P", F.concat(F.lit("ship mode "), (F.col("o_custkey") % 4).cast("string"))).alias("value"), F.when(quoted, F.col("o_orderpriority")).alias("quote_text"), F.when(quoted, k % 7).alias("quote_page"), F.when(quoted, "exact").alias("verify_pass"), F.lit("n/a").alias("verifier"), (k % 2 == 0).alias("methods_agree"), (k % 3).alias("n_methods"), (k % 100 / 100).alias("confidence"), F.lit("REVIEW").alias("decision"))
    l = F.col("l_orderkey")
    cands = li.groupBy(l, "l_linenumber").agg(F.min("l_suppkey").alias("s"), F.max("l_returnflag").alias("r"))
    cands = cands.select(*key(l), F.col("l_linenumber").alias("ord"), F.when(F.col("s") % 9 > 0, F.concat(F.lit("ship mode "), (F.col("s") % 4).cast("string"))).otherwise(F.lit("")).alias("value"), F.col("r").alias("quote_text"), F.when(F.col("s") % 2 == 0, F.col("s") % 6).alias("quote_page"), F.when(F.col("s") % 2 == 0, "normalized").otherwise("failed").alias("verify_pass"))
    kinds = spark.createDataFrame([("metadata", "f1", "name"), ("design", "f2", "code"), ("soa", "f0", "mark")], "domain string, field string, field_type string")
    pages = li.select(l.alias("study_id"), F.col("l_linenumber").alias("page"), (F.col("l_tax") > 0.03).alias("has_text"))
    windows = o.select(k.alias("study_id"), F.lit("metadata").alias("domain"), (k % 6).alias("kept"), (k % 2).alias("dropped"), F.lit("h").alias("plan_hash"))
    grids = o.filter(k % 6 == 0).select(*key(k), F.lit(0.5).alias("grid_agreement"))
    return V.features(fields, cands, kinds, pages, windows, grids).withColumns({c: F.round(c, 9) for c in ("agreement_fuzzy_mean", "page_position", "window_kept_ratio", "confidence")})


FEATURE_ROWS = """
WITH c0 AS (SELECT l_orderkey AS k, l_linenumber AS ord, min(l_suppkey) AS s, max(l_returnflag) AS r FROM lineitem GROUP BY ALL),
c AS (SELECT k, ord, CASE WHEN s % 9 > 0 THEN 'ship mode ' || s % 4 ELSE '' END AS v, r AS q, CASE WHEN s % 2 = 0 THEN s % 6 END AS p, CASE WHEN s % 2 = 0 THEN 'normalized' ELSE 'failed' END AS how FROM c0),
d AS (SELECT k, v FROM c WHERE v <> '' GROUP BY k, v), pairs AS (SELECT a.k, a.v AS x, b.v AS y FROM d a JOIN d b ON a.k = b.k AND a.v < b.v),
sim AS (SELECT k, avg(len(list_intersect(string_split(x, ' '), string_split(y, ' ')))::DOUBLE / len(list_distinct(string_split(x, ' ') || string_split(y, ' ')))) AS m FROM pairs GROUP BY k),
f AS (SELECT o_orderkey AS k, CASE o_orderkey % 3 WHEN 0 THEN 'soa' WHEN 1 THEN 'metadata' ELSE 'design' END AS domain, 'f' || o_orderkey % 5 AS field, CASE WHEN o_orderstatus <> 'P' THEN 'ship mode ' || o_custkey % 4 END AS v, o_orderkey % 4 = 0 AS quoted, o_orderpriority AS pr FROM orders),
w AS (SELECT f.k, arg_min(c.q, c.ord) AS q, arg_min(coalesce(c.p, -1), c.ord) AS p, arg_min(c.how, c.ord) AS how FROM f JOIN c ON c.k = f.k AND c.v = f.v GROUP BY f.k),
g AS (SELECT f.*, CASE WHEN quoted THEN pr ELSE w.q END AS qt, CASE WHEN quoted THEN f.k % 7 ELSE nullif(w.p, -1) END AS page, CASE WHEN quoted THEN 'exact' ELSE w.how END AS how FROM f LEFT JOIN w ON w.k = f.k),
t AS (SELECT l_orderkey AS k, count(DISTINCT l_linenumber) AS n FROM lineitem GROUP BY 1), y AS (SELECT l_orderkey AS k, l_linenumber AS page, bool_or(l_tax > 0.03) AS has FROM lineitem GROUP BY ALL)
SELECT g.k AS study_id, domain, field, CASE WHEN domain = 'metadata' AND field = 'f1' THEN 'name' WHEN domain = 'design' AND field = 'f2' THEN 'code' WHEN domain = 'soa' AND field = 'f0' THEN 'mark' ELSE 'unknown' END AS field_type, v IS NOT NULL AS value_present,
  coalesce(how, 'none') AS verify_pass, 'n/a' AS verifier, g.k % 2 = 0 AS methods_agree, g.k % 3 AS n_methods, round(sim.m, 9) AS agreement_fuzzy_mean, domain = 'soa' AS is_table_cell, CASE WHEN g.k % 6 = 0 THEN 0.5 END::DOUBLE AS grid_agreement, coalesce(length(qt), 0) AS span_length, g.page::INT AS page,
  round(CASE WHEN g.page > 0 THEN g.page::DOUBLE / t.n END, 9) AS page_position, CASE WHEN g.page IS NOT NULL AND t.n IS NOT NULL THEN coalesce(y.has, false) END AS has_text_layer, CASE WHEN domain = 'metadata' AND g.k % 6 + g.k % 2 > 0 THEN round((g.k % 6)::DOUBLE / (g.k % 6 + g.k % 2), 9) END AS window_kept_ratio,
  CASE WHEN domain = 'metadata' THEN 'h' END AS route_plan_hash, round((g.k % 100) / 100.0::DOUBLE, 9) AS confidence, 'REVIEW' AS decision
FROM g LEFT JOIN sim ON sim.k = g.k LEFT JOIN t ON t.k = g.k LEFT JOIN y ON y.k = g.k AND y.page = g.page
"""


def missing_visits(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    visits = li.filter("l_returnflag <> 'R'").select(F.col("l_orderkey").alias("study_id"), F.when(F.col("l_orderkey") % 3 > 0, F.concat(F.when(F.col("l_tax") > 0.04, "V").otherwise("Visit "), F.col("l_linenumber").cast("string"))).otherwise("Screening").alias("label"))
    texts = li.select(F.col("l_orderkey").alias("study_id"), F.concat(F.lit("at visit "), F.col("l_linenumber").cast("string"), F.lit(" and Visits "), (F.col("l_suppkey") % 9).cast("string"), F.lit(" of 12")).alias("text"))
    return V.missing_visits(visits, texts)


MISSING_VISITS = """
WITH h AS (SELECT DISTINCT l_orderkey AS s, l_linenumber AS v FROM lineitem WHERE l_returnflag <> 'R' AND l_orderkey % 3 > 0), t AS (SELECT l_orderkey AS s, l_linenumber AS v FROM lineitem UNION SELECT l_orderkey, l_suppkey % 9 FROM lineitem)
SELECT s AS study_id, v::INT AS visit FROM t WHERE s IN (SELECT s FROM h) EXCEPT SELECT s, v::INT FROM h
"""


def domains_touched(spark: SparkSession, sf_dir: str) -> DataFrame:
    li, k = table(spark, sf_dir, "lineitem"), F.col("l_linenumber")
    return V.domains_touched(li.select("l_orderkey", F.when(F.col("l_returnflag") == "N", "unchanged").otherwise("modified").alias("kind"), F.when(k % 3 == 0, F.array(F.lit("soa"), F.lit("design"))).when(k % 3 == 1, F.array(F.lit("metadata"))).otherwise(F.array().cast("array<string>")).alias("domains")), ["l_orderkey"])


DOMAINS_TOUCHED = "SELECT l_orderkey, domain, count(*) AS n FROM (SELECT l_orderkey, unnest(CASE l_linenumber % 3 WHEN 0 THEN ['soa', 'design'] WHEN 1 THEN ['metadata'] ELSE [] END) AS domain FROM lineitem WHERE l_returnflag <> 'N') GROUP BY ALL"


def all_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as cells of two engines, of which one has no boxes, and of a third that is not there; pages after the second are left out."""
    li = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("page"), F.lit(0).alias("table_ix"), F.col("l_suppkey").alias("row"), F.lit(0).alias("col"), F.col("l_returnflag").alias("text"), F.col("l_quantity").alias("x0"), F.lit(0.0).alias("y0"), F.col("l_quantity").alias("x1"), F.lit(9.0).alias("y1"), "l_linestatus")
    cells = {"native": li.filter("l_linestatus = 'O'").drop("l_linestatus"), "other": li.filter("l_linestatus = 'F'").drop("l_linestatus", "x0", "y0", "x1", "y1"), "absent": None}
    return V.all_cells(spark, cells, li.filter("page <= 2").select("doc_id", "page"))


ALL_CELLS = """
SELECT l_orderkey AS doc_id, CASE l_linestatus WHEN 'O' THEN 'native' ELSE 'other' END AS engine, l_linenumber AS page, 0 AS table_ix, l_suppkey AS row, 0 AS col, l_returnflag AS text, CASE WHEN l_linestatus = 'O' THEN l_quantity END AS x0, CASE WHEN l_linestatus = 'O' THEN 0.0 END::DOUBLE AS y0,
  CASE WHEN l_linestatus = 'O' THEN l_quantity END AS x1, CASE WHEN l_linestatus = 'O' THEN 9.0 END::DOUBLE AS y1 FROM lineitem WHERE l_linenumber <= 2
"""


def live_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users as jobs: a purchase ends one well, an error badly; an hour after the last day's noon."""
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("job"), F.when(F.col("event_type") == "purchase", "done").when(F.col("event_type") == "error", "failed").otherwise("running").alias("state"), F.col("ts").alias("at"), F.col("event_id").alias("seq"))
    return V.live_jobs(e, F.lit("2024-01-20 12:00:00").cast("timestamp"), 5 * 86400)


LIVE_JOBS = """
WITH l AS (SELECT user_id AS job, CASE event_type WHEN 'purchase' THEN 'done' WHEN 'error' THEN 'failed' ELSE 'running' END AS state, ts AS "at" FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1)
SELECT * FROM l WHERE NOT (state IN ('done', 'failed') AND "at" < TIMESTAMP '2024-01-20 12:00:00' - INTERVAL 5 DAY)
"""


def scalar_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers' nations and segments as what two sides say of a study."""
    c, k = table(spark, sf_dir, "customer"), F.col("c_nationkey") % 8
    field = F.element_at(F.array(*map(F.lit, ("title", "sponsor", "protocol_id", "phase", "version", "study_type", "model", "region"))), (k + 1).cast("int"))
    got = F.when(k == 3, F.concat(F.lit("Phase "), F.element_at(F.array(*map(F.lit, ("II", "3", "iv", "1"))), (F.col("c_custkey") % 4 + 1).cast("int")))).when(k == 4, F.concat(F.lit("v"), (F.col("c_custkey") % 3).cast("string"), F.lit(".0"))).otherwise(F.concat("c_mktsegment", F.lit(" Study "), (F.col("c_custkey") % 3).cast("string")))
    want = F.when(k == 3, F.concat(F.lit("phase "), (F.col("c_custkey") % 3 + 1).cast("string"))).when(k == 4, F.concat(F.lit("version "), (F.col("c_custkey") % 2).cast("string"))).otherwise(F.concat(F.lower("c_mktsegment"), F.lit(" study "), (F.col("c_custkey") % 2).cast("string")))
    return c.select("c_custkey", scoring.scalar_equal(field, got, want).alias("same"))


SCALAR_AGREEMENT = """
WITH t AS (SELECT c_custkey AS k, c_nationkey % 8 AS f, c_custkey % 4 AS q, c_mktsegment || ' Study ' || c_custkey % 3 AS got, lower(c_mktsegment) || ' study ' || c_custkey % 2 AS want FROM customer),
j AS (SELECT *, list_distinct(string_split(lower(got), ' ')) AS g, list_distinct(string_split(want, ' ')) AS w FROM t)
SELECT k AS c_custkey, CASE f WHEN 0 THEN len(list_intersect(g, w))::DOUBLE / len(list_distinct(g || w)) >= 0.8 WHEN 1 THEN len(list_intersect(g, w))::DOUBLE / len(list_distinct(g || w)) >= 0.5 OR contains(lower(got), want) WHEN 2 THEN lower(got) = want
  WHEN 3 THEN [2, 3, 4, 1][q + 1] = k % 3 + 1 WHEN 4 THEN k % 3 = k % 2 WHEN 5 THEN len(list_intersect(g, list_filter(w, lambda x: x NOT IN ('study', 'trial')))) > 0 WHEN 6 THEN len(list_intersect(g, list_filter(w, lambda x: x NOT IN ('study', 'trial')))) > 0 ELSE lower(got) = want END AS same FROM j
"""


def study_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as studies: suppliers are what was delivered, customers the reference, segments the categories; scalars are the nation's name."""
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("study"), "n_name")
    names = lambda c: F.element_at(F.array(*map(F.lit, ("arms", "criteria", "identifiers", "marks"))), (c % 4 + 1).cast("int"))
    text = lambda c: F.concat(F.lit("item "), (c % 5).cast("string"), F.lit("\nrow "), (c % 3).cast("string"))
    ref = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("study"), names(F.col("c_custkey")).alias("category"), F.col("c_custkey").alias("ord"), text(F.col("c_custkey")).alias("text"))
    got = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("study"), names(F.col("s_suppkey")).alias("category"), F.col("s_suppkey").alias("ord"), text(F.col("s_suppkey")).alias("text"))
    scalars = scoring.scalar_counts(n.select("study", F.lit("region").alias("field"), F.lower("n_name").alias("value")), n.select("study", F.lit("region").alias("field"), F.col("n_name").alias("value")))
    counts = scoring.category_counts(got, ref).unionByName(scalars.select("study", "category", "n_reference", "n_delivered", "n_matched"))
    return scoring.rubric(counts).withColumns({c: F.round(c, 9) for c in ("accuracy", "recall")})


def first_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("page")).agg(F.min("l_suppkey").alias("table_ix"), (F.max("l_partkey") % 3).alias("n_visits"), (F.max("l_partkey") % 2).alias("n_activities"))
    return G.first_parsing_table(li, ["doc_id"])


FIRST_TABLES = """
WITH t AS (SELECT l_orderkey AS doc_id, l_linenumber AS page, min(l_suppkey) AS table_ix, max(l_partkey) % 3 AS n_visits, max(l_partkey) % 2 AS n_activities FROM lineitem GROUP BY ALL)
SELECT * FROM t WHERE n_visits > 0 AND n_activities > 0 QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY page, table_ix) = 1
"""


def first_writes(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return files.first_write(e.filter("event_type = 'purchase'").select("user_id"), e.filter("event_type = 'error'").select("user_id"), "user_id")


FIRST_WRITES = "SELECT DISTINCT user_id FROM events WHERE event_type = 'error' EXCEPT SELECT user_id FROM events WHERE event_type = 'purchase'"


def permitted_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks as candidates with the places of their quotes; those in sections of one type go."""
    rows = blocks(spark, sf_dir).select("doc_id", F.when(F.col("ord") % 2 == 0, F.col("page")).alias("page"), "y0", "ord")
    bad = spark.createDataFrame([("history",)], "section string")
    good, _ = X.drop_prohibited(rows, sections(spark, sf_dir).withColumn("section", F.col("type")), bad)
    return good.select("doc_id", "ord")


PERMITTED_CANDIDATES = f"""
WITH {SECTIONS_SQL}, c AS (SELECT * FROM blocks),
p AS (SELECT c.doc_id, c.ord, (SELECT arg_max(coalesce(s.type, '-'), (s.page, s.y0, s.ord)) FROM sections s WHERE s.doc_id = c.doc_id AND (s.page < c.page OR s.page = c.page AND s.y0 <= c.y0 + 0.5)) AS type FROM c)
SELECT doc_id, ord FROM p WHERE ord % 2 = 1 OR type IS DISTINCT FROM 'history'
"""


def table_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as tables of three columns, of which one may be notes."""
    li = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_returnflag").alias("r"), F.max("l_suppkey").alias("s"))
    cells = F.array(F.when(F.col("l_linenumber") == 2, F.lit(" ")).otherwise(F.col("r")), F.when(F.col("l_linenumber") == 1, F.lit("Value")).when(F.col("s") % 2 == 0, F.col("s").cast("string")), F.when(F.col("l_linenumber") == 1, F.when(F.col("s") % 2 == 0, F.lit("Notes")).otherwise(F.lit("Unit"))).otherwise(F.lit("mg")))
    return G.data_columns(li.select("l_orderkey", (F.col("l_linenumber") - 1).alias("row"), F.posexplode(cells).alias("col", "text")), ["l_orderkey"])


TABLE_DATA = """
WITH t AS (SELECT l_orderkey, l_linenumber - 1 AS row, max(l_returnflag) AS r, max(l_suppkey) AS s FROM lineitem GROUP BY ALL), n AS (SELECT l_orderkey FROM t WHERE row = 0 AND s % 2 = 0)
SELECT l_orderkey, row, 1::INT AS col, s::VARCHAR AS text, r AS label FROM t WHERE row > 1 AND s % 2 = 0 UNION ALL SELECT l_orderkey, row, 2, 'mg', r FROM t WHERE row > 1 AND l_orderkey NOT IN (SELECT l_orderkey FROM n)
"""


def reviewer_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", (F.col("n_chars") % 16 / 16 + F.col("doc_id") % 2 / 2048).alias("confidence"), F.col("text").alias("span"))
    return X.review_rows(d).withColumn("span", F.md5("span"))


REVIEWER_ROWS = """
WITH d AS (SELECT doc_id, (n_chars % 16) / 16.0::DOUBLE + (doc_id % 2) / 2048.0::DOUBLE AS c, md5(substr(coalesce(text, ''), 1, 160)) AS span FROM documents)
SELECT doc_id, CASE WHEN 1000 * c - floor(1000 * c) = 0.5 THEN CASE WHEN floor(1000 * c)::BIGINT % 2 = 0 THEN floor(1000 * c) ELSE floor(1000 * c) + 1 END ELSE round(1000 * c) END / 1000 AS confidence, span FROM d
"""


def training_studies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.study_split(table(spark, sf_dir, "nation").select(F.col("n_name").alias("study_id")), "train", ["NATION_3", "NATION_7"])


TRAINING_STUDIES = "SELECT n_name AS study_id FROM nation WHERE n_name NOT IN ('NATION_3', 'NATION_7')"


def change_rationales(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as versions: lines are items that name a section by number."""
    li = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_suppkey").alias("s"), F.max("l_returnflag").alias("r"))
    items = li.select("l_orderkey", F.col("l_linenumber").alias("item_ord"), F.concat(F.lit("Section 4."), (F.col("s") % 4).cast("string"), F.lit(" was changed "), "r", F.when(F.col("s") % 3 == 0, F.lit(" because of many reasons that are all set out in this long text")).otherwise(F.lit(""))).alias("item"))
    parts = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("ord")).withColumn("number", F.concat(F.lit("4."), F.col("ord").cast("string")))
    return M.rationales(parts, items, ["l_orderkey"])


CHANGE_RATIONALES = """
WITH l AS (SELECT l_orderkey, l_linenumber AS i, max(l_suppkey) AS s, max(l_returnflag) AS r FROM lineitem GROUP BY ALL),
t AS (SELECT *, 'Section 4.' || s % 4 || ' was changed ' || r || CASE WHEN s % 3 = 0 THEN ' because of many reasons that are all set out in this long text' ELSE '' END AS item FROM l),
w AS (SELECT *, CASE WHEN s % 3 > 0 THEN concat_ws(' ', item, lead(item) OVER (PARTITION BY l_orderkey ORDER BY i)) ELSE item END AS text FROM t)
SELECT l_orderkey, (s % 4)::INT AS ord, arg_min(text, i) AS rationale FROM w WHERE s % 4 < 3 AND l_orderkey IN (SELECT o_orderkey FROM orders) GROUP BY l_orderkey, s % 4
"""


def placed_bookmarks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fourth block's first words as a bookmark of its page."""
    b = blocks(spark, sf_dir)
    marks = b.select("doc_id", "ord", "page", F.substring("text", 1, 12).alias("title"))
    return S.position_bookmarks(marks, b).select("doc_id", "ord", "y0")


PLACED_BOOKMARKS = f"""
WITH {LINES_SQL}, m AS (SELECT doc_id, ord, page, lower(substr(text, 1, 12)) AS t FROM blocks), h AS (SELECT m.doc_id, m.ord, m.page, arg_min(b.y0, b.ord) AS y FROM m LEFT JOIN blocks b ON b.doc_id = m.doc_id AND b.page = m.page AND starts_with(lower(b.text), m.t) GROUP BY ALL)
SELECT doc_id, ord, max(coalesce(y, 0)) OVER (PARTITION BY doc_id, page ORDER BY ord) AS y0 FROM h
"""


def chosen_graphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    return S.choose_graph(li.select(F.col("l_orderkey").alias("doc_id"), F.when(F.col("l_linestatus") == "O", "bookmarks").otherwise("headings").alias("source"), F.when(F.col("l_tax") > 0.02, F.col("l_returnflag")).alias("type")))


CHOSEN_GRAPHS = """
WITH t AS (SELECT l_orderkey AS doc_id, count(*) FILTER (l_linestatus = 'O' AND l_tax > 0.02) AS b, count(*) FILTER (l_linestatus <> 'O' AND l_tax > 0.02) AS h, bool_or(l_linestatus = 'O') AS any_b, bool_or(l_linestatus <> 'O') AS any_h FROM lineitem GROUP BY 1)
SELECT doc_id, CASE WHEN any_b AND (b >= h OR NOT any_h) THEN 'bookmarks' ELSE 'headings' END AS source FROM t
"""


def bounding_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), (F.col("l_linenumber") % 3).alias("page"), (F.col("l_partkey") * 1000.0 + F.col("l_suppkey")).alias("y0")).distinct()
    return G.page_bounds(li)


BOUNDING_TABLES = """
WITH t AS (SELECT DISTINCT l_orderkey AS doc_id, l_linenumber % 3 AS page, l_partkey * 1000.0::DOUBLE + l_suppkey AS y0 FROM lineitem)
SELECT *, y0 = min(y0) OVER w AS first_on_page, y0 = max(y0) OVER w AS last_on_page FROM t WINDOW w AS (PARTITION BY doc_id, page)
"""


def merged_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = blocks(spark, sf_dir)
    return B.merge_windows(b.filter("page = 1"), b.filter("size > 12")).select("doc_id", "ord", "pos")


MERGED_WINDOWS = f"WITH {LINES_SQL}, u AS (SELECT doc_id, ord, page, y0 FROM blocks WHERE page = 1 UNION ALL SELECT doc_id, ord, page, y0 FROM blocks WHERE size > 12) SELECT doc_id, ord, row_number() OVER (PARTITION BY doc_id ORDER BY page, y0, ord)::INT AS pos FROM u"


def table_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", (F.col("l_suppkey") % 4).alias("col"), F.col("l_quantity").alias("x0"), (F.col("l_quantity") + F.col("l_linenumber")).alias("x1"))
    return G.column_edges(li, ["l_orderkey"]).select("l_orderkey", F.array_join(F.transform("edges", lambda x: x.cast("int").cast("string")), ",").alias("edges"))


TABLE_EDGES = "WITH c AS (SELECT l_orderkey, l_suppkey % 4 AS col, min(l_quantity) AS x, max(l_quantity + l_linenumber) AS r FROM lineitem GROUP BY ALL) SELECT l_orderkey, string_agg(x::INT::VARCHAR, ',' ORDER BY col) || ',' || max(r)::INT AS edges FROM c GROUP BY 1"


def amendment_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .layout_queries import version_diff

    return A.amendment_input(version_diff(spark, sf_dir), ["conv_id"])


AMENDMENT_COUNTS = """
WITH o AS (SELECT conv_id, turn, role, text, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) AS n FROM conversations),
w AS (SELECT conv_id, turn, CASE role WHEN 'assistant' THEN 'reply' ELSE role END AS role, CASE WHEN turn = 0 THEN text ELSE upper(text) END AS text FROM conversations), v AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) AS n FROM w),
d AS (SELECT coalesce(o.conv_id, v.conv_id) AS conv_id, CASE WHEN o.turn IS NULL THEN 'added' WHEN v.turn IS NULL THEN 'removed' WHEN o.text IS NOT DISTINCT FROM v.text THEN 'unchanged' ELSE 'modified' END AS kind FROM o FULL JOIN v ON o.conv_id = v.conv_id AND o.role = v.role AND o.n = v.n)
SELECT conv_id, count(*) FILTER (kind = 'added') AS n_added, count(*) FILTER (kind = 'removed') AS n_removed, count(*) FILTER (kind = 'modified') AS n_modified FROM d WHERE kind <> 'unchanged' GROUP BY 1
"""


def study_invariants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as studies: their nations' numbers as visits of an order's lines, orders as criteria and objectives."""
    o = table(spark, sf_dir, "orders")
    li = table(spark, sf_dir, "lineitem").join(o.select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("study_id")), "l_orderkey")
    grid = li.groupBy("study_id").agg((F.max("l_linenumber") > 2).alias("has_grid"), (F.max("l_suppkey") % 3 > 0).alias("has_slot"))
    studies = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("study_id")).join(grid, "study_id", "left").fillna(False)
    visits = li.groupBy("study_id", F.col("l_linenumber").alias("n")).agg((F.max("l_suppkey") % 6).alias("k")).select("study_id", (F.col("n") - 1).cast("int").alias("visit"), F.when(F.col("k") == 0, F.concat(F.lit("V"), F.col("n").cast("string"))).otherwise(F.concat(F.lit("Visit "), (F.col("n") % 5).cast("string"))).alias("name"), F.when(F.col("k") != 1, "Treatment").alias("epoch"))
    activities = li.select("study_id", (F.col("l_partkey") % 9).cast("int").alias("activity")).distinct().withColumn("name", F.when(F.col("activity") == 8, "").otherwise(F.col("activity").cast("string")))
    marks = li.select("study_id", (F.col("l_partkey") % 9).cast("int").alias("activity"), (F.col("l_linenumber") - 1).cast("int").alias("visit")).filter("visit < 5")
    criteria = o.select(F.col("o_custkey").alias("study_id"), F.when(F.col("o_orderstatus") == "F", "inclusion").otherwise("exclusion").alias("category"), F.substring("o_orderpriority", 3, 9).alias("text"))
    aims = o.select(F.col("o_custkey").alias("study_id"), F.when(F.col("o_orderpriority").startswith("1"), "Primary").alias("level"), F.concat(F.lit("objective "), "o_orderpriority").alias("objective"), F.when(F.col("o_orderkey") % 7 > 0, 1).alias("n_endpoints"))
    return X.study_invariants(studies, visits, activities, marks, criteria, aims)


STUDY_INVARIANTS = """
WITH li AS (SELECT l.*, o_custkey AS s FROM lineitem l JOIN orders ON l_orderkey = o_orderkey),
g AS (SELECT c_custkey AS s, coalesce(max(l_linenumber) > 2, false) AS grid, coalesce(max(l_suppkey) % 3 > 0, false) AS slot FROM customer LEFT JOIN li ON s = c_custkey GROUP BY 1),
v0 AS (SELECT s, l_linenumber AS n, max(l_suppkey) % 6 AS k FROM li GROUP BY ALL), v AS (SELECT s, count(*) AS n_v, bool_and(k <> 0) AS real, bool_and(k <> 1) AS epochs, count(DISTINCT CASE WHEN k = 0 THEN 'V' || n ELSE 'Visit ' || n % 5 END) AS names FROM v0 GROUP BY s),
a AS (SELECT s, count(DISTINCT l_partkey % 9) AS n_a, bool_and(l_partkey % 9 < 8) AS sized FROM li GROUP BY s),
m AS (SELECT li.s, bool_and(l_partkey % 9 < n_a AND l_linenumber <= n_v) AS inside, count(DISTINCT l_linenumber) AS m_v, count(DISTINCT l_partkey % 9) AS m_a FROM li JOIN v ON li.s = v.s JOIN a ON li.s = a.s WHERE l_linenumber < 6 GROUP BY li.s),
c AS (SELECT o_custkey AS s, count(*) FILTER (o_orderstatus = 'F') AS inc, count(*) FILTER (o_orderstatus <> 'F') AS exc, bool_and(length(substr(o_orderpriority, 3, 9)) BETWEEN 4 AND 3500) AS cs, count(*) AS rows, bool_or(starts_with(o_orderpriority, '1')) AS pri, bool_and(o_orderkey % 7 > 0) AS ends, bool_and(length('objective ' || o_orderpriority) >= 15) AS os FROM orders GROUP BY 1),
e AS (SELECT g.s, g.grid, g.slot, coalesce(n_v, 0) AS n_v, coalesce(n_a, 0) AS n_a, coalesce(real, true) AS real, coalesce(epochs, true) AS epochs, coalesce(names, 0) AS names, coalesce(sized, true) AS sized, coalesce(inside, true) AS inside, coalesce(m_v, 0) AS m_v, coalesce(m_a, 0) AS m_a, coalesce(inc, 0) AS inc, coalesce(exc, 0) AS exc, coalesce(cs, false) AS cs, coalesce(rows, 0) AS rows, coalesce(pri, false) AS pri, coalesce(ends, false) AS ends, coalesce(os, false) AS os
  FROM g LEFT JOIN v ON g.s = v.s LEFT JOIN a ON g.s = a.s LEFT JOIN m ON g.s = m.s LEFT JOIN c ON g.s = c.s),
r AS (SELECT s, unnest([struct_pack(p := 'schedule', i := 'slot_found', h := slot), struct_pack(p := 'schedule', i := 'grid_found', h := grid), struct_pack(p := 'schedule', i := 'enough_visits_and_activities', h := grid AND n_v >= 2 AND n_a >= 5),
  struct_pack(p := 'schedule', i := 'marks_are_in_range', h := CASE WHEN grid THEN inside END), struct_pack(p := 'schedule', i := 'every_visit_has_a_mark', h := CASE WHEN grid THEN n_v > 0 AND m_v = n_v END), struct_pack(p := 'schedule', i := 'most_activities_are_scheduled', h := CASE WHEN grid THEN n_a > 0 AND m_a >= 0.6 * n_a END),
  struct_pack(p := 'schedule', i := 'visit_names_are_real', h := CASE WHEN grid THEN real END), struct_pack(p := 'schedule', i := 'every_visit_has_an_epoch', h := CASE WHEN grid THEN epochs END), struct_pack(p := 'schedule', i := 'activity_names_are_label_sized', h := CASE WHEN grid THEN sized END),
  struct_pack(p := 'schedule', i := 'visit_names_are_unique_enough', h := CASE WHEN grid THEN n_v = 0 OR names >= 0.8 * n_v END), struct_pack(p := 'eligibility', i := 'has_inclusion', h := inc > 0), struct_pack(p := 'eligibility', i := 'has_exclusion', h := exc > 0), struct_pack(p := 'eligibility', i := 'items_are_criterion_sized', h := cs),
  struct_pack(p := 'eligibility', i := 'list_sizes_are_plausible', h := inc BETWEEN 1 AND 60 AND exc BETWEEN 1 AND 80), struct_pack(p := 'objectives', i := 'table_found', h := rows > 0), struct_pack(p := 'objectives', i := 'has_a_primary_objective', h := pri), struct_pack(p := 'objectives', i := 'every_row_has_an_endpoint', h := ends), struct_pack(p := 'objectives', i := 'objective_text_is_real', h := os)]) AS x FROM e)
SELECT s AS study_id, x.p AS part, x.i AS invariant, x.h AS holds FROM r WHERE x.h IS NOT NULL
"""


def study_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A report of its orders for each customer."""
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus")).alias("status"), F.concat("o_orderpriority", F.when(F.col("o_orderkey") % 2 == 0, F.lit("|x")).otherwise(F.lit("\ny"))).alias("note"))
    return X.markdown_reports(o, "o_custkey", ["o_orderkey"])


STUDY_REPORTS = r"""
SELECT o_custkey, '| o_orderkey | status | note |' || chr(10) || '|-|-|-|' || chr(10) || string_agg('| ' || o_orderkey || ' | ' || CASE WHEN o_orderstatus <> 'P' THEN o_orderstatus ELSE '' END || ' | ' || o_orderpriority || CASE WHEN o_orderkey % 2 = 0 THEN '\|x' ELSE ' y' END || ' |', chr(10) ORDER BY o_orderkey) AS report FROM orders GROUP BY 1
"""


def nested_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as studies with their fields, orders as arms, lines as objectives: one nested row for each, as JSON."""
    c, o = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders")
    meta = c.select(F.col("c_custkey").alias("study_id"), F.explode(F.array(F.struct(F.lit("title").alias("field"), F.col("c_name").alias("value")), F.struct(F.lit("segment").alias("field"), F.col("c_mktsegment").alias("value")))).alias("f")).select("study_id", "f.*")
    arms = o.select(F.col("o_custkey").alias("study_id"), F.col("o_orderkey").alias("ord"), F.when(F.col("o_orderstatus") == "P", F.lit("Placebo")).otherwise(F.col("o_orderpriority")).alias("name"))
    aims = o.select(F.col("o_custkey").alias("study_id"), F.col("o_orderkey").alias("record"), F.lit("primary").alias("tier"), F.col("o_orderpriority").alias("objective"), F.lit("e").alias("endpoints"))
    out = X.study_input(meta, arms, aims)
    return out.select("study_id", F.col("fields")["title"].alias("title"), F.col("fields")["segment"].alias("segment"), F.array_join(F.transform("arms", lambda a: F.concat(a["name"], F.lit("="), a["type"])), "|").alias("arms"), F.array_join(F.transform("objectives", lambda a: a["objective"]), "|").alias("objectives"))


NESTED_INPUTS = """
SELECT c_custkey AS study_id, c_name AS title, c_mktsegment AS segment, (SELECT string_agg(CASE WHEN o_orderstatus = 'P' THEN 'Placebo=placebo' ELSE o_orderpriority || '=experimental' END, '|' ORDER BY o_orderkey) FROM orders WHERE o_custkey = c_custkey) AS arms,
  (SELECT string_agg(o_orderpriority, '|' ORDER BY o_orderkey) FROM orders WHERE o_custkey = c_custkey) AS objectives FROM customer
"""


def label_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as lines of a label file, read by the schema of labels."""
    n = table(spark, sf_dir, "nation").select(F.to_json(F.struct(F.lit("metadata").alias("domain"), F.col("n_name").alias("field"), F.col("n_nationkey").cast("string").alias("label"))).alias("j"))
    return n.select(F.from_json("j", LABEL).alias("l")).select("l.domain", "l.field", "l.label")


LABEL_ROWS = "SELECT 'metadata' AS domain, n_name AS field, n_nationkey::VARCHAR AS label FROM nation"

def visit_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headers that lines stand for: names, times, footnotes and windows by numbers."""
    li, k = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey").distinct(), F.col("l_suppkey") % 6
    n = F.col("l_linenumber").cast("string")
    name = F.when(k == 0, F.concat(F.lit("Cycle 2 Day "), n, F.lit(" 0.5 h post dose"))).when(k == 1, F.concat(F.lit("Day -"), n)).when(k == 2, F.concat(F.lit("Day "), n, F.lit(" b, c"))).when(k == 3, F.concat(F.lit("EOT / Withdrawal a"))).when(k == 4, F.lit("follow up**")).otherwise(F.concat(F.lit("Day "), n, F.lit(" 5 - 7")))
    parts = F.array(F.lit("Screen"), F.when(k < 3, F.lit("ing")).otherwise(F.lit("and")), F.concat(F.lit("±"), n, F.lit(" days")), F.lit("3 days"))
    split = Z.split_label(Z.merge_wrapped(parts))
    return li.select("l_orderkey", "l_linenumber", "l_suppkey", Z.visit_identity(name).alias("identity"), Z.without_footnote(name).alias("bare"), Z.epoch_name(name).alias("epoch"), split["name"].alias("name"), split["window"].alias("window"), Z.visit_name(F.when(k == 2, F.concat(n, F.lit("a b"))).otherwise(F.lit("x")), name).alias("visit"))


VISIT_LABELS = r"""
WITH l AS (SELECT DISTINCT l_orderkey, l_linenumber, l_suppkey, l_suppkey % 6 AS k, l_linenumber::VARCHAR AS n FROM lineitem),
t AS (SELECT *, CASE k WHEN 0 THEN 'Cycle 2 Day ' || n || ' 0.5 h post dose' WHEN 1 THEN 'Day -' || n WHEN 2 THEN 'Day ' || n || ' b, c' WHEN 3 THEN 'EOT / Withdrawal a' WHEN 4 THEN 'follow up**' ELSE 'Day ' || n || ' 5 - 7' END AS name FROM l),
i AS (SELECT *, regexp_replace(name, '\s+\d+(\.\d+)?\s*(h|hrs?|hours?)\b.*$', '', 'i') AS a, regexp_replace(regexp_replace(name, '(\s+[a-z](\s*,\s*[a-z])*)+$', ''), '\s*\*+$', '') AS bare FROM t)
SELECT l_orderkey, l_linenumber, l_suppkey, regexp_replace(lower(regexp_replace(regexp_replace(a, '(\bday\s*-?\d+)\s+\d+\s*-\s*\d+$', '\1', 'i'), '(^|\W)-(\d)', '\1neg\2')), '[^\w]+', '', 'g') AS identity, bare,
  CASE WHEN regexp_matches(lower(name), '^screen') THEN 'Screening Period' WHEN regexp_matches(lower(name), '^(f/?u|follow)') THEN 'Follow-up Period' ELSE name END AS epoch, CASE WHEN k < 3 THEN 'Screening' ELSE 'Screen and' END AS name, '±' || n || ' days' AS window, CASE WHEN k = 2 THEN 'Visit ' || n || 'a' ELSE bare END AS visit FROM i
"""


def title_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First pages of documents, with a line in front of every other one."""
    d = table(spark, sf_dir, "documents")
    front = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("A Phase 2/3 study of ABC-12"), (F.col("doc_id") % 90 + 10).cast("string"), F.lit("\n"))).otherwise(F.lit(""))
    return Z.title_page(B.classify_blocks(B.text_blocks(d.select("doc_id", F.concat(front, F.coalesce("text", F.lit(""))).alias("text")))))


TITLE_PAGES = r"""
WITH t AS (SELECT doc_id, string_split(CASE WHEN doc_id % 2 = 0 THEN 'A Phase 2/3 study of ABC-12' || (doc_id % 90 + 10) || chr(10) ELSE '' END || coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, generate_subscripts(ls, 1) - 1 AS ord, trim(regexp_replace(unnest(ls), '\s+', ' ', 'g')) AS t FROM t), b AS (SELECT *, CASE WHEN length(t) < 60 AND NOT regexp_matches(t, '[.,;:]$') THEN 14.0 ELSE 10.0 END AS size FROM l WHERE t <> '' AND ord < 8),
m AS (SELECT doc_id, list_sort(list(size))[len(list(size)) // 2 + 1] AS med, string_agg(t, chr(10) ORDER BY ord) AS page FROM b GROUP BY doc_id), h AS (SELECT b.doc_id, t, ord FROM b JOIN m ON m.doc_id = b.doc_id WHERE size >= 1.25 * med AND length(t) > 12 AND length(t) < 120)
SELECT doc_id, 'studyTitle' AS field, t AS value FROM h QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY length(t) DESC, ord) = 1 UNION ALL SELECT doc_id, 'studyPhase', v FROM (SELECT doc_id, regexp_extract(page, '(?i)\bphase\s*(?:0|i{1,3}v?|iv|[1-4])(?:\s*[/-]\s*(?:i{1,3}v?|[1-4]))?\b') AS v FROM m) WHERE v <> ''
UNION ALL SELECT doc_id, 'protocolIdentifier', v FROM (SELECT doc_id, regexp_extract(page, '\b[A-Z]{2,}[A-Z0-9]*-?\d{2,}(?:-[A-Z0-9]+)*\b') AS v FROM m) WHERE v <> ''
"""


def current_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Z.exclude_under(S.top_level_parent(_titles(spark, sf_dir)), "amendment|changes").select("doc_id", "ord")


CURRENT_SECTIONS = f"""
WITH {TITLES_SQL}, p AS (SELECT doc_id, ord, last_value(CASE WHEN level = 1 THEN lower(title) END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM ts)
SELECT doc_id, ord FROM p WHERE top IS NULL OR NOT regexp_matches(top, 'amendment|changes')
"""


def organization_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("study_id"), F.when(F.col("s_nationkey") % 3 == 0, "croName").when(F.col("s_nationkey") % 3 == 1, "centralLaboratoryName").otherwise("other").alias("field"), F.when(F.col("s_suppkey") % 5 > 0, F.col("s_name")).otherwise(F.lit(" ")).alias("value"))
    kinds = spark.createDataFrame([("croName", "cro", "C54148"), ("centralLaboratoryName", "lab", "C37984")], "field string, kind string, org_code string")
    rows, findings = Z.with_roles(s, kinds, spark.createDataFrame([("lab", "C37984")], "kind string, role_code string"))
    return rows.join(findings.select("study_id", "severity"), "study_id", "left")


ORGANIZATION_ROLES = """
WITH s AS (SELECT s_suppkey AS study_id, CASE s_nationkey % 3 WHEN 0 THEN 'croName' WHEN 1 THEN 'centralLaboratoryName' END AS field, CASE WHEN s_suppkey % 5 > 0 THEN s_name END AS value FROM supplier)
SELECT study_id, field, value, CASE field WHEN 'croName' THEN 'C54148' ELSE 'C37984' END AS org_code, CASE WHEN field <> 'croName' THEN 'C37984' END AS role_code, CASE WHEN field = 'croName' THEN 'INFO' END AS severity FROM s WHERE field IS NOT NULL AND value IS NOT NULL
"""


def study_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as studies: schedules, footnotes and objectives from their lines, all findings in one table."""
    o, li = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    key = F.col("l_orderkey").alias("study_id")
    schedules = o.select(F.col("o_orderkey").alias("study_id"), (F.col("o_custkey") % 5).alias("n_activities"), (F.col("o_orderkey") % 4).alias("n_visits"), (F.col("o_orderstatus") == "O").alias("has_design"))
    marks = li.join(schedules, F.col("l_orderkey") == F.col("study_id")).filter((F.col("l_linenumber") - 1 < F.col("n_activities")) & (F.col("l_suppkey") % 4 < F.col("n_visits"))).select("study_id", F.col("l_linenumber").alias("activity"), (F.col("l_suppkey") % 4).alias("visit"))
    marked = li.filter("l_returnflag = 'R'").select(key, F.col("l_linenumber").alias("activity"))
    texts = li.select(key, F.when(F.col("l_tax") > 0.05, F.lit("intro\n a. Taken before")).otherwise(F.lit("no notes")).alias("text"))
    aims = li.select(key, F.when(F.col("l_linenumber") == 1, "Primary").otherwise("secondary").alias("level"), F.lit("o").alias("objective"), F.when(F.col("l_quantity") > 20, F.lit("e")).alias("endpoint"))
    own = Z.schedule_findings(schedules, marks)
    return Z.all_findings(own, Z.footnote_findings(marked, texts), Z.objective_findings(aims), own.limit(0).select("study_id", "kind"))


STUDY_FINDINGS = r"""
WITH s AS (SELECT o_orderkey AS k, o_custkey % 5 AS na, o_orderkey % 4 AS nv, o_orderstatus = 'O' AS d FROM orders), m AS (SELECT DISTINCT k, l_linenumber AS a, l_suppkey % 4 AS v FROM lineitem JOIN s ON l_orderkey = k WHERE l_linenumber - 1 < na AND l_suppkey % 4 < nv),
u AS (SELECT s.*, (SELECT count(DISTINCT a) FROM m WHERE m.k = s.k) AS ua, (SELECT count(DISTINCT v) FROM m WHERE m.k = s.k) AS uv FROM s),
f AS (SELECT l_orderkey AS k, count(DISTINCT l_linenumber) FILTER (l_returnflag = 'R') AS n, bool_or(l_tax > 0.05) AS defined, count(*) FILTER (l_linenumber = 1) AS p, count(*) FILTER (l_linenumber = 1 AND l_quantity > 20) AS e, count(*) FILTER (l_linenumber <> 1 AND l_quantity <= 20) AS o FROM lineitem GROUP BY 1)
SELECT k AS study_id, 'no_matrix' AS kind, CASE WHEN d THEN 'ERROR' ELSE 'WARNING' END AS severity, 0::BIGINT AS n FROM u WHERE na = 0 OR nv = 0 UNION ALL SELECT k, 'activities_at_no_visit', 'WARNING', na - ua FROM u WHERE na > 0 AND nv > 0 AND na > ua UNION ALL SELECT k, 'visits_without_activity', 'WARNING', nv - uv FROM u WHERE na > 0 AND nv > 0 AND nv > uv
UNION ALL SELECT k, 'footnotes_not_defined', 'WARNING', n FROM f WHERE n > 0 AND NOT defined UNION ALL SELECT k, 'no_primary_objective', 'ERROR', 0 FROM f WHERE p = 0 UNION ALL SELECT k, 'primary_without_endpoint', 'ERROR', p FROM f WHERE p > 0 AND e = 0 UNION ALL SELECT k, 'objectives_without_endpoint', 'WARNING', o FROM f WHERE p > 0 AND o > 0
"""


def ranked_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("doc_id"), F.dayofyear("ts").alias("page"), F.lit(1).alias("weight"), (F.col("event_type") == "error").alias("is_historic"), (F.col("event_type") == "purchase").alias("is_current"))
    return Z.page_manifest(e, 4)


RANKED_PAGES = """
WITH p AS (SELECT user_id AS doc_id, dayofyear(ts)::INT AS page, count(*) + CASE WHEN bool_or(event_type = 'error') THEN -36 ELSE 0 END + CASE WHEN bool_or(event_type = 'purchase') THEN 4 ELSE 0 END AS score FROM events GROUP BY ALL),
t AS (SELECT doc_id, page, sum(score)::BIGINT AS score FROM (SELECT * FROM p UNION ALL SELECT doc_id, page + 1, 1 FROM p WHERE score > 0) GROUP BY ALL HAVING sum(score) > 0)
SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, page)::INT AS rank FROM t QUALIFY rank <= 4
"""


QUERIES = {
    "study_invariants": study_invariants, "study_reports": study_reports,
    "visit_labels": visit_labels, "title_pages": title_pages, "current_sections": current_sections, "organization_roles": organization_roles, "study_findings": study_findings, "ranked_pages": ranked_pages,
    "title_axes": title_axes, "labelled_sections": labelled_sections, "deep_types": deep_types, "fingerprints": fingerprints, "feature_rows": feature_rows, "missing_visits": missing_visits, "domains_touched": domains_touched, "all_cells": all_cells, "live_jobs": live_jobs, "scalar_agreement": scalar_agreement, "study_scores": study_scores,
    "first_tables": first_tables, "first_writes": first_writes, "permitted_candidates": permitted_candidates, "table_data": table_data, "reviewer_rows": reviewer_rows, "training_studies": training_studies, "change_rationales": change_rationales, "placed_bookmarks": placed_bookmarks, "chosen_graphs": chosen_graphs,
    "bounding_tables": bounding_tables, "merged_windows": merged_windows, "table_edges": table_edges, "amendment_counts": amendment_counts, "nested_inputs": nested_inputs, "label_rows": label_rows,
}
SQL = {
    "study_invariants": STUDY_INVARIANTS, "study_reports": STUDY_REPORTS,
    "visit_labels": VISIT_LABELS, "title_pages": TITLE_PAGES, "current_sections": CURRENT_SECTIONS, "organization_roles": ORGANIZATION_ROLES, "study_findings": STUDY_FINDINGS, "ranked_pages": RANKED_PAGES,
    "title_axes": TITLE_AXES_SQL, "labelled_sections": LABELLED_SECTIONS, "deep_types": DEEP_TYPES, "fingerprints": FINGERPRINTS, "feature_rows": FEATURE_ROWS, "missing_visits": MISSING_VISITS, "domains_touched": DOMAINS_TOUCHED, "all_cells": ALL_CELLS, "live_jobs": LIVE_JOBS, "scalar_agreement": SCALAR_AGREEMENT,
    "first_tables": FIRST_TABLES, "first_writes": FIRST_WRITES, "permitted_candidates": PERMITTED_CANDIDATES, "table_data": TABLE_DATA, "reviewer_rows": REVIEWER_ROWS, "training_studies": TRAINING_STUDIES, "change_rationales": CHANGE_RATIONALES, "placed_bookmarks": PLACED_BOOKMARKS, "chosen_graphs": CHOSEN_GRAPHS,
    "bounding_tables": BOUNDING_TABLES, "merged_windows": MERGED_WINDOWS, "table_edges": TABLE_EDGES, "amendment_counts": AMENDMENT_COUNTS, "nested_inputs": NESTED_INPUTS, "label_rows": LABEL_ROWS,
}
