"""Queries over text functions, quotes and votes, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shared import checkpointed
from ..functions import text as T
from ..operators import voting
from ..operators.audit import risk_rank
from ..operators.scoring import score_fields, summarize
from .inputs import table


def text_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(T.norm(text)).alias("norm_md5"), F.md5(T.norm_words(text)).alias("words_md5"), F.md5(T.escape_markup(text)).alias("escaped_md5"), T.usable(text).alias("usable"))


TEXT_NORMALISE = r"""
SELECT doc_id, md5(lower(trim(regexp_replace(text, '\s+', ' ', 'g')))) AS norm_md5, md5(trim(regexp_replace(lower(text), '[^\p{L}\p{N}_]+', ' ', 'g'))) AS words_md5,
  md5(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')) AS escaped_md5,
  NOT lower(trim(coalesce(text, ''))) IN ('', 'n/a', 'na', 'tbd', 'tba', 'unknown', 'none', '-', 'not applicable') AS usable
FROM documents
"""


def token_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", T.tokens(F.col("text")).alias("t"))
    after = rows.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("t").alias("u"))
    return rows.join(after, ["conv_id", "turn"]).select("conv_id", "turn", F.round(T.jaccard(F.col("t"), F.col("u")), 9).alias("jaccard"))


TOKEN_JACCARD = r"""
WITH t AS (SELECT conv_id, turn, list_distinct(regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}_]+')) AS t FROM conversations)
SELECT a.conv_id, a.turn, round(CASE WHEN len(list_distinct(a.t || b.t)) = 0 THEN 0 ELSE len(list_intersect(a.t, b.t))::DOUBLE / len(list_distinct(a.t || b.t)) END, 9) AS jaccard
FROM t a JOIN t b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1
"""


def edit_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    return p.select("p_partkey", F.levenshtein("p_name", F.lower("p_type")).alias("distance"), F.round(T.edit_share(F.col("p_name"), F.lower("p_type")), 9).alias("share"))


EDIT_DISTANCE = """
SELECT p_partkey, levenshtein(p_name, lower(p_type))::INT AS distance, round(levenshtein(p_name, lower(p_type))::DOUBLE / greatest(length(p_name), length(p_type)), 9) AS share FROM part
"""


def _fields(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Three fields of each part: a scalar, a number, a long text, with predictions that are right, near or wrong."""
    p, k = table(spark, sf_dir, "part"), F.col("p_partkey")
    brand = F.when(k % 4 == 0, F.col("p_brand")).when(k % 4 == 1, F.lower("p_brand")).when(k % 4 == 2, F.lit("Brand?"))
    size = F.when(k % 3 == 0, F.col("p_size").cast("string")).when(k % 3 == 1, (F.col("p_size") + 0.5).cast("string")).otherwise((F.col("p_size") + 7).cast("string"))
    name = F.when(k % 2 == 0, F.concat(F.col("p_name"), F.lit(" extra"))).otherwise(F.col("p_type"))
    rows = lambda field, label, value, kind: p.select(k.alias("study"), F.lit(field).alias("domain"), label.cast("string").alias("label"), value.alias("predicted"), F.lit(kind).alias("kind"))
    all_ = rows("brand", F.col("p_brand"), brand, "scalar").unionByName(rows("size", F.col("p_size"), size, "number")).unionByName(rows("name", F.col("p_name"), name, "long_text"))
    return all_.select("study", "domain", "predicted"), all_.select("study", "domain", "label", "kind")


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_fields(*_fields(spark, sf_dir), ["study", "domain"])


def typed_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores(spark, sf_dir).select("study", "domain", "verdict", F.round("similarity", 9).alias("similarity"))


SCORES_SQL = r"""
f AS (
  SELECT p_partkey AS study, 'brand' AS domain, p_brand AS label, CASE p_partkey % 4 WHEN 0 THEN p_brand WHEN 1 THEN lower(p_brand) WHEN 2 THEN 'Brand?' END AS predicted, 'scalar' AS kind FROM part
  UNION ALL SELECT p_partkey, 'size', p_size::VARCHAR, CASE p_partkey % 3 WHEN 0 THEN p_size::VARCHAR WHEN 1 THEN (p_size + 0.5::DOUBLE)::VARCHAR ELSE (p_size + 7)::VARCHAR END, 'number' FROM part
  UNION ALL SELECT p_partkey, 'name', p_name, CASE p_partkey % 2 WHEN 0 THEN p_name || ' extra' ELSE p_type END, 'long_text' FROM part),
n AS (SELECT *, trim(regexp_replace(lower(predicted), '[^\p{L}\p{N}_]+', ' ', 'g')) AS np, trim(regexp_replace(lower(label), '[^\p{L}\p{N}_]+', ' ', 'g')) AS nl,
  abs(try_cast(predicted AS DOUBLE) - try_cast(label AS DOUBLE)) AS gap, list_distinct(regexp_extract_all(lower(coalesce(predicted, '')), '[\p{L}\p{N}_]+')) AS tp, list_distinct(regexp_extract_all(lower(label), '[\p{L}\p{N}_]+')) AS tl FROM f),
j AS (SELECT *, CASE WHEN len(list_distinct(tp || tl)) = 0 THEN 1.0 ELSE len(list_intersect(tp, tl))::DOUBLE / len(list_distinct(tp || tl)) END AS near FROM n),
s AS (SELECT study, domain, predicted, label, kind,
  CASE WHEN coalesce(predicted, '') = '' THEN 'absent' WHEN predicted = label THEN 'exact' WHEN np = nl THEN 'normalized' WHEN kind = 'number' AND gap <= 1 THEN 'fuzzy' WHEN kind = 'long_text' AND near >= 0.5 THEN 'fuzzy' ELSE 'mismatch' END AS verdict,
  CASE WHEN coalesce(predicted, '') = '' THEN 0 WHEN predicted = label OR np = nl THEN 1 WHEN kind = 'number' AND gap <= 1 THEN greatest(0, 1 - gap / greatest(abs(try_cast(label AS DOUBLE)), 1)) WHEN kind = 'long_text' THEN near ELSE 0 END::DOUBLE AS similarity FROM j)
"""
TYPED_SCORES = f"WITH {SCORES_SQL} SELECT study, domain, verdict, round(similarity, 9) AS similarity FROM s"


def score_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summarize(scores(spark, sf_dir)).withColumns({c: F.round(c, 9) for c in ("accuracy", "accuracy_of_found")})


SCORE_SUMMARY = f"""
WITH {SCORES_SQL}
SELECT domain, count(*) AS n, count(*) FILTER (verdict IN ('exact', 'normalized', 'fuzzy')) AS correct, count(*) FILTER (verdict = 'absent') AS absent,
  count(*) FILTER (verdict = 'exact') AS n_exact, count(*) FILTER (verdict = 'normalized') AS n_normalized, count(*) FILTER (verdict = 'fuzzy') AS n_fuzzy,
  round(count(*) FILTER (verdict IN ('exact', 'normalized', 'fuzzy'))::DOUBLE / count(*), 9) AS accuracy,
  round(count(*) FILTER (verdict IN ('exact', 'normalized', 'fuzzy'))::DOUBLE / nullif(count(*) FILTER (verdict <> 'absent'), 0), 9) AS accuracy_of_found
FROM s GROUP BY ROLLUP (domain)
"""


def _quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark passages as quotes; odd ones with two blanks for one, so that only the second pass finds them."""
    b = table(spark, sf_dir, "benchmark")
    return b.select(F.col("item_id").alias("quote_id"), F.when(F.col("item_id") % 2 == 1, F.replace("text", F.lit(" "), F.lit("  "))).otherwise(F.col("text")).alias("quote"))


def resolve_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return voting.resolve_quotes(table(spark, sf_dir, "documents"), _quotes(spark, sf_dir))


QUOTES_SQL = r"""
q AS (SELECT item_id AS quote_id, CASE WHEN item_id % 2 = 1 THEN replace(text, ' ', '  ') ELSE text END AS quote, text AS passage FROM benchmark),
r AS (SELECT d.doc_id, q.quote_id, CASE WHEN contains(d.text, q.quote) THEN 'exact' ELSE 'normalized' END AS verify_pass,
  CASE WHEN contains(d.text, q.quote) THEN instr(d.text, q.quote) ELSE instr(regexp_replace(d.text, '\s+', ' ', 'g'), regexp_replace(q.quote, '\s+', ' ', 'g')) END - 1 AS start, d.text, q.passage
  FROM documents d JOIN q ON contains(d.text, q.quote) OR contains(regexp_replace(d.text, '\s+', ' ', 'g'), regexp_replace(q.quote, '\s+', ' ', 'g')))
"""
RESOLVE_QUOTES = f"WITH {QUOTES_SQL} SELECT doc_id, quote_id, verify_pass, start::INT AS start FROM r"


def verify_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = resolve_quotes(spark, sf_dir).join(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id").join(table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("quote_id"), F.col("text").alias("passage")), "quote_id")
    half = F.concat(F.col("passage"), F.lit(" absentword"))
    return found.select("doc_id", "quote_id", T.verify(F.upper("passage"), F.col("passage"), F.col("text")).alias("by_span"), T.verify(half, F.lit(""), F.col("text")).alias("by_words"), T.verify(F.lit("zzqq yyxx"), F.lit(""), F.col("text")).alias("nothing"))


VERIFY_VALUES = rf"""
WITH {QUOTES_SQL},
w AS (SELECT *, list_filter(regexp_split_to_array(lower(passage || ' absentword'), '[^\p{{L}}\p{{N}}_]+'), lambda x: length(x) > 2) AS ws, lower(trim(regexp_replace(text, '\s+', ' ', 'g'))) AS low FROM r)
SELECT doc_id, quote_id, 'supported' AS by_span, CASE WHEN len(list_filter(ws, lambda x: contains(low, x)))::DOUBLE / len(ws) >= 0.9 THEN 'supported' WHEN len(list_filter(ws, lambda x: contains(low, x)))::DOUBLE / len(ws) >= 0.5 THEN 'partial' ELSE 'unsupported' END AS by_words, 'unsupported' AS nothing
FROM w
"""


def _candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as candidates for one field of their order: value and quote from the item, method from its supplier."""
    li = table(spark, sf_dir, "lineitem")
    ord_ = F.col("l_linenumber") * 1_000_000 + F.col("l_partkey") * 100 + F.col("l_suppkey") % 100
    sanity = F.when(F.col("l_quantity") > 45, "failed").when(F.col("l_quantity") > 20, "confirmed").otherwise("neutral")
    return li.select(
        F.col("l_orderkey").alias("study"), F.when(F.col("l_linestatus") == "O", F.concat(F.lit(" "), F.lower("l_returnflag"))).otherwise(F.col("l_returnflag")).alias("value"), F.concat(F.lit("m"), (F.col("l_suppkey") % 4).cast("string")).alias("method"), (F.col("l_suppkey") % 4 >= 2).alias("is_model"),
        sanity.alias("sanity"), ord_.alias("ord"), F.when(F.col("l_discount") > 0.02, F.col("l_shipdate").cast("string")).alias("quote"), (F.col("l_tax") > 0.03).alias("quote_ok"),
    ).dropDuplicates(["study", "ord"])


CANDIDATES_SQL = """
c0 AS (SELECT l_orderkey AS study, CASE WHEN l_linestatus = 'O' THEN ' ' || lower(l_returnflag) ELSE l_returnflag END AS value, 'm' || (l_suppkey % 4) AS method, l_suppkey % 4 >= 2 AS is_model,
  CASE WHEN l_quantity > 45 THEN 'failed' WHEN l_quantity > 20 THEN 'confirmed' ELSE 'neutral' END AS sanity, l_linenumber::BIGINT * 1000000 + l_partkey * 100 + l_suppkey % 100 AS ord, l_tax > 0.03 AS quote_ok, l_discount > 0.02 AS has_quote FROM lineitem),
c AS (SELECT * FROM c0 QUALIFY count(*) OVER (PARTITION BY study, ord) = 1),
b AS (SELECT study, lower(trim(value)) AS norm, count(DISTINCT CASE WHEN is_model THEN method ELSE 'deterministic' END) AS n_groups, bool_or(is_model) AS any_model, count(*) AS n, arg_min(value, ord) AS value, min(ord) AS first_ord, arg_min(sanity, ord) AS sanity FROM c GROUP BY study, lower(trim(value))),
v AS (SELECT study, CASE WHEN sanity <> 'failed' THEN value END AS value, sanity, n_groups >= 2 AS agree, n, any_model FROM b
  QUALIFY row_number() OVER (PARTITION BY study ORDER BY sanity <> 'failed' DESC, sanity = 'confirmed' DESC, n_groups DESC, any_model DESC, n DESC, first_ord) = 1)
"""


def _single(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates whose order number is their own; repeated ones would make first-seen values depend on the reader."""
    rows = _candidates(spark, sf_dir)
    li = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("study"), (F.col("l_linenumber") * 1_000_000 + F.col("l_partkey") * 100 + F.col("l_suppkey") % 100).alias("ord"))
    once = li.groupBy("study", "ord").agg(F.count("*").alias("_n")).filter("_n = 1").drop("_n")
    return rows.join(once, ["study", "ord"])


def ensemble_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    return voting.vote(_single(spark, sf_dir), ["study"])


ENSEMBLE_VOTE = f"WITH {CANDIDATES_SQL} SELECT * FROM v"


def grounding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return voting.resolve_grounding(_single(spark, sf_dir).withColumn("quote", F.when(F.col("quote").isNotNull(), F.col("ord").cast("string"))), ["study"])


GROUNDING_SQL = CANDIDATES_SQL + """,
g AS (SELECT study, arg_min(ord::VARCHAR, ord) FILTER (has_quote AND quote_ok) AS quote, count(*) FILTER (has_quote) > 0 AND count(*) FILTER (has_quote AND quote_ok) = 0 AS grounding_failed FROM c GROUP BY study)
"""
GROUNDING = f"WITH {GROUNDING_SQL} SELECT * FROM g"


def assured_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One decision per order, also for orders without candidates."""
    fields = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("study"), F.when(F.col("o_orderpriority") < "2", "supported").when(F.col("o_orderpriority") < "4", "partial").otherwise("unsupported").alias("verifier"))
    rows = fields.join(ensemble_vote(spark, sf_dir), "study", "left").join(grounding(spark, sf_dir).drop("quote"), "study", "left")
    out = voting.assure(rows, ["study"])
    return out.select("study", "value", "confidence", "decision", risk_rank(F.col("decision")).alias("risk"))


ASSURED_SQL = GROUNDING_SQL + """,
a0 AS (SELECT o_orderkey AS study, CASE WHEN o_orderpriority < '2' THEN 'supported' WHEN o_orderpriority < '4' THEN 'partial' ELSE 'unsupported' END AS verifier, v.value, coalesce(agree, false) AS agree, coalesce(sanity = 'confirmed', false) AS confirmed, coalesce(n, 0) AS n, coalesce(any_model, false) AS any_model, coalesce(grounding_failed, false) AS failed
  FROM orders LEFT JOIN v ON o_orderkey = v.study LEFT JOIN g ON o_orderkey = g.study),
a1 AS (SELECT *, value IS NULL OR failed AS blocked, CASE WHEN value IS NULL OR failed THEN 0.0 ELSE round(greatest(0, least(1, 0.45 + 0.3 * (agree OR confirmed)::INT + 0.05 * least(n, 3) + CASE verifier WHEN 'supported' THEN 0.15 WHEN 'unsupported' THEN -0.35 ELSE 0 END)), 6) END::DOUBLE AS confidence FROM a0),
assured AS (SELECT study, value, confidence, CASE WHEN blocked THEN 'BLOCK' WHEN verifier = 'unsupported' THEN 'REVIEW' WHEN (agree OR (NOT any_model AND confirmed)) AND verifier = 'supported' AND confidence >= 0.8 THEN 'AUTO_ACCEPT' ELSE 'REVIEW' END AS decision FROM a1)
"""
ASSURED_FIELDS = f"WITH {ASSURED_SQL} SELECT *, CASE decision WHEN 'BLOCK' THEN 0 WHEN 'AUTO_ACCEPT' THEN 2 ELSE 1 END::INT AS risk FROM assured"


def pairwise_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select(F.col("p_brand").alias("study"), F.col("p_name").alias("value"))
    return voting.pairwise_agreement(p, ["study"]).withColumn("fuzzy_agreement", F.round("fuzzy_agreement", 6))


PAIRWISE_AGREEMENT = r"""
WITH v AS (SELECT DISTINCT p_brand AS study, p_name AS value FROM part), t AS (SELECT *, list_distinct(regexp_extract_all(lower(value), '[\p{L}\p{N}_]+')) AS t FROM v),
n AS (SELECT study, count(*)::INT AS n_values FROM v GROUP BY study),
p AS (SELECT a.study, avg(len(list_intersect(a.t, b.t))::DOUBLE / len(list_distinct(a.t || b.t))) AS m FROM t a JOIN t b ON a.study = b.study AND a.value < b.value GROUP BY a.study)
SELECT n.study, n_values, round(m, 6) AS fuzzy_agreement FROM n LEFT JOIN p ON n.study = p.study
"""


def assured_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: which benchmark passages a document holds, found by which pass, how sure, and what to do with it."""
    found = resolve_quotes(spark, sf_dir)
    candidates = found.select("doc_id", "quote_id", F.col("quote_id").cast("string").alias("value"), F.lit("quote").alias("method"), F.lit(False).alias("is_model"), F.when(F.col("verify_pass") == "exact", "confirmed").otherwise("neutral").alias("sanity"), F.col("start").alias("ord"), F.col("verify_pass").alias("quote"), F.lit(True).alias("quote_ok")).transform(checkpointed)  # read twice
    keys = ["doc_id", "quote_id"]
    rows = voting.vote(candidates, keys).join(voting.resolve_grounding(candidates, keys), keys).withColumn("verifier", F.when(F.col("quote") == "exact", "supported").otherwise("partial"))
    return voting.assure(rows, keys).select(*keys, F.col("quote").alias("verify_pass"), "confidence", "decision", risk_rank(F.col("decision")).alias("risk"))


ASSURED_PASSAGES = f"""
WITH {QUOTES_SQL}
SELECT doc_id, quote_id, verify_pass, CASE WHEN verify_pass = 'exact' THEN 0.95 ELSE 0.5 END::DOUBLE AS confidence, CASE WHEN verify_pass = 'exact' THEN 'AUTO_ACCEPT' ELSE 'REVIEW' END AS decision, CASE WHEN verify_pass = 'exact' THEN 2 ELSE 1 END::INT AS risk FROM r
"""


def html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.md5(T.strip_tags(F.col("html"))).alias("text_md5"), F.char_length(T.strip_tags(F.col("html"))).alias("n_chars"))


HTML_TEXT = r"""
WITH t AS (SELECT page_id, trim(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace(coalesce(html, ''), '<[^>]*>', ' ', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&nbsp;', ' '), '&amp;', '&'), '\s+', ' ', 'g')) AS t FROM pages)
SELECT page_id, md5(t) AS text_md5, length(t)::INT AS n_chars FROM t
"""


def cell_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    cell = F.when(F.col("p_size") % 4 == 0, F.lit("X")).when(F.col("p_size") % 4 == 1, F.concat(F.lit("Exam "), F.col("p_name"))).when(F.col("p_size") % 4 == 2, F.lit("✓")).otherwise(F.concat(F.lit("Table "), F.col("p_size").cast("string"), F.lit(" cont. "), F.col("p_name")))
    return p.select("p_partkey", T.mark_anywhere(cell).alias("anywhere"), T.mark_first(cell).alias("first"), T.continued(cell).alias("continued"), T.caption(cell).alias("caption"))


CELL_MARKS = r"""
WITH c AS (SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN 'X' WHEN 1 THEN 'Exam ' || p_name WHEN 2 THEN '✓' ELSE 'Table ' || p_size || ' cont. ' || p_name END AS t FROM part)
SELECT p_partkey, regexp_matches(t, '[xX✓✔●•]') AS anywhere, t IN ('X', '✓') AS first, contains(t, 'cont.') AS continued, false AS caption FROM c
"""


def timings(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, n = table(spark, sf_dir, "part"), F.col("p_size").cast("string")
    s = F.when(F.col("p_size") % 3 == 0, F.concat(F.lit("Week "), n, F.lit(" ±"), (F.col("p_size") % 5).cast("string"), F.lit(" days"))).when(F.col("p_size") % 3 == 1, F.concat(F.lit("Day -"), n, F.lit(" -2/+4"))).otherwise(F.concat(F.lit("Month "), n, F.lit(" (± 1 week)")))
    return p.select("p_partkey", T.day_value(s).alias("days"), T.visit_window(s)["before"].alias("before"), T.visit_window(s)["after"].alias("after"))


TIMINGS = """
SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN 7 * p_size WHEN 1 THEN -p_size ELSE 30 * p_size END::INT AS days, CASE p_size % 3 WHEN 0 THEN p_size % 5 WHEN 1 THEN 2 ELSE 7 END::INT AS before, CASE p_size % 3 WHEN 0 THEN p_size % 5 WHEN 1 THEN 4 ELSE 7 END::INT AS after FROM part
"""


def planned_duration(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select("p_brand", T.day_value(F.concat(F.lit("day "), F.col("p_size").cast("string"))).alias("d"))
    span = F.max("d") - F.min("d")
    return p.groupBy("p_brand").agg(F.when((F.count("d") >= 2) & (span > 0), span).alias("days"))


PLANNED_DURATION = "SELECT p_brand, CASE WHEN count(*) >= 2 THEN nullif(max(p_size) - min(p_size), 0) END AS days FROM part GROUP BY p_brand"


def phases_and_ages(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, n = table(spark, sf_dir, "part"), F.col("p_size")
    s = F.concat(F.lit("A Phase "), F.when(n % 2 == 0, "II").otherwise("3"), F.lit(" study, then phase 2, ages "), n.cast("string"), F.lit(" to "), (n + 40).cast("string"), F.lit(" years"), F.when(n % 5 == 0, F.lit(", or 70 years or older")).otherwise(F.lit("")))
    return p.select("p_partkey", F.array_join(T.phases(s), ",").alias("phases"), T.age_range(s)["low"].alias("low"), T.age_range(s)["high"].alias("high"))


PHASES_AND_AGES = "SELECT p_partkey, CASE p_size % 2 WHEN 0 THEN '2' ELSE '3,2' END AS phases, CASE WHEN p_size % 5 = 0 THEN least(p_size, 70) ELSE p_size END::INT AS low, CASE WHEN p_size % 5 <> 0 THEN p_size + 40 END::INT AS high FROM part"


def listed_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    s = F.concat(F.lit("1. Subjects with "), F.col("p_name"), F.lit("\n2) short\n3. No "), F.col("p_type"), F.lit(" before visit.\n4. Exclusion criteria:"))
    return p.select("p_partkey", F.array_join(T.list_items(s), "|").alias("items"))


LISTED_ITEMS = r"""
WITH t AS (SELECT p_partkey, regexp_replace('1. Subjects with ' || p_name || chr(10) || '2) short' || chr(10) || '3. No ' || p_type || ' before visit.' || chr(10) || '4. Exclusion criteria:', '\s+', ' ', 'g') AS t FROM part),
i AS (SELECT p_partkey, list_filter(list_transform(regexp_split_to_array(t, '(^|\s)[0-9]{1,2}[.)]\s'), lambda x: trim(x)), lambda x: length(x) >= 8 AND NOT regexp_matches(lower(x), 'criteria:?$')) AS items FROM t)
SELECT p_partkey, array_to_string(list_transform(items, lambda x: CASE WHEN x LIKE '%.' THEN x ELSE x || '.' END), '|') AS items FROM i
"""

QUERIES = {
    "text_normalise": text_normalise, "token_jaccard": token_jaccard, "edit_distance": edit_distance, "typed_scores": typed_scores, "score_summary": score_summary, "resolve_quotes": resolve_quotes, "verify_values": verify_values, "ensemble_vote": ensemble_vote, "grounding": grounding,
    "assured_fields": assured_fields, "pairwise_agreement": pairwise_agreement, "assured_passages": assured_passages, "html_text": html_text, "cell_marks": cell_marks, "timings": timings, "planned_duration": planned_duration, "phases_and_ages": phases_and_ages, "listed_items": listed_items,
}
SQL = {
    "text_normalise": TEXT_NORMALISE, "token_jaccard": TOKEN_JACCARD, "edit_distance": EDIT_DISTANCE, "typed_scores": TYPED_SCORES, "score_summary": SCORE_SUMMARY, "resolve_quotes": RESOLVE_QUOTES, "verify_values": VERIFY_VALUES, "ensemble_vote": ENSEMBLE_VOTE, "grounding": GROUNDING,
    "assured_fields": ASSURED_FIELDS, "pairwise_agreement": PAIRWISE_AGREEMENT, "assured_passages": ASSURED_PASSAGES, "html_text": HTML_TEXT, "cell_marks": CELL_MARKS, "timings": TIMINGS, "planned_duration": PLANNED_DURATION, "phases_and_ages": PHASES_AND_AGES, "listed_items": LISTED_ITEMS,
}
