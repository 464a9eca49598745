"""Queries over features, calibration and bounds, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import content_hash
from ..operators import calibration as C
from .inputs import table


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row of features per document, with its label where there is one."""
    d, l = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    text = F.coalesce("text", F.lit(""))
    rows = d.select("doc_id", "lang", F.char_length(text).alias("span_length"), (F.size(F.split(text, "\n")) - 1).alias("n_breaks"), F.when(F.contains(text, F.lit("%%")), F.lit(1.0)).when(F.contains(text, F.lit("!!")), F.lit(0.5)).alias("odd"))
    return rows.join(l, "doc_id", "left").withColumn("correct", F.col("quality") == 1)


def encoded_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = C.encode(features(spark, sf_dir), {"lang": ["de", "en", "es", "fr"]}, ["odd"], ["span_length", "n_breaks"], ["doc_id", "correct"])
    return out.withColumns({c: F.round(c, 9) for c in ("log_span_length", "log_n_breaks")})


FEATURES_SQL = "f AS (SELECT d.doc_id, lang, length(coalesce(text, '')) AS n, len(string_split(coalesce(text, ''), chr(10))) - 1 AS b, CASE WHEN contains(text, '%%') THEN 1.0 WHEN contains(text, '!!') THEN 0.5 END AS odd, quality = 1 AS correct FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"
ENCODED_FEATURES = f"""
WITH {FEATURES_SQL} SELECT doc_id, correct, coalesce(lang = 'de', false)::DOUBLE AS lang_de, coalesce(lang = 'en', false)::DOUBLE AS lang_en, coalesce(lang = 'es', false)::DOUBLE AS lang_es, coalesce(lang = 'fr', false)::DOUBLE AS lang_fr,
  coalesce(odd, 0)::DOUBLE AS odd, (odd IS NULL)::DOUBLE AS odd_missing, round(ln(1 + n), 9) AS log_span_length, round(ln(1 + b), 9) AS log_n_breaks FROM f
"""


def fitted_probabilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calibrated probabilities of a penalised logistic fit on the labelled documents."""
    names = ["odd", "odd_missing", "log_span_length"]
    rows = encoded_features(spark, sf_dir)
    weights, platt, _ = C.fit_calibrated(rows.filter("correct is not null"), names, "correct", ["doc_id", *names, "correct"])
    return rows.select("doc_id", "correct", F.round(C.predict(names, weights, platt), 6).alias("probability"))


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    return li.select(F.round(1 - F.col("l_discount") / 2 - F.col("l_tax"), 4).alias("score"), (F.col("l_quantity") < 50 - 120 * F.col("l_tax")).alias("correct"))


SCORED_SQL = "sc AS (SELECT round(1 - l_discount / 2 - l_tax, 4) AS score, l_quantity < 50 - 120 * l_tax AS correct FROM lineitem)"


def threshold_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.threshold_counts(_scored(spark, sf_dir), "score", "correct")


THRESHOLD_COUNTS = f"""
WITH {SCORED_SQL}, g AS (SELECT i AS seq, round(0.99 - 0.01 * i, 2)::DOUBLE AS t FROM range(0, 99) r(i))
SELECT seq::INT AS seq, t, count(score) AS m, count(score) FILTER (NOT correct) AS k FROM g LEFT JOIN sc ON score >= t GROUP BY seq, t
"""


def binomial_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.with_upper_bound(C.with_p_value(threshold_counts(spark, sf_dir), "k", "m", 0.1), "k", "m", C.DELTA).withColumns({c: F.round(c, 6) for c in ("p_value", "upper")})


#: the binomial sum from logarithms; the bound is halved 40 times, which tells six digits
BINOMIAL_BOUNDS = f"""
WITH RECURSIVE {SCORED_SQL}, c AS (SELECT seq::INT AS seq, t, count(score) AS m, count(score) FILTER (NOT correct) AS k FROM (SELECT i AS seq, round(0.99 - 0.01 * i, 2)::DOUBLE AS t FROM range(0, 99) r(i)) LEFT JOIN sc ON score >= t GROUP BY seq, t),
d AS (SELECT DISTINCT m, k, list_transform(range(0, k + 1), lambda i: lgamma(m + 1) - lgamma(i + 1) - lgamma(m - i + 1)) AS ways FROM c WHERE k < m),
b AS (SELECT m, k, ways, 0 AS i, 0.0::DOUBLE AS lo, 1.0::DOUBLE AS hi FROM d
  UNION ALL SELECT m, k, ways, i + 1, CASE WHEN s > 0.1 THEN mid ELSE lo END, CASE WHEN s > 0.1 THEN hi ELSE mid END
  FROM (SELECT *, (lo + hi) / 2 AS mid, list_sum(list_transform(ways, lambda x, j: exp(x + (j - 1) * ln((lo + hi) / 2) + (m - j + 1) * ln(1 - (lo + hi) / 2)))) AS s FROM b WHERE i < 40)),
u AS (SELECT m, k, (lo + hi) / 2 AS upper, list_sum(list_transform(ways, lambda x, j: exp(x + (j - 1) * ln(0.1::DOUBLE) + (m - j + 1) * ln(0.9::DOUBLE)))) AS p FROM b WHERE i = 40)
SELECT c.seq, c.t, c.m, c.k, round(coalesce(least(p, 1), 1), 6) AS p_value, round(coalesce(upper, 1), 6) AS upper FROM c LEFT JOIN u ON c.m = u.m AND c.k = u.k
"""


def calibrated_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.calibrate(_scored(spark, sf_dir), "score", "correct", alpha=0.15)


CALIBRATED_THRESHOLD = f"""
WITH {SCORED_SQL}, c AS (SELECT seq::INT AS seq, t, count(score) AS m, count(score) FILTER (NOT correct) AS k FROM (SELECT i AS seq, round(0.99 - 0.01 * i, 2)::DOUBLE AS t FROM range(0, 99) r(i)) LEFT JOIN sc ON score >= t GROUP BY seq, t),
p AS (SELECT *, CASE WHEN m > 0 AND k < m THEN list_sum(list_transform(range(0, k + 1), lambda i: exp(lgamma(m + 1) - lgamma(i + 1) - lgamma(m - i + 1) + i * ln(0.15::DOUBLE) + (m - i) * ln(0.85::DOUBLE)))) ELSE 1 END AS v FROM c),
r AS (SELECT *, min((v <= 0.1 AND m > 0)::INT) OVER (ORDER BY seq) = 1 AS ok FROM p), best AS (SELECT t, m, k FROM r WHERE ok ORDER BY m DESC, seq LIMIT 1), n AS (SELECT count(*) AS n FROM sc)
SELECT n, CASE WHEN n >= 47 THEN t END AS threshold, CASE WHEN n >= 47 THEN m END AS m, CASE WHEN n >= 47 THEN k END AS k, m IS NOT NULL AND n >= 47 AS emitted FROM n LEFT JOIN best ON true
"""


def tested_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The order in which thresholds should be tested on 40 rows, by the scores of all lines."""
    order = C.plan_sequence(_scored(spark, sf_dir), "score", "correct", n_calibration=40, alpha=0.2)
    return spark.createDataFrame(list(enumerate(order, 1)), "place int, t double")


#: chances from logarithms, to 12 digits, so that equal ones are equal; most is the largest number of errors that still certifies
TESTED_ORDER = f"""
WITH {SCORED_SQL}, c AS (SELECT t, count(score) AS m, count(score) FILTER (NOT correct) AS k FROM (SELECT round(0.99 - 0.01 * i, 2)::DOUBLE AS t FROM range(0, 99) r(i)) JOIN sc ON score >= t GROUP BY t),
e AS (SELECT *, (k + 0.5) / (m + 1) AS risk, greatest(1, round_even(40.0 * m / (SELECT count(*) FROM sc), 0))::BIGINT AS n FROM c),
x AS (SELECT *, list_transform(range(0, n + 1), lambda i: lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1)) AS ways FROM e),
y AS (SELECT *, list_max(list_filter(range(0, n + 1), lambda q: list_sum(list_transform(ways[1:q + 1], lambda v, i: exp(v + (i - 1) * ln(0.2::DOUBLE) + (n - i + 1) * ln(0.8::DOUBLE)))) <= 0.1)) AS most FROM x),
z AS (SELECT *, coalesce(list_sum(list_transform(ways[1:most + 1], lambda v, i: exp(v + (i - 1) * ln(risk) + (n - i + 1) * ln(1 - risk)))), 0) AS p FROM y)
SELECT row_number() OVER (ORDER BY round(p, 10) DESC, m DESC, t)::INT AS place, t FROM z
"""


def gated_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    bound = spark.createDataFrame([(0.9, True)], "threshold double, emitted boolean")
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_custkey") % 7 > 0, F.col("o_orderstatus")).alias("value"), F.when(F.col("o_orderstatus") == "P", "BLOCK").otherwise("REVIEW").alias("decision"), F.lit(0.0).alias("confidence"), (F.col("o_custkey") % 100 / 100).alias("probability"))
    return C.gate(o, bound).select("o_orderkey", "decision", "confidence")


GATED_FIELDS = """
SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 'BLOCK' WHEN o_custkey % 7 > 0 AND o_orderstatus IS NOT NULL AND (o_custkey % 100) / 100.0::DOUBLE >= 0.9 THEN 'AUTO_ACCEPT' ELSE 'REVIEW' END AS decision, CASE WHEN o_orderstatus = 'P' THEN 0.0 ELSE (o_custkey % 100) / 100.0::DOUBLE END::DOUBLE AS confidence FROM orders
"""


def hashed_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").select("n_nationkey", content_hash(F.col("n_nationkey"), F.col("n_name")).alias("hash"))


HASHED_ROWS = """SELECT n_nationkey, sha256('{"n_nationkey":' || n_nationkey || ',"n_name":"' || n_name || '"}') AS hash FROM nation"""

QUERIES = {"encoded_features": encoded_features, "fitted_probabilities": fitted_probabilities, "threshold_counts": threshold_counts, "binomial_bounds": binomial_bounds, "calibrated_threshold": calibrated_threshold, "tested_order": tested_order, "gated_fields": gated_fields, "hashed_rows": hashed_rows}
SQL = {"encoded_features": ENCODED_FEATURES, "threshold_counts": THRESHOLD_COUNTS, "binomial_bounds": BINOMIAL_BOUNDS, "calibrated_threshold": CALIBRATED_THRESHOLD, "tested_order": TESTED_ORDER, "gated_fields": GATED_FIELDS, "hashed_rows": HASHED_ROWS}
