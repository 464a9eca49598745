"""Thin queries opN_<name> over the operators, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .embedding_dedup import near_vectors
from .exact_dedup import ascii_lower, duplicate_groups
from .lm_scoring import score_documents
from .ngram_jaccard import jaccard_components
from .packing import pack_documents
from .pii import personal_spans
from .quality_rules import BREAK, GRID, PRIOR, REACH, judged
from .sentencepiece_codec import round_trip
from .source_divergence import divergence
from .spelling_variants import spelling_groups
from .substring_dedup import drop_repeats
from .token_binary import token_shards
from .tokens import public_tokenizer
from .warc import through_archives


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(_table(spark, sf_dir, "documents"), public_tokenizer("piece_bpe_32k.model"))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drop_repeats(_table(spark, sf_dir, "documents"), span=13)


OP2_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
w AS (SELECT r, doc_id, unnest(range(1, len(ws) - 11)) AS i, unnest(list_transform(range(1, len(ws) - 11), lambda i: array_to_string(ws[i:i + 12], ' '))) AS g FROM d WHERE len(ws) >= 13),
x AS (SELECT r, i FROM (SELECT r, i, doc_id, min(doc_id) OVER (PARTITION BY g) AS least FROM w) WHERE least < doc_id),
c AS (SELECT DISTINCT r, i + k AS i FROM x, (SELECT unnest(range(0, 13)) AS k)),
n AS (SELECT r, list(i) AS gone FROM c GROUP BY r)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(len(gone), 0)::BIGINT AS n_removed,
  sha256(coalesce(array_to_string(CASE WHEN gone IS NULL THEN ws ELSE list_filter(ws, lambda w, i: NOT list_contains(gone, i)) END, ' '), '')) AS kept_sha256
FROM d LEFT JOIN n ON d.r = n.r
"""


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return through_archives(_table(spark, sf_dir, "pages"), least_bytes=0).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP3_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS t, max(page_id) OVER (PARTITION BY coalesce(html, '')) AS keep FROM pages),
h AS (SELECT *, list_transform(range(0, 8), lambda g: ('0x' || substr(sha1(t), 5 * g + 1, 5))::BIGINT) AS bits FROM p)
SELECT page_id, octet_length(encode(t))::BIGINT AS payload_bytes,
  array_to_string(list_transform(bits, lambda v: array_to_string(list_transform([15, 10, 5, 0], lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((v >> k) & 31)::INTEGER + 1, 1)), '')), '') AS payload_digest,
  CASE WHEN page_id = keep THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> keep THEN keep END AS refers_to
FROM h
"""


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return duplicate_groups(_table(spark, sf_dir, "documents"), ascii_lower, keep="max")


OP4_SQL = """
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents)
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = max(doc_id) OVER g AS kept, sha256(t) AS text_sha256
FROM d WINDOW g AS (PARTITION BY t)
"""


def op5_token_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_shards(_table(spark, sf_dir, "documents"), public_tokenizer("word_bpe_49k.json"), end_id=2)


def op6_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(_table(spark, sf_dir, "documents"), n=3, percent=90)


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(_table(spark, sf_dir, "documents"), public_tokenizer("byte_bpe_50k.json"), end_id=0, size=2048)


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(_table(spark, sf_dir, "documents"))


#: The sketches are exact below about half of ACCURACY rows in a group, where this takes the ordered values themselves.
OP8_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, lang, source, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS ws, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS ls FROM d),
tri AS (SELECT r, unnest(range(1, len(ws) - 1)) AS i, unnest(list_transform(range(1, len(ws) - 1), lambda i: ws[i] || chr(10) || ws[i + 1] || chr(10) || ws[i + 2])) AS g FROM w WHERE len(ws) > 2),
dup AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS c FROM tri) WHERE c > 1),
cov AS (SELECT r, count(DISTINCT i + k) AS n FROM dup, (VALUES (0), (1), (2)) AS o(k) GROUP BY r),
b AS (SELECT w.r, doc_id, lang, source, len(ws)::BIGINT AS n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars,
  (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols, len(ls)::BIGINT AS n_lines,
  (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(cov.n, 0)::BIGINT AS n_repeat_words FROM w LEFT JOIN cov ON w.r = cov.r),
m AS (SELECT *, 1000 * n_symbols // greatest(word_chars, 1) AS v1, 100 * word_chars // greatest(n_words, 1) AS v2, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM b),
u AS (SELECT 0 AS level, lang, source, v1, v2 FROM m WHERE NOT base_failed UNION ALL SELECT 1, lang, NULL, v1, v2 FROM m WHERE NOT base_failed UNION ALL SELECT 2, NULL, NULL, v1, v2 FROM m WHERE NOT base_failed),
o AS (SELECT level, lang, source, list(v1 ORDER BY v1) AS s, list(v2 ORDER BY v2) AS w, count(*) AS n FROM u GROUP BY level, lang, source),
q AS (SELECT *, list_transform({GRID}, lambda p: s[ceil(p * n)::BIGINT]) AS g FROM o),
x AS (SELECT *, list_transform(range(1, len(g)), lambda i: (g[i + 1] + 1)::DOUBLE / (g[i] + 1)) AS r FROM q),
k AS (
  SELECT level, lang, source, n, w[ceil(0.25 * n)::BIGINT]::DOUBLE AS w0, w[ceil(0.5 * n)::BIGINT]::DOUBLE AS w1, w[ceil(0.75 * n)::BIGINT]::DOUBLE AS w2,
    CASE WHEN list_max(r) >= {BREAK} THEN sqrt((g[list_position(r, list_max(r))] + 1.0::DOUBLE) * (g[list_position(r, list_max(r)) + 1] + 1.0::DOUBLE)) - 1 END AS b FROM x),
l AS (
  SELECT l.lang, l.n, (l.n * l.w0 + {PRIOR}::DOUBLE * a.w0) / (l.n + {PRIOR}::DOUBLE) AS w0, (l.n * l.w1 + {PRIOR}::DOUBLE * a.w1) / (l.n + {PRIOR}::DOUBLE) AS w1,
    (l.n * l.w2 + {PRIOR}::DOUBLE * a.w2) / (l.n + {PRIOR}::DOUBLE) AS w2, coalesce((l.n * l.b + {PRIOR}::DOUBLE * a.b) / (l.n + {PRIOR}::DOUBLE), l.b, a.b) AS b FROM k l JOIN k a ON l.level = 1 AND a.level = 2),
e AS (
  SELECT s.lang, s.source, s.w1 AS own, (s.n * s.w0 + {PRIOR}::DOUBLE * l.w0) / (s.n + {PRIOR}::DOUBLE) AS w0, (s.n * s.w1 + {PRIOR}::DOUBLE * l.w1) / (s.n + {PRIOR}::DOUBLE) AS w1,
    (s.n * s.w2 + {PRIOR}::DOUBLE * l.w2) / (s.n + {PRIOR}::DOUBLE) AS w2, coalesce((s.n * s.b + {PRIOR}::DOUBLE * l.b) / (s.n + {PRIOR}::DOUBLE), s.b, l.b) AS b FROM k s JOIN l ON s.level = 0 AND s.lang IS NOT DISTINCT FROM l.lang)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND coalesce(coalesce(v1 <= b, true) AND v2 BETWEEN w1 - ({REACH} * least(w1 - w0, w2 - w1) + abs(own - w1)) AND w1 + ({REACH} * least(w1 - w0, w2 - w1) + abs(own - w1)), false) AS kept
FROM m LEFT JOIN e ON m.lang IS NOT DISTINCT FROM e.lang AND m.source IS NOT DISTINCT FROM e.source
"""


def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(_table(spark, sf_dir, "documents"))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_spans(_table(spark, sf_dir, "documents"))


def op11_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(_table(spark, sf_dir, "embeddings"), cosine=0.98)


OP11_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
  WHERE label IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.98),
r AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT a, min(b) AS least FROM r GROUP BY a),
n AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, least(vec_id, least) AS component_id, vec_id = least(vec_id, least) AS kept
FROM embeddings LEFT JOIN c ON vec_id = c.a LEFT JOIN n ON vec_id = n.a
"""


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_groups(_table(spark, sf_dir, "documents"), least_points=7, least_n=2, factor=10, noise=31)


#: crc32 goes byte by byte over its table of 256 numbers; near words are those that lose one code point to the same rest, at the same place or at one end only.
OP12_SQL = r"""
WITH RECURSIVE bit AS (SELECT i, i AS c, 0 AS k FROM range(256) t(i) UNION ALL SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM bit WHERE k < 8),
t AS (SELECT list(c ORDER BY i) AS tab FROM bit WHERE k = 8),
r AS (SELECT doc_id, unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z\x{00C0}-\x{00FF}]+')) AS w FROM documents),
g AS (SELECT doc_id, translate(w, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS w, count(*) AS n FROM r WHERE length(w) >= 7 GROUP BY ALL),
x AS (SELECT doc_id, w, n, hex(encode(coalesce(doc_id::VARCHAR, '') || ':' || w)) AS b FROM g),
h AS (
  SELECT w, n, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length(b), 2), lambda i: ('0x' || substr(b, i::INTEGER, 2))::BIGINT)), lambda c, y: xor(c >> 8, tab[(xor(c, y) & 255) + 1])), 4294967295) AS h FROM x, t),
m AS (SELECT CASE WHEN h % 31 = 0 THEN substr(w, 1, (h % length(w))::INTEGER) || substr(w, (h % length(w))::INTEGER + 2) ELSE w END AS word, n FROM h),
v AS (SELECT word, sum(n)::BIGINT AS n FROM m WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2),
d AS (SELECT DISTINCT word, n, p, substr(word, 1, p::INTEGER) || substr(word, p::INTEGER + 2) AS rest FROM (SELECT word, n, unnest(range(0, length(word))) AS p FROM v)),
e AS (
  SELECT a.word, b.word AS other, b.n FROM d a JOIN d b ON a.rest = b.rest AND a.p = b.p AND a.word <> b.word
  UNION SELECT d.word, v.word, v.n FROM d JOIN v ON d.rest = v.word UNION SELECT v.word, d.word, d.n FROM d JOIN v ON d.rest = v.word),
s AS (SELECT word, count(*) AS n_near, min({'n': -n, 'w': other}) AS best FROM e GROUP BY word),
f AS (SELECT v.word, v.n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN -best.n >= 10 * v.n THEN best.w END AS form, CASE WHEN -best.n >= 10 * v.n THEN -best.n END::BIGINT AS form_n FROM v LEFT JOIN s ON v.word = s.word),
o AS (SELECT word, word AS root, form AS up FROM f UNION ALL SELECT o.word, f.word, f.form FROM o JOIN f ON o.up = f.word)
SELECT f.*, root FROM f JOIN o ON f.word = o.word AND o.up IS NULL
"""


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence(_table(spark, sf_dir, "documents"), least_docs=30, top=50)


OP13_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
w AS (SELECT r, lang, source, unnest(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
k AS (SELECT lang, term FROM w GROUP BY lang, term HAVING count(DISTINCT r) >= 30),
v AS (SELECT lang, count(*) AS v FROM k GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, count(*) AS n FROM w JOIN k USING (lang, term) GROUP BY ALL),
z AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n FROM g JOIN k ON g.lang = k.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
p AS (SELECT *, 1 + (1000000000 * (n + 5)::HUGEINT) // (sum(n) OVER (PARTITION BY lang, source) + 5 * v)::HUGEINT AS p FROM z JOIN v USING (lang)),
q AS (SELECT lang, term, 1 + (1000000000 * (sum(n) + 5)::HUGEINT) // (sum(sum(n)) OVER (PARTITION BY lang) + 5 * v)::HUGEINT AS q FROM p GROUP BY lang, term, v),
f AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
o AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
  UNION ALL SELECT lang, source, 'term', term, p - q FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank
FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item)) AS rank FROM o) WHERE part = 'pair' OR rank <= 50
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_sentencepiece": op1_sentencepiece,
        "op2_substring_dedup": op2_substring_dedup,
        "op3_warc": op3_warc,
        "op4_exact_dedup": op4_exact_dedup,
        "op5_token_binary": op5_token_binary,
        "op6_ngram_jaccard": op6_ngram_jaccard,
        "op7_best_fit_packing": op7_best_fit_packing,
        "op8_quality_rules": op8_quality_rules,
        "op9_lm_scoring": op9_lm_scoring,
        "op10_pii": op10_pii,
        "op11_embedding_dedup": op11_embedding_dedup,
        "op12_spelling_variants": op12_spelling_variants,
        "op13_source_divergence": op13_source_divergence,
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_substring_dedup": OP2_SQL, "op3_warc": OP3_SQL, "op4_exact_dedup": OP4_SQL, "op8_quality_rules": OP8_SQL, "op11_embedding_dedup": OP11_SQL, "op12_spelling_variants": OP12_SQL, "op13_source_divergence": OP13_SQL}
