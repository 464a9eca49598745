"""Candidates of several methods: grounding, vote, triage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import fold_typography, jaccard, norm, tokens

#: words of the anchor by which a quote finds the documents that may hold it
ANCHOR_WORDS = 3
#: letters by which a short quote finds words
GRAM = 3
#: runs of quotes that are sent to all tasks as a list
FEW_ANCHORS = 2000


def resolve_quotes(docs: DataFrame, quotes: DataFrame) -> DataFrame:
    """(doc_id, quote_id, verify_pass, start) of every quote that a document holds: exact, else after folding typography and white space.

    start is 0-based, in the text or in the folded text. A document that holds a quote also holds its inner words as whole words, so both
    meet in an equi-join on the hash of a run of inner words; the whole quote is then looked up. Up to FEW_ANCHORS runs of quotes leave only theirs
    of each text before anything is shuffled, and the texts that have one go on with it. Shorter quotes, where there are some, find their documents by _short_quotes. docs: doc_id, text; quotes: quote_id, quote. Blank quotes match nothing.
    """
    both = quotes.filter(F.trim(F.coalesce("quote", F.lit(""))) != "").select("quote_id", "quote", fold_typography(F.col("quote")).alias("_fold"))
    both = both.withColumn("_words", F.split(F.trim("_fold"), " "))
    anchor = F.xxhash64(*(F.element_at("_words", k) for k in range(2, 2 + ANCHOR_WORDS)))
    long_ = both.filter(F.size("_words") >= ANCHOR_WORDS + 2).withColumn("_anchor", anchor).drop("_words")
    short = both.filter(F.size("_words") < ANCHOR_WORDS + 2).withColumn("_piece", F.array_max(F.transform("_words", lambda w: F.struct(F.char_length(w).alias("n"), w.alias("w"))))["w"]).drop("_words")
    texts = docs.select("doc_id", "text", fold_typography(F.coalesce("text", F.lit(""))).alias("_folded"))
    runs = F.transform("_w", lambda w, i: F.xxhash64(w, *(F.get("_w", i + k) for k in range(1, ANCHOR_WORDS))))
    anchors = [r["_anchor"] for r in long_.select("_anchor").distinct().limit(FEW_ANCHORS + 1).collect()]
    words = F.split(F.trim(F.col("_folded")), " ").alias("_w")
    if len(anchors) > FEW_ANCHORS:
        near = texts.select("doc_id", words).select("doc_id", F.explode(F.array_distinct(runs)).alias("_anchor")).join(long_.select("quote_id", "_anchor"), "_anchor").select("doc_id", "quote_id").distinct()
        found = near.join(long_.drop("_anchor"), "quote_id").join(texts, "doc_id")
    else:  # texts with a run of a quote, which are few, keep their text beside it
        held = texts.select("doc_id", "text", "_folded", words).select("doc_id", "text", "_folded", F.explode(F.array_intersect(runs, F.array(*map(F.lit, anchors)).cast("array<bigint>"))).alias("_anchor"))
        found = held.join(long_, "_anchor").select("quote_id", "doc_id", "quote", "_fold", "text", "_folded")
    if not short.isEmpty():
        few = _short_quotes(texts, short).join(short, "quote_id").join(texts, "doc_id").filter(F.contains(F.col("_folded"), F.col("_fold")))
        found = found.unionByName(few.select(*found.columns))
    exact, folded = F.expr("instr(text, quote)"), F.expr("instr(_folded, _fold)")
    return found.select(
        "doc_id", "quote_id", F.when(exact > 0, "exact").when(folded > 0, "normalized").alias("verify_pass"), (F.when(exact > 0, exact).otherwise(folded) - 1).alias("start")
    ).filter(F.col("verify_pass").isNotNull())


def _short_quotes(texts: DataFrame, quotes: DataFrame) -> DataFrame:
    """(doc_id, quote_id) that may match: a text with a word that holds the quote's longest one, _piece, which may be cut at either end of the quote.

    Pieces meet the distinct words of all texts by their first GRAM letters, or all if they have fewer; the words found meet the texts as whole words.
    """

    def letters(n: int) -> Column:
        chars = F.split("_word", "")
        return F.transform(F.slice(chars, 1, F.size(chars) - n + 1), lambda c, i: F.concat(c, *(F.get(F.split("_word", ""), i + k) for k in range(1, n))))

    words = texts.select("doc_id", F.explode(F.array_distinct(F.split("_folded", " "))).alias("_word")).filter("_word <> ''")
    gram = F.left("_piece", F.lit(GRAM))
    pieces = quotes.select("quote_id", "_piece", gram.alias("_gram"), F.char_length(gram).alias("_n"))
    none = F.array().cast("array<string>")
    own = F.array_distinct(F.flatten(F.array(*(F.when(F.char_length("_word") >= n, letters(n)).otherwise(none) for n in range(1, GRAM + 1)))))
    known = words.select("_word").distinct().select("_word", F.explode(own).alias("_gram"))
    hits = known.join(pieces, "_gram").filter(F.contains(F.col("_word"), F.col("_piece"))).select("_word", "quote_id")
    return words.join(hits, "_word").select("doc_id", "quote_id").distinct()


def vote(candidates: DataFrame, keys: list[str]) -> DataFrame:
    """The winning value of each key.

    candidates: keys, value, method, is_model, sanity (confirmed, neutral, failed), ord. Values are equal when normalised; deterministic
    methods are one group, each model is its own. Values rank by not failed, confirmed, groups, any model, candidates, then first seen.
    Two groups agree. If the best value failed, the value is null.
    """
    rows = candidates.filter(norm(F.coalesce("value", F.lit(""))) != "")
    group = F.when(F.col("is_model"), F.col("method")).otherwise(F.lit("deterministic"))
    buckets = rows.groupBy(*keys, norm(F.col("value")).alias("_norm")).agg(
        F.countDistinct(group).alias("n_groups"), F.max("is_model").alias("any_model"), F.count("*").alias("n"), F.min_by("value", "ord").alias("value"), F.min("ord").alias("first_ord"), F.min_by("sanity", "ord").alias("sanity")
    )
    rank = F.struct((F.col("sanity") != "failed").alias("a"), (F.col("sanity") == "confirmed").alias("b"), F.col("n_groups").alias("c"), F.col("any_model").alias("d"), F.col("n").alias("e"), (-F.col("first_ord")).alias("f"))
    best = buckets.groupBy(*keys).agg(F.max_by(F.struct("value", "sanity", "n_groups", "n", "any_model"), rank).alias("_b"))
    return best.select(*keys, F.when(F.col("_b.sanity") != "failed", F.col("_b.value")).alias("value"), F.col("_b.sanity").alias("sanity"), (F.col("_b.n_groups") >= 2).alias("agree"), F.col("_b.n").alias("n"), F.col("_b.any_model").alias("any_model"))


def resolve_grounding(candidates: DataFrame, keys: list[str]) -> DataFrame:
    """First good quote per key, and whether all quotes there failed (which blocks). candidates: keys, quote, quote_ok, ord."""
    has = F.col("quote").isNotNull()
    return candidates.groupBy(*keys).agg(
        F.min_by(F.when(has & F.col("quote_ok"), F.col("quote")), F.when(has & F.col("quote_ok"), F.col("ord"))).alias("quote"),
        ((F.count_if(has) > 0) & (F.count_if(has & F.col("quote_ok")) == 0)).alias("grounding_failed"),
    )


def assure(fields: DataFrame, keys: list[str]) -> DataFrame:
    """Adds confidence and decision to rows with value, agree, sanity, n, any_model, verifier and grounding_failed. Rows without a value block."""
    shared = F.coalesce(F.col("agree"), F.lit(False)) | F.coalesce(F.col("sanity") == "confirmed", F.lit(False))
    add = F.when(F.col("verifier") == "supported", 0.15).when(F.col("verifier") == "unsupported", -0.35).otherwise(0.0)
    raw = 0.45 + 0.30 * shared.cast("double") + 0.05 * F.least(F.coalesce(F.col("n"), F.lit(0)), F.lit(3)) + add
    blocked = F.col("value").isNull() | F.coalesce(F.col("grounding_failed"), F.lit(False))
    out = fields.withColumn("confidence", F.when(blocked, 0.0).otherwise(F.bround(F.greatest(F.lit(0.0), F.least(F.lit(1.0), raw)), 6)))
    independent = F.coalesce(F.col("agree"), F.lit(False)) | (~F.coalesce(F.col("any_model"), F.lit(False)) & F.coalesce(F.col("sanity") == "confirmed", F.lit(False)))
    accept = independent & (F.col("verifier") == "supported") & (F.col("confidence") >= 0.8)
    return out.withColumn("decision", F.when(blocked, "BLOCK").when(F.col("verifier") == "unsupported", "REVIEW").when(accept, "AUTO_ACCEPT").otherwise("REVIEW"))


def pairwise_agreement(candidates: DataFrame, keys: list[str]) -> DataFrame:
    """Mean token similarity over the pairs of distinct values of a key; null with fewer than two. Keys have a handful of values, one per method."""
    values = candidates.filter(F.col("value").isNotNull()).groupBy(*keys).agg(F.array_sort(F.collect_set("value")).alias("_v"))
    sets = values.withColumn("_t", F.transform("_v", lambda v: tokens(v)))
    pairs = F.flatten(F.transform("_t", lambda a, i: F.transform(F.filter(F.col("_t"), lambda b, j: j > i), lambda b: jaccard(a, b))))
    out = sets.withColumn("_p", pairs)
    total = F.aggregate("_p", F.lit(0.0), lambda acc, x: acc + x)
    return out.select(*keys, F.size("_v").alias("n_values"), F.when(F.size("_p") > 0, total / F.size("_p")).alias("fuzzy_agreement"))
