"""Predictions against labels: verdict tallies, scoreboards, rubrics, curves."""

from __future__ import annotations

from collections import Counter, defaultdict, deque
from itertools import groupby, takewhile

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import jaccard, norm_words, score_value, tokens
from ..shared import checkpointed
from .folds import fold, running_sums
from .graphs import components, rare_tokens

CORRECT = ("exact", "normalized", "fuzzy")


def score_fields(predicted: DataFrame, labels: DataFrame, keys: list[str]) -> DataFrame:
    """A verdict for each label; labels without a prediction are absent, predictions without a label drop out. labels: keys, label, kind."""
    both = labels.join(predicted.select(*keys, "predicted"), keys, "left")
    return both.withColumn("_s", score_value(F.col("predicted"), F.col("label"), F.col("kind"))).select(*keys, "predicted", "label", "kind", "_s.verdict", "_s.similarity")


def is_correct(verdict: Column) -> Column:
    return verdict.isin(*CORRECT)


def summarize(scores: DataFrame, by: str = "domain") -> DataFrame:
    """Tallies overall (null in `by`) and by domain: n, counts, accuracy, accuracy of what was found; null where nothing was."""
    n, good, none = F.count("*"), F.count_if(is_correct(F.col("verdict"))), F.count_if(F.col("verdict") == "absent")
    return scores.rollup(by).agg(
        n.alias("n"), good.alias("correct"), none.alias("absent"), *(F.count_if(F.col("verdict") == v).alias(f"n_{v}") for v in CORRECT), (good / n).alias("accuracy"), F.when(n > none, good / (n - none)).alias("accuracy_of_found")
    )


def scoreboard(fields: DataFrame, scores: DataFrame, keys: list[str], by: str = "domain") -> DataFrame:
    """Decisions overall and by domain: counts, coverage, review burden and the realised error of accepted labelled fields."""
    rows = fields.join(scores.select(*keys, "verdict"), keys, "left")
    n, auto = F.count("*"), F.col("decision") == "AUTO_ACCEPT"
    labelled = F.count_if(auto & F.col("verdict").isNotNull())
    right = F.count_if(auto & is_correct(F.col("verdict")))
    return rows.rollup(by).agg(
        n.alias("n"), F.count_if(auto).alias("n_auto"), F.count_if(F.col("decision") == "REVIEW").alias("n_review"), F.count_if(F.col("decision") == "BLOCK").alias("n_block"),
        (F.count_if(auto) / n).alias("coverage"), (F.count_if(F.col("decision") == "REVIEW") / n).alias("burden"), F.when(labelled > 0, 1 - right / labelled).alias("realized_error"),
    )


def diff_fields(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Fields whose value or decision differs between two runs; a missing side has the decision "absent"."""
    side = lambda df, tag: df.select(*keys, F.col("value").alias(f"value_{tag}"), F.col("decision").alias(f"decision_{tag}"))
    out = side(a, "a").join(side(b, "b"), keys, "full_outer").fillna("absent", ["decision_a", "decision_b"])
    return out.filter(~(F.col("value_a").eqNullSafe(F.col("value_b")) & (F.col("decision_a") == F.col("decision_b"))))


def training_pairs(features: DataFrame, scores: DataFrame, keys: list[str]) -> DataFrame:
    """Features with their outcome, for fields that have a value and a verdict other than absent."""
    return features.filter("has_value").join(scores.filter("verdict <> 'absent'").select(*keys, is_correct(F.col("verdict")).alias("correct")), keys)


def greedy_match(pairs: DataFrame, keys: list[str], threshold: float) -> DataFrame:
    """(keys, ref, item, similarity): references in order each take the most similar item not yet taken, if it reaches the threshold.

    pairs: keys, ref, item, similarity. A choice depends on all before it, so the pairs of a key, one study's category, are walked in order.
    """

    def walk(rows: list[dict]) -> list[tuple]:
        used, kept = set(), []
        for ref, own in groupby(rows, key=lambda r: r["ref"]):
            best = min((r for r in own if r["item"] not in used), key=lambda r: (-r["similarity"], r["item"]), default=None)
            if best and best["similarity"] >= threshold:
                used.add(best["item"])
                kept.append((ref, best["item"], best["similarity"]))
        return kept

    kinds = dict(pairs.dtypes)
    return fold(pairs.select(*keys, "ref", "item", "similarity"), keys, ["ref", "item"], walk, f"ref {kinds['ref']}, item {kinds['item']}, similarity double")


def greedy_match_sets(refs: DataFrame, items: DataFrame, keys: list[str], threshold: float | Column) -> DataFrame:
    """greedy_match by the Jaccard similarity of token sets, without a table of pairs; pairs that share no token never match.

    refs: keys, ref, tokens; items: keys, item, tokens; the ids of a key differ. threshold can follow from the keys. Items with equal sets wait in one queue, and each distinct set of a
    reference is compared once with the distinct sets that share a token with it, so the work grows with the rows and the distinct sets.

    A choice depends on all earlier ones that compete with it, but on no others: sets that can be alike share one of their rarest tokens, and what
    these tokens do not tie together, over any number of sets, never competes. So a key is cut into such components, which are walked side by side.
    """

    def walk(rows: list[dict]) -> list[tuple]:
        queues: dict[frozenset, deque] = defaultdict(deque)
        holders, ways, kept = defaultdict(list), {}, []
        for r in rows:
            r["_tokens"] = frozenset(r["_tokens"])
            if r["_side"]:
                queues[r["_tokens"]].append(r["_id"])
        for own in queues:
            for token in own:
                holders[token].append(own)
        for r in rows:
            own = r["_tokens"]
            if r["_side"]:
                continue
            if own not in ways:
                shared = Counter(other for token in own for other in holders.get(token, ()))
                scores = ((n / (len(own) + len(other) - n), other) for other, n in shared.items())
                ways[own] = sorted((x for x in scores if x[0] >= r["_least"]), key=lambda x: -x[0])
            ways[own] = [x for x in ways[own] if queues[x[1]]]
            if ways[own]:
                top = ways[own][0][0]
                best = min((queues[other] for _, other in takewhile(lambda x: x[0] == top, ways[own])), key=lambda q: q[0])  # noqa: B023
                kept.append((r["_id"], best.popleft(), top))
        return kept

    least = threshold if isinstance(threshold, Column) else F.lit(threshold)
    side = lambda df, name, tag: df.select(*keys, F.lit(tag).alias("_side"), F.col(name).alias("_id"), F.col("tokens").alias("_tokens"), least.cast("double").alias("_least"))
    both = side(refs, "ref", 0).unionByName(side(items, "item", 1)).withColumn("_tokens", F.array_sort(F.array_distinct(F.coalesce("_tokens", F.array().cast("array<string>"))))).transform(checkpointed)
    ties = rare_tokens(both.withColumnRenamed("_tokens", "tokens"), [*keys, "_least"], F.col("_least")).withColumnRenamed("tokens", "_tokens")
    node = F.xxhash64(*keys, "_tokens")
    tied = components(ties.select(node.alias("a"), F.xxhash64(*keys, "token", F.lit("token")).alias("b")))
    rows = both.withColumn("node", node).join(tied, "node").withColumnRenamed("component", "_component").drop("node")
    return fold(rows, [*keys, "_component"], ["_side", "_id"], walk, f"ref {dict(refs.dtypes)['ref']}, item {dict(items.dtypes)['item']}, similarity double").drop("_component")


# The similarity that a match of each category of a study takes.
CATEGORY_THRESHOLDS = {"identifiers": 1.0, "arms": 0.3, "interventions": 0.3, "criteria": 0.5, "objectives": 0.4, "endpoints": 0.5, "estimands": 0.3, "epochs": 0.5, "encounters": 0.5, "activities": 0.6, "vendors": 0.5, "marks": 0.6}


def scalar_equal(field: Column, got: Column, want: Column) -> Column:
    """Whether a study's value of a field is the one of its reference, by what the field means.

    Titles agree in 0.8 of their words, sponsors in half, or one names the other; identifiers up to case; phases by their numbers, Roman ones
    included; versions by their first number; types and models share a word other than "study" and "trial"; anything else as lower-case words.
    """
    low = lambda c: F.lower(F.coalesce(c, F.lit("")))
    words, text = lambda c: tokens(F.coalesce(c, F.lit(""))), lambda c: norm_words(F.coalesce(c, F.lit("")))
    alike = jaccard(words(got), words(want))

    def numbers(c: Column) -> Column:
        digits = F.regexp_extract_all(low(c), F.lit("([1-4])"), F.lit(1))
        roman = F.regexp_extract_all(low(c), F.lit(r"\b(iii|ii|iv|i)\b"), F.lit(1))
        return F.when(F.size(digits) > 0, digits).otherwise(F.transform(roman, lambda x: F.when(x == "iv", "4").otherwise(F.char_length(x).cast("string"))))

    first = lambda c: F.regexp_extract(low(c), "([0-9]+)", 1).try_cast("long")
    named = F.array_except(words(want), F.array(F.lit("study"), F.lit("trial")))
    return (
        F.when(field == "title", alike >= 0.8)
        .when(field == "sponsor", (alike >= 0.5) | F.contains(text(got), text(want)))
        .when(field == "protocol_id", F.trim(low(got)) == F.trim(low(want)))
        .when(field == "phase", (F.size(numbers(got)) > 0) & (numbers(got) == numbers(want)))
        .when(field == "version", F.coalesce(first(got) == first(want), F.lit(False)))
        .when(field.isin("study_type", "model"), F.arrays_overlap(words(got), named))
        .otherwise(text(got) == text(want))
    )


def scalar_counts(delivered: DataFrame, reference: DataFrame, by: str = "study") -> DataFrame:
    """Rows for rubric: category "scalars" of (by, field, value) tables. Only fields of the reference count; blank values are not delivered."""
    full = lambda df, name: df.filter(F.coalesce("value", F.lit("")) != "").select(by, "field", F.col("value").alias(name))
    both = full(reference, "_want").join(full(delivered, "_got"), [by, "field"], "left")
    hit = F.col("_got").isNotNull() & scalar_equal(F.col("field"), F.col("_got"), F.col("_want"))
    return both.groupBy(by).agg(F.count("*").alias("n_reference"), F.count("_got").alias("n_delivered"), F.count_if(hit).alias("n_matched")).withColumn("category", F.lit("scalars"))


def category_counts(delivered: DataFrame, reference: DataFrame, by: str = "study", thresholds: dict[str, float] | None = None) -> DataFrame:
    """Rows for rubric: the categories of (by, category, ord, text) tables, matched greedily at each category's threshold; identifiers as equal words. Marks are matched by their two texts, joined by a line break: both have to be alike."""
    thresholds = thresholds or CATEGORY_THRESHOLDS
    keys, out = [by, "category"], None
    have = reference.groupBy(*keys).agg(F.count("*").alias("n_reference")).join(delivered.groupBy(*keys).agg(F.count("*").alias("n_delivered")), keys, "left")
    words = F.when(F.col("category") == "identifiers", F.array(norm_words(F.col("text")))).otherwise(tokens(F.col("text")))
    side = lambda df, tag: df.select(*keys, F.col("ord").alias(tag), words.alias("tokens"), F.col("text").alias("_text"))
    refs, items = side(reference, "ref"), side(delivered, "item")
    plain = [c for c in thresholds if c != "marks"]
    if plain:
        least = F.element_at(F.create_map(*(F.lit(x) for c in plain for x in (c, thresholds[c]))), F.col("category"))
        known = F.col("category").isin(*plain)
        out = greedy_match_sets(refs.filter(known).drop("_text"), items.filter(known).drop("_text"), keys, least).select(*keys)
    if "marks" in thresholds:
        mark = F.col("category") == "marks"
        marks = greedy_match_marks(refs.filter(mark), items.filter(mark), keys, thresholds["marks"]).select(*keys)
        out = marks if out is None else out.unionByName(marks)
    hits = out.groupBy(*keys).agg(F.count("*").alias("n_matched"))
    return have.filter(F.col("category").isin(*thresholds)).join(hits, keys, "left").select(*keys, "n_reference", F.coalesce("n_delivered", F.lit(0)).alias("n_delivered"), F.coalesce("n_matched", F.lit(0)).alias("n_matched"))


def mark_pairs(refs: DataFrame, items: DataFrame, keys: list[str], threshold: float | None = None) -> DataFrame:
    """(keys, ref, item, similarity) of marks (visit, line break, activity) that share a word of the visit and one of the activity: the smaller similarity of the two. With a threshold only pairs that reach it, which meet by the rarest words of their visits."""
    part = lambda k: tokens(F.get(F.split("_text", "\n"), F.lit(k)))
    side = lambda df, name, tag: df.select(*keys, name, part(0).alias(f"_v{tag}"), part(1).alias(f"_a{tag}"))
    a, b = side(refs, "ref", 1), side(items, "item", 2)
    if threshold is None:
        a, b = a.withColumn("_w", F.explode("_v1")), b.withColumn("_w", F.explode("_v2"))
    else:
        a, b = a.withColumn("_v1", F.array_sort("_v1")), b.withColumn("_v2", F.array_sort("_v2"))
        rare = rare_tokens(a.select(*keys, F.col("_v1").alias("tokens")).union(b.select(*keys, "_v2")), keys, threshold).withColumnRenamed("token", "_w")
        a, b = (df.join(rare.withColumnRenamed("tokens", v), [*keys, v]) for df, v in ((a, "_v1"), (b, "_v2")))
    met = a.join(b, [*keys, "_w"]).filter(F.arrays_overlap("_a1", "_a2")).select(*keys, "ref", "item", F.least(jaccard(F.col("_v1"), F.col("_v2")), jaccard(F.col("_a1"), F.col("_a2"))).alias("similarity"))
    return met.distinct() if threshold is None else met.filter(F.col("similarity") >= threshold).distinct()


def greedy_match_marks(refs: DataFrame, items: DataFrame, keys: list[str], threshold: float) -> DataFrame:
    """greedy_match(mark_pairs(refs, items, keys), keys, threshold) without a table of all pairs: marks with equal words are compared once and wait in one queue, and a key is
    cut into what similar marks tie together, as in greedy_match_sets. Its work grows with the rows and with the pairs of different marks that are alike."""

    def walk(rows: list[dict]) -> list[tuple]:
        queues: dict[object, deque] = defaultdict(deque)
        ways, kept = {}, []
        for r in rows:
            if r["_side"]:
                queues[r["_set"]].append(r["_id"])
        for r in rows:
            if r["_side"]:
                continue
            own = r["_set"]
            if own not in ways:  # the first of its set has the similar ones, best first
                ways[own] = [(w["similarity"], w["item"]) for w in r["_ways"]]
            ways[own] = [x for x in ways[own] if queues[x[1]]]
            if ways[own]:
                top = ways[own][0][0]
                best = min((queues[other] for _, other in takewhile(lambda x: x[0] == top, ways[own])), key=lambda q: q[0])  # noqa: B023
                kept.append((r["_id"], best.popleft(), top))
        return kept

    pair = F.array(*(F.array_sort(tokens(F.get(F.split("_text", "\n"), F.lit(k)))) for k in (0, 1)))
    alike = lambda df, name: checkpointed(df.select(*keys, name, pair.alias("_pair"), "_text").withColumn("_set", F.min(name).over(Window.partitionBy(*keys, "_pair"))))
    own, other = alike(refs, "ref"), alike(items, "item")
    pairs = checkpointed(mark_pairs(own.filter("ref = _set"), other.filter("item = _set"), keys, threshold))
    node = lambda name, side: F.xxhash64(*keys, name, F.lit(side))
    tied = components(pairs.select(node("ref", "ref").alias("a"), node("item", "item").alias("b"))).withColumnRenamed("component", "_component")
    best = F.reverse(F.array_sort(F.collect_list(F.struct("similarity", "item"))))
    ways = pairs.groupBy(*keys, F.col("ref").alias("_id")).agg(best.alias("_ways"))
    a = own.select(*keys, F.lit(0).alias("_side"), F.col("ref").alias("_id"), "_set", node("_set", "ref").alias("node")).join(ways, [*keys, "_id"], "left")
    b = other.select(*keys, F.lit(1).alias("_side"), F.col("item").alias("_id"), "_set", node("_set", "item").alias("node"))
    rows = a.unionByName(b, allowMissingColumns=True).join(tied, "node").drop("node")
    return fold(rows, [*keys, "_component"], ["_side", "_id"], walk, f"ref {dict(refs.dtypes)['ref']}, item {dict(items.dtypes)['item']}, similarity double").drop("_component")


def rubric(counts: DataFrame, by: str = "study") -> DataFrame:
    """accuracy = matched / (reference + spurious), recall = matched / reference, overall and by study; 1 over nothing. counts: by, category, n_reference, n_delivered, n_matched. Categories without a reference are not scored."""
    rows = counts.filter("n_reference > 0")
    ref, hit, extra = F.sum("n_reference"), F.sum("n_matched"), F.sum(F.greatest(F.col("n_delivered") - F.col("n_matched"), F.lit(0)))
    return rows.rollup(by).agg(ref.alias("n_reference"), hit.alias("n_matched"), extra.alias("n_spurious"), F.when(ref + extra > 0, hit / (ref + extra)).otherwise(1.0).alias("accuracy"), F.when(ref > 0, hit / ref).otherwise(1.0).alias("recall"))


def risk_coverage(rows: DataFrame, by: list[str], score: str, correct: str, order: str) -> DataFrame:
    """A point per distinct score, best first: how many rows reach it, and their error rate."""
    steps = rows.groupBy(*by, score).agg(F.count("*").alias("_n"), F.count_if(~F.col(correct)).alias("_bad"))
    w = Window.partitionBy(*by).orderBy(F.desc(score)).rowsBetween(Window.unboundedPreceding, 0)
    return steps.select(*by, score, F.sum("_n").over(w).alias("n_covered"), (F.sum("_bad").over(w) / F.sum("_n").over(w)).alias("risk"))


def aurc(rows: DataFrame, by: list[str], score: str, correct: str, order: str) -> DataFrame:
    """Mean over all prefixes, best first, of their error rate. Groups of any size: the prefixes are running sums over sorted partitions."""
    sums = running_sums(rows, by, [F.desc(score), F.asc(order)], {"_n": F.lit(1), "_bad": (~F.col(correct)).cast("int")})
    return sums.groupBy(*by).agg(F.avg(F.col("_bad") / F.col("_n")).alias("aurc"))


def brier(rows: DataFrame, by: list[str], probability: str, correct: str) -> DataFrame:
    return rows.groupBy(*by).agg(F.avg(F.pow(F.col(probability) - F.col(correct).cast("double"), 2)).alias("brier"))
