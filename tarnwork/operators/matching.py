"""Versions, estimands and links between texts."""

from __future__ import annotations

import difflib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import jaccard, norm_words, tokens
from ..shared import checkpointed
from .folds import fold
from .graphs import rare_tokens


def title_key(title: Column) -> Column:
    """A title without its number, as lower-case words."""
    return norm_words(F.regexp_replace(title, r"^\s*[0-9]+(\.[0-9]+)*\.?\s*", ""))


def diff_versions(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Sections of two versions by normalised title; repeated titles pair in order. kind: unchanged, modified, added, removed."""
    w = Window.partitionBy(*keys, "_key").orderBy("ord")
    side = lambda df, tag: df.withColumn("_key", title_key(F.col("title"))).withColumn("_nth", F.row_number().over(w)).select(*keys, "_key", "_nth", *(F.col(c).alias(f"{c}_{tag}") for c in ("ord", "title", "text")))
    both = side(old, "old").join(side(new, "new"), [*keys, "_key", "_nth"], "full_outer")
    kind = F.when(F.col("ord_old").isNull(), "added").when(F.col("ord_new").isNull(), "removed").when(F.col("text_old").eqNullSafe(F.col("text_new")), "unchanged").otherwise("modified")
    return both.select(*keys, "ord_old", "ord_new", F.coalesce("title_new", "title_old").alias("title"), kind.alias("kind"), "text_old", "text_new")


def word_changes(pairs: DataFrame) -> DataFrame:
    """Adds similarity (longest-common-block ratio over lower-case words, 4 digits) and changes (up to three changed spans, with 4 words around).

    Equal texts need no comparison and never reach Python.
    """
    equal = F.sha2(F.coalesce("text_old", F.lit("")), 256) == F.sha2(F.coalesce("text_new", F.lit("")), 256)
    same = pairs.filter(equal).withColumns({"similarity": F.lit(1.0), "changes": F.lit("")})

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            ratio, spans = [], []
            for a, b in zip(batch["text_old"].fillna(""), batch["text_new"].fillna(""), strict=True):
                x, y = a.lower().split(), b.lower().split()
                match = difflib.SequenceMatcher(None, x, y, autojunk=False)
                changed = [(i, j, k, m) for tag, i, j, k, m in match.get_opcodes() if tag != "equal"][:3]
                ratio.append(round(match.ratio(), 4))
                spans.append("; ".join(f"{' '.join(x[max(0, i - 4) : j])} -> {' '.join(y[k:m])}" for i, j, k, m in changed))
            yield batch.assign(similarity=ratio, changes=spans)

    other = pairs.filter(~equal)
    return same.unionByName(other.mapInPandas(scan, f"{other.schema.simpleString()[7:-1]},similarity:double,changes:string"))


def link_by_tokens(left: DataFrame, right: DataFrame, keys: list[str], threshold: float = 0.3) -> DataFrame:
    """(keys, left_id, right_id, similarity): for each left text the most similar right one of its key that reaches the threshold, the first of equals.

    Texts with equal words are one on either side (the right one with its first id), so a key with many repeated texts compares only its distinct
    ones. Those meet in an equi-join on their rarest words, of which two that are alike share one: a word that all texts have brings none together. What
    meets is then compared by all words. left, right: keys, id, text.
    """
    sets = lambda df: df.select(*keys, "id", F.array_sort(tokens(F.col("text"))).alias("tokens"))
    own, other = sets(left).transform(checkpointed), sets(right).groupBy(*keys, "tokens").agg(F.min("id").alias("right_id")).transform(checkpointed)
    rare = rare_tokens(own.select(*keys, "tokens").union(other.select(*keys, "tokens")), keys, threshold).transform(checkpointed)
    mine = rare.join(own.select(*keys, "tokens").distinct(), [*keys, "tokens"], "left_semi").withColumnRenamed("tokens", "_t")
    yours = rare.join(other, [*keys, "tokens"]).withColumnRenamed("tokens", "_t_right")
    met = mine.join(yours, [*keys, "token"]).select(*keys, "_t", "_t_right", "right_id").distinct()
    scored = met.withColumn("similarity", jaccard(F.col("_t"), F.col("_t_right"))).filter(F.col("similarity") >= threshold)
    best = scored.groupBy(*keys, "_t").agg(F.max(F.struct("similarity", (-F.col("right_id")).alias("_o"))).alias("_m"))
    return own.withColumnRenamed("tokens", "_t").join(best, [*keys, "_t"]).select(*keys, F.col("id").alias("left_id"), (-F.col("_m._o")).alias("right_id"), F.col("_m.similarity").alias("similarity"))


def rationales(sections: DataFrame, items: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, ord, rationale): the first item that names a section's number; a short one takes the next with it. sections: keys, ord, number; items: keys, item_ord, item."""
    w = Window.partitionBy(*keys).orderBy("item_ord")
    wide = items.withColumn("_next", F.lead("item").over(w))
    text = F.when((F.size(F.split("item", " ")) <= 12) & F.col("_next").isNotNull(), F.concat_ws(" ", "item", "_next")).otherwise(F.col("item"))
    named = wide.select(*keys, "item_ord", text.alias("_text"), F.explode(F.array_distinct(F.regexp_extract_all("item", F.lit(r"([0-9]+(?:\.[0-9]+)*)"), F.lit(1)))).alias("number"))
    return sections.join(named, [*keys, "number"]).groupBy(*keys, "ord").agg(F.min_by("_text", "item_ord").alias("rationale"))


def _set(text: str | None) -> frozenset:
    import re

    return frozenset(re.findall(r"\w+", (text or "").lower()))


def _alike(a: frozenset, b: frozenset) -> float:
    return len(a & b) / len(a | b) if a | b else 0.0


def align(candidates: DataFrame, attributes: tuple[str, ...] = ("variable", "summary_measure", "population"), threshold: float = 0.4) -> DataFrame:
    """Adds slot to (doc_id, member, ord, attributes): members in order, each candidate to the best slot without one of its member; the later of equals; else a new slot.

    Two candidates are as alike as the most alike of the attributes that both have; null is no attribute.
    """

    def walk(rows: list[dict]) -> list[tuple]:
        slots: list[list[tuple]] = []
        out = []
        for r in rows:
            own = [None if r[a] is None else _set(r[a]) for a in attributes]
            best, at = threshold, None
            for k, slot in enumerate(slots):
                score = max((_alike(x, y) for _, other in slot for x, y in zip(own, other, strict=True) if x is not None and y is not None), default=0.0)
                if score >= best and all(m != r["member"] for m, _ in slot):
                    best, at = score, k
            if at is None:
                at = len(slots)
                slots.append([])
            slots[at].append((r["member"], own))
            out.append((r["member"], r["ord"], *(r[a] for a in attributes), at))
        return out

    kinds = dict(candidates.dtypes)
    return fold(candidates.select("doc_id", "member", "ord", *attributes), ["doc_id"], ["member", "ord"], walk, f"member {kinds['member']}, ord {kinds['ord']}, {', '.join(f'{a} string' for a in attributes)}, slot int")


def clustered_events(events: DataFrame, threshold: float = 0.5) -> DataFrame:
    """(doc_id, slot, text, strategy, support, grounded): events clustered by likeness to a cluster's first text.

    text is that of the first event with a good quote, or of the first; strategy the most frequent one that is given, first seen among equals, null if
    none is. events: doc_id, slot, ord, text, strategy, quote_ok.
    """

    def walk(rows: list[dict]) -> list[tuple]:
        groups: list[list] = []
        for r in rows:
            own = _set(r["text"])
            home = next((g for g in groups if _alike(own, g[0][0]) >= threshold), None)
            if home is None:
                groups.append(home := [])
            home.append((own, r))
        out = []
        for g in groups:
            good = [r["text"] for _, r in g if r["quote_ok"]]
            names = [r["strategy"] for _, r in g if r["strategy"]]
            out.append(((good or [g[0][1]["text"]])[0], max(dict.fromkeys(names), key=names.count, default=None), len(g), bool(good)))
        return out

    return fold(events.select("doc_id", "slot", "ord", "text", "strategy", "quote_ok"), ["doc_id", "slot"], ["ord"], walk, "text string, strategy string, support int, grounded boolean")


def reconcile(events: DataFrame, threshold: float = 0.5) -> DataFrame:
    """(doc_id, slot, text, strategy, support) of clustered_events that have a good quote."""
    return clustered_events(events, threshold).filter("grounded").drop("grounded")


def event_findings(clusters: DataFrame) -> DataFrame:
    """(doc_id, slot, text, kind, severity) of clustered_events: those dropped for want of a good quote, and those kept without a strategy."""
    kind = F.when(~F.col("grounded"), "GROUNDING").when(F.coalesce("strategy", F.lit("")) == "", "COMPLETENESS")
    return clusters.select("doc_id", "slot", "text", kind.alias("kind"), F.lit("WARNING").alias("severity")).filter(F.col("kind").isNotNull())
