"""Sections of documents: nesting, as-of lookup, scopes and slots."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .folds import by_generation, fold

#: points that a block may stand above its section's heading
TOLERANCE = 0.5
#: levels of headings that documents may have
MOST_LEVELS = 64


def section_of(blocks: DataFrame, sections: DataFrame, columns: list[str]) -> DataFrame:
    """Adds columns of the innermost section open at each block: the last one at or before (page, y0 + tolerance); null before the first.

    An as-of join without a condition join: both sides are stacked, sorted by place within a document, and the last section is carried
    forward. sections: doc_id, ord, page, y0 and the columns.
    """
    kept = [c for c in blocks.columns if c != "doc_id"]
    own = blocks.select("doc_id", F.col("page").alias("_p"), (F.col("y0") + TOLERANCE).alias("_y"), F.lit(1).alias("_side"), F.lit(None).cast("long").alias("_ord"), F.struct(*kept).alias("_block"), F.lit(None).cast(sections.select(F.struct(*columns)).schema[0].dataType).alias("_section"))
    other = sections.select("doc_id", F.col("page").alias("_p"), F.col("y0").alias("_y"), F.lit(0).alias("_side"), F.col("ord").cast("long").alias("_ord"), F.lit(None).cast(blocks.select(F.struct(*kept)).schema[0].dataType).alias("_block"), F.struct(*columns).alias("_section"))
    w = Window.partitionBy("doc_id").orderBy("_p", "_y", "_side", "_ord").rowsBetween(Window.unboundedPreceding, 0)
    out = own.unionByName(other).withColumn("_section", F.last("_section", ignorenulls=True).over(w)).filter("_side = 1")
    return out.select("doc_id", "_block.*", *(F.col(f"_section.{c}").alias(c) for c in columns))


def nest(sections: DataFrame) -> DataFrame:
    """Adds parent_ord (the last earlier section of a lower level) and page_end. sections: doc_id, ord, page, y0, level.

    A window for each level carries its last section forward; the driver gets the levels that occur, a handful. Where documents have more than MOST_LEVELS of them,
    an odd one that counts its lists for headings, all deeper levels are as the last of these.
    """
    order = Window.partitionBy("doc_id").orderBy("ord")
    levels = [r["level"] for r in sections.select("level").filter("level is not null").distinct().orderBy("level").limit(MOST_LEVELS).collect()]
    own = F.when(F.col("level").isNotNull(), F.least("level", F.lit(levels[-1]))) if levels else F.col("level")
    last = [F.when(own > k, F.last(F.when(own == k, F.col("ord")), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))) for k in levels]
    after, top = F.lead("page").over(order), F.lead("y0").over(order)
    parent = F.greatest(*last) if len(last) > 1 else F.lit(None).cast(sections.schema["ord"].dataType)
    return sections.withColumns({"parent_ord": parent, "page_end": F.when(after.isNull(), F.col("page")).when(top > 120, after).otherwise(F.greatest(F.col("page"), after - 1))})


def inherit(nested: DataFrame, label: str) -> DataFrame:
    """Fills a missing label from the nearest ancestor that has one, however far up."""
    return by_generation(nested, ["doc_id", "ord"], "parent_ord", label, lambda own, above: F.coalesce(own, above))


def scope_matches(section: dict[str, Column], scope: dict[str, Column]) -> Column:
    """All axes agree: an empty axis (array) of the scope takes anything, but a scope without any axis takes nothing."""
    axes = [(F.size(values) == 0) | F.coalesce(F.array_contains(values, section[axis]), F.lit(False)) for axis, values in scope.items()]
    some = [F.size(values) > 0 for values in scope.values()]
    out, any_ = axes[0], some[0]
    for a, b in zip(axes[1:], some[1:], strict=True):
        out, any_ = out & a, any_ | b
    return out & any_


def evidence_window(blocks: DataFrame, sections: DataFrame, prohibited: DataFrame, key: str = "section") -> tuple[DataFrame, DataFrame]:
    """Blocks outside prohibited sections (blocks before the first section stay), and per document the counts of kept and dropped ones."""
    placed = section_of(blocks, sections, [key])
    bad = prohibited.select(key).distinct().withColumn("_bad", F.lit(True))
    marked = placed.join(bad, key, "left").withColumn("_bad", F.coalesce("_bad", F.lit(False)))
    counts = marked.groupBy("doc_id").agg(F.count_if(~F.col("_bad")).alias("kept"), F.count_if("_bad").alias("dropped"))
    return marked.filter(~F.col("_bad")).drop("_bad"), counts


def dropped_findings(blocks: DataFrame, sections: DataFrame, prohibited: DataFrame, key: str = "section") -> DataFrame:
    """(doc_id, section, n_blocks, severity): a finding for each dropped section."""
    placed = section_of(blocks, sections, [key]).join(prohibited.select(key).distinct(), key, "left_semi")
    return placed.groupBy("doc_id", key).agg(F.count("*").alias("n_blocks")).withColumn("severity", F.lit("INFO"))


def slot_blocks(blocks: DataFrame, sections: DataFrame, pattern: str, front_pages: int = 0) -> DataFrame:
    """Blocks under sections whose title matches, each up to the next section of its level or a higher one; and those of the front pages."""
    ends = sections.select("doc_id", F.col("page").alias("_p2"), F.col("y0").alias("_y2"), F.col("level").alias("_l2"))
    chosen = sections.filter(F.lower("title").rlike(pattern)).select("doc_id", "ord", "page", "y0", "level")
    later = (F.col("_l2") <= F.col("level")) & (F.struct("_p2", "_y2") > F.struct("page", "y0"))
    spans = chosen.join(ends, "doc_id").groupBy("doc_id", "ord", "page", "y0").agg(F.min(F.when(later, F.struct("_p2", "_y2"))).alias("_end"))
    spans = spans.select("doc_id", F.struct("page", (F.col("y0") - 1).alias("y0")).alias("_from"), F.struct(F.col("_end._p2").alias("page"), (F.col("_end._y2") - 1).alias("y0")).alias("_to"), F.col("_end").isNull().alias("_open"))
    here = F.struct("page", "y0")
    inside = blocks.join(spans, "doc_id").filter((here >= F.col("_from")) & (F.col("_open") | (here < F.col("_to")))).select(*blocks.columns)
    front = blocks.filter(F.col("page") <= front_pages).join(chosen.select("doc_id").distinct(), "doc_id", "left_semi")
    return inside.unionByName(front).distinct()


def top_level_parent(sections: DataFrame) -> DataFrame:
    """Adds top_title: the title of the last section of level 1 before each."""
    w = Window.partitionBy("doc_id").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    return sections.withColumn("top_title", F.last(F.when(F.col("level") == 1, F.col("title")), ignorenulls=True).over(w))


def graph_summary(sections: DataFrame) -> DataFrame:
    """Per document: n_sections, n_typed, typed_share and the counts by type (null types left out)."""
    types = sections.filter(F.col("type").isNotNull()).groupBy("doc_id", "type").agg(F.count("*").alias("_n"))
    maps = types.groupBy("doc_id").agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("type", "_n"))))).alias("by_type"))
    out = sections.groupBy("doc_id").agg(F.count("*").alias("n_sections"), F.count_if(F.col("type").isNotNull()).alias("n_typed"))
    return out.withColumn("typed_share", F.col("n_typed") / F.col("n_sections")).join(maps, "doc_id", "left")


def title_shaped(title: Column) -> Column:
    """Whether a line can be a heading."""
    words = F.size(F.split(F.trim(title), r"\s+"))
    digits = F.char_length(title) - F.char_length(F.regexp_replace(title, "[0-9]", ""))
    return title.rlike(r"^\p{Lu}") & ~title.rlike(r"[.;,:]$") & (words <= 14) & title.rlike(r"\p{L}{3}") & (digits <= F.floor(F.char_length(title) / 4))


def position_bookmarks(marks: DataFrame, blocks: DataFrame, start: int | None = 25) -> DataFrame:
    """Adds y0 to (doc_id, ord, page, title): the top of the first block of the page that starts like the title, else 0; never above an earlier mark of the page. start: characters of the title that a block has to have; None: all."""
    tops = marks.join(blocks.select("doc_id", "page", F.col("y0").alias("_y"), F.lower("text").alias("_t"), F.col("ord").alias("_o")), ["doc_id", "page"], "left")
    hit = F.startswith(F.col("_t"), F.lower(F.col("title") if start is None else F.substring("title", 1, start)))
    at = tops.groupBy("doc_id", "ord", "page", "title").agg(F.min_by(F.when(hit, F.col("_y")), F.when(hit, F.col("_o"))).alias("_y"))
    w = Window.partitionBy("doc_id", "page").orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)
    return at.withColumn("y0", F.max(F.coalesce("_y", F.lit(0.0))).over(w)).drop("_y")


def choose_graph(graphs: DataFrame) -> DataFrame:
    """(doc_id, source): the source with most typed sections, bookmarks on a tie. graphs: doc_id, source, type."""
    typed = graphs.groupBy("doc_id", "source").agg(F.count("type").alias("_n"))
    return typed.groupBy("doc_id").agg(F.max_by("source", F.struct("_n", (F.col("source") == "bookmarks").alias("_b"))).alias("source"))


def heading_sequence(candidates: DataFrame) -> DataFrame:
    """Headings whose number advances over the last one kept; pages with six or more candidates are tables of contents.

    candidates: doc_id, ord, page, number (like "3.1"), font (whether set as a heading). Each step depends on the last row that was kept, so
    a document's few candidates are walked in order. What is no number in a number is passed over ("3." is 3); without any it is before all others.
    """

    def walk(rows: list[dict]) -> list[tuple]:
        on_page = Counter(r["page"] for r in rows)
        kept, last = [], ()
        for r in rows:
            number = tuple(int(x) for x in re.findall(r"[0-9]+", r["number"] or ""))
            if on_page[r["page"]] < 6 and (r["font"] or number > last):
                kept.append((r["ord"], r["page"], r["number"], r["font"]))
                last = number
        return kept

    kinds = dict(candidates.dtypes)
    return fold(candidates.select("doc_id", "ord", "page", "number", "font"), ["doc_id"], ["ord"], walk, ", ".join(f"{c} {kinds[c]}" for c in ("ord", "page", "number", "font")))


def clusters(pages: DataFrame, gap: int = 15) -> DataFrame:
    """Adds cluster to (doc_id, page): a new one where the page is more than `gap` after the one before."""
    w = Window.partitionBy("doc_id").orderBy("page")
    new = (F.col("page") - F.lag("page").over(w) > gap).cast("int")
    return pages.withColumn("cluster", F.sum(F.coalesce(new, F.lit(0))).over(w.rowsBetween(Window.unboundedPreceding, 0)))


def page_families(entries: DataFrame, attributes: list[str]) -> DataFrame:
    """Runs of consecutive pages with the same attributes: (doc_id, family, first_page, last_page, n)."""
    w = Window.partitionBy("doc_id").orderBy("page")
    same = F.lag("page").over(w) == F.col("page") - 1
    for a in attributes:
        same = same & F.lag(a).over(w).eqNullSafe(F.col(a))
    marked = entries.withColumn("_new", (~F.coalesce(same, F.lit(False))).cast("int")).withColumn("family", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy("doc_id", "family").agg(F.min("page").alias("first_page"), F.max("page").alias("last_page"), F.count("*").alias("n"))


def best_pages(entries: DataFrame, most: int) -> DataFrame:
    """The `most` pages of each document with the largest sum of scores, earlier pages first among equals."""
    totals = entries.groupBy("doc_id", "page").agg(F.sum("score").alias("score"))
    return totals.withColumn("rank", F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("score"), "page"))).filter(F.col("rank") <= most)


# What may stand before the number of an item, and a heading that ends it.
ITEM_NUMBER = r"(?<![\w.,/<>=+≥-])([0-9]+)\.(?=\s)"
NEXT_HEADING = r"\s*\n[^\n]{3,60}:\s*$"


def split_numbered(regions: DataFrame) -> DataFrame:
    """(doc_id, n, item) of numbered lists: item n starts at an "n." after item n - 1, one at the start of a line or behind a wide gap rather than one
    in running text ("as in 3. below"), and of equals the first. A heading at the end of an item is none of it, and items without text go. regions: doc_id, text."""

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for doc_id, text in zip(batch["doc_id"], batch["text"].fillna(""), strict=True):
                places: dict[str, list[tuple[bool, int, int]]] = {}
                for m in re.finditer(ITEM_NUMBER, text):
                    before = text[: m.start()][-2:]
                    places.setdefault(m[1], []).append((before not in ("", "  ") and not before.endswith("\n"), m.start(), m.end()))
                starts, at = [], 0
                while later := [x for x in places.get(str(len(starts) + 1), ()) if x[1] >= at]:
                    _, start, at = min(later)
                    starts.append((start, at))
                ends = [start for start, _ in starts[1:]] + [len(text)]
                items = (" ".join(re.sub(NEXT_HEADING, "", text[own:end].rstrip()).split()) for (_, own), end in zip(starts, ends[: len(starts)], strict=True))
                out += [(doc_id, k + 1, item) for k, item in enumerate(filter(None, items))]
            yield pd.DataFrame(out, columns=["doc_id", "n", "item"])

    return regions.select("doc_id", "text").mapInPandas(scan, "doc_id long, n int, item string")
