"""Text blocks of documents: scan, kinds, running headers, windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import collapse


def text_blocks(docs: DataFrame, lines_per_page: int = 8, line_height: float = 12.0) -> DataFrame:
    """Blocks of plain texts: (doc_id, ord, page, y0, size, text), a block per non-blank line; size 14 for lines set as headings, else 10.

    Layout readers give the same columns from real pages; lines stand for blocks, lines_per_page of them make a page.
    """
    lines = docs.select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("ord", "_line")).withColumn("text", collapse(F.col("_line"))).filter("text <> ''")
    heading = (F.char_length("text") < 60) & ~F.col("text").rlike(r"[.,;:]$")
    return lines.select(
        "doc_id", "ord", (F.floor(F.col("ord") / lines_per_page) + 1).cast("int").alias("page"), (F.col("ord") % lines_per_page * line_height).cast("double").alias("y0"), F.when(heading, 14.0).otherwise(10.0).alias("size"), "text"
    )


def refuse_scanned(blocks: DataFrame, least_chars: int = 3, share: float = 0.8) -> DataFrame:
    """(doc_id, n_pages, thin_pages, refused): documents where at least `share` of the pages have fewer than least_chars characters."""
    pages = blocks.groupBy("doc_id", "page").agg(F.sum(F.char_length("text")).alias("_n"))
    out = pages.groupBy("doc_id").agg(F.count("*").alias("n_pages"), F.count_if(F.col("_n") < least_chars).alias("thin_pages"))
    return out.withColumn("refused", F.col("thin_pages") >= share * F.col("n_pages"))


def classify_blocks(blocks: DataFrame) -> DataFrame:
    """Adds kind: heading (at least 1.25 times the page's upper median size, under 120 characters), footnote, prose.

    A page has a bounded number of blocks, so its sizes are gathered to find the exact upper median.
    """
    sizes = F.sort_array(F.collect_list("size"))
    medians = blocks.groupBy("doc_id", "page").agg(F.element_at(sizes, (F.floor(F.size(sizes) / 2) + 1).cast("int")).alias("_median"))
    note = F.lower("text").rlike(r"^(\*|†|‡|note:|footnote)")
    kind = F.when((F.col("size") >= 1.25 * F.col("_median")) & (F.char_length("text") < 120), "heading").when(note, "footnote").otherwise("prose")
    return blocks.join(medians, ["doc_id", "page"]).withColumn("kind", kind).drop("_median")


def head_text(blocks: DataFrame, pages: int) -> DataFrame:
    """(doc_id, head): the blocks of the first pages in order, joined by line breaks."""
    rows = F.array_sort(F.collect_list(F.struct("ord", "text")))
    return blocks.filter(F.col("page") <= pages).groupBy("doc_id").agg(F.array_join(F.transform(rows, lambda x: x["text"]), "\n").alias("head"))


def furniture_key(text: Column, y0: Column) -> tuple[Column, Column]:
    """Text with digits as # and, for short ones, the band of their place."""
    key = F.regexp_replace(F.lower(text), r"[0-9]+", "#")
    return key, F.when(F.char_length(key) < 25, F.bround(y0 / 8).cast("int")).otherwise(0)


def furniture(blocks: DataFrame) -> DataFrame:
    """(doc_id, key, band) of running headers and footers: on at least 5 pages and half of all."""
    key, band = furniture_key(F.col("text"), F.col("y0"))
    keyed = blocks.select("doc_id", "page", key.alias("key"), band.alias("band"))
    pages = keyed.groupBy("doc_id").agg(F.countDistinct("page").alias("_pages"))
    seen = keyed.groupBy("doc_id", "key", "band").agg(F.countDistinct("page").alias("_n"))
    return seen.join(pages, "doc_id").filter(F.col("_n") >= F.greatest(F.lit(5.0), 0.5 * F.col("_pages"))).select("doc_id", "key", "band")


def strip_furniture(blocks: DataFrame) -> DataFrame:
    """Blocks that are no running headers or footers, those of furniture(). Blocks are shuffled once, by document, and pages are counted where they lie."""
    key, band = furniture_key(F.col("text"), F.col("y0"))
    pages = lambda *by: F.size(F.collect_set("page").over(Window.partitionBy(*by)))
    rows = blocks.repartition("doc_id").withColumns({"_key": key, "_band": band}).withColumn("_n", pages("doc_id", "_key", "_band")).withColumn("_pages", pages("doc_id"))
    named = F.col("doc_id").isNotNull() & F.col("_key").isNotNull() & F.col("_band").isNotNull()
    return rows.filter(~(named & (F.col("_n") >= F.greatest(F.lit(5.0), 0.5 * F.col("_pages"))))).select(*blocks.columns)


def strip_repeated(blocks: DataFrame, pages: int = 3) -> DataFrame:
    """Blocks without those of a text that comes on `pages` or more pages of a document, and without bare page numbers."""
    seen = blocks.groupBy("doc_id", "text").agg(F.countDistinct("page").alias("_n")).filter(F.col("_n") >= pages)
    return blocks.filter(~F.lower("text").rlike(r"^(page\s*)?[0-9]+(\s*(of|/)\s*[0-9]+)?$")).join(seen, ["doc_id", "text"], "left_anti").select(*blocks.columns)


def merge_windows(first: DataFrame, *more: DataFrame) -> DataFrame:
    """Blocks of several windows in reading order, repeated ones kept."""
    out = first
    for other in more:
        out = out.unionByName(other)
    return out.withColumn("pos", F.row_number().over(Window.partitionBy("doc_id").orderBy("page", "y0", "ord")))


def label_values(blocks: DataFrame, labels: DataFrame, pages: int = 3, most: int = 300, most_labels: int = 1000) -> DataFrame:
    """(doc_id, field, value): the first usable "label: value" line of each field. labels: field, pattern (matched at the line's start, lower case).

    The labels, most_labels at most, become conditions of one pass over the lines, so nothing is joined.
    """
    from ..functions.text import usable

    rules = sorted((r["field"], r["pattern"]) for r in labels.select("field", "pattern").distinct().limit(most_labels + 1).collect())
    if len(rules) > most_labels:
        raise ValueError(f"more than {most_labels} labels")
    low = F.lower("text")
    named = F.array_distinct(F.array_compact(F.array(*(F.when(low.rlike(pattern), F.lit(field)) for field, pattern in rules)))) if rules else F.array().cast("array<string>")
    lines = blocks.filter((F.col("page") <= pages) & F.contains(F.col("text"), F.lit(":"))).withColumn("value", F.trim(F.regexp_extract("text", r"^[^:]*:(.*)$", 1)))
    rows = lines.filter(usable(F.col("value")) & (F.char_length("value") <= most)).select("doc_id", "ord", "value", F.explode(named).alias("field"))
    return rows.groupBy("doc_id", "field").agg(F.min_by("value", "ord").alias("value"))
