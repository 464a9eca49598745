"""Headings of a document from its blocks: numbered, appendices and unnumbered titles, each at its level."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import collapse
from .sections import title_shaped
from .titles import title_labels

# How numbered headings and appendices look, how a line of a table of contents ends, the largest chapter, how many candidates make a page a
# table of contents, on how many pages a text is a running header, how many words in capitals a heading has at most, and how far on a chapter's first
# subsection stands.
NUMBERED = r"(?i)^(\d{1,2}(?:\.\d{1,2}){0,4})\.?\s+([A-Za-z(].{1,118})$"
APPENDIX = r"(?i)^(appendix\s+[0-9A-Z]{1,3})\b[.:\s-]*(.{0,110})$"
CONTENTS_TAIL = r"(?:\.{3,}|…{2,}|\s\d{1,3})\s*$"
LONGEST, SHORT, LAST_CHAPTER, CONTENTS_PAGE, RUNNING, CAPITAL_WORDS, LOOK_AHEAD = 120, 80, 30, 6, 3, 10, 3


def _capitals(text: Column) -> Column:
    return (F.upper(text) == text) & (F.lower(text) != text)


def heading_candidates(blocks: DataFrame) -> DataFrame:
    """(doc_id, ord, page, number, title, level, font, confirmed) of blocks (doc_id, ord, page, text, kind) that may be headings; font: set as one.

    Numbered titles have the level of their number and an empty one stands for no number. Appendices are of level 1. Titles without a number count if they are set
    as headings or in capitals, say what they hold, and are no running header; they are one level below the last number or appendix. Pages with
    CONTENTS_PAGE candidates are tables of contents and have none. confirmed: a chapter that is neither set as a heading nor in capitals has a subsection
    among the next LOOK_AHEAD candidates; others are so by themselves.
    """
    text, font = F.col("_t"), F.col("kind") == "heading"
    number, title = F.regexp_extract("_t", NUMBERED, 1), F.trim(F.regexp_extract("_t", NUMBERED, 2))
    rows = blocks.withColumn("_t", collapse(F.coalesce("text", F.lit(""))))
    pages = Window.partitionBy("doc_id", "_t")
    rows = rows.withColumns({"number": number, "_pages": F.size(F.collect_set("page").over(pages))})
    numbered = F.col("number") != ""
    chapter = F.regexp_extract("number", r"^(\d+)", 1).try_cast("int")
    shape = (
        F.when(numbered, F.when((chapter <= LAST_CHAPTER) & title_shaped(title), "numbered"))
        .when(text.rlike(APPENDIX) & (font | _capitals(text) | (F.char_length(text) < SHORT)), "appendix")
        .when((font | (_capitals(text) & (F.size(F.split(text, " ")) <= CAPITAL_WORDS))) & title_shaped(text) & (F.col("_pages") < RUNNING) & title_labels(text)["type"].isNotNull(), "title")
    )
    found = rows.filter((F.char_length(text) <= LONGEST) & ~text.rlike(CONTENTS_TAIL)).withColumn("_shape", shape).filter("_shape is not null")
    order = Window.partitionBy("doc_id").orderBy("ord")
    own = F.when(F.col("_shape") == "numbered", F.size(F.split("number", r"\."))).when(F.col("_shape") == "appendix", 1)
    found = found.withColumn("_own", own).withColumn("level", F.coalesce("_own", F.coalesce(F.last("_own", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + 1))
    found = found.withColumn("_n", F.count("*").over(Window.partitionBy("doc_id", "page"))).filter(F.col("_n") < CONTENTS_PAGE)
    following = F.collect_list("number").over(order.rowsBetween(1, LOOK_AHEAD))
    plain = F.col("number").rlike(r"^\d+$") & ~font & ~_capitals(title)
    confirmed = ~plain | F.exists(following, lambda n: n.startswith(F.concat(F.col("number"), F.lit("."))))
    return found.select("doc_id", "ord", "page", "number", F.when(F.col("number") != "", title).otherwise(text).alias("title"), "level", font.alias("font"), confirmed.alias("confirmed"))


def document_headings(blocks: DataFrame) -> DataFrame:
    """(doc_id, ord, page, number, title, level): the candidates that go forward. A number that does not come after the last one kept belongs to a list or a
    reference, unless it is set as a heading, which may begin anew. A document's candidates, of which there are few, are folded in order."""
    rows = heading_candidates(blocks)
    steps = F.transform(F.split("number", r"\."), lambda n: n.try_cast("int"))
    parts = ["ord", "page", "number", "title", "level"]
    gathered = rows.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct(*parts, "font", "confirmed", F.when(F.col("number") != "", steps).alias("steps")))).alias("_c"))
    kinds = dict(rows.dtypes)
    made = f"array<struct<{','.join(f'{p}:{kinds[p]}' for p in parts)}>>"
    start = F.struct(F.array().cast("array<int>").alias("last"), F.array().cast(made).alias("out"))

    def step(state: Column, c: Column) -> Column:
        free = c["steps"].isNull()
        kept = free | (c["confirmed"] & (c["font"] | (c["steps"] > state["last"])))
        row = F.struct(*(c[p].alias(p) for p in parts))
        return F.struct(F.when(kept & ~free, c["steps"]).otherwise(state["last"]).alias("last"), F.when(kept, F.array_append(state["out"], row)).otherwise(state["out"]).alias("out"))

    return gathered.select("doc_id", F.inline(F.aggregate("_c", start, step)["out"]))
