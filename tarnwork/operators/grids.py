"""Schedules and tables as long rows of cells: (table keys, row, col, text)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def norm_cell(c: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " ")))


def first_parsing_table(tables: DataFrame, keys: list[str]) -> DataFrame:
    """The first table of each key (by page, table_ix) with at least one visit and one activity. tables: keys, page, table_ix, n_visits, n_activities."""
    ok = tables.filter("n_visits >= 1 and n_activities >= 1")
    rest = [c for c in tables.columns if c not in (*keys, "page", "table_ix")]
    return ok.groupBy(*keys).agg(F.min(F.struct("page", "table_ix", *rest)).alias("_t")).select(*keys, "_t.*")


def pair_by_page(first: DataFrame, second: DataFrame) -> DataFrame:
    """The n-th table on a page in one engine beside the n-th in the other: (doc_id, page, n, a, b, has_signal)."""
    w = Window.partitionBy("doc_id", "page").orderBy("table_ix")
    a = first.withColumn("n", F.row_number().over(w)).select("doc_id", "page", "n", F.col("table_ix").alias("a"))
    b = second.withColumn("n", F.row_number().over(w)).select("doc_id", "page", "n", F.col("table_ix").alias("b"))
    return a.join(b, ["doc_id", "page", "n"], "left").withColumn("has_signal", F.col("b").isNotNull())


def compare_grids(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Per table: cells compared, cells that agree (normalised), their ratio (1.0 without any), and whether the dimensions match."""
    size = lambda df, tag: df.groupBy(*keys).agg((F.max("row") + 1).alias(f"_rows_{tag}"), (F.max("col") + 1).alias(f"_cols_{tag}"))
    both = a.select(*keys, "row", "col", norm_cell(F.col("text")).alias("_a")).join(b.select(*keys, "row", "col", norm_cell(F.col("text")).alias("_b")), [*keys, "row", "col"])
    cells = both.groupBy(*keys).agg(F.count("*").alias("compared"), F.count_if(F.col("_a") == F.col("_b")).alias("agree"))
    out = size(a, "a").join(size(b, "b"), keys).join(cells, keys, "left").fillna(0, ["compared", "agree"])
    same = (F.col("_rows_a") == F.col("_rows_b")) & (F.col("_cols_a") == F.col("_cols_b"))
    return out.select(*keys, "compared", "agree", F.when(F.col("compared") > 0, F.col("agree") / F.col("compared")).otherwise(F.lit(1.0)).alias("ratio"), same.alias("dims_match"))


def disagreements(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Cells that both have and that differ."""
    return a.select(*keys, "row", "col", F.col("text").alias("claimed")).join(b.select(*keys, "row", "col", F.col("text").alias("rederived")), [*keys, "row", "col"]).filter(norm_cell(F.col("claimed")) != norm_cell(F.col("rederived")))


def cross_validate(marks: DataFrame, dims: DataFrame, keys: list[str]) -> DataFrame:
    """A decision for each cell of each schedule, by how many engines mark it (cells match by position).

    marks: keys, engine, engine_ord, activity, visit; dims: keys, engine, n_activities, n_visits (engines with an empty grid are left out).
    The grid with most activities, visits and cells is the reference; its cells are made by sequences, not by a product of rows.
    """
    live = dims.filter("n_activities > 0 and n_visits > 0")
    cells = marks.groupBy(*keys, "engine").agg(F.count("*").alias("_cells"))
    size = live.join(cells, [*keys, "engine"], "left").groupBy(*keys).agg(F.max(F.struct("n_activities", "n_visits", F.coalesce("_cells", F.lit(0)))).alias("_d"), F.count("*").alias("_n"))
    grid = size.select(*keys, "_n", "_d.n_visits", F.explode(F.sequence(F.lit(0), F.col("_d.n_activities") - 1)).alias("activity"))
    grid = grid.select(*keys, "_n", "activity", F.explode(F.sequence(F.lit(0), F.col("n_visits") - 1)).alias("visit"))
    hits = marks.join(live.select(*keys, "engine"), [*keys, "engine"], "left_semi").groupBy(*keys, "activity", "visit").agg(F.countDistinct("engine").alias("_k"), F.min_by("engine", "engine_ord").alias("_first"))
    k, n = F.coalesce("_k", F.lit(0)), F.col("_n")
    full, part, alone = (k == n) & (n >= 2), (k > 0) & (k < n), (k == 1) & (n == 1)
    return grid.join(hits, [*keys, "activity", "visit"], "left").select(
        *keys, "activity", "visit",
        F.when(full, "both").when(part | alone, F.concat(F.coalesce("_first", F.lit("")), F.lit("-only"))).otherwise("none").alias("provenance"),
        F.when(full, 0.97).when(part, 0.55).when(alone, 0.6).otherwise(0.9).alias("confidence"),
        F.when(part | alone, "REVIEW").otherwise("AUTO_ACCEPT").alias("decision"),
    )


def forward_fill(cells: DataFrame, partition: list[str], order: str, value: str) -> DataFrame:
    """Empty cells take the last non-empty value before them; leading ones stay empty."""
    w = Window.partitionBy(*partition).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return cells.withColumn(value, F.coalesce(F.last(F.when(F.col(value) != "", F.col(value)), ignorenulls=True).over(w), F.lit("")))


def data_columns(cells: DataFrame, keys: list[str]) -> DataFrame:
    """Cells without the label column and without columns of notes, in rows that have a label and a value."""
    notes = cells.filter((F.col("row") == 0) & F.lower("text").rlike(r"^(notes?|comments?|remarks?)$")).select(*keys, "col")
    label = cells.filter((F.col("col") == 0) & (F.trim("text") != "") & (F.col("row") > 0)).select(*keys, "row", F.col("text").alias("label"))
    body = cells.filter((F.col("col") > 0) & (F.col("row") > 0)).join(notes, [*keys, "col"], "left_anti").join(label, [*keys, "row"])
    return body.filter(F.trim(F.coalesce("text", F.lit(""))) != "")


def drop_empty_columns(cells: DataFrame, keys: list[str]) -> DataFrame:
    """Cells of columns with some text, columns numbered anew from 0."""
    # one exchange and one sort by keys and column serve both windows
    rows = cells.dropna(subset=[*keys, "col"]).repartition(*keys)
    full = rows.withColumn("_f", F.max(F.trim(F.coalesce("text", F.lit(""))) != "").over(Window.partitionBy(*keys, "col"))).filter("_f")
    return full.withColumn("col", F.dense_rank().over(Window.partitionBy(*keys).orderBy("col")) - 1).select(*cells.columns)


def parse_schedule(cells: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, activity, epoch, visit, timing, marked) of grids with three header rows; blank rows go, fewer than four rows give nothing."""
    from ..functions.text import mark_anywhere

    full = cells.groupBy(*keys, "row").agg(F.max((F.trim(F.coalesce("text", F.lit(""))) != "").cast("int")).alias("_f")).filter("_f = 1")
    w = Window.partitionBy(*keys)
    rows = full.withColumns({"_r": F.row_number().over(w.orderBy("row")) - 1, "_n": F.count("*").over(w)}).filter("_n >= 4")
    numbered = cells.join(rows.select(*keys, "row", "_r"), [*keys, "row"])
    head = lambda k, name: numbered.filter((F.col("_r") == k) & (F.col("col") > 0)).select(*keys, "col", F.coalesce(F.trim("text"), F.lit("")).alias(name))
    epochs = forward_fill(head(0, "epoch"), keys, "col", "epoch")
    body = numbered.filter(F.col("_r") >= 3)
    label = body.filter("col = 0").select(*keys, "_r", F.trim("text").alias("activity")).filter("activity <> ''")
    return body.filter("col > 0").join(label, [*keys, "_r"]).join(epochs, [*keys, "col"]).join(head(1, "visit"), [*keys, "col"]).join(head(2, "timing"), [*keys, "col"]).select(*keys, "activity", "epoch", "visit", "timing", mark_anywhere(F.col("text")).alias("marked"))


def missing_pairs(left: DataFrame, right: DataFrame, cells: DataFrame, keys: list[str], a: str, b: str) -> DataFrame:
    """Pairs of a key's arms and epochs without a cell. Both lists belong to one study and are short; they meet by the study's key."""
    return left.join(right, keys).join(cells, [*keys, a, b], "left_anti")


def demote(fields: DataFrame, findings: DataFrame, domain: str = "domain") -> DataFrame:
    """AUTO_ACCEPT becomes REVIEW in domains with a finding of severity ERROR."""
    bad = findings.filter("severity = 'ERROR'").select(domain).distinct().withColumn("_bad", F.lit(True))
    return fields.join(bad, domain, "left").withColumn("decision", F.when(F.col("_bad") & (F.col("decision") == "AUTO_ACCEPT"), "REVIEW").otherwise(F.col("decision"))).drop("_bad")


def bbox_union(x0: str = "x0", y0: str = "y0", x1: str = "x1", y1: str = "y1") -> Column:
    """The smallest box around all boxes of a group."""
    return F.struct(F.min(x0).alias("x0"), F.min(y0).alias("y0"), F.max(x1).alias("x1"), F.max(y1).alias("y1"))


def in_boxes(points: DataFrame, boxes: DataFrame, keys: list[str]) -> DataFrame:
    """Glyphs whose centre lies in a box (edges count), a row for each such box; keys, such as document and page, are equal on both sides.

    Both sides meet by the cells of a grid, and the exact test comes after. A box lies in the grid whose cells are as wide as the power of two
    above its longer side, so in four of them at most; a glyph looks up its cell in each grid that has boxes of its page. Work follows the
    glyphs and what they are near to, however many boxes a page has and however their sizes differ.
    """
    x0, y0, x1, y1 = (F.col(f"_b{c}") for c in ("x0", "y0", "x1", "y1"))
    named = boxes.select(*keys, "box_id", *(F.col(c).cast("double").alias(f"_b{c}") for c in ("x0", "y0", "x1", "y1"))).filter((x0 <= x1) & (y0 <= y1))
    cell = lambda v: F.floor(v / F.pow(F.lit(2.0), "_grid"))
    gridded = named.withColumn("_grid", F.ceil(F.log2(F.greatest(x1 - x0, y1 - y0, F.lit(1.0)))).cast("int"))
    grids = gridded.groupBy(*keys).agg(F.collect_set("_grid").alias("_grids"))
    placed = gridded.withColumn("_cx", F.explode(F.sequence(cell(x0), cell(x1)))).withColumn("_cy", F.explode(F.sequence(cell(y0), cell(y1))))
    centred = points.withColumns({"_x": (F.col("x0") + F.col("x1")) / 2, "_y": (F.col("y0") + F.col("y1")) / 2}).join(grids, keys).withColumn("_grid", F.explode("_grids"))
    met = centred.withColumns({"_cx": cell(F.col("_x")), "_cy": cell(F.col("_y"))}).join(placed, [*keys, "_grid", "_cx", "_cy"])
    return met.filter(F.col("_x").between(x0, x1) & F.col("_y").between(y0, y1)).select(*points.columns, "box_id")


def aligned(a: Column, b: Column, tolerance: float = 3.0) -> Column:
    """Whether two arrays of column edges agree, each taken from its own first edge."""
    return (F.size(a) == F.size(b)) & F.forall(F.zip_with(a, b, lambda x, y: F.abs((x - a[0]) - (y - b[0])) <= tolerance), lambda x: F.coalesce(x, F.lit(False)))


def column_edges(cells: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, edges): left edges of the columns, in order, and the right edge of the last."""
    left = cells.groupBy(*keys, "col").agg(F.min("x0").alias("_x"), F.max("x1").alias("_r"))
    return left.groupBy(*keys).agg(F.array_append(F.transform(F.array_sort(F.collect_list(F.struct("col", "_x"))), lambda x: x["_x"]), F.max("_r")).alias("edges"))


def page_bounds(tables: DataFrame) -> DataFrame:
    """Adds first_on_page and last_on_page to (doc_id, page, y0)."""
    w = Window.partitionBy("doc_id").orderBy("page", "y0")
    return tables.withColumns({"first_on_page": F.coalesce(F.lag("page").over(w) != F.col("page"), F.lit(True)), "last_on_page": F.coalesce(F.lead("page").over(w) != F.col("page"), F.lit(True))})


def read_ruled(cells: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, activity_row, activity, visit_col, epoch, visit) for each mark of ruled schedules. cells: keys, row, col, x0, x1, text.

    The row with most cells, the first of equals, gives the columns. Rows above the first one with a mark are the header: the first names epochs, the
    last visits, and a header cell or a mark that spans several columns is that of each whose centre it covers. The first column holds activities.
    A schedule's cells are gathered once; who has them so gives them to read_ruled_pages.
    """
    pages = cells.dropna(subset=keys).groupBy(*keys).agg(F.collect_list(F.struct("row", "col", "x0", "x1", "text")).alias("cells"))
    return read_ruled_pages(pages, keys)


def read_ruled_pages(pages: DataFrame, keys: list[str]) -> DataFrame:
    """read_ruled of schedules (keys, cells), whose cells are an array of struct(row, col, x0, x1, text). Nothing is shuffled."""
    from ..functions.text import mark_first

    trimmed = F.transform("cells", lambda c: F.struct(c["row"].alias("row"), c["col"].alias("col"), c["x0"].alias("x0"), c["x1"].alias("x1"), F.trim(F.coalesce(c["text"], F.lit(""))).alias("t")))
    out = pages.select(*keys, F.array_sort(trimmed).alias("_s")).withColumn("_marks", F.filter("_s", lambda c: (c["col"] > 0) & mark_first(c["t"])))
    # cells are sorted, so a row's follow each other; the largest (cells, -row) so far is that of whole rows in the end
    none = F.lit(None).cast(pages.select(F.col("cells")[0]["row"]).schema[0].dataType)
    start = F.struct(none.alias("row"), F.lit(0).alias("n"), F.struct(F.lit(0).alias("n"), none.alias("o")).alias("best"))

    def longest(at: Column, c: Column) -> Column:
        n = F.when(at["row"].eqNullSafe(c["row"]), at["n"] + 1).otherwise(F.lit(1))
        return F.struct(c["row"].alias("row"), n.alias("n"), F.greatest(at["best"], F.struct(n.alias("n"), (-c["row"]).alias("o"))).alias("best"))

    out = out.withColumns({"_first": F.array_min(F.transform("_marks", lambda c: c["row"])), "_widest": -F.aggregate("_s", start, longest)["best"]["o"]})
    own = F.filter("_s", lambda c: (c["col"] > 0) & (c["row"] == F.col("_widest")))
    head = F.filter("_s", lambda c: (c["col"] > 0) & (c["row"] < F.col("_first")) & (c["t"] != ""))
    names = F.filter("_s", lambda c: (c["col"] == 0) & (c["row"] >= F.col("_first")) & (c["t"] != ""))
    out = out.withColumns({"_columns": F.array_sort(F.transform(own, lambda c: F.struct(c["x0"].alias("x0"), ((c["x0"] + c["x1"]) / 2).alias("c")))), "_head": head, "_names": names})
    covers = lambda cell, c: (c >= cell["x0"]) & (c <= cell["x1"])
    named = lambda c, row: F.coalesce(F.get(F.filter("_head", lambda h: (h["row"] == row) & covers(h, c)), F.lit(0))["t"], F.lit(""))
    columns = F.transform("_columns", lambda c, i: F.struct((i + 1).alias("visit_col"), c["c"].alias("c"), named(c["c"], F.lit(0)).alias("epoch"), named(c["c"], F.col("_first") - 1).alias("visit")))
    out = out.select(*keys, "_marks", "_names", columns.alias("_columns"))
    hits = F.flatten(F.transform("_marks", lambda m: F.transform(F.filter("_columns", lambda c: covers(m, c["c"])), lambda c: F.struct(m["row"].alias("row"), c["visit_col"].alias("visit_col"), c["epoch"].alias("epoch"), c["visit"].alias("visit")))))
    rows = F.flatten(F.transform(F.array_distinct(hits), lambda h: F.transform(F.filter("_names", lambda n: n["row"] == h["row"]), lambda n: F.struct(h["row"].alias("activity_row"), n["t"].alias("activity"), h["visit_col"].alias("visit_col"), h["epoch"].alias("epoch"), h["visit"].alias("visit")))))
    return out.select(*keys, F.inline(rows))
