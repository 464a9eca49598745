"""Tables from their ruling lines and words: a lattice of edges, merged cells, and the text of each cell."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import collapse, once
from .schedules import merge_wrapped
from .stitching import boxes_of

# Fixed values, in points: how thick a rule may be and how long it is at least, how far apart rules of one edge lie, how wide a gap in an edge may be,
# the share of a table that an edge covers, how much of its height a line of text may waver, and the width up to which cells break words.
THICK, LONG, TOLERANCE, GAP, COVER, WAVER, NARROW = 0.8, 4.0, 2.5, 2.0, 0.30, 0.6, 45.0
CELL = "struct<x0:double,y0:double,x1:double,y1:double,open_below:boolean>"
PLACED = "struct<across:double,along:double,w:string,slack:double>"


def rules(segments: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, upright, pos, lo, hi) of straight lines (keys, x0, y0, x1, y1); slanted and short ones are no rules."""
    wide, high = F.abs(F.col("x1") - F.col("x0")), F.abs(F.col("y1") - F.col("y0"))
    upright, level = (wide < THICK) & (high > LONG), (high < THICK) & (wide > LONG)
    along = lambda k: F.when(upright, F.col(f"y{k}")).otherwise(F.col(f"x{k}"))
    kept = segments.filter(upright | level)
    return kept.select(*keys, upright.alias("upright"), F.when(upright, (F.col("x0") + F.col("x1")) / 2).otherwise((F.col("y0") + F.col("y1")) / 2).alias("pos"), F.least(along(0), along(1)).alias("lo"), F.greatest(along(0), along(1)).alias("hi"))


def _tables(lines: np.ndarray, upright: np.ndarray, page: np.ndarray, box_page: np.ndarray, n: np.ndarray, low: np.ndarray, high: np.ndarray, pages: int) -> np.ndarray:
    """(4, pages): the widest of a page's boxes that holds the centres of upright lines at three places, the one with more lines of equals; NaN without any."""
    ranked = np.lexsort((*high[::-1], *low[::-1], -n, -(high - low).prod(axis=0), box_page))
    box_page, low, high = box_page[ranked], low[:, ranked], high[:, ranked]
    many = np.bincount(box_page, minlength=pages)
    first, best = np.cumsum(many) - many, np.full((4, pages), np.nan)
    x, y, own = lines[0][upright], (lines[1] + lines[3])[upright] / 2, page[upright]
    place = np.copysign(np.floor(np.abs(x) + 0.5), x) + 0.0
    k = 0
    while len(own):  # the k-th box of each page that has no table yet
        box = first[own] + k
        inside = (x >= low[0][box]) & (x <= high[0][box]) & (y >= low[1][box]) & (y <= high[1][box])
        places = np.unique(np.stack([own[inside].astype(float), place[inside]]), axis=1)[0].astype(np.int64)
        found = np.flatnonzero(np.bincount(places, minlength=pages) >= 3)
        best[:2, found], best[2:, found] = low[:, first[found] + k], high[:, first[found] + k]
        k += 1
        more = (many[own] > k) & np.isnan(best[0][own])
        x, y, own, place = x[more], y[more], own[more], place[more]
    return best


def lattice(segments: DataFrame, keys: list[str], least_columns: int = 3, least_rows: int = 2) -> DataFrame:
    """(keys, columns, rows) of the pages with a ruled table: its edges from left to right and from top to bottom, each struct(pos, spans), spans being where it is drawn.

    The box of a page's table is the largest set of rules that touch and have three upright ones, as high as the upright rules within its width. Rules
    at about one position are one edge (islands of sorted positions), what they cover are its spans (islands of sorted intervals). An edge has to
    cover COVER of the table. Pages with fewer than `least_columns` columns or `least_rows` rows give nothing. A page's rules are gathered once, and
    only its edges are handed on.
    """
    ruled, up, sides = rules(segments, keys), F.col("upright"), ["x0", "y0", "x1", "y1"]
    line = F.struct(F.when(up, F.col("pos")).otherwise(F.col("lo")).alias("x0"), F.when(up, F.col("lo")).otherwise(F.col("pos")).alias("y0"), F.when(up, F.col("pos")).otherwise(F.col("hi")).alias("x1"), F.when(up, F.col("hi")).otherwise(F.col("pos")).alias("y1"), up.alias("up"))
    gathered = ruled.dropna(subset=keys).groupBy(*keys).agg(F.array_sort(F.collect_list(line)).alias("_rules"))
    edges = T.ArrayType(T.StructType([T.StructField("pos", T.DoubleType()), T.StructField("spans", T.ArrayType(T.StructType([T.StructField(c, T.DoubleType()) for c in ("lo", "hi")])))]))
    made = T.StructType([*(ruled.schema[k] for k in keys), T.StructField("columns", edges), T.StructField("rows", edges)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(len(keys))
            flat, sizes = lists.flatten(), np.diff(lists.offsets.to_numpy())
            lines = np.stack([flat.field(c).to_numpy(zero_copy_only=False) for c in sides])
            upright = flat.field("up").to_numpy(zero_copy_only=False)
            page, order, first, low, high = boxes_of(lines, sizes, GAP / 2)
            if not len(first):
                continue
            best = _tables(lines, upright, page, page[order][first], np.diff(np.append(first, len(order))), low, high, len(sizes))
            has = ~np.isnan(best[0])
            near = upright & has[page] & (lines[0] >= best[0][page] - GAP) & (lines[0] <= best[2][page] + GAP)
            np.minimum.at(best[1], page[near], lines[1][near])
            np.maximum.at(best[3], page[near], lines[3][near])
            side, pos, *spans = _edges(lines, upright, page, best)
            many = np.bincount(side, minlength=2 * len(sizes))
            kept = np.flatnonzero((many[1::2] > least_columns) & (many[::2] > least_rows))
            if len(kept):
                of = [_listed(np.isin(side, 2 * kept + u), many[2 * kept + u], pos, *spans) for u in (1, 0)]
                yield pa.RecordBatch.from_arrays([*(batch.column(k).take(pa.array(kept)) for k in range(len(keys))), *of], made.names)

    return gathered.mapInArrow(run, made)


def _edges(lines: np.ndarray, upright: np.ndarray, page: np.ndarray, best: np.ndarray) -> tuple[np.ndarray, ...]:
    """Edges in order, by page and direction: their side (twice the page, and one for upright edges), their position, how many spans each has, and where all these begin and end."""
    box = best[:, page]
    pos, lo, hi = np.where(upright, lines[0], lines[1]), np.where(upright, lines[1], lines[0]), np.where(upright, lines[3], lines[2])
    across, along = np.where(upright, box[::2], box[1::2]), np.where(upright, box[1::2], box[::2])
    own = (pos >= across[0] - GAP) & (pos <= across[1] + GAP) & (hi >= along[0] - GAP) & (lo <= along[1] + GAP)  # none without a box
    side, length, pos, lo, hi = (2 * page + upright)[own], (along[1] - along[0])[own], pos[own], lo[own], hi[own]
    order = np.lexsort((hi, lo, pos, side))
    side, length, pos, lo, hi = side[order], length[order], pos[order], lo[order], hi[order]
    edge = np.cumsum((np.diff(side, prepend=-1) > 0) | (np.diff(pos, prepend=0.0) > TOLERANCE)) - 1
    starts = np.flatnonzero(np.diff(edge, prepend=-1))
    if not len(starts):
        return side, pos, side, lo, hi
    at = np.add.reduceat(pos, starts) / np.diff(np.append(starts, len(pos)))
    order = np.lexsort((hi, lo, edge))
    lo, hi, values = lo[order], hi[order], np.sort(hi)
    # how far rules of an edge have reached: a running maximum of ranks, which begin anew with each edge
    reached = values[np.maximum.accumulate(edge * len(hi) + np.searchsorted(values, hi)) - edge * len(hi)]
    new = np.diff(edge, prepend=-1) > 0
    new[1:] |= lo[1:] > reached[:-1] + GAP
    spans = np.flatnonzero(new)
    n, lo, hi = np.bincount(edge[spans]), lo[spans], np.maximum.reduceat(hi, spans)
    kept = np.add.reduceat(hi - lo, np.cumsum(n) - n) >= COVER * length[starts]
    drawn = np.repeat(kept, n)
    return side[starts][kept], at[kept], n[kept], lo[drawn], hi[drawn]


def _listed(which: np.ndarray, many: np.ndarray, pos: np.ndarray, n: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> pa.ListArray:
    """Some of the edges as lists of struct(pos, spans), as many in each as `many` says."""
    offsets = lambda sizes: pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
    drawn = np.repeat(which, n)
    spans = pa.ListArray.from_arrays(offsets(n[which]), pa.StructArray.from_arrays([pa.array(lo[drawn]), pa.array(hi[drawn])], ["lo", "hi"]))
    return pa.ListArray.from_arrays(offsets(many), pa.StructArray.from_arrays([pa.array(pos[which]), spans], ["pos", "spans"]))


def _drawn(spans: Column, at: Column) -> Column:
    return F.exists(spans, lambda s: (s["lo"] <= at) & (s["hi"] >= at))


def _bands() -> Column:
    """The rows of a lattice as an array: where an inner edge is not drawn across a row, the cells on both sides are one; xs are the edges of what is left."""

    def band(top: Column, row: Column) -> Column:
        below = F.get("rows", row + 1)
        edges = F.filter("columns", lambda e, i: (i == 0) | (i == F.size("columns") - 1) | _drawn(e["spans"], (top["pos"] + below["pos"]) / 2))
        return F.struct(row.alias("row"), top["pos"].alias("y0"), below["pos"].alias("y1"), F.transform(edges, lambda e: e["pos"]).alias("xs"), below["spans"].alias("below"))

    return F.transform(F.slice("rows", 1, F.size("rows") - 1), band)


def _entry(row: Column, col: Column, turned: Column, cell: Column, word: Column) -> Column:
    return F.struct(row.cast("int").alias("row"), col.cast("int").alias("col"), turned.alias("turned"), cell.cast(CELL).alias("cell"), word.cast(PLACED).alias("word"))


def _cells(bands: Column) -> Column:
    """An entry for each cell. open_below: the edge below it is not drawn at its middle, so it goes on in the next row."""

    def cell(b: Column, col: Column) -> Column:
        x0, x1 = b["xs"][col], b["xs"][col + 1]
        return _entry(b["row"], col, F.lit(False), F.struct(x0, b["y0"], x1, b["y1"], ~_drawn(b["below"], (x0 + x1) / 2)), F.lit(None))

    return F.flatten(F.transform(bands, lambda b: F.transform(F.sequence(F.lit(0), F.size(b["xs"]) - 2), lambda col: cell(b, col))))


def _placed(words: Column, bands: Column, tops: Column) -> Column:
    """An entry for each word within the table. A word on an edge between rows or columns belongs to what follows, one on the last edge to what is before."""
    before = lambda edges, v: F.least(F.size(F.filter(edges, lambda e: e <= v)), F.size(edges) - 1) - 1

    def place(w: Column, r: Column) -> Column:
        level = w["turn"] == 0
        word = F.struct(F.when(level, w["cy"]).otherwise(w["turn"] * w["cx"]), F.when(level, w["cx"]).otherwise(-w["turn"] * w["cy"]), w["w"], w["slack"])
        return F.when(w["cx"].between(r["xs"][0], F.element_at(r["xs"], -1)), _entry(r["row"], before(r["xs"], w["cx"]), ~level, F.lit(None), word))

    within = F.filter(F.coalesce(words, F.array()), lambda w: w["cy"].between(tops[0], F.element_at(tops, -1)))
    return F.filter(F.transform(within, lambda w: once(F.get(bands, before(tops, w["cy"])), lambda r: place(w, r))), lambda e: e.isNotNull())


def _lines(words: Column) -> Column:
    """Texts of the lines that words of one direction make, in order: a word further across than its slack begins a line."""
    text = lambda ws: F.array_join(F.transform(F.array_sort(F.transform(ws, lambda w: F.struct(w["along"], w["w"]))), lambda x: x["w"]), " ")

    def cut(ws: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(0), F.size(ws) - 1), lambda i: F.coalesce(F.get(ws, i)["across"] - F.get(ws, i - 1)["across"] > F.get(ws, i)["slack"], F.lit(True)))
        return once(starts, lambda at: F.transform(at, lambda s, k: text(F.slice(ws, s + 1, F.coalesce(F.get(at, k + 1), F.size(ws)) - s))))

    return once(F.array_sort(words), lambda ws: F.when(F.size(ws) > 0, cut(ws)).otherwise(F.array().cast("array<string>")))


def ruled_cells(segments: DataFrame, words: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, row, col, x0, y0, x1, y1, open_below, text) of each page's ruled table, for grids.read_ruled.

    segments: keys, x0, y0, x1, y1; words: keys, x0, y0, x1, y1, text, turn, with turn 0 for upright words, 1 for those that read upwards, -1 for those that read
    downwards. A word belongs to the cell that holds its centre. Upright words make lines from top to bottom, turned ones follow, side by side as
    they read; in cells narrower than NARROW words that break over lines are rejoined. Cells without words have an empty text. Null words count as
    empty. A page whose lines make no table gives nothing; so do empty inputs. A page's words are gathered, as its lines are, and meet its lattice in one
    join, which is never a broadcast.
    """
    cx, cy, turn = (F.col("x0") + F.col("x1")) / 2, (F.col("y0") + F.col("y1")) / 2, F.coalesce("turn", F.lit(0))
    slack = F.when(turn == 0, WAVER * F.greatest(F.col("y1") - F.col("y0"), F.lit(LONG))).otherwise(F.lit(3.0))
    word = F.struct(cx.alias("cx"), cy.alias("cy"), turn.alias("turn"), slack.alias("slack"), F.coalesce("text", F.lit("")).alias("w"))
    gathered = words.dropna(subset=keys).groupBy(*keys).agg(F.collect_list(word).alias("_words"))
    # merge: Spark's guess of a size knows nothing of the arrays' lengths, and what is broadcast has to fit the driver
    pages = lattice(segments, keys).hint("merge").join(gathered.hint("merge"), keys, "left")
    page = F.struct(_bands().alias("bands"), F.transform("rows", lambda e: e["pos"]).alias("tops"))
    entries = pages.select(*keys, F.inline(once(page, lambda p: F.concat(_cells(p["bands"]), _placed(F.col("_words"), p["bands"], p["tops"])))))
    cells = entries.groupBy(*keys, "row", "col").agg(F.first("cell", ignorenulls=True).alias("_c"), *(F.collect_list(F.when(F.col("turned") == t, F.col("word"))).alias(name) for t, name in ((False, "_level"), (True, "_turned"))))
    cells = cells.select(*keys, "row", "col", "_c.*", _lines(F.col("_level")).alias("_lines"), _lines(F.col("_turned")).alias("_more"))
    upright = F.when(F.col("x1") - F.col("x0") < NARROW, merge_wrapped(F.col("_lines"))).otherwise(F.col("_lines"))
    return cells.select(*keys, "row", "col", "x0", "y0", "x1", "y1", "open_below", F.coalesce(collapse(F.array_join(F.concat(upright, "_more"), " ")), F.lit("")).alias("text"))
