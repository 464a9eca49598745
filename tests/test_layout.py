"""Ruled tables, glyphs in boxes and tables that go on, against plain walks."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tarnwork import shared
from tarnwork.operators import fields, grids, headings, ruled, stitching
from tarnwork.plans import catalog

SEGMENT = "doc_id int, page int, x0 double, y0 double, x1 double, y1 double"
WORD = f"{SEGMENT}, text string, turn int"


def box_lines(xs, ys, skip=()):
    """Every edge of every cell of a lattice as a line of its own, some of them left out."""
    out = []
    for i, j in itertools.product(range(len(xs)), range(len(ys) - 1)):
        if ("v", i, j) not in skip:
            out.append((xs[i], ys[j], xs[i], ys[j + 1]))
    for i, j in itertools.product(range(len(xs) - 1), range(len(ys))):
        if ("h", i, j) not in skip:
            out.append((xs[i], ys[j], xs[i + 1], ys[j]))
    return out


def plain_cells(xs, ys, skip):
    out = []
    for r in range(len(ys) - 1):
        edges = [x for i, x in enumerate(xs) if i in (0, len(xs) - 1) or ("v", i, r) not in skip]
        for c, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
            at = next(i for i in range(len(xs) - 1) if xs[i] <= (a + b) / 2 <= xs[i + 1])
            out.append((r, c, a, b, ys[r], ys[r + 1], ("h", at, r + 1) in skip))
    return out


def test_lattices_with_merged_cells(spark):
    rng = random.Random(12)
    segments, want = [], []
    for page in range(25):
        xs = list(itertools.accumulate([10.0, *(float(rng.randrange(20, 60)) for _ in range(rng.randrange(3, 7)))]))
        ys = list(itertools.accumulate([50.0, *(float(rng.randrange(12, 30)) for _ in range(rng.randrange(3, 8)))]))
        inner = [("v", i, j) for i in range(1, len(xs) - 1) for j in range(len(ys) - 1)] + [("h", i, j) for i in range(len(xs) - 1) for j in range(1, len(ys) - 1)]
        skip = set(rng.sample(inner, len(inner) // 8))
        cover = lambda kind, k: sum(hi - lo for at, (lo, hi) in enumerate(zip(*((ys, ys[1:]) if kind == "v" else (xs, xs[1:])), strict=False)) if ((kind, k, at) if kind == "v" else (kind, at, k)) not in skip)  # noqa: B023, E731
        if any(cover("v", i) < 0.3 * (ys[-1] - ys[0]) for i in range(len(xs))) or any(cover("h", j) < 0.3 * (xs[-1] - xs[0]) for j in range(len(ys))):
            continue
        jitter = lambda: rng.choice([0.0, 0.3, -0.3])
        for a, b, c, d in box_lines(xs, ys, skip):
            dx, dy = (jitter(), 0.0) if a == c else (0.0, jitter())
            line = (a + dx, b + dy, c + dx, d + dy)
            segments.append((1, page, *(line if rng.random() < 0.5 else (line[2], line[3], line[0], line[1]))))
        segments.append((1, page, 0.0, 5.0, 300.0, 5.0))  # a line under the running header
        segments.append((1, page, 0.0, 400.0, 90.0, 480.0))  # a slanted one
        want += [(page, *c) for c in plain_cells(xs, ys, skip)]
    got = ruled.ruled_cells(spark.createDataFrame(segments, SEGMENT), spark.createDataFrame([], WORD), ["doc_id", "page"])
    rows = sorted((r.page, r.row, r.col, round(r.x0), round(r.x1), round(r.y0), round(r.y1), r.open_below) for r in got.collect())
    assert len(want) > 200 and rows == sorted((p, r, c, round(a), round(b), round(y), round(z), o) for p, r, c, a, b, y, z, o in want)


def test_text_of_cells(spark):
    lines = spark.createDataFrame([(1, 1, *x) for x in box_lines([0.0, 60.0, 100.0, 200.0], [0.0, 40.0, 80.0, 120.0])], SEGMENT)
    at = lambda x, y, t, turn=0: (1, 1, float(x), float(y), x + 8.0, y + 8.0, t, turn)
    words = [at(30, 4, "b"), at(10, 5, "a"), at(10, 20, "c"), at(64, 4, "Screen"), at(64, 16, "ing"), at(110, 4, "Screen"), at(110, 16, "ing"), at(80, 70, "up", 1), at(80, 55, "wards", 1), at(70, 60, "first", 1), at(110, 45, "down", -1), at(110, 60, "wards", -1), at(130, 50, "top", -1), at(300, 10, "outside"), (1, 1, 10.0, 90.0, 18.0, 98.0, None, None), at(70, 96, "x"), (2, 1, 1.0, 1.0, 2.0, 2.0, "no table", 0)]
    got = ruled.ruled_cells(lines, spark.createDataFrame(words, WORD), ["doc_id", "page"]).collect()
    assert {(r.row, r.col): r.text for r in got if r.text} == {(0, 0): "a b c", (0, 1): "Screening", (0, 2): "Screen ing", (1, 1): "first up wards", (1, 2): "top down wards", (2, 1): "x"}
    assert len(got) == 9


def test_pages_without_tables(spark):
    lines = [(1, 1, 0.0, 0.0, 50.0, 0.0), (1, 2, 0.0, 0.0, 0.0, 50.0), *((1, 3, *x) for x in box_lines([0.0, 60.0], [0.0, 40.0]))]
    words = spark.createDataFrame([(1, 1, 0.0, 0.0, 5.0, 5.0, "w", 0)], WORD)
    assert ruled.ruled_cells(spark.createDataFrame(lines, SEGMENT), words, ["doc_id", "page"]).count() == 0
    assert ruled.ruled_cells(spark.createDataFrame([], SEGMENT), words, ["doc_id", "page"]).count() == 0


def test_from_rules_to_marks(spark):
    lines = spark.createDataFrame([(1, 1, *x) for x in box_lines([0.0, 60.0, 100.0, 140.0], [0.0, 20.0, 40.0, 60.0, 80.0], {("v", 2, 0), ("v", 2, 3)})], SEGMENT)
    at = lambda x, y, t: (1, 1, float(x), float(y), x + 8.0, y + 8.0, t, 0)
    words = [at(90, 4, "Treatment"), at(65, 24, "D1"), at(105, 24, "D2"), at(5, 44, "ECG"), at(105, 44, "X"), at(5, 64, "Labs"), at(96, 64, "X")]
    cells = ruled.ruled_cells(lines, spark.createDataFrame(words, WORD), ["doc_id", "page"])
    got = sorted((r.activity, r.epoch, r.visit) for r in grids.read_ruled(cells, ["doc_id", "page"]).collect())
    assert got == [("ECG", "Treatment", "D2"), ("Labs", "Treatment", "D1"), ("Labs", "Treatment", "D2")]


def test_glyphs_of_a_crowded_page(spark):
    """100,000 glyphs and 10,000 boxes of all sizes on one page; the pairs that meet are far fewer than the page has."""
    rng = random.Random(7)
    boxes = []
    for b in range(10_000):
        x, y, w = rng.uniform(-500, 2000), rng.uniform(-500, 2000), rng.choice([0.0, 2.0, 8.0, 20.0])
        boxes.append((1, b, x, y, x + w, y + w * rng.random()))
    boxes += [(1, 10_000, -600.0, -600.0, 3000.0, 3000.0), (1, 10_001, 5.0, 5.0, 1.0, 9.0), (2, 10_002, 0.0, 0.0, 1.0, 1.0)]
    glyphs = spark.range(100_000).select(F.lit(1).alias("page"), (F.col("id") % 400 * 5.0 - 200).alias("x0"), (F.col("id") / 400 * 6.0 - 200).cast("double").alias("y0")).selectExpr("page", "x0", "y0", "x0 + 4 AS x1", "y0 + 4 AS y1", "'g' AS text")
    table = spark.createDataFrame(boxes, "page int, box_id int, x0 double, y0 double, x1 double, y1 double")
    got = {r.box_id: r.n for r in grids.in_boxes(glyphs, table, ["page"]).groupBy("box_id").agg(F.count("*").alias("n")).collect()}
    import numpy as np

    g = glyphs.toPandas()
    cx, cy = ((g.x0 + g.x1) / 2).to_numpy(), ((g.y0 + g.y1) / 2).to_numpy()
    order = np.argsort(cx)
    cx, cy = cx[order], cy[order]
    want = {}
    for page, b, x0, y0, x1, y1 in boxes:
        lo, hi = np.searchsorted(cx, x0, "left"), np.searchsorted(cx, x1, "right")
        n = int(((cy[lo:hi] >= y0) & (cy[lo:hi] <= y1)).sum()) if page == 1 and x0 <= x1 else 0
        if n:
            want[b] = n
    assert got == want


@pytest.mark.parametrize(
    "first, then, verdict, repeated",
    [
        (dict(), dict(), "CONTINUATION", 1),
        (dict(header=[["A", "B"], ["1", "2"]]), dict(header=[["a ", "B (cont'd)"], ["1", "2"]]), "CONTINUATION", 2),
        (dict(), dict(caption="Table 4"), "AMBIGUOUS", 0),
        (dict(), dict(caption="Table 3 (contd)"), "CONTINUATION", 1),
        (dict(), dict(edges=[0.0, 20.0, 90.0]), "AMBIGUOUS", 0),
        (dict(), dict(edges=[7.0, 57.0, 97.0]), "CONTINUATION", 1),
        (dict(), dict(edges=None), "CONTINUATION", 1),
        (dict(), dict(page=3), "SEPARATE", 0),
        (dict(), dict(page=1, y0=200.0), "SEPARATE", 0),
        (dict(), dict(header=[["X", "Y"]]), "AMBIGUOUS", 0),
        (dict(), dict(header=[["X", "Y"]], edges=[0.0, 20.0, 90.0]), "SEPARATE", 0),
        (dict(), dict(header=[["X", "Y"]], edges=None), "SEPARATE", 0),
        (dict(), dict(header=[["X", "Y"]], cue=True), "CONTINUATION", 0),
        (dict(), dict(header=[["X", "Y"]], cue=True, edges=None), "AMBIGUOUS", 0),
        (dict(header=[["A", "B", "C"]], edges=None), dict(header=[["A", "B", "N", "C"]], edges=None), "AMBIGUOUS", 0),
        (dict(header=[["A", "B"]]), dict(header=[["", ""]]), "AMBIGUOUS", 0),
        (dict(header=None, edges=None), dict(header=None, edges=None), "SEPARATE", 0),
    ],
)
def test_verdicts(spark, first, then, verdict, repeated):
    usual = dict(doc_id=1, table_ix=0, page=1, y0=0.0, edges=[0.0, 50.0, 90.0], header=[["A", "B"]], caption=None, cue=False)
    rows = [usual | first, usual | dict(table_ix=1, page=2) | then]
    names = list(usual)
    table = spark.createDataFrame([tuple(r[c] for c in names) for r in rows], "doc_id int, table_ix int, page int, y0 double, edges array<double>, header array<array<string>>, caption string, cue boolean")
    got = stitching.stitch(table).orderBy("table_ix").collect()
    assert (got[1].verdict, got[1].repeated, got[1].chain) == (verdict, repeated, 0 if verdict == "CONTINUATION" else 1)


def test_a_chain_keeps_its_header(spark):
    """The third page repeats fewer rows than the second did; the fourth meets the third."""
    two, one = [["A", "B"], ["1", "2"], ["p", "q"]], [["A", "B"], ["x", "y"], ["r", "s"]]
    rows = [(1, k, k, 0.0, [0.0, 50.0, 90.0], h, None, False) for k, h in enumerate([two, [["A", "B"], ["1", "2"], ["s", "t"]], one, one])]
    table = spark.createDataFrame(rows, "doc_id int, table_ix int, page int, y0 double, edges array<double>, header array<array<string>>, caption string, cue boolean")
    got = [tuple(r)[2:] for r in stitching.stitch(table).orderBy("table_ix").collect()]
    assert got == [(0, "SEPARATE", 0), (0, "CONTINUATION", 2), (1, "AMBIGUOUS", 0), (1, "CONTINUATION", 3)]


def test_headings_look_ahead(spark):
    rows = [
        (1, "Synopsis", "heading"), (1, "1 Introduction ............ 5", "prose"), (2, "1 Introduction", "prose"), (2, "1.1 Background", "prose"), (3, "2 Documented status of the disease", "prose"), (3, "as in 1.1 Background", "prose"), (3, "3.1 Objectives", "prose"),
        (4, "1 Provision of consent", "heading"), (5, "4 STUDY DESIGN", "prose"), (5, "45 Milligrams of it", "prose"), (6, "5 Selection", "prose"), (6, "Some prose in between.", "prose"), (6, "STUDY POPULATION", "prose"), (6, "5.1 Inclusion Criteria", "prose"),
        (7, "Study Protocol", "heading"), (8, "Study Protocol", "heading"), (9, "Study Protocol", "heading"), (10, "Appendix A: Abbreviations and Terms", "prose"), (10, "6 ends with a stop.", "prose"), *((11, f"7.{k} Contents Line", "prose") for k in range(1, 8)), (12, None, "heading"), (12, "7 Statistics", "heading"),
    ]
    table = spark.createDataFrame([(1, i, *r) for i, r in enumerate(rows)], "doc_id long, ord int, page int, text string, kind string")
    got = [(r.number, r.title, r.level) for r in headings.document_headings(table).orderBy("ord").collect()]
    assert got == [("", "Synopsis", 1), ("1", "Introduction", 1), ("1.1", "Background", 2), ("3.1", "Objectives", 2), ("1", "Provision of consent", 1), ("4", "STUDY DESIGN", 1), ("5", "Selection", 1), ("", "STUDY POPULATION", 2), ("5.1", "Inclusion Criteria", 2), ("", "Appendix A: Abbreviations and Terms", 1), ("7", "Statistics", 1)]
    assert headings.document_headings(table.limit(0)).count() == 0


def test_invariants_of_what_is_there_and_what_is_not(spark):
    make = spark.createDataFrame
    studies = make([(1, True, True), (2, False, False), (3, True, True)], "study_id int, has_slot boolean, has_grid boolean")
    visits = make([(1, k, f"Visit {k}", "Treatment") for k in range(3)] + [(3, 0, "V1", None), (3, 1, "V1", "x")], "study_id int, visit int, name string, epoch string")
    activities = make([(1, k, f"a{k}") for k in range(5)] + [(3, 0, None)], "study_id int, activity int, name string")
    marks = make([(1, k, k % 3) for k in range(5)] + [(3, 0, 7)], "study_id int, activity int, visit int")
    criteria = make([(1, "inclusion", "Adults of any sex"), (1, "exclusion", "Trisomy 21"), (3, "inclusion", "no")], "study_id int, category string, text string")
    aims = make([(1, "Primary", "to see whether it works", 1), (3, "Secondary", None, 0)], "study_id int, level string, objective string, n_endpoints int")
    got = {}
    for r in fields.study_invariants(studies, visits, activities, marks, criteria, aims).collect():
        got.setdefault(r.study_id, {})[r.invariant] = r.holds
    assert len(got[1]) == 18 and all(got[1].values())
    assert len(got[2]) == 11 and not any(got[2].values())
    assert {k for k, v in got[3].items() if v} == {"slot_found", "grid_found", "has_inclusion", "table_found", "most_activities_are_scheduled"}


def test_boxes_by_pairs_and_by_walk():
    rng = np.random.default_rng(5)
    for n in (1, 2, 7, 60, 200):
        lines = rng.integers(0, 60, (4, n)).astype(float)
        lines[2:] = lines[:2] + rng.integers(0, 9, (2, n)) * (rng.random((2, n)) < 0.5)
        lines = lines[:, np.lexsort(lines[::-1])]
        assert (stitching._touching(lines[:, None], 0.5)[0] == stitching._walked(lines, 0.5)).all()


def test_a_lattice_gathers_its_rules_once(spark):
    segments = spark.createDataFrame([(1, 0.0, 0.0, 9.0, 0.0)], "doc_id int, x0 double, y0 double, x1 double, y1 double")
    plan = ruled.lattice(segments, ["doc_id"])._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "MapInPandas" not in plan


def test_cells_are_numbered_without_joins(spark):
    """Columns without a text go, in one exchange; cells of a chain meet their tables in one join."""
    rows = [(1, 0, 0, "a"), (1, 0, 1, " "), (1, 0, 2, "b"), (1, 1, 1, None), (1, 1, 2, ""), (2, 0, 5, "c")]
    out = grids.drop_empty_columns(spark.createDataFrame(rows, "k int, row int, col int, text string"), ["k"])
    assert sorted(map(tuple, out.collect()), key=str) == [(1, 0, 0, "a"), (1, 0, 1, "b"), (1, 1, 1, ""), (2, 0, 0, "c")]
    assert "Join" not in out._jdf.queryExecution().optimizedPlan().toString()
    cells = spark.createDataFrame(rows, "doc_id int, row int, col int, text string").withColumn("table_ix", F.lit(0))
    chains = spark.createDataFrame([(1, 0, 0, 1), (2, 0, 0, 0)], "doc_id int, table_ix int, chain int, repeated int")
    made = stitching.stitched_cells(cells, chains)
    assert [tuple(r) for r in made.collect()] == [(2, 0, 0, 0, "c", 0)]
    assert made._jdf.queryExecution().optimizedPlan().toString().count("Join") == 1


def test_ruled_schedules_gather_their_cells_once(spark):
    """A spanning header and mark, a repeated label, a schedule without marks; of equal rows the first gives the columns."""
    row = lambda k, row, *cells: [(k, row, i, float(x0), float(x1), t) for i, (x0, x1, t) in enumerate(cells)]
    rows = row(1, 0, (0, 10, None), (10, 30, " On "), (30, 40, "Off")) + row(1, 1, (0, 10, ""), (10, 20, "D1"), (20, 30, "D2"), (30, 40, "")) + row(1, 2, (0, 10, "ECG "), (10, 20, "x"), (20, 30, "Exam"), (30, 40, "✓")) + row(1, 3, (0, 10, "Labs"), (10, 30, "X a"), (30, 40, ""))
    rows += row(2, 0, (0, 10, "a"), (10, 20, "Exam")) + row(3, 0, (0, 10, "b"), (10, 20, "x")) + [(3, 0, 0, 0.0, 10.0, "c"), (None, 0, 0, 0.0, 10.0, "d"), (None, 0, 1, 10.0, 20.0, "x")]
    out = grids.read_ruled(spark.createDataFrame(rows, "k int, row int, col int, x0 double, x1 double, text string"), ["k"])
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, out.collect())) == [(1, 2, "ECG", 1, "On", "D1"), (1, 2, "ECG", 3, "Off", ""), (1, 3, "Labs", 1, "On", "D1"), (1, 3, "Labs", 2, "On", "D2"), (3, 0, "b", 1, "", ""), (3, 0, "c", 1, "", "")]
    assert "Join" not in plan and "Window" not in plan and plan.count("Exchange") == 1


def test_parts_hold_a_number_of_rows(spark):
    assert shared.spread(spark.range(100).toDF("k"), ["k"], most=4).rdd.getNumPartitions() == 25


def test_document_headings_shuffle_lines_once(spark):
    plan = catalog.QUERIES["document_headings"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1


def test_ruled_cells_broadcast_nothing(spark):
    """Small tables too meet in one join that passes nothing through the driver; words without a page or a table go, pages without words stay."""
    lines = [(page, *x) for page in (1, 2, None) for x in box_lines([0.0, 60.0, 100.0, 200.0], [0.0, 40.0, 80.0])]
    words = [(k, x, 10.0, x + 8.0, 18.0, t, None) for k, x, t in ((1, 96.0, "on an edge"), (1, 196.0, "on the last"), (1, 10.0, "b"), (1, 5.0, "a"), (3, 5.0, "no table"), (None, 5.0, "no page"))]
    out = ruled.ruled_cells(spark.createDataFrame(lines, SEGMENT.replace(" page int,", "")), spark.createDataFrame(words, WORD.replace(" page int,", "")), ["doc_id"])
    got = out.collect()
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert {(r.doc_id, r.row, r.col): r.text for r in got if r.text} == {(1, 0, 0): "a b", (1, 0, 2): "on an edge on the last"} and len(got) == 12
    assert "Broadcast" not in plan and out._jdf.queryExecution().optimizedPlan().toString().count("Join") == 1
