"""Small cases of single operators, with ties, nulls and empty groups."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tarnwork.functions import text as T
from tarnwork.operators import audit, blocks, calibration, folds, graphs, grids, matching, scoring, sections, stitching, voting
from tarnwork.plans import assembly, log_queries
from tarnwork.sources import files
from tarnwork.streaming import log


def values(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_scalars(spark):
    rows = spark.createDataFrame([("Week 2 ± 3 days", "", "É naïve  Phase II, phase 2, Phase 1"), (None, None, None)], "t string, e string, p string")
    got = rows.select(T.day_value(F.col("t")), T.visit_window(F.col("t"))["before"], T.jaccard(T.tokens(F.col("e")), T.tokens(F.col("e")), 1.0), F.array_join(T.phases(F.col("p")), ","), T.norm_words(F.col("p"))).collect()
    assert tuple(got[0]) == (14, 3, 1.0, "2,1", "é naïve phase ii phase 2 phase 1") and tuple(got[1]) == (None, 0, 1.0, "", None)
    cells = spark.createDataFrame([("Exam",), ("x",), ("X 1",), ("✓",), (None,)], "c string")
    assert [tuple(r) for r in cells.select(T.mark_anywhere(F.col("c")), T.mark_first(F.col("c"))).collect()] == [(True, False), (True, True), (True, True), (True, True), (False, False)]
    cues = spark.createDataFrame([("Table 3 continued",), ("discontinued",), ("Table 4",)], "c string")
    assert [tuple(r) for r in cues.select(T.continued(F.col("c")), T.caption(F.col("c"))).collect()] == [(True, False), (False, False), (False, True)]


def test_scores(spark):
    rows = spark.createDataFrame([("a", "A.", "scalar"), ("5.5", "5", "number"), ("9", "5", "number"), (None, "x", "scalar"), ("a b c", "a b d", "long_text"), ("x", "y", "scalar")], "p string, l string, k string")
    got = [tuple(r[0]) for r in rows.select(T.score_value(F.col("p"), F.col("l"), F.col("k"))).collect()]
    assert got == [("normalized", 1.0), ("fuzzy", 0.9), ("mismatch", 0.0), ("absent", 0.0), ("fuzzy", 0.5), ("mismatch", 0.0)]


def test_quotes(spark):
    docs = spark.createDataFrame([(1, "say ‘the  ﬁrst of all these words’ now"), (2, "nothing"), (3, None)], "doc_id long, text string")
    quotes = spark.createDataFrame([(1, "the first of all these words"), (2, "say"), (3, " "), (4, "absent words that are not in here")], "quote_id long, quote string")
    assert values(voting.resolve_quotes(docs, quotes)) == [(1, 1, "normalized", 5), (1, 2, "exact", 0)]


def test_vote_ties_and_failed(spark):
    c = [(1, "b", "r", False, "neutral", 2), (1, "a", "r", False, "neutral", 1), (2, "x", "m1", True, "failed", 1), (3, "Y ", "m1", True, "neutral", 2), (3, "y", "r", False, "neutral", 1), (3, "z", "m2", True, "confirmed", 0), (4, " ", "r", False, "confirmed", 1)]
    got = {r.k: r for r in voting.vote(spark.createDataFrame(c, "k int, value string, method string, is_model boolean, sanity string, ord int"), ["k"]).collect()}
    assert got[1].value == "a" and not got[1].agree and got[2].value is None and got[3].value == "z" and 4 not in got


def test_log_states(spark):
    rows = [(1, 1, "extract", "a"), (1, 2, "edit", "b"), (1, 3, "certify", "c"), (1, 4, "edit", "d"), (2, 5, "extract", "a")]
    df = spark.createDataFrame(rows, "k int, seq long, event string, value string")
    assert values(audit.latest_by_key(df, ["k"]).select("k", "value")) == [(1, "d"), (2, "a")]
    assert values(audit.as_of(df, ["k"], "value", F.col("event") == "certify", F.col("event") == "edit")) == [(1, 3, "a", "c", True)]
    empty = audit.summarize_distances(df.limit(0).withColumns({"d": F.lit(0.0), "e": F.lit(True)}), "d", "e").first()
    assert tuple(empty) == (0, 0, None, None)


def test_greedy_takes_in_order(spark):
    pairs = spark.createDataFrame([("s", 1, 7, 0.6), ("s", 1, 8, 0.6), ("s", 2, 7, 0.9), ("s", 3, 8, 0.2)], "study string, ref int, item int, similarity double")
    assert values(scoring.greedy_match(pairs, ["study"], 0.3)) == [("s", 1, 7, 0.6)]


def test_greedy_matches_the_whole_key(spark):
    rng = random.Random(4)
    words = ["a", "b", "c", "d", "e"]
    rows = [(rng.choice("xy"), i, sorted(rng.sample(words, rng.randrange(4)))) for i in range(300)]
    df = spark.createDataFrame(rows, "k string, id long, tokens array<string>")
    refs, items = df.filter("id % 3 > 0").withColumnRenamed("id", "ref"), df.filter("id % 3 = 0").withColumnRenamed("id", "item")
    pairs = refs.withColumnRenamed("tokens", "t").join(items, "k").select("k", "ref", "item", T.jaccard(F.col("t"), F.col("tokens")).alias("similarity"))
    assert values(scoring.greedy_match_sets(refs, items, ["k"], 0.3)) == values(scoring.greedy_match(pairs, ["k"], 0.3))


def test_rare_tokens_lose_no_pair(spark):
    rng = random.Random(8)
    sets = [(rng.randrange(2), sorted({"the", *rng.choices([f"w{k}" for k in range(30)], k=rng.randrange(7))} if rng.random() < 0.9 else set())) for _ in range(150)]
    for t in (0.3, 0.5, 0.8, 1.0):
        rows = graphs.rare_tokens(spark.createDataFrame(sets, "k int, tokens array<string>"), ["k"], t).collect()
        rare = {}
        for r in rows:
            rare.setdefault((r.k, tuple(r.tokens)), set()).add(r.token)
        met = 0
        for (k, x), (j, y) in itertools.combinations({(k, tuple(s)) for k, s in sets if s}, 2):
            share = bool(rare[k, x] & rare[j, y])
            met += share and k == j
            assert k != j or share or len({*x} & {*y}) / len({*x} | {*y}) < t
        assert t < 0.8 or met < 1500  # a word that all have brings few together


def test_components_of_long_paths(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, 102), (102, 101), (200, 200)]
    got = {r.node: r.component for r in graphs.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(41), 0), **dict.fromkeys((100, 101, 102), 100), 200: 200}


def test_greedy_walks_parts_of_a_key_by_themselves(spark, monkeypatch):
    """A third of all rows in one key: the walks see its components, and no pair is lost."""
    rng, seen = random.Random(6), []
    text = lambda key: [f"{rng.randrange(40)}-{k}" for k in range(3)] if key else sorted({f"t{c}-{rng.randrange(4)}" for c in [rng.randrange(60)] * 3})
    refs = [(0 if i % 3 == 0 else 1 + i % 50, i, text(i % 3)) for i in range(600)]
    items = [(0 if i % 3 == 0 else 1 + i % 50, i, text(i % 3)) for i in range(600)]
    tables = [spark.createDataFrame(rows, f"k int, {name} int, tokens array<string>") for rows, name in ((refs, "ref"), (items, "item"))]
    got = scoring.greedy_match_sets(*tables, ["k"], 0.4)
    want, used = [], set()
    for k, r, t in sorted(refs):
        best = max(((len({*t} & {*u}) / len({*t} | {*u}), -i) for j, i, u in items if j == k and (k, i) not in used), default=(0, 0))
        if best[0] >= 0.4:
            used.add((k, -best[1]))
            want.append((k, r, -best[1], best[0]))
    assert sorted(map(tuple, got.collect())) == sorted(want) and len([w for w in want if w[0] == 0]) > 100
    real = scoring.fold
    monkeypatch.setattr(scoring, "fold", lambda rows, keys, *a: (seen.append(rows.groupBy(*keys).count().agg(F.max("count")).first()[0]), real(rows, keys, *a))[1])
    scoring.greedy_match_sets(*tables, ["k"], 0.4)
    assert seen[0] < 40


def test_greedy_query_takes_all_parts_of_a_brand(spark):
    got = values(log_queries.greedy_match(spark, "/root/testdata/sf0.001").select("p_brand", "ref", "item", "similarity"))
    parts = [(r.p_brand, r.p_partkey, r.p_size, set(r.p_name.lower().split())) for r in spark.read.parquet("/root/testdata/sf0.001/part.parquet").orderBy("p_partkey").collect()]
    used, want = set(), []
    for brand, ref, size, own in parts:
        near = [(-len(own & t) / len(own | t), item) for b, item, s, t in parts if b == brand and s <= 25 and item not in used] if size > 25 else []
        if near and -min(near)[0] >= 0.3:
            used.add(min(near)[1])
            want.append((brand, ref, min(near)[1], -min(near)[0]))
    assert got == sorted(want, key=str) and any(ref // 100 != item // 100 for _, ref, item, _ in got)


def test_sections(spark):
    s = spark.createDataFrame([(1, 0, 1, 10.0, 1, "A", "history"), (1, 1, 1, 50.0, 2, "B", None), (1, 2, 2, 20.0, 1, "C", None)], "doc_id long, ord int, page int, y0 double, level int, title string, type string")
    b = spark.createDataFrame([(1, 0, 1, 5.0, 9.0, "x"), (1, 1, 1, 9.8, 9.0, "y"), (1, 2, 2, 90.0, 9.0, "z")], "doc_id long, ord int, page int, y0 double, size double, text string")
    assert values(sections.section_of(b, s, ["title"]).select("ord", "title")) == [(0, None), (1, "A"), (2, "C")]
    nested = sections.nest(s)
    assert values(nested.select("ord", "parent_ord", "page_end")) == [(0, None, 1), (1, 0, 1), (2, None, 2)]
    assert values(sections.inherit(nested, "type").select("ord", "type")) == [(0, "history"), (1, "history"), (2, None)]
    heads = spark.createDataFrame([(1, i, p, n, False) for i, (p, n) in enumerate([(1, "1"), (1, "2"), (2, "1.5"), (2, "2.1"), (3, "3")])] + [(1, 10 + i, 9, str(i), False) for i in range(6)], "doc_id long, ord int, page int, number string, font boolean")
    assert [r.number for r in sections.heading_sequence(heads).orderBy("ord").collect()] == ["1", "2", "2.1", "3"]


def test_grids(spark):
    cells = [("t", r, c, v) for r, line in enumerate([["", "Ep1", "", "Ep2"], ["", "V1", "V2", "V3"], ["", "d1", "d2", "d3"], ["Exam", "x", "", "x"], ["", "", "", ""], ["Lab", "", "x", ""]]) for c, v in enumerate(line)]
    got = grids.parse_schedule(spark.createDataFrame(cells, "id string, row int, col int, text string"), ["id"])
    assert values(got.filter("marked").select("activity", "epoch", "visit", "timing")) == [("Exam", "Ep1", "V1", "d1"), ("Exam", "Ep2", "V3", "d3"), ("Lab", "Ep1", "V2", "d2")]
    short = spark.createDataFrame([c for c in cells if c[1] < 3], "id string, row int, col int, text string")
    assert grids.parse_schedule(short, ["id"]).count() == 0


def test_stitching(spark):
    e, f = [10.0, 50.0, 90.0], [10.0, 90.0]
    rows = [(1, 0, 1, 5.0, e, "h", "Table 1", False), (1, 1, 2, 5.0, [12.0, 52.0, 92.0], "h", None, False), (1, 2, 3, 5.0, f, "h", None, True), (1, 3, 9, 5.0, e, "h", None, True)]
    got = stitching.stitch(spark.createDataFrame(rows, "doc_id long, table_ix int, page int, y0 double, edges array<double>, header string, caption string, cue boolean"))
    assert values(got) == [(1, 0, 0, "SEPARATE", 0), (1, 1, 0, "CONTINUATION", 1), (1, 2, 1, "AMBIGUOUS", 0), (1, 3, 2, "SEPARATE", 0)]
    cells = spark.createDataFrame([(1, t, r, c, v) for t in range(2) for r, row in enumerate((["h", "", "v"], [f"a{t}", None, "x"])) for c, v in enumerate(row)], "doc_id long, table_ix int, row int, col int, text string")
    assert [tuple(r)[2:] for r in stitching.stitched_cells(cells, got).orderBy("row", "col").collect()] == [(0, 0, "h", 0), (0, 1, "v", 0), (1, 0, "a0", 0), (1, 1, "x", 0), (2, 0, "a1", 1), (2, 1, "x", 1)]
    assert values(stitching.stitching_findings(got)) == [(1, 2, "ambiguous_continuation", "WARNING")]
    lines = spark.createDataFrame([(1, 1, 0.0, 0.0, 10.0, 0.0), (1, 1, 10.0, 0.0, 10.0, 9.0), (1, 1, 50.0, 0.0, 60.0, 0.0)], "doc_id long, page int, x0 double, y0 double, x1 double, y1 double")
    assert values(stitching.ruled_boxes(lines)) == [(1, 1, 0, 0.0, 0.0, 10.0, 9.0, 2), (1, 1, 1, 50.0, 0.0, 60.0, 0.0, 1)]


def test_stitching_by_headers(spark):
    e, f, g = [10.0, 50.0, 90.0], [10.0, 30.0, 90.0], [10.0, 50.0, 90.0, 120.0]
    two, one = [["Visit", "V1"], ["Day", "1"]], [["Visit (continued)", "V1"], ["Lab", "x"]]
    cases = {
        "aligned edges alone": [(1, e, two, None, False), (2, e, [["Lab", "x"]], None, False)],
        "repeated header": [(1, e, two, None, False), (2, e, two, None, False)],
        "same page": [(1, e, two, None, False), (1, e, two, None, False)],
        "fewer header rows": [(1, e, two, None, False), (2, e, two, None, False), (3, e, one, None, False)],
        "other columns": [(1, e, [["Visit", ""]], None, False), (2, e, [["", "Visit"]], None, False)],
        "one column more": [(1, e, [["Visit", "V1"]], None, False), (2, g, [["Visit", "V1", "V2"]], None, False)],
        "cue, unknown edges": [(1, None, two, None, False), (2, None, [["Lab", "x"]], None, True)],
        "header, unknown edges": [(1, None, two, None, False), (2, None, two, None, False)],
        "other widths": [(1, e, two, None, False), (2, f, two, None, False)],
        "new caption": [(1, e, two, None, False), (2, e, two, "Table 2", True)],
        "continued caption": [(1, e, two, None, False), (2, e, two, "Table 1 (continued)", True)],
        "blank header": [(1, e, [["", ""]], None, False), (2, f, [["", ""]], None, False)],
    }
    rows = [(name, i, page, float(i), edges, header, caption, cue) for name, own in cases.items() for i, (page, edges, header, caption, cue) in enumerate(own)]
    got = stitching.stitch(spark.createDataFrame(rows, "doc_id string, table_ix int, page int, y0 double, edges array<double>, header array<array<string>>, caption string, cue boolean"))
    last = {r.doc_id: r.verdict for r in got.orderBy("table_ix").collect()}
    assert {k for k, v in last.items() if v == "CONTINUATION"} == {"repeated header", "header, unknown edges", "continued caption"}
    assert {k for k, v in last.items() if v == "SEPARATE"} == {"same page", "blank header"}


def test_binomial_bounds():
    from math import comb

    for k, m, p in ((0, 10, 0.1), (3, 47, 0.2), (46, 47, 0.5)):
        assert calibration.binom_cdf(k, m, p) == pytest.approx(sum(comb(m, i) * p**i * (1 - p) ** (m - i) for i in range(k + 1)))
    assert calibration.binom_cdf(5, 5, 0.3) == 1 and calibration.binom_cdf(0, 0, 0.3) == 1
    up = calibration.clopper_pearson_upper(2, 50, 0.1)
    assert calibration.binom_cdf(2, 50, up) == pytest.approx(0.1, abs=1e-6)


def test_calibration(spark):
    rng = random.Random(1)
    rows = [(rng.random(),) for _ in range(600)]
    df = spark.createDataFrame([(s, rng.random() < 0.3 + 0.7 * s) for (s,) in rows], "score double, correct boolean")
    bound = calibration.calibrate(df, "score", "correct", alpha=0.25, grid=(0.8, 0.6, 0.4)).first()
    assert bound.emitted and bound.k <= 0.25 * bound.m
    assert not calibration.calibrate(df, "score", "correct", alpha=0.25).first().emitted  # few rows reach 0.99, the first of the usual grid
    assert not calibration.calibrate(df.limit(20), "score", "correct", alpha=0.25, grid=(0.8, 0.6)).first().emitted


def test_logistic_is_the_optimum(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(0, 1, (200, 2))
    y = rng.random(200) < 1 / (1 + np.exp(-(0.5 + x @ [1.0, -2.0])))
    df = spark.createDataFrame([(float(a), float(b), bool(c)) for (a, b), c in zip(x, y, strict=True)], "a double, b double, y boolean")
    w = calibration.fit_logistic(df, ["a", "b"], "y", l2=1.0)
    full = np.column_stack([np.ones(200), x])
    gradient = full.T @ (y - 1 / (1 + np.exp(-full @ w))) - np.array([0, 1, 1]) * w
    assert np.abs(gradient).max() < 1e-6


def test_calibration_is_out_of_fold(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(0, 1, 60)
    y = (rng.random(60) < 1 / (1 + np.exp(-2 * x))).astype(float)

    def newton(z, t, l2):
        full, w = np.column_stack([np.ones(len(z)), z]), np.zeros(2)
        for _ in range(50):
            p = 1 / (1 + np.exp(-full @ w))
            w = w + np.linalg.solve((full.T * (p * (1 - p))) @ full + np.diag([0, l2]), full.T @ (t - p) - np.array([0, l2]) * w)
        return w

    place = np.arange(60)
    for group, mode, fold in ((None, "kfold", place % 5), ("g", "groups", place // 25)):
        df = spark.createDataFrame([(int(i), float(a), bool(b), int(i) // 25) for i, (a, b) in enumerate(zip(x, y, strict=True))], "i int, x double, y boolean, g int").repartition(3)
        z = np.zeros(60)
        for f in np.unique(fold):
            w = newton(x[fold != f], y[fold != f], 1.0)
            z[fold == f] = w[0] + w[1] * x[fold == f]
        want = newton(z, np.where(y > 0.5, (y.sum() + 1) / (y.sum() + 2), 1 / ((1 - y).sum() + 2)), 1e-6)
        weights, platt, got = calibration.fit_calibrated(df, ["x"], "y", ["i"], group)
        assert got == mode and weights == pytest.approx(newton(x, y, 1.0), abs=1e-6) and platt == pytest.approx((want[1], want[0]), abs=1e-5)
    assert calibration.fit_calibrated(df.filter("i < 9"), ["x"], "y", ["i"])[2] == "in_sample"


def test_a_thousand_groups_are_fitted_side_by_side(spark):
    rng = np.random.default_rng(4)
    n, groups = 4000, 1000
    x, g = rng.normal(0, 1, (n, 2)), np.arange(n) % groups
    y = (rng.random(n) < 1 / (1 + np.exp(0.3 - x @ [1.5, -0.5]))).astype(float)
    rows = [(int(i), f"g{k}" if k else None, float(a), float(b), bool(c)) for i, (k, (a, b), c) in enumerate(zip(g, x, y, strict=True))]
    df = spark.createDataFrame(rows, "i int, g string, a double, b double, y boolean").repartition(4)
    seen = spark.sparkContext.statusTracker()
    mode, placed, k = calibration.folds(df, ["i"], "g")
    spark.sparkContext.setJobGroup("folds", "folds")
    weights = calibration.fit_folds(placed, ["a", "b"], "y", k)
    jobs = len(seen.getJobIdsForGroup("folds"))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert mode == "groups" and k == groups and weights.shape == (groups + 1, 3) and jobs < 60
    full = np.column_stack([np.ones(n), x])
    fold = {r.g: r._fold for r in placed.select("g", "_fold").distinct().collect()}
    for name, out in ((None, 0), ("g7", 7), ("g999", 999)):
        rest = g != out
        gradient = full[rest].T @ (y[rest] - 1 / (1 + np.exp(-full[rest] @ weights[fold[name]]))) - np.array([0, 1, 1]) * weights[fold[name]]
        assert np.abs(gradient).max() < 1e-6
    assert weights[-1] == pytest.approx(calibration.fit_logistic(df, ["a", "b"], "y"), abs=1e-8)


def test_matching(spark):
    c = spark.createDataFrame([(1, 0, 0, "time to first event"), (1, 1, 0, "first event time to"), (1, 1, 1, "other thing")], "doc_id long, member int, ord int, text string")
    assert values(matching.align(c, attributes=("text",)).select("member", "ord", "slot")) == [(0, 0, 0), (1, 0, 0), (1, 1, 1)]
    c = spark.createDataFrame([(1, 0, 0, "time to event", "hazard ratio", None), (1, 1, 0, "survival", "hazard ratio", "all"), (1, 1, 1, "pain", None, "safety set"), (1, 2, 0, "sleep", None, "safety set"), (1, 2, 1, None, "mean", "all")], "doc_id long, member int, ord int, variable string, summary_measure string, population string")
    assert values(matching.align(c).select("member", "ord", "slot")) == [(0, 0, 0), (1, 0, 0), (1, 1, 1), (2, 0, 1), (2, 1, 0)]
    e = spark.createDataFrame([(1, 0, 0, "stop of drug", "a", False), (1, 0, 1, "stop of the drug", "b", True), (1, 0, 2, "death", "b", False), *((2, 0, k, "same", s, True) for k, s in enumerate([None, None, "composite"])), (3, 0, 0, "rescue", "", True)], "doc_id long, slot int, ord int, text string, strategy string, quote_ok boolean")
    assert values(matching.reconcile(e)) == [(1, 0, "stop of the drug", "a", 2), (2, 0, "same", "composite", 3), (3, 0, "rescue", None, 1)]
    assert values(matching.event_findings(matching.clustered_events(e))) == [(1, 0, "death", "GROUNDING", "WARNING"), (3, 0, "rescue", "COMPLETENESS", "WARNING")]


def test_numbers_in_running_text_start_no_item(spark):
    texts = ["1. Age over 18\n2. Dose as in 3. below\n3. Real third\nNext part:", "1. a  2. b 3. c", "5.1. Title\n1. one (>2. 5)\n2. two", "2. no first", "1. one\n3. skipped", None, "", "1. \n2. x"]
    got = sections.split_numbered(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string"))
    assert values(got) == [(0, 1, "Age over 18"), (0, 2, "Dose as in 3. below"), (0, 3, "Real third"), (1, 1, "a"), (1, 2, "b"), (1, 3, "c"), (2, 1, "one (>2. 5)"), (2, 2, "two"), (4, 1, "one 3. skipped"), (7, 1, "x")]


def test_short_quotes_meet_texts_by_words(spark):
    docs = spark.createDataFrame([(1, "A xab cdy z"), (2, "ab\n cd"), (3, "cab"), (4, None), (5, "ab-cd é"), (6, "one two three four")], "doc_id long, text string")
    quotes = spark.createDataFrame([(1, "ab cd"), (2, "b"), (3, "é"), (4, "two three"), (5, "zzz"), (6, " "), (7, "wo three fou"), (8, "ab"), (9, None)], "quote_id long, quote string")
    got = voting.resolve_quotes(docs, quotes)
    assert values(got.select("doc_id", "quote_id", "verify_pass")) == [(1, 1, "exact"), (1, 2, "exact"), (1, 8, "exact"), (2, 1, "normalized"), (2, 2, "exact"), (2, 8, "exact"), (3, 2, "exact"), (3, 8, "exact"), (5, 2, "exact"), (5, 3, "exact"), (5, 8, "exact"), (6, 4, "exact"), (6, 7, "exact")]
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_files(spark, tmp_path):
    for name in ("s1/s1.pdf", "s1/other.pdf", "s2/p.pdf", "s2/p_v2.pdf", "s3/x.pdf", "s3/y.pdf"):
        path = tmp_path / "root" / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(b"x")
    got = {r.study: r.path.rsplit("/", 1)[1] for r in files.studies(spark, str(tmp_path / "root")).collect()}
    assert got == {"s1": "s1.pdf", "s2": "p.pdf"}
    labels = spark.createDataFrame([("s", "d", "f", "1", "number")], "study_id string, domain string, field string, label string, kind string")
    files.write_labels(labels, str(tmp_path / "labels"))
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS"):
        files.write_labels(labels, str(tmp_path / "labels"))
    assert values(files.read_labels(spark, str(tmp_path / "labels"))) == values(labels) and files.read_labels(spark, str(tmp_path / "none")).count() == 0
    files.save_model(spark, str(tmp_path / "model"), '{"w": [1]}')
    assert files.load_model(spark, str(tmp_path / "model")) == '{"w": [1]}'


def test_stream(spark, tmp_path):
    rows = spark.createDataFrame([(1, 1, "a"), (2, 2, "b"), (1, 3, "c")], "k long, seq long, v string")
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    query = log.latest_values(stream, ["k"]).writeStream.outputMode("complete").format("memory").queryName("latest").start()
    query.processAllAvailable()
    query.stop()
    assert values(spark.table("latest")) == [(1, 3, "c"), (2, 2, "b")]


def test_repair_and_models(spark):
    state = spark.createDataFrame([(1, "bad"), (2, "good"), (3, "bad")], "id long, value string")
    bad = lambda df: df.filter("value = 'bad'").select("id")
    fixed, left = assembly.repair(state, ["id"], bad, lambda failed: failed.withColumn("value", F.when(F.col("id") == 1, "fixed")))
    assert values(fixed) == [(1, "fixed"), (2, "good"), (3, "bad")] and values(left) == [(3,)]
    assert assembly.complete(state.withColumn("prompt", F.lit("p")), None).filter("reply is null").count() == 3


def test_generations_are_not_broadcast(spark):
    rows = spark.createDataFrame([(1, 1, None, "a"), (1, 2, 1, None), (1, 3, 2, None), (2, 2, 1, "b")], "doc_id int, ord int, parent_ord int, type string")
    up = rows.selectExpr("doc_id AS _t", "ord AS _n")
    assert all("Broadcast" not in folds._kin(rows, ["doc_id", "ord"], "parent_ord", up, how)._jdf.queryExecution().executedPlan().toString() for how in ("inner", "left_anti"))
    assert sorted((r.doc_id, r.ord, r.type) for r in sections.inherit(rows, "type").collect()) == [(1, 1, "a"), (1, 2, "a"), (1, 3, "a"), (2, 2, "b")]


def test_long_quotes_read_texts_once(spark, tmp_path):
    """Without short quotes texts are neither split into all their words nor read again for those found."""
    spark.createDataFrame([(1, "say one  two three four five now"), (2, "one two three four"), (3, None)], "doc_id long, text string").write.parquet(str(tmp_path / "docs"))
    quotes = spark.createDataFrame([(7, "one two three four five")], "quote_id long, quote string")
    got = voting.resolve_quotes(spark.read.parquet(str(tmp_path / "docs")), quotes)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1
    assert [tuple(r) for r in got.collect()] == [(1, 7, "normalized", 4)]


def test_furniture_is_stripped_without_joins(spark):
    rows = [(1, p, p, 0.0, f"Page {p} of 9") for p in range(1, 7)] + [(1, 10 + p, p, 12.0, f"{'abcdef'[p - 1]} text") for p in range(1, 7)] + [(1, 20, 1, 0.0, None), (None, 0, 1, 0.0, "Page 1 of 9"), (2, 0, 1, 0.0, "Page 1 of 9")]
    rows += [(3, p, p, 0.0, "seldom") for p in range(1, 5)] + [(4, p, p, None, "short") for p in range(1, 7)]
    out = blocks.strip_furniture(spark.createDataFrame(rows, "doc_id int, ord int, page int, y0 double, text string"))
    assert "Join" not in out._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(map(tuple, out.collect()), key=str) == sorted((r for r in rows if not (r[0] == 1 and r[1] < 10)), key=str)
