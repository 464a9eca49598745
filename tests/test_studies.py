"""Titles, features, rubrics and the whole loop on small cases; sinks that no query reads."""

import hashlib
import json
import random

import pytest
from pyspark.sql import functions as F

from tarnwork import schemas
from tarnwork.operators import calibration, features, folds, schedules, scoring, sections, titles, voting
from tarnwork.plans import assembly, catalog, full, routes
from tarnwork.sources import files, runs


def values(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_titles_settle_under_their_parents(spark):
    rows = [(1, 1, None, "Appendix 3 Various"), (1, 2, 1, "Clinical Laboratory Tests"), (1, 3, 2, "Anything"), (1, 4, None, "Summary of Changes"), (1, 5, 4, "Schedule of Activities"), (1, 6, 5, "Detail"), (1, 7, None, "1. Synopsis"), (1, 8, 7, "Schedule of Activities"), (1, 9, 99, None)]
    got = {r.ord: (r.type, r.subtype, r.authority) for r in titles.label_sections(spark.createDataFrame(rows, "doc_id long, ord int, parent_ord int, title string")).collect()}
    assert got[2] == got[3] == ("appendix", "lab_inventory", "assessment_prose")
    assert got[5] == ("assessments", "amendment_history", "soa_table_historic") and got[6][1] == "amendment_history"
    assert got[8] == ("assessments", "soa_main", "soa_table_current") and got[9] == (None, None, None)


def test_labels_come_from_any_depth(spark):
    rows = [(1, k, k - 1 if k else None, "x" if k == 0 else "y" if k == 7 else None) for k in range(12)] + [(2, 0, None, None)]
    got = {(r.doc_id, r.ord): r.label for r in sections.inherit(spark.createDataFrame(rows, "doc_id long, ord int, parent_ord int, label string"), "label").collect()}
    assert [got[1, k] for k in range(12)] == ["x"] * 7 + ["y"] * 5 and got[2, 0] is None


def test_phases(spark):
    texts = ["Phase 1b/2", "phase IIb / III and Phase 2", "a Phase IV trial", "phase i", "phase 5, phasing", None]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(titles.phase_scopes(F.col("t"))).collect()]
    assert got == [["phase_1b", "phase_2"], ["phase_2", "phase_3"], ["phase_4"], ["phase_1"], [], []]


def test_heading_numbers_may_be_odd(spark):
    rows = [(1, 1, 1, "3.", False), (1, 2, 1, None, False), (1, 3, 1, "2.1", True), (1, 4, 1, "2.2.", False), (1, 5, 1, "x", True)]
    got = values(sections.heading_sequence(spark.createDataFrame(rows, "doc_id long, ord int, page int, number string, font boolean")))
    assert [r[1] for r in got] == [1, 3, 4, 5]


def test_running_sums_over_partitions(spark):
    rows = [("a" if i % 3 else None, i, i % 7) for i in range(500)]
    df = spark.createDataFrame(rows, "g string, i int, v int").repartition(7)
    got = {(r.g, r.i): (r.n, r.s) for r in folds.running_sums(df, ["g"], [F.desc("i")], {"n": F.lit(1), "s": F.col("v")}).collect()}
    for g in ("a", None):
        own = sorted((r for r in rows if r[0] == g), key=lambda r: -r[1])
        for k, r in enumerate(own):
            assert got[g, r[1]] == (k + 1, sum(x[2] for x in own[: k + 1]))


def test_binomial_in_constant_memory():
    from math import comb

    for m, p in ((7, 0.3), (60, 0.1), (200, 0.85)):
        for k in range(m):
            assert calibration.binom_cdf(k, m, p) == pytest.approx(sum(comb(m, i) * p**i * (1 - p) ** (m - i) for i in range(k + 1)), abs=1e-10)
    assert calibration.binom_cdf(100_000_000, 1_000_000_000, 0.1) == pytest.approx(0.5, abs=1e-4)
    assert 0.0999 < calibration.clopper_pearson_upper(99_900_000, 1_000_000_000, 0.1) < 0.1001


def test_categories(spark):
    ref = [("s", "arms", 1, "Drug A high"), ("s", "arms", 2, "Placebo"), ("s", "identifiers", 1, "NCT 01"), ("s", "marks", 1, "Day 1\nBlood draw"), ("s", "marks", 2, "Day 2\nBlood draw"), ("t", "arms", 1, "x")]
    got = [("s", "arms", 1, "placebo"), ("s", "arms", 2, "drug a"), ("s", "arms", 3, "zzz"), ("s", "identifiers", 1, "nct-01"), ("s", "marks", 1, "day 1\nblood draw"), ("s", "marks", 2, "week 9\nblood draw"), ("s", "epochs", 1, "e")]
    make = lambda rows: spark.createDataFrame(rows, "study string, category string, ord int, text string")
    counts = scoring.category_counts(make(got), make(ref))
    assert values(counts) == [("s", "arms", 2, 3, 2), ("s", "identifiers", 1, 1, 1), ("s", "marks", 2, 2, 1), ("t", "arms", 1, 0, 0)]
    total = {r.study: (r.accuracy, r.recall) for r in scoring.rubric(counts).collect()}
    assert total["s"] == (4 / 7, 4 / 5) and total["t"] == (0.0, 0.0)


def test_thresholds_are_found_by_halves(spark):
    rng = random.Random(8)
    rows = [(rng.choice([None, float("nan"), 2.0, 0.7, rng.random()]), rng.random() < 0.6) for _ in range(400)]
    for grid in (calibration.GRID, (0.5, 0.9, 0.2), (0.7,)):
        out = calibration.threshold_counts(spark.createDataFrame(rows, "score double, correct boolean"), "score", "correct", grid)
        plain = [[ok for s, ok in rows if s is not None and (s != s or s >= min(grid[: i + 1]))] for i in range(len(grid))]
        assert sorted((r.seq, r.t, r.m, r.k) for r in out.collect()) == [(i, t, len(x), x.count(False)) for i, (t, x) in enumerate(zip(grid, plain, strict=True))]
    assert "array_position" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_marks_that_are_repeated(spark, monkeypatch):
    """The same matches as from a table of all pairs, while the walk sees marks only."""
    rng, seen = random.Random(3), []
    text = lambda: rng.choice(["Day 1\nBlood draw", "day 1\nblood  draw", "Day 2\nBlood", "Day 1 of 2\nBlood draw", "Week 9\nExam", "Exam", None])
    refs, items = (spark.createDataFrame([(i % 2, i, text()) for i in range(150)], f"k int, {name} int, _text string") for name in ("ref", "item"))
    plain = scoring.greedy_match(scoring.mark_pairs(refs, items, ["k"]), ["k"], 0.5)
    want = sorted(map(tuple, plain.collect()))
    real = scoring.fold
    monkeypatch.setattr(scoring, "fold", lambda rows, keys, *a: (seen.append(rows.count()), real(rows, keys, *a))[1])
    got = scoring.greedy_match_marks(refs, items, ["k"], 0.5)
    assert sorted(map(tuple, got.collect())) == want and len(want) > 80 and seen[0] <= 300


def test_features_without_anything_known(spark):
    fields = spark.createDataFrame([(1, "soa", "f", "v", None, None, None, "n/a", True, 2, 0.5, "REVIEW")], "study_id long, domain string, field string, value string, quote_text string, quote_page int, verify_pass string, verifier string, methods_agree boolean, n_methods int, confidence double, decision string")
    none = spark.createDataFrame([], "study_id long, domain string, field string, ord int, value string, quote_text string, quote_page int, verify_pass string")
    row = features.features(fields, none, spark.createDataFrame([], "domain string, field string, field_type string")).first()
    assert row.asDict() == {"study_id": 1, "domain": "soa", "field": "f", "field_type": "unknown", "value_present": True, "verify_pass": "none", "verifier": "n/a", "methods_agree": True, "n_methods": 2, "agreement_fuzzy_mean": None, "is_table_cell": True, "grid_agreement": None, "span_length": 0, "page": None, "page_position": None, "has_text_layer": None, "window_kept_ratio": None, "route_plan_hash": None, "confidence": 0.5, "decision": "REVIEW"}


def test_sinks(spark, tmp_path):
    fields = spark.createDataFrame([(1, "soa", "f", "v", "q", 2, "exact", "n/a", True, 2, 0.5, "REVIEW")], "study_id long, domain string, field string, value string, quote_text string, quote_page int, verify_pass string, verifier string, methods_agree boolean, n_methods int, confidence double, decision string")
    none = spark.createDataFrame([], "study_id long, domain string, field string, ord int, value string, quote_text string, quote_page int, verify_pass string")
    rows = features.features(fields, none, spark.createDataFrame([], "domain string, field string, field_type string"))
    for _ in range(2):
        features.write_features(rows, f"{tmp_path}/features")
    assert [(r.domain, r.span_length, r.page) for r in spark.read.parquet(f"{tmp_path}/features").collect()] == [("soa", 1, 2)]
    fixes, checked = spark.createDataFrame([(1, "a", "b")], "doc_id long, field string, value string"), spark.createDataFrame([(1,), (2,)], "doc_id long")
    files.write_corrections(fixes, f"{tmp_path}/fixes", checked, seq=1)
    read = lambda: {r.doc_id: [tuple(x) for x in r.corrections] for r in files.read_corrections(spark, f"{tmp_path}/fixes", "field string, value string").collect()}
    assert read() == {1: [("a", "b")], 2: []}
    files.write_corrections(fixes.limit(0), f"{tmp_path}/fixes", checked.filter("doc_id = 1"), seq=2)
    assert read() == {1: [], 2: []}
    log = spark.createDataFrame([("h", 1, "extract")], "source_sha256 string, seq long, event string")
    files.append_log(log, f"{tmp_path}/log")
    files.append_log(log.withColumn("seq", F.lit(2)), f"{tmp_path}/log")
    assert spark.read.parquet(f"{tmp_path}/log").count() == 2
    for kind in (schemas.BLOCK, schemas.SECTION, schemas.CELL, schemas.CANDIDATE, schemas.FINDING, schemas.AUDIT, schemas.LABEL):
        assert spark.createDataFrame([], kind).count() == 0


def test_residue_and_plans(spark):
    rows = spark.createDataFrame([(1, "Odd title", None), (2, "Other", None), (3, "Set", "design")], "ord int, title string, type string")
    model = lambda prompts: ["Safety " if p == "Odd title" else "nonsense" for p in prompts]
    assert values(assembly.classify_residue(rows, model, ["safety"]).select("ord", "type")) == [(1, "safety"), (2, None), (3, "design")]
    assert values(assembly.classify_residue(rows, None, ["safety"]).select("ord", "type")) == [(1, None), (2, None), (3, "design")]
    scored = spark.createDataFrame([(k / 200, k > 60) for k in range(200)], "score double, correct boolean")
    plan = calibration.plan_sequence(scored, "score", "correct", 100, 0.2)
    counts = {r.t: (r.m, r.k) for r in calibration.threshold_counts(scored, "score", "correct").collect()}
    assert sorted(plan) == sorted(t for t, (m, _) in counts.items() if m) and counts[plan[0]][1] / counts[plan[0]][0] < 0.2


def test_runs(spark, tmp_path):
    studies = spark.createDataFrame([(1, 1.0), (2, 0.0)], "doc_id long, produced double")
    some = spark.createDataFrame([("a", 1)], "field string, n int")
    runs.write_run(studies, some, some, f"{tmp_path}/run")
    assert values(spark.read.json(f"{tmp_path}/run/studies").select("doc_id")) == [(1,)] and spark.read.json(f"{tmp_path}/run/scoreboard").count() == 1
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "x.txt").write_bytes(b"abc")
    assert [r.sha256 for r in runs.source_identities(spark, f"{tmp_path}/in").collect()] == [hashlib.sha256(b"abc").hexdigest()]
    log = spark.createDataFrame([(["t1"], "det", 0.4), (["t1", "h1"], "det", 0.5)], "studies array<string>, mode string, accuracy double")
    for _ in range(2):
        runs.log_heldout(log, ["h1", "h2"], f"{tmp_path}/log")
    assert [r.accuracy for r in spark.read.json(f"{tmp_path}/log").collect()] == [0.5, 0.5]
    assert values(runs.dimension(spark, f"{tmp_path}/none", "key string, n int", [("a", 1)])) == [("a", 1)]
    some.withColumnRenamed("field", "key").write.json(f"{tmp_path}/dim")
    assert values(runs.dimension(spark, f"{tmp_path}/dim", "key string, n int", [])) == [("a", 1)]
    rules = spark.createDataFrame([("type", "design"), ("type", "odd"), ("subtype", None)], "axis string, value string")
    assert values(runs.unknown_labels(rules, spark.createDataFrame([("type", "design")], "axis string, value string"))) == [("type", "odd")]


def test_models_by_role(spark):
    prompts = spark.createDataFrame([("extract", "a"), ("verify", "b"), (None, "c")], "role string, prompt string")
    up = lambda ps: [p.upper() for p in ps]
    assert values(runs.by_role(prompts, {"extract": up})) == [("extract", "a", "A"), ("verify", "b", None), (None, "c", None)]
    assert values(runs.by_role(prompts, {}, up)) == [("extract", "a", "A"), ("verify", "b", "B"), (None, "c", "C")]
    with pytest.raises(ValueError):
        runs.by_role(prompts, {"extract": up}, required=("verify",))
    rows = spark.createDataFrame([(1, "v", "q", "partial"), (2, "v", "q", "supported"), (3, "w", None, "partial"), (4, "v", "q", None)], "k int, value string, quote string, verifier string")
    model = lambda ps: ["Unsupported" if "Value: v" in p else "who knows" for p in ps]
    assert [r[3] for r in values(runs.escalate(rows, model))] == ["unsupported", "supported", "partial", None]
    assert values(runs.escalate(rows, None)) == values(rows)
    got = runs.isolated(rows, lambda r: (r["k"], 10 // (r["k"] - 2)), "k int, n int").collect()
    assert sorted((r.n, (r.error or "")[:17]) for r in got if r.n is not None) == [(-10, ""), (5, ""), (10, "")] and [r.error[:17] for r in got if r.error] == ["ZeroDivisionError"]


def test_schedule_labels(spark):
    names = ["Cycle 2 Day 1 0 h (within 2.5 h prior to dose)", "Cycle 2 Day 1 5-7", "Cycle 2 Day 1", "Day -1", "Day 1", None]
    got = [r[0] for r in spark.createDataFrame([(n,) for n in names], "n string").select(schedules.visit_identity(F.col("n"))).collect()]
    assert got[0] == got[1] == got[2] == "cycle2day1" and got[3] == "dayneg1" and got[4] == "day1" and got[5] == ""
    labels = ["EOT / Withdrawal a", "Day 1 b, c", "±2d*", "0 h", "Phase b (1 Cycle)"]
    assert [r[0] for r in spark.createDataFrame([(n,) for n in labels], "n string").select(schedules.without_footnote(F.col("n"))).collect()] == ["EOT / Withdrawal", "Day 1", "±2d", "0 h", "Phase (1 Cycle)"]
    parts = spark.createDataFrame([(["Screen", "ing", "and", "Base", "line", "x1"],), (None,), ([],)], "p array<string>")
    assert [r[0] for r in parts.select(schedules.merge_wrapped(F.col("p"))).collect()] == [["Screening", "and", "Baseline", "x1"], [], []]


def test_command_line(spark, tmp_path, capsys):
    from tarnwork.__main__ import main

    assert main(["list"]) == 0 and "hashed_rows" in capsys.readouterr().out.split()
    assert main(["no_such_query", "x"]) == 2
    assert main(["hashed_rows", "/root/testdata/sf0.001", f"{tmp_path}/out"]) == 0 and spark.read.parquet(f"{tmp_path}/out").count() == 25


def test_quotes_by_lists_and_by_joins(spark, monkeypatch):
    docs = spark.createDataFrame([(k, f"start {' '.join(f'w{(i * k) % 17}' for i in range(60))} end") for k in range(1, 40)], "doc_id long, text string")
    quotes = spark.createDataFrame([(k, " ".join(f"w{(i * k) % 17}" for i in range(5, 14))) for k in range(1, 17)] + [(90, "w1 w2"), (91, "start w0 w3 w6 w9"), (92, "a b c d e f g")], "quote_id long, quote string")
    want = values(voting.resolve_quotes(docs, quotes))
    monkeypatch.setattr(voting, "FEW_ANCHORS", 3)
    assert values(voting.resolve_quotes(docs, quotes)) == want and len(want) > 40
    rows = [(d.doc_id, q.quote_id, "exact", d.text.find(q.quote)) for d in docs.collect() for q in quotes.collect() if q.quote in d.text]
    assert want == sorted(rows, key=str)


def test_two_passes(spark):
    def model(prompts):
        out = []
        for p in prompts:
            if not p.startswith("Answer"):
                out.append("" if "silent" in p else "notes")
            elif "broken" in p:
                out.append("[{not json")
            else:
                out.append('Here: [{"field": "phase", "value": "2", "quote": " "}, {"field": "sponsor", "value": "x", "quote": "by x"}, {"field": "odd", "value": "y"}, {"field": "phase", "value": ""}]')
        return out

    parts = assembly.shards(spark, {"c1": ("metadata", ["sponsor", "title"]), "c2": ("design", ["phase"])})
    texts = spark.createDataFrame([(1, "a text"), (2, "silent"), (3, "broken"), (4, None)], "doc_id long, text string")
    assert values(assembly.two_pass(texts, parts, model)) == [(1, "c1", "metadata", "sponsor", "x", "by x"), (1, "c2", "design", "phase", "2", None)]
    assert assembly.two_pass(texts, parts, None).count() == 0
    with pytest.raises(ValueError):
        assembly.shards(spark, {"c": ("d", [f"f{i}" for i in range(41)])})


TEXT = """Acme study of things
This is prose on the first page of the study.
And more of it.
Sponsor: Acme Ltd
Phase: Phase 2
PROTOCOL AMENDMENT HISTORY
Primary objective: this is historic and must not be taken.
Why it was changed.
STUDY DESIGN
Subjects are randomized to drug A 10 mg or placebo.
STUDY POPULATION
Inclusion criteria are these.
1. Adults of any age 2. Able to read.
Exclusion criteria are these.
1. Children of any age.
OBJECTIVES AND ENDPOINTS
Primary objective: to see whether it works.
Population: all.
Treatment: drug A.
Variable: change at visit 9.
Summary: mean.
"""


def test_full_loop(spark):
    docs = spark.createDataFrame([(1, TEXT), (2, None), (3, "Phase: Phase 1\nnothing else here")], "doc_id long, text string")
    labels = spark.createDataFrame([("sponsor", "^sponsor"), ("phase", "^phase")], "field string, pattern string")
    visits = spark.createDataFrame([(1, "Visit 1"), (1, "V2")], "doc_id long, label string")
    got = full.full_loop(docs, labels, visits=visits)
    assert {(r.doc_id, r.field): r.value for r in got["fields"].collect()} == {(1, "sponsor"): "Acme Ltd", (1, "phase"): "Phase 2", (2, "sponsor"): None, (2, "phase"): None, (3, "sponsor"): None, (3, "phase"): "Phase 1"}
    assert [r.name for r in got["arms"].filter("doc_id = 1").orderBy("ord").collect()] == ["drug A", "placebo"]
    assert values(got["objectives"].filter("doc_id = 1")) == [(1, "primary", "to see whether it works.")]
    assert ("exclusion", 1, "Children of any age.") in values(got["criteria"].filter("doc_id = 1").select("category", "n", "item")) and got["criteria"].filter("doc_id = 1").count() == 3
    assert got["estimands"].filter("doc_id = 1").first().summary == "mean."
    assert (1, "visit_9_not_in_schedule", "WARNING") in values(got["findings"])
    studies = {r.doc_id: r for r in got["studies"].collect()}
    assert studies[1].produced == 1.0 and studies[2].produced == 0.0 and json.dumps(len(studies[1].arms)) == "2"
    assert got["features"].count() == 6 and {r.window_kept_ratio is not None for r in got["features"].filter("study_id = 1").collect()} == {True}


def test_full_loop_by_rules(spark):
    """Rules that say what the built-in routes do change nothing; others move the evidence."""
    docs = spark.createDataFrame([(1, TEXT), (2, None)], "doc_id long, text string")
    blocks = full.strip_furniture(full.text_blocks(docs))
    sections = full.label_sections(full.nest(full.headings(blocks))).transform(full.checkpointed)
    known = [(k, domain, "primary", None, None, list(types), None, None) for k, (domain, types) in enumerate(full.ROUTES.items())]
    studies = spark.createDataFrame([(1, "f", "phase_2")], "doc_id long, family string, phase string")
    plans = lambda rules: routes.study_plans(studies, spark.createDataFrame(rules, routes.RULE))
    usual, same = full.domain_windows(blocks, sections), full.domain_windows(blocks, sections, plans=plans(known))
    pick = lambda rows: sorted(map(tuple, rows.select("doc_id", "domain", "ord").collect()))
    untyped = {(r.doc_id, "metadata", r.ord) for r in full.section_of(blocks, sections, ["type"]).filter("type is null").collect()}
    assert set(pick(usual[0])) - set(pick(same[0])) <= untyped and set(pick(same[0])) <= set(pick(usual[0]))
    moved = full.domain_windows(blocks, sections, plans=plans([*known, (90, "eligibility", "primary", None, "phase_2", ["science"], None, None), (91, "objectives", "prohibited", "f", None, ["science"], None, None)]))
    science = {r.ord for r in full.section_of(blocks, sections, ["type"]).filter("type = 'science'").collect()}
    got = pick(moved[0])
    assert science and {o for _, d, o in got if d == "eligibility"} == science
    fallback = lambda windows: {r.domain for r in windows.filter("doc_id = 1 and fallback").collect()}
    assert "objectives" in fallback(moved[1]) - fallback(same[1])  # nothing else is left for them


def test_one_odd_document_stops_nothing(spark, monkeypatch):
    monkeypatch.setattr(sections, "MOST_LEVELS", 3)
    rows = [(1, k, 1, float(k), level) for k, level in enumerate([1, 2, 3, 4, 5, 2, None])]
    got = sections.nest(spark.createDataFrame(rows, "doc_id long, ord int, page int, y0 double, level int"))
    assert [r.parent_ord for r in got.orderBy("ord").collect()] == [None, 0, 1, 1, 1, 0, None]


def test_features_leave_candidates_where_they_meet(spark):
    """Pages meet the fields once, after candidates are left behind."""
    plan = catalog.QUERIES["feature_rows"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") == 5
