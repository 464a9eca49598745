"""Fields of studies: plausibility, parsers of arms and objectives, nested studies, completeness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import collapse, mark_anywhere, phases
from .folds import fold
from .sections import section_of


def sanity(field: Column, value: Column, document: Column) -> Column:
    """confirmed, neutral or failed, by field: phase, sponsor, identifier, arm, and any other as a long text. Blank values are neutral."""
    v, text = F.trim(F.coalesce(value, F.lit(""))), F.coalesce(document, F.lit(""))
    letters = F.char_length(F.regexp_replace(v, r"[^\p{L}]", ""))
    words = F.size(F.split(v, r"\s+"))
    stated, own = phases(F.regexp_extract(text, r"(?i)(phase\s+[ivIV1-4]+)", 1)), phases(v)
    phase = F.when(F.size(own) == 0, "failed").when(F.size(stated) == 0, "neutral").when(F.size(F.array_intersect(own, stated)) > 0, "confirmed").otherwise("failed")
    sponsor = F.when((F.char_length(v) > 80) | v.rlike(r"[0-9]{4,}|(?i)street|road|avenue"), "failed").otherwise("neutral")
    blanks = F.char_length(v) - F.char_length(F.replace(v, F.lit(" "), F.lit("")))
    identifier = F.when(F.char_length(v).between(3, 40) & (blanks <= 5) & v.rlike("[0-9]") & ~F.lower(v).rlike("template|xxx"), "confirmed").otherwise("failed")
    arm = F.when(F.char_length(v).between(2, 60) & (letters >= 3) & ~v.rlike(r"(?i)^[0-9.,]+\s*(mg|ml|g|µg)$"), "confirmed").otherwise("failed")
    long_text = F.when((F.char_length(v) >= 15) & (letters >= 10) & (words >= 3) & ~v.rlike(r"\.{4,}"), "confirmed").otherwise("failed")
    return F.when(v == "", "neutral").when(field == "phase", phase).when(field == "sponsor", sponsor).when(field == "identifier", identifier).when(field == "arm", arm).otherwise(long_text)


def drop_prohibited(candidates: DataFrame, sections: DataFrame, prohibited: DataFrame, key: str = "section") -> tuple[DataFrame, DataFrame]:
    """Candidates (doc_id, page, y0 of their quote, ...) outside prohibited sections, and a WARNING for each dropped one. Candidates without a place stay."""
    placed = section_of(candidates.filter("page is not null"), sections, [key])
    bad = placed.join(prohibited.select(key).distinct(), key, "left_semi")
    good = placed.join(prohibited.select(key).distinct(), key, "left_anti").select(*candidates.columns)
    return good.unionByName(candidates.filter("page is null")), bad.select("doc_id", key, F.lit("WARNING").alias("severity"))


def review_rows(fields: DataFrame) -> DataFrame:
    """Rows for reviewers: confidence with three digits (half to even), spans of at most 160 characters."""
    return fields.select("*").withColumns({"confidence": F.bround("confidence", 3), "span": F.substring(F.coalesce("span", F.lit("")), 1, 160)})


def arm_names(s: Column) -> Column:
    """Names of arms: of "Arm A: ..." labels where there are two or more, else of a list after "to" or "receive", without articles and doses; case-insensitively distinct."""
    text = F.coalesce(s, F.lit(""))
    labelled = F.regexp_extract_all(text, F.lit(r"(?im)^[ \t]*[-•*]?[ \t]*((?:arm|group|cohort)[ \t]+[A-Z0-9]+)[ \t]*:"), F.lit(1))
    listed = F.split(F.regexp_extract(collapse(text), r"(?i)(?:randomi[sz]ed to|receive)\s+([^.]*)", 1), r"\s*(?:,|\bor\b|\band\b|\bversus\b)\s*")
    bare = F.transform(listed, lambda x: F.trim(F.regexp_replace(F.regexp_replace(x, r"(?i)^\s*(?:either|the|an|a)\s+", ""), r"(?i)\s*[0-9.,]+\s*(?:mg|ml|g).*$", "")))
    names = F.when(F.size(labelled) >= 2, labelled).otherwise(F.filter(bare, lambda x: F.char_length(x) >= 2))
    return F.filter(names, lambda x, i: ~F.exists(F.slice(names, 1, i), lambda y: F.lower(y) == F.lower(x)))


def arm_type(name: Column) -> Column:
    low = F.lower(name)
    return F.when(low.rlike("placebo|sham"), "placebo").when(low.rlike("standard of care|comparator|active control"), "comparator").otherwise("experimental")


def objectives(s: Column) -> Column:
    """struct(primary, secondary, exploratory): the first line after each label; null without one."""
    text = F.coalesce(s, F.lit(""))
    line = lambda tier: F.nullif(F.trim(F.regexp_extract(text, rf"(?im)^\s*{tier} objectives?\s*:?[ \t]*\n?[ \t]*([^\n]+)", 1)), F.lit(""))
    return F.struct(*(line(t).alias(t) for t in ("primary", "secondary", "exploratory")))


def objective_rows(cells: DataFrame) -> DataFrame:
    """(doc_id, record, tier, objective, endpoints) of tables (doc_id, row, objective, endpoint): a row that names a tier sets it; a row without an objective goes on with the record before it. Endpoints are joined by "; "."""
    w = Window.partitionBy("doc_id").orderBy("row").rowsBetween(Window.unboundedPreceding, 0)
    named = F.lower(F.regexp_extract(F.coalesce("objective", F.lit("")), r"(?i)^\s*(primary|secondary|exploratory)\s*(?:objectives?)?\s*$", 1))
    rows = cells.withColumn("_tier", F.nullif(named, F.lit(""))).withColumn("tier", F.last("_tier", ignorenulls=True).over(w)).filter("_tier is null")
    rows = rows.withColumn("record", F.sum((F.trim(F.coalesce("objective", F.lit(""))) != "").cast("int")).over(w))
    parts = F.array_sort(F.collect_list(F.when(F.trim("endpoint") != "", F.struct("row", F.trim("endpoint").alias("e")))))
    return rows.filter("record > 0").groupBy("doc_id", "record").agg(F.min_by("tier", "row").alias("tier"), F.min_by(F.trim("objective"), "row").alias("objective"), F.array_join(F.transform(parts, lambda x: x["e"]), "; ").alias("endpoints"))


# Labels of an estimand's attributes and the strategies for intercurrent events.
ESTIMAND_LABELS = ("population", "treatment", "variable", "endpoint", "summary", "intercurrent events")
STRATEGIES = ("treatment policy", "hypothetical", "composite", "while on treatment", "principal stratum")


def estimand_groups(blocks: DataFrame, least: int = 3, most_characters: int | None = 1200) -> DataFrame:
    """(doc_id, group, population, treatment, variable, summary, events, strategy) of labelled lines; a repeated label starts a group, groups with fewer than `least` labels, or without summary and events, go. Values keep most_characters characters; None: all."""

    def walk(rows: list[dict]) -> list[tuple]:
        groups: list[dict] = []
        for r in rows:
            label, _, value = r["text"].partition(":")
            label = label.strip().lower()
            if label in ESTIMAND_LABELS and value.strip():
                if not groups or label in groups[-1]:
                    groups.append({})
                groups[-1][label] = value.strip()[:most_characters]
        kept = [g for g in groups if len(g) >= least and ("summary" in g or "intercurrent events" in g)]
        strategy = lambda g: next((s for s in STRATEGIES if s in g.get("intercurrent events", "").lower()), None)
        return [(i, g.get("population"), g.get("treatment"), g.get("variable") or g.get("endpoint"), g.get("summary"), g.get("intercurrent events"), strategy(g)) for i, g in enumerate(kept)]

    labelled = blocks.filter(F.contains("text", F.lit(":"))).select("doc_id", "ord", "text")
    return fold(labelled, ["doc_id"], ["ord"], walk, "group int, population string, treatment string, variable string, summary string, events string, strategy string")


STUDY = "struct<title:string,phase:string,identifiers:array<struct<id:string,scopeId:string,text:string>>,organizations:array<struct<id:string,name:string>>,criteria:array<struct<id:string,itemId:string,category:string>>,items:array<struct<id:string,text:string>>>"


def flatten_study(studies: DataFrame) -> DataFrame:
    """(study_id, domain, field, label) of nested studies (study_id, json): titles, phases, identifiers with the name of their organisation, criteria with the text of their item. Empty values are left out; what an id does not lead to is null."""
    s = studies.select("study_id", F.from_json("json", STUDY).alias("s"))
    look = lambda rows, id_, field: F.element_at(F.map_from_entries(F.transform(F.coalesce(rows, F.array()), lambda x: F.struct(x["id"], x[field]))), id_)
    row = lambda domain, field, label: F.struct(F.lit(domain).alias("domain"), F.lit(field).alias("field"), label.alias("label"))
    named = lambda domain, field, label: F.struct(F.lit(domain).alias("domain"), field.alias("field"), label.alias("label"))
    ids = F.transform(F.coalesce("s.identifiers", F.array()), lambda x: named("identifiers", F.coalesce(look(F.col("s.organizations"), x["scopeId"], "name"), F.lit("?")), x["text"]))
    criteria = F.transform(F.coalesce("s.criteria", F.array()), lambda x, i: named("eligibility", F.concat(x["category"], F.lit("_"), (i + 1).cast("string")), look(F.col("s.items"), x["itemId"], "text")))
    all_ = F.concat(F.array(row("metadata", "title", F.col("s.title")), row("metadata", "phase", F.col("s.phase"))), ids, criteria)
    return s.select("study_id", F.explode(all_).alias("_r")).select("study_id", "_r.*").filter(F.trim(F.coalesce("label", F.lit(""))) != "")


def study_input(meta: DataFrame, arms: DataFrame, objectives_: DataFrame, key: str = "study_id") -> DataFrame:
    """One nested row per study: its fields as a map, an intervention for each arm, objectives with their endpoints."""
    fields = meta.groupBy(key).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("field", "value")))).alias("fields"))
    named = arms.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("ord", "name", arm_type(F.col("name")).alias("type")))).alias("arms"))
    aims = objectives_.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("record", "tier", "objective", "endpoints"))).alias("objectives"))
    return fields.join(named, key, "left").join(aims, key, "left")


def glyph_rows(spans: DataFrame) -> DataFrame:
    """(doc_id, page, offset, char, x0, x1) of spans (doc_id, page, block, span, text, x0, x1): characters in order, a blank between spans, a line break between blocks, each of no width at the end of the one before. Offsets are those of the joined text."""
    order = Window.partitionBy("doc_id", "page").orderBy("block", "span")
    first = F.lag("block").over(order)
    sep = F.when(first.isNull(), "").when(first != F.col("block"), "\n").otherwise(" ")
    before = F.coalesce(F.lag("x1").over(order), F.lit(0.0))
    rows = spans.withColumns({"_sep": sep, "_before": before, "_n": F.char_length("text")})
    rows = rows.withColumn("_at", F.sum(F.col("_n") + F.char_length("_sep")).over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n") - F.char_length("_sep"))
    chars = rows.withColumn("_text", F.concat("_sep", "text")).filter("_text <> ''").select("*", F.explode(F.sequence(F.lit(0), F.char_length("_text") - 1)).alias("_i"))
    own = F.col("_i") - F.char_length("_sep")
    width = (F.col("x1") - F.col("x0")) / F.col("_n")
    left = F.when(own < 0, F.col("_before")).otherwise(F.col("x0") + own * width)
    return chars.select("doc_id", "page", (F.col("_at") + F.col("_i")).alias("offset"), F.substring(F.col("_text"), F.col("_i") + 1, F.lit(1)).alias("char"), left.alias("x0"), F.when(own < 0, left).otherwise(left + width).alias("x1"))


def rederived_marks(cells: DataFrame, glyphs: DataFrame, keys: list[str]) -> DataFrame:
    """Claimed marks beside those of the glyphs in each cell's box; a cell without a box counts as agreeing. cells: keys, box_id, x0, y0, x1, y1, claimed; glyphs: keys, char, x0, y0, x1, y1."""
    from .grids import in_boxes

    boxed = cells.filter("x0 is not null")
    seen = in_boxes(glyphs, boxed, keys).groupBy(*keys, "box_id").agg(F.max(mark_anywhere(F.col("char")).cast("int")).alias("_m"))
    out = cells.join(seen, [*keys, "box_id"], "left")
    mark = F.when(F.col("x0").isNull(), F.col("claimed")).otherwise(F.coalesce(F.col("_m") == 1, F.lit(False)))
    return out.select(*keys, "box_id", "claimed", mark.alias("rederived"), (mark == F.col("claimed")).alias("agrees"))


def completeness(studies: DataFrame) -> DataFrame:
    """Findings (study_id, kind, severity) of studies (study_id, ratio, n_arms, n_visits, n_activities, n_primary, n_endpoints, n_inclusion, n_exclusion). A rule without inputs is silent."""
    expected = F.size(F.split("ratio", ":"))
    rule = lambda when, kind, severity: F.when(when, F.struct(F.lit(kind).alias("kind"), F.lit(severity).alias("severity")))
    rules = [
        rule(F.col("ratio").isNotNull() & (expected != F.col("n_arms")), "arms_differ_from_ratio", "ERROR"),
        rule((F.col("n_visits") == 0) | (F.col("n_activities") == 0), "no_schedule", "ERROR"),
        rule(F.col("n_primary") == 0, "no_primary_objective", "ERROR"),
        rule((F.col("n_primary") > 0) & (F.col("n_endpoints") == 0), "objective_without_endpoint", "ERROR"),
        rule((F.col("n_inclusion") == 0) | (F.col("n_exclusion") == 0), "criteria_missing", "WARNING"),
    ]
    return studies.select("study_id", F.explode(F.array_compact(F.array(*rules))).alias("_f")).select("study_id", "_f.*")


def invariants(marks: DataFrame, key: str) -> DataFrame:
    """(key, invariant, holds) that need no labels. marks: key, activity, visit, n_activities, n_visits, in long form."""
    per = marks.groupBy(key).agg(
        F.min(((F.col("activity") >= 0) & (F.col("activity") < F.col("n_activities")) & (F.col("visit") >= 0) & (F.col("visit") < F.col("n_visits"))).cast("int")).alias("marks_in_range"),
        (F.countDistinct("visit") == F.max("n_visits")).cast("int").alias("every_visit_marked"),
        (F.countDistinct("activity") >= 0.6 * F.max("n_activities")).cast("int").alias("most_activities_scheduled"),
    )
    names = ["marks_in_range", "every_visit_marked", "most_activities_scheduled"]
    return per.unpivot([key], names, "invariant", "holds").withColumn("holds", F.col("holds") == 1)


# Fixed values of the invariants: least visits and activities, the share of activities with a mark and of distinct visit names, and the letters of labels,
# criteria and objectives; how many criteria a study has at most; what a name that stands for none looks like.
FEWEST_VISITS, FEWEST_ACTIVITIES, SCHEDULED, DISTINCT_NAMES, LABEL_SIZE, CRITERION_SIZE, OBJECTIVE_SIZE, MOST_CRITERIA = 2, 5, 0.6, 0.8, (1, 300), (4, 3500), 15, {"inclusion": 60, "exclusion": 80}
NO_NAME = r"^V\d+$"


def study_invariants(studies: DataFrame, visits: DataFrame, activities: DataFrame, marks: DataFrame, criteria: DataFrame, objectives_: DataFrame, key: str = "study_id") -> DataFrame:
    """(key, part, invariant, holds) of each study, without labels: 10 of its schedule, 4 of its criteria, 4 of its objectives.

    studies: key, has_slot, has_grid; visits: key, visit (from 0), name, epoch; activities: key, activity (from 0), name; marks: key, activity, visit; criteria: key,
    category, text; objectives: key, level, objective, n_endpoints. Without a grid only three invariants of the schedule are told. Each part is one aggregate; no
    lists are gathered. Null texts count as empty.
    """
    text = lambda c: F.trim(F.coalesce(c, F.lit("")))
    size = lambda c: F.char_length(F.coalesce(c, F.lit("")))
    v = visits.groupBy(key).agg(F.count("*").alias("n_v"), F.min((text("name") != "") & ~text("name").rlike(NO_NAME)).alias("real"), F.min(text("epoch") != "").alias("epochs"), F.count_distinct(F.coalesce("name", F.lit(""))).alias("names"))
    a = activities.groupBy(key).agg(F.count("*").alias("n_a"), F.min(size("name").between(*LABEL_SIZE)).alias("sized"))
    known = studies.select(key, "has_slot", "has_grid").join(v, key, "left").join(a, key, "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("n_v", "n_a", "names")})
    inside = (F.col("activity") >= 0) & (F.col("activity") < F.col("n_a")) & (F.col("visit") >= 0) & (F.col("visit") < F.col("n_v"))
    m = marks.join(known.select(key, "n_v", "n_a"), key).groupBy(key).agg(F.min(inside).alias("inside"), F.count_distinct("visit").alias("m_v"), F.count_distinct("activity").alias("m_a"))
    is_ = lambda side: F.count_if(F.col("category") == side)
    c = criteria.groupBy(key).agg(is_("inclusion").alias("inc"), is_("exclusion").alias("exc"), F.min(size("text").between(*CRITERION_SIZE)).alias("c_sized"))
    o = objectives_.groupBy(key).agg(F.count("*").alias("rows"), F.max(F.coalesce(F.col("level") == "Primary", F.lit(False))).alias("primary"), F.min(F.coalesce(F.col("n_endpoints") > 0, F.lit(False))).alias("endpoints"), F.min(size("objective") >= OBJECTIVE_SIZE).alias("o_sized"))
    every = known.join(m, key, "left").join(c, key, "left").join(o, key, "left").withColumns({n: F.coalesce(n, F.lit(0)) for n in ("m_v", "m_a", "inc", "exc", "rows")})
    yes, no = (lambda name: F.coalesce(F.col(name), F.lit(True))), (lambda name: F.coalesce(F.col(name), F.lit(False)))  # noqa: E731  of what is not there, all holds and nothing is found
    n_v, n_a = F.col("n_v"), F.col("n_a")
    grid = lambda holds: F.when(F.col("has_grid"), holds)
    told = [
        ("schedule", "slot_found", F.col("has_slot")),
        ("schedule", "grid_found", F.col("has_grid")),
        ("schedule", "enough_visits_and_activities", F.col("has_grid") & (n_v >= FEWEST_VISITS) & (n_a >= FEWEST_ACTIVITIES)),
        ("schedule", "marks_are_in_range", grid(yes("inside"))),
        ("schedule", "every_visit_has_a_mark", grid((n_v > 0) & (F.col("m_v") == n_v))),
        ("schedule", "most_activities_are_scheduled", grid((n_a > 0) & (F.col("m_a") >= SCHEDULED * n_a))),
        ("schedule", "visit_names_are_real", grid(yes("real"))),
        ("schedule", "every_visit_has_an_epoch", grid(yes("epochs"))),
        ("schedule", "activity_names_are_label_sized", grid(yes("sized"))),
        ("schedule", "visit_names_are_unique_enough", grid((n_v == 0) | (F.col("names") >= DISTINCT_NAMES * n_v))),
        ("eligibility", "has_inclusion", F.col("inc") > 0),
        ("eligibility", "has_exclusion", F.col("exc") > 0),
        ("eligibility", "items_are_criterion_sized", no("c_sized")),
        ("eligibility", "list_sizes_are_plausible", F.col("inc").between(1, MOST_CRITERIA["inclusion"]) & F.col("exc").between(1, MOST_CRITERIA["exclusion"])),
        ("objectives", "table_found", F.col("rows") > 0),
        ("objectives", "has_a_primary_objective", no("primary")),
        ("objectives", "every_row_has_an_endpoint", no("endpoints")),
        ("objectives", "objective_text_is_real", no("o_sized")),
    ]
    rows = F.array(*(F.struct(F.lit(part).alias("part"), F.lit(name).alias("invariant"), holds.alias("holds")) for part, name, holds in told))
    return every.select(key, F.inline(F.filter(rows, lambda r: r["holds"].isNotNull())))


def study_split(studies: DataFrame, which: str, heldout: list[str], confirmed: bool = False) -> DataFrame:
    """Studies of a split: train, heldout or all; held-out ones only once confirmed."""
    if which not in ("train", "heldout", "all"):
        raise ValueError(f"no such split: {which}")
    if which != "train" and not confirmed:
        raise PermissionError("scoring held-out studies needs confirmation")
    inside = F.col("study_id").isin(heldout)
    return studies if which == "all" else studies.filter(inside if which == "heldout" else ~inside)


def routes(spark, table: list[tuple[str, str, str, str]]) -> DataFrame:
    """Route scopes as a dimension: (route, kind, axis, values) from rows (route, kind, axis, value). kind is primary, supporting or prohibited."""
    rows = spark.createDataFrame(table, "route string, kind string, axis string, value string")
    return rows.groupBy("route", "kind", "axis").agg(F.array_sort(F.collect_set("value")).alias("values"))


def markdown(rows: DataFrame) -> str:
    """A small report, such as a scoreboard, as a table; the driver holds all its rows."""
    got = rows.collect()
    return "\n".join(["| " + " | ".join(rows.columns) + " |", "|" + "-|" * len(rows.columns), *("| " + " | ".join("" if v is None else str(v) for v in r) + " |" for r in got)])


def markdown_reports(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """(key, report): a table in Markdown for each key, such as a study, of the other columns of its rows, in order; null is empty, and signs that end a cell are escaped."""
    columns = [c for c in rows.columns if c != key]
    cell = lambda c: F.replace(F.regexp_replace(F.coalesce(F.col(c).cast("string"), F.lit("")), r"[\r\n]+", " "), F.lit("|"), F.lit("\\|"))
    line = F.concat(F.lit("| "), F.concat_ws(" | ", *map(cell, columns)), F.lit(" |"))
    head = "| " + " | ".join(columns) + " |\n|" + "-|" * len(columns) + "\n"
    own = F.array_sort(F.collect_list(F.struct(*(F.col(c).alias(f"_{k}") for k, c in enumerate(order)), line.alias("_line"))))
    return rows.groupBy(key).agg(own.alias("_r")).select(key, F.concat(F.lit(head), F.array_join(F.transform("_r", lambda r: r["_line"]), "\n")).alias("report"))
