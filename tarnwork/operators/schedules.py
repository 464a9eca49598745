"""Labels of schedules, title pages, findings about schedules, pages for a reader."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Names of epochs by how a label starts, and the forms of windows, times within a visit, footnote tails and definitions.
EPOCHS = ((r"(?i)^screen", "Screening Period"), (r"(?i)^(treatment|dosing|intervention)", "Treatment Period"), (r"(?i)^(f/?u|follow)", "Follow-up Period"))
WINDOW = r"(?i)^\(?\s*(?:[±+\-−]|\+/-)\s*\d|^\d+\s*days?\)?$|^window"
DAYS_ALONE = r"(?i)^\d+\s*days?\)?$"
TIME_DETAIL = r"(?i)\s+\d+(?:\.\d+)?\s*(?:-\s*\d+(?:\.\d+)?\s*)?(?:h|hrs?|hours?)\b.*$"
FOOTNOTE_TAIL = r"(?:(?:(?<!\d)\s+[a-z]|(?<=\d)\s+[a-gi-z])(?:\s*,\s*[a-z])*|\s*\*+)+$"
FOOTNOTE_DEFINITION = r"(?m)^\s*[a-z](?:[.)]|\s)\s*[A-Z(]"
FUNCTION_WORDS = r"(?i)^(and|or|to|of|day|days|the|in|on|at|for|per|by|with)\b"


def epoch_name(label: Column) -> Column:
    """The usual name of an epoch, or the label itself."""
    bare, out = F.trim(F.coalesce(label, F.lit(""))), None
    for pattern, name in EPOCHS:
        out = F.when(bare.rlike(pattern), name) if out is None else out.when(bare.rlike(pattern), name)
    return out.otherwise(bare)


def merge_wrapped(parts: Column) -> Column:
    """Parts of a label (array) with the tails of words that a narrow cell broke rejoined: a short fragment in small letters, no word by itself, after a letter."""
    last = lambda acc: F.element_at(acc, -1)

    def step(acc: Column, p: Column) -> Column:
        tail = (F.size(acc) > 0) & last(acc).rlike("[A-Za-z]$") & p.rlike(r"^[a-z]{1,5}(?:\W|$)") & ~p.rlike(FUNCTION_WORDS)
        return F.when(tail, F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(F.concat(F.when(F.size(acc) > 0, last(acc)), p)))).otherwise(F.concat(acc, F.array(p)))

    return F.aggregate(F.coalesce(parts, F.array().cast("array<string>")), F.array().cast("array<string>"), step)


def split_label(parts: Column) -> Column:
    """struct(name, window) of the parts of a column's header: windows such as "±3 days" apart from the name; a bare number of days is neither."""
    join = lambda x: F.trim(F.array_join(x, " "))
    return F.struct(join(F.filter(parts, lambda p: ~p.rlike(WINDOW))).alias("name"), join(F.filter(parts, lambda p: p.rlike(WINDOW) & ~p.rlike(DAYS_ALONE))).alias("window"))


def without_footnote(label: Column) -> Column:
    """A label without the letters and asterisks of its footnotes; after a number "h" is hours."""
    inner = F.regexp_replace(F.trim(F.coalesce(label, F.lit(""))), r"(?<=[A-Za-z])\s+[a-z](?=\s+\()", "")
    return F.trim(F.regexp_replace(inner, FOOTNOTE_TAIL, ""))


def visit_identity(name: Column) -> Column:
    """What a visit is across tables: without times within it, blanks and signs; "Day -1" is not "Day 1"."""
    base = F.regexp_replace(F.coalesce(name, F.lit("")), TIME_DETAIL, "")
    base = F.regexp_replace(base, r"(?i)(\bday\s*-?\d+)\s+\d+\s*-\s*\d+$", "$1")
    base = F.regexp_replace(base, r"(?<![\w])[-−](?=\d)", "neg")
    return F.regexp_replace(F.lower(base), r"[^\p{L}\p{N}_]+", "")


def visit_name(number: Column, label: Column) -> Column:
    """A numbered visit is "Visit 1a", another one its label, both without footnotes."""
    bare = without_footnote(number)
    return F.when(bare.rlike(r"^\d+[a-z]?$"), F.concat(F.lit("Visit "), bare)).otherwise(without_footnote(label))


def title_page(blocks: DataFrame) -> DataFrame:
    """(doc_id, field, value) from page 1 without labels: the longest heading of more than 12 characters, the first phase, the first token like an identifier. blocks: with kind."""
    first = blocks.filter(F.col("page") == 1)
    heads = F.col("kind") == "heading"
    rows = first.groupBy("doc_id").agg(
        F.max_by(F.when(heads & (F.char_length("text") > 12), F.trim("text")), F.when(heads & (F.char_length("text") > 12), F.struct(F.char_length("text").alias("n"), (-F.col("ord")).alias("o")))).alias("studyTitle"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "text"))), lambda b: b["text"]), "\n").alias("_text"),
    )
    found = lambda pattern: F.nullif(F.regexp_extract("_text", pattern, 0), F.lit(""))
    rows = rows.withColumns({"studyPhase": found(r"(?i)\bphase\s*(?:0|i{1,3}v?|iv|[1-4])(?:\s*[/-]\s*(?:i{1,3}v?|[1-4]))?\b"), "protocolIdentifier": found(r"\b[A-Z]{2,}[A-Z0-9]*-?\d{2,}(?:-[A-Z0-9]+)*\b")})
    return rows.unpivot(["doc_id"], ["studyTitle", "studyPhase", "protocolIdentifier"], "field", "value").filter("value is not null")


def exclude_under(sections: DataFrame, pattern: str) -> DataFrame:
    """Sections that do not stand below a section of level 1 whose title matches. sections: with top_title."""
    return sections.filter(~F.coalesce(F.lower("top_title").rlike(pattern), F.lit(False)))


def with_roles(organizations: DataFrame, kinds: DataFrame, roles: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Organisations (study_id, field, value) with the codes of their kind and role, and an INFO for those without a role.

    kinds: field, kind, org_code; roles: kind, role_code. Blank values and fields without a kind are left out.
    """
    rows = organizations.filter(F.trim(F.coalesce("value", F.lit(""))) != "").join(kinds, "field").join(roles, "kind", "left")
    return rows.select("study_id", "field", "value", "org_code", "role_code"), rows.filter("role_code is null").select("study_id", F.concat(F.lit("no_role_for_"), "field").alias("kind"), F.lit("INFO").alias("severity"))


def schedule_findings(schedules: DataFrame, marks: DataFrame, key: str = "study_id") -> DataFrame:
    """(key, kind, severity, n) of schedules (key, n_activities, n_visits, has_design) and marks (key, activity, visit): no matrix, activities at no visit, visits without any."""
    used = marks.groupBy(key).agg(F.countDistinct("activity").alias("_a"), F.countDistinct("visit").alias("_v"))
    rows = schedules.join(used, key, "left").fillna(0, ["_a", "_v"])
    none = (F.col("n_activities") == 0) | (F.col("n_visits") == 0)
    rule = lambda when, kind, severity, n: F.when(when, F.struct(F.lit(kind).alias("kind"), severity.alias("severity"), n.cast("long").alias("n")))
    warn, free = F.lit("WARNING"), (F.col("n_activities") - F.col("_a"), F.col("n_visits") - F.col("_v"))
    found = F.array(rule(none, "no_matrix", F.when(F.col("has_design"), "ERROR").otherwise("WARNING"), F.lit(0)), rule(~none & (free[0] > 0), "activities_at_no_visit", warn, free[0]), rule(~none & (free[1] > 0), "visits_without_activity", warn, free[1]))
    return rows.select(key, F.explode(F.array_compact(found)).alias("_f")).select(key, "_f.*")


def footnote_findings(marked: DataFrame, texts: DataFrame, key: str = "study_id") -> DataFrame:
    """(key, kind, severity, n): activities that carry footnote marks in studies whose text defines none. marked: key, activity; texts: key, text."""
    defined = texts.filter(F.col("text").rlike(FOOTNOTE_DEFINITION)).select(key).distinct()
    return marked.groupBy(key).agg(F.countDistinct("activity").alias("n")).join(defined, key, "left_anti").select(key, F.lit("footnotes_not_defined").alias("kind"), F.lit("WARNING").alias("severity"), "n")


def objective_findings(objectives: DataFrame, key: str = "study_id") -> DataFrame:
    """(key, kind, severity, n) of objectives (key, level, objective, endpoint): no primary one, a primary one without endpoint, others without."""
    primary = F.lower(F.coalesce("level", F.lit(""))) == "primary"
    ended = F.coalesce("endpoint", F.lit("")) != ""
    rows = objectives.groupBy(key).agg(F.count_if(primary).alias("_p"), F.count_if(primary & ended).alias("_e"), F.count_if(~primary & ~ended).alias("_o"))
    rule = lambda when, kind, severity, n: F.when(when, F.struct(F.lit(kind).alias("kind"), F.lit(severity).alias("severity"), n.cast("long").alias("n")))
    found = F.array(rule(F.col("_p") == 0, "no_primary_objective", "ERROR", F.lit(0)), rule((F.col("_p") > 0) & (F.col("_e") == 0), "primary_without_endpoint", "ERROR", F.col("_p")), rule((F.col("_p") > 0) & (F.col("_o") > 0), "objectives_without_endpoint", "WARNING", F.col("_o")))
    return rows.select(key, F.explode(F.array_compact(found)).alias("_f")).select(key, "_f.*")


def all_findings(*findings: DataFrame) -> DataFrame:
    """Findings of all stages in one table; columns that one lacks are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), findings)


def page_manifest(evidence: DataFrame, most: int, current: int = 4, historic: int = -36, spill: int = 1) -> DataFrame:
    """(doc_id, page, score, rank): the `most` pages of each document by evidence, earlier ones first among equals, pages of no weight left out.

    evidence: doc_id, page, weight, is_historic, is_current. Historic pages lose and current ones win a fixed amount once; `spill` of a page's
    evidence goes to the page after it, where a table may go on.
    """
    once = lambda flag, amount: F.when(F.max(F.coalesce(F.col(flag), F.lit(False))), amount).otherwise(0)
    own = evidence.groupBy("doc_id", "page").agg((F.sum("weight") + once("is_historic", historic) + once("is_current", current)).alias("score"))
    after = own.filter("score > 0").select("doc_id", (F.col("page") + 1).alias("page"), F.lit(spill).alias("score"))
    total = own.unionByName(after).groupBy("doc_id", "page").agg(F.sum("score").cast("long").alias("score")).filter("score > 0")
    return total.withColumn("rank", F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("score"), "page"))).filter(F.col("rank") <= most)
