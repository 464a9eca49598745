"""What is known about each field's decision, as a row of features; findings about visits; jobs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import jaccard, tokens

#: columns of a row of features, in their order
FEATURES = (
    "study_id", "domain", "field", "field_type", "value_present", "verify_pass", "verifier", "methods_agree", "n_methods", "agreement_fuzzy_mean", "is_table_cell", "grid_agreement", "span_length", "page", "page_position", "has_text_layer",
    "window_kept_ratio", "route_plan_hash", "confidence", "decision",
)
#: the domain whose fields are cells of a table
TABLE_DOMAIN = "soa"


def mean_likeness(values: Column) -> Column:
    """Mean similarity of the words of each two of an array's distinct non-empty texts; null with fewer than two. The array is a field's candidates, one for each method."""
    own = F.array_distinct(F.filter(values, lambda v: F.coalesce(v, F.lit("")) != ""))
    pairs = F.flatten(F.transform(own, lambda a, i: F.transform(F.filter(own, lambda _, j: j > i), lambda b: jaccard(tokens(a), tokens(b)))))
    return F.when(F.size(own) >= 2, F.aggregate(pairs, F.lit(0.0), lambda x, y: x + y) / F.size(pairs))


def features(fields: DataFrame, candidates: DataFrame, kinds: DataFrame, pages: DataFrame | None = None, windows: DataFrame | None = None, grids: DataFrame | None = None) -> DataFrame:
    """A row of FEATURES for each assured field; null where nothing is known.

    fields: study_id, domain, field, value, quote_text, quote_page, verify_pass (null without a quote), verifier, methods_agree, n_methods,
    confidence, decision. candidates: study_id, domain, field, ord, value, and their quotes (quote_text, quote_page, verify_pass): a field without
    a quote takes that of the first candidate with its value. kinds: domain, field, field_type. pages: study_id, page, has_text; windows: study_id,
    domain, kept, dropped, plan_hash; grids: study_id, domain, field, grid_agreement.
    """
    keys = ["study_id", "domain", "field"]
    quote = F.struct(F.col("quote_text").alias("text"), F.col("quote_page").alias("page"), F.col("verify_pass").alias("how"))
    offered = candidates.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("ord", "value", quote.alias("quote")))).alias("_c"))
    rows = fields.withColumn("_own", quote).drop("quote_text", "quote_page", "verify_pass").join(offered, keys, "left").join(kinds.select("domain", "field", "field_type"), ["domain", "field"], "left")
    winner = F.get(F.filter("_c", lambda c: c["value"] == F.col("value")), F.lit(0))["quote"]
    rows = rows.withColumn("_q", F.when(F.col("_own.how").isNotNull(), F.col("_own")).otherwise(winner))
    # what candidates are needed for is worked out before anything else is joined, so they are not shuffled again
    rows = rows.select(
        *keys, "field_type", "value", "verifier", "methods_agree", "n_methods", "confidence", "decision",
        F.col("_q.page").cast("int").alias("page"), F.coalesce("_q.how", F.lit("none")).alias("verify_pass"), F.coalesce(F.char_length("_q.text"), F.lit(0)).alias("span_length"), mean_likeness(F.transform("_c", lambda c: c["value"])).alias("agreement_fuzzy_mean"),
    )
    rows = rows.withColumn("grid_agreement", F.lit(None).cast("double")) if grids is None else rows.join(grids.select(*keys, "grid_agreement"), keys, "left")
    if pages is None:
        rows = rows.withColumns({"_total": F.lit(None).cast("long"), "has_text_layer": F.lit(None).cast("boolean")})
    else:
        rows = rows.join(pages.groupBy("study_id").agg(F.collect_set(F.struct("page", "has_text")).alias("_pages")), "study_id", "left")
        total = F.size(F.array_distinct(F.filter(F.transform("_pages", lambda p: p["page"]), lambda p: p.isNotNull()))).cast("long")
        layer = F.exists("_pages", lambda p: (p["page"] == F.col("page")) & p["has_text"])
        there = F.col("_pages").isNotNull()
        rows = rows.withColumns({"_total": F.when(there, total), "has_text_layer": F.when(F.col("page").isNotNull() & there, F.coalesce(layer, F.lit(False)))}).drop("_pages")
    if windows is None:
        rows = rows.withColumns({"window_kept_ratio": F.lit(None).cast("double"), "route_plan_hash": F.lit(None).cast("string")})
    else:
        ratio = F.when(F.col("kept") + F.col("dropped") > 0, F.col("kept") / (F.col("kept") + F.col("dropped")))
        own = windows.groupBy("study_id").agg(F.collect_list(F.struct("domain", ratio.alias("window_kept_ratio"), F.col("plan_hash").alias("route_plan_hash"))).alias("_windows"))
        rows = rows.join(own, "study_id", "left").withColumn("_w", F.explode_outer(F.filter("_windows", lambda w: w["domain"] == F.col("domain")))).select("*", "_w.window_kept_ratio", "_w.route_plan_hash")
    made = {
        "field_type": F.coalesce("field_type", F.lit("unknown")), "value_present": F.col("value").isNotNull(), "is_table_cell": F.col("domain") == TABLE_DOMAIN,
        "page_position": F.when(F.col("page") > 0, F.col("page") / F.col("_total")),
    }
    return rows.withColumns(made).select(*FEATURES)


def write_features(rows: DataFrame, path: str) -> None:
    """Feature rows as a Parquet table, one folder for each domain, over what was there."""
    rows.select(*FEATURES).write.mode("overwrite").partitionBy("domain").parquet(path)


def missing_visits(visits: DataFrame, texts: DataFrame, key: str = "study_id") -> DataFrame:
    """(key, visit): visits that a study's text names by number and its schedule lacks; nothing for schedules without numbered visits. visits: key, label; texts: key, text."""
    numbers = lambda c, pattern: F.array_distinct(F.transform(F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(pattern), F.lit(1)), lambda x: x.cast("int")))
    there = visits.select(key, F.explode(numbers(F.col("label"), r"(?:\bvisit\s*|\bv)([0-9]{1,3})\b")).alias("visit")).distinct()
    named = texts.select(key, F.explode(numbers(F.col("text"), r"\bvisits?\s*([0-9]{1,3})\b")).alias("visit")).distinct()
    return named.join(there.select(key).distinct(), key, "left_semi").join(there, [key, "visit"], "left_anti")


def domains_touched(changes: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, domain, n): how many changed sections touch each domain. changes: keys, kind, domains (array)."""
    return changes.filter("kind <> 'unchanged'").select(*keys, F.explode("domains").alias("domain")).groupBy(*keys, "domain").agg(F.count("*").alias("n"))


#: columns of cells, whichever engine found them
CELLS = "doc_id long, engine string, page int, table_ix int, row int, col int, text string, x0 double, y0 double, x1 double, y1 double"


def all_cells(spark, engines: dict[str, DataFrame | None], pages: DataFrame | None = None) -> DataFrame:
    """Cells of all engines, in the order of CELLS; an engine that is not there (None) has none, and boxes that one lacks are null. pages (doc_id, page): only these."""
    out = spark.createDataFrame([], CELLS)
    for name, cells in engines.items():
        if cells is not None:
            named = {"engine": F.lit(name), **{c: F.lit(None).cast("double") for c in ("x0", "y0", "x1", "y1") if c not in cells.columns}}
            own = cells.withColumns(named)
            out = out.unionByName(own.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in out.schema.fields)))
    return out if pages is None else out.join(pages.select("doc_id", "page").distinct(), ["doc_id", "page"], "left_semi").select(*out.columns)


def live_jobs(log: DataFrame, now: Column, ttl_seconds: int = 3600) -> DataFrame:
    """(job, state, at): the last state of each job; finished ones (done, failed) that are older than ttl_seconds are gone. log: job, state, at, seq."""
    last = log.groupBy("job").agg(F.max(F.struct("seq", "state", "at")).alias("_l")).select("job", "_l.state", "_l.at")
    old = F.col("state").isin("done", "failed") & (now.cast("timestamp").cast("double") - F.col("at").cast("timestamp").cast("double") > ttl_seconds)
    return last.filter(~old)
