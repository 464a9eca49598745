"""The whole loop: from texts to decided fields, findings, features and nested studies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..shared import checkpointed
from ..operators import features as V
from ..operators import fields as X
from ..operators.blocks import classify_blocks, head_text, strip_furniture, text_blocks
from ..operators.grids import demote
from ..operators.sections import nest, section_of, split_numbered, title_shaped
from ..operators.titles import HISTORY, fingerprint, label_sections
from .assembly import assemble, sanitize
from .routes import routed as by_plan
from .routes import study_plans
from .spine import metadata

#: which types of sections give evidence for a domain; what stands before the first section is for the metadata
ROUTES = {"metadata": ("header", "summary"), "design": ("design", "interventions", "summary"), "eligibility": ("population",), "objectives": ("science", "summary"), "estimands": ("science",)}


def headings(blocks: DataFrame) -> DataFrame:
    """(doc_id, ord, page, y0, level, title) of blocks that are set and worded like headings; a number such as 5.2 gives the level."""
    rows = classify_blocks(blocks).filter(F.col("kind") == "heading")
    number = F.regexp_extract("text", r"^\s*([0-9]+(?:\.[0-9]+)*)", 1)
    bare = F.regexp_replace("text", r"^\s*[0-9]+(?:\.[0-9]+)*\.?\s+", "")
    level = F.when(number == "", 1).otherwise(F.size(F.split(number, r"\.")))
    return rows.filter(title_shaped(bare)).select("doc_id", "ord", "page", "y0", level.alias("level"), F.col("text").alias("title"))


def domain_windows(blocks: DataFrame, sections: DataFrame, routes: dict[str, tuple[str, ...]] = ROUTES, plans: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Blocks with the domain that they are evidence for (a block can serve several), and windows (doc_id, domain, kept, dropped, fallback).

    sections: with type and subtype. What stands under a history of amendments is evidence for nothing. A domain without any block of its own
    falls back to all of the document that is not historic. plans: those of routes.study_plans, whose fields are domains of `routes`; for documents with a plan they
    say which sections are evidence, and what stands before the first section is for the metadata as ever.
    """
    placed = section_of(blocks, sections.withColumn("_sec", F.col("ord")), ["type", "subtype", "_sec"]).filter(~F.coalesce(F.col("subtype") == HISTORY, F.lit(False)))
    own = F.array_compact(F.array(*(F.when(F.col("type").isin(*types) | ((F.col("type").isNull()) & F.lit(domain == "metadata")), F.lit(domain)) for domain, types in routes.items())))
    if plans is None:
        routed = placed.withColumn("_own", own)
    else:
        scoped = sections if "scope" in sections.columns else sections.withColumn("scope", F.lit(None).cast("string"))
        evidence = by_plan(plans, scoped).filter("role <> 'prohibited'").groupBy("doc_id", F.col("ord").alias("_sec")).agg(F.collect_set("field").alias("_named"))
        planned = plans.select("doc_id", F.lit(True).alias("_planned")).distinct()
        front = F.when(F.col("_sec").isNull(), F.array(F.lit("metadata"))).otherwise(F.array().cast("array<string>"))
        routed = placed.join(evidence, ["doc_id", "_sec"], "left").join(planned, "doc_id", "left").withColumn("_own", F.when(F.col("_planned"), F.array_intersect(F.array(*map(F.lit, routes)), F.array_union(F.coalesce("_named", F.array().cast("array<string>")), front))).otherwise(own))
    some = routed.groupBy("doc_id").agg(F.flatten(F.collect_set("_own")).alias("_some"))
    every = F.array(*map(F.lit, routes))
    left = F.array_except(every, F.array_distinct("_some"))
    rows = routed.join(some, "doc_id").select(*blocks.columns, F.explode(F.array_union("_own", left)).alias("domain"), "_some")
    counts = rows.groupBy("doc_id", "domain").agg(F.count("*").alias("kept"), (~F.max(F.array_contains("_some", F.col("domain")))).alias("fallback"))
    total = blocks.groupBy("doc_id").agg(F.count("*").alias("_n"))
    return rows.drop("_some"), counts.join(total, "doc_id").select("doc_id", "domain", "kept", (F.col("_n") - F.col("kept")).alias("dropped"), "fallback")


def _texts(rows: DataFrame, domain: str) -> DataFrame:
    """(doc_id, text) of a domain's window: a document's blocks in order, one line each."""
    own = rows.filter(F.col("domain") == domain).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("ord", "text"))).alias("_b"))
    return own.select("doc_id", F.array_join(F.transform("_b", lambda b: b["text"]), "\n").alias("text"))


def full_loop(docs: DataFrame, labels: DataFrame, others: DataFrame | None = None, visits: DataFrame | None = None, threshold: float = 0.9, rules: DataFrame | None = None) -> dict[str, DataFrame]:
    """Every stage's table, by name: fields, arms, criteria, objectives, estimands, windows, findings, features and studies.

    docs: doc_id, text; labels and others as for the metadata; visits (doc_id, label): the columns of schedules, where some are known. A field is
    accepted at a confidence of `threshold`, or reviewed; fields of a domain with an ERROR are reviewed in any case. Documents without text have a
    study without parts. rules: as routes.RULE, with domains for fields; families are the archetypes of documents and phases the first that their first page
    names (phase_2). One pass over the texts makes the blocks; everything else joins by document.
    """
    blocks = strip_furniture(text_blocks(docs)).transform(checkpointed)
    sections = label_sections(nest(headings(blocks))).transform(checkpointed)
    plans = None
    if rules is not None:
        seen = fingerprint(head_text(blocks, 1).withColumnRenamed("head", "title_page"), sections)
        plans = study_plans(seen.select("doc_id", F.col("archetype").alias("family"), F.get("phases", F.lit(0)).alias("phase")), rules).transform(checkpointed)
    rows, windows = domain_windows(blocks, sections, plans=plans)
    rows = rows.transform(checkpointed)

    decided = metadata(docs, labels, others)
    design = _texts(rows, "design").withColumn("_a", X.arm_names(F.col("text")))
    arms = design.select("doc_id", F.posexplode("_a").alias("ord", "name")).withColumn("type", X.arm_type(F.col("name")))
    side = F.when(F.lower("text").rlike(r"exclusion criteria"), "exclusion").otherwise("inclusion")
    parts = _texts(rows, "eligibility").select("doc_id", F.explode(F.split("text", r"(?i)(?=exclusion criteria)")).alias("text"))
    criteria = split_numbered(parts.select(F.struct("doc_id", side.alias("category")).alias("doc_id"), "text").select(F.to_json("doc_id").alias("_k"), "text").withColumn("doc_id", F.xxhash64("_k")).select("doc_id", "text"))
    sides = parts.select(F.xxhash64(F.to_json(F.struct("doc_id", side.alias("category")))).alias("_k"), "doc_id", side.alias("category")).distinct()
    criteria = criteria.withColumnRenamed("doc_id", "_k").join(sides, "_k").select("doc_id", "category", "n", "item").distinct()
    aims = _texts(rows, "objectives").select("doc_id", X.objectives(F.col("text")).alias("o")).select("doc_id", F.expr("stack(3, 'primary', o.primary, 'secondary', o.secondary, 'exploratory', o.exploratory) as (tier, objective)")).filter("objective is not null")
    estimands = X.estimand_groups(rows.filter("domain = 'estimands'").select("doc_id", "ord", "text"))

    count = lambda df, name, when=None: df.groupBy("doc_id").agg((F.count("*") if when is None else F.count_if(when)).alias(name))
    known = docs.select("doc_id").distinct()
    totals = known
    for part in (count(arms, "n_arms"), count(aims, "n_primary", F.col("tier") == "primary"), count(criteria, "n_inclusion", F.col("category") == "inclusion"), count(criteria, "n_exclusion", F.col("category") == "exclusion")):
        totals = totals.join(part, "doc_id", "left")
    there = lambda c: F.when(F.col(c).isNotNull(), F.col(c))  # noqa: E731  a domain that nothing was found for stays silent
    findings = X.completeness(totals.select(F.col("doc_id").alias("study_id"), F.lit(None).cast("string").alias("ratio"), there("n_arms").alias("n_arms"), F.lit(None).cast("int").alias("n_visits"), F.lit(None).cast("int").alias("n_activities"), there("n_primary").alias("n_primary"), F.lit(None).cast("int").alias("n_endpoints"), there("n_inclusion").alias("n_inclusion"), there("n_exclusion").alias("n_exclusion")))
    findings = findings.withColumnRenamed("study_id", "doc_id").unionByName(windows.filter("fallback").select("doc_id", F.concat(F.lit("no_section_for_"), "domain").alias("kind"), F.lit("INFO").alias("severity")))
    if visits is not None:
        lost = V.missing_visits(visits.select(F.col("doc_id").alias("study_id"), "label"), docs.select(F.col("doc_id").alias("study_id"), "text"))
        findings = findings.unionByName(lost.select(F.col("study_id").alias("doc_id"), F.concat(F.lit("visit_"), F.col("visit").cast("string"), F.lit("_not_in_schedule")).alias("kind"), F.lit("WARNING").alias("severity")))

    fields = decided.withColumn("domain", F.concat(F.lit("metadata/"), F.col("doc_id").cast("string")))
    bad = findings.filter("severity = 'ERROR'").select(F.concat(F.lit("metadata/"), F.col("doc_id").cast("string")).alias("domain"), "severity")
    gated = fields.withColumn("decision", F.when(F.col("decision") == "BLOCK", "BLOCK").when(F.col("confidence") >= threshold, "AUTO_ACCEPT").otherwise("REVIEW"))
    fields = demote(gated, bad).withColumn("domain", F.lit("metadata")).select("doc_id", "domain", "field", "value", "confidence", "decision")

    candidates = fields.select(F.col("doc_id").alias("study_id"), "domain", "field", F.lit(0).alias("ord"), "value", F.col("value").alias("quote_text"), F.lit(None).cast("int").alias("quote_page"), F.lit("exact").alias("verify_pass")).filter("value is not null")
    none = lambda kind: F.lit(None).cast(kind)
    assured = fields.select(F.col("doc_id").alias("study_id"), "domain", "field", "value", none("string").alias("quote_text"), none("int").alias("quote_page"), none("string").alias("verify_pass"), F.lit("n/a").alias("verifier"), (F.col("confidence") >= threshold).alias("methods_agree"), F.lit(1).alias("n_methods"), "confidence", "decision")
    kinds = labels.select(F.lit("metadata").alias("domain"), "field", F.lit("scalar").alias("field_type")).distinct()
    pages = blocks.groupBy(F.col("doc_id").alias("study_id"), "page").agg(F.lit(True).alias("has_text"))
    features = V.features(assured, candidates, kinds, pages, windows.select(F.col("doc_id").alias("study_id"), "domain", "kept", "dropped", F.sha2("domain", 256).alias("plan_hash")))

    clean = sanitize(arms, ["doc_id", "ord"], {"name": ("unnamed arm", "WARNING")})[0]
    accepted = fields.filter("value is not null").select("doc_id", "field", "value", "decision")
    studies = assemble(known, {"metadata": accepted, "arms": clean, "criteria": criteria, "objectives": aims, "estimands": estimands}, "doc_id")
    return {"fields": fields, "arms": arms, "criteria": criteria, "objectives": aims, "estimands": estimands, "windows": windows, "findings": findings, "features": features, "studies": studies}


def produced(studies: DataFrame) -> Column:
    """Names of the parts that a study has, in order."""
    return F.array_compact(F.array(*(F.when(F.col(c).isNotNull(), F.lit(c)) for c in studies.columns if c not in ("doc_id", "produced"))))
