"""Which sections a field is read from: plans by study, settled from a table of rules by how specific they are."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.sections import scope_matches

#: what a rule makes of the sections that it names, from the strongest
ROLES = ("prohibited", "primary", "supporting")
AXES = ("types", "subtypes", "scopes")
RULE = "rule int, field string, role string, family string, phase string, types array<string>, subtypes array<string>, scopes array<string>"


def study_plans(studies: DataFrame, rules: DataFrame) -> DataFrame:
    """(doc_id, field, prohibited, primary, supporting): for every field of the rules and each role the scope, struct(rule, types, subtypes, scopes), or null without a rule.

    studies: doc_id, family, phase; rules as RULE. A rule with a family or a phase holds for studies of that family or phase, one with neither for all. Of those
    that hold, the more specific one decides: with both, then by family, then by phase, then neither; of equals the rule of the lower number. Axes that a rule
    leaves null are empty. Each study asks for the four ways in which a rule can name it, so both sides meet by equality.
    """
    none = F.lit(None).cast("string")
    ways = [(F.col("family"), F.col("phase"), 3), (F.col("family"), none, 2), (none, F.col("phase"), 1), (none, none, 0)]
    asked = F.filter(F.array(*(F.struct(f.alias("f"), p.alias("p"), F.lit(n).alias("n")) for f, p, n in ways)), lambda w: ((w["n"] < 2) | w["f"].isNotNull()) & ((w["n"] % 2 == 0) | w["p"].isNotNull()))
    names = studies.select("doc_id", F.explode(asked).alias("_w"))
    axes = [F.coalesce(a, F.array().cast("array<string>")).alias(a) for a in AXES]
    held = names.join(rules.select("rule", "field", "role", "family", "phase", *axes), F.col("_w.f").eqNullSafe(F.col("family")) & F.col("_w.p").eqNullSafe(F.col("phase")))
    best = held.groupBy("doc_id", "field", "role").agg(F.max_by(F.struct("rule", *AXES), F.struct("_w.n", -F.col("rule"))).alias("_s"))
    return best.groupBy("doc_id", "field").agg(*(F.max(F.when(F.col("role") == r, F.col("_s"))).alias(r) for r in ROLES))


def routed(plans: DataFrame, sections: DataFrame) -> DataFrame:
    """(doc_id, ord, field, role): what each section is to each field of its study; sections of no role are left out. sections: doc_id, ord, type, subtype, scope.

    A scope holds for a section if all axes that it names do. What is prohibited is nothing else, and primary is more than supporting.
    """
    met = sections.select("doc_id", "ord", "type", "subtype", "scope").join(plans, "doc_id")
    section = {"types": F.col("type"), "subtypes": F.col("subtype"), "scopes": F.col("scope")}
    role = F.coalesce(*(F.when(F.col(r).isNotNull() & scope_matches(section, {a: F.coalesce(F.col(f"{r}.{a}"), F.array().cast("array<string>")) for a in AXES}), F.lit(r)) for r in ROLES))
    return met.select("doc_id", "ord", "field", role.alias("role")).filter(F.col("role").isNotNull())


def without_evidence(plans: DataFrame, routed_: DataFrame) -> DataFrame:
    """(doc_id, field): fields with a plan that no section of the study is primary or supporting for; they fall back to the whole text."""
    return plans.select("doc_id", "field").join(routed_.filter("role <> 'prohibited'").select("doc_id", "field").distinct(), ["doc_id", "field"], "left_anti")
