"""What sections are about, on three axes, and what a title page says of a study."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .folds import by_generation

# Words of a title, in the order in which they are tried, and the type, subtype and authority that they stand for.
TITLE_AXES = (
    (r"protocol amendment|summary of (?:key )?changes|amendment (?:history|summary)|document history|overall rationale for (?:the )?(?:protocol )?amendment", "summary", "amendment_history", "amendment_summary"),
    (r"table of contents|list of (?:tables|figures|appendices)", "header", "table_of_contents", "page_furniture"),
    (r"title page|investigator'?s? (?:agreement|signature|statement)|sponsor (?:signature|approval)|protocol (?:approval|signature)", "header", None, "title_identity"),
    (r"abbreviations?|glossary|definitions? of terms", "summary", "abbreviations", "abbreviation_section"),
    (r"schedule of (?:activities|assessments|events)|study (?:flow ?chart|schedule)|flow ?chart|time and events|visit schedule|study plan and timing", "assessments", "soa_main", "soa_table_current"),
    (r"estimands?", "science", "estimands_table", "estimand_column"),
    (r"objectives?|endpoints?", "science", "objectives_table", "objective_column"),
    (r"synopsis|protocol summary|study summary", "summary", None, "content_section"),
    (r"references|bibliography", "references", None, "content_section"),
    (r"appendix|appendices|attachment|annex|supporting documentation", "appendix", None, "content_section"),
    (r"discontinuation|withdrawal|lost to follow|early termination|participant disposition|completion of the study", "disposition", None, "content_section"),
    (r"sample size", "statistics", "sample_size", "sample_size_section"),
    (r"analysis (?:sets?|populations?)|populations for analys", "statistics", "analysis_sets", "statistics_section"),
    (r"interim analys", "statistics", "interim_analysis", "interim_analysis_section"),
    (r"statistic|data analys|analysis methods?|statistical hypothes", "statistics", "general_statistics", "statistics_section"),
    (r"committees?|governance|data monitoring|adjudication", "appendix", "committee_governance", "adjudication_committee"),
    (r"ethics\b|ethical (?:conduct|considerations|and regulatory)|regulatory|data (?:management|handling|protection)|quality (?:control|assurance)|informed consent|publication|record keeping|monitoring of the study|audits?\b", "appendix", None, "content_section"),
    (r"(?:inclusion|exclusion|eligibility) criteria|study population|selection of (?:study )?(?:population|participants|patients|subjects)|lifestyle (?:considerations|restrictions)|screen failures", "population", None, "content_section"),
    (r"study design|investigational plan|overall design|design of the study|schema|scientific rationale for (?:the )?study design|end of study definition", "design", None, "content_section"),
    (r"study interventions?|study treatments?|investigational (?:product|medicinal)|study drugs?|dosing|dosage|concomitant (?:therapy|medication)|treatments? administered|blinding|randomi[sz]ation", "interventions", None, "content_section"),
    (r"pharmacokinetic|pharmacodynamic", "assessments", "pk_assessment", "assessment_prose"),
    (r"tumou?r assessment|recist", "assessments", "tumor_assessment", "assessment_prose"),
    (r"response criteria", "appendix", "response_criteria", "response_criteria_appendix"),
    (r"clinical laboratory|laboratory (?:tests|assessments|evaluations)", "assessments", "lab_inventory", "assessment_prose"),
    (r"assessments?|procedures|efficacy|safety|adverse events?|vital signs|physical examination|electrocardiogram|biomarkers?|immunogenicity", "assessments", None, "assessment_prose"),
    (r"introduction|background|rationale|benefit[/ ]risk", "introduction", None, "content_section"),
)
APPENDIX_START = r"^\s*(?:appendix|attachment|annex)\b"
HISTORY, SCHEDULES, HISTORIC_SCHEDULE = "amendment_history", ("soa_main", "soa_followup"), "soa_table_historic"
# Kinds of studies in the order in which they are tried; where to look, whether the study has several parts, and patterns of which all have to be found.
FAMILIES = (
    ("master_vaccine_protocol", "title", True, (r"\bmaster protocol\b", r"\bvaccin")),
    ("umbrella_substudy_protocol", "title", True, (r"\bumbrella\b",)),
    ("vaccine_substudy_protocol", "title", True, (r"\bvaccin", r"\bsub-?study\b")),
    ("seamless_phase2b3", "title", True, (r"\bseamless\b", r"\bphase (?:2b|ii b|2/3|2b/3|iib/iii)\b")),
    ("master_protocol_substudies", "sections", True, (r"\bsub-?stud(?:y|ies)\b",)),
    ("sli_plus_randomized_phase3", "title", True, (r"\bsafety (?:lead|run)-in\b",)),
    ("phase1b_phase2_split", "phases", True, (r"\bphase_1b\b", r"\bphase_2\b")),
    ("blinded_extension_with_open_label_cohort", "sections", True, (r"\bpart ia\b", r"\bpart ib\b", r"\bopen[- ]label cohort\b|\bpart ii\b")),
    ("multi_part_randomized_oncology", "sections", True, (r"\bpart (?:1|a)\b", r"\bpart (?:2|b)\b")),
    ("ddi_cohort_embedded", "sections", True, (r"\bddi cohort\b|\bdrug[- ]drug interaction cohort\b",)),
    ("randomized_withdrawal_extension", "title", True, (r"\brandomi[sz]ed[- ]withdrawal\b", r"\btitration\b")),
    ("period_split_blinded_extension", "sections", True, (r"\bperiod a\b", r"\bperiod b\b")),
    ("randomized_blinded_extension", "title", False, (r"\b(?:blinded )?extension\b|\btitration\b",)),
    ("physician_choice_comparator_oncology", "title", False, (r"\b(?:physician|investigator)'?s'? choice\b",)),
    ("maintenance_randomized_oncology", "title", False, (r"\bmaintenance (?:therapy|treatment)\b|\bas maintenance\b",)),
    ("pediatric_inclusive_phase3", "title", False, (r"\badolescents?\b", r"\bphase (?:3|iii)\b")),
    ("clinical_pharmacology_table_driven", "title", False, (r"\bpharmacokinetic",)),
)
DEFAULT_FAMILY = "standard_randomized_phase3"

LABELS = "struct<type:string,subtype:string,authority:string>"


def _labels(kind: str | Column | None, subtype: str | Column | None, authority: str | Column | None) -> Column:
    column = lambda x: x if isinstance(x, Column) else F.lit(x).cast("string")
    return F.struct(column(kind).alias("type"), column(subtype).alias("subtype"), column(authority).alias("authority"))


def title_labels(title: Column) -> Column:
    """struct(type, subtype, authority) of a section's own title, all null without a sign; a title that starts as an appendix is one, whatever it is about."""
    low = F.lower(F.coalesce(title, F.lit("")))
    attached, out = low.rlike(APPENDIX_START), None
    for pattern, *axes in TITLE_AXES:
        labels = _labels(F.when(attached, "appendix").otherwise(axes[0]), *axes[1:])
        hit = low.rlike(rf"\b(?:{pattern})")
        out = F.when(hit, labels) if out is None else out.when(hit, labels)
    return out.otherwise(_labels(None, None, None))


def settle(own: Column, above: Column) -> Column:
    """Labels of a section under those of its parent: without a type of its own it has the parent's; below an appendix it is one; below a history of amendments all is historic, and a schedule is a historic schedule."""
    kind = F.when(above["type"] == "appendix", "appendix").otherwise(own["type"])
    historic = above["subtype"] == HISTORY
    authority = F.when(historic, F.when(own["subtype"].isin(*SCHEDULES), HISTORIC_SCHEDULE).otherwise(above["authority"])).otherwise(own["authority"])
    return F.when(own["type"].isNull(), above).otherwise(_labels(kind, F.when(historic, HISTORY).otherwise(own["subtype"]), authority))


def label_sections(nested: DataFrame) -> DataFrame:
    """Adds type, subtype and authority to sections (doc_id, ord, parent_ord, title), each after its parent, to any depth."""
    kept = [c for c in nested.columns if c not in ("type", "subtype", "authority")]
    rows = nested.select(*kept, title_labels(F.col("title")).alias("_labels"))
    return by_generation(rows, ["doc_id", "ord"], "parent_ord", "_labels", settle).select(*kept, "_labels.*")


def phase_scopes(text: Column) -> Column:
    """Distinct phases in the order of the text, as phase_1, phase_1b, phase_2 and so on; lists such as "phase 2/3" give each. Of the letters only that of 1b counts."""
    token = r"(?:[1-4]|iv|i{1,3})[ab]?"
    lists = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(rf"\bphase\s+({token}(?:\s*/\s*{token})*)\b"), F.lit(1))
    tokens = F.flatten(F.transform(lists, lambda x: F.split(x, r"\s*/\s*")))

    def scope(x: Column) -> Column:
        bare = F.regexp_replace(x, "[ab]$", "")
        number = F.when(bare == "iv", "4").when(bare.rlike("^i+$"), F.char_length(bare).cast("string")).otherwise(bare)
        return F.concat(F.lit("phase_"), number, F.when((number == "1") & x.endswith("b"), "b").otherwise(""))

    return F.array_distinct(F.transform(tokens, scope))


def fingerprint(pages: DataFrame, sections: DataFrame) -> DataFrame:
    """One row per document: archetype, detected, phases, multi_part, explicit_estimands, tags, confidence.

    pages: doc_id, title_page; sections: doc_id, title, type, subtype. The first family whose signs are all there is taken, else the default with
    less confidence.
    """
    by_doc = sections.groupBy("doc_id").agg(
        F.concat_ws("\n", F.array_sort(F.collect_set("title"))).alias("_sections"),
        F.max(F.coalesce((F.col("type") == "appendix") & (F.col("subtype") == HISTORY), F.lit(False))).alias("_history"),
        F.max(F.coalesce(F.col("subtype") == "analysis_sets", F.lit(False))).alias("_sets"),
        F.max(F.coalesce(F.col("subtype") == "estimands_table", F.lit(False))).alias("_estimands"),
    )
    rows = pages.join(by_doc, "doc_id", "left").withColumn("phases", phase_scopes(F.col("title_page")))
    texts = {"title": F.lower(F.coalesce("title_page", F.lit(""))), "sections": F.lower(F.coalesce("_sections", F.lit(""))), "phases": F.concat_ws(" ", "phases")}
    family = None
    for name, where, _, patterns in FAMILIES:
        hit = texts[where].rlike(patterns[0])
        for p in patterns[1:]:
            hit = hit & texts[where].rlike(p)
        family = F.when(hit, name) if family is None else family.when(hit, name)
    found = rows.withColumn("_family", family)
    there = lambda c: F.coalesce(F.col(c), F.lit(False))
    tags = F.array_compact(F.array(F.when(there("_history"), F.lit("historical_amendment_appendix")), F.when(there("_sets"), F.lit("explicit_analysis_sets"))))
    detected = F.col("_family").isNotNull()
    return found.select("doc_id", F.coalesce("_family", F.lit(DEFAULT_FAMILY)).alias("archetype"), detected.alias("detected"), "phases", F.coalesce(F.col("_family").isin(*(name for name, _, several, _ in FAMILIES if several)), F.lit(False)).alias("multi_part"), there("_estimands").alias("explicit_estimands"), tags.alias("tags"), F.when(detected, 0.7).otherwise(0.4).alias("confidence"))
