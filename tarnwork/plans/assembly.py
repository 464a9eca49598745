"""Model calls, sanitising, assembly shapes, validation and repair."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..shared import checkpointed

#: a model: prompts in, replies out, in order; None stands for no model
Model = Callable[[list[str]], list[str]]


def complete(prompts: DataFrame, model: Model | None) -> DataFrame:
    """Adds reply to prompts (prompt); without a model every reply is null, and what depends on it stays absent."""
    if model is None:
        return prompts.withColumn("reply", F.lit(None).cast("string"))

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.assign(reply=model(batch["prompt"].tolist()) if len(batch) else [])

    return prompts.mapInPandas(scan, f"{prompts.schema.simpleString()[7:-1]},reply:string")


def parse_candidates(replies: DataFrame, keys: list[str], fields: DataFrame) -> DataFrame:
    """(keys, field, value, quote) of replies that hold a JSON array between the outermost brackets; unknown fields and empty values go; so does what does not parse."""
    inner = F.regexp_extract("reply", r"(?s)(\[.*\])", 1)
    rows = replies.filter(F.col("reply").isNotNull()).select(*keys, F.explode(F.from_json(inner, "array<struct<field:string,value:string,quote:string>>")).alias("_c")).select(*keys, "_c.*")
    return rows.filter(F.trim(F.coalesce("value", F.lit(""))) != "").join(fields.select("field"), "field", "left_semi").select(*keys, "field", "value", F.nullif(F.trim("quote"), F.lit("")).alias("quote"))


#: fields that one call may ask for; characters of a document that a prompt holds, if not told otherwise
MOST_FIELDS, MOST_CHARACTERS = 40, 40_000


def shards(spark, table: dict[str, tuple[str, list[str]]]) -> DataFrame:
    """(shard, domain, field, ord) of {shard: (domain, fields)}: what one call asks for. More than MOST_FIELDS, or none, is refused."""
    for name, (_, fields) in table.items():
        if not 0 < len(fields) <= MOST_FIELDS:
            raise ValueError(f"shard {name} has {len(fields)} fields")
    return spark.createDataFrame([(name, domain, field, i) for name, (domain, fields) in table.items() for i, field in enumerate(fields)], "shard string, domain string, field string, ord int")


def two_pass(texts: DataFrame, parts: DataFrame, model: Model | None, most_characters: int | None = MOST_CHARACTERS) -> DataFrame:
    """(doc_id, shard, domain, field, value, quote): candidates of a model that first reasons about a document and then answers as a JSON array.

    texts: doc_id, text; parts: shards. A prompt holds most_characters of a text (None: all). Blank replies of either pass, what does not parse,
    fields that the shard lacks and empty values give nothing; without a model there are no candidates.
    """
    asked = parts.groupBy("shard", "domain").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "field"))), lambda x: x["field"]), ", ").alias("fields"))
    text = F.coalesce("text", F.lit(""))
    rows = texts.select("doc_id", (text if most_characters is None else F.substring(text, 1, most_characters)).alias("text")).filter("text <> ''").crossJoin(asked)  # a row for each shard, of which there are a few
    first = rows.withColumn("prompt", F.concat(F.lit("Find what the document says about: "), "fields", F.lit("\nQuote it word for word.\n\n"), "text"))
    notes = complete(first, model).filter(F.trim(F.coalesce("reply", F.lit(""))) != "").withColumnRenamed("reply", "notes")
    second = notes.withColumn("prompt", F.concat(F.lit("Answer with a JSON array of {field, value, quote} for: "), "fields", F.lit("\n\n"), "notes", F.lit("\n\n"), "text"))
    replies = complete(second, model).select("doc_id", "shard", "domain", "reply")
    got = parse_candidates(replies, ["doc_id", "shard", "domain"], parts.select("field").distinct())
    return got.join(parts.select("shard", "field"), ["shard", "field"], "left_semi").select("doc_id", "shard", "domain", "field", "value", "quote")


#: a page as a vision model describes it
PAGE = "struct<is_schedule:boolean,columns:array<struct<visit:string,epoch:string>>,rows:array<struct<activity:string,marks:array<int>>>>"


def schedule_pages(replies: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, page, activity, visit_key, epoch, ord) of replies (keys, page, reply) that are JSON of a schedule page with columns.

    Marks outside the columns go, and repeated ones. A visit's key is its name and how often the page had it before; empty epochs take the one
    to their left.
    """
    pages = replies.select(*keys, "page", F.from_json("reply", PAGE).alias("p")).filter(F.coalesce("p.is_schedule", F.lit(False)) & (F.size(F.coalesce("p.columns", F.array())) > 0))
    columns = pages.select(*keys, "page", F.posexplode("p.columns").alias("col", "c"))
    name = F.lower(F.trim(F.coalesce("c.visit", F.lit(""))))
    w = Window.partitionBy(*keys, "page")
    nth = F.row_number().over(w.partitionBy(*keys, "page", name).orderBy("col"))
    epoch = F.last(F.nullif(F.trim("c.epoch"), F.lit("")), ignorenulls=True).over(w.orderBy("col").rowsBetween(Window.unboundedPreceding, 0))
    columns = columns.select(*keys, "page", "col", F.concat(name, F.lit("#"), nth.cast("string")).alias("visit_key"), F.coalesce(epoch, F.lit("")).alias("epoch"))
    rows = pages.select(*keys, "page", F.explode("p.rows").alias("r")).select(*keys, "page", F.trim("r.activity").alias("activity"), F.explode(F.array_distinct(F.coalesce("r.marks", F.array()))).alias("col"))
    return rows.join(columns, [*keys, "page", "col"]).select(*keys, "page", "activity", "visit_key", "epoch", F.col("col").alias("ord"))


def classify_residue(sections: DataFrame, model: Model | None, types: list[str]) -> DataFrame:
    """Sections with a model's answer for those without a type, where it is one of the types; unchanged without a model."""
    asked = complete(sections.filter("type is null").withColumn("prompt", F.col("title")), model)
    answer = F.lower(F.trim("reply"))
    typed = asked.withColumn("type", F.when(answer.isin(types), answer)).select(*sections.columns)
    return sections.filter("type is not null").unionByName(typed)


#: columns of a study that must be there, as conditions
STRUCTURE = {"has_title": "coalesce(trim(title), '') <> ''", "has_arms": "n_arms > 0", "has_visits": "n_visits > 0"}


def gates(studies: DataFrame, key: str, rules: DataFrame | None = None) -> DataFrame:
    """(key, rules): failed structural rules of each study, and those of an outside rule table (key, rule) for studies that pass them."""
    own = studies.select(key, F.array_compact(F.array(*(F.when(~F.coalesce(F.expr(e), F.lit(False)), F.lit(n)) for n, e in STRUCTURE.items()))).alias("rules"))
    if rules is None:
        return own
    other = rules.join(own.filter(F.size("rules") == 0).select(key), key, "left_semi").groupBy(key).agg(F.collect_set("rule").alias("rules"))
    return own.unionByName(other)


def parse_verdict(reply: F.Column) -> F.Column:
    """supported, partial or unsupported, as whole words; null for anything else."""
    word = F.regexp_extract(F.lower(F.coalesce(reply, F.lit(""))), r"(?:^|[^a-z])(unsupported|supported|partial)(?:[^a-z]|$)", 1)
    return F.nullif(word, F.lit(""))


def sanitize(rows: DataFrame, keys: list[str], defaults: dict[str, tuple[str, str]]) -> tuple[DataFrame, DataFrame]:
    """Fills missing values with defaults (value, severity), and gives a finding (keys, field, severity) for each one filled. White space is trimmed first."""
    trimmed = {c: F.nullif(F.trim(F.regexp_replace(c, r"[\s\p{Cc}]+", " ")), F.lit("")) for c in defaults}
    clean = rows.withColumns(trimmed)
    found = F.explode(F.array_compact(F.array(*(F.when(F.col(c).isNull(), F.struct(F.lit(c).alias("field"), F.lit(severity).alias("severity"))) for c, (_, severity) in defaults.items())))).alias("_f")
    return clean.withColumns({c: F.coalesce(c, F.lit(value)) for c, (value, _) in defaults.items()}), clean.select(*keys, found).select(*keys, "_f.*")


def unique_names(rows: DataFrame, keys: list[str], name: str, order: str) -> DataFrame:
    """Repeated names get " (2)", " (3)" and so on, in order."""
    nth = F.row_number().over(Window.partitionBy(*keys, F.lower(name)).orderBy(order))
    return rows.withColumn(name, F.when(nth > 1, F.concat(name, F.lit(" ("), nth.cast("string"), F.lit(")"))).otherwise(F.col(name)))


def timeline(cells: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, activity, visits, previous, next): sorted visits of each activity's marks, and its neighbours. cells: keys, activity_ord, activity, visit, marked."""
    rows = cells.groupBy(*keys, "activity_ord", "activity").agg(F.array_sort(F.collect_set(F.when(F.col("marked"), F.col("visit")))).alias("visits"))
    w = Window.partitionBy(*keys).orderBy("activity_ord")
    return rows.select(*keys, "activity", "visits", F.lag("activity").over(w).alias("previous"), F.lead("activity").over(w).alias("next"))


def amendment_input(diff: DataFrame, keys: list[str]) -> DataFrame:
    """Counts of changes by kind; nothing for a key without changes."""
    changed = F.col("kind") != "unchanged"
    return diff.groupBy(*keys).agg(*(F.count_if(F.col("kind") == k).alias(f"n_{k}") for k in ("added", "removed", "modified")), F.count_if(changed).alias("_n")).filter("_n > 0").drop("_n")


def assemble(base: DataFrame, parts: dict[str, DataFrame], key: str) -> DataFrame:
    """Nested documents: a column for each part, null where a key has none, and the share of parts that are there. parts: key and the part's columns."""
    out = base.select(key)
    for name, part in parts.items():
        rest = [c for c in part.columns if c != key]
        out = out.join(part.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*rest))).alias(name)), key, "left")
    there = [F.col(name).isNotNull().cast("int") for name in parts]
    total = there[0]
    for t in there[1:]:
        total = total + t
    return out.withColumn("produced", total / len(parts))


def failed_rules(gates: DataFrame, key: str) -> DataFrame:
    """The sorted distinct rules that failed over all gates of a key. gates: key, rules (array)."""
    return gates.groupBy(key).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("rules")))).alias("failed"))


def repair(state: DataFrame, keys: list[str], validate: Callable[[DataFrame], DataFrame], reextract: Callable[[DataFrame], DataFrame], rounds: int = 2) -> tuple[DataFrame, DataFrame]:
    """State and leftover failures (keys) after at most `rounds` rounds: failed keys are extracted again, and a new value is taken if it is there and differs.

    Each round is cut off by a checkpoint, which needs the session's checkpoint folder.
    """
    failed = validate(state)
    for _ in range(rounds):
        if failed.isEmpty():
            break
        new = reextract(failed).select(*keys, F.col("value").alias("_new"))
        better = F.col("_new").isNotNull() & ~F.col("_new").eqNullSafe(F.col("value"))
        merged = state.join(new, keys, "left").withColumn("_better", F.coalesce(better, F.lit(False))).transform(checkpointed)
        if merged.filter("_better").isEmpty():
            break
        state = merged.withColumn("value", F.when(F.col("_better"), F.col("_new")).otherwise(F.col("value"))).drop("_new", "_better")
        failed = validate(state)
    return state, failed
