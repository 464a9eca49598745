"""What a run leaves behind: studies, reviews, scoreboards, logs; dimensions that it reads; models by role."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.assembly import Model, complete, parse_verdict


def source_identities(spark: SparkSession, path: str) -> DataFrame:
    """(path, sha256) of the bytes of files."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", F.sha2("content", 256).alias("sha256"))


def write_run(studies: DataFrame, reviews: DataFrame, board: DataFrame, path: str) -> None:
    """JSON of a run under path: studies that were assembled (produced above 0), rows for reviewers, the scoreboard."""
    studies.filter("produced > 0").write.mode("overwrite").json(f"{path}/studies")
    reviews.write.mode("overwrite").json(f"{path}/review")
    board.write.mode("overwrite").json(f"{path}/scoreboard")


def log_heldout(runs: DataFrame, heldout: list[str], path: str) -> None:
    """Appends runs (studies as an array, mode, accuracy) that scored a held-out study to a JSON log; others leave no line."""
    runs.filter(F.arrays_overlap("studies", F.array(*map(F.lit, heldout)))).write.mode("append").json(path)


def dimension(spark: SparkSession, path: str, schema: str, default: list[tuple]) -> DataFrame:
    """A small table of settings from JSON lines, or the default rows where there is no such file."""
    try:
        return spark.read.schema(schema).json(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame(default, schema)


def unknown_labels(rules: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(axis, value) that rules use and the vocabulary lacks; both have axis and value. A run should start with none."""
    return rules.filter("value is not null").select("axis", "value").distinct().join(vocabulary, ["axis", "value"], "left_anti")


def by_role(prompts: DataFrame, models: dict[str, Model], default: Model | None = None, required: tuple[str, ...] = ()) -> DataFrame:
    """Adds reply to prompts (role, prompt): each role's own model, or the default; null without either. A role in `required` without a model is refused."""
    missing = [r for r in required if r not in models and default is None]
    if missing:
        raise ValueError(f"no model for {', '.join(missing)}")
    out = complete(prompts.filter(~F.col("role").isin(*models) | F.col("role").isNull()) if models else prompts, default)
    for role, model in models.items():
        out = out.unionByName(complete(prompts.filter(F.col("role") == role), model))
    return out


def escalate(rows: DataFrame, model: Model | None) -> DataFrame:
    """Rows (value, quote, verifier) with the model's one-word verdict where the verifier says partial and the model gives one; others are never sent."""
    asked = rows.filter("verifier = 'partial'").withColumn("prompt", F.concat(F.lit("Does the quote support the value? Answer supported, partial or unsupported.\nValue: "), F.coalesce("value", F.lit("")), F.lit("\nQuote: "), F.coalesce("quote", F.lit(""))))
    told = complete(asked, model).withColumn("verifier", F.coalesce(parse_verdict(F.col("reply")), F.col("verifier"))).select(*rows.columns)
    return rows.filter("verifier <> 'partial' or verifier is null").unionByName(told)


def isolated(rows: DataFrame, run: Callable[[dict], tuple], schema: str) -> DataFrame:
    """run of each row, with what went wrong in `error` instead of failing all: (schema's columns, error); a broken row has nulls and a message."""
    names = [part.split()[0] for part in schema.split(", ")]

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for row in batch.to_dict("records"):
                try:
                    out.append((*run(row), None))
                except Exception as e:  # noqa: BLE001  that is what the column is for
                    out.append((*[None] * len(names), f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(out, columns=[*names, "error"])

    return rows.mapInPandas(each, f"{schema}, error string")
