"""The metadata spine: texts, blocks, labelled values, votes, decisions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import verify
from ..operators.blocks import head_text, label_values, text_blocks
from ..operators.fields import sanity
from ..operators.voting import assure, vote


def metadata(docs: DataFrame, labels: DataFrame, others: DataFrame | None = None, pages: int = 3) -> DataFrame:
    """(doc_id, field, value, confidence, decision): a row for every document and field, also without a candidate.

    docs: doc_id, text; labels: field, pattern, a small table; others: candidates of other methods (doc_id, field, value, method, is_model, ord).
    Values are checked against the first pages of their document.
    """
    blocks = text_blocks(docs)
    heads = head_text(blocks, pages)
    own = label_values(blocks, labels, pages).select("doc_id", "field", "value", F.lit("label").alias("method"), F.lit(False).alias("is_model"), F.lit(0).alias("ord"))
    all_ = own.unionByName(others) if others is not None else own
    checked = all_.join(heads, "doc_id", "left").withColumn("sanity", sanity(F.col("field"), F.col("value"), F.col("head"))).drop("head")
    keys = ["doc_id", "field"]
    fields = docs.select("doc_id").distinct().select("doc_id", F.explode(F.array(*(F.lit(r["field"]) for r in labels.select("field").distinct().collect()))).alias("field"))  # a small table of field names
    rows = fields.join(vote(checked, keys), keys, "left").join(heads, "doc_id", "left")
    rows = rows.withColumns({"verifier": verify(F.col("value"), F.lit(""), F.col("head")), "grounding_failed": F.lit(False)})
    return assure(rows, keys).select(*keys, "value", "confidence", "decision")
