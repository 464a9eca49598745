"""Connected components, and sets of tokens that may be alike."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..shared import checkpointed


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of edges (a, b), two longs: the least node that it reaches.

    A round takes the least label of a node's neighbours and then that label's own, so that rounds follow the logarithm of the longest path; they end when
    no label changes. Each is cut off by a checkpoint.
    """
    both = checkpointed(edges.select("a", "b").union(edges.select("b", "a")).distinct())
    labels = checkpointed(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("_b")).select("node", F.least("node", "_b").alias("component")))
    while True:
        least = both.join(labels.select(F.col("node").alias("b"), "component"), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("_near"))
        near = labels.join(least, "node").select("node", F.col("component").alias("_old"), F.least("component", "_near").alias("component"))
        ahead = labels.select(F.col("node").alias("component"), F.col("component").alias("_far"))
        now = checkpointed(near.join(ahead, "component", "left").select("node", "_old", F.least("component", F.coalesce("_far", "component")).alias("component")))
        labels = now.select("node", "component")
        if now.filter("_old <> component").isEmpty():
            return labels


def rare_tokens(sets: DataFrame, keys: list[str], threshold: float | Column) -> DataFrame:
    """(keys, tokens, token): of each distinct set of a key, so many of its rarest tokens that two sets with a Jaccard similarity of `threshold` or more share one.

    sets: keys, tokens (distinct), of all sides that are to be compared, as all have to rank tokens alike: by how many sets of the key have them, then by the
    token. A set of n shares at least t * n of its tokens with one that is alike, so it leaves at most n - t * n out, and one more must be shared.
    """
    distinct = sets.select(*keys, "tokens").distinct()
    seen = distinct.select(*keys, "tokens", F.explode("tokens").alias("token"))
    counts = seen.groupBy(*keys, "token").agg(F.count("*").alias("_n"))
    ranked = seen.join(counts, [*keys, "token"]).groupBy(*keys, "tokens").agg(F.array_sort(F.collect_list(F.struct("_n", "token"))).alias("_r"))
    n = F.size("_r")
    return ranked.select(*keys, "tokens", F.explode(F.transform(F.slice("_r", 1, n - F.ceil(threshold * n - 1e-9).cast("int") + 1), lambda r: r["token"])).alias("token"))
