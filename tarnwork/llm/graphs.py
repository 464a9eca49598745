"""Connected components: in one task where a count shows that the graph is small, else by repeated minima."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed

#: edges, each in one direction, that one task may take: 16 MB
SMALL = 1_000_000


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Labels of one task's graph: labels fall to the least of both ends and then to their own labels' until nothing changes."""
    got = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
    if not got:
        return
    nodes, ends = np.unique(np.concatenate([x for pair in got for x in pair]), return_inverse=True)
    cut = np.cumsum([len(x) for pair in got for x in pair])[:-1]
    sides = np.split(ends, cut)
    a, b = np.concatenate(sides[0::2]), np.concatenate(sides[1::2])
    label = np.arange(len(nodes))
    while True:
        old = label.copy()
        least = np.minimum(label[a], label[b])
        np.minimum.at(label, label[a], least)
        np.minimum.at(label, label[b], least)
        np.minimum.at(label, a, least)
        np.minimum.at(label, b, least)
        label = label[label]
        if (label == old).all():
            break
    for at in range(0, len(nodes), 50_000):
        yield pa.RecordBatch.from_arrays([pa.array(nodes[at : at + 50_000]), pa.array(nodes[label[at : at + 50_000]])], ["node", "component"])


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of edges (a, b), two longs: the smallest node that it reaches.

    Up to SMALL edges are joined in one task. Beyond, each round takes the least label among a node's neighbours and then the label of that label,
    so the number of rounds follows the logarithm of the longest path; rounds end when no label changes, and each is written to the shared folder.
    """
    edges = checkpointed(edges.select("a", "b"))
    if edges.count() <= SMALL:
        return checkpointed(edges.repartition(1).mapInArrow(_joined, "node long, component long"))
    both = checkpointed(edges.union(edges.select("b", "a")).distinct())
    labels = checkpointed(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("_least")).select("node", F.least("node", "_least").alias("component")))
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "component"), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("_near"))
        closer = labels.join(near, "node").select("node", F.col("component").alias("_old"), F.least("component", "_near").alias("component"))
        jump = closer.select(F.col("node").alias("component"), F.col("component").alias("_next"))
        stepped = checkpointed(closer.join(jump, "component", "left").select("node", "_old", F.least("component", F.coalesce("_next", "component")).alias("component")))
        done = stepped.filter(F.col("_old") != F.col("component")).isEmpty()
        labels = stepped.select("node", "component")
        if done:
            return labels
