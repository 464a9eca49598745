"""Ordered walks over the rows of a key, where a step depends on the steps before it."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..shared import checkpointed


def fold(rows: DataFrame, keys: list[str], order: list[str], walk: Callable[[list[dict]], Iterable[tuple]], schema: str) -> DataFrame:
    """walk gets the rows of a key as dicts, in order, and gives tuples of the schema that follow the key's columns.

    Rows of a key, one document's, are gathered and sorted on the JVM side, so a task hands batches of many keys to Python at once. Keys whose
    rows are not bounded do not belong here.
    """
    rest = [c for c in rows.columns if c not in keys and c not in order]
    gathered = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(*order, *rest))).alias("_rows"))
    names = [*order, *rest]
    out_names = [*keys, *(part.split()[0] for part in schema.split(", "))]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for *key, own in batch.itertuples(index=False, name=None):
                own = [r if isinstance(r, dict) else dict(zip(names, r, strict=True)) for r in own]
                out += [(*key, *got) for got in walk(own)]
            yield pd.DataFrame(out, columns=out_names)

    kinds = dict(rows.dtypes)
    return gathered.mapInPandas(run, ", ".join([*(f"{k} {kinds[k]}" for k in keys), schema]))


def running_sums(rows: DataFrame, by: list[str], order: list[Column], values: dict[str, Column]) -> DataFrame:
    """Adds running sums of the values over the rows of each group in order, however large a group is.

    Rows are sorted over all partitions at once, so a group that holds a third of them spreads over many tasks; sums run inside a partition, and
    what comes before it is added from a table with a row for each partition and group. Needs the session's checkpoint folder.
    """
    placed = rows.withColumns({f"_v_{k}": v for k, v in values.items()}).orderBy(*by, *order).withColumn("_pos", F.monotonically_increasing_id()).withColumn("_part", F.shiftright("_pos", 33)).transform(checkpointed)
    parts = placed.groupBy(*by, "_part").agg(*(F.sum(f"_v_{k}").alias(f"_s_{k}") for k in values))
    earlier = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(*(F.col(c).alias(f"_by_{c}") for c in by), F.col("_part").alias("_by_part"), *(F.coalesce(F.sum(f"_s_{k}").over(earlier), F.lit(0)).alias(f"_b_{k}") for k in values))
    same = F.col("_part") == F.col("_by_part")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_by_{c}"))
    inside = Window.partitionBy(*by, "_part").orderBy("_pos").rowsBetween(Window.unboundedPreceding, 0)
    return placed.join(parts, same).select(*rows.columns, *((F.col(f"_b_{k}") + F.sum(f"_v_{k}").over(inside)).alias(k) for k in values))


def _kin(rows: DataFrame, key: list[str], parent: str, others: DataFrame, how: str) -> DataFrame:
    """rows joined with what others (_t, _n) say of their parents. Both sides are shuffled: generations sent to all tasks would add up on the driver."""
    tree, number = key
    return rows.join(others.hint("merge"), (F.col(tree) == F.col("_t")) & (F.col(parent) == F.col("_n")), how)


def by_generation(rows: DataFrame, key: list[str], parent: str, own: str, step: Callable[[Column, Column], Column]) -> DataFrame:
    """rows with column `own` settled from the top of each tree down, to any depth: step(own, settled column of the parent).

    Rows without a parent, or whose parent is not there, stay as they are. key: the tree, then the row's number in it; parent: the number of the
    parent. Each generation is one shuffled join with the one before, cut off by a checkpoint, and rounds end when a generation is empty.
    """
    tree, number = key
    up = rows.select(F.col(tree).alias("_t"), F.col(number).alias("_n"))
    settled = _kin(rows, key, parent, up, "left_anti").transform(checkpointed)
    out = settled
    while True:
        above = settled.select(F.col(tree).alias("_t"), F.col(number).alias("_n"), F.col(own).alias("_above"))
        settled = _kin(rows, key, parent, above, "inner").withColumn(own, step(F.col(own), F.col("_above"))).select(*rows.columns).transform(checkpointed)
        if settled.isEmpty():
            return out
        out = out.unionByName(settled)
