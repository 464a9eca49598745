"""The folder that driver and executors share."""

from __future__ import annotations

import math
import re
import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Where it is unset a local session gets a folder of its own; a cluster has to name one."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not where:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        where = f"file://{tempfile.mkdtemp(prefix='tarnwork-')}"
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(where)
    return where.rstrip("/")


def checkpointed(df: DataFrame) -> DataFrame:
    """Cuts lineage through the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def spread(rows: DataFrame, keys: list[str], most: int = 1_000_000) -> DataFrame:
    """rows by keys, in as many parts as bring about `most` rows to each, so what a task holds does not grow with the table. rows are counted first: of Parquet files
    only the footers are read."""
    return rows.repartition(max(rows.sparkSession.sparkContext.defaultParallelism, math.ceil(rows.count() / most)), *keys)
