"""Tables of which the newest row of each key counts: rows are appended, and now and then brought together.

    <path>/log              rows as they came, with a seq
    <path>/state/gen=<n>    the newest row of every key, as of one compaction, in ranges of keys
    <path>/covered/gen=<n>  the files of the log that went into it

What a reader sees is the newest of a whole generation and of the log. Rows of the log that a generation has already are no newer, so it is the same table before,
during and after a compaction, whichever generation a reader finds; and two writers never touch the same file.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _folder(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def _generations(spark: SparkSession, path: str) -> list[int]:
    """Those that are whole, oldest first."""
    fs, at = _folder(spark, f"{path}/state")
    found = [f.getPath() for f in fs.listStatus(at)] if fs.exists(at) else []
    whole = [p for p in found if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
    return sorted(int(p.getName().split("=")[1]) for p in whole)


def append(rows: DataFrame, path: str) -> None:
    """Adds rows, which have a seq beside keys and values; in whatever order they come, that of the largest seq counts."""
    rows.write.mode("append").parquet(f"{path}/log")


def _newest(rows: DataFrame, keys: list[str]) -> DataFrame:
    rest = [c for c in rows.columns if c not in (*keys, "seq")]
    return rows.groupBy(*keys).agg(F.max(F.struct("seq", *rest)).alias("_r")).select(*keys, "_r.*").select(*rows.columns)


def _log(spark: SparkSession, path: str, schema: str) -> DataFrame:
    fs, at = _folder(spark, f"{path}/log")
    return spark.read.schema(schema).parquet(f"{path}/log") if fs.exists(at) else spark.createDataFrame([], schema)


def current(spark: SparkSession, path: str, keys: list[str], schema: str) -> DataFrame:
    """The newest row of each key; of equal seqs the largest row. A table that is not there is empty."""
    rows, whole = _log(spark, path, schema), _generations(spark, path)
    if whole:
        rows = rows.unionByName(spark.read.schema(schema).parquet(f"{path}/state/gen={whole[-1]}"))
    return _newest(rows, keys)


def compact(spark: SparkSession, path: str, keys: list[str], schema: str) -> int:
    """Writes the next generation, and returns its number. Rows that are appended meanwhile stay in the log; a compaction that dies leaves nothing that counts."""
    whole = _generations(spark, path)
    log = _log(spark, path, schema)
    files = log.inputFiles()
    rows = spark.read.schema(schema).parquet(*files) if files else spark.createDataFrame([], schema)
    if whole:
        rows = rows.unionByName(spark.read.schema(schema).parquet(f"{path}/state/gen={whole[-1]}"))
    now = (whole[-1] if whole else 0) + 1
    spark.createDataFrame([(f,) for f in files], "file string").write.mode("overwrite").parquet(f"{path}/covered/gen={now}")
    _newest(rows, keys).repartitionByRange(*keys).sortWithinPartitions(*keys).write.mode("overwrite").parquet(f"{path}/state/gen={now}")
    return now


def vacuum(spark: SparkSession, path: str) -> int:
    """Removes what the newest generation has: files of the log and older generations; returns how many. For a time when no reader has begun before that generation."""
    whole = _generations(spark, path)
    if not whole:
        return 0
    gone = [r["file"] for r in spark.read.schema("file string").parquet(f"{path}/covered/gen={whole[-1]}").toLocalIterator()]
    gone += [f"{path}/{kind}/gen={n}" for n in whole[:-1] for kind in ("state", "covered")]
    for name in gone:
        fs, at = _folder(spark, name)
        fs.delete(at, True)
    return len(gone)
