"""Folders of studies, label files, logs and caches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import LABEL
from .latest import append, current


def studies(spark: SparkSession, root: str, suffix: str = ".pdf") -> DataFrame:
    """(study, path) of the sub-folders of root: the file named like the folder, else the shortest name if all others go on from it with "_"; other folders give nothing."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", f"*{suffix}").load(root).select("path")
    parts = files.withColumn("study", F.element_at(F.split("path", "/"), -2)).withColumn("_stem", F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.[^.]*$", ""))
    best = parts.groupBy("study").agg(F.min_by("path", F.struct((F.col("_stem") != F.col("study")).alias("a"), F.char_length("_stem").alias("b"), "_stem")).alias("path"), F.min(F.struct(F.char_length("_stem").alias("n"), "_stem"))["_stem"].alias("_base"), F.max((F.col("_stem") == F.col("study")).cast("int")).alias("_exact"))
    ok = parts.join(best, "study").groupBy("study").agg(F.min(((F.col("_exact") == 1) | (F.col("_stem") == F.col("_base")) | F.startswith(F.col("_stem"), F.concat("_base", F.lit("_")))).cast("int")).alias("_ok"))
    return best.join(ok.filter("_ok = 1"), "study").select("study", best["path"])


def write_labels(labels: DataFrame, path: str, force: bool = False) -> None:
    """Labels as JSON lines, sorted by domain and field within files; an existing file stays unless force."""
    labels.repartitionByRange("domain").sortWithinPartitions("domain", "field").write.mode("overwrite" if force else "errorifexists").json(path)


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """Labels of a file; none if there is no such file."""
    from pyspark.errors import AnalysisException

    try:
        return spark.read.schema(LABEL).json(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], LABEL)


def append_log(rows: DataFrame, path: str, partition: str = "source_sha256") -> None:
    """Appends rows to a log, a folder for each source. The log is never rewritten; rows come with their seq."""
    rows.write.mode("append").partitionBy(partition).parquet(path)


def first_write(existing: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """New rows whose key is not there yet: the first write of a key wins."""
    return new.dropDuplicates([key]).join(existing.select(key), key, "left_anti")


def cache_key(model: str, messages: str, max_tokens: str) -> F.Column:
    return F.sha2(F.to_json(F.struct(model, messages, max_tokens)), 256)


def cached(requests: DataFrame, cache: DataFrame) -> DataFrame:
    """Requests (key) with the response of the cache; blank responses are misses."""
    return requests.join(cache.filter(F.trim(F.coalesce("response", F.lit(""))) != "").select("key", "response"), "key", "left")


def upsert(cache: DataFrame, rows: DataFrame) -> DataFrame:
    """The cache after rows (key, response, seq), later ones over earlier ones; blank responses are not stored."""
    all_ = cache.unionByName(rows.filter(F.trim(F.coalesce("response", F.lit(""))) != ""))
    return all_.groupBy("key").agg(F.max(F.struct("seq", "response")).alias("_r")).select("key", "_r.response", "_r.seq")


def write_corrections(rows: DataFrame, path: str, checked: DataFrame, seq: int) -> None:
    """Appends the corrections (doc_id and others) of the documents checked, over all earlier ones of these; one without any keeps an empty list, so that it counts
    as checked. A file for each task, however many documents there are."""
    rest = [c for c in rows.columns if c != "doc_id"]
    own = rows.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct(*rest))).alias("corrections"))
    marked = checked.select("doc_id").distinct().join(own, "doc_id", "left")
    kind = own.schema["corrections"].dataType
    append(marked.select("doc_id", F.lit(seq).cast("long").alias("seq"), F.coalesce("corrections", F.array().cast(kind)).alias("corrections")), path)


def read_corrections(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """(doc_id, corrections) of the documents checked. schema: that of a correction, such as "field string, value string"."""
    return current(spark, path, ["doc_id"], f"doc_id long, seq long, corrections array<struct<{_struct(schema)}>>").drop("seq")


#: of a cache of replies on disk, for append, current, compact and vacuum
CACHE = "key string, seq long, response string"


def write_cache(rows: DataFrame, path: str) -> None:
    """Appends replies (CACHE), later ones over earlier ones; blank responses are not stored."""
    append(rows.filter(F.trim(F.coalesce("response", F.lit(""))) != "").select("key", "seq", "response"), path)


def read_cache(spark: SparkSession, path: str) -> DataFrame:
    return current(spark, path, ["key"], CACHE)


def _struct(schema: str) -> str:
    return ",".join(f"{part.split()[0]}:{part.split()[1]}" for part in schema.split(", "))


def save_model(spark: SparkSession, path: str, payload: str) -> None:
    """A model's JSON beside its hash."""
    spark.createDataFrame([(payload,)], "payload string").withColumn("sha256", F.sha2("payload", 256)).write.mode("overwrite").json(path)


def load_model(spark: SparkSession, path: str) -> str:
    """The JSON of a model; fails if it is not what was saved."""
    row = spark.read.schema("payload string, sha256 string").json(path).select("payload", (F.sha2("payload", 256) == F.col("sha256")).alias("ok")).first()
    if not row["ok"]:
        raise ValueError(f"the model at {path} differs from its hash")
    return row["payload"]
