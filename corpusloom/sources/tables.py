"""Tables, strict line-delimited corpora, result folders, and incremental appends."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def kept_table(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share: the session's ``spark.checkpoint.dir``.

    Only a local session without that setting gets a temporary folder; any other raises.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        master = spark.sparkContext.master
        if not master.startswith("local") or "cluster" in master:
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="corpusloom-")
    return f"{folder.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once and read back, so that its work isn't done again by each that reads it, nor when an executor is lost."""
    path = kept_table(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def read_corpus(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(rows, errors) of a JSONL corpus: lines that don't parse, lack id or text, or repeat an id are errors."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in ("id", "text", "document", "article", "clause", "_bad")])
    rows = spark.read.schema(schema).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad").json(path)
    counts = rows.groupBy("id").agg(F.count(F.lit(1)).alias("_n"))
    rows = rows.join(counts, rows["id"].eqNullSafe(counts["id"]), "left").drop(counts["id"])
    reason = (
        F.when(F.col("_bad").isNotNull(), "bad JSON")
        .when(F.coalesce(F.trim("id"), F.lit("")) == "", "missing id")
        .when(F.coalesce(F.trim("text"), F.lit("")) == "", "missing text")
        .when(F.col("_n") > 1, "duplicate id")
    )
    marked = rows.withColumn("reason", reason)
    return marked.where("reason is null").drop("_bad", "_n", "reason"), marked.where("reason is not null").select("id", "reason")


def read_results(spark: SparkSession, folder: str, schema: T.StructType, include_errors: bool = False) -> DataFrame:
    """Records of ``<folder>/<arm>/A*.json`` with the arm's name; failed runs' files only if asked for."""
    files = F.input_file_name()
    rows = spark.read.schema(schema).option("multiLine", True).json(f"{folder}/*/A*.json").withColumns({"file": files, "arm": F.regexp_extract(files, r"([^/]+)/[^/]+$", 1)})
    return rows if include_errors else rows.where(~F.col("file").endswith(".error.json"))


def unprocessed(rows: DataFrame, done: DataFrame, key: list[str]) -> DataFrame:
    """What an earlier run hasn't handled."""
    return rows.join(done.select(*key).distinct(), key, "left_anti")


def cached_responses(requests: DataFrame, cache: DataFrame, inputs: list[str]) -> tuple[DataFrame, DataFrame]:
    """(hits, misses) of a response cache keyed by the SHA-256 of all inputs."""
    sized = [F.concat(F.length(F.coalesce(F.col(c), F.lit(""))).cast("string"), F.lit(":"), F.coalesce(F.col(c), F.lit(""))) for c in inputs]
    keyed = requests.withColumn("cache_key", F.sha2(F.concat(*sized), 256))
    return keyed.join(cache, "cache_key"), keyed.join(cache, "cache_key", "left_anti")
