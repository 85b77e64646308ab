"""Shared pieces of the training-data operators: tables, scratch tables, distributed ranks."""

from __future__ import annotations

import tempfile
import uuid
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Rows that one task of a bucketed window should hold.
BUCKET_ROWS = 20_000
#: Rows in one Arrow batch of text columns, so that batches of long texts stay small.
TEXT_BATCH_ROWS = 256


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables, read with Spark's own reader."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Keep Arrow batches bounded in rows, whatever the length of the texts."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(TEXT_BATCH_ROWS))


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` of the session.

    Only a local session without that setting gets a temporary folder; any other raises.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if folder:
        return folder.rstrip("/")
    if not (spark.sparkContext.master.startswith("local") and "cluster" not in spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    folder = "file://" + tempfile.mkdtemp(prefix="corpusloom-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


class Scratch:
    """Tables written under the shared folder, which cut lineage and survive lost executors."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root, self.n = spark, f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}", 0

    def keep(self, df: DataFrame, codec: str = "zstd") -> DataFrame:
        """Write ``df`` and return it as a scan of what was written."""
        path = f"{self.root}/{self.n}"
        self.n += 1
        df.write.option("compression", codec).parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Delete tables that no later step reads."""
        jvm = self.spark._jvm
        for t in tables:
            p = jvm.org.apache.hadoop.fs.Path(t._scratch)
            p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)


def free_names(df: DataFrame, *wanted: str) -> list[str]:
    """Names like ``wanted`` that no column of ``df`` has, whatever the case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in wanted:
        name = f"_{name}"
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def quoted(name: str) -> str:
    """A column's name as one that Spark takes literally."""
    return "`" + name.replace("`", "``") + "`"


def shield(df: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """``df`` with columns that begin with an underscore renamed, as operators' own columns do so; and the new names by the old."""
    taken, names, new = {c.lower() for c in df.columns}, [], {}
    for c in df.columns:
        name = c
        if c.startswith("_"):
            name = f"kept{c}"
            while name.lower() in taken:
                name += "_"
            taken.add(name.lower())
            new[c] = name
        names.append(name)
    return df.toDF(*names), new


def unshield(df: DataFrame, new: dict[str, str]) -> DataFrame:
    """``df`` with the names that ``shield`` has changed as they were."""
    old = {n: c for c, n in new.items()}
    return df.toDF(*(old.get(c, c) for c in df.columns))


def same(left: DataFrame, right: DataFrame, names: list[str]) -> Column:
    return reduce(and_, [left[n] == right[n] for n in names], F.lit(True))


def buckets_for(rows: int) -> int:
    """Buckets for ``rows`` rows; it grows with the input, so no bucket does."""
    return max(16, rows // BUCKET_ROWS + 1)


def running(df: DataFrame, keys: list[str], order: list[str], value: Column, out: str, buckets: int) -> DataFrame:
    """Add ``out``: the sum of ``value`` over earlier rows of the same ``keys``, in hashed order.

    Rows are dealt to ``buckets`` hash buckets of each key: sums of buckets first, then a window
    within a bucket only, so that a hot key is no task's whole load. ``df`` is read twice and must
    be a stored table. ``keys`` must hold no null. The order is that of (bucket, ``order``).
    """
    dealt = df.withColumn("_v", value).withColumn("_b", F.pmod(F.xxhash64(*order), F.lit(buckets)).cast("int"))
    sums = dealt.groupBy(*keys, "_b").agg(F.sum("_v").alias("_s"))
    earlier = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(*keys, "_b", F.coalesce(F.sum("_s").over(earlier), F.lit(0)).alias("_o"))
    own = Window.partitionBy(*keys, "_b").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    dealt = dealt.withColumn("_w", F.coalesce(F.sum("_v").over(own), F.lit(0)))
    return dealt.join(offsets, [*keys, "_b"]).withColumn(out, F.col("_w") + F.col("_o")).drop("_b", "_v", "_w", "_o")
