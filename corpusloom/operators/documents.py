"""Ordered document streams: running state, neighbours, contiguity, chunks, rendering, splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def next_edges(df: DataFrame, parent: str, order: list[str], ident: str) -> DataFrame:
    """(parent, src, dst) for each pair of consecutive children."""
    before = F.lag(ident).over(Window.partitionBy(parent).orderBy(*order))
    return df.select(parent, before.alias("src"), F.col(ident).alias("dst")).where(F.col("src").isNotNull())


def gaps(df: DataFrame, parent: str, number: str) -> DataFrame:
    """Children whose number isn't their place in 1..N."""
    place = F.row_number().over(Window.partitionBy(parent).orderBy(number))
    return df.select(parent, F.col(number).alias("number"), place.alias("place")).where("number <> place")


def chunk(df: DataFrame, ident: str, text: str, size: int) -> DataFrame:
    """(ident, chunk, start, body): the text in parts of ``size`` characters."""
    parts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.length(text) - 1) / size).cast("int")))
    rows = df.select(ident, text, F.explode(parts).alias("chunk"))
    return rows.select(ident, "chunk", (F.col("chunk") * size).alias("start"), F.substr(F.col(text), F.col("chunk") * size + 1, F.lit(size)).alias("body"))


def render(df: DataFrame, key: str, order: list[str], line: Column, size: int | None = None) -> DataFrame:
    """All lines of a key in order, joined by line breaks and cut to ``size`` characters."""
    lines = F.array_sort(F.collect_list(F.struct(*order, line.alias("_line"))))
    text = F.array_join(F.transform(lines, lambda x: x["_line"]), "\n")
    return df.groupBy(key).agg((F.substring(text, 1, size) if size else text).alias("context"))


def stratified_split(df: DataFrame, stratum: str, ident: str, part: float, seed: int) -> DataFrame:
    """``split``: test for the first ``part`` of each stratum (rounded half to even) in hashed order, else dev."""
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.col(ident).cast("string")), 256)
    w = Window.partitionBy(stratum)
    rows = df.withColumns({"_r": F.row_number().over(w.orderBy(order, ident)), "_n": F.bround(F.count(F.lit(1)).over(w) * F.lit(part))})
    return rows.withColumn("split", F.when(F.col("_r") <= F.col("_n"), "test").otherwise("dev")).drop("_r", "_n")
