"""Property-graph operators: merging, deduplication, upserts, expansion, degrees, checks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import stored


def merge_nodes(rows: DataFrame, key: list[str], order: str, first: list[str], longest: list[str], union: list[str]) -> DataFrame:
    """One row a key: the first value of ``first``, the longest of ``longest`` (ties: the first) and the
    ordered union of the arrays ``union``, all by ``order``. Nulls never win over values."""
    aggs: list[Column] = [F.min_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(c) for c in first]
    aggs += [F.max_by(c, F.when(F.col(c).isNotNull(), F.struct(F.length(c), -F.col(order)))).alias(c) for c in longest]
    for c in union:
        lists = F.array_sort(F.collect_list(F.struct(F.col(order), F.col(c).alias("_x"))))
        aggs.append(F.array_distinct(F.flatten(F.transform(lists, lambda r: r["_x"]))).alias(c))
    return rows.groupBy(*key).agg(*aggs)


def dedupe_edges(edges: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The first edge of each key."""
    w = Window.partitionBy(*key).orderBy(*order)
    return edges.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def upsert(target: DataFrame, delta: DataFrame, key: list[str], order: str) -> DataFrame:
    """Last writer wins for each property; a null never overwrites a value."""
    values = [c for c in target.columns if c not in key]
    old = target.withColumn("_o", F.lit(None).cast("long"))
    new = delta.select(*key, *values, F.col(order).cast("long").alias("_o"))
    rows = old.unionByName(new)
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.coalesce("_o", F.lit(-(2**62))))).alias(c)
    return rows.groupBy(*key).agg(*(last(c) for c in values))


def degrees(edges: DataFrame) -> DataFrame:
    """(node, degree): edges that touch a node; a loop counts once."""
    ends = F.explode(F.array_distinct(F.array("src", "dst")))
    return edges.select(ends.alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("degree"))


def without_orphans(edges: DataFrame, nodes: DataFrame, key: str = "id") -> DataFrame:
    """Edges both of whose ends exist."""
    for end in ("src", "dst"):
        edges = edges.join(nodes.select(F.col(key).alias(end)), end, "left_semi")
    return edges


def expand(seeds: DataFrame, edges: DataFrame, hops: int, undirected: bool = False) -> DataFrame:
    """(seed, node, hop): what each seed reaches in 1 to ``hops`` steps, with the fewest steps; seeds are left out."""
    ways = edges.select("src", "dst").distinct()
    if undirected:
        ways = ways.union(ways.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()
    front = seeds.select(F.col("seed"), F.col("seed").alias("node"))
    found = None
    for hop in range(1, hops + 1):
        front = front.join(ways, front["node"] == ways["src"]).select("seed", F.col("dst").alias("node")).distinct()
        step = front.withColumn("hop", F.lit(hop))
        found = step if found is None else found.union(step)
    return found.where("seed <> node").groupBy("seed", "node").agg(F.min("hop").alias("hop"))


#: Rows of a front that is sent to all tasks; a larger one is joined by shuffles.
SENT = 500_000


def _bit_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(block, bit, nodes, node_sum) of rows (node, block, mask)."""
    for batch in batches:
        node, block, mask = (batch.column(c).to_numpy() for c in ("node", "block", "mask"))
        order = np.argsort(block, kind="stable")
        cuts = np.flatnonzero(np.diff(block[order])) + 1
        for rows in np.split(order, cuts) if len(order) else ():
            bits = np.unpackbits(mask[rows].astype("<i8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.int64)
            columns = np.full(64, block[rows[0]]), np.arange(64), bits.sum(0), node[rows] @ bits
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["block", "bit", "nodes", "node_sum"])


def reach_counts(seeds: DataFrame, edges: DataFrame, hops: int, undirected: bool = False) -> DataFrame:
    """(seed, hop, nodes, node_sum): how many nodes, and the sum of their ids, ``expand`` finds from each seed at each hop.

    64 seeds walk together as the bits of a word, so that an edge is walked once for all of them,
    and no pair of a seed and a node has a row of its own. Ids are whole numbers.
    """
    ways = edges.where("src is not null and dst is not null").select(F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst"))
    if undirected:
        ways = ways.union(ways.select("dst", "src"))
    ways = stored(ways.repartition("dst"), "ways")  # by target, so that what meets there is summed up before it moves
    place = F.monotonically_increasing_id()
    numbered = seeds.where("seed is not null").select(F.col("seed").cast("long").alias("seed")).distinct().orderBy("seed").withColumn("place", place)
    numbered = stored(numbered.select("seed", F.expr("place div 64").alias("block"), (F.col("place") % 64).alias("bit")), "seeds")
    front = stored(numbered.select(F.col("seed").alias("node"), "block", F.expr("shiftleft(1L, cast(bit as int))").alias("mask")).groupBy("node", "block").agg(F.bit_or("mask").alias("mask")), "front")
    seen, found = front, []
    for hop in range(1, hops + 1):
        near = F.broadcast(front) if front.count() <= SENT else front.hint("shuffle_hash")
        met = ways.join(near, ways["src"] == near["node"]).groupBy(F.col("dst").alias("node"), "block").agg(F.bit_or("mask").alias("mask"))
        before = seen.groupBy("node", "block").agg(F.bit_or("mask").alias("old"))
        fresh = F.col("mask").bitwiseAND(F.bitwise_not(F.coalesce("old", F.lit(0).cast("long"))))
        front = stored(met.join(before, ["node", "block"], "left").select("node", "block", fresh.alias("mask")).where("mask <> 0"), "front")
        seen = seen.union(front)
        found.append(front.mapInArrow(_bit_sums, "block long, bit long, nodes long, node_sum long").withColumn("hop", F.lit(hop)))
    sums = found[0]
    for more in found[1:]:
        sums = sums.union(more)
    sums = sums.groupBy("block", "bit", "hop").agg(F.sum("nodes").alias("nodes"), F.sum("node_sum").alias("node_sum")).where("nodes > 0")
    return numbered.join(sums, ["block", "bit"]).select("seed", "hop", "nodes", "node_sum")


def check_unique(df: DataFrame, key: list[str], name: str) -> DataFrame:
    return df.groupBy(*key).count().where("count > 1").agg(F.count(F.lit(1)).alias("violations")).select(F.lit(name).alias("rule"), "violations")


def check_not_null(df: DataFrame, column: str, name: str) -> DataFrame:
    return df.agg(F.count_if(F.col(column).isNull()).alias("violations")).select(F.lit(name).alias("rule"), "violations")


def check_reference(df: DataFrame, column: str, other: DataFrame, key: str, name: str) -> DataFrame:
    lost = df.where(F.col(column).isNotNull()).join(other.select(F.col(key).alias(column)), column, "left_anti")
    return lost.agg(F.count(F.lit(1)).alias("violations")).select(F.lit(name).alias("rule"), "violations")
