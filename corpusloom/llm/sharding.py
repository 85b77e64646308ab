"""Sharding by balanced label propagation.

Documents with equal texts are linked. Linked documents start dealt evenly over the shards; in
each round, those of a group that lie elsewhere ask to join the shard where most of their
neighbours are (the few largest shards, for a group that no single shard can hold). How many may
move between each pair of shards is scaled down on a matrix of shards by shards until no shard
exceeds its quota; the moves themselves are Spark joins. Unlinked documents fill what is left, so
that shards differ by one document at most. As documents of one group are interchangeable, the
rounds work on (group, shard, count) and documents take their seats by rank at the end.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, buckets_for, running

LAW = "rows"


def quotas(rows: int, shards: int) -> np.ndarray:
    """Seats of each shard; at most one apart."""
    return np.array([rows // shards + (s < rows % shards) for s in range(shards)], np.int64)


def allowed_moves(asked: np.ndarray, spare: np.ndarray) -> np.ndarray:
    """Of ``asked[i, j]`` moves from i to j, how many may happen so that no shard grows beyond its spare seats."""
    flow = asked.astype(float)
    for _ in range(200):
        over = flow.sum(0) - flow.sum(1) - spare
        if (over <= 1e-9).all():
            break
        into = flow.sum(0)
        flow *= np.where(over > 0, np.maximum(into - over, 0) / np.maximum(into, 1e-9), 1.0)
    out = np.floor(flow + 1e-9).astype(np.int64)
    while True:  # rounding down also lowers what leaves a shard
        over = out.sum(0) - out.sum(1) - spare
        j = int(over.argmax())
        if over[j] <= 0:
            return out
        for i in np.argsort(-out[:, j]):
            cut = min(out[i, j], over[j])
            out[i, j] -= cut
            over[j] -= cut


def propagate(state: DataFrame, scratch: Scratch, quota: np.ndarray, patience: int) -> DataFrame:
    """Move counts in ``state`` (group, shard, n) until no group is cut that could lie in one shard.

    Where several shards hold equally many of a group, each round draws its home anew, so that one
    that was full isn't asked for ever; ``patience`` rounds in a row that cut no fewer edges end it.
    """
    shards, most = len(quota), int(max(quota.max(), 1))
    spark = state.sparkSession
    least, idle, turn = None, 0, 0
    while idle < patience:
        load = np.zeros(shards, np.int64)
        for r in state.groupBy("shard").agg(F.sum("n").alias("n")).collect():  # a row for each shard
            load[r["shard"]] = r["n"]
        best = Window.partitionBy("group").orderBy(F.desc("n"), F.xxhash64("group", "shard", F.lit(turn)))
        size = F.sum("n").over(Window.partitionBy("group"))
        ranked = state.select("group", "shard", "n", F.row_number().over(best).alias("rank"), size.alias("size"))
        ranked = ranked.withColumn("homes", F.greatest(F.lit(1), F.ceil(F.col("size") / most)))
        homes = ranked.where("rank <= homes").select("group", F.col("shard").alias("home"), F.col("rank").alias("seat"))
        others = ranked.where("rank > homes").withColumn("seat", ((F.col("rank") - 1) % F.col("homes") + 1).cast("int"))
        asks = others.join(homes, ["group", "seat"]).select("group", "shard", "home", "n")
        asks = scratch.keep(asks)
        asked = np.zeros((shards, shards), np.int64)
        for r in asks.groupBy("shard", "home").agg(F.sum("n").alias("n")).collect():  # shards x shards at most
            asked[r["shard"], r["home"]] = r["n"]
        away = int(asked.sum())
        idle, least, turn = (0, away, turn + 1) if least is None or away < least else (idle + 1, least, turn + 1)
        flow = allowed_moves(asked, quota - load)
        if not away:
            scratch.drop(asks)
            break
        if not flow.sum():
            scratch.drop(asks)
            continue
        pairs = spark.createDataFrame([(int(i), int(j), int(flow[i, j])) for i, j in zip(*np.nonzero(flow))], "shard int, home int, allowed long")
        rows = int(asked.astype(bool).sum())
        queued = running(asks, ["shard", "home"], ["group"], F.col("n"), "before", buckets_for(asks.count() // max(rows, 1)))
        moved = queued.join(F.broadcast(pairs), ["shard", "home"]).withColumn("go", F.greatest(F.lit(0), F.least("n", F.col("allowed") - F.col("before")))).where("go > 0")
        change = moved.select("group", F.col("home").alias("shard"), F.col("go").alias("n")).union(moved.select("group", "shard", -F.col("go")))
        after = state.select("group", "shard", "n").union(change).groupBy("group", "shard").agg(F.sum("n").alias("n")).where("n > 0")
        after = scratch.keep(after)
        scratch.drop(asks, state)
        state = after
    return state


def shard_documents(df: DataFrame, shards: int = 40, patience: int = 4) -> DataFrame:
    """Give every row of (doc_id, text) a shard and a gapless slot in it.

    Returns doc_id, size (UTF-8 bytes plus 16; a null text has none), text_crc32 (0 for null), law
    (``rows``: the shards' row counts differ by one at most), shard, slot, grown_shard (null under
    this law) and linked (documents with this text). A null text is linked to nothing; empty texts
    are equal texts. Null or repeated doc_ids and repeated rows are rows like all others. Further
    columns are ignored.
    """
    scratch = Scratch(df.sparkSession, "shards")
    raw = F.col("text").cast("binary")
    base = scratch.keep(
        df.select(
            "doc_id",
            (F.coalesce(F.octet_length("text"), F.lit(0)) + 16).cast("long").alias("size"),
            F.coalesce(F.crc32(raw), F.lit(0)).cast("long").alias("text_crc32"),
            F.unhex(F.sha2(raw, 256)).alias("group"),
        )
    )
    rows = base.count()
    quota, buckets = quotas(rows, shards), buckets_for(rows)
    ident = ["doc_id", "size", "text_crc32"]
    # a group's documents are ranked within salts, so that a group of any size spreads
    salted = base.where(F.col("group").isNotNull()).withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(buckets)).cast("int"))
    counts = salted.groupBy("group", "salt").agg(F.count(F.lit(1)).alias("m"))
    by = Window.partitionBy("group")
    earlier = by.orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("group", "salt", F.coalesce(F.sum("m").over(earlier), F.lit(0)).alias("first"), F.sum("m").over(by).alias("linked"))
    inside = Window.partitionBy("group", "salt").orderBy(*ident)
    seated = salted.withColumn("place", F.row_number().over(inside)).join(counts, ["group", "salt"])
    seated = scratch.keep(seated.select(*ident, "group", "salt", "linked", (F.col("place") - 1 + F.col("first")).alias("place")))
    groups = scratch.keep(seated.where("linked > 1 and place = 0").select("group", "linked"))
    first = scratch.keep(running(groups, [], ["group"], F.col("linked"), "start", buckets_for(groups.count())))
    # dealt in turn: group's documents start..start+linked-1 go to these numbers modulo the shards
    each = F.expr(f"sequence(0, cast(least(linked, {shards}) - 1 as int))")
    state = first.select("group", "linked", "start", F.explode(each).alias("k")).select(
        "group",
        ((F.col("start") + F.col("k")) % shards).cast("int").alias("shard"),
        F.expr(f"(linked - k + {shards} - 1) div {shards}").cast("long").alias("n"),
    )
    state = propagate(scratch.keep(state), scratch, quota, patience)
    scratch.drop(first, groups)
    load = np.zeros(shards, np.int64)
    for r in state.groupBy("shard").agg(F.sum("n").alias("n")).collect():
        load[r["shard"]] = r["n"]
    # seats: where each (group, shard) begins in its shard and in its group
    placed = running(state, ["shard"], ["group"], F.col("n"), "slot0", buckets_for(state.count() // shards))
    before = Window.partitionBy("group").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    placed = placed.withColumn("from", F.coalesce(F.sum("n").over(before), F.lit(0)))
    runs = placed.groupBy("group").agg(F.collect_list(F.struct("from", "n", "shard", "slot0")).alias("runs"))
    # a copy of a group's runs for each of its salts, so that documents stay dealt by (group, salt)
    runs = runs.join(seated.where("linked > 1").select("group", "salt").distinct(), "group")
    linked = seated.where("linked > 1").join(runs, ["group", "salt"])
    own = F.filter("runs", lambda r: (r["from"] <= F.col("place")) & (F.col("place") < r["from"] + r["n"]))[0]
    linked = linked.withColumn("_run", own).select(*ident, F.col("_run.shard").alias("shard"), (F.col("_run.slot0") + F.col("place") - F.col("_run.from")).alias("slot"), "linked")
    # the others take the seats that are left, in one global order
    single = seated.where("linked = 1").select(*ident, "group").unionByName(base.where(F.col("group").isNull()).select(*ident, "group"))
    single = running(scratch.keep(single), [], [*ident, "group"], F.lit(1), "turn", buckets)
    ends = np.cumsum(quota - load)
    shard = F.lit(shards - 1)
    offset = F.lit(int(ends[-2] if shards > 1 else 0))
    for s in range(shards - 2, -1, -1):
        shard = F.when(F.col("turn") < int(ends[s]), F.lit(s)).otherwise(shard)
        offset = F.when(F.col("turn") < int(ends[s]), F.lit(int(ends[s - 1]) if s else 0)).otherwise(offset)
    taken = F.array(*(F.lit(int(x)) for x in load))
    single = single.withColumn("shard", shard.cast("int")).withColumn("slot", F.col("turn") - offset + F.element_at(taken, F.col("shard") + 1))
    single = single.select(*ident, "shard", F.col("slot").cast("long").alias("slot"), F.lit(1).cast("long").alias("linked"))
    out = linked.unionByName(single)
    return out.select("doc_id", "size", "text_crc32", F.lit(LAW).alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "linked")
