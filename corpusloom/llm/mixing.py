"""Mixing sources to target weights by temperature.

A source's weight is its token share to the power alpha, normalised. Alpha is bisected: the
largest one whose weights reach the target entropy, raised as far as the repetition limit asks.
Each source then gets weight times budget tokens, which it fills by epochs. An epoch is a
permutation of the source's hash blocks, and of the documents within a block; the last epoch stops
where the budget ends.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, buckets_for, running, shield, unshield


@dataclass(frozen=True)
class MixConfig:
    """``target_entropy``: as a part of the logarithm of the number of sources. ``repetition``: the
    most times a source may be seen, on the scale on which the least seen one counts as once.
    ``budget``: tokens in all; None: as many as show every document once at least. ``blocks``: hash
    blocks of a source. ``max_sources``: more are an error, as the weights are solved on the driver."""

    target_entropy: float = 0.9
    repetition: float = 1.5
    budget: int | None = None
    blocks: int = 1024
    seed: int = 17
    max_sources: int = 100_000


def weights(tokens: np.ndarray, alpha: float) -> np.ndarray:
    share = np.asarray(tokens, float)
    share = (share / share.max()) ** alpha
    return share / share.sum()


def entropy(w: np.ndarray) -> float:
    return float(-(w * np.log(np.maximum(w, 1e-300))).sum())


def spread(tokens: np.ndarray, alpha: float) -> float:
    """How often the most repeated source is seen while the least repeated one is seen once."""
    ratio = weights(tokens, alpha) / np.asarray(tokens, float)
    return float(ratio.max() / ratio.min())


def solve_alpha(tokens: np.ndarray, target_entropy: float, repetition: float) -> float:
    """The exponent in [0, 1]; where both targets can't be met, the repetition limit holds."""

    def bisect(fits_low: bool, good) -> float:
        low, high = 0.0, 1.0
        for _ in range(60):
            mid = (low + high) / 2
            if good(mid) == fits_low:
                low = mid
            else:
                high = mid
        return low if fits_low else high

    if len(tokens) < 2:
        return 1.0
    goal = target_entropy * np.log(len(tokens))
    by_entropy = 1.0 if entropy(weights(tokens, 1.0)) >= goal else bisect(True, lambda a: entropy(weights(tokens, a)) >= goal)
    by_repetition = 0.0 if spread(tokens, 0.0) <= repetition else bisect(False, lambda a: spread(tokens, a) <= repetition)
    return max(by_entropy, by_repetition)


def plan(tokens: np.ndarray, config: MixConfig) -> tuple[float, np.ndarray, np.ndarray]:
    """Alpha, the weights, and the budget of each source in tokens."""
    alpha = solve_alpha(tokens, config.target_entropy, config.repetition)
    w = weights(tokens, alpha)
    if config.budget is not None:
        return alpha, w, np.floor(w * config.budget).astype(np.int64)
    return alpha, w, np.maximum(np.rint(w * (tokens / w).max()).astype(np.int64), tokens)


def mix(df: DataFrame, config: MixConfig = MixConfig(), text: str = "text", source: str = "source", ident: str = "doc_id", positions: bool = False) -> DataFrame:
    """Every row as often as the mixture shows it.

    Adds ``epoch`` (from 0), and with ``positions`` also mix_tokens, mix_weight, mix_block (the
    block's rank in its source's epoch) and mix_order in [0, 1): tokens of the source before the
    block, as a part of its budget; sorting by it interleaves the sources at their weights. A
    document's tokens are its words, one at least. Null sources form a source of their own; null
    and empty texts count as one token. Equal rows share a place in the order: they come in or
    stay out of the last epoch together. All columns stay, but those of the new names.
    """
    spark = df.sparkSession
    scratch = Scratch(spark, "mix")
    added = ["epoch", "mix_tokens", "mix_weight", "mix_block", "mix_order"]
    df, new = shield(df.drop(*added))
    text, source, ident = (new.get(c, c) for c in (text, source, ident))
    tokens = F.greatest(F.lit(1), F.coalesce(F.regexp_count(f"`{text}`", F.lit(r"\S+")), F.lit(0))).cast("long")
    key = F.coalesce(F.concat(F.lit("="), F.col(f"`{source}`").cast("string")), F.lit("-"))
    hashed = F.xxhash64(F.lit(config.seed), F.col(f"`{ident}`"), F.col(f"`{text}`"))
    df = df.withColumns({"_key": key, "_hash": hashed, "_tokens": tokens})
    df = df.withColumn("_block", F.pmod("_hash", F.lit(config.blocks)).cast("int"))
    light = scratch.keep(df.select("_key", "_hash", "_tokens", "_block"))
    totals = {r["_key"]: r["t"] for r in light.groupBy("_key").agg(F.sum("_tokens").alias("t")).orderBy("_key").limit(config.max_sources + 1).collect()}
    if len(totals) > config.max_sources:
        raise ValueError(f"more than {config.max_sources} sources")
    names, have = list(totals), np.array(list(totals.values()), np.int64)
    alpha, w, budget = plan(have, config) if names else (1.0, np.zeros(0), np.zeros(0, np.int64))
    full, rest = budget // np.maximum(have, 1), budget % np.maximum(have, 1)
    rows = [(n, float(a), int(b), int(f), int(r)) for n, a, b, f, r in zip(names, w, budget, full, rest)]
    sources = F.broadcast(spark.createDataFrame(rows, "_key string, _weight double, _budget long, _full long, _rest long"))
    # the order of blocks in every epoch; a row for each source, epoch and block
    blocks = light.groupBy("_key", "_block").agg(F.sum("_tokens").alias("_sum"))
    order = lambda epoch, what: F.xxhash64(F.lit(config.seed + 1), epoch, what)
    blocks = blocks.join(sources, "_key").withColumn("epoch", F.explode(F.expr("sequence(0L, _full)")))
    by = Window.partitionBy("_key", "epoch").orderBy(order(F.col("epoch"), F.col("_block")), "_block")
    before = F.coalesce(F.sum("_sum").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    blocks = scratch.keep(blocks.select("_key", "_block", "epoch", "_sum", "_full", "_rest", "_weight", "_budget", (F.row_number().over(by) - 1).alias("mix_block"), before.alias("_before")))
    # the block in which the last epoch's budget ends, and the documents of it that still fit
    last = blocks.where("epoch = _full and _rest > _before")
    whole = last.where("_before + _sum <= _rest").select("_key", "_block")
    edge = last.where("_before + _sum > _rest").select("_key", "_block", (F.col("_rest") - F.col("_before")).alias("_room"), "_full")
    edge_rows = light.join(F.broadcast(edge), ["_key", "_block"]).groupBy("_key", "_hash", "_room", "_full").agg(F.sum("_tokens").alias("_tokens"))
    edge_rows = edge_rows.withColumn("_turn", order(F.col("_full"), F.col("_hash")))
    edge_rows = scratch.keep(edge_rows)
    slots = buckets_for(edge_rows.count() // max(len(names), 1))
    fits = running(edge_rows, ["_key"], ["_turn", "_hash"], F.col("_tokens"), "_sofar", slots).where("_sofar + _tokens <= _room")
    part = scratch.keep(fits.select("_key", "_hash", F.lit(True).alias("_fits")))
    whole = whole.withColumn("_whole", F.lit(True))
    # blocks are sources x blocks at most, a bound that doesn't grow with the documents
    out = df.join(sources, "_key").join(F.broadcast(whole), ["_key", "_block"], "left")
    out = out.join(part, ["_key", "_hash"], "left")
    copies = F.col("_full") + F.when(F.col("_whole") | F.col("_fits"), 1).otherwise(0)
    out = out.withColumn("epoch", F.explode(F.when(copies > 0, F.sequence(F.lit(0), copies - 1)).otherwise(F.array().cast("array<bigint>"))))
    kept = [f"`{c}`" for c in df.columns if not c.startswith("_")]
    if not positions:
        return unshield(out.select(*kept, F.col("epoch").cast("int").alias("epoch")), new)
    place = blocks.select("_key", "_block", "epoch", "mix_block", "_before")
    out = out.join(place, ["_key", "_block", "epoch"])
    start = (F.col("epoch") * F.col("_total") + F.col("_before")) / F.col("_budget")
    total = F.broadcast(spark.createDataFrame([(n, int(t)) for n, t in totals.items()], "_key string, _total long"))
    out = out.join(total, "_key").select(*kept, F.col("epoch").cast("int").alias("epoch"), F.col("_tokens").alias("mix_tokens"), F.col("_weight").alias("mix_weight"), F.col("mix_block").cast("int").alias("mix_block"), start.alias("mix_order"))
    return unshield(out, new)
