"""Chat formatting with cumulative-snapshot collapse.

Logs often hold a conversation again after every turn. Each turn is hashed with its place, and a
rolling exclusive-or over the turns gives a hash of every prefix of every conversation. A
conversation whose whole hash is a proper prefix of another is a snapshot of it; an anti-join
drops these, equal conversations collapse to one, and the maximal ones are rendered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch

OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"


def _sized(c: str) -> Column:
    return F.coalesce(F.concat(F.length(c).cast("string"), F.lit(":"), F.col(c)), F.lit("-"))


def turn_digest() -> Column:
    """SHA-256 of role and text, in which null differs from empty."""
    return F.unhex(F.sha2(F.concat(_sized("role"), _sized("text")), 256))


def prefix_hashes(turns: DataFrame) -> DataFrame:
    """(conv_id, turns, place, a, b): 120 bits for each turn prefix of each conversation."""
    rows = turns.select("conv_id", "turn", turn_digest().alias("digest")).distinct()
    by = Window.partitionBy("conv_id").orderBy("turn", "digest")
    placed = rows.withColumn("place", F.row_number().over(by))
    tag = F.sha2(F.concat("digest", F.col("place").cast("string").cast("binary")), 256)
    placed = placed.select("conv_id", "turn", "digest", "place", tag.alias("tag"))
    half = lambda at: F.conv(F.substring("tag", at, 15), 16, 10).cast("long")
    so_far = by.rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy("conv_id").orderBy("turn", "digest").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return placed.select(
        "conv_id",
        F.count(F.lit(1)).over(whole).alias("turns"),
        F.col("place").cast("long").alias("place"),
        F.bit_xor(half(1)).over(so_far).alias("a"),
        F.bit_xor(half(16)).over(so_far).alias("b"),
    )


def render(role: Column, text: Column) -> Column:
    """One turn as chat markup; markers inside a text are broken by a space."""
    safe = F.replace(F.coalesce(text, F.lit("")), F.lit("<|im_"), F.lit("<| im_"))
    return F.concat(F.lit(OPEN), F.coalesce(role, F.lit("unknown")), F.lit("\n"), safe, F.lit(CLOSE))


def format_chats(turns: DataFrame) -> DataFrame:
    """Maximal conversations of rows (conv_id, turn, role, text), rendered.

    Returns conv_id, n_turns, n_copies and rendered, one row for each maximal conversation.
    ``n_copies`` counts the conversations with exactly these turns; the smallest conv_id stands
    for them. Turns are in the order of ``turn`` (null first, then by a digest). Fully equal rows
    count once; rows with a null conv_id belong to no conversation and are left out. A null role
    is rendered as ``unknown`` and a null text as an empty one, but neither equals another value.
    Further columns are ignored.
    """
    scratch = Scratch(turns.sparkSession, "chats")
    turns = turns.select("conv_id", "turn", "role", "text").where(F.col("conv_id").isNotNull())
    prefixes = scratch.keep(prefix_hashes(turns))
    key = ["place", "a", "b"]
    whole = prefixes.where("place = turns").groupBy(*key).agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_copies"))
    longer = prefixes.where("place < turns").select(*key).distinct()
    maximal = scratch.keep(whole.join(longer, key, "left_anti").select("conv_id", F.col("place").alias("n_turns"), "n_copies"))
    scratch.drop(prefixes)
    kept = turns.join(maximal.select("conv_id"), "conv_id", "left_semi")
    line = F.struct("turn", turn_digest().alias("digest"), "role", "text")
    texts = kept.groupBy("conv_id").agg(F.array_sort(F.collect_set(line)).alias("lines"))
    rendered = F.array_join(F.transform("lines", lambda x: render(x["role"], x["text"])), "")
    return texts.join(maximal, "conv_id").select("conv_id", "n_turns", "n_copies", rendered.alias("rendered"))
