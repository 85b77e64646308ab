"""Incremental forms of batch semantics: deduplicated appends and keyed upserts on streams."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.graph import upsert


def deduplicated(stream: DataFrame, ident: str, time: str, delay: str) -> DataFrame:
    """Each id once, within the time that late copies may take."""
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark([ident])


def windowed_counts(stream: DataFrame, time: str, key: str, size: str, slide: str, delay: str) -> DataFrame:
    return stream.withWatermark(time, delay).groupBy(F.window(time, size, slide), key).agg(F.count(F.lit(1)).alias("n"))


def upsert_batches(read: Callable[[], DataFrame], write: Callable[[DataFrame], None], key: list[str], order: str) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that merges each batch into the target, last writer per property."""

    def run(batch: DataFrame, _: int) -> None:
        write(upsert(read(), batch, key, order))

    return run
