"""Spans of aliases in texts, selection among overlapping ones, a provenance check, expansion of number ranges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.spans import literal_pattern, pattern_spans
from .cited import expand_articles


def alias_spans(texts: DataFrame, aliases: list[str], ident: str, text: str) -> DataFrame:
    """(ident, alias, start, end): leftmost longest places of ``aliases``, without overlaps.

    One pattern finds all aliases in one pass over a text, and rows don't move.
    """
    found = pattern_spans(F.col(text), literal_pattern(aliases))
    return texts.select(ident, F.explode(found).alias("_s")).select(ident, F.col("_s.span").alias("alias"), "_s.start", "_s.end")


def literal_spans(texts: DataFrame, aliases: DataFrame, ident: str, text: str) -> DataFrame:
    """(ident, alias, start, end) of every place of every alias, found by splitting at it (no overlap with itself)."""
    hits = texts.join(aliases, F.col(text).contains(F.col("alias")))
    pieces = F.expr(f"split({text}, concat('\\\\Q', alias, '\\\\E'), -1)")
    rows = hits.select(ident, "alias", F.posexplode(pieces).alias("n", "piece"), F.size(pieces).alias("m"), F.transform(pieces, lambda p: F.length(p)).alias("sizes"))
    start = F.aggregate(F.slice("sizes", F.lit(1), F.col("n") + 1), F.lit(0), lambda s, x: s + x) + F.col("n") * F.length("alias")
    rows = rows.where(F.col("n") < F.col("m") - 1).select(ident, "alias", start.alias("start"))
    return rows.withColumn("end", F.col("start") + F.length("alias"))


def select_spans(spans: DataFrame, ident: str, order: list[Column]) -> DataFrame:
    """Greedy choice within each text: spans in ``order``, each kept if it overlaps none kept before."""
    listed = F.array_sort(F.collect_list(F.struct(*(o.alias(f"_o{i}") for i, o in enumerate(order)), "start", "end", "alias")))
    keep = lambda acc, s: F.when(F.exists(acc, lambda a: (a["start"] < s["end"]) & (s["start"] < a["end"])), acc).otherwise(F.concat(acc, F.array(s)))
    grouped = spans.groupBy(ident).agg(listed.alias("_all"))
    grouped = grouped.withColumn("_kept", F.aggregate("_all", F.slice("_all", 1, 0), keep))
    return grouped.select(ident, F.explode("_kept").alias("_s")).select(ident, "_s.alias", "_s.start", "_s.end")


def provenance_violations(rows: DataFrame, text: str, span: str, offset: str) -> DataFrame:
    """Rows whose text doesn't hold the span at its offset."""
    return rows.where(F.coalesce(F.substr(F.col(text), F.col(offset) + 1, F.length(span)) != F.col(span), F.lit(True)))


def expand_ranges(df: DataFrame, column: str, out: str) -> DataFrame:
    """A row for each number of lists and ranges like ``5-8, 11 va 12``; see ``cited.expand_articles``."""
    return df.withColumn(out, F.explode(expand_articles(F.col(column))))
