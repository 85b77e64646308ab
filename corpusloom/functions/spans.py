"""Places of patterns in a text, as arrays that stay with their row."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def _zipped(arrays: dict[str, Column]) -> Column:
    """Structs of the elements of arrays of equal size."""
    first = next(iter(arrays))
    return let(F.struct(*(x.alias(n) for n, x in arrays.items())), lambda s: F.transform(s[first], lambda _, i: F.struct(*(F.get(s[n], i).alias(n) for n in arrays))))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is worked out once however often ``body`` names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def pattern_spans(text: Column, pattern: str, groups: dict[str, int] | None = None, needs: tuple[str, ...] = ()) -> Column:
    """Array of (start, end, span, and a string for each of ``groups``, null where it took no part), leftmost first.

    ``pattern`` must not match the empty string. Offsets count characters. What lies between two
    matches is what ``split`` leaves, so that the lengths of both give every place. ``needs``: words
    that each match holds as they are; a text without one of them is not searched.
    """
    names = list(groups or {})
    kind = "".join(f",`{n}`:string" for n in names)
    nothing = F.expr(f"cast(array() as array<struct<start:int,end:int,span:string{kind}>>)")

    def starts(found: Column, between: Column) -> Column:
        step = lambda acc, i: F.struct(
            (acc["at"] + F.length(between[i]) + F.length(found[i])).alias("at"), F.concat(acc["starts"], F.array(acc["at"] + F.length(between[i]))).alias("starts")
        )
        zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("starts"))
        return F.aggregate(F.transform(found, lambda _, i: i), zero, step, lambda acc: acc["starts"])

    def listed(found: Column) -> Column:
        begins = let(F.split(text, pattern, -1), lambda between: starts(found, between))
        parts = [F.regexp_extract_all(text, F.lit(pattern), F.lit(g)) for g in (groups or {}).values()]
        zipped = _zipped({"start": begins, "span": found, **dict(zip(names, parts))})
        return F.transform(zipped, lambda r: F.struct(r.getField("start").alias("start"), (r.getField("start") + F.length(r.getField("span"))).alias("end"), r.getField("span").alias("span"), *(F.nullif(r.getField(n), F.lit("")).alias(n) for n in names)))

    every = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    for word in needs:
        every = F.when(~F.contains(text, F.lit(word)), F.array().cast("array<string>")).otherwise(every)
    return let(every, lambda found: F.when(F.size(found) == 0, nothing).otherwise(listed(found)))


def overlaps(span: Column, others: Column) -> Column:
    return F.exists(others, lambda o: (span["start"] < o["end"]) & (o["start"] < span["end"]))


def places(spans: Column) -> Column:
    """(start, end) of each of ``spans``."""
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end")))


def apart_from(spans: Column, taken: Column) -> Column:
    """Those of ``spans`` that overlap none of ``taken``."""
    return F.filter(spans, lambda s: ~overlaps(s, taken))


def literal_pattern(words: list[str]) -> str:
    """An alternation of ``words`` as they are, longer ones first, so that the longest that fits is taken."""
    return "|".join("\\Q" + w.replace("\\E", "\\E\\\\E\\Q") + "\\E" for w in sorted(set(words), key=lambda w: (-len(w), w)))
