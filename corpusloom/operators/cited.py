"""Parsers of citations: gold lists, citations displayed in answers, older forms and logic facts.

The registry is (source, title, alias, atoms) rows; its aliases become one pattern, so that a text
is read once whatever the number of sources. Registries are lists that people keep: some hundreds
of rows, checked against ``MOST_ALIASES``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import ids
from ..functions.spans import let, literal_pattern, pattern_spans
from ..functions.text import fold_text

MOST_ALIASES = 20_000

# The forms of citations in folded texts, and of older ones.
ARTICLES = r"\bdieu\s+(\d+[a-z]?(?:\s*(?:-|,|va)\s*\d+[a-z]?)*)(?=\b)"
PLACE = r"\bdieu\s+(\d+[a-z]?)(?:\s+khoan\s+(\d+[a-z]?))?(?:\s+diem\s+([a-z]))?"
LEGACY = r"\[Điều\s+(\d+)(?:\s+khoản\s+(\d+))?(?:\s+điểm\s+([a-zđ]))?\]"
FACT = r"(?i)legal_source\(\s*[^,]+,\s*([a-z0-9_]+)\s*,\s*(article_\d+[a-z]?)\s*,\s*(clause_\d+[a-z]?|none)\s*,\s*(point_[a-z]|[a-z]|none)\s*,"
WIDEST = 50


class Registry:
    """The sources of a registry, ready for use in expressions."""

    def __init__(self, rows: DataFrame):
        listed = rows.limit(MOST_ALIASES + 1).collect()
        if len(listed) > MOST_ALIASES:
            raise ValueError(f"a registry has {MOST_ALIASES} aliases at most")
        self.source = {r["alias"]: r["source"] for r in sorted(listed, key=lambda r: r["source"], reverse=True)}
        self.title = {r["source"]: r["title"] for r in listed}
        self.atom = {a: r["source"] for r in sorted(listed, key=lambda r: r["source"], reverse=True) for a in r["atoms"] or []}
        self.pattern = rf"(?<![a-z0-9])(?:{literal_pattern(list(self.source))})(?![a-z0-9])" if self.source else "(?!)"

    @staticmethod
    def _lookup(table: dict[str, str], key: Column) -> Column:
        mark, gap = "\x01", "\x02"
        return F.str_to_map(F.lit(mark.join(f"{k}{gap}{v}" for k, v in table.items())), F.lit(mark), F.lit(gap))[key] if table else F.lit(None).cast("string")

    def source_of(self, alias: Column) -> Column:
        return self._lookup(self.source, alias)

    def title_of(self, source: Column) -> Column:
        return self._lookup(self.title, source)

    def source_of_atom(self, atom: Column) -> Column:
        return self._lookup(self.atom, F.lower(F.trim(atom)))

    def occurrences(self, folded: Column) -> Column:
        """Array of (start, end, span, source): leftmost longest aliases that stand alone."""
        spans = pattern_spans(folded, self.pattern)
        return F.transform(spans, lambda s: F.struct(s["start"], s["end"], s["span"], self.source_of(s["span"]).alias("source")))


def expand_articles(spec: Column) -> Column:
    """The article numbers of ``5-8``, ``5, 6 va 7`` or ``12a``; reversed, lettered and too wide ranges give none."""
    parts = F.filter(F.split(F.trim(spec), r"\s*,\s*|\s+va\s+"), lambda p: p != "")
    low, high = (lambda p: F.regexp_extract(p, r"^\s*(\d+)\s*-\s*(\d+)\s*$", 1).try_cast("int")), (lambda p: F.regexp_extract(p, r"^\s*(\d+)\s*-\s*(\d+)\s*$", 2).try_cast("int"))
    fits = lambda p: (low(p) <= high(p)) & (high(p) - low(p) <= WIDEST)
    numbers = lambda p: F.when(~F.contains(p, F.lit("-")), F.array(F.lower(p))).when(fits(p), F.transform(F.sequence(low(p), high(p)), lambda x: x.cast("string"))).otherwise(F.array().cast("array<string>"))
    return F.flatten(F.transform(parts, numbers))


def articles_in(folded: Column) -> Column:
    return F.flatten(F.transform(F.regexp_extract_all(folded, F.lit(ARTICLES), F.lit(1)), expand_articles))


def parse_gold(rows: DataFrame, ident: str, raw: str, registry: Registry) -> DataFrame:
    """(ident, refs, errors): cited article identifiers in order, each once, and (error_type, text) of what can't be read.

    Each line or part between semicolons names authorities; an authority's articles stand before it
    (from the end of the one before), else after it (up to the next).
    """
    segments = F.filter(F.transform(F.split(F.coalesce(raw, F.lit("")), r"[\n;]+"), lambda s: F.regexp_replace(s, r"(?U)^\s+|\s+$", "")), lambda s: s != "")

    def of_authority(segment: Column, folded: Column, found: Column, o: Column, i: Column) -> Column:
        left = F.when(i > 0, F.get(found, i - 1)["end"]).otherwise(0)
        right = F.coalesce(F.get(found, i + 1)["start"], F.length(folded))
        before = articles_in(F.substr(folded, left + 1, o["start"] - left))
        after = articles_in(F.substr(folded, o["end"] + 1, right - o["end"]))
        listed = let(before, lambda x: F.when(F.size(x) > 0, x).otherwise(after))
        return let(listed, lambda x: F.struct(F.transform(x, lambda a: ids.article_id(o["source"], a)).alias("refs"), F.when(F.size(x) == 0, F.lit("article_missing")).alias("error_type"), segment.alias("text")))

    def of_segment(segment: Column) -> Column:
        none = F.array(F.struct(F.array().cast("array<string>").alias("refs"), F.lit("authority_unresolved").alias("error_type"), segment.alias("text")))
        with_found = lambda folded, found: F.when(F.size(found) == 0, none).otherwise(F.transform(found, lambda o, i: of_authority(segment, folded, found, o, i)))
        return let(fold_text(segment), lambda folded: let(registry.occurrences(folded), lambda found: with_found(folded, found)))

    each = F.flatten(F.transform(segments, of_segment))
    empty = F.array(F.struct(F.array().cast("array<string>").alias("refs"), F.lit("missing_gold_citations_raw").alias("error_type"), F.lit("").alias("text")))
    read = rows.select(ident, F.when(F.size(segments) == 0, empty).otherwise(each).alias("_all"))
    wrong = F.transform(F.filter("_all", lambda x: x["error_type"].isNotNull()), lambda x: F.struct(x["error_type"].alias("error_type"), x["text"].alias("text")))
    return read.select(ident, F.array_distinct(F.flatten(F.transform("_all", lambda x: x["refs"]))).alias("refs"), wrong.alias("errors"))


def displayed_citations(answer: Column, registry: Registry, compat: bool = False) -> Column:
    """Array of (source, article, clause, point) of citations in square brackets, each once.

    A bracket counts if it names one source and articles after it. It may name that source by two
    names, unless ``compat``.
    """
    blocks = F.transform(F.regexp_extract_all(F.coalesce(answer, F.lit("")), F.lit(r"\[([^\[\]]+)\]"), F.lit(1)), fold_text)

    def with_found(block: Column, found: Column) -> Column:
        count = F.size(found) if compat else F.size(F.array_distinct(F.transform(found, lambda o: o["source"])))
        end, source = F.get(found, F.size(found) - 1)["end"], F.get(found, F.lit(0))["source"]
        tail = F.when(count == 1, F.substr(block, end + 1, F.length(block))).otherwise("")
        spans = pattern_spans(tail, PLACE, {"article": 1, "clause": 2, "point": 3})
        return F.transform(spans, lambda s: F.struct(source.alias("source"), s["article"].alias("article"), s["clause"].alias("clause"), s["point"].alias("point")))

    refs = F.transform(blocks, lambda block: let(registry.occurrences(block), lambda found: with_found(block, found)))
    return F.array_distinct(F.flatten(refs))


def item_of(ref: Column) -> Column:
    return ids.item_id(ref["source"], ref["article"], ref["clause"], ref["point"])


def shows(displayed: Column, ref: Column) -> Column:
    """Whether one of ``displayed`` is ``ref`` or lies within it; a point must be named with its clause."""
    same = lambda d, part: d[part].eqNullSafe(ref[part])
    deep = lambda d: F.when(ref["point"].isNotNull(), same(d, "clause") & same(d, "point")).when(ref["clause"].isNotNull(), same(d, "clause")).otherwise(F.lit(True))
    return F.exists(displayed, lambda d: same(d, "source") & same(d, "article") & deep(d))


def legacy_citations(answer: Column, law: str) -> Column:
    """Graph identifiers of ``[Điều 64 khoản 1 điểm a]`` of one law, each once."""
    tail = lambda s: F.coalesce(F.concat(F.lit(".K"), s["clause"], F.coalesce(F.concat(F.lit("."), s["point"]), F.lit(""))), F.lit(""))
    spans = pattern_spans(answer, LEGACY, {"article": 1, "clause": 2, "point": 3})
    return F.array_distinct(F.transform(spans, lambda s: F.concat(F.lit(f"{law}.A"), s["article"], tail(s))))


def fact_citations(facts: Column, registry: Registry) -> Column:
    """Identifiers of cited items in an array of ``legal_source(...)`` facts, each once; facts of unknown laws give none."""

    def of_fact(fact: Column) -> Column:
        spans = pattern_spans(fact, FACT, {"law": 1, "article": 2, "clause": 3, "point": 4})
        bare = lambda x, prefix: F.when(F.lower(x) != "none", F.regexp_replace(F.lower(x), f"^{prefix}", ""))
        made = F.transform(spans, lambda s: ids.item_id(registry.source_of_atom(s["law"]), bare(s["article"], "article_"), bare(s["clause"], "clause_"), bare(s["point"], "point_")))
        return F.filter(made, lambda x: x.isNotNull())

    return F.array_distinct(F.flatten(F.transform(facts, of_fact)))


def citation_records(records: DataFrame, gold: DataFrame, registry: Registry, key: list[str]) -> DataFrame:
    """Records (key, citation_ids, answer) with their gold ``refs`` as (predicted, parse_errors, gold, displayed), for ``citation_metrics``.

    A record without gold is an error: it raises when the row is read.
    """
    sources = sorted(registry.title)
    parsed = F.transform(F.filter(F.transform(F.coalesce("citation_ids", F.array().cast("array<string>")), lambda x: F.trim(x)), lambda x: x != ""), lambda x: ids.parse_citation_id(x, sources))
    good = F.filter(parsed, lambda p: p.isNotNull())
    rows = records.join(gold, key, "left").withColumn("gold", F.coalesce("refs", F.when(F.col("refs").isNull(), F.raise_error(F.lit("a record has no gold"))).cast("array<string>")))
    rows = rows.withColumns({"_good": F.array_distinct(good), "parse_errors": F.size(parsed) - F.size(good), "_shown": displayed_citations(F.col("answer"), registry)})
    rows = rows.withColumns({"predicted": F.transform("_good", item_of), "displayed": F.transform("_shown", item_of), "shown": F.transform(F.filter("_good", lambda r: shows(F.col("_shown"), r)), item_of)})
    return rows.drop("_good", "_shown", "refs")
