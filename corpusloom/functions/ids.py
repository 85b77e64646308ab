"""Identifiers of laws and their parts: built, read back, labelled and converted."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import slug

# The forms of identifiers, and the prefixes and lengths of those of concepts.
STRUCTURAL = r"^([A-Z][A-Z0-9_]*)(?:\.C(\d+))?(?:\.A(\d+))?(?:\.K(\d+))?(?:\.([a-zđ]))?(?:\.T(\d+))?$"
CITED = r"(?i)^([A-Z0-9_]+)\.A(\d+[a-z]?)(?:\.K(\d+[a-z]?))?(?:\.D?([a-zđ]))?$"
CITED_PLAIN = CITED.replace("đ", "")
CANONICAL_LAW, LAW_CODE = r"^[A-Z][A-Z0-9_]*$", r"^(\d+)/(\d{4})/QH\d+$"
PREFIX = {"concept": "concept", "subject": "subject", "benefit": "benefit", "organization": "org", "role": "role", "fund": "fund", "condition": "cond", "obligation": "oblig", "right": "right", "prohibited": "prohib"}
CLIPPED = {"condition", "obligation", "right", "prohibited"}
CLIP = 80


def law_id(code: Column, strict: bool = True) -> Column:
    """A canonical law id as it is, or the one of a code like ``41/2024/QH15``; others raise, or are null if not ``strict``."""
    made = F.concat(F.lit("L"), F.regexp_extract(code, LAW_CODE, 1), F.lit("_"), F.regexp_extract(code, LAW_CODE, 2))
    wrong = F.raise_error(F.concat(F.lit("no law id or code: "), F.coalesce(code, F.lit("")))).cast("string") if strict else F.lit(None).cast("string")
    return F.when(code.rlike(CANONICAL_LAW), code).when(code.rlike(LAW_CODE), made).otherwise(wrong)


def _under(parent: Column, mark: str, part: Column) -> Column:
    return F.concat(parent, F.lit(mark), part.cast("string"))


def chapter_id(law: Column, chapter: Column) -> Column:
    return _under(law, ".C", chapter)


def section_id(law: Column, chapter: Column, section: Column) -> Column:
    """Sections are numbered within their chapter."""
    return _under(chapter_id(law, chapter), ".M", section)


def article_id(law: Column, article: Column) -> Column:
    return _under(law, ".A", article)


def clause_id(law: Column, article: Column, clause: Column) -> Column:
    return _under(article_id(law, article), ".K", clause)


def point_id(law: Column, article: Column, clause: Column, letter: Column) -> Column:
    return _under(clause_id(law, article, clause), ".", F.lower(letter))


def table_id(law: Column, article: Column, index: Column) -> Column:
    return _under(article_id(law, article), ".T", index)


def semantic_id(kind: str, text: Column) -> Column:
    """``concept:...`` and its like; identifiers of long statements are cut."""
    return F.concat(F.lit(PREFIX[kind] + ":"), slug(text, CLIP if kind in CLIPPED else None))


def external_law_id(code: Column) -> Column:
    return F.concat(F.lit("ext:"), F.trim(code))


def parse_id(identifier: Column) -> Column:
    """Struct (law, chapter, article, clause, point, table) of an identifier; null if it isn't one. đ is a letter of its own."""
    part = lambda i: F.nullif(F.regexp_extract(identifier, STRUCTURAL, i), F.lit(""))
    named = [part(i).cast("string" if name in ("law", "point") else "int").alias(name) for i, name in enumerate(("law", "chapter", "article", "clause", "point", "table"), 1)]
    return F.when(identifier.rlike(STRUCTURAL), F.struct(*named))


def is_clause(identifier: Column) -> Column:
    p = parse_id(identifier)
    return F.coalesce(p["clause"].isNotNull() & p["point"].isNull(), F.lit(False))


def is_article(identifier: Column) -> Column:
    p = parse_id(identifier)
    return F.coalesce(p["article"].isNotNull() & p["clause"].isNull() & p["table"].isNull(), F.lit(False))


def _place(article: Column, clause: Column, point: Column) -> Column:
    return F.concat_ws(" ", F.concat(F.lit("Điều "), article.cast("string")), F.concat(F.lit("khoản "), clause.cast("string")), F.concat(F.lit("điểm "), point))


def citation_label(identifier: Column) -> Column:
    """``Điều 64 khoản 1 điểm a``; an identifier without these parts as it is."""
    p = parse_id(identifier)
    return F.coalesce(F.nullif(_place(p["article"], p["clause"], p["point"]), F.lit("")), identifier)


def item_id(source: Column, article: Column, clause: Column, point: Column) -> Column:
    """The identifier of a cited item; parts that are null are left out."""
    tail = lambda mark, x: F.coalesce(F.concat(F.lit(mark), x), F.lit(""))
    return F.concat(source, F.lit(".A"), article, tail(".K", clause), tail(".D", point))


def parse_citation_id(identifier: Column, sources: list[str] | None = None, compat: bool = False) -> Column:
    """Struct (source, article, clause, point) of a cited item's identifier; null if it isn't one or its source is unknown.

    ``compat`` doesn't take đ for a point's letter.
    """
    form = CITED_PLAIN if compat else CITED
    text = F.trim(identifier)
    part = lambda i: F.nullif(F.regexp_extract(text, form, i), F.lit(""))
    ok = text.rlike(form)
    if sources is not None:
        ok = ok & F.upper(part(1)).isin(sources)
    return F.when(ok, F.struct(F.upper(part(1)).alias("source"), F.lower(part(2)).alias("article"), F.lower(part(3)).alias("clause"), F.lower(part(4)).alias("point")))


def format_citation(ref: Column, title: Column) -> Column:
    """``[title, Điều 64 khoản 1 điểm a]`` of a struct as ``parse_citation_id`` gives it."""
    return F.concat(F.lit("["), title, F.lit(", "), _place(ref["article"], ref["clause"], ref["point"]), F.lit("]"))


def graph_to_citation_id(identifier: Column) -> Column:
    """A point's identifier in the graph (``.a``) as the one of a cited item (``.Da``); others as they are."""
    return F.regexp_replace(identifier, r"(\.K\d+)\.([a-zđ])$", "$1.D$2")


def citation_to_graph_id(identifier: Column) -> Column:
    return F.regexp_replace(identifier, r"(\.K\d+)\.D([a-zđ])$", "$1.$2")


def ontology_slug(text: Column) -> Column:
    """A slug with underscores; ``unknown`` for what has no letter or digit."""
    return F.coalesce(F.nullif(slug(text, join="_"), F.lit("")), F.lit("unknown"))


def ontology_id(kind: str, *parts: Column) -> Column:
    return F.concat_ws(":", F.lit(kind), *(ontology_slug(p) for p in parts))


def file_name(model: Column) -> Column:
    """A model's name as part of a file name."""
    return F.regexp_replace(model, r"[^A-Za-z0-9_-]", "_")
