"""A property graph from parsed statutes, references and extracted statements.

Nodes are (label, id, ord, props, mentioned_in, definition), edges (type, src, dst, source_clause,
source_text, span, char_offset, ord, props); ``props`` are maps of strings without nulls. ``ord``
is the order of loading, by which the first of equal rows is told.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import ids
from .documents import next_edges
from .graph import dedupe_edges, merge_nodes

# What makes two edges the same, besides type, src, dst and source_clause, and the length of quoted sources.
EDGE_KEYS = {"CITES_EXTERNAL": ["char_offset"], "REFERS_TO": ["char_offset"], "REFERENCES": ["char_offset"], "AMENDS": ["external_article"], "REPEALS": ["external_article"], "REPLACES": ["external_article"], "semantic": ["source_text"]}
QUOTE = 300
EDGE_ENDS = {"ENTITLED_TO": ("Subject", "Benefit"), "PAID_FROM": ("Benefit", "Fund"), "MANAGES": ("Organization", "Fund"), "DEFINES": ("Article", "LegalConcept")}


def _props(*columns: str) -> Column:
    pairs = [x for c in columns for x in (F.lit(c), F.col(c).cast("string"))]
    return F.map_filter(F.create_map(*pairs), lambda _, v: v.isNotNull()) if columns else F.expr("map()").cast("map<string,string>")


def _nodes(df: DataFrame, label: str, ident: str, props: list[str], ord_: Column, mentioned: Column | None = None, definition: Column | None = None) -> DataFrame:
    none = F.lit(None).cast("string")
    return df.select(
        F.lit(label).alias("label"), F.col(ident).alias("id"), ord_.cast("long").alias("ord"), _props(*props).alias("props"),
        (mentioned if mentioned is not None else F.array().cast("array<string>")).alias("mentioned_in"), (definition if definition is not None else none).alias("definition"),
    )


def _edges(df: DataFrame, kind: Column, src: Column, dst: Column, ord_: Column, props: list[str] = [], source: str | None = None, quote: str | None = None, span: bool = False) -> DataFrame:  # noqa: B006
    none = F.lit(None)
    return df.select(
        kind.alias("type"), src.alias("src"), dst.alias("dst"),
        (F.col(source) if source else none.cast("string")).alias("source_clause"), (F.substring(quote, 1, QUOTE) if quote else none.cast("string")).alias("source_text"),
        (F.col("span") if span else none.cast("string")).alias("span"), (F.col("char_offset") if span else none.cast("int")).alias("char_offset"),
        ord_.cast("long").alias("ord"), _props(*props).alias("props"),
    )


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def structural_graph(parts: dict[str, DataFrame], laws: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and containment edges of parsed laws; ``laws`` is a table as ``law_table`` makes it."""
    at = F.col("ord")
    nodes = [
        _nodes(laws, "Law", "law", ["code", "full_id", "title", "canonical_title", "type", "effective_date", "issued_date", "repealed_date"], at),
        _nodes(parts["chapters"], "Chapter", "id", ["law", "number", "roman", "title"], at),
        _nodes(parts["sections"], "Section", "id", ["law", "number", "title", "chapter_id"], at),
        _nodes(parts["articles"], "Article", "id", ["law", "number", "title", "chapter_id", "section_id", *(["full_text"] if "full_text" in parts["articles"].columns else [])], at),
        _nodes(parts["clauses"], "Clause", "id", ["law", "number", "text", "article_id"], at),
        _nodes(parts["points"], "Point", "id", ["law", "letter", "text", "clause_id"], at),
    ]
    edge = lambda name, kind, src, dst: _edges(parts[name], F.lit(kind), F.col(src), F.col(dst), at)
    follow = next_edges(parts["articles"], "law", ["ord"], "id").select(F.lit("NEXT").alias("type"), "src", "dst")
    edges = [
        edge("chapters", "HAS_CHAPTER", "law", "id"), edge("sections", "HAS_SECTION", "chapter_id", "id"), edge("articles", "HAS_ARTICLE", "chapter_id", "id"), edge("articles", "BELONGS_TO", "id", "law"),
        _edges(parts["articles"].where("section_id is not null"), F.lit("IN_SECTION"), F.col("id"), F.col("section_id"), at), edge("clauses", "HAS_CLAUSE", "article_id", "id"), edge("points", "HAS_POINT", "clause_id", "id"),
        _edges(follow, F.lit("NEXT"), F.col("src"), F.col("dst"), F.lit(0)),
    ]
    return _union(nodes), _union(edges)


def reference_graph(refs: dict[str, DataFrame], articles: DataFrame, laws: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of what ``extract_references`` found: citations, links to loaded laws, amendments, repeals, definitions."""
    at, zero = F.col("char_offset"), F.lit(0)
    external, acts, defined = refs["external"], refs["amendments"], refs["definitions"]
    outer = ["external_article", "external_clause", "external_point"]
    named = ["external_code", "external_title", "target_law"]
    loaded = external.join(articles.select(F.col("id").alias("target_article_id")), "target_article_id", "left_semi")
    repeals = laws.select("law", F.explode("repeals").alias("target")).join(laws.select(F.col("law").alias("target")), "target", "left_semi")
    lifted = F.regexp_extract("defined_in", r"^(.*?)(?:\.K\d+)?$", 1)
    nodes = [
        _nodes(external, "ExternalLaw", "dst", named, at), _nodes(acts, "ExternalLaw", "dst", named, zero),
        _nodes(defined, "LegalConcept", "concept_id", ["term", "defined_in"], zero, F.array("defined_in"), F.col("definition")),
    ]
    edges = [
        _edges(external, F.lit("CITES_EXTERNAL"), F.col("src"), F.col("dst"), at, [*outer, "target_law", "target_article_id"], "source_clause", span=True),
        _edges(loaded, F.lit("REFERS_TO"), F.col("src"), F.col("target_article_id"), at, [*outer, "target_law"], "source_clause", span=True),
        _edges(acts, F.col("action"), F.col("src"), F.col("dst"), F.col("char_offset_action"), [*outer, "span_action", "char_offset_action", "target_law"], "source_clause"),
        _edges(refs["internal"], F.lit("REFERENCES"), F.col("src"), F.col("dst"), at, ["kind", "is_self"], "source_clause", span=True),
        _edges(defined, F.lit("DEFINES"), lifted, F.col("concept_id"), zero, [], "defined_in", "span"),
        _edges(repeals, F.lit("REPEALS"), F.col("law"), F.col("target"), zero),
    ]
    return _union(nodes), _union(edges)


def merge_graph(nodes: DataFrame, edges: DataFrame) -> dict[str, DataFrame]:
    """One node a label and id, one edge a key, edges without lost ends, and how many of each type were lost."""
    merged = merge_nodes(nodes.withColumn("mentioned_in", F.array_compact("mentioned_in")), ["label", "id"], "ord", ["props"], ["definition"], ["mentioned_in"])
    extra = F.lit(None).cast("string")
    for kind, columns in EDGE_KEYS.items():
        if kind != "semantic":
            value = F.col("char_offset").cast("string") if columns == ["char_offset"] else F.col("props")[columns[0]]
            extra = F.when(F.col("type") == kind, value).otherwise(extra)
    extra = F.coalesce(extra, "source_text", F.lit(""))
    keyed = edges.withColumns({"_clause": F.coalesce("source_clause", F.lit("")), "_extra": extra})
    once = dedupe_edges(keyed, ["type", "src", "dst", "_clause", "_extra"], ["ord"]).drop("_clause", "_extra")
    known = merged.select("id").distinct()
    marked = once.join(known.select(F.col("id").alias("src"), F.lit(1).alias("_s")), "src", "left").join(known.select(F.col("id").alias("dst"), F.lit(1).alias("_d")), "dst", "left")
    whole = F.col("_s").isNotNull() & F.col("_d").isNotNull()
    return {
        "nodes": merged,
        "edges": marked.where(whole).select(*edges.columns),
        "dropped": marked.where(~whole).groupBy("type").agg(F.count(F.lit(1)).alias("dropped")),
    }


def graph_problems(nodes: DataFrame, edges: DataFrame, semantic: list[str], expected: dict[str, int] | None = None) -> DataFrame:
    """(rule, kind, item): semantic nodes without a mention, edges of unknown source clauses or between wrong labels, counts unlike ``expected``."""
    row = lambda df, rule, kind, item: df.select(F.lit(rule).alias("rule"), kind.alias("kind"), item.cast("string").alias("item"))
    out = row(nodes.where(F.col("label").isin(semantic) & (F.size("mentioned_in") <= 0)), "no mention", F.col("label"), F.col("id"))
    places = nodes.where(F.col("label").isin("Clause", "Point", "Article")).select(F.col("id").alias("source_clause"))
    out = out.unionByName(row(edges.where("source_clause is not null").join(places, "source_clause", "left_anti"), "unknown source clause", F.col("type"), F.col("source_clause")))
    typed = nodes.select("id", "label").distinct()
    for kind, (src, dst) in EDGE_ENDS.items():
        for end, label in (("src", src), ("dst", dst)):
            wrong = edges.where(F.col("type") == kind).join(typed.where(F.col("label") == label).select(F.col("id").alias(end)), end, "left_anti")
            out = out.unionByName(row(wrong, f"{end} of another label", F.col("type"), F.col(end)))
    for label, count in (expected or {}).items():
        n = nodes.where(F.col("label") == label).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") != count)
        out = out.unionByName(row(n, "count", F.lit(label), F.col("n")))
    return out


def filter_extractions(entities: DataFrame, edges: DataFrame, units: DataFrame) -> dict[str, DataFrame]:
    """Keeps of a model's statements what the texts bear out, with the reasons of the rest.

    ``entities`` is (article_id, kind, id, mentioned_in), ``edges`` (article_id, type, src, dst,
    source_clause, source_text), ``units`` (article_id, unit_id, text). An edge must quote its
    clause of that article, one of its texts if there are several; an entity keeps the mentions
    that lie in its article and needs one.
    """
    texts = units.groupBy("article_id", F.col("unit_id").alias("source_clause")).agg(F.collect_list("text").alias("_texts"))
    met = edges.join(texts, ["article_id", "source_clause"], "left")
    quoted = (F.coalesce("source_text", F.lit("")) != "") & F.exists("_texts", lambda t: F.contains(t, F.col("source_text")))
    judged = met.withColumn("reason", F.when(F.col("_texts").isNull(), "invalid_source").when(~quoted, "text_mismatch")).drop("_texts")
    each = entities.select("article_id", "kind", "id", F.posexplode_outer("mentioned_in").alias("_at", "unit_id"))
    inside = each.join(units.select("article_id", "unit_id").distinct().withColumn("_in", F.lit(1)), ["article_id", "unit_id"], "left")
    listed = F.transform(F.array_sort(F.collect_list(F.when(F.col("_in") == 1, F.struct("_at", "unit_id")))), lambda x: x["unit_id"])
    kept = inside.groupBy("article_id", "kind", "id").agg(listed.alias("mentioned_in"))
    return {
        "edges": judged.where("reason is null").drop("reason").select(*edges.columns),
        "entities": kept.where(F.size("mentioned_in") > 0),
        "dropped": judged.where("reason is not null").groupBy("reason").agg(F.count(F.lit(1)).alias("n")).unionByName(kept.where(F.size("mentioned_in") <= 0).agg(F.count(F.lit(1)).alias("n")).where("n > 0").select(F.lit("entity_outside_article").alias("reason"), "n")),
    }


def provenance_lift(mentions: list[DataFrame]) -> DataFrame:
    """(id, clauses, articles, laws) of nodes from several (id, clause) tables: all places that mention them, and what these lie in."""
    every = _union([m.select("id", "clause") for m in mentions]).where("clause is not null").distinct()
    p = ids.parse_id(F.col("clause"))
    rows = every.select("id", "clause", ids.article_id(p["law"], p["article"]).alias("article"), p["law"].alias("law"))
    sets = lambda c: F.array_sort(F.collect_set(c))
    return rows.groupBy("id").agg(sets("clause").alias("clauses"), sets("article").alias("articles"), sets("law").alias("laws"))
