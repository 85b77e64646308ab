"""References from legal clauses to other clauses and laws, found by patterns in an order of priority.

Units are rows (unit_id, source_clause, law, article, text). All passes over a text work on arrays
within its row, so that extraction moves no rows; references are exploded at the end.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import ids
from ..functions.spans import apart_from, pattern_spans, places
from ..functions.text import fold_text

# How clauses name laws and their parts.
CODE = r"\d+/\d{4}/(?:QH\d+|NĐ-CP|NQ-CP|TT-[A-Z]+|CP|TTg)"
KIND = r"Luật|Bộ\s+luật|Nghị\s+định|Nghị\s+quyết"
NAME = r"[\wÀ-ỹĐđ][\wÀ-ỹĐđ,\s]{0,80}?"
CODES = r"Bộ\s+luật\s+(?:Lao\s+động|Dân\s+sự|Hình\s+sự|Tố\s+tụng\s+[A-Za-zÀ-ỹ\s]+?)"
PART = r"(?:(?:điểm\s+([a-zđ])(?:\s*(?:,\s*|\s+và\s+)\s*điểm\s+[a-zđ])*\s+)?khoản\s+(\d+)\s+)?Điều\s+(\d+)\s+của\s+"
SEVERAL, ALSO = r"(?:các\s+|những\s+)?", r"(?:\s*,\s*|\s+và\s+)"
OWN = r"(?:\s+(?:của\s+)?Luật\s+này)?(?!\s+của\s+(?:Luật|Bộ\s+luật|Nghị))"
EXTERNAL = {
    "article_of_coded": (rf"(?U){PART}({KIND})(?:\s+{NAME})?\s+số\s+({CODE})", {"point": 1, "clause": 2, "article": 3, "kind": 4, "code": 5}),
    "article_of_named": (rf"(?U){PART}({CODES})(?=[\s,;.])", {"point": 1, "clause": 2, "article": 3, "kind": 4}),
    "coded": (rf"(?U)({KIND})(?:\s+({NAME}))?\s+số\s+({CODE})", {"kind": 1, "name": 2, "code": 3}),
    "named": (rf"(?U)({CODES})(?=\b|[,;.])", {"kind": 1}),
}
POINT = (rf"(?U){SEVERAL}điểm\s+[a-zđ](?:{ALSO}(?:điểm\s+)?[a-zđ])*\s+khoản\s+(\d+)\s+Điều\s+(\d+){OWN}", {"clause": 1, "article": 2})
CLAUSE = (rf"(?U){SEVERAL}khoản\s+\d+(?:{ALSO}(?:khoản\s+)?\d+)*\s+Điều\s+(\d+){OWN}", {"article": 1})
ARTICLE = (rf"(?U){SEVERAL}Điều\s+\d+(?:{ALSO}Điều\s+\d+)*{OWN}", {})
#: Words that every match of a pattern holds.
NEEDS = {
    "article_of_coded": ("Điều", "của", "số"),
    "article_of_named": ("Điều", "của", "luật"),
    "coded": ("số",),
    "named": ("Bộ", "luật"),
    "points": ("điểm", "khoản", "Điều"),
    "clauses": ("khoản", "Điều"),
    "articles": ("Điều",),
    "own_article": ("Điều", "này"),
    "own_clause": ("khoản", "này"),
}
SELF_ARTICLE, SELF_CLAUSE = r"(?U)Điều\s+này", r"(?U)khoản\s+này"
AMEND, REPEAL, ENDS = r"(?U)Sửa\s+đổi(?:,\s*bổ\s+sung)?", r"(?U)Bãi\s+bỏ", "hết hiệu lực"
DEFINITION, TERM, DEFINING = r"(?Us)^(.+?)\s+là\s+(.+)$", 120, 3

NONE = "cast(array() as array<struct<start:int,end:int>>)"


def _null(kind: str = "string") -> Column:
    return F.lit(None).cast(kind)


def _external_row(name: str, groups: dict[str, int]) -> Callable[[Column], Column]:
    def row(s: Column) -> Column:
        code = s["code"] if "code" in groups else _null()
        title = F.trim(s["kind"])
        if name == "coded":
            title = F.concat_ws(" ", title, F.trim(s["name"]))
        part = {p: s[p] if p in groups else _null() for p in ("article", "clause", "point")}
        return F.struct(
            F.coalesce(ids.external_law_id(code), F.concat(F.lit("ext:"), title)).alias("dst"),
            code.alias("external_code"),
            title.alias("external_title"),
            part["article"].cast("int").alias("external_article"),
            part["clause"].cast("int").alias("external_clause"),
            part["point"].alias("external_point"),
            s["span"].alias("span"),
            s["start"].alias("char_offset"),
        )

    return row


def _without_external(units: DataFrame) -> DataFrame:
    """Adds ``_taken``, the places that external references take, without reading their parts."""
    rows = units.withColumn("_taken", F.expr(NONE))
    for name, (pattern, _) in EXTERNAL.items():
        free = apart_from(pattern_spans(F.col("text"), pattern, needs=NEEDS[name]), F.col("_taken"))
        rows = rows.withColumn("_taken", F.concat("_taken", places(free)))
    return rows


def _with_external(units: DataFrame) -> DataFrame:
    """Adds ``_refs``, the external references by priority, and ``_taken``, the places they take."""
    rows, lists = units.withColumn("_taken", F.expr(NONE)), []
    for name, (pattern, groups) in EXTERNAL.items():
        kept = f"_{name}"
        rows = rows.withColumn(kept, apart_from(pattern_spans(F.col("text"), pattern, groups, NEEDS[name]), F.col("_taken"))).withColumn("_taken", F.concat("_taken", places(F.col(kept))))
        lists.append(F.transform(kept, _external_row(name, groups)))
    return rows.withColumn("_refs", F.concat(*lists)).drop(*(f"_{name}" for name in EXTERNAL))


def external_references(units: DataFrame) -> DataFrame:
    """One row for each reference to another law: src, source_clause, dst, its code, title, article, clause, point, span, char_offset."""
    rows = _with_external(units).select(F.col("unit_id").alias("src"), "source_clause", "law", F.explode("_refs").alias("r"))
    return rows.select("src", "source_clause", "law", "r.*")


def _listed(spans: Column, inner: str, dst, kind: str, head: str = "(?s)^(.*)$", bounded: bool = False) -> Column:  # noqa: ANN001
    """A reference for each place that ``inner`` finds in the ``head`` of each span."""
    each = lambda s: F.transform(F.filter(F.regexp_extract_all(F.regexp_extract(s["span"], head, 1), F.lit(inner), F.lit(1)), lambda x: F.lit(not bounded) | x.try_cast("int").isNotNull()), lambda x: _internal(dst(s, x), kind, s, bound=x.cast("int") if bounded else _null("int")))
    return F.flatten(F.transform(spans, each))


def _internal(dst: Column, kind: str, s: Column, is_self: bool = False, bound: Column | None = None) -> Column:
    return F.struct(dst.alias("dst"), F.lit(kind).alias("kind"), s["span"].alias("span"), s["start"].alias("char_offset"), F.lit(is_self).alias("is_self"), (_null("int") if bound is None else bound).alias("bound"))


def internal_references(units: DataFrame, laws: DataFrame, expand_lists: bool = False) -> DataFrame:
    """References within a law: src, source_clause, law, dst, kind, span, char_offset, is_self.

    ``laws`` is (law, max_article); a single article beyond that is no reference, for it must be
    another law's. Of a list like ``khoản 1, 2 Điều 5`` only what repeats the keyword counts, unless
    ``expand_lists``. Places that external references take are left alone, as are articles that
    amend other laws (leave their units out with ``without_amending``).
    """
    rows, law = _without_external(units), F.col("law")
    for name, pattern in (("points", POINT), ("clauses", CLAUSE), ("articles", ARTICLE), ("own_article", (SELF_ARTICLE,)), ("own_clause", (SELF_CLAUSE,))):
        rows = rows.withColumn(f"_{name}", apart_from(pattern_spans(F.col("text"), *pattern, needs=NEEDS[name]), F.col("_taken"))).withColumn("_taken", F.concat("_taken", places(F.col(f"_{name}"))))
    points, clauses, articles, own_article, own_clause = (F.col(f"_{n}") for n in ("points", "clauses", "articles", "own_article", "own_clause"))
    letter, number = r"(?U)điểm\s+([a-zđ])", r"(?U)khoản\s+(\d+)"
    if expand_lists:
        letter, number = r"(?U)\b([a-zđ])\b", r"(\d+)"
    numbered = lambda a: ids.article_id(law, a.cast("int"))
    under = lambda a, k: ids.clause_id(law, a.cast("int"), k.cast("int"))
    refs = F.concat(
        _listed(points, letter, lambda s, x: F.concat(under(s["article"], s["clause"]), F.lit("."), F.lower(x)), "REFERENCES_POINT", r"(?Us)^(.*?)\s+khoản"),
        _listed(clauses, number, lambda s, x: under(s["article"], x), "REFERENCES_CLAUSE", r"(?Us)^(.*?)\s+Điều"),
        _listed(articles, r"(?U)Điều\s+(\d+)", lambda s, x: numbered(x), "REFERENCES_ARTICLE", bounded=True),
        F.transform(own_article, lambda s: _internal(ids.article_id(law, F.col("article")), "REFERENCES_ARTICLE", s, True)),
        F.transform(own_clause, lambda s: _internal(F.col("source_clause"), "REFERENCES_CLAUSE", s, True)),
    )
    # laws are met last, so that their join deals out references and not the work on texts
    rows = rows.select(F.col("unit_id").alias("src"), "source_clause", "law", F.explode(refs).alias("r")).join(laws, "law")
    return rows.where("r.bound is null or r.bound between 1 and max_article").select("src", "source_clause", "law", "r.*").drop("bound")


def definitions(clauses: DataFrame) -> DataFrame:
    """(concept_id, term, definition, defined_in, span) of clauses (id, article, text) ``X là Y`` in the article of definitions."""
    found = clauses.where((F.col("article") == DEFINING) & F.col("text").rlike(DEFINITION))
    part = lambda i: F.trim(F.regexp_extract("text", DEFINITION, i))
    rows = found.select(part(1).alias("term"), part(2).alias("definition"), F.col("id").alias("defined_in"), F.col("text").alias("span"))
    rows = rows.where((F.length("term") <= TERM) & ~F.contains("term", F.lit(".")))
    return rows.select(ids.semantic_id("concept", F.col("term")).alias("concept_id"), "term", "definition", "defined_in", "span")


def amendments(clauses: DataFrame, external: DataFrame) -> DataFrame:
    """External references of clauses (id, text) that amend, repeal or end another law, with the action and its words."""
    text = F.col("text")
    amends, repeals = text.rlike(AMEND), text.rlike(REPEAL)
    action = F.when(amends, "AMENDS").when(repeals, "REPEALS").when(F.contains(F.lower(text), F.lit(ENDS)), "REPLACES")
    words = F.when(amends, F.regexp_extract(text, AMEND, 0)).when(repeals, F.regexp_extract(text, REPEAL, 0)).otherwise("REPLACES")
    offset = F.when(amends | repeals, F.instr(text, words) - 1).otherwise(0)
    acting = clauses.select(F.col("id").alias("source_clause"), action.alias("action"), words.alias("span_action"), offset.alias("char_offset_action")).where("action is not null")
    return acting.join(external.drop("src"), "source_clause").withColumn("src", F.col("source_clause"))


def amending_articles(articles: DataFrame, clauses: DataFrame) -> DataFrame:
    """Articles (article_id) that amend other laws: those that amend anything, or add to or repeal a law, in title or clauses."""
    words = lambda x: [F.contains(F.lower(x), F.lit(w)) for w in ("sửa đổi", "bổ sung", "bãi bỏ", "luật")]
    names = ("amends", "adds", "repeals", "law")
    told = articles.select(F.col("id").alias("article_id"), *(w.alias(n) for n, w in zip(names, words(F.col("title")))))
    told = told.unionByName(clauses.select("article_id", *(w.alias(n) for n, w in zip(names, words(F.col("text"))))))
    every = told.groupBy("article_id").agg(*(F.bool_or(n).alias(n) for n in names))
    return every.where("amends or (adds and law) or (repeals and law)").select("article_id")


def without_amending(units: DataFrame, amending: DataFrame) -> DataFrame:
    return units.withColumn("article_id", ids.article_id(F.col("law"), F.col("article"))).join(amending, "article_id", "left_anti").drop("article_id")


def resolve_targets(external: DataFrame, aliases: DataFrame, labour_code: str | None = None) -> DataFrame:
    """Adds target_law, target_article_id and is_loaded_cross_law.

    ``aliases`` is (alias, target), alias folded, one row an alias. The code is looked up first, then its number and year
    as a canonical id, then the title, the same way; ``labour_code`` is the law meant by a title that names the labour code.
    """
    known = F.broadcast(aliases) if aliases.count() <= 10_000 else aliases
    canonical = F.when(F.col("external_code").rlike(r"^\d+/\d{4}/"), F.concat(F.lit("L"), F.regexp_extract("external_code", r"^(\d+)/", 1), F.lit("_"), F.regexp_extract("external_code", r"^\d+/(\d{4})/", 1)))
    rows = external
    for name, key in (("_c", fold_text(F.col("external_code"))), ("_n", fold_text(canonical)), ("_t", fold_text(F.col("external_title")))):
        side = known.select(F.col("alias").alias(f"{name}k"), F.col("target").alias(name))
        rows = rows.withColumn(f"{name}q", F.nullif(key, F.lit(""))).join(side, F.col(f"{name}q") == F.col(f"{name}k"), "left").drop(f"{name}q", f"{name}k")
    named = F.when(F.contains(fold_text(F.col("external_title")), F.lit("bo luat lao dong")), F.lit(labour_code))
    rows = rows.withColumn("target_law", F.coalesce("_c", "_n", "_t", named)).drop("_c", "_n", "_t")
    return rows.withColumns({"target_article_id": ids.article_id(F.col("target_law"), F.col("external_article")), "is_loaded_cross_law": F.coalesce(F.col("target_law") != F.col("law"), F.lit(False))})


def extract_references(units: DataFrame, articles: DataFrame, clauses: DataFrame, aliases: DataFrame, labour_code: str | None = None) -> dict[str, DataFrame]:
    """All of the above: external, internal, definitions and amendments of a parsed corpus."""
    laws = articles.groupBy("law").agg(F.max("number").alias("max_article"))
    external = resolve_targets(external_references(units), aliases, labour_code)
    kept = without_amending(units, amending_articles(articles, clauses))
    numbered = clauses.withColumn("article", ids.parse_id(F.col("id"))["article"])
    return {"external": external, "internal": internal_references(kept, laws), "definitions": definitions(numbered), "amendments": amendments(clauses, external)}
