"""Statutes from ordered paragraphs: a state machine over lines, run in blocks, and the parts it finds.

What a line is depends on all lines before it, but only through one of five states. A block of
lines therefore maps each state it may begin in to the one it ends in; these maps are made for all
blocks at once, followed from block to block of a document, and then each block is run again from
the state it really begins in. A document of any length spreads over tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import ids
from ..functions.text import roman
from ..sources.tables import stored

BLOCK_LINES = 2_000

# How headings and parts of a statute begin, and what its metadata look like.
CHAPTER, SECTION, ARTICLE = r"(?iu)^Chương\s+([IVXLCDM]+)\s*(.*)$", r"(?iu)^Mục\s+(\d+)\s*(.*)$", r"(?iu)^Điều\s+(\d+)\s*\.\s*(.*)$"
CLAUSE, POINT = r"^(\d+)\s*\.\s+(.+)$", r"(?iu)^([a-zđ])\)\s+(.+)$"
PASSED = r"(?iu)Luật\s+này\s+được\s+Quốc\s+hội.*thông\s+qua"
LAW_CODE = r"(?iu)(?:Luật|Bộ luật)\s+số:\s*(\d+/\d{4}/QH\d+)"
DATE = r"ngày\s+(\d{1,2})\s+tháng\s+(\d{1,2})\s+năm\s+(\d{4})"
SESSION = r"(?iu)khóa\s+([IVXLCDM]+),?\s+kỳ\s+họp\s+(?:thứ\s+)?(\d+)"
EFFECTIVE = r"(?iu)có\s+hiệu\s+lực\s+thi\s+hành\s+từ\s+ngày\s+(\d{1,2})\s+tháng\s+(\d{1,2})\s+năm\s+(\d{4})"

BEFORE, BODY, QUOTE, TITLE, AFTER = range(5)


def _next_state(state: Column, kind: Column, quotes: Column, synthetic: bool) -> Column:
    """The state after a line; ``quotes`` is the sign of opening less closing quotation marks."""
    inside = F.when(quotes < 0, BODY).otherwise(QUOTE)
    heading = F.when(kind.isin("chapter", "section"), TITLE).otherwise(BODY)
    begins = kind.isin("chapter", "section", "article") if synthetic else kind == "chapter"
    return (
        F.when((state == AFTER) | (kind == "passed"), AFTER)
        .when(state == BEFORE, F.when(begins, heading).otherwise(BEFORE))
        .when(state == QUOTE, inside)
        .when(kind.isin("chapter", "section", "article"), heading)
        .when(state == TITLE, TITLE)
        .when(quotes > 0, QUOTE)
        .otherwise(BODY)
    )


def label_lines(lines: DataFrame, synthetic: bool = False, block: int = BLOCK_LINES) -> DataFrame:
    """Adds ``role`` to lines (law, ord, text): preamble, chapter, section, article, clause, point, title, more or postamble.

    ``ord`` counts a law's lines from 0. Titles run on until the next heading. Within quotation
    marks that a clause opens, and nothing before the first chapter, counts as a heading; after the
    line of passing all is postamble. ``synthetic``: a law may begin with a section or article.
    """
    text = F.col("text")
    kind = (
        F.when(text.rlike(PASSED), "passed")
        .when(text.rlike(CHAPTER) & (roman(F.upper(F.regexp_extract(text, CHAPTER, 1))) > 0), "chapter")
        .when(text.rlike(SECTION), "section")
        .when(text.rlike(ARTICLE), "article")
        .otherwise("line")
    )
    count = lambda mark: F.length(text) - F.length(F.replace(text, F.lit(mark), F.lit("")))
    known = lines.withColumns({"_kind": kind, "_quotes": F.signum(count("“") - count("”")).cast("int"), "_block": F.floor(F.col("ord") / block).cast("int")})
    listed = F.array_sort(F.collect_list(F.struct("ord", "_kind", "_quotes")))
    blocks = known.groupBy("law", "_block").agg(listed.alias("_lines"))
    ends = F.array(*(F.aggregate("_lines", F.lit(s), lambda a, x: _next_state(a, x["_kind"], x["_quotes"], synthetic)) for s in range(5)))
    maps = blocks.select("law", "_block", ends.alias("_ends"))
    # a row for each block of a law: few, however long the law
    order = Window.partitionBy("law").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    begins = F.aggregate(F.coalesce(F.collect_list("_ends").over(order), F.array()), F.lit(BEFORE), lambda a, e: F.get(e, a))
    ran = blocks.join(maps.select("law", "_block", begins.alias("_state")), ["law", "_block"])
    step = lambda a, x: F.struct(_next_state(a["s"], x["_kind"], x["_quotes"], synthetic).alias("s"), F.concat(a["l"], F.array(a["s"])).alias("l"))
    states = F.aggregate("_lines", F.struct(F.col("_state").alias("s"), F.array().cast("array<int>").alias("l")), step, lambda a: a["l"])
    each = ran.withColumn("_states", states).select("law", F.explode(F.zip_with("_lines", "_states", lambda x, s: F.struct(x["ord"].alias("ord"), s.alias("_state")))).alias("_x")).select("law", "_x.ord", "_x._state")
    rows = known.join(each, ["law", "ord"])
    state, starts = F.col("_state"), (F.col("_kind").isin("chapter", "section", "article") if synthetic else F.col("_kind") == "chapter")
    role = (
        F.when((state == AFTER) | (F.col("_kind") == "passed"), "postamble")
        .when((state == BEFORE) & ~starts, "preamble")
        .when(state == QUOTE, "more")
        .when(F.col("_kind") != "line", F.col("_kind"))
        .when(state == TITLE, "title")
        .when(text.rlike(CLAUSE), "clause")
        .when(text.rlike(POINT), "point")
        .otherwise("more")
    )
    return rows.withColumn("role", role).drop("_kind", "_quotes", "_state", "_block")


def running_last(df: DataFrame, key: list[str], order: list[str], block: Column, values: dict[str, Column]) -> DataFrame:
    """Adds the last non-null of each of ``values`` so far, for each key in ``order``.

    ``block`` must not fall along the order: windows are of a key's block only, and what earlier
    blocks left is carried by a window over one row for each block.
    """
    rows = df.withColumn("_block", block).withColumns({f"_v_{n}": v for n, v in values.items()})
    place = F.struct(*order)
    left = rows.groupBy(*key, "_block").agg(*(F.max_by(f"_v_{n}", F.when(F.col(f"_v_{n}").isNotNull(), place)).alias(f"_e_{n}") for n in values))
    before = Window.partitionBy(*key).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    names = [*key, "_block"]
    carried = left.select(*(F.col(c).alias(f"_k_{i}") for i, c in enumerate(names)), *(F.last(f"_e_{n}", ignorenulls=True).over(before).alias(f"_c_{n}") for n in values))
    inside = Window.partitionBy(*key, "_block").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({f"_l_{n}": F.last(f"_v_{n}", ignorenulls=True).over(inside) for n in values})
    rows = rows.join(carried, [rows[c].eqNullSafe(carried[f"_k_{i}"]) for i, c in enumerate(names)])
    out = rows.withColumns({n: F.coalesce(f"_l_{n}", f"_c_{n}") for n in values})
    return out.drop("_block", *(f"_k_{i}" for i in range(len(names))), *(f"_{p}_{n}" for p in "vlc" for n in values))


def parse_statutes(lines: DataFrame, synthetic: bool = False, block: int = BLOCK_LINES) -> dict[str, DataFrame]:
    """Chapters, sections, articles, clauses, points and other lines of laws given as (law, ord, text).

    An article's ``lead_text`` is what stands before its first clause; lines that begin no part
    continue the one before them. A ``synthetic`` chapter I holds what stands before any chapter.
    """
    text, role = F.col("text"), F.col("role")
    group = lambda pattern, i: F.regexp_extract(text, pattern, i)
    rows = label_lines(lines.select("law", "ord", F.trim("text").alias("text")).where("text <> ''"), synthetic, block)
    number = lambda of, pattern: F.when(role == of, group(pattern, 1).cast("int"))
    state = {
        "chapter": F.when(role == "chapter", roman(F.upper(group(CHAPTER, 1))).cast("int")),
        "roman": F.when(role == "chapter", F.upper(group(CHAPTER, 1))),
        "_section": F.when(role == "section", group(SECTION, 1)).when(role == "chapter", ""),
        "article": number("article", ARTICLE),
        "_clause": F.when(role == "clause", group(CLAUSE, 1)).when(role.isin("article", "section", "chapter"), ""),
    }
    rows = running_last(rows, ["law"], ["ord"], F.floor(F.col("ord") / block), state)
    # a point needs a clause; without one the line goes on with what stands before it
    rows = rows.withColumn("role", F.when((role == "point") & (F.coalesce("_clause", F.lit("")) == ""), "more").otherwise(role))
    rows = running_last(rows, ["law"], ["ord"], F.floor(F.col("ord") / block), {"_part": F.when(F.col("role").isin("chapter", "section", "article", "clause", "point"), F.col("ord"))})
    first = F.coalesce("chapter", F.lit(1) if synthetic else F.lit(None).cast("int"))
    rows = rows.withColumns({"chapter": first, "section": F.nullif("_section", F.lit("")).cast("int"), "clause": F.nullif("_clause", F.lit("")).cast("int")})
    rows = stored(rows, "lines")
    body = rows.where(F.col("role").isin("chapter", "section", "article", "clause", "point", "title", "more"))
    own = F.when(F.col("role") == "chapter", group(CHAPTER, 2)).when(F.col("role") == "section", group(SECTION, 2)).when(F.col("role") == "article", group(ARTICLE, 2)).when(F.col("role") == "clause", group(CLAUSE, 2)).when(F.col("role") == "point", group(POINT, 2)).otherwise(text)
    body = body.withColumn("own", F.trim(own))
    line = F.struct("ord", "own")
    listed = lambda keep: F.transform(F.filter(F.array_sort(F.collect_list(F.when(keep, line))), lambda x: x["own"] != ""), lambda x: x["own"])
    heads, is_article = F.col("role").isin("chapter", "section", "title"), F.col("role") == "article"
    parts = body.withColumn("letter", F.when(F.col("role") == "point", F.lower(group(POINT, 1)))).groupBy("law", F.col("_part").alias("ord")).agg(
        *(F.min_by(c, "ord").alias(c) for c in ("role", "chapter", "roman", "section", "article", "clause", "letter", "own")),
        F.array_join(listed(heads), " ").alias("heading"),
        F.array_join(listed(~heads & ~is_article), "\n").alias("text"),
    ).withColumnRenamed("own", "title")
    parts = stored(parts, "parts")
    law, kind = F.col("law"), lambda k: parts.where(F.col("role") == k)
    chapters = kind("chapter").select(ids.chapter_id(law, F.col("chapter")).alias("id"), "law", "ord", F.col("chapter").alias("number"), "roman", F.col("heading").alias("title"))
    articles = kind("article").select(
        ids.article_id(law, F.col("article")).alias("id"), "law", "ord", F.col("article").alias("number"), "title", F.col("text").alias("lead_text"), ids.chapter_id(law, F.col("chapter")).alias("chapter_id"),
        F.when(F.col("section").isNotNull(), ids.section_id(law, F.col("chapter"), F.col("section"))).alias("section_id"),
    )
    if synthetic:
        made = articles.select("law", "chapter_id").distinct().join(chapters.select(F.col("id").alias("chapter_id")), "chapter_id", "left_anti")
        chapters = chapters.unionByName(made.select(F.col("chapter_id").alias("id"), "law", F.lit(-1).cast(chapters.schema["ord"].dataType).alias("ord"), F.lit(1).alias("number"), F.lit("I").alias("roman"), F.lit("").alias("title")))
    return {
        "chapters": chapters,
        "sections": kind("section").select(ids.section_id(law, F.col("chapter"), F.col("section")).alias("id"), "law", "ord", F.col("section").alias("number"), F.col("heading").alias("title"), ids.chapter_id(law, F.col("chapter")).alias("chapter_id")),
        "articles": articles,
        "clauses": kind("clause").select(ids.clause_id(law, F.col("article"), F.col("clause")).alias("id"), "law", "ord", F.col("clause").alias("number"), ids.article_id(law, F.col("article")).alias("article_id"), "text"),
        "points": kind("point").select(ids.point_id(law, F.col("article"), F.col("clause"), F.col("letter")).alias("id"), "law", "ord", "letter", ids.clause_id(law, F.col("article"), F.col("clause")).alias("clause_id"), "text"),
        "others": rows.where(F.col("role").isin("preamble", "postamble")).select("law", "ord", "role", "text"),
    }


def full_texts(parts: dict[str, DataFrame]) -> tuple[DataFrame, DataFrame]:
    """(articles, clauses) with ``full_text``: a clause with its points, an article with its heading, lead text and clauses, in order."""
    lines = lambda *cols: F.transform(F.array_sort(F.collect_list(F.struct(*cols))), lambda x: x["line"])
    points = parts["points"].withColumn("line", F.concat("letter", F.lit(") "), "text")).groupBy(F.col("clause_id").alias("id")).agg(lines("ord", "line").alias("_points"))
    head = F.concat(F.col("number").cast("string"), F.lit(". "), "text")
    clauses = parts["clauses"].join(points, "id", "left").withColumn("full_text", F.array_join(F.concat(F.array(head), F.coalesce("_points", F.array())), "\n")).drop("_points")
    inside = clauses.withColumn("line", F.col("full_text")).groupBy(F.col("article_id").alias("id")).agg(lines("ord", "line").alias("_clauses"))
    title = F.rtrim(F.concat(F.lit("Điều "), F.col("number").cast("string"), F.lit(". "), "title"))
    lead = F.when(F.col("lead_text") != "", F.array("lead_text")).otherwise(F.array().cast("array<string>"))
    articles = parts["articles"].join(inside, "id", "left")
    return articles.withColumn("full_text", F.array_join(F.concat(F.array(title), lead, F.coalesce("_clauses", F.array())), "\n")).drop("_clauses"), clauses


def text_units(parts: dict[str, DataFrame]) -> DataFrame:
    """(unit_id, source_clause, law, article, text): lead texts under their article, clauses, and points under their clause."""
    article = ids.parse_id(F.col("unit_id"))["article"].alias("article")
    made = lambda df, source, text="text": df.select(F.col("id").alias("unit_id"), F.col(source).alias("source_clause"), "law", F.col(text).alias("text"))
    units = made(parts["articles"].where("lead_text <> ''"), "id", "lead_text").unionByName(made(parts["clauses"], "id")).unionByName(made(parts["points"], "clause_id"))
    return units.select("unit_id", "source_clause", "law", article, "text")


def _dated(text: Column, pattern: str) -> Column:
    part = lambda i, n: F.lpad(F.regexp_extract(text, pattern, i), n, "0")
    return F.when(text.rlike(pattern), F.concat_ws("-", part(3, 4), part(2, 2), part(1, 2)))


def source_metadata(others: DataFrame, articles: DataFrame, tables: DataFrame | None = None) -> DataFrame:
    """(law, issued_date, session, effective_date, and issuer and full_id of ``tables`` (law, text)) as the texts name them; null where they don't.

    Each is looked for within a line or an article, the first in order counts.
    """
    found = lambda df, order, cols: df.groupBy("law").agg(*(F.min_by(n, F.when(F.col(n).isNotNull(), F.col(order))).alias(n) for n in cols))
    text = F.col("text")
    session = F.when(text.rlike(SESSION), F.concat(F.lit("Khóa "), F.upper(F.regexp_extract(text, SESSION, 1)), F.lit(", kỳ họp thứ "), F.regexp_extract(text, SESSION, 2)))
    after = found(others.where("role = 'postamble'").withColumns({"issued_date": _dated(text, DATE), "session": session}), "ord", ["issued_date", "session"])
    within = found(articles.withColumn("effective_date", _dated(F.col("full_text"), EFFECTIVE)), "ord", ["effective_date"])
    out = after.join(within, "law", "full_outer")
    if tables is not None:
        cells = tables.withColumns({"issuer": F.when(F.contains(F.upper("text"), F.lit("QUỐC HỘI")), "Quốc hội"), "full_id": F.nullif(F.regexp_extract("text", LAW_CODE, 1), F.lit("")), "ord": F.lit(0)})
        out = out.join(cells.groupBy("law").agg(F.max("issuer").alias("issuer"), F.max("full_id").alias("full_id")), "law", "full_outer")
    return out


def structural_problems(parts: dict[str, DataFrame], expected: DataFrame | None = None) -> DataFrame:
    """(law, rule, item): identifiers that repeat, empty texts and titles, gaps in the articles' numbers, counts unlike ``expected`` (law, part, count)."""
    rule = lambda df, name, item: df.select("law", F.lit(name).alias("rule"), item.cast("string").alias("item"))
    out = None
    for name in ("chapters", "sections", "articles", "clauses", "points"):
        again = rule(parts[name].groupBy("law", "id").count().where("count > 1"), f"repeated {name}", F.col("id"))
        out = again if out is None else out.unionByName(again)
    for name, column in (("articles", "title"), ("clauses", "text"), ("points", "text")):
        out = out.unionByName(rule(parts[name].where(F.trim(column) == ""), f"empty {column} of {name}", F.col("id")))
    numbers = parts["articles"].select("law", "number").distinct()
    next_one = numbers.select("law", (F.col("number") - 1).alias("number"))
    # every number but 1 has the one before it, so that no law is ordered as a whole
    lone = next_one.where("number > 0").join(numbers, ["law", "number"], "left_anti")
    out = out.unionByName(rule(lone, "missing article", F.col("number")))
    if expected is not None:
        counts = None
        for name in ("chapters", "sections", "articles"):
            c = parts[name].groupBy("law").agg(F.count(F.lit(1)).alias("n")).withColumn("part", F.lit(name))
            counts = c if counts is None else counts.unionByName(c)
        off = expected.join(counts, ["law", "part"], "left").where(F.coalesce("n", F.lit(0)) != F.col("count"))
        out = out.unionByName(rule(off, "count", F.concat_ws(" ", "part", F.coalesce("n", F.lit(0)))))
    return out
