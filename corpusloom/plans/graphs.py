"""Graph, extraction, document and check queries over the shared tables."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import ids as I
from ..functions import text as T
from ..operators import documents as D
from ..operators import extract as E
from ..operators import graph as G
from ..operators.dense import dense_pairs
from ..operators.parsing import running_last
from ..sources.tables import table

CORPUS = ["src0", "src1", "src2"]


def hydrate_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """region, nation, customer, order, line: the chain of containers of each matched line."""
    t = lambda n: table(spark, sf_dir, n)
    hits = t("lineitem").where("l_quantity >= 49").select("l_orderkey", "l_linenumber")
    chain = hits.join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(t("customer"), F.col("o_custkey") == F.col("c_custkey"))
    chain = chain.join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return chain.select("l_orderkey", "l_linenumber", "c_name", "n_name", "r_name")


def optional_collect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every customer with the list of its orders of one priority, if any."""
    orders = table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'").select("o_custkey", "o_orderkey")
    rows = table(spark, sf_dir, "customer").join(orders, F.col("c_custkey") == F.col("o_custkey"), "left")
    listed = F.array_join(F.transform(F.array_sort(F.collect_list("o_orderkey")), lambda x: x.cast("string")), ",")
    return rows.groupBy("c_custkey").agg(F.count("o_orderkey").alias("n"), listed.alias("orders"))


def verify_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each cited order exists."""
    cited = table(spark, sf_dir, "customer").select((F.col("c_custkey") * 7).alias("cited"))
    known = table(spark, sf_dir, "orders").select("o_orderkey").distinct()
    return cited.join(known, F.col("cited") == F.col("o_orderkey"), "left").select("cited", F.col("o_orderkey").isNotNull().alias("found"))


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part to supplier, as one set of nodes: suppliers are negative."""
    return table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("src"), (-1 - F.col("l_suppkey")).alias("dst")).distinct()


EDGES = "e AS (SELECT DISTINCT l_partkey AS src, -1 - l_suppkey AS dst FROM lineitem)"


def semantic_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of the given orders whose flag is of the wanted kinds."""
    seeds = table(spark, sf_dir, "orders").where("o_orderpriority = '2-HIGH'").select(F.col("o_orderkey").alias("l_orderkey"))
    rows = table(spark, sf_dir, "lineitem").where(F.col("l_returnflag").isin("A", "R"))
    return rows.join(seeds, "l_orderkey", "left_semi").groupBy("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("l_partkey")).alias("parts"))


def orphan_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges kept and dropped when some parts and suppliers are missing."""
    edges = _edges(spark, sf_dir)
    nodes = table(spark, sf_dir, "part").where("p_size % 5 <> 0").select(F.col("p_partkey").alias("id")).union(table(spark, sf_dir, "supplier").where("s_suppkey % 3 <> 0").select(-1 - F.col("s_suppkey")))
    kept = G.without_orphans(edges, nodes)
    return edges.agg(F.count(F.lit(1)).alias("total")).join(kept.agg(F.count(F.lit(1)).alias("kept"), F.sum("src").alias("src_sum")))


def uncovered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts that no edge names."""
    return table(spark, sf_dir, "part").join(_edges(spark, sf_dir).select(F.col("src").alias("p_partkey")), "p_partkey", "left_anti").select("p_partkey")


def multi_hop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the parts whose key is divisible by 100, as in all searches, reach over all edges."""
    seeds = table(spark, sf_dir, "part").where("p_partkey % 100 = 0").select(F.col("p_partkey").alias("seed"))
    edges = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("src"), (-1 - F.col("l_suppkey")).alias("dst"))
    return G.reach_counts(seeds, edges, 3, undirected=True)


def same_parent_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of lines passed to their siblings in the order at a quarter."""
    rows = table(spark, sf_dir, "lineitem").where("l_quantity >= 30").select("l_orderkey", "l_linenumber", (F.col("l_quantity") / 50).alias("score"))
    other = rows.select("l_orderkey", F.col("l_linenumber").alias("o"), F.col("score").alias("given"))
    near = rows.join(other, "l_orderkey").where("l_linenumber <> o").groupBy("l_orderkey", "l_linenumber").agg(F.sum("given").alias("g"))
    return rows.join(near, ["l_orderkey", "l_linenumber"], "left").groupBy("l_orderkey", "l_linenumber").agg(F.round(F.max(F.col("score") + 0.25 * F.coalesce("g", F.lit(0.0))), 6).alias("score"))


def proximity_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every order, up to 8 others of the customer, those of the same priority first.

    The 8 are among the customer's first 9 of each priority (one may be the order itself), so only
    those are paired with it.
    """
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    seed = o.select(F.col("o_orderkey").alias("seed"), "o_custkey", F.col("o_orderpriority").alias("p"))
    nth = F.row_number().over(Window.partitionBy("o_custkey", "o_orderpriority").orderBy("o_orderkey"))
    pairs = seed.join(o.withColumn("nth", nth).where("nth <= 9"), "o_custkey").where("seed <> o_orderkey").withColumn("tier", F.when(F.col("p") == F.col("o_orderpriority"), 1).otherwise(2))
    w = Window.partitionBy("seed").orderBy("tier", "o_orderkey")
    return pairs.withColumn("place", F.row_number().over(w)).where("place <= 8").select("seed", "o_orderkey", "tier", "place")


def first_child(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.min_by("l_partkey", F.struct("l_linenumber", "l_partkey")).alias("first_part"))


def degree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.degrees(_edges(spark, sf_dir))


def reachability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many orders and lines each region reaches, and customers without any."""
    t = lambda n: table(spark, sf_dir, n)
    chain = t("region").join(t("nation"), F.col("r_regionkey") == F.col("n_regionkey")).join(t("customer"), F.col("n_nationkey") == F.col("c_nationkey")).join(t("orders"), F.col("c_custkey") == F.col("o_custkey"), "left")
    return chain.groupBy("r_name").agg(F.countDistinct("c_custkey").alias("customers"), F.countDistinct("o_orderkey").alias("orders"), F.count_if(F.col("o_orderkey").isNull()).alias("without"))


def merge_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of a user as one node: first type, longest properties, ordered union of types."""
    rows = table(spark, sf_dir, "events").withColumn("types", F.array("event_type"))
    merged = G.merge_nodes(rows, ["user_id"], "event_id", ["event_type"], ["props"], ["types"])
    return merged.select("user_id", "event_type", "props", F.array_join("types", ",").alias("types"))


def dedupe_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey", "l_returnflag", "l_orderkey", "l_linenumber")
    return G.dedupe_edges(rows, ["l_partkey", "l_suppkey", "l_returnflag"], ["l_orderkey", "l_linenumber"])


def upsert_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers updated by their orders: the last status wins, null totals don't overwrite."""
    target = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_mktsegment").alias("status"), F.col("c_acctbal").alias("amount"))
    delta = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), F.col("o_orderstatus").alias("status"), F.when(F.col("o_orderkey") % 2 == 0, F.col("o_totalprice")).alias("amount"), "o_orderkey")
    return G.upsert(target, delta, ["c_custkey"], "o_orderkey")


def next_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.next_edges(table(spark, sf_dir, "orders"), "o_custkey", ["o_orderdate", "o_orderkey"], "o_orderkey")


def contiguity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines whose number isn't their place once every seventh part is taken out."""
    return D.gaps(table(spark, sf_dir, "lineitem").where("l_partkey % 7 <> 0").select("l_orderkey", "l_linenumber").distinct(), "l_orderkey", "l_linenumber")


def running_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event with the user's last click before or at it."""
    click = F.when(F.col("event_type") == "click", F.col("event_id"))
    rows = running_last(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], F.to_date("ts"), {"last_click": click})
    return rows.select("event_id", "user_id", "last_click")


ALIASES = ["th", "the", "ther", "ent", "que", "der"]


def extract_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leftmost longest places of aliases in the benchmark items, without overlaps."""
    items = table(spark, sf_dir, "benchmark").select("item_id", F.lower("text").alias("text"))
    return E.alias_spans(items, ALIASES, "item_id", "text")


def alias_theta_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a whole benchmark passage."""
    return table(spark, sf_dir, "documents").select("doc_id", "text").join(table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("passage")), F.col("text").contains(F.col("passage"))).select("doc_id", "item_id")


STRINGS = "Người lao động; Điều 64 khoản 1/QĐ-BHXH; BẢO HIỂM XÃ HỘI"


def fold_slug(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts folded, after some words with marks, and the beginning of their slugs."""
    text = F.concat(F.lit(STRINGS), F.lit(" "), F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", T.fold(text).alias("folded"), T.slug(text, 80).alias("slug"), F.sha2(T.fold_text(text), 256).alias("kept_sha"))


def _line_id() -> Column:
    """Identifiers of orders and lines, some without a clause, a point or a law, some with a chapter or table, some in no known form."""
    order, line, flag = F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"), F.lower("l_returnflag")
    article = F.concat(F.lit("ORD_1.A"), order)
    return (
        F.when(F.col("l_linenumber") == 1, article)
        .when(F.col("l_linenumber") == 2, F.concat(article, F.lit(".K"), line, F.lit("."), flag))
        .when(F.col("l_linenumber") == 3, F.concat(article, F.lit(".T"), line))
        .when(F.col("l_linenumber") == 4, F.concat(F.lit("ORD_1.C"), order))
        .when(F.col("l_linenumber") == 5, F.concat(F.lit("1ORD.A"), order))
        .when(F.col("l_linenumber") == 6, F.concat(article, F.lit(".K2.đ")))
        .otherwise("ORD_1")
    )


def parse_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Identifiers built from orders and lines, and read back."""
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", _line_id().alias("id"))
    p = I.parse_id(F.col("id"))
    return rows.select("l_orderkey", "l_linenumber", "id", *(p[c].alias(c) for c in ("law", "chapter", "article", "clause", "point", "table")), I.citation_label(F.col("id")).alias("label"))


def date_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dates in texts made from orders; law codes don't count as years."""
    day = F.when(F.col("o_orderkey") % 3 == 0, F.date_format("o_orderdate", "d/M/yyyy")).when(F.col("o_orderkey") % 3 == 1, F.date_format("o_orderdate", "dd.MM.yyyy")).otherwise(F.date_format("o_orderdate", "d-M-yyyy"))
    law = F.when(F.col("o_orderkey") % 5 == 0, F.lit("Law 41/2024/QH15 of ")).otherwise("As of ")
    text = F.concat(law, day, F.when(F.col("o_orderkey") % 2 == 0, F.lit(" and 01/02/1993, not 31/02/2030")).otherwise(F.lit(" since 1949 or 2019")))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.date_format(T.event_date(text), "yyyy-MM-dd").alias("date"), F.date_format(T.event_date(text, "compat"), "yyyy-MM-dd").alias("compat"))


def threshold_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.lit("sau "), F.col("p_size"), F.lit(",5 Ngày hoặc "), F.col("p_partkey") % 100, F.lit("  tuổi, đủ 12 tháng, 50% từ 05/06/"), 1990 + F.col("p_size"), F.lit(", since 2001"))
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(T.thresholds(text), "|").alias("found"))


def _first_in_band(a: np.ndarray, b: np.ndarray, sim: np.ndarray, other: np.ndarray, la: np.ndarray, lb: np.ndarray, _: np.ndarray, order: np.ndarray) -> pd.DataFrame:
    at = np.argsort(order, kind="stable")
    fits = (other & (sim >= 0.30) & (sim <= 0.85))[:, at]
    same = (la[:, None] == lb[None, :])[:, at]
    out = []
    for rel in (True, False):
        mine = fits & (same == rel)
        q, c = np.nonzero(mine & (mine.cumsum(axis=1) <= 3))
        out.append(pd.DataFrame({"query_id": a[q], "vec_id": b[at[c]], "rel": rel, "sim": sim[q, at[c]], "draw": order[at[c]]}))
    return pd.concat(out)


def pair_mining(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of each vector and others in a similarity band: same label positive, other labels negative, 3 of each."""
    drawn = table(spark, sf_dir, "embeddings").withColumn("draw", F.sha2(F.concat(F.lit("42:"), F.col("vec_id").cast("string")), 256))
    rows = dense_pairs(drawn, _first_in_band, "query_id long, vec_id long, rel boolean, sim double, draw string", also=("label", "draw"))
    w = Window.partitionBy("query_id", "rel").orderBy("draw")
    return rows.withColumn("place", F.row_number().over(w)).where("place <= 3").select("query_id", "vec_id", "rel", "sim")


def stratified_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.stratified_split(table(spark, sf_dir, "documents").select("doc_id", "lang"), "lang", "doc_id", 0.75, 42)


def category_stratum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations by whether the sources that their turns stand for are in the corpus."""
    codes = F.collect_set(F.when(F.length("text") % 9 > 0, F.concat(F.lit("src"), (F.length("text") % 5).cast("string"))))
    rows = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(codes.alias("codes"))
    return rows.select(T.category(F.col("codes"), CORPUS).alias("category")).groupBy("category").agg(F.count(F.lit(1)).alias("n"))


def provenance_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans taken from texts, some with a wrong offset: how many don't hold."""
    rows = table(spark, sf_dir, "documents").select("lang", "text", F.substr(F.col("text"), F.lit(11), F.lit(15)).alias("span"), F.when(F.col("doc_id") % 4 == 0, 11).otherwise(10).alias("at"))
    return E.provenance_violations(rows, "text", "span", "at").groupBy("lang").agg(F.count(F.lit(1)).alias("violations"))


def constraint_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lambda n: table(spark, sf_dir, n)
    out = G.check_unique(t("documents"), ["doc_id"], "documents.doc_id unique")
    out = out.unionByName(G.check_unique(t("documents"), ["text"], "documents.text unique"))
    out = out.unionByName(G.check_not_null(t("documents"), "lang", "documents.lang not null"))
    out = out.unionByName(G.check_reference(t("labels"), "doc_id", t("documents").where("lang = 'en'"), "doc_id", "labels refer to English documents"))
    return out.unionByName(t("embeddings").agg(F.count_if(F.abs(F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))) - 1) > 1e-3).alias("violations")).select(F.lit("unit vectors").alias("rule"), "violations"))


def chunker(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = D.chunk(table(spark, sf_dir, "documents"), "doc_id", "text", 400)
    return rows.select("doc_id", F.col("chunk").cast("long").alias("chunk"), F.col("start").cast("long").alias("start"), F.sha2("body", 256).alias("body_sha"))


def answer_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.lit("Issue: x\nRule:  [A 1] "), F.col("text"), F.lit(" [B, C]  end\nNguồn: Điều 5\nCitations: none\n last"))
    return table(spark, sf_dir, "conversations").where("role = 'assistant'").select("conv_id", "turn", F.sha2(T.clean_answer(text), 256).alias("clean_sha"))


def context_render(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.concat_ws(" ", F.concat(F.lit("["), F.col("role"), F.lit("]")), T.clip(F.col("text"), 60))
    return D.render(table(spark, sf_dir, "conversations"), "conv_id", ["turn"], line, 400)


def validation_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return rows.groupBy("lang").agg(
        F.count(F.lit(1)).alias("n"), F.count("quality").alias("labelled"), F.count_if(F.col("quality") == 1).alias("good"), F.count_if(F.col("toxic") == 1).alias("toxic"), F.round(F.try_divide(F.count_if(F.col("quality") == 1), F.count("quality")), 4).alias("rate")
    )


def group_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("user_id").alias("users"), F.min("event_id").alias("first"))


def article_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lists and ranges of article numbers, one row a number."""
    text = F.concat(F.col("p_size"), F.lit("-"), F.col("p_size") + F.col("p_partkey") % 4, F.lit(", 99 va 7"))
    rows = table(spark, sf_dir, "part").select("p_partkey", text.alias("articles"))
    return E.expand_ranges(rows, "articles", "article").select("p_partkey", F.col("article").cast("int").alias("article"))


QUERIES = {f.__name__: f for f in (hydrate_chain, optional_collect, verify_ids, semantic_expand, orphan_filter, uncovered, multi_hop, same_parent_expand, proximity_candidates, first_child, degree, reachability, merge_nodes, dedupe_edges, upsert_edges, next_edges, contiguity, running_state, extract_spans, alias_theta_match, fold_slug, parse_id, date_detect, threshold_extract, pair_mining, stratified_split, category_stratum, provenance_check, constraint_violations, chunker, answer_clean, context_render, validation_summary, group_counts, article_ranges)}

_ASCII = f"lower(regexp_replace(strip_accents(replace(replace('{STRINGS} ' || text, 'đ', 'd'), 'Đ', 'D')), '[^\\x00-\\x7F]+', '', 'g'))"
_FOLD = f"trim(regexp_replace({_ASCII}, '[^a-z0-9]+', ' ', 'g'))"
_KEPT = f"trim(regexp_replace({_ASCII}, '[^a-z0-9/_-]+', ' ', 'g'))"

SQL = {
    "hydrate_chain": "SELECT l_orderkey, l_linenumber, c_name, n_name, r_name FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE l_quantity >= 49",
    "optional_collect": "SELECT c_custkey, count(o_orderkey) AS n, coalesce(string_agg(o_orderkey::VARCHAR, ',' ORDER BY o_orderkey), '') AS orders FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_orderpriority = '1-URGENT' GROUP BY 1",
    "verify_ids": "SELECT c_custkey * 7 AS cited, EXISTS (SELECT 1 FROM orders WHERE o_orderkey = c_custkey * 7) AS found FROM customer",
    "semantic_expand": "SELECT l_returnflag, l_linestatus, count(*) AS n, sum(l_partkey)::BIGINT AS parts FROM lineitem WHERE l_returnflag IN ('A', 'R') AND l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderpriority = '2-HIGH') GROUP BY ALL",
    "orphan_filter": f"WITH {EDGES}, k AS (SELECT * FROM e WHERE src IN (SELECT p_partkey FROM part WHERE p_size % 5 <> 0) AND -1 - dst IN (SELECT s_suppkey FROM supplier WHERE s_suppkey % 3 <> 0)) SELECT (SELECT count(*) FROM e) AS total, count(*) AS kept, sum(src)::BIGINT AS src_sum FROM k",
    "uncovered": f"WITH {EDGES} SELECT p_partkey FROM part WHERE p_partkey NOT IN (SELECT src FROM e)",
    "multi_hop": f"""WITH RECURSIVE {EDGES}, w AS (SELECT src, dst FROM e UNION SELECT dst, src FROM e),
x(seed, node, hop) AS (SELECT p_partkey, p_partkey, 0 FROM part WHERE p_partkey % 100 = 0 UNION SELECT seed, dst, hop + 1 FROM x JOIN w ON src = node WHERE hop < 3),
m AS (SELECT seed, node, min(hop) AS hop FROM x WHERE hop > 0 AND node <> seed GROUP BY ALL) SELECT seed, hop, count(*) AS nodes, sum(node)::BIGINT AS node_sum FROM m GROUP BY ALL""",
    "same_parent_expand": """WITH r AS (SELECT l_orderkey, l_linenumber, l_quantity / 50 AS score FROM lineitem WHERE l_quantity >= 30),
n AS (SELECT a.l_orderkey, a.l_linenumber, sum(b.score) AS g FROM r a JOIN r b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber <> b.l_linenumber GROUP BY ALL)
SELECT l_orderkey, l_linenumber, round(max(score + 0.25::DOUBLE * coalesce(g, 0)), 6) AS score FROM r LEFT JOIN n USING (l_orderkey, l_linenumber) GROUP BY ALL""",
    "proximity_candidates": """WITH p AS (SELECT a.o_orderkey AS seed, b.o_orderkey, CASE WHEN a.o_orderpriority = b.o_orderpriority THEN 1 ELSE 2 END AS tier FROM orders a JOIN orders b ON a.o_custkey = b.o_custkey AND a.o_orderkey <> b.o_orderkey)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY seed ORDER BY tier, o_orderkey) AS place FROM p) WHERE place <= 8""",
    "first_child": "SELECT l_orderkey, arg_min(l_partkey, (l_linenumber, l_partkey)) AS first_part FROM lineitem GROUP BY 1",
    "degree": f"WITH {EDGES}, n AS (SELECT src AS node FROM e UNION ALL SELECT dst FROM e WHERE src <> dst) SELECT node, count(*) AS degree FROM n GROUP BY 1",
    "reachability": "SELECT r_name, count(DISTINCT c_custkey) AS customers, count(DISTINCT o_orderkey) AS orders, count_if(o_orderkey IS NULL)::BIGINT AS without FROM region JOIN nation ON r_regionkey = n_regionkey JOIN customer ON n_nationkey = c_nationkey LEFT JOIN orders ON c_custkey = o_custkey GROUP BY 1",
    "merge_nodes": """WITH f AS (SELECT user_id, event_type, min(event_id) AS e FROM events GROUP BY ALL)
SELECT user_id, arg_min(event_type, event_id) AS event_type, arg_max(props, (length(props), -event_id)) AS props, (SELECT string_agg(event_type, ',' ORDER BY e) FROM f WHERE f.user_id = events.user_id) AS types FROM events GROUP BY user_id""",
    "dedupe_edges": "SELECT l_partkey, l_suppkey, l_returnflag, l_orderkey, l_linenumber FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey, l_suppkey, l_returnflag ORDER BY l_orderkey, l_linenumber) AS n FROM lineitem) WHERE n = 1",
    "upsert_edges": """WITH d AS (SELECT o_custkey, o_orderstatus, CASE WHEN o_orderkey % 2 = 0 THEN o_totalprice END AS a, o_orderkey FROM orders),
m AS (SELECT o_custkey, arg_max(o_orderstatus, o_orderkey) AS s, max_by(a, o_orderkey) FILTER (WHERE a IS NOT NULL) AS a FROM d GROUP BY 1)
SELECT coalesce(c_custkey, o_custkey) AS c_custkey, coalesce(s, c_mktsegment) AS status, coalesce(a, c_acctbal) AS amount FROM customer FULL JOIN m ON c_custkey = o_custkey""",
    "next_edges": "SELECT * FROM (SELECT o_custkey, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS src, o_orderkey AS dst FROM orders) WHERE src IS NOT NULL",
    "contiguity": "SELECT * FROM (SELECT l_orderkey, l_linenumber AS number, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS place FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem WHERE l_partkey % 7 <> 0)) WHERE number <> place",
    "running_state": "SELECT event_id, user_id, last_value(CASE WHEN event_type = 'click' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS last_click FROM events",
    "extract_spans": """WITH RECURSIVE b AS (SELECT item_id, lower(text) AS t FROM benchmark),
s(item_id, t, pos, start, alias) AS (SELECT item_id, t, 1, 0, NULL::VARCHAR FROM b UNION ALL
  SELECT item_id, t, CASE WHEN hit = '' THEN length(t) + 2 ELSE p + length(hit) END, p - 1, hit FROM (
    SELECT item_id, t, hit, pos + strpos(substr(t, pos), hit) - 1 AS p FROM (SELECT *, regexp_extract(substr(t, pos), 'ther|the|th|ent|que|der') AS hit FROM s WHERE pos <= length(t))))
SELECT item_id, alias, start, start + length(alias) AS "end" FROM s WHERE alias IS NOT NULL AND alias <> ''""",
    "alias_theta_match": "SELECT doc_id, item_id FROM documents d JOIN benchmark b ON contains(d.text, b.text)",
    "fold_slug": f"SELECT doc_id, {_FOLD} AS folded, substr(replace({_FOLD}, ' ', '-'), 1, 80) AS slug, sha256({_KEPT}) AS kept_sha FROM documents",
    "parse_id": """WITH r AS (SELECT l_orderkey, l_linenumber, l_orderkey::VARCHAR AS o, l_linenumber AS n, lower(l_returnflag) AS f FROM lineitem),
i AS (SELECT *, CASE n WHEN 1 THEN 'ORD_1.A' || o WHEN 2 THEN 'ORD_1.A' || o || '.K2.' || f WHEN 3 THEN 'ORD_1.A' || o || '.T3' WHEN 4 THEN 'ORD_1.C' || o WHEN 5 THEN '1ORD.A' || o WHEN 6 THEN 'ORD_1.A' || o || '.K2.đ' ELSE 'ORD_1' END AS id FROM r)
SELECT l_orderkey, l_linenumber, id, CASE WHEN n <> 5 THEN 'ORD_1' END AS law, CASE WHEN n = 4 THEN o::INT END AS chapter, CASE WHEN n IN (1, 2, 3, 6) THEN o::INT END AS article, CASE WHEN n IN (2, 6) THEN 2 END AS clause,
CASE n WHEN 2 THEN f WHEN 6 THEN 'đ' END AS point, CASE WHEN n = 3 THEN 3 END AS "table", CASE WHEN n IN (1, 3) THEN 'Điều ' || o WHEN n = 2 THEN 'Điều ' || o || ' khoản 2 điểm ' || f WHEN n = 6 THEN 'Điều ' || o || ' khoản 2 điểm đ' ELSE id END AS label FROM i""",
    "date_detect": """SELECT o_orderkey, strftime(CASE WHEN o_orderkey % 2 = 0 THEN greatest(o_orderdate::DATE, DATE '1993-02-01') ELSE o_orderdate::DATE END, '%Y-%m-%d') AS date,
strftime(greatest(make_date(year(o_orderdate), 12, 31), CASE WHEN o_orderkey % 5 = 0 THEN DATE '2024-12-31' END, CASE WHEN o_orderkey % 2 = 0 THEN DATE '2030-12-31' ELSE DATE '2019-12-31' END), '%Y-%m-%d') AS compat FROM orders""",
    "threshold_extract": """SELECT p_partkey, array_to_string(list_distinct_in_order, '|') AS found FROM (SELECT p_partkey, list_filter(l, lambda x, i: list_position(l, x) = i) AS list_distinct_in_order FROM (
SELECT p_partkey, [p_size || ',5 Ngày', (p_partkey % 100) || ' tuổi', '12 tháng', '05/06/' || (1990 + p_size), (1990 + p_size)::VARCHAR, '2001'] AS l FROM part))""",
    "pair_mining": "WITH d AS (SELECT a.vec_id AS query_id, b.vec_id, a.label = b.label AS rel, round(list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS sim FROM embeddings a, embeddings b WHERE a.vec_id <> b.vec_id) SELECT query_id, vec_id, rel, sim FROM (SELECT *, row_number() OVER (PARTITION BY query_id, rel ORDER BY sha256('42:' || vec_id)) AS place FROM d WHERE sim BETWEEN 0.30 AND 0.85) WHERE place <= 3",
    "stratified_split": "SELECT doc_id, lang, CASE WHEN row_number() OVER (PARTITION BY lang ORDER BY sha256('42:' || doc_id), doc_id) <= round_even(count(*) OVER (PARTITION BY lang) * 0.75, 0) THEN 'test' ELSE 'dev' END AS split FROM documents",
    "category_stratum": """WITH c AS (SELECT conv_id, count(DISTINCT CASE WHEN length(text) % 9 > 0 THEN length(text) % 5 END) AS n, count(DISTINCT CASE WHEN length(text) % 9 > 0 AND length(text) % 5 < 3 THEN length(text) % 5 END) AS k FROM conversations GROUP BY 1)
SELECT CASE WHEN n = 0 THEN 'unparseable' WHEN n = k THEN 'in_corpus' WHEN k = 0 THEN 'ooc' ELSE 'mixed' END AS category, count(*) AS n FROM c GROUP BY 1""",
    "provenance_check": "SELECT lang, count(*) AS violations FROM documents WHERE doc_id % 4 = 0 AND substr(text, 12, length(substr(text, 11, 15))) <> substr(text, 11, 15) GROUP BY 1",
    "constraint_violations": """SELECT 'documents.doc_id unique' AS rule, count(*) AS violations FROM (SELECT doc_id FROM documents GROUP BY 1 HAVING count(*) > 1)
UNION ALL SELECT 'documents.text unique', count(*) FROM (SELECT text FROM documents GROUP BY 1 HAVING count(*) > 1) UNION ALL SELECT 'documents.lang not null', count(*) FROM documents WHERE lang IS NULL
UNION ALL SELECT 'labels refer to English documents', count(*) FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents WHERE lang = 'en')
UNION ALL SELECT 'unit vectors', count(*) FROM embeddings WHERE abs(sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) - 1) > 1e-3""",
    "chunker": "SELECT doc_id, k AS chunk, k * 400 AS start, sha256(substr(text, k * 400 + 1, 400)) AS body_sha FROM (SELECT doc_id, text, unnest(range(0, greatest(1, ((length(text) + 399) // 400)))) AS k FROM documents)",
    "answer_clean": r"""WITH t AS (SELECT conv_id, turn, regexp_replace('Issue: x' || chr(10) || 'Rule:  [A 1] ' || text || ' [B, C]  end' || chr(10) || 'last', '\[[^\]]+\]', '', 'g') AS x FROM conversations WHERE role = 'assistant')
SELECT conv_id, turn, sha256(trim(regexp_replace(regexp_replace(x, '(?im)^\s*(issue|rule|application|conclusion)\s*:\s*', '', 'g'), '\s+', ' ', 'g'))) AS clean_sha FROM t""",
    "context_render": "SELECT conv_id, substr(string_agg('[' || role || '] ' || substr(text, 1, 60), chr(10) ORDER BY turn), 1, 400) AS context FROM conversations GROUP BY 1",
    "validation_summary": "SELECT lang, count(*) AS n, count(quality) AS labelled, count_if(quality = 1)::BIGINT AS good, count_if(toxic = 1)::BIGINT AS toxic, round(count_if(quality = 1) / count(quality), 4) AS rate FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1",
    "group_counts": "SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS users, min(event_id) AS first FROM events GROUP BY 1",
    "article_ranges": "SELECT p_partkey, unnest(list_concat(range(p_size, p_size + (p_partkey % 4)::INT + 1), [99, 7])) AS article FROM part",
}
