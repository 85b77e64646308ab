"""Retrieval, fusion and metric queries over the shared tables."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import tokens
from ..operators import citations, dense, ranking, sparse
from ..sources.tables import kept_table, table

#: Searches take the vectors whose id is divisible by this as queries, against all vectors.
QUERIES_EVERY = 100
TERMS = r"regexp_extract_all(lower(text), '[a-z0-9]+')"
#: Postings and query terms, shared by the SQL of the sparse queries.
POST = f"""w0 AS MATERIALIZED (SELECT doc_id AS doc, {TERMS} AS ws FROM documents),
p0 AS MATERIALIZED (SELECT doc, len(ws) AS len, unnest(ws) AS term FROM w0),
p AS MATERIALIZED (SELECT doc, term, count(*) AS tf, max(len) AS len FROM p0 GROUP BY doc, term)"""


ASKED = f"q AS MATERIALIZED (SELECT query_id, term, count(*) AS qtf FROM (SELECT item_id AS query_id, unnest({TERMS}) AS term FROM benchmark) GROUP BY ALL)"


def _bm25_sql(okapi: bool = False) -> str:
    idf = "ln(1 + (n - df + 0.5) / (df + 0.5))"
    if okapi:
        idf = "ln((n - df + 0.5) / (df + 0.5))"
    return f"""{POST}, {ASKED},
st AS MATERIALIZED (SELECT count(*) AS n, avg(len) AS a FROM (SELECT doc, max(len) AS len FROM p GROUP BY doc)),
i0 AS MATERIALIZED (SELECT term, a, {idf} AS idf FROM (SELECT term, count(*) AS df FROM p GROUP BY term), st),
i AS MATERIALIZED (SELECT term, a, {"CASE WHEN idf < 0 THEN 0.25 * (SELECT avg(idf) FROM i0) ELSE idf END" if okapi else "idf"} AS idf FROM i0),
s AS MATERIALIZED (SELECT query_id, doc, round(sum(idf * tf * ({1.5 if okapi else 1.2} + 1) / (tf + {1.5 if okapi else 1.2} * (1 - 0.75 + 0.75 * len / a))), 6) AS score FROM q JOIN i USING (term) JOIN p USING (term) GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc) AS rank FROM s WHERE score > 0)"""


def _post(spark: SparkSession, sf_dir: str) -> sparse.Index:
    return sparse.Index(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id", "text", kept_table(spark, "postings"))


def _asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sparse.query_terms(table(spark, sf_dir, "benchmark"), "item_id", "text")


def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sparse.bm25(_asked(spark, sf_dir), _post(spark, sf_dir), 10)


def bm25_okapi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sparse.bm25(_asked(spark, sf_dir), _post(spark, sf_dir), 10, 1.5, 0.75, okapi=True)


def sparse_cosine_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sparse.cosine(_asked(spark, sf_dir), _post(spark, sf_dir), 10)


def token_overlap_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sparse.overlap(_asked(spark, sf_dir), _post(spark, sf_dir), 10)


def _vectors(spark: SparkSession, sf_dir: str, every: int) -> tuple[DataFrame, DataFrame]:
    v = table(spark, sf_dir, "embeddings")
    return v.where(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("query_id"), "embedding", "label"), v


def _dense_sql(every: int, k: int) -> str:
    return f"""d AS (SELECT a.vec_id AS query_id, b.vec_id, a.label AS la, b.label AS lb, round(list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS score
  FROM embeddings a, embeddings b WHERE a.vec_id % {every} = 0 AND a.vec_id <> b.vec_id),
t AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM d) WHERE rank <= {k})"""


def dense_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    q, v = _vectors(spark, sf_dir, QUERIES_EVERY)
    return dense.dense_topk(q, v, 10)


def mean_pool_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each label's mean vector, normalised, against all vectors."""
    v = table(spark, sf_dir, "embeddings")
    pooled = dense.mean_pool(v, "label").select(F.col("label").cast("long").alias("query_id"), "embedding")
    return dense.dense_topk(pooled, v, 5, exclude_self=False)


def _channels(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Two rankings of documents for whole queries: BM25 and term-count cosine."""
    q, p = _asked(spark, sf_dir), _post(spark, sf_dir)
    return sparse.bm25(q, p, 30), sparse.cosine(q, p, 30)


CHANNELS = f"""{_bm25_sql()},
c1 AS (SELECT query_id, doc, score, rank FROM r WHERE rank <= 30),
qn AS (SELECT query_id, sqrt(sum(qtf * qtf)) AS n FROM q GROUP BY 1), dn AS (SELECT doc, sqrt(sum(tf * tf)) AS n FROM p GROUP BY 1),
cs AS (SELECT query_id, doc, round(dp / (qn.n * dn.n), 6) AS score FROM (SELECT query_id, doc, sum(qtf * tf) AS dp FROM q JOIN p USING (term) GROUP BY ALL) JOIN qn USING (query_id) JOIN dn USING (doc)),
c2 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc) AS rank FROM cs) WHERE rank <= 30)"""


def rrf_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.reciprocal_rank_fusion(list(_channels(spark, sf_dir)), "doc", 15)


def weighted_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = _channels(spark, sf_dir)
    return ranking.weighted_fusion([(a, 0.5), (b, 0.5)], "doc", 15)


def hybrid_temporal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both channels kept to documents whose source is in force for the query, ranked again and fused.

    A source ``srcN`` takes effect in year 2000 + N (src0: no date) and sources N divisible by 5
    are repealed in 2010 + N; query i asks for 2000 + i mod 25.
    """
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc"), F.col("source").alias("law"))
    number = F.regexp_extract("law", r"(\d+)$", 1).cast("int")
    laws = docs.select("law").distinct().select("law", F.when(number > 0, F.make_date(2000 + number, F.lit(1), F.lit(1))).alias("effective"), number.alias("n"))
    repeals = laws.where("n % 5 = 0 and n > 0").select("law", F.make_date(2010 + F.col("n"), F.lit(1), F.lit(1)).alias("repealed"))
    dates = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.make_date((2000 + F.col("item_id") % 25).cast("int"), F.lit(7), F.lit(1)).alias("date"))
    kept = [ranking.in_force(c.join(docs, "doc"), laws.drop("n"), repeals, dates) for c in _channels(spark, sf_dir)]
    again = [ranking.top_per_query(c.drop("rank"), "doc", 30) for c in kept]
    return ranking.reciprocal_rank_fusion(again, "doc", 10)


def rerank_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """BM25 candidates scored again by the part of the query's distinct terms they hold, as a logistic."""
    q, p = _asked(spark, sf_dir), _post(spark, sf_dir)
    pool = sparse.bm25(q, p, 15).select("query_id", "doc")
    terms = q.groupBy("query_id").agg(F.count(F.lit(1)).alias("m"))
    hits = pool.join(q.select("query_id", "term"), "query_id").join(p.asked(q).select("doc", "term"), ["doc", "term"]).groupBy("query_id", "doc").agg(F.count(F.lit(1)).alias("h"))
    scored = hits.join(terms, "query_id").select("query_id", "doc", F.round(1 / (1 + F.exp(-(4.0 * F.col("h") / F.col("m") - 2))), 6).alias("score"))
    return ranking.top_per_query(scored, "doc", 5)


def _judged(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    q, v = _vectors(spark, sf_dir, QUERIES_EVERY)
    ranked = dense.dense_topk(q, v, 30).select("query_id", "vec_id", "rank")
    gold = q.select("query_id", "label").join(v.select("vec_id", "label"), "label").where("vec_id <> query_id").select("query_id", "vec_id")
    return ranked, gold


KS = [5, 10, 20]
METRICS = ["precision", "recall", "f1", "ndcg", "rr", "r_precision"]
JUDGED = f"""{_dense_sql(QUERIES_EVERY, 30)},
g AS (SELECT a.vec_id AS query_id, count(*) AS ng FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE a.vec_id % {QUERIES_EVERY} = 0 GROUP BY 1),
f AS (SELECT query_id, min(rank) AS f FROM t WHERE la = lb GROUP BY 1),
rp AS (SELECT query_id, count(*) FILTER (WHERE rank <= ng AND la = lb) / max(ng) AS r_precision FROM t JOIN g USING (query_id) GROUP BY 1),
m AS (SELECT t.query_id, k, any_value(la) AS label, count_if(rank <= k) AS n, count_if(rank <= k AND la = lb) AS h, sum(CASE WHEN rank <= k AND la = lb THEN 1 / log2(rank + 1) ELSE 0 END) AS dcg
  FROM t, (VALUES (5), (10), (20)) ks(k) GROUP BY t.query_id, k),
x AS (SELECT m.query_id, k, label, h / n AS precision, h / ng AS recall, CASE WHEN h = 0 THEN 0 ELSE 2 * (h / n) * (h / ng) / (h / n + h / ng) END AS f1,
  dcg / (SELECT sum(1 / log2(i + 1)) FROM range(1, 31) z(i) WHERE i <= least(ng, k)) AS ndcg, coalesce(1.0 / f, 0) AS rr, r_precision
  FROM m JOIN g USING (query_id) JOIN rp USING (query_id) LEFT JOIN f USING (query_id))"""


def retrieval_metrics_at_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ranking.retrieval_metrics(*_judged(spark, sf_dir), KS, "vec_id")
    return rows.select("query_id", "k", *(F.round(c, 6).alias(c) for c in METRICS))


def retrieval_macro_stratified(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means by K over all queries (stratum ``all``) and by label."""
    rows = ranking.retrieval_metrics(*_judged(spark, sf_dir), KS, "vec_id")
    labels = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("query_id"), F.col("label").cast("string").alias("stratum"))
    return ranking.macro_by(rows.join(labels, "query_id"), ["k"], labels.select("stratum").distinct(), METRICS)


def probe_hit_at_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hit at 1, 5 and 10, mean reciprocal rank and the rate of queries without any hit."""
    ranked, gold = _judged(spark, sf_dir)
    first = ranked.join(gold, ["query_id", "vec_id"]).groupBy("query_id").agg(F.min("rank").alias("first"))
    rows = ranked.select("query_id").distinct().join(first, "query_id", "left")
    hit = lambda k: F.round(F.avg(F.when(F.col("first") <= k, 1.0).otherwise(0.0)), 4).alias(f"hit_at_{k}")
    return rows.agg(F.count(F.lit(1)).alias("n"), hit(1), hit(5), hit(10), F.round(F.avg(F.coalesce(1.0 / F.col("first"), F.lit(0.0))), 4).alias("mrr"), F.round(F.avg(F.col("first").isNull().cast("double")), 4).alias("zero_recall"))


PAIRS = "d AS (SELECT a.vec_id AS query_id, b.vec_id, a.label = b.label AS rel, round(list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS sim FROM embeddings a, embeddings b WHERE a.vec_id <> b.vec_id)"


def _gap_sums(a: np.ndarray, b: np.ndarray, sim: np.ndarray, other: np.ndarray, la: np.ndarray, lb: np.ndarray) -> pd.DataFrame:
    same, out = la[:, None] == lb[None, :], []
    for rel in (True, False):
        x = sim[other & (same == rel)]
        if len(x):
            out.append((rel, len(x), x.min(), x.max(), x.sum(), ((x - x.mean()) ** 2).sum()))
    return pd.DataFrame(out, columns=["rel", "n", "lo", "hi", "total", "around"])


def score_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of relevant and other vectors, over all pairs: least, most, mean, deviation."""
    parts = dense.dense_pairs(table(spark, sf_dir, "embeddings"), _gap_sums, "rel boolean, n long, lo double, hi double, total double, around double", also=("label",))
    n, total = F.sum("n"), F.sum("total")
    # squares around the whole mean: those around each block's, and the blocks' means around the whole one
    squares = F.sum(F.col("around") + F.col("total") * F.col("total") / F.col("n")) - total * total / n
    sd = F.when(n > 1, F.round(F.sqrt(F.greatest(squares, F.lit(0.0)) / (n - 1)), 4))
    return parts.groupBy("rel").agg(n.alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.round(total / n, 4).alias("mean"), sd.alias("sd"))


def _best_relevant(a: np.ndarray, b: np.ndarray, sim: np.ndarray, other: np.ndarray, la: np.ndarray, lb: np.ndarray) -> pd.DataFrame:
    rel = other & (la[:, None] == lb[None, :])
    best = np.where(rel, sim, -np.inf).max(axis=1)
    return pd.DataFrame({"query_id": a, "best": best})[rel.any(axis=1)]


def failure_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All vectors by the similarity band of their best relevant other vector, with the upper median."""
    parts = dense.dense_pairs(table(spark, sf_dir, "embeddings"), _best_relevant, "query_id long, best double", also=("label",))
    best = parts.groupBy("query_id").agg(F.max("best").alias("best"))
    mode = F.when(F.col("best") < 0.55, "far").when(F.col("best") < 0.70, "near").otherwise("close")
    banded = best.select(mode.alias("mode"), "best").groupBy("mode", "best").agg(F.count(F.lit(1)).alias("n"))
    # scores have six digits, so there are two million distinct ones at most
    upto = Window.partitionBy("mode").orderBy("best")
    ranked = banded.select("mode", "best", "n", F.sum("n").over(upto).alias("upto"), F.sum("n").over(Window.partitionBy("mode")).alias("all"))
    return ranked.groupBy("mode").agg(F.max("all").alias("n"), F.min(F.when(F.col("upto") > F.floor(F.col("all") / 2), F.col("best"))).alias("median"))


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Citation records made from assistant turns: ids from lengths and turn numbers, arms from ids."""
    t = table(spark, sf_dir, "conversations").where("role = 'assistant'")
    n, size = F.col("turn").cast("int"), F.length("text")
    ref = lambda a, k=None: F.concat(F.lit("L.A"), a.cast("string"), F.lit("") if k is None else F.concat(F.lit(".K"), k.cast("string")))
    return t.select(
        "conv_id",
        "turn",
        F.concat(F.lit("arm"), (F.col("conv_id") % 3).cast("string")).alias("arm"),
        F.when(size % 7 == 0, F.array().cast("array<string>")).otherwise(F.array(ref(size % 5, n % 2), ref(size % 3))).alias("predicted"),
        F.when(size % 11 == 0, F.array().cast("array<string>")).otherwise(F.array(ref(n % 5), ref(size % 3))).alias("gold"),
        F.array(ref(size % 5, n % 2), ref(size % 4)).alias("displayed"),
        (size % 4 == 0).cast("int").alias("parse_errors"),
    )


RECORDS = """t AS (SELECT conv_id, turn, 'arm' || (conv_id % 3) AS arm, turn AS n, length(text) AS s FROM conversations WHERE role = 'assistant'),
z AS (SELECT conv_id, turn, arm, CASE WHEN s % 7 = 0 THEN [] ELSE list_distinct(['L.A' || (s % 5) || '.K' || (n % 2), 'L.A' || (s % 3)]) END AS p,
  CASE WHEN s % 11 = 0 THEN [] ELSE list_distinct(['L.A' || (n % 5), 'L.A' || (s % 3)]) END AS g, ['L.A' || (s % 5) || '.K' || (n % 2), 'L.A' || (s % 4)] AS w, (s % 4 = 0)::INT AS e FROM t)"""


def _scored_sql(article: bool) -> str:
    cut = lambda c: f"list_distinct([regexp_extract(x, '^[^.]+\\.A[0-9]+') for x in {c}])"
    p, g = (cut("p"), cut("g")) if article else ("p", "g")
    return f"""{RECORDS}, y AS (SELECT conv_id, turn, arm, e, len(list_intersect({p}, {g})) AS h, len({g}) AS ng, len({p}) + e AS np FROM z),
v AS (SELECT *, CASE WHEN ng > 0 THEN round(h / ng, 4) END AS recall, CASE WHEN np > 0 THEN round(h / np, 4) WHEN ng > 0 THEN 0.0 END AS precision FROM y),
u AS (SELECT *, CASE WHEN recall + precision > 0 THEN round(2 * recall * precision / (recall + precision), 4) WHEN recall + precision = 0 THEN 0.0 END AS f1 FROM v)"""


def citation_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return citations.citation_metrics(_records(spark, sf_dir)).select("conv_id", "turn", "hits", "recall", "precision", "f1")


def citation_metrics_article(spark: SparkSession, sf_dir: str) -> DataFrame:
    return citations.citation_metrics(_records(spark, sf_dir), "article").select("conv_id", "turn", "hits", "recall", "precision", "f1")


def citation_micro_macro(spark: SparkSession, sf_dir: str) -> DataFrame:
    return citations.citation_summary(citations.citation_metrics(_records(spark, sf_dir)), "arm")


def display_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = citations.display_rate(_records(spark, sf_dir))
    return rows.groupBy("arm").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("display"), 4).alias("display_rate"), F.round(F.try_divide(F.sum("display_num"), F.sum("display_denom")), 4).alias("micro"))


def ontology_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weighted concept, source and keyword evidence, widened to documents of the same source by a quarter."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc"), "lang", "source")
    q = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"))
    words = sparse.overlap(_asked(spark, sf_dir), _post(spark, sf_dir), 20).select("query_id", "doc", "score")
    top = F.max("score").over(Window.partitionBy("query_id"))
    parts = words.select("query_id", "doc", (F.col("score") / top).alias("part"))
    concept = words.join(docs, "doc").select("query_id", "doc", F.when(F.col("lang") == "en", 3 * 1.35).otherwise(F.lit(2.0)).alias("part"))
    legal = words.join(docs, "doc").where(F.concat(F.lit("src"), (F.col("query_id") % 20).cast("string")) == F.col("source")).select("query_id", "doc", F.lit(2.5).alias("part"))
    base = parts.unionByName(concept).unionByName(legal).groupBy("query_id", "doc").agg(F.sum("part").alias("base")).join(docs, "doc")
    near = base.select("query_id", "source", F.col("doc").alias("other"), F.col("base").alias("given"))
    wide = base.join(near, ["query_id", "source"]).where("doc <> other").groupBy("query_id", "doc").agg((0.25 * F.sum("given")).alias("extra"))
    out = base.join(wide, ["query_id", "doc"], "left").join(q, "query_id", "left_semi")
    return ranking.top_per_query(out.select("query_id", "doc", F.round(F.col("base") + F.coalesce("extra", F.lit(0.0)), 6).alias("score")), "doc", 8)


def corpus_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = table(spark, sf_dir, "documents").select("lang", tokens(F.col("text")).alias("w"))
    return words.groupBy("lang").agg(F.count(F.lit(1)).alias("docs"), F.round(F.avg(F.size("w")), 6).alias("avg_len"), F.max(F.size("w")).cast("long").alias("max_len"))


QUERIES = {f.__name__: f for f in (bm25_topk, bm25_okapi, sparse_cosine_topk, token_overlap_fallback, dense_topk, mean_pool_query, rrf_fusion, weighted_fusion, hybrid_temporal, rerank_lexical, retrieval_metrics_at_k, retrieval_macro_stratified, probe_hit_at_k, score_gap, failure_modes, citation_metrics, citation_metrics_article, citation_micro_macro, display_rate, ontology_score, corpus_statistics)}

_ROUNDED = ", ".join(f"round({c}, 6) AS {c}" for c in METRICS)
_MEANS = ", ".join(f"round(avg({c}), 4) AS {c}" for c in METRICS)
_FUSE = "SELECT query_id, doc, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS score, min(CASE WHEN ch = 0 THEN rank END) AS first FROM (SELECT query_id, doc, rank, 0 AS ch FROM {0} UNION ALL SELECT query_id, doc, rank, 1 FROM {1}) GROUP BY ALL"
_RANKED = "SELECT query_id, doc, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, first NULLS LAST, doc) AS rank FROM ({0})) WHERE rank <= {1}"

SQL = {
    "bm25_topk": f"WITH {_bm25_sql()} SELECT query_id, doc, score, rank FROM r WHERE rank <= 10",
    "bm25_okapi": f"WITH {_bm25_sql(True)} SELECT query_id, doc, score, rank FROM r WHERE rank <= 10",
    "sparse_cosine_topk": f"""WITH {POST}, {ASKED}, qn AS (SELECT query_id, sqrt(sum(qtf * qtf)) AS n FROM q GROUP BY 1), dn AS (SELECT doc, sqrt(sum(tf * tf)) AS n FROM p GROUP BY 1),
s AS (SELECT query_id, doc, round(dp / (qn.n * dn.n), 6) AS score FROM (SELECT query_id, doc, sum(qtf * tf) AS dp FROM q JOIN p USING (term) GROUP BY ALL) JOIN qn USING (query_id) JOIN dn USING (doc))
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc) AS rank FROM s) WHERE rank <= 10""",
    "token_overlap_fallback": f"""WITH {POST}, {ASKED}, s AS (SELECT query_id, doc, sum(qtf)::BIGINT AS score FROM q JOIN p USING (term) GROUP BY ALL)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc) AS rank FROM s) WHERE rank <= 10""",
    "dense_topk": f"WITH {_dense_sql(QUERIES_EVERY, 10)} SELECT query_id, vec_id, score, rank FROM t",
    "mean_pool_query": """WITH e AS (SELECT label, generate_subscripts(embedding, 1) AS i, unnest(embedding)::DOUBLE AS x FROM embeddings),
a AS (SELECT label, i, avg(x) AS x FROM e GROUP BY ALL), n AS (SELECT label, sqrt(sum(x * x)) AS n FROM a GROUP BY 1),
m AS (SELECT label AS query_id, list(x / n ORDER BY i) AS v FROM a JOIN n USING (label) GROUP BY 1),
s AS (SELECT query_id, vec_id, round(list_dot_product(v, embedding::DOUBLE[]), 6) AS score FROM m, embeddings)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5""",
    "rrf_fusion": f"WITH {CHANNELS} {_RANKED.format(_FUSE.format('c1', 'c2'), 15)}",
    "weighted_fusion": f"""WITH {CHANNELS}, fs AS (SELECT query_id, doc, round(sum(x), 6) AS score FROM (
  SELECT query_id, doc, 0.5 * score / max(score) OVER (PARTITION BY query_id) AS x FROM c1 UNION ALL SELECT query_id, doc, 0.5 * score / max(score) OVER (PARTITION BY query_id) FROM c2) GROUP BY ALL)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc) AS rank FROM fs) WHERE rank <= 15""",
    "hybrid_temporal": f"""WITH {CHANNELS}, dl AS (SELECT doc_id AS doc, source, regexp_extract(source, '([0-9]+)$', 1)::INT AS n FROM documents),
ok AS (SELECT item_id AS query_id, doc FROM benchmark, dl WHERE (n = 0 OR make_date(2000 + n, 1, 1) <= make_date(2000 + (item_id % 25)::INT, 7, 1))
  AND NOT (n % 5 = 0 AND n > 0 AND make_date(2010 + n, 1, 1) <= make_date(2000 + (item_id % 25)::INT, 7, 1))),
k1 AS (SELECT query_id, doc, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc) AS rank FROM c1 SEMI JOIN ok USING (query_id, doc)),
k2 AS (SELECT query_id, doc, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc) AS rank FROM c2 SEMI JOIN ok USING (query_id, doc))
{_RANKED.format(_FUSE.format('k1', 'k2'), 10)}""",
    "rerank_lexical": f"""WITH {_bm25_sql()}, h AS (SELECT r.query_id, r.doc, count(*) AS h FROM r JOIN q USING (query_id) JOIN p ON p.doc = r.doc AND p.term = q.term WHERE rank <= 15 GROUP BY ALL),
ls AS (SELECT query_id, doc, round(1 / (1 + exp(-(4.0::DOUBLE * h / (SELECT count(*) FROM q WHERE q.query_id = h.query_id) - 2))), 6) AS score FROM h)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc) AS rank FROM ls) WHERE rank <= 5""",
    "retrieval_metrics_at_k": f"WITH {JUDGED} SELECT query_id, k, {_ROUNDED} FROM x",
    "retrieval_macro_stratified": f"""WITH {JUDGED}, z AS (SELECT k, 'all' AS stratum, count(*) AS n, {_MEANS} FROM x GROUP BY k UNION ALL SELECT k, label::VARCHAR, count(*), {_MEANS} FROM x GROUP BY k, label),
y AS (SELECT k, stratum FROM (VALUES (5), (10), (20)) ks(k), (SELECT DISTINCT label::VARCHAR AS stratum FROM embeddings UNION ALL SELECT 'all'))
SELECT k, stratum, coalesce(n, 0) AS n, {", ".join(METRICS)} FROM y LEFT JOIN z USING (k, stratum)""",
    "probe_hit_at_k": f"""WITH {JUDGED}, o AS (SELECT DISTINCT t.query_id, f FROM t LEFT JOIN f USING (query_id))
SELECT count(*) AS n, round(avg(CASE WHEN f <= 1 THEN 1.0 ELSE 0 END), 4) AS hit_at_1, round(avg(CASE WHEN f <= 5 THEN 1.0 ELSE 0 END), 4) AS hit_at_5, round(avg(CASE WHEN f <= 10 THEN 1.0 ELSE 0 END), 4) AS hit_at_10,
round(avg(coalesce(1.0::DOUBLE / f, 0)), 4) AS mrr, round(avg((f IS NULL)::INT), 4) AS zero_recall FROM o""",
    "score_gap": f"WITH {PAIRS} SELECT rel, count(*) AS n, min(sim) AS lo, max(sim) AS hi, round(avg(sim), 4) AS mean, round(stddev_samp(sim), 4) AS sd FROM d GROUP BY rel",
    "failure_modes": f"""WITH {PAIRS}, b AS (SELECT query_id, max(sim) AS best FROM d WHERE rel GROUP BY 1)
SELECT CASE WHEN best < 0.55 THEN 'far' WHEN best < 0.70 THEN 'near' ELSE 'close' END AS mode, count(*) AS n, list_sort(list(best))[(count(*) // 2) + 1] AS median FROM b GROUP BY 1""",
    "citation_metrics": f"WITH {_scored_sql(False)} SELECT conv_id, turn, h AS hits, recall, precision, f1 FROM u",
    "citation_metrics_article": f"WITH {_scored_sql(True)} SELECT conv_id, turn, h AS hits, recall, precision, f1 FROM u",
    "citation_micro_macro": f"""WITH {_scored_sql(False)} SELECT arm, count(*) AS n_records, round(avg(recall), 4) AS macro_recall, round(avg(precision), 4) AS macro_precision, round(avg(f1), 4) AS macro_f1,
round(stddev_samp(recall), 4) AS std_recall, round(stddev_samp(precision), 4) AS std_precision, round(stddev_samp(f1), 4) AS std_f1,
round(sum(h) / sum(ng), 4) AS micro_recall, round(sum(h) / sum(np), 4) AS micro_precision, sum(e)::BIGINT AS parse_errors, count_if(np = 0)::BIGINT AS without_predictions FROM u GROUP BY arm""",
    "display_rate": f"""WITH {RECORDS}, y AS (SELECT arm, len([x for x in p if len([y for y in w if y = x OR starts_with(y, x || '.')]) > 0]) AS d, len(p) + e AS m FROM z)
SELECT arm, count(*) AS n, round(avg(CASE WHEN m > 0 THEN round(d / m, 4) END), 4) AS display_rate, round(sum(d) / sum(m), 4) AS micro FROM y GROUP BY arm""",
    "ontology_score": f"""WITH {POST}, {ASKED}, o AS (SELECT query_id, doc, sum(qtf) AS score FROM q JOIN p USING (term) GROUP BY ALL),
w AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc) AS rank FROM o) WHERE rank <= 20),
b AS (SELECT query_id, doc, source, score / max(score) OVER (PARTITION BY query_id) + CASE WHEN lang = 'en' THEN 4.05::DOUBLE ELSE 2 END + CASE WHEN source = 'src' || (query_id % 20) THEN 2.5 ELSE 0 END AS base FROM w JOIN documents d ON d.doc_id = w.doc),
s AS (SELECT query_id, doc, round(base + 0.25::DOUBLE * (sum(base) OVER (PARTITION BY query_id, source) - base), 6) AS score FROM b)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc) AS rank FROM s) WHERE rank <= 8""",
    "corpus_statistics": f"SELECT lang, count(*) AS docs, round(avg(len({TERMS})), 6) AS avg_len, max(len({TERMS})) AS max_len FROM documents GROUP BY lang",
}
