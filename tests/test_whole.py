"""Catalogue queries over all of their input, against their SQL without its cuts, on small tables."""

import math
import random
import re
import unicodedata

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.operators import graph as G
from corpusloom.plans import catalogue


@pytest.fixture(scope="module")
def small(tmp_path_factory):
    """A folder of small tables."""
    rng = random.Random(11)
    words = [a + b + c for a in "bdklm" for b in "aeiou" for c in "nrst"]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    vector = lambda label: [x + 0.4 * (i == label) for i, x in enumerate(rng.gauss(0, 0.3) for _ in range(8))]
    unit = lambda v: [x / math.sqrt(sum(y * y for y in v)) for x in v]
    order = [(i, rng.randint(1, 4), rng.choice(["1-URGENT", "2-HIGH", "3-MEDIUM"]), rng.choice("OFP"), rng.uniform(1, 900)) for i in range(1, 181)]
    line = [(o[0], n, rng.choice([*range(1, 30), 100]), rng.randint(1, 6), float(rng.randint(1, 50)), rng.choice("ANR")) for o in order for n in range(1, rng.randint(1, 3) + 1)]
    tables = {
        "documents": pd.DataFrame([(i, text(rng.randint(20, 90)), rng.choice(["en", "de"]), f"src{i % 20}") for i in range(60)], columns=["doc_id", "text", "lang", "source"]),
        "benchmark": pd.DataFrame([(i, text(rng.randint(14, 24))) for i in range(12)], columns=["item_id", "text"]),
        "embeddings": pd.DataFrame([(i, unit(vector(i % 4)), i % 4) for i in range(130)], columns=["vec_id", "embedding", "label"]),
        "orders": pd.DataFrame(order, columns=["o_orderkey", "o_custkey", "o_orderpriority", "o_orderstatus", "o_totalprice"]),
        "lineitem": pd.DataFrame(line, columns=["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_returnflag"]),
        "part": pd.DataFrame([(i, rng.randint(1, 50)) for i in (*range(1, 36), 100, 200)], columns=["p_partkey", "p_size"]),
        "supplier": pd.DataFrame([(i,) for i in range(1, 8)], columns=["s_suppkey"]),
        "customer": pd.DataFrame([(i, rng.choice(["A", "B"]), rng.uniform(0, 99)) for i in range(1, 15)], columns=["c_custkey", "c_mktsegment", "c_acctbal"]),
    }
    folder = tmp_path_factory.mktemp("small")
    for name, rows in tables.items():
        rows.to_parquet(folder / f"{name}.parquet")
    return str(folder)


def plain(rows, names):
    value = lambda x: None if x is None or x != x else round(float(x), 5) if isinstance(x, float) or hasattr(x, "as_tuple") else x
    return sorted((tuple(value(r[names.index(n)]) for n in sorted(names)) for r in rows), key=repr)


def same(spark, small, name):
    """The query's rows, which must be its SQL's."""
    con = duckdb.connect()
    for t in ("documents", "benchmark", "embeddings", "orders", "lineitem", "part", "supplier", "customer"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    df = catalogue.queries()[name](spark, small)
    got = plain([tuple(r) for r in df.collect()], df.columns)
    found = con.execute(catalogue.oracle_sql()[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == sorted(df.columns)
    assert got == plain(found.fetchall(), names)
    return got


@pytest.mark.parametrize("name", ["bm25_okapi", "rerank_lexical", "rrf_fusion", "weighted_fusion", "hybrid_temporal", "ontology_score"])
def test_whole_benchmark_texts_are_asked(spark, small, name):
    same(spark, small, name)


@pytest.mark.parametrize("name", ["degree", "uncovered", "orphan_filter", "parse_id", "article_ranges", "proximity_candidates", "upsert_edges"])
def test_whole_tables_are_read(spark, small, name):
    assert same(spark, small, name)


@pytest.mark.parametrize("name", ["external_references", "internal_references", "gold_citations", "answer_metrics", "statute_parts", "statute_references", "identifiers", "law_resolution"])
def test_legal_texts_are_read(spark, small, name):
    assert same(spark, small, name)


def test_seeds_reach_what_a_plain_search_reaches(spark, small):
    lines, parts = pd.read_parquet(f"{small}/lineitem.parquet"), pd.read_parquet(f"{small}/part.parquet")
    near = {}
    for a, b in zip(lines.l_partkey.tolist(), (-1 - lines.l_suppkey).tolist()):
        near.setdefault(a, set()).add(b), near.setdefault(b, set()).add(a)
    want = []
    for seed in [p for p in parts.p_partkey.tolist() if p % 100 == 0]:
        seen = front = {seed}
        for hop in (1, 2, 3):
            front = {y for x in front for y in near.get(x, ())} - seen
            seen = seen | front
            if front:
                want.append((seed, hop, len(front), sum(front)))
    got = catalogue.queries()["multi_hop"](spark, small).collect()
    assert sorted((r.seed, r.hop, r.nodes, r.node_sum) for r in got) == sorted(want)


@pytest.mark.parametrize("block", [2048, 40])
@pytest.mark.parametrize("name", ["score_gap", "failure_modes", "pair_mining"])
def test_all_vectors_are_queries(spark, small, name, block, monkeypatch):
    monkeypatch.setattr("corpusloom.operators.dense.BLOCK", block)
    got = same(spark, small, name)
    assert name != "failure_modes" or len(got) > 1


def test_whole_texts_are_folded(spark, small):
    same(spark, small, "fold_slug")


def test_all_accents_are_folded(spark):
    letters = [c for c in map(chr, range(0xC0, 0x1F00)) if c.isalpha() and re.fullmatch("[A-Za-z]", unicodedata.normalize("NFKD", c).encode("ascii", "ignore").decode())]
    assert len(letters) > 500
    texts = ["Điều 64 khoản", unicodedata.normalize("NFD", "Người lao động được hưởng"), "x" + "x".join(letters) + "x"]
    want = ["dieu 64 khoan", "nguoi lao dong duoc huong", re.sub("[^a-z]", "", unicodedata.normalize("NFKD", texts[2]).lower().encode("ascii", "ignore").decode())]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", T.fold(F.col("t")).alias("f")).orderBy("i").collect()
    assert [r.f for r in got] == want


@pytest.mark.parametrize("texts", [["", "ab", "cd", "ef" * 20, None, "a quote§", "abcdefghijklmnopqrstuvwxyz§", "ab"], [], ["x"]])
def test_statements_about_texts_of_any_length(spark, small, tmp_path, texts):
    rows = [(i, t) for i, t in enumerate(texts * 4)] + ([(-1, "minus"), (None, "none"), (3, "again"), (7, "")] if texts else [])
    for t in ("benchmark", "embeddings", "orders", "lineitem", "part", "supplier", "customer"):
        (tmp_path / f"{t}.parquet").symlink_to(f"{small}/{t}.parquet")
    spark.createDataFrame(rows, "doc_id long, text string").toPandas().astype({"doc_id": "Int64", "text": "string"}).to_parquet(tmp_path / "documents.parquet")
    same(spark, str(tmp_path), "filtered_extractions")


@pytest.mark.parametrize("sent", [G.SENT, 0])
@pytest.mark.parametrize("undirected", [False, True])
def test_seeds_that_walk_together_reach_what_each_reaches(spark, undirected, sent, monkeypatch):
    monkeypatch.setattr(G, "SENT", sent)
    rng = random.Random(4)
    ends = [(rng.randint(-150, 150), rng.randint(-150, 150)) for _ in range(350)] + [(5, 5), (5, None), (None, 6), (None, None)]
    edges = spark.createDataFrame(ends, "src long, dst long")
    seeds = spark.createDataFrame([(i,) for i in [*range(-90, 90), 3, 3, None, 9999]], "seed long")
    got = sorted(tuple(r) for r in G.reach_counts(seeds, edges, 4, undirected).collect())
    plain = G.expand(seeds, edges, 4, undirected).groupBy("seed", "hop").agg(F.count(F.lit(1)), F.sum("node"))
    assert got == sorted(tuple(r) for r in plain.collect()) and len(got) > 180
