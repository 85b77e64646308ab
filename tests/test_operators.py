"""The engine's operators on small tables with values worked out by hand."""

import math

import pytest
from pyspark.sql import functions as F

from corpusloom.functions import ids as I
from corpusloom.functions import text as T
from corpusloom.operators import cited as C
from corpusloom.operators import citations, dense, documents, extract, graph, hybrid, parsing, ranking
from corpusloom.operators import references as R
from corpusloom.plans import legal
from corpusloom.sources import tables


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("given,want", [("IV", 4), ("XIX", 19), ("MCMXCIV", 1994), ("I", 1)])
def test_roman(spark, given, want):
    assert one(spark, T.roman(F.lit(given))) == want


def test_text(spark):
    assert one(spark, T.fold(F.lit("Él  đã-ÑU!"))) == "el da nu"
    assert one(spark, T.slug(F.lit("A b/c"))) == "a-b-c"
    assert one(spark, T.slug(F.lit("Người lao động ½ ﬁn ß"))) == "nguoi-lao-dong-12-fin"
    assert one(spark, T.fold_text(F.lit("Điều 64, khoản 1/QĐ-BHXH"))) == "dieu 64 khoan 1/qd-bhxh"
    assert one(spark, T.normalised(F.lit("  Điều  Này, ĐÃ "))) == "dieu nay, da"
    assert str(one(spark, T.event_date(F.lit("ngày 01-02-2020, 3.4.2021 và 31/02/2030")))) == "2021-04-03"
    assert one(spark, T.event_date(F.lit("từ 1949"))) is None
    assert one(spark, T.thresholds(F.lit("đủ 15,5 năm hoặc 20  TUỔI, 75% từ 1/2/2020"))) == ["15,5 năm", "20 TUỔI", "1/2/2020", "2020"]
    answer = "Issue: x [Điều 1]\nNguồn: Điều 5\nConclusion:  y"
    assert one(spark, T.clean_answer(F.lit(answer))) == "x y"
    assert one(spark, T.clean_answer(F.lit(answer), F.lit(" z "))) == "z"


def test_ids(spark):
    got = lambda x: tuple(one(spark, I.parse_id(F.lit(x))) or ())
    assert got("L41_2024.A64.K1.đ") == ("L41_2024", None, 64, 1, "đ", None)
    assert got("L41_2024") == ("L41_2024", None, None, None, None, None)
    assert got("L41_2024.C2") == ("L41_2024", 2, None, None, None, None)
    assert got("L41_2024.A3.T2") == ("L41_2024", None, 3, None, None, 2)
    assert got("1L.A2") == got("nothing") == ()
    assert one(spark, I.law_id(F.lit("41/2024/QH15"))) == "L41_2024" and one(spark, I.law_id(F.lit("ND143_2018"))) == "ND143_2018"
    with pytest.raises(Exception, match="no law id or code"):
        one(spark, I.law_id(F.lit("143/2018/ND-CP")))
    assert one(spark, I.citation_label(F.lit("L41_2024.A64.K1.a"))) == "Điều 64 khoản 1 điểm a"
    assert len(one(spark, I.semantic_id("condition", F.lit("x" * 200)))) == len("cond:") + 80
    assert one(spark, I.parse_citation_id(F.lit("X.A1"), ["L"])) is None
    assert one(spark, I.file_name(F.lit("gpt-4.1"))) == "gpt-4_1"


def test_article_lists(spark):
    got = lambda x: one(spark, C.expand_articles(F.lit(x)))
    assert got("5-8, 6 va 12a") == ["5", "6", "7", "8", "6", "12a"]
    assert got("9-7") == got("1-90") == got("1a-3") == []


def test_lists_with_one_keyword(spark):
    units = spark.createDataFrame([("L1_2020.A5.K1", "L1_2020.A5.K1", "L1_2020", 5, "Theo khoản 1, 2 Điều 6; điểm a, b khoản 3 Điều 7.")], "unit_id string, source_clause string, law string, article int, text string")
    laws = spark.createDataFrame([("L1_2020", 9)], "law string, max_article int")
    found = lambda **k: sorted(r.dst for r in R.internal_references(units, laws, **k).collect())
    assert found() == ["L1_2020.A6.K1", "L1_2020.A7.K3.a"]
    assert found(expand_lists=True) == ["L1_2020.A6.K1", "L1_2020.A6.K2", "L1_2020.A7.K3.a", "L1_2020.A7.K3.b"]


def test_vectors_out_of_shape(spark):
    rows = [(1, [1.0, 0.0]), (2, [0.6, 0.8]), (3, None), (4, [1.0, None]), (5, [float("nan"), 1.0]), (6, [1.0]), (7, [0.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = dense.dense_topk(df.withColumnRenamed("vec_id", "query_id"), df, 1).collect()
    assert sorted((r.query_id, r.vec_id) for r in got) == [(1, 2), (2, 7), (7, 2)]


def test_hybrid(spark):
    dense_rows = spark.createDataFrame([(1, "a", 0.9, 1), (1, "b", 0.8, 2), (2, "a", 0.9, 1)], "query_id long, id string, score double, rank int")
    sparse_rows = spark.createDataFrame([(1, "c", 3.0, 1), (1, "b", 2.0, 2)], "query_id long, id string, score double, rank int")
    items = spark.createDataFrame([("a", "L1", "L1.A1"), ("b", "L2", "L2.A1"), ("c", "L2", "L2.A1")], "id string, law string, article string")
    laws = spark.createDataFrame([("L1", "2000-01-01"), ("L2", "2020-01-01")], "law string, d string").selectExpr("law", "date(d) AS effective")
    repeals = spark.createDataFrame([("L1", "2020-01-01")], "law string, d string").selectExpr("law", "date(d) AS repealed")
    dates = spark.createDataFrame([(1, "2021-05-05"), (2, None)], "query_id long, d string").selectExpr("query_id", "date(d) AS date")
    run = lambda **k: hybrid.hybrid_retrieve(dense_rows, sparse_rows, items, laws, repeals, dates, "id", **k)
    ids = lambda df, q: [r.id for r in df.where(f"query_id = {q}").orderBy("rank").collect()]
    fused, audit = run()
    assert ids(fused, 1) == ["b", "c"] and ids(fused, 2) == ["a"]
    told = audit.where("query_id = 1").first()
    assert (told.n_dense, told.n_sparse, told.n_post_temporal, told.n_fused, told.n_dropped_by_temporal) == (2, 2, 2, 2, 1)
    assert told.dense_articles == ["L1.A1", "L2.A1"] and told.fused_articles == ["L2.A1"]
    assert ids(run(mode="strict_today_default")[0], 2) == [] and len(ids(run(mode="always_skip")[0], 1)) == 3
    with pytest.raises(ValueError, match="mode"):
        run(mode="other")


def test_walks(spark):
    edges = spark.createDataFrame([("REFERENCES", "a", "b"), ("REFERENCES", "b", "c"), ("NEXT", "a", "d")], "type string, src string, dst string")
    hits = spark.createDataFrame([(1, "a", 1), (2, "c", 1)], "query_id long, id string, rank int")
    path = hybrid.Walk((hybrid.Step("REFERENCES"), hybrid.Step("REFERENCES")))
    assert [(r.query_id, r.node) for r in hybrid.walk(hits.select("query_id", "id"), edges, path).collect()] == [(1, "c")]
    wrong = hybrid.Walk((hybrid.Step("DROP"),))
    assert wrong.problems() and not path.problems()
    with pytest.raises(ValueError, match="unknown edge type"):
        hybrid.walk(hits.select("query_id", "id"), edges, wrong)
    got = hybrid.walk_retrieve(hits, edges, wrong, fallback=hybrid.Walk((hybrid.Step("NEXT"),))).collect()
    assert {(r.query_id, r.id, r.source) for r in got} == {(1, "a", "seed"), (1, "d", "walk"), (2, "c", "seed")}


def test_statutes_in_blocks_of_any_size(spark):
    lines = spark.createDataFrame([("S", i, t) for i, t in enumerate(legal.STATUTE)], "law string, ord int, text string")
    rows = lambda b: sorted((r.ord, r.role) for r in parsing.label_lines(lines, block=b).collect())
    assert rows(1) == rows(4) == rows(2000)


def test_laws_without_chapters(spark):
    text = ["Điều 1. Một", "1. Khoản", "Chương II", "Hai", "Điều 2. Ba"]
    lines = spark.createDataFrame([("D", i, t) for i, t in enumerate(text)], "law string, ord int, text string")
    parts = parsing.parse_statutes(lines, synthetic=True)
    assert sorted((r.id, r.title) for r in parts["chapters"].collect()) == [("D.C1", ""), ("D.C2", "Hai")]
    assert sorted((r.id, r.chapter_id) for r in parts["articles"].collect()) == [("D.A1", "D.C1"), ("D.A2", "D.C2")]
    assert parsing.parse_statutes(lines)["articles"].count() == 1


def test_other_text_functions(spark):
    assert str(one(spark, T.event_date(F.lit("on 01/03/2020")))) == "2020-03-01"
    assert str(one(spark, T.event_date(F.lit("on 01/03/2020"), "compat"))) == "2020-12-31"
    assert one(spark, T.event_date(F.lit("Law 41/2024/QH15"))) is None
    assert one(spark, T.category(F.array(F.lit("a"), F.lit("z")), ["a"])) == "mixed"


def test_metrics(spark):
    ranked = spark.createDataFrame([(1, "a", 1), (1, "x", 2), (1, "b", 3), (2, "q", 1)], "query_id long, doc string, rank int")
    gold = spark.createDataFrame([(1, "a"), (1, "b"), (1, "c"), (3, "z")], "query_id long, doc string")
    got = {(r.query_id, r.k): r for r in ranking.retrieval_metrics(ranked, gold, [2, None], "doc").collect()}
    assert (got[1, 2].precision, got[1, 2].rr) == (0.5, 1.0) and got[1, 2].recall == pytest.approx(1 / 3)
    assert got[1, None].ndcg == pytest.approx(1.5 / (1 + 1 / math.log2(3) + 0.5))
    assert (got[2, 2].precision, got[2, 2].recall, got[2, 2].f1, got[2, 2].ndcg) == (0.0, None, None, None)
    assert (got[3, 2].precision, got[3, 2].recall) == (None, 0.0)


def test_fusion(spark):
    a = spark.createDataFrame([(1, "x", 1), (1, "y", 2)], "query_id long, doc string, rank int")
    b = spark.createDataFrame([(1, "z", 1), (1, "y", 2)], "query_id long, doc string, rank int")
    got = [(r.doc, r["rank"]) for r in ranking.reciprocal_rank_fusion([a, b], "doc", 3).orderBy("rank").collect()]
    assert got == [("y", 1), ("x", 2), ("z", 3)]


def test_citations(spark):
    rows = [(1, ["L.A1", "L.A2.K1"], ["L.A1", "L.A2"], 0), (2, [], [], 0), (3, [], ["L.A1"], 1)]
    df = spark.createDataFrame(rows, "id long, predicted array<string>, gold array<string>, parse_errors int")
    strict = {r.id: (r.recall, r.precision, r.f1) for r in citations.citation_metrics(df).collect()}
    assert strict == {1: (0.5, 0.5, 0.5), 2: (None, None, None), 3: (0.0, 0.0, 0.0)}
    assert citations.citation_metrics(df, "article").where("id = 1").first().f1 == 1.0


def test_graph(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4), (4, 4)], "src long, dst long")
    seeds = spark.createDataFrame([(1,)], "seed long")
    assert {(r.node, r.hop) for r in graph.expand(seeds, edges, 3).collect()} == {(2, 1), (3, 2), (4, 3)}
    assert {(r.node, r.degree) for r in graph.degrees(edges).collect()} == {(1, 2), (2, 2), (3, 3), (4, 2)}
    nodes = spark.createDataFrame([(2,), (3,), (4,)], "id long")
    assert graph.without_orphans(edges, nodes).count() == 3
    target = spark.createDataFrame([(1, "a", 5)], "k long, v string, w int")
    delta = spark.createDataFrame([(1, None, 6, 1), (1, "c", None, 2), (2, "n", 1, 1)], "k long, v string, w int, o int")
    assert sorted(tuple(r) for r in graph.upsert(target, delta, ["k"], "o").collect()) == [(1, "c", 6), (2, "n", 1)]


def test_spans(spark):
    texts = spark.createDataFrame([(1, "the theory")], "id long, text string")
    aliases = spark.createDataFrame([("the",), ("theory",), ("e t",)], "alias string")
    spans = extract.literal_spans(texts, aliases, "id", "text")
    got = extract.select_spans(spans, "id", [F.col("start"), -F.length("alias")]).orderBy("start").collect()
    assert [(r.alias, r.start, r.end) for r in got] == [("the", 0, 3), ("theory", 4, 10)]
    ranges = spark.createDataFrame([("5-8, 11",), ("1-90",)], "a string")
    assert sorted(r.n for r in extract.expand_ranges(ranges, "a", "n").collect()) == ["11", "5", "6", "7", "8"]


def test_documents(spark):
    rows = spark.createDataFrame([(1, i, f"w{i}") for i in range(1, 9)], "g long, i int, t string")
    assert documents.gaps(rows.where("i <> 3"), "g", "i").count() == 5
    split = documents.stratified_split(rows, "g", "i", 0.75, 42)
    assert split.where("split = 'test'").count() == 6


def test_corpus_errors(spark, tmp_path):
    (tmp_path / "c.jsonl").write_text('{"id": "1", "text": "a"}\n{"id": "1", "text": "b"}\n{"text": "c"}\n{"id": "2", "text": ""}\n{bad\n{"id": "3", "text": "ok"}\n')
    good, bad = tables.read_corpus(spark, str(tmp_path / "c.jsonl"))
    assert [r.id for r in good.collect()] == ["3"]
    assert sorted(r.reason for r in bad.collect()) == ["bad JSON", "duplicate id", "duplicate id", "missing id", "missing text"]


def test_r_precision(spark):
    ranked = spark.createDataFrame([(1, "a", 1), (1, "x", 2), (1, "y", 3), (1, "b", 4), (2, "q", 1), (4, "m", 1)], "query_id long, doc string, rank int")
    gold = spark.createDataFrame([(1, "a"), (1, "b"), (1, "c"), (3, "z"), (4, "m"), (4, "n")], "query_id long, doc string")
    got = {(r.query_id, r.k): r.r_precision for r in ranking.retrieval_metrics(ranked, gold, [1, None], "doc").collect()}
    assert got == {(q, k): v for q, v in ((1, pytest.approx(1 / 3)), (2, None), (3, 0.0), (4, 0.5)) for k in (1, None)}


def test_only_texts_that_hold_a_pattern_s_words_are_searched(spark):
    from corpusloom.functions.spans import pattern_spans

    rows = spark.createDataFrame([("khoản 1 Điều 2",), ("khoản 1",), ("",), (None,)], "text string")
    found = rows.select(pattern_spans(F.col("text"), r"(?:khoản\s+)?\d", {"n": 0}, needs=("khoản", "Điều")).alias("s")).collect()
    assert [None if r.s is None else [(x.start, x.end, x.n) for x in r.s] for r in found] == [[(0, 7, "khoản 1"), (13, 14, "2")], [], [], None]


def test_articles_beyond_a_law_s_last_or_any_number_are_no_references(spark):
    units = spark.createDataFrame([("u", "c", "A_1", 5, "Áp dụng Điều 0, Điều 7 và Điều 8; Điều 99999999999 và Điều này.")], "unit_id string, source_clause string, law string, article int, text string")
    got = R.internal_references(units, spark.createDataFrame([("A_1", 7)], "law string, max_article int")).collect()
    assert sorted((r.dst, r.is_self) for r in got) == [("A_1.A5", True), ("A_1.A7", False)]


def test_few_keys_of_many_texts_are_spread_over_tasks(spark, tmp_path):
    spark.range(50).select(F.col("id").alias("p_partkey")).coalesce(1).write.parquet(str(tmp_path / "part.parquet"))
    assert legal._clauses(spark, str(tmp_path)).rdd.getNumPartitions() >= 4
