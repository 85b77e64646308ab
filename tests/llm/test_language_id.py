import random

import numpy as np
from pyspark.sql import functions as F

from corpusloom.llm import language_id as L

WORDS = {"aa": "the and of to in that with from this", "bb": "der und die das ist nicht ein mit", "cc": "le la les des une est dans pour que"}


def table(spark, n=300):
    rng = random.Random(2)
    rows = [(i, " ".join(rng.choice(WORDS[lang].split()) for _ in range(rng.randint(1, 60))), lang) for i, lang in ((i, rng.choice(list(WORDS))) for i in range(n))]
    rows += [(9000, None, "aa"), (9001, "", None), (9002, "123 !!", "bb"), (None, "the and of to in that", None), (9003, "und die " * 9000, None), rows[0]]
    return rows, spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, lang string, score string")


def test_accuracy_and_odd_rows(spark):
    rows, df = table(spark)
    config = L.PPMConfig(batch_bytes=10_000)
    model = L.learn(df.where(~L.held_out()), config)
    got = L.identify(df.withColumn("held_out", L.held_out()), model, config=config).collect()
    assert len(got) == len(rows) and sum(r.held_out for r in got) > 30
    tried = [r for r in got if r.held_out and r.lang and r.text and len(r.text) > 20 and r.lang_pred != "und"]
    assert sum(r.lang == r.lang_pred for r in tried) >= 0.97 * len(tried)
    by = {r.doc_id: r for r in got}
    assert [by[i].lang_pred for i in (9000, 9001, 9002, None, 9003)] == ["und", "und", "und", "aa", "bb"]
    assert by[9000].score == 0 and all(0 <= r.score <= 1 for r in got)
    assert L.identify(df.limit(0), model).count() == 0
    none = L.learn(df.limit(0))
    assert {r.lang_pred for r in L.identify(df, none).collect()} == {"und"}


def test_windows_add_up(spark):
    _, df = table(spark, 60)
    model = L.learn(df)
    texts = [("die und das " * 50).encode(), b"x", b"", "é the".encode()]
    whole = model.lengths(texts)
    assert (L.lengths_in_windows(model, texts, 64) == whole).all()
    each = np.array([model.lengths([t])[0] for t in texts])
    assert (each == whole).all()


def test_code_is_a_probability(spark):
    _, df = table(spark, 60)
    model = L.learn(df)
    bits = model.cost.reshape(-1, model.symbols, len(model.langs))[:, 1:-1].astype(float) / L.UNIT
    p = (2.0**-bits).sum(1)
    assert (p <= 1.01).all()


def test_languages_share_the_contexts(spark):
    rng = random.Random(4)
    text = lambda letters, n: "".join(rng.choice(letters) for _ in range(n))
    rows = [(i, "big", text("abcdefgh", 400)) for i in range(60)] + [(100 + i, "few", text("wxyz", 400)) for i in range(2)]
    df = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    deep = L.freeze(L.context_counts(df, L.PPMConfig()), L.PPMConfig())
    config = L.PPMConfig(max_contexts=200)
    cut = L.freeze(L.context_counts(df, config), config)
    few = [text("wxyz", 300).encode()]
    assert len(cut.cost) // cut.symbols == 200 < len(deep.cost) // deep.symbols
    assert (cut.lengths(few)[0, cut.langs.index("few")]) == (deep.lengths(few)[0, deep.langs.index("few")])
