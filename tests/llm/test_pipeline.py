import random

import corpus_pipeline

from .test_near_duplicates import corpus, truth


def test_near_duplicate_stage_from_four_fifths_on(spark):
    rng = random.Random(8)
    text = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    rows = []
    for i, (size, more) in enumerate([(1000, 190), (1000, 248), (1000, 250), (300, 60), (120, 28), (120, 30), (24, 5), (24, 6)]):
        base = text(size)
        rows += [(10 * i, " ".join(base)), (10 * i + 1, " ".join(base + text(more)))]
    for i in range(1, 9):  # i of 200 words replaced, far from each other
        base = text(200)
        other = [f"x{k}" if k % 20 == 10 and k < 20 * i else w for k, w in enumerate(base)]
        rows += [(200 + 10 * i, " ".join(base)), (201 + 10 * i, " ".join(other))]
    want = sorted({c for _, _, c in truth(rows, 5, 80)})
    assert len(want) < len({c for _, _, c in truth(rows, 4, 85)}) < len(rows)
    df = spark.createDataFrame([(*r, "en") for r in rows], "doc_id long, text string, lang string")
    got = corpus_pipeline.drop_near_duplicates(spark, df, "").collect()
    assert sorted(r.doc_id for r in got) == want
    assert 1 not in want and 21 in want  # 996 of 1186 shingles, and of 1246


def test_near_duplicate_stage_on_edits(spark):
    rows = [r for r in corpus(5) if r[0] is not None][:350]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = corpus_pipeline.drop_near_duplicates(spark, df, "").collect()
    assert sorted(r.doc_id for r in got) == sorted({c for _, _, c in truth(rows, 5, 80)})


def test_all_stages_on_odd_rows(spark):
    import random

    import corpus_pipeline

    rng = random.Random(5)
    words = {"en": "the of and house water tree under small river green".split(), "de": "der und haus wasser baum unter klein fluss gruen nicht".split()}
    rows = []
    for i in range(60):
        lang = ("en", "de")[i % 2]
        rows.append((i, " ".join(rng.choice(words[lang]) for _ in range(60)), lang, f"src{i % 3}", 0))
    rows += [(100, rows[4][1], "en", "src9", 0), (101, rows[4][1], None, None, None), rows[6], (102, None, "en", "src0", None), (103, "", "en", "src0", 0), (104, "12 345", "de", "src0", 6), (None, "the house and the river under the tree", "en", "src0", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs, seen = df, {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, "").persist()
        seen[name] = docs.collect()
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == df.columns
    ids = lambda name: {r.doc_id for r in seen[name]}
    assert ids("language ID") == {*range(60), 100, 101, None}  # nothing without a letter
    assert ids("n-gram Jaccard join") == {*range(60), None} and len(seen["n-gram Jaccard join"]) == 61
    assert ids("secret scans") == ids("mixing sources to target weights") == ids("best-fit packing") == {*range(60), None}
    empty = df.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        empty = stage(spark, empty, "")
        assert empty.count() == 0
