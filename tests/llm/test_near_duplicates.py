import random
import re
from itertools import combinations

import numpy as np
import pytest

from corpusloom.llm import near_duplicates as nd

C = nd.JaccardConfig()


def truth(rows, words=4, threshold=85):
    sets = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(w[i : i + words]) for i in range(max(1, len(w) - words + 1))} if w else set())
    up = list(range(len(rows)))

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, j in combinations(range(len(rows)), 2):
        if rows[i][0] is not None and rows[j][0] is not None and sets[i] and sets[j]:
            both = len(sets[i] & sets[j])
            if 100 * both >= threshold * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((top(i), top(j)))
                up[b] = a
    best = {}
    for i, (d, _) in enumerate(rows):
        best[top(i)] = min(best.get(top(i), d), d) if d is not None else None
    return sorted(((d, len(s), best[top(i)] if d is not None else None) for i, ((d, _), s) in enumerate(zip(rows, sets))), key=str)


def corpus(seed):
    rng = random.Random(seed)
    word = lambda: rng.choice("abcdefgh") * rng.randint(1, 3) + rng.choice("xyz")
    rows, n = [], 0

    def put(t):
        nonlocal n
        rows.append((1000 - n, t))
        n += 1

    passage = " ".join(word() for _ in range(60))
    for size in (1, 2, 3, 4, 5, 6, 8, 12, 20, 40, 90, 200, 700):
        for _ in range(4):
            base = [word() for _ in range(size)]
            put(" ".join(base))
            for edits in (0, 0, 1, 1, 2, 3, 6, 12, 25):
                w = list(base)
                for _ in range(edits):
                    w[rng.randrange(size)] = word()
                put(rng.choice([" ", "\n", "\t "]).join(w) if edits else " ".join(w).upper())
            put(" ".join(base + [word() for _ in range(max(1, size // 12))]))
            put(" ".join(base) + " " + passage)
    hot = [word() for _ in range(150)]
    for i in range(60):
        w = list(hot)
        for _ in range(i % 7):
            w[rng.randrange(150)] = word()
        put(" ".join(w))
    for odd in ("", None, "   \n", "é É ß", "é É ß", "z" * 5000, "word " * 9000):
        put(odd)
    rows += [rows[0], rows[5], (None, rows[3][1]), (None, None)]
    rng.shuffle(rows)
    return rows


def test_components(spark):
    rows = corpus(3)
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, n_shingles int")
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in nd.link_components(df).collect()), key=str)
    want = truth(rows)
    assert got == want
    assert len({c for _, _, c in want}) < len(want) * 0.8
    assert nd.link_components(df.limit(0)).count() == 0
    kept = nd.keep_one(df).collect()
    assert sorted(r.doc_id for r in kept if r.doc_id is not None) == sorted({c for _, _, c in want if c is not None})
    assert sum(r.doc_id is None for r in kept) == 2


@pytest.mark.parametrize("paired", [1, 5])
def test_all_groups_split_by_differences(spark, paired):
    rows = corpus(4)[:300]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in nd.link_components(df, nd.JaccardConfig(paired=paired, prefer=1e9)).collect()), key=str)
    assert got == truth(rows)


def test_many_near_misses(spark, words=5, threshold=80):
    rng = random.Random(11)
    base, rows = [f"w{i}" for i in range(120)], []
    for i in range(450):  # most differ from the base by more than the threshold allows, some share edits
        w = list(base)
        for _ in range(i % 8):
            w[rng.randrange(120)] = rng.choice("abcde")
        rows.append((i, " ".join(w[: rng.choice([120, 120, 110, 100])])))
    got = nd.link_components(spark.createDataFrame(rows, "doc_id long, text string"), nd.JaccardConfig(words=words, threshold=threshold, spare=0.05)).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == sorted(truth(rows, words, threshold))


def test_columns_of_any_name(spark):
    df = spark.createDataFrame([(1, "a b c d e", 1, 2, 3), (2, "a b c d e", 4, 5, 6), (3, "z", 7, 8, 9), (3, "y", 0, 0, 0)], "doc_id long, text string, `_kept` int, `_row` int, `a.b` int")
    assert sorted(tuple(r) for r in nd.keep_one(df).collect()) == [(1, "a b c d e", 1, 2, 3), (3, "y", 0, 0, 0)]


def test_unlike_sets_share_no_empty_subset():
    rng, shared = np.random.default_rng(5), []
    for spare in (0.0, 0.05):
        bands, seen = nd.Bands(nd.JaccardConfig(words=5, threshold=80, spare=spare)), []
        for _ in range(60):
            s = nd.distinct(rng.integers(0, 1 << 63, 700, dtype=np.uint64))
            seen.append(bands.signatures(s, bands.of(700)))
        n = np.unique(np.concatenate(seen), return_counts=True)[1]
        shared.append(int(n[n > 1].sum()))
    assert shared[1] < shared[0] / 5  # of these sets, few have more such parts than there are spare ones


@pytest.mark.parametrize("spare", [0.0, 0.05, 0.3])
@pytest.mark.parametrize("seed", range(3))
def test_signatures_and_sketches_lose_nothing(seed, spare):
    rng = np.random.default_rng(seed)
    bands = nd.Bands(nd.JaccardConfig(spare=spare))
    for _ in range(300):
        n = int(rng.integers(1, 400))
        a = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
        drop = int(rng.integers(0, max(1, len(a) // 8) + 1))
        b = np.unique(np.concatenate([a[drop:], rng.integers(0, 1 << 63, int(rng.integers(0, len(a) // 10 + 1)), dtype=np.uint64)]))
        common = len(np.intersect1d(a, b))
        if not len(b) or 100 * common < 85 * (len(a) + len(b) - common) or common == len(a) == len(b):
            continue
        top = bands.of(max(len(a), len(b)))
        assert top in bands.tags(len(a)) and top in bands.tags(len(b))
        assert len(np.intersect1d(bands.signatures(a, top), bands.signatures(b, top)))
        x, y = (np.unpackbits(bands.sketch(s).view(np.uint8), bitorder="little") for s in (a, b))
        bits = min(len(x), len(y))
        x, y = (z.reshape(-1, bits).sum(0) % 2 for z in (x, y))
        assert (x != y).sum() <= bands.most(len(a) + len(b))


@pytest.mark.parametrize("spare", [0.0, 0.05, 0.3])
def test_as_many_signatures_are_shared_as_said(spare):
    rng = np.random.default_rng(7)
    bands, least = nd.Bands(nd.JaccardConfig(words=5, threshold=80, spare=spare)), 99
    for _ in range(400):
        n = int(rng.integers(4, 400))
        a = nd.distinct(rng.integers(0, 1 << 63, n, dtype=np.uint64))
        out = int(rng.integers(0, n // 9 + 1))
        b = nd.distinct(np.concatenate([a[out:], rng.integers(0, 1 << 63, int(rng.integers(0, n // 9 + 1)), dtype=np.uint64)]))
        common = len(np.intersect1d(a, b))
        if 100 * common < 80 * (len(a) + len(b) - common) or common == len(a) == len(b):
            continue
        top = bands.of(max(len(a), len(b)))
        shared = len(np.intersect1d(bands.signatures(a, top), bands.signatures(b, top)))
        for s in (a, b):  # what a class of this size counts on, as ``thinned`` does
            both = len(s) + min(bands.bounds(top)[1], len(s) * 100 // 80)
            least = min(least, shared - (bands.shared(top) - both * 20 // 180))
    assert least >= 0


def test_classes_leave_their_largest_groups(spark):
    config = nd.JaccardConfig(words=5, threshold=80, spare=0.3)
    band = nd.Bands(config).of(100)
    share = nd.Bands(config).shared(band) - (100 + min(nd.Bands(config).bounds(band)[1], 125)) * 20 // 180
    sig = lambda i: i << 8 | band
    # class 1 shares signature i with i other classes, which can't do without theirs
    rows = [(sig(i), i + 1, 1, 1) for i in range(1, share + 2)] + [(sig(i), i + 1, 1, 1000 * i + j) for i in range(1, share + 2) for j in range(i)]
    rows += [(sig(500 + c), 9999, share, c) for _, _, _, c in rows if c > 1]
    members = spark.createDataFrame(rows, "sig long, m long, times long, cls long")
    got = nd.thinned(members, members.select("cls").distinct().selectExpr("cls", "100L as n"), config)
    assert sorted(r.sig >> 8 for r in got.where("cls = 1").collect()) == [1, 2]
