from collections import Counter, defaultdict

import numpy as np
import pytest

from corpusloom.llm import mixing
from corpusloom.llm.mixing import MixConfig


@pytest.mark.parametrize("target,limit", [(0.9, 1.5), (0.99, 100.0), (0.5, 2.0), (1.0, 1.0)])
def test_alpha(target, limit):
    tokens = np.array([1000, 300, 200, 10, 5])
    a = mixing.solve_alpha(tokens, target, limit)
    goal = target * np.log(5)
    grid = np.linspace(0, 1, 20001)
    enough = [x for x in grid if mixing.entropy(mixing.weights(tokens, x)) >= goal - 1e-12]
    few = [x for x in grid if mixing.spread(tokens, x) <= limit + 1e-9]
    assert a == pytest.approx(max(max(enough, default=0), min(few)), abs=1e-4)


def table(spark):
    rows = [(i, "one two three" if i % 3 else "w " * (i % 50), "hot") for i in range(400)]
    rows += [(1000 + i, "a b", f"s{i % 4}") for i in range(100)] + [(2000, None, None), (2001, "", None), (None, "x y", "s1")] + [(2002, "same row", "s2")] * 3
    rows += [(3000, "w " * 20_000, "s3")]
    return rows, spark.createDataFrame([(*r, 7) for r in rows], "doc_id long, text string, source string, epoch int")


def test_all_kept(spark):
    rows, df = table(spark)
    out = mixing.mix(df, positions=True).collect()
    words = lambda t: max(1, len((t or "").split()))
    have, budget = Counter(), {}
    for _, t, s in rows:
        have[s] += words(t)
    names = list(have)
    _, w, want = mixing.plan(np.array([have[s] for s in names]), MixConfig())
    budget = dict(zip(names, want))
    shown = Counter()
    copies = defaultdict(Counter)
    for r in out:
        shown[r.source] += words(r.text)
        copies[(r.doc_id, r.text, r.source)][r.epoch] += 1
        assert 0 <= r.mix_order < 1 and r.mix_weight == pytest.approx(dict(zip(names, w))[r.source])
    repeats = Counter(rows)
    assert set(copies) == set(repeats)
    for key, got in copies.items():
        assert got[0] == repeats[key] and set(got) == set(range(len(got))) and set(got.values()) == {repeats[key]}
    for s in names:
        assert shown[s] <= budget[s] and budget[s] - shown[s] <= max(words(t) * 3 for _, t, x in rows if x == s)
    assert sorted((r.doc_id or -1, r.epoch) for r in mixing.mix(df).collect()) == sorted((r.doc_id or -1, r.epoch) for r in out)


def test_budget_and_empty(spark):
    rows, df = table(spark)
    out = mixing.mix(df, MixConfig(budget=300)).collect()
    assert sum(max(1, len((r.text or "").split())) for r in out) <= 300 and out
    assert mixing.mix(df.limit(0)).count() == 0
