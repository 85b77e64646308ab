import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from corpusloom.llm import packing

FILE = public_tokenizers.path("byte_bpe_50k.json")
ENCODER = packing.Encoder(FILE, chunk=500)
TRUTH = Tokenizer.from_file(FILE)


def truth(t):
    return TRUTH.encode(t, add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.text(max_size=40), st.text("ab'srevlmtd 1.\n\té  中<|endoftext|>", max_size=40)), max_size=8))
def test_ids(texts):
    assert [x.tolist() for x in ENCODER.encode(texts)] == [truth(t) for t in texts]


def test_odd_texts():
    texts = ["", " ", "  ", "a  b", "a \n b", "it's 'll they're ''s 'x I'LL x'd'd", "x<|endoftext|>y", "word " * 3000, "q" * 3000, "\x1c\x1f\x85 a", "don't\n\n", " 's", "é" * 70 + " " + "é" * 70]
    assert [x.tolist() for x in ENCODER.encode(texts)] == [truth(t) for t in texts]


def test_forgetting(monkeypatch):
    monkeypatch.setattr(packing.Encoder, "WORDS", 50)
    e = packing.Encoder(FILE, chunk=100)
    texts = [f"word{i} other{i % 7} " * 5 for i in range(100)]
    assert [x.tolist() for x in e.encode(texts)] == [truth(t) for t in texts]


def fill(rows, size):
    used = defaultdict(list)
    for length, _, n, each, first, offset in rows:
        for k in range(n):
            used[first + k // each].append((offset + k % each * length, length))
    for got in used.values():
        at = 0
        for offset, length in sorted(got):
            assert offset == at
            at += length
        assert at <= size
    return used


@pytest.mark.parametrize("seed", range(20))
def test_plan(seed):
    rng = random.Random(seed)
    size = rng.choice([10, 64, 2048])
    counts = {rng.randint(1, size): rng.choice([1, 2, 17, 500]) for _ in range(rng.randint(0, 60))}
    used = fill(packing.best_fit_plan(counts, size), size)
    spaces = []  # plain best fit, longest first
    for length in sorted(counts, reverse=True):
        for _ in range(counts[length]):
            fit = min((i for i, s in enumerate(spaces) if s >= length), key=lambda i: spaces[i], default=None)
            if fit is None:
                spaces.append(size - length)
            else:
                spaces[fit] -= length
    assert len(used) == len(spaces)


def test_pack(spark):
    texts = ["", None, "a b c", "word " * 5000, "x", "x", "long text " * 300]
    df = spark.createDataFrame([(i % 6, t, "z") for i, t in enumerate(texts)], "doc_id long, text string, offset string")
    got = packing.pack(df, FILE, 100, ids=True).collect()
    whole = defaultdict(list)
    for r in got:
        assert zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 and len(r.ids) == r.length
        whole[r.doc_id].append(r)
    for i in range(1, 6):
        rows = sorted(whole[i], key=lambda r: r.piece)
        want = truth(texts[i] or "") + [0]
        assert sum((r.ids for r in rows), []) == want and [r.piece for r in rows] == list(range(len(rows)))
        assert [r.start for r in rows] == np.cumsum([0] + [r.length for r in rows])[:-1].tolist()
        assert all(r.length == 100 for r in rows[1:])
    places = defaultdict(list)
    for r in got:
        places[r.sequence_id].append((r.offset, r.length))
    for x in places.values():
        at = 0
        for offset, length in sorted(x):
            assert offset == at
            at += length
        assert at <= 100
    assert packing.pack(df.limit(0), FILE).count() == 0
