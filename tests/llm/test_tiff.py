import numpy as np
import pytest

from corpusloom.llm import tiff


@pytest.mark.parametrize("order", ["<", ">"])
@pytest.mark.parametrize("compression", [tiff.NONE, tiff.PACKBITS, tiff.LZW, tiff.DEFLATE])
@pytest.mark.parametrize("predictor", [1, 2])
@pytest.mark.parametrize("tile", [None, (16, 32)])
def test_round_trip(order, compression, predictor, tile):
    rng = np.random.default_rng(1)
    pages = [
        rng.integers(0, 4, (37, 61), dtype=np.uint8),
        rng.integers(0, 256, (90, 100, 3), dtype=np.uint8),
        np.zeros((64, 64), np.uint8),
        rng.integers(0, 65536, (20, 9), dtype=np.uint16),
    ]
    data = tiff.write_tiff(pages, compression, predictor, rows=13, tile=tile, order=order)
    got = list(tiff.read_tiff(data))
    assert [(p.height, p.width, p.samples, p.bits) for p in got] == [(37, 61, 1, 8), (90, 100, 3, 8), (64, 64, 1, 8), (20, 9, 1, 16)]
    assert [p.pixels for p in got] == [x.tobytes() for x in pages]


@pytest.mark.parametrize("n", [0, 1, 2, 255, 256, 3000, 4000, 60_000])
def test_codecs(n):
    rng = np.random.default_rng(n)
    for data in (bytes(n), rng.integers(0, 256, n, dtype=np.uint8).tobytes(), rng.integers(0, 3, n, dtype=np.uint8).tobytes()):
        assert tiff.unlzw(tiff.lzw(data), n + 1) == data
        assert tiff.unpackbits(tiff.packbits(data), n + 1) == data


def tagged(**tags):
    """A one-page TIFF of 2 x 2 samples whose tags are replaced or added: (type, values)."""
    entries = {256: (3, [2]), 257: (3, [2]), 258: (3, [8]), 259: (3, [1]), 273: (4, [8]), 277: (3, [1]), 278: (3, [2]), 279: (4, [4])}
    entries |= {int(k[1:]): v for k, v in tags.items()}
    out = b"II*\0" + (12).to_bytes(4, "little") + b"\1\2\3\4" + len(entries).to_bytes(2, "little")
    for tag, (kind, values) in sorted(entries.items()):
        packed = b"".join(np.float32(v).tobytes() if kind == 11 else int(v).to_bytes(2 if kind == 3 else 4 if kind == 4 else 1, "little") for v in values)
        out += tag.to_bytes(2, "little") + kind.to_bytes(2, "little") + len(values).to_bytes(4, "little") + packed.ljust(4, b"\0")
    return out + bytes(4)


DAMAGE = [tagged(t256=(3, [0])), tagged(t256=(2, [65])), tagged(t256=(3, [])), tagged(t256=(11, [2.0])), tagged(t266=(3, [2])), tagged(t262=(3, [0])), tagged(t279=(4, [999])), tagged(t278=(3, [0])), tagged(t259=(3, [5])), tagged(t259=(3, [8])), tagged(t259=(3, [77])), b"", b"II*\0", b"GIF89a"]


def test_damage_gives_an_error_row(spark):
    good = tagged()
    rows = [(i, bytearray(x)) for i, x in enumerate([*DAMAGE, good, good[:20], good[:8] + b"\xff" * (len(good) - 8)])]
    got = {r.id: r for r in tiff.tiff_pages(spark.createDataFrame(rows, "id long, content binary")).collect()}
    assert len(got) == len(rows) and bytes(got[len(DAMAGE)].pixels) == b"\1\2\3\4"
    assert all(r.page is None and r.error for i, r in got.items() if i != len(DAMAGE))


def test_fixed_bytes():
    """Codecs against bytes worked out by hand: PackBits runs, and the LZW codes of the specification's way of writing them."""
    packed = bytes([254, 170, 2, 128, 0, 42, 253, 170, 3, 128, 0, 42, 34, 247, 170])
    assert tiff._unpack(packed, tiff.PACKBITS, 24) == bytes([170] * 3 + [128, 0, 42] + [170] * 4 + [128, 0, 42, 34] + [170] * 10)
    codes = [256, 7, 258, 8, 8, 258, 6, 6, 257]  # clear, 7, 7 7, 8, 8, 7 7, 6, 6, end
    bits = "".join(f"{c:09b}" for c in codes)
    packed = int(bits.ljust(-(-len(bits) // 8) * 8, "0"), 2).to_bytes(-(-len(bits) // 8), "big")
    assert tiff._unpack(packed, tiff.LZW, 9) == bytes([7, 7, 7, 8, 8, 7, 7, 6, 6])


def test_operator(spark):
    two = tiff.write_tiff([np.ones((2, 3), np.uint8), np.zeros((1, 1), np.uint8)], tiff.PACKBITS)
    df = spark.createDataFrame([(1, two, "x"), (1, two, "x"), (2, None, None), (3, bytearray(b"junk"), "y")], "id long, content binary, page string")
    rows = tiff.tiff_pages(df).orderBy("id", "page").collect()
    assert [(r.id, r.page, r.width, r.height) for r in rows] == [(1, 0, 3, 2), (1, 0, 3, 2), (1, 1, 1, 1), (1, 1, 1, 1), (2, None, None, None), (3, None, None, None)]
    assert bytes(rows[0].pixels) == b"\1" * 6 and rows[-1].error == "not a TIFF"
    assert tiff.tiff_pages(df.limit(0)).count() == 0


def test_texts(spark):
    texts = ["", None, "a" * 64, "é" * 5000, "x"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in tiff.tiff_pages(tiff.text_to_tiff(df)).collect()}
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        assert got[i].n_bytes == len(raw)
        assert bytes(got[i].pixels) == raw + bytes((max(1, -(-len(raw) // 64)) * 64) - len(raw))
