"""TIFF as a media column: a writer, a reader, and an operator that emits one row a page.

The reader walks the chain of image directories, decodes uncompressed, PackBits, LZW and deflate
strips or tiles, undoes the horizontal predictor and joins the parts. 8- and 16-bit samples,
chunky, of any number per pixel and either byte order are read; other files give an error row.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import small_batches

# Fixed values of the TIFF 6.0 format.
NONE, LZW, DEFLATE, OLD_DEFLATE, PACKBITS = 1, 5, 8, 32946, 32773
WIDTH, LENGTH, BITS, COMPRESSION, PHOTOMETRIC, OFFSETS, SAMPLES, ROWS, COUNTS, PLANAR, PREDICTOR, TILE_WIDTH, TILE_LENGTH, TILE_OFFSETS, TILE_COUNTS = 256, 257, 258, 259, 262, 273, 277, 278, 279, 284, 317, 322, 323, 324, 325
FILL_ORDER = 266
SIZES = {1: ("B", 1), 2: ("s", 1), 3: ("H", 2), 4: ("I", 4), 5: ("II", 8), 6: ("b", 1), 7: ("s", 1), 8: ("h", 2), 9: ("i", 4), 10: ("ii", 8), 11: ("f", 4), 12: ("d", 8)}


@dataclass
class Page:
    width: int
    height: int
    samples: int
    bits: int
    compression: int
    predictor: int
    pixels: bytes


def packbits(data: bytes) -> bytes:
    """Runs of three or more equal bytes become repeats; the rest is literal."""
    out, at, n, begin = bytearray(), 0, len(data), 0

    def literal(end: int) -> None:
        for a in range(begin, end, 128):
            part = data[a : min(a + 128, end)]
            out.append(len(part) - 1)
            out.extend(part)

    while at < n:
        run = 1
        while run < 128 and at + run < n and data[at + run] == data[at]:
            run += 1
        if run >= 3:
            literal(at)
            out += bytes((257 - run, data[at]))
            begin = at + run
        at += run
    literal(n)
    return bytes(out)


def unpackbits(data: bytes, size: int) -> bytes:
    out, at = bytearray(), 0
    while at < len(data) and len(out) < size:
        head = data[at]
        if head < 128:
            out += data[at + 1 : at + 2 + head]
            at += 2 + head
        else:
            if head > 128:
                out += data[at + 1 : at + 2] * (257 - head)
            at += 2 if head > 128 else 1
    return bytes(out)


CLEAR, END = 256, 257


def lzw(data: bytes) -> bytes:
    """Codes of 9 to 12 bits, high bit first; the width grows one code early, as the format asks."""
    out, held, count = bytearray(), 0, 0

    def put(code: int, width: int) -> None:
        nonlocal held, count
        held, count = held << width | code, count + width
        while count >= 8:
            count -= 8
            out.append(held >> count & 255)
        held &= (1 << count) - 1

    seen: dict[bytes, int] = {}
    width, word, following = 9, b"", 258
    put(CLEAR, 9)
    for b in data:
        longer = word + bytes((b,))
        if len(longer) == 1 or longer in seen:
            word = longer
            continue
        put(seen[word] if len(word) > 1 else word[0], width)
        seen[longer] = following
        following += 1
        word = longer[-1:]
        if following == 4094:
            put(CLEAR, width)
            seen, width, following = {}, 9, 258
        elif following + 1 > 1 << width:
            width += 1
    if word:
        put(seen[word] if len(word) > 1 else word[0], width)
        following += 1
        if following + 1 > 1 << width and width < 12:
            width += 1
    put(END, width)
    if count:
        out.append(held << 8 - count & 255)
    return bytes(out)


def unlzw(data: bytes, size: int) -> bytes:
    out, words, width, held, count, before = bytearray(), [], 9, 0, 0, b""
    roots = [bytes((i,)) for i in range(256)] + [b"", b""]
    for byte in data:
        held, count = held << 8 | byte, count + 8
        if count < width:
            continue
        count -= width
        code, held = held >> count, held & (1 << count) - 1
        if code == END:
            break
        if code == CLEAR:
            words, width, before = list(roots), 9, b""
            continue
        if not words or code > len(words) or code == len(words) and not before:
            raise ValueError("bad LZW code")
        word = words[code] if code < len(words) else before + before[:1]
        out += word
        if before:
            words.append(before + word[:1])
        before = word
        if len(words) + 1 >= 1 << width and width < 12:
            width += 1
        if len(out) >= size:
            break
    return bytes(out)


def _pack(data: bytes, compression: int) -> bytes:
    return {NONE: bytes, PACKBITS: packbits, LZW: lzw, DEFLATE: lambda x: zlib.compress(x, 1)}[compression](data)


def _unpack(data: bytes, compression: int, size: int) -> bytes:
    if compression == NONE:
        return data
    if compression in (DEFLATE, OLD_DEFLATE):
        return zlib.decompressobj().decompress(data, size)
    if compression == LZW:
        return unlzw(data, size)
    if compression == PACKBITS:
        return unpackbits(data, size)
    raise ValueError(f"compression {compression} isn't supported")


def write_tiff(pages: list[np.ndarray], compression: int = DEFLATE, predictor: int = 2, rows: int = 256, tile: tuple[int, int] | None = None, order: str = "<") -> bytes:
    """A TIFF of ``pages`` (height, width[, samples]; uint8 or uint16) in strips of ``rows`` rows or in tiles."""
    out = bytearray((b"II" if order == "<" else b"MM") + struct.pack(order + "HI", 42, 0))
    link = 4
    for image in pages:
        image = image if image.ndim == 3 else image[:, :, None]
        height, width, samples = image.shape
        bits = image.dtype.itemsize * 8
        if tile:
            th, tw = tile
            grid = np.zeros((-(-height // th) * th, -(-width // tw) * tw, samples), image.dtype)
            grid[:height, :width] = image
            parts = [grid[y : y + th, x : x + tw] for y in range(0, grid.shape[0], th) for x in range(0, grid.shape[1], tw)]
        else:
            parts = [image[y : y + rows] for y in range(0, height, rows)]
        offsets, counts = [], []
        for part in parts:
            if predictor == 2:
                part = np.concatenate([part[:, :1], part[:, 1:] - part[:, :-1]], axis=1)
            raw = _pack(np.ascontiguousarray(part.astype(part.dtype.newbyteorder(order))).tobytes(), compression)
            offsets.append(len(out)), counts.append(len(raw))
            out += raw + b"\0" * (len(raw) % 2)
        entries = [(WIDTH, 4, [width]), (LENGTH, 4, [height]), (BITS, 3, [bits] * samples), (COMPRESSION, 3, [compression]), (PHOTOMETRIC, 3, [2 if samples == 3 else 1]), (SAMPLES, 3, [samples]), (PLANAR, 3, [1]), (PREDICTOR, 3, [predictor])]
        entries += [(TILE_WIDTH, 4, [tile[1]]), (TILE_LENGTH, 4, [tile[0]]), (TILE_OFFSETS, 4, offsets), (TILE_COUNTS, 4, counts)] if tile else [(OFFSETS, 4, offsets), (ROWS, 4, [rows]), (COUNTS, 4, counts)]
        entries.sort()
        struct.pack_into(order + "I", out, link, len(out))
        begin = len(out)
        out += struct.pack(order + "H", len(entries))
        extra = begin + 2 + 12 * len(entries) + 4
        tail = bytearray()
        for tag, kind, values in entries:
            code = SIZES[kind][0]
            data = struct.pack(f"{order}{len(values)}{code}", *values)
            if len(data) > 4:
                out += struct.pack(order + "HHII", tag, kind, len(values), extra + len(tail))
                tail += data + b"\0" * (len(data) % 2)
            else:
                out += struct.pack(order + "HHI", tag, kind, len(values)) + data.ljust(4, b"\0")
        link = len(out)
        out += b"\0\0\0\0" + tail
    return bytes(out)


def _directory(data: bytes, order: str, at: int) -> tuple[dict[int, list[int]], int]:
    """Tags of the image directory at ``at``, and the place of the next one."""
    (count,) = struct.unpack_from(order + "H", data, at)
    tags = {}
    for i in range(count):
        tag, kind, n = struct.unpack_from(order + "HHI", data, at + 2 + 12 * i)
        if kind not in SIZES:
            continue
        code, size = SIZES[kind]
        place = at + 2 + 12 * i + 8
        if n * size > 4:
            (place,) = struct.unpack_from(order + "I", data, place)
        if place + n * size > len(data):
            raise ValueError("a tag's values lie outside the file")
        tags[tag] = list(struct.unpack_from(f"{order}{n * len(code)}{code[0]}", data, place)) if code != "s" else []
    return tags, struct.unpack_from(order + "I", data, at + 2 + 12 * count)[0]


def read_tiff(data: bytes) -> Iterator[Page]:
    """The pages of a TIFF, in the order of their directories; ValueError or struct.error if it is damaged."""
    if data[:4] not in (b"II*\0", b"MM\0*"):
        raise ValueError("not a TIFF")
    order = "<" if data[:2] == b"II" else ">"
    (at,) = struct.unpack_from(order + "I", data, 4)
    seen = set()
    while at:
        if at in seen:
            raise ValueError("the directories form a ring")
        seen.add(at)
        tags, at = _directory(data, order, at)
        if WIDTH not in tags or LENGTH not in tags:
            raise ValueError("a page without a size")
        for tag in (WIDTH, LENGTH, SAMPLES, BITS, ROWS, TILE_WIDTH, TILE_LENGTH, COMPRESSION, PREDICTOR, PLANAR, FILL_ORDER, PHOTOMETRIC, OFFSETS, COUNTS, TILE_OFFSETS, TILE_COUNTS):
            values = tags.get(tag, [1])
            if not values or not all(isinstance(v, int) and v >= 0 for v in values) or tag in (WIDTH, LENGTH, SAMPLES, ROWS, TILE_WIDTH, TILE_LENGTH) and values[0] < 1:
                raise ValueError(f"tag {tag} holds no usable number")
        one = lambda tag, default: tags.get(tag, [default])[0]
        if one(FILL_ORDER, 1) != 1 or one(PHOTOMETRIC, 1) == 0:
            raise ValueError("reversed bits and white as zero aren't supported")
        width, height, samples, bits = one(WIDTH, 0), one(LENGTH, 0), one(SAMPLES, 1), one(BITS, 1)
        compression, predictor = one(COMPRESSION, NONE), one(PREDICTOR, 1)
        if bits not in (8, 16) or set(tags.get(BITS, [bits])) != {bits} or one(PLANAR, 1) != 1 or predictor not in (1, 2):
            raise ValueError("sample layout isn't supported")
        tiled = TILE_OFFSETS in tags
        rows = one(TILE_LENGTH, height) if tiled else min(one(ROWS, height), height)
        across = one(TILE_WIDTH, width) if tiled else width
        kind = np.dtype(f"u{bits // 8}").newbyteorder(order)
        if max(rows, 1) * across * samples * bits // 8 > 1 << 31 or height * width * samples * bits // 8 > 1 << 31:
            raise ValueError("the page is too large")
        page = np.zeros((height, width, samples), kind.newbyteorder("<"))
        places = list(zip(tags.get(TILE_OFFSETS if tiled else OFFSETS, []), tags.get(TILE_COUNTS if tiled else COUNTS, [])))
        columns = -(-width // across) if across else 0
        if rows and len(places) < columns * -(-height // rows):
            raise ValueError("strips or tiles are missing")
        for i, (offset, count) in enumerate(places):
            y, x = i // columns * rows, i % columns * across
            if y >= height:
                break
            high = rows if tiled else min(rows, height - y)
            size = high * across * samples * kind.itemsize
            if offset + count > len(data):
                raise ValueError("a strip lies outside the file")
            raw = _unpack(data[offset : offset + count], compression, size)
            if len(raw) < size:
                raise ValueError("a strip is too short")
            part = np.frombuffer(raw, kind, high * across * samples).reshape(high, across, samples)
            if predictor == 2:
                part = np.cumsum(part, axis=1, dtype=kind.newbyteorder("="))
            page[y : y + high, x : x + across] = part[: height - y, : width - x]
        yield Page(width, height, samples, bits, compression, predictor, page.tobytes())


PAGE_FIELDS = "page int, width long, height long, samples int, bits int, compression int, predictor int, histogram array<bigint>, pixels binary, error string"


def tiff_pages(df: DataFrame, content: str = "content") -> DataFrame:
    """One row for each page of every TIFF in column ``content``, beside the row's other columns.

    ``pixels`` holds the samples row by row (16-bit ones low byte first), ``histogram`` how many
    bytes of it fall in each sixteenth of the byte range. A null, empty or damaged file gives the
    pages before the damage and one row with page null and ``error`` set. Columns with the names
    of the new ones are replaced.
    """
    small_batches(df.sparkSession)
    names = [x.split()[0] for x in PAGE_FIELDS.split(", ")]
    df = df.drop(*(n for n in names if n != content))
    fields = ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in df.schema.fields if f.name != content)
    kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.binary(), pa.string()]

    def rows(data: bytes | None) -> Iterator[tuple]:
        try:
            for i, p in enumerate(read_tiff(data or b"")):
                bars = np.bincount(np.frombuffer(p.pixels, np.uint8) >> 4, minlength=16)
                yield i, p.width, p.height, p.samples, p.bits, p.compression, p.predictor, bars.tolist(), p.pixels, None
        except (ValueError, IndexError, OverflowError, struct.error, zlib.error) as e:
            yield (None,) * 9 + (str(e),)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index(content)
            source, got, held = [], [], 0

            def flush() -> pa.RecordBatch:
                rest = batch.take(pa.array(source, pa.int64()))
                columns = [c for i, c in enumerate(rest.columns) if i != at] + [pa.array(x, k) for x, k in zip(zip(*got), kinds)]
                return pa.RecordBatch.from_arrays(columns, names=[n for i, n in enumerate(batch.schema.names) if i != at] + names)

            for i, data in enumerate(batch.column(at).to_pylist()):
                for row in rows(data):
                    source.append(i), got.append(row)
                    held += len(row[8] or b"")
                    if held > 1 << 24:
                        yield flush()
                        source, got, held = [], [], 0
            if got:
                yield flush()

    return df.mapInArrow(run, f"{fields}, {PAGE_FIELDS}" if fields else PAGE_FIELDS)


def text_to_tiff(df: DataFrame, text: str = "text", out: str = "content", width: int = 64) -> DataFrame:
    """Replace column ``text`` by ``n_bytes`` (of its UTF-8) and ``out``, a one-page TIFF that holds it.

    The page is ``width`` samples wide; zero bytes fill its last row, and a null or empty text
    gives one row of zeros. Equal texts give equal files.
    """
    small_batches(df.sparkSession)
    df = df.drop("n_bytes", *([out] if out != text else []))
    fields = ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in df.schema.fields if f.name != text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index(text)
            raw = [(t or "").encode("utf-8", "surrogatepass") for t in batch.column(at).to_pylist()]
            files = [write_tiff([np.frombuffer(r.ljust(max(1, -(-len(r) // width)) * width, b"\0"), np.uint8).reshape(-1, width)]) for r in raw]
            columns = [c for i, c in enumerate(batch.columns) if i != at] + [pa.array(map(len, raw), pa.int64()), pa.array(files, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=[n for i, n in enumerate(batch.schema.names) if i != at] + ["n_bytes", out])

    return df.mapInArrow(run, f"{fields + ', ' if fields else ''}n_bytes long, `{out}` binary")
