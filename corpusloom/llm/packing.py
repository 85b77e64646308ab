"""Best-fit packing by a plan over the length histogram.

Documents become token ids with an end id, and only documents longer than a sequence are cut. How
many pieces there are of each length is all the planner needs: best fit, longest first, places
whole runs of equally long pieces into runs of equally filled sequences. Pieces then take the
planned places by joining on their rank within their length.
"""

from __future__ import annotations

import bisect
import json
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, buckets_for, running, small_batches

LETTER, NUMBER, SPACE = 1, 2, 3
#: A plan of more rows is joined by shuffle instead of a broadcast.
BROADCAST_PLAN = 200_000


def byte_of_character() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Encoder:
    """Token ids of the byte-level BPE tokenizer in ``file``, for many texts at a time.

    Texts are split into the tokenizer's words with array operations, and each distinct word is
    encoded once (as long as it is remembered). Texts that hold a special token's string go
    through the tokenizers library itself.
    """

    WORDS = 1_500_000  # remembered words
    MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)

    def __init__(self, file: str, chunk: int = 1 << 20):
        import regex
        import tiktoken
        from tokenizers import Tokenizer

        with open(file, encoding="utf-8") as f:
            spec = json.load(f)
        self.own = Tokenizer.from_file(file)
        special = [t["content"] for t in spec.get("added_tokens", [])]
        self.special = re.compile("|".join(map(re.escape, special))) if special else None
        of = byte_of_character()
        ranks = {bytes(of[c] for c in word): i for word, i in spec["model"]["vocab"].items() if word not in special}
        # Fixed value: the word pattern of this vocabulary.
        pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        self.bpe = tiktoken.Encoding("words", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
        self.kind = np.zeros(0x110000, np.uint8)
        for kind, chars in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\p{White_Space}+")):
            for m in regex.finditer(chars, every):
                self.kind[ord(m[0][0]) : ord(m[0][-1]) + 1] = kind
        self.kind[0xD800:0xE000] = 0
        self.chunk = chunk
        b, inverse = 0x9E3779B97F4A7C15 | 1, pow(0x9E3779B97F4A7C15 | 1, -1, 1 << 64)
        self.base, self.inverse = np.uint64(b), np.uint64(inverse)
        self.powers = self.unpowers = np.ones(1, np.uint64)
        self._forget()

    def _forget(self) -> None:
        self.hashes = np.zeros(0, np.uint64)  # sorted; slots go with them
        self.slots = np.zeros(0, np.int64)
        self.fresh: dict[int, int] = {}
        self.flat, self.begin, self.count = array("I"), array("q"), array("q")

    def _starts(self, chars: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Where the words of the joined texts begin; ``first`` marks the texts' first characters."""
        kind = self.kind[chars]
        n = len(chars)
        turn = np.ones(n, bool)
        turn[1:] = (kind[1:] != kind[:-1]) | first[1:]
        blank = kind == SPACE
        starts = turn.copy()
        run_ends = np.zeros(n, bool)  # a run's last character, if the text goes on after it
        run_ends[:-1] = turn[1:] & ~first[1:]
        starts |= run_ends & blank
        after_space = np.zeros(n, bool)
        after_space[1:] = (chars[:-1] == 32) & ~first[1:]
        starts &= ~(turn & ~blank & after_space)
        quote = np.flatnonzero((chars == 39) & starts)
        if len(quote):
            quote = quote[quote + 1 < n]
            quote = quote[(kind[quote + 1] == LETTER) & ~first[quote + 1]]
            for q in quote.tolist():
                c = chr(chars[q + 1])
                size = 2 if c in "stmd" else 0
                if c in "rvl" and q + 2 < n and not first[q + 2] and c + chr(chars[q + 2]) in ("re", "ve", "ll"):
                    size = 3
                if size:
                    starts[q + 1] = False
                    if q + size < n and kind[q + size] == LETTER and not first[q + size]:
                        starts[q + size] = True
        return np.flatnonzero(starts)

    def _word_hashes(self, chars: np.ndarray, at: np.ndarray, ends: np.ndarray) -> np.ndarray:
        n = len(chars)
        if len(self.powers) < n:
            with np.errstate(over="ignore"):
                grown = np.full(n, self.base, np.uint64)
                grown[0] = 1
                self.powers = np.multiply.accumulate(grown)
                grown = np.full(n, self.inverse, np.uint64)
                grown[0] = 1
                self.unpowers = np.multiply.accumulate(grown)
        with np.errstate(over="ignore"):
            value = (chars.astype(np.uint64) + np.uint64(1)) * np.uint64(0xBF58476D1CE4E5B9)
            value ^= value >> np.uint64(31)
            sums = np.zeros(n + 1, np.uint64)
            np.cumsum(value * self.powers[:n], out=sums[1:])
            h = (sums[ends] - sums[at]) * self.unpowers[at]
            h ^= (ends - at).astype(np.uint64) * np.uint64(0x94D049BB133111EB)
            h ^= h >> np.uint64(29)
            h *= np.uint64(0xBF58476D1CE4E5B9)
            h ^= h >> np.uint64(32)
        for i in np.flatnonzero(ends - at > 64).tolist():  # long words get a stronger hash
            h[i] = xxhash.xxh3_64_intdigest(chars[at[i] : ends[i]].tobytes())
        return h

    def _slots_of(self, distinct: np.ndarray, example: np.ndarray, joined: str, at: np.ndarray, ends: np.ndarray) -> np.ndarray:
        out = np.full(len(distinct), -1, np.int64)
        if len(self.hashes):
            near = np.searchsorted(self.hashes, distinct)
            near[near == len(self.hashes)] = 0
            hit = self.hashes[near] == distinct
            out[hit] = self.slots[near[hit]]
        for i in np.flatnonzero(out < 0).tolist():
            h = int(distinct[i])
            slot = self.fresh.get(h)
            if slot is None:
                t = example[i]
                ids = self.bpe.encode_ordinary(joined[at[t] : ends[t]])
                slot = self.fresh[h] = len(self.begin)
                self.begin.append(len(self.flat))
                self.count.append(len(ids))
                self.flat.extend(ids)
            out[i] = slot
        return out

    def _chunk(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        joined = "".join(texts)
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        if not joined:
            return np.zeros(0, np.uint32), np.zeros(len(texts), np.int64)
        if len(self.begin) > self.WORDS:
            self._forget()
        chars = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), "<u4")
        text_at = np.cumsum(sizes) - sizes
        first = np.zeros(len(chars) + 1, bool)
        first[text_at] = True
        at = self._starts(chars, first[:-1])
        ends = np.append(at[1:], len(chars))
        distinct, example, which = np.unique(self._word_hashes(chars, at, ends), return_index=True, return_inverse=True)
        slots = self._slots_of(distinct, example, joined, at, ends)[which]
        begin, count = np.array(self.begin, np.int64)[slots], np.array(self.count, np.int64)[slots]
        if len(self.fresh) > 100_000:
            h = np.fromiter(self.fresh.keys(), np.uint64, len(self.fresh))
            s = np.fromiter(self.fresh.values(), np.int64, len(self.fresh))
            h, s = np.concatenate([self.hashes, h]), np.concatenate([self.slots, s])
            order = np.argsort(h)
            self.hashes, self.slots, self.fresh = h[order], s[order], {}
        total = np.concatenate([[0], np.cumsum(count)])
        ids = np.array(self.flat, np.uint32)[np.repeat(begin - total[:-1], count) + np.arange(total[-1])]
        words = np.searchsorted(at, np.append(text_at, len(chars)))
        return ids, np.diff(total[words])

    def _parts(self, text: str) -> list[str]:
        """A very long text, cut where the pattern is sure to begin a word."""
        parts, at = [], 0
        cut = re.compile(r"(?<=[a-z]) (?=[a-z])")
        while len(text) - at > 2 * self.chunk:
            m = cut.search(text, at + self.chunk)
            if not m:
                break
            parts.append(text[at : m.start()])
            at = m.start()
        return [*parts, text[at:]]

    def encode(self, texts: list[str]) -> Iterator[np.ndarray]:
        """The ids of each text, in order."""
        group: list[str] = []
        held = 0

        def flush() -> Iterator[np.ndarray]:
            ids, counts = self._chunk(group)
            yield from np.split(ids, np.cumsum(counts)[:-1])

        for t in texts:
            odd = self.special and self.special.search(t)
            if group and (held + len(t) > self.chunk or odd):
                yield from flush()
                group, held = [], 0
            if odd:
                yield np.array(self.own.encode(t, add_special_tokens=False).ids, np.uint32)
            elif len(t) > 2 * self.chunk:
                yield np.concatenate([self._chunk([p])[0] for p in self._parts(t)])
            else:
                group.append(t)
                held += len(t)
        if group:
            yield from flush()


_encoders: dict[str, Encoder] = {}


def pieces(df: DataFrame, tokenizer: str, size: int = 2048, end_id: int = 0, text: str = "text", ids: bool = False) -> DataFrame:
    """Each row's text as token ids with ``end_id`` after them, in pieces of at most ``size``.

    ``text`` is replaced by piece (from 0), start (the document's ids before it), length and
    ids_crc32 (of the ids as unsigned little-endian 32-bit numbers), and with ``ids`` the ids
    themselves. Only longer documents are cut: the first piece takes what is over, the others are
    full. A null or empty text is the end id alone. Other columns and repeated rows stay.
    """
    small_batches(df.sparkSession)
    new = ["piece", "start", "length", "ids_crc32"] + ["ids"] * ids
    df = df.drop(*(n for n in new if n != text))
    kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64()] + [pa.list_(pa.int64())] * ids
    fields = "".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}, " for f in df.schema.fields if f.name != text)
    schema = f"{fields}piece int, start long, length long, ids_crc32 long" + ", ids array<bigint>" * ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if tokenizer not in _encoders:
            _encoders[tokenizer] = Encoder(tokenizer)
        encoder = _encoders[tokenizer]
        for batch in batches:
            at = batch.schema.get_field_index(text)
            source, rows = [], []
            for i, got in enumerate(encoder.encode([t or "" for t in batch.column(at).to_pylist()])):
                got = np.append(got, np.uint32(end_id)).astype("<u4")
                first = len(got) % size or size
                cuts = [0, *range(min(first, len(got)), len(got) + 1, size)]
                for p, (a, b) in enumerate(zip(cuts, cuts[1:])):
                    source.append(i)
                    rows.append((p, a, b - a, zlib.crc32(got[a:b].tobytes())) + ((got[a:b].tolist(),) if ids else ()))
            rest = batch.take(pa.array(source, pa.int64()))
            columns = [c for i, c in enumerate(rest.columns) if i != at] + [pa.array(list(x), k) for x, k in zip(zip(*rows), kinds)]
            if rows:
                yield pa.RecordBatch.from_arrays(columns, names=[n for i, n in enumerate(batch.schema.names) if i != at] + new)

    return df.mapInArrow(run, schema)


def best_fit_plan(counts: dict[int, int], size: int) -> list[tuple[int, int, int, int, int, int]]:
    """Best fit, longest first, over ``counts`` pieces of each length.

    Rows (length, rank, pieces, each, sequence, offset): the ``pieces`` pieces of that length from
    ``rank`` on go to sequences from ``sequence`` on, ``each`` to a sequence, from ``offset``. The
    work and the rows depend on the distinct lengths only, not on how many pieces there are.
    """
    room: dict[int, list[tuple[int, int]]] = {}  # free space -> runs (first sequence, sequences)
    spaces: list[int] = []
    rows, sequences = [], 0

    def leave(space: int, first: int, n: int) -> None:
        if space and n:
            if space not in room:
                room[space] = []
                bisect.insort(spaces, space)
            room[space].append((first, n))

    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        while left:
            i = bisect.bisect_left(spaces, length)
            if i < len(spaces):
                space = spaces[i]
                first, n = room[space].pop()
                if not room[space]:
                    del room[space], spaces[i]
            else:
                space, first, n = size, sequences, -(-left // (size // length))
                sequences += n
            each = space // length
            whole = min(n, left // each)
            if whole:
                rows.append((length, rank, whole * each, each, first, size - space))
                leave(space - each * length, first, whole)
                rank, left = rank + whole * each, left - whole * each
            if left and whole < n:
                rows.append((length, rank, left, left, first + whole, size - space))
                leave(space - left * length, first + whole, 1)
                whole, left = whole + 1, 0
            leave(space, first + whole, n - whole)
    return rows


def pack(df: DataFrame, tokenizer: str, size: int = 2048, end_id: int = 0, ident: str = "doc_id", text: str = "text", ids: bool = False) -> DataFrame:
    """Pack rows (``ident``, ``text``) into sequences of at most ``size`` ids.

    Returns ident, piece, start, length, ids_crc32, sequence_id, offset (and ids), one row for each
    piece. Null or repeated idents are documents like all others; null texts count as empty. An
    empty table gives no rows.
    """
    spark = df.sparkSession
    scratch = Scratch(spark, "pack")
    cut = scratch.keep(pieces(df.select(F.col(f"`{ident}`"), F.col(f"`{text}`").alias("_text")), tokenizer, size, end_id, "_text", ids))
    counts = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most size rows
    rows = best_fit_plan(counts, size)
    planned = spark.createDataFrame(rows, "length long, _rank long, _pieces long, _each long, _first long, _from long")
    planned = F.broadcast(planned) if len(rows) <= BROADCAST_PLAN else planned
    ranked = running(cut, ["length"], [f"`{ident}`", "piece"], F.lit(1), "_place", buckets_for(sum(counts.values()) // max(len(counts), 1)))
    k = F.col("_place") - F.col("_rank")
    out = ranked.join(planned, "length").where((k >= 0) & (k < F.col("_pieces")))
    sequence = F.col("_first") + F.floor(k / F.col("_each"))
    offset = F.col("_from") + (k % F.col("_each")) * F.col("length")
    return out.select(f"`{ident}`", "piece", "start", "length", "ids_crc32", sequence.cast("long").alias("sequence_id"), offset.cast("long").alias("offset"), *(["ids"] * ids))
