"""Language identification by prediction by partial matching (PPM).

For every language a variable-order byte context tree is counted over labelled texts and then
frozen. The code length of a text under a language is the sum, over its bytes, of minus the log
of the byte's probability in the longest known context, with PPM's escape (method C, with
exclusion) to shorter contexts and at last to a uniform byte. The shortest code wins.

Contexts of all trees share one automaton: a context is looked up by the last ``order`` bytes,
so scoring a batch is two gathers a byte, whatever the number of languages.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, shield, small_batches, unshield

UNKNOWN = "und"
#: More labels than this aren't languages; it bounds what is broadcast about them.
MAX_LANGUAGES = 1000


@dataclass(frozen=True)
class PPMConfig:
    """``sample_rows``: the most labelled rows of one language that are learned from.
    ``order``: bytes in the longest context. ``min_count``: contexts seen less often are left out.
    ``classes``: the most distinct byte values that get a symbol; the rest share the escape to a
    uniform byte. ``max_contexts``: the most contexts kept, which bounds the broadcast tables."""

    sample_rows: int = 1500
    order: int = 3
    min_count: int = 4
    classes: int = 160
    max_contexts: int = 40_000
    batch_bytes: int = 1 << 20


#: Code lengths are kept in this fraction of a bit, as integers, so that sums are exact.
UNIT = 1024


@dataclass
class PPMModel:
    """Frozen statistics: ``cost[state * symbols + symbol, language]`` in 1/UNIT bits."""

    langs: list[str]
    symbol: np.ndarray
    state: np.ndarray
    cost: np.ndarray
    symbols: int
    order: int

    def lengths(self, texts: list[bytes]) -> np.ndarray:
        """Exact code lengths, in 1/UNIT bits, of each text under each language."""
        pad = self.order
        out = np.zeros((len(texts), len(self.langs)), np.int64)
        sizes = np.fromiter((len(t) for t in texts), np.int64, len(texts))
        if not sizes.sum() or not self.langs:
            return out
        joined = np.frombuffer((b"\0" * pad).join([b"", *texts]), np.uint8)
        sym = self.symbol[joined]
        ends = np.cumsum(sizes + pad)
        starts = ends - sizes
        edge = (starts[:, None] - 1 - np.arange(pad)).ravel()
        sym[edge] = 0  # the start of a text is a symbol of its own
        key = np.zeros(len(sym) - pad, np.int64)
        for back in range(pad, 0, -1):
            key *= self.symbols
            key += sym[pad - back : len(sym) - back]
        cost = self.cost[self.state[key] * self.symbols + sym[pad:]]
        cost[edge[edge >= pad] - pad] = 0
        total = np.zeros((len(cost) + 1, len(self.langs)), np.int64)
        np.cumsum(cost, axis=0, dtype=np.int64, out=total[1:])
        return total[ends - pad] - total[starts - pad]


def context_counts(df: DataFrame, config: PPMConfig) -> DataFrame:
    """(lang, length, context, byte, n): how often each byte follows each context, in rows of (lang, text).

    A context is an integer whose base-257 digits are bytes plus one, 0 for the start of the text.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[str, list[bytes]] = {}

        def flush(lang: str) -> pa.RecordBatch:
            parts = [np.concatenate([np.zeros(config.order, np.int64), np.frombuffer(t, np.uint8) + np.int64(1)]) for t in kept.pop(lang)]
            data = np.concatenate(parts)
            ends = np.cumsum([len(p) for p in parts])
            real = np.ones(len(data), bool)
            for k in range(config.order):
                real[ends - [len(p) for p in parts] + k] = False
            at = np.flatnonzero(real)
            keys, counts, lengths = [], [], []
            for length in range(config.order + 1):
                key = np.zeros(len(at), np.int64)
                for back in range(length, -1, -1):
                    key = key * 257 + data[at - back]
                u, n = np.unique(key, return_counts=True)
                keys.append(u), counts.append(n), lengths.append(np.full(len(u), length))
            key = np.concatenate(keys)
            cols = [pa.array([lang] * len(key)), pa.array(np.concatenate(lengths), pa.int32()), pa.array(key // 257), pa.array(key % 257 - 1, pa.int32()), pa.array(np.concatenate(counts), pa.int64())]
            return pa.RecordBatch.from_arrays(cols, names=["lang", "length", "context", "byte", "n"])

        held = 0
        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
                if text:
                    raw = text.encode("utf-8", "surrogatepass")
                    for at in range(0, len(raw), config.batch_bytes):
                        kept.setdefault(lang, []).append(raw[at : at + config.batch_bytes])
                        held += min(len(raw) - at, config.batch_bytes)
                        if held >= config.batch_bytes:
                            yield from [flush(x) for x in list(kept)]
                            held = 0
        yield from [flush(x) for x in list(kept)]

    rows = df.select("lang", "text").mapInArrow(count, "lang string, length int, context long, byte int, n long")
    return rows.groupBy("lang", "length", "context", "byte").agg(F.sum("n").alias("n"))


def bounded_sample(df: DataFrame, rows: int) -> DataFrame:
    """At most ``rows`` rows of each language, those with the smallest hash of ``doc_id`` and text.

    Counting the languages first leaves about twice the wanted rows to sort, so a hot language is
    no task's whole load.
    """
    wide = df.select("doc_id", "lang", "text").withColumn("_h", F.xxhash64("doc_id"))
    counts = wide.groupBy("lang").agg(F.count(F.lit(1)).alias("_n"))
    part = F.least(F.lit(1.0), F.lit(2.0 * rows + 50) / F.col("_n"))
    if counts.count() > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages: is this the label column?")
    near = wide.join(F.broadcast(counts), "lang").where(F.pmod("_h", F.lit(1 << 20)) < part * (1 << 20))
    w = Window.partitionBy("lang").orderBy("_h", "doc_id", F.xxhash64("text"))
    return near.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= rows).select("lang", "text")


def freeze(counts: DataFrame, config: PPMConfig = PPMConfig()) -> PPMModel:
    """Turn context counts into the frozen tables.

    What reaches the driver is bounded by ``max_contexts`` contexts with at most 256 bytes each, for
    each language of a bounded sample. Where there are more, languages take turns, each with its
    shortest and then its most frequent contexts.
    """
    whole = counts.groupBy("length", "context").agg(F.sum("n").alias("t")).where((F.col("t") >= config.min_count) | (F.col("length") == 0))
    own = counts.groupBy("lang", "length", "context").agg(F.sum("n").alias("own")).join(whole, ["length", "context"])
    turn = F.row_number().over(Window.partitionBy("lang").orderBy("length", F.desc("own"), "context"))
    first = own.withColumn("turn", turn).groupBy("length", "context", "t").agg(F.min("turn").alias("turn"))
    kept = first.orderBy("turn", "length", F.desc("t"), "context").limit(config.max_contexts)
    got = counts.join(F.broadcast(kept.select("length", "context")), ["length", "context"]).toPandas()
    langs = sorted(got["lang"].unique())
    if not langs:
        return PPMModel([], np.zeros(256, np.int64), np.zeros(2, np.int32), np.zeros((2, 0), np.uint16), 2, config.order)
    zero = got[got["length"] == 0].groupby("byte")["n"].sum()
    chosen = sorted(zero.sort_values(ascending=False, kind="stable").index[: config.classes])
    rest = len(chosen) + 1  # symbol of all other bytes; 0 is the start of a text
    symbols = rest + 1
    symbol = np.full(257, rest, np.int64)
    symbol[0] = 0
    symbol[[b + 1 for b in chosen]] = np.arange(1, rest)

    def digits(context: np.ndarray, length: int) -> np.ndarray:
        out = np.zeros(len(context), np.int64)
        for k in range(length - 1, -1, -1):
            out = out * symbols + symbol[context // 257**k % 257]
        return out

    # states: every kept context, by length; a state's parent is its longest proper suffix that is kept
    got["key"] = 0
    for length in range(config.order + 1):
        rows = got["length"] == length
        got.loc[rows, "key"] = digits(got.loc[rows, "context"].to_numpy(np.int64), length)
    ids: list[dict[int, int]] = []
    parent: list[int] = []
    for length in range(config.order + 1):
        own: dict[int, int] = {}
        for key in np.unique(got.loc[got["length"] == length, "key"]):
            own[int(key)] = len(parent)
            up = -1
            for shorter in range(length - 1, -1, -1):
                up = ids[shorter].get(int(key) % symbols**shorter, -1)
                if up >= 0:
                    break
            parent.append(up)
        ids.append(own)
    n, up = len(parent), np.array(parent)
    state = np.zeros(symbols**config.order, np.int32)
    state[:] = ids[0][0]
    for length in range(1, config.order + 1):
        grid = state.reshape(-1, symbols**length)
        for key, i in ids[length].items():
            grid[:, key] = i
    got["state"] = [ids[a][b] for a, b in zip(got["length"], got["key"])]
    got["sym"] = symbol[got["byte"].to_numpy() + 1]
    cost = np.zeros((n * symbols, len(langs)), np.uint16)
    step = max(1, 2_000_000 // symbols)
    for j, lang in enumerate(langs):
        own = got[got["lang"] == lang]
        seen = np.zeros((n, symbols), np.float32)
        np.add.at(seen, (own["state"].to_numpy(), own["sym"].to_numpy()), own["n"].to_numpy())
        seen[:, rest] = 0  # bytes without a symbol are only coded after every escape
        for lo in range(0, n, step):
            at = np.arange(lo, min(n, lo + step))
            hi = len(at)
            left = np.ones((hi, symbols), bool)
            left[:, 0] = False
            prob = np.zeros((hi, symbols))
            escape = np.ones(hi)
            while (at >= 0).any():
                c = np.where(left & (at >= 0)[:, None], seen[at], 0).astype(np.float64)
                distinct, total = (c > 0).sum(1), c.sum(1)
                scale = np.where(distinct > 0, escape / np.maximum(total + distinct, 1), 0)
                prob += c * scale[:, None]
                escape = np.where(distinct > 0, scale * distinct, escape)
                left &= c <= 0
                at = np.where(at >= 0, up[at], -1)
            uniform = escape / np.maximum(left[:, 1:rest].sum(1) + 257 - rest, 1)
            prob = np.where(left, uniform[:, None], prob)
            prob[:, 0] = 1
            bits = -np.log2(np.maximum(prob, 2.0**-63)) * UNIT
            cost[lo * symbols : (lo + hi) * symbols, j] = np.minimum(np.rint(bits), 65535).astype(np.uint16).ravel()
    return PPMModel(langs, symbol[1:].copy(), state, cost, symbols, config.order)


def learn(df: DataFrame, config: PPMConfig = PPMConfig()) -> PPMModel:
    """Learn from the rows of (doc_id, lang, text) whose lang and text aren't null."""
    small_batches(df.sparkSession)
    rows = df.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    scratch = Scratch(df.sparkSession, "ppm")
    counts = scratch.keep(context_counts(bounded_sample(rows, config.sample_rows), config))
    model = freeze(counts, config)
    scratch.drop(counts)
    return model


def identify(df: DataFrame, model: PPMModel, text: str = "text", config: PPMConfig = PPMConfig()) -> DataFrame:
    """Add lang_pred, score and bits_per_byte to every row.

    ``lang_pred`` is the language with the shortest code (ties: the smaller name); ``und`` if the
    text is null, has no letter, or nothing was learned. ``score`` is that language's share of the
    total probability (0 for ``und``). ``bits_per_byte`` is its code length (null for ``und``).
    Columns of those names are replaced; all others, and repeated rows, stay. Whole texts are
    scored; a text longer than a batch is coded in overlapping windows that add up exactly.
    """
    spark = df.sparkSession
    small_batches(spark)
    df, new = shield(df.drop("lang_pred", "score", "bits_per_byte"))
    text = new.get(text, text)
    shared = spark.sparkContext.broadcast(model)
    fields = ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in df.schema.fields)
    has = F.coalesce(F.col(f"`{text}`").rlike(r"\p{L}"), F.lit(False))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: PPMModel = shared.value
        for batch in batches:
            texts = batch.column(text).to_pylist()
            known = batch.column("_letters").to_pylist()
            raw = [t.encode("utf-8", "surrogatepass") if k and t else b"" for t, k in zip(texts, known)]
            bits = lengths_in_windows(m, raw, config.batch_bytes)
            lang, prob, rate = [], np.zeros(len(raw)), []
            for i, r in enumerate(raw):
                if not r or not m.langs:
                    lang.append(UNKNOWN), rate.append(None)
                    continue
                best = int(bits[i].argmin())
                gap = (bits[i] - bits[i][best]) / UNIT
                lang.append(m.langs[best]), rate.append(float(bits[i][best]) / UNIT / len(r))
                prob[i] = 1.0 / np.exp2(-np.minimum(gap, 1000)).sum()
            cols = [c for c, f in zip(batch.columns, batch.schema) if f.name != "_letters"]
            names = [f.name for f in batch.schema if f.name != "_letters"]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(lang, pa.string()), pa.array(prob), pa.array(rate, pa.float64())], names=[*names, "lang_pred", "score", "bits_per_byte"])

    return unshield(df.withColumn("_letters", has).mapInArrow(score, f"{fields}, lang_pred string, score double, bits_per_byte double"), new)


def lengths_in_windows(m: PPMModel, raw: list[bytes], window: int) -> np.ndarray:
    """Code lengths of all texts, at most about ``window`` bytes at a time."""
    out = np.zeros((len(raw), len(m.langs)), np.int64)
    group: list[int] = []
    held = 0
    for i, r in enumerate(raw):
        if len(r) > window:
            out[i] = m.lengths([r[:window]])[0]
            for at in range(window, len(r), window):
                back = r[at - m.order : at + window]
                out[i] += m.lengths([back])[0] - m.lengths([back[: m.order]])[0]
            continue
        group.append(i)
        held += len(r)
        if held >= window:
            out[group] = m.lengths([raw[j] for j in group])
            group, held = [], 0
    if group:
        out[group] = m.lengths([raw[j] for j in group])
    return out


def held_out() -> Column:
    """Documents that are never learned from: crc32 of doc_id as text leaves 2 modulo 4."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
