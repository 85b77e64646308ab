"""N-gram Jaccard self-join by PartEnum signatures, and its connected components.

Texts are sets of word shingles. Equal sets form one class, found by fingerprint. Classes are put
in size bands; within a band, a Jaccard threshold bounds how many shingles two sets can differ in.
PartEnum splits the shingle domain into first-level parts, so few differences are left for one of
them, and each part into second-level parts, of which it enumerates the subsets that leave one
out: two sets that are similar enough agree on one such subset at least, and share its signature.
Subsets of few or common shingles say little, but sets that have hardly anything in common share
them, the more the larger the corpus is. With spare parts, similar sets share more signatures than
one, so that a set can leave some out: those of its smallest subsets, then those that most classes
have. Both are taken in whole levels of an order that depends on the signature only, so that two sets
together lose no more shared ones than one of them may leave out, and still share one.

Each signature has a hub, the class with the most company, which all its other classes are compared
with first; what is joined by that needs no further comparison. Then the classes of a small group
are paired, if they lie in different components. Groups that have more pairs than that are split by
differences, so that a hub never has more rows than a fixed number for each class: classes x
and y that differ from the hub in Dx and Dy differ from each other in Dx xor Dy, so they can only
be similar if Dx and Dy share enough, and then they share one of the first few elements of both
(in a fixed order: those last that one other class, the hub's witness, has too, as most classes may;
before them what the hub lacks). Classes are dealt by these elements, a bounded number of rows for
each, and meet only there. Comparisons look at a parity sketch first (it never rejects a similar
pair), for classes of small groups as they meet, then at the whole sets.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, buckets_for, free_names, quoted, small_batches


@dataclass(frozen=True)
class JaccardConfig:
    """``threshold`` per cent. ``band``: ratio of a size band's bounds. ``split``: second-level parts;
    more make signatures more selective and more numerous. ``paired``: the most classes of a
    signature that are always paired with each other. Larger groups of a hub are split by
    differences if their pairs are more than ``prefer`` times the rows that splitting takes.
    ``spare``: the share of first-level parts that signatures may be left out for; higher ones cost
    that many more signatures, and with 0 none is left out."""

    words: int = 4
    threshold: int = 85
    band: float = 1.2
    split: int = 3
    paired: int = 32
    prefer: float = 1.0
    spare: float = 0.0
    chunk: int = 1 << 21


#: The low bits of a signature are its band.
BAND = 255
BLANK = np.zeros(256, bool)
BLANK[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
A, B, C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))
S27, S30, S31 = np.uint64(27), np.uint64(30), np.uint64(31)
LONG = 64  # bytes; longer words are hashed as a whole
HALF, LOW = np.uint64(32), np.uint64(0xFFFFFFFF)


def scramble(x: np.ndarray) -> np.ndarray:
    """A 64-bit mixing function without fixed structure."""
    with np.errstate(over="ignore"):
        x = x + A
        x = (x ^ (x >> S30)) * B
        x = (x ^ (x >> S27)) * C
        return x ^ (x >> S31)


#: A random number for each byte value.
BYTE = scramble(np.arange(256, dtype=np.uint64))


def distinct(x: np.ndarray) -> np.ndarray:
    x = np.sort(x)
    return x[np.concatenate([[True], x[1:] != x[:-1]])] if len(x) else x


_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _grown(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        for i, base in enumerate((int(A), pow(int(A), -1, 1 << 64))):
            p = np.full(n, base, np.uint64)
            p[0] = 1
            with np.errstate(over="ignore"):
                _powers[i] = np.multiply.accumulate(p)
    return _powers[0], _powers[1]


def _sets(texts: list[bytes], words: int) -> list[np.ndarray]:
    raw = b" ".join(texts) + b" "
    data = LOWER[np.frombuffer(raw, np.uint8)]
    blank = BLANK[data]
    edge = np.flatnonzero(blank[1:] != blank[:-1]) + 1
    if not blank[0]:
        edge = np.concatenate([[0], edge])
    at, ends = edge[0::2], edge[1::2]
    up, down = _grown(len(data))
    with np.errstate(over="ignore"):
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(BYTE[data] * up[: len(data)], out=sums[1:])
        h = scramble((sums[ends] - sums[at]) * down[at] ^ (ends - at).astype(np.uint64))
        for i in np.flatnonzero(ends - at > LONG).tolist():
            h[i] = xxhash.xxh3_64_intdigest(data[at[i] : ends[i]].tobytes())
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        begin = np.cumsum(sizes + 1) - sizes - 1
        first = np.searchsorted(at, np.append(begin, len(raw)))
        shingle = h.copy()
        for k in range(1, words):
            shingle[:-k] = scramble(shingle[:-k] * B + h[k:])
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        n = b - a
        if n >= words:
            out.append(distinct(shingle[a : b - words + 1]))
        elif n:
            out.append(np.array([xxhash.xxh3_64_intdigest(h[a:b].tobytes(), seed=n)], np.uint64))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def shingle_sets(texts: list[str | None], words: int, chunk: int) -> Iterator[np.ndarray]:
    """The sorted distinct 64-bit shingle hashes of each whole text; empty for null."""
    group: list[bytes] = []
    held = 0
    for t in texts:
        raw = (t or "").encode("utf-8", "surrogatepass")
        if group and held + len(raw) > chunk:
            yield from _sets(group, words)
            group, held = [], 0
        group.append(raw)
        held += len(raw)
    if group:
        yield from _sets(group, words)


class Bands:
    """Size bands and the signatures of each."""

    def __init__(self, config: JaccardConfig):
        self.config, self.low = config, [1]

    def bounds(self, band: int) -> tuple[int, int]:
        while len(self.low) < band + 2:
            self.low.append(max(self.low[-1] + 1, int(self.low[-1] * self.config.band)))
        return self.low[band], self.low[band + 1] - 1

    def of(self, size: int) -> int:
        while self.low[-1] <= size:
            self.bounds(len(self.low))
        return int(np.searchsorted(self.low, size, "right")) - 1

    def tags(self, size: int) -> range:
        """The set's own band, and those above it that hold sets it can be similar to."""
        return range(self.of(size), self.of(size * 100 // self.config.threshold) + 1)

    def most(self, both: int) -> int:
        """How many shingles two linked sets of ``both`` shingles together can differ in."""
        t = self.config.threshold
        return both - 2 * -(-t * both // (100 + t))

    def differences(self, band: int) -> int:
        high = 2 * self.bounds(band)[1]
        return max(self.most(s) for s in range(max(high - 3, 0), high + 1))

    def parts(self, band: int) -> tuple[int, int]:
        """First-level parts, and how many of them at least hold one differing shingle or none."""
        most, share = self.differences(band) // 2, self.config.spare
        good = 1 + int(share * most + 2 * (share * most) ** 0.5)
        return most + good, good

    def shared(self, band: int) -> int:
        """Signatures that similar sets share at least, plus the shingles that they differ in, less those left out here.

        Of P parts, equal ones share all signatures (of more than one second-level part) and those
        with one difference share one; with D differences, 2 P - D are shared at least.
        """
        parts, good = self.parts(band)
        return 2 * parts - good // 2

    def signatures(self, shingles: np.ndarray, band: int) -> np.ndarray:
        """Of a part with one differing shingle at most, all but one of its second-level parts agree.

        Half as many signatures as there are good parts may be left out, those of the smallest
        subsets, all of one size or none. What two sets share and one of them lacks is then smaller than the
        larger of their bounds, so that the set with that bound leaves it out too: no more are lost.
        """
        if not self.differences(band):
            return np.zeros(0, np.uint64)
        (parts, good), split = self.parts(band), self.config.split
        sums = np.zeros(parts * split, np.uint64)
        with np.errstate(over="ignore"):
            g = shingles * C  # shingles are well mixed already
            part, within = ((g >> HALF) * np.uint64(parts)) >> HALF, ((shingles & LOW) * np.uint64(split)) >> HALF
            cell = (part * np.uint64(split) + within).astype(np.int64)
            np.add.at(sums, cell, g ^ (g >> S31))
            grid = sums.reshape(parts, split)
            rest = grid.sum(1, dtype=np.uint64)[:, None] - grid
            place = np.arange(parts * split, dtype=np.uint64) + np.uint64(band) * np.uint64(1 << 40)
            out = scramble(rest.ravel() ^ scramble(place)) & ~np.uint64(BAND) | np.uint64(band & BAND)
        if good < 2:
            return out
        held = np.bincount(cell, minlength=parts * split).reshape(parts, split)
        size = (held.sum(1)[:, None] - held).ravel()
        return out[size >= np.partition(size, good // 2)[good // 2]]

    def sketch(self, shingles: np.ndarray) -> np.ndarray:
        """Parities of shingle counts in a power of two of cells; a differing shingle flips one."""
        bits = 64
        while bits < 4 * (self.most(2 * len(shingles)) + 1):
            bits *= 2
        cells = np.bincount((scramble(shingles ^ B) & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
        return np.packbits(cells.astype(np.uint8), bitorder="little").view("<i8")


#: Classes that one copy of a hub's set is compared with.
HUB_ROWS = 64


def _prints(s: np.ndarray, seed: int) -> tuple[int, int]:
    """Two independent fingerprints of a set."""
    with np.errstate(over="ignore"):
        a = int(scramble(s ^ scramble(np.array([seed], np.uint64))).sum(dtype=np.uint64))
        b = int(scramble(s ^ B).sum(dtype=np.uint64))
    mixed = scramble(np.array([a ^ len(s), b], np.uint64)).view(np.int64)
    return int(mixed[0]), int(mixed[1])


def fingerprints(df: DataFrame, config: JaccardConfig, seed: int) -> DataFrame:
    """(doc_id, n_shingles, cls, check) of each row of (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, cls, check = [], [], []
            for s in shingle_sets(batch.column("text").to_pylist(), config.words, config.chunk):
                a, b = _prints(s, seed)
                n.append(len(s)), cls.append(a), check.append(b)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(cls, pa.int64()), pa.array(check, pa.int64())], names=["doc_id", "n_shingles", "cls", "check"])

    kind = df.schema["doc_id"].dataType.simpleString()
    return df.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_shingles long, cls long, check long")


def signature_rows(df: DataFrame, config: JaccardConfig, seed: int) -> DataFrame:
    """(sig, cls) of every class that a task meets, once a task, however many copies it reads."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bands, seen = Bands(config), set()
        for batch in batches:
            sigs, owners, held = [], [], 0
            for s in shingle_sets(batch.column("text").to_pylist(), config.words, config.chunk):
                if not len(s):
                    continue
                cls = _prints(s, seed)[0]
                if cls in seen:
                    continue
                if len(seen) > 500_000:  # forgetting only costs repeated rows
                    seen.clear()
                seen.add(cls)
                for band in bands.tags(len(s)):
                    own = bands.signatures(s, band)
                    sigs.append(own), owners.append(np.full(len(own), cls, np.int64))
                    held += len(own)
                if held > 500_000:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sigs).view(np.int64)), pa.array(np.concatenate(owners))], names=["sig", "cls"])
                    sigs, owners, held = [], [], 0
            if held:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sigs).view(np.int64)), pa.array(np.concatenate(owners))], names=["sig", "cls"])

    return df.select("text").mapInArrow(run, "sig long, cls long")


#: Bits of an id filter for each id, and the most a filter has (32 MB); for more ids, rows are joined instead.
BITS_EACH, MOST_BITS = 16, 1 << 28


def id_filter(ids: DataFrame, column: str, bits: int) -> np.ndarray:
    """A bitmap of ``bits`` in which every id's bit is set.

    It only spares work: what passes by chance is dropped by a join later.
    """
    bit = ids.select(F.pmod(F.xxhash64(column), F.lit(bits)).alias("bit"))
    words = bit.groupBy(F.expr("bit div 64").alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(bit % 64 as int)))").alias("mask"))
    out = np.zeros(bits // 64, np.int64)
    got = words.toPandas()  # bits / 64 rows at most
    out[got["word"].to_numpy(np.int64)] = got["mask"].to_numpy(np.int64)
    return out.view(np.uint64)


def class_sets(docs: DataFrame, reps: DataFrame, config: JaccardConfig, seed: int, buckets: int, what: str) -> DataFrame:
    """(cls, n, ``what``) of each class in ``reps`` (cls, doc_id), from its representative's text.

    ``what`` is "sketch" or "items". The rows are dealt once, by class, into ``buckets`` partitions.
    """
    spark = docs.sparkSession
    wanted, bits, count = None, 1 << 16, reps.count()
    while bits < BITS_EACH * count:
        bits *= 2
    if bits <= MOST_BITS:
        wanted = spark.sparkContext.broadcast(id_filter(reps, "doc_id", bits))
    else:
        docs = docs.join(reps.select("doc_id").hint("merge"), "doc_id", "left_semi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bands = Bands(config)
        for batch in batches:
            rows = batch
            if wanted is not None:
                bit = batch.column("_bit").to_numpy()
                keep = np.flatnonzero(wanted.value[bit >> 6] >> (bit & 63).astype(np.uint64) & np.uint64(1))
                if not len(keep):
                    continue
                rows = batch.take(pa.array(keep))
            got = list(shingle_sets(rows.column("text").to_pylist(), config.words, config.chunk))
            prints = [_prints(s, seed)[0] for s in got]
            sizes = pa.array([len(s) for s in got], pa.int64())
            kept = [s.view(np.int64) if what == "items" else bands.sketch(s) for s in got]
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(prints, pa.int64()), sizes, pa.array(kept, pa.list_(pa.int64()))], names=["_doc", "cls", "n", what])

    bit = F.pmod(F.xxhash64("doc_id"), F.lit(bits))
    rows = docs.select("doc_id", "text", bit.alias("_bit")).mapInArrow(run, f"_doc long, cls long, n long, {what} array<bigint>")
    found = rows.repartition(buckets, "cls").join(reps.repartition(buckets, "cls").hint("merge"), "cls").where("_doc = doc_id").dropDuplicates(["cls"])
    return found.select("cls", "n", what)


def can_link(a: Column, b: Column, threshold: int) -> Column:
    return F.least(a, b) * 100 >= F.greatest(a, b) * threshold


def met(pairs: DataFrame, sets: DataFrame, what: str, threshold: int) -> DataFrame:
    """``pairs`` (a, b) with both classes' sizes (na, nb) and ``what`` (xa, xb), if the sizes allow a link."""
    one = sets.select(F.col("cls").alias("a"), F.col("n").alias("na"), F.col(what).alias("xa"))
    two = sets.select(F.col("cls").alias("b"), F.col("n").alias("nb"), F.col(what).alias("xb"))
    return pairs.join(one, "a").join(two, "b").where(can_link(F.col("na"), F.col("nb"), threshold))


def few_flips(xa: str, xb: str, total: Column, config: JaccardConfig) -> Column:
    """Whether two sketches allow a link of sets of ``total`` shingles together."""

    def folded(x: str, size: Column) -> Column:
        half = F.floor(F.size(x) / 2).cast("int")
        return F.when(F.size(x) > size, F.zip_with(F.slice(x, F.lit(1), half), F.slice(x, half + 1, half), lambda u, v: u.bitwiseXOR(v))).otherwise(F.col(x))

    t, size = config.threshold, F.least(F.size(xa), F.size(xb))
    flips = F.aggregate(F.zip_with(folded(xa, size), folded(xb, size), lambda u, v: F.bit_count(u.bitwiseXOR(v))), F.lit(0), lambda acc, x: acc + x)
    return flips <= total - 2 * F.ceil(total * t / (100 + t) - 1e-6)


def alike(pairs: DataFrame, sketches: DataFrame, config: JaccardConfig) -> DataFrame:
    """``pairs`` (a, b) without those that their sketches rule out."""
    near = met(pairs, sketches, "sketch", config.threshold)
    return near.where(few_flips("xa", "xb", F.col("na") + F.col("nb"), config)).select("a", "b")


def verified(pairs: DataFrame, sets: DataFrame, config: JaccardConfig) -> DataFrame:
    """Those of ``pairs`` (a, b) whose whole sets are similar enough."""
    common, total = F.size(F.array_intersect("xa", "xb")), F.col("na") + F.col("nb")
    return met(pairs, sets, "items", config.threshold).where(100 * common >= config.threshold * (total - common)).select("a", "b")


def most_apart(size: Column, threshold: int) -> Column:
    """How many shingles two linked sets of ``size`` shingles together can differ in."""
    return F.floor(size * (100 - threshold) / (100 + threshold) + 1e-6)


def thinned(members: DataFrame, sizes: DataFrame, config: JaccardConfig) -> DataFrame:
    """``members`` (sig, m, times, cls) without the largest groups that a class can do without.

    ``sizes`` is (cls, n). A class that shares s signatures at least with any similar set of a band
    leaves out all those of some number of classes or more, if they are fewer than s: a signature
    that one set of a pair lacks is one that the set with the smaller bound leaves out, so that a
    similar pair still shares one.
    """
    bands = Bands(config)
    last = bands.of((sizes.agg(F.max("n")).first()[0] or 1) * 100 // config.threshold)
    band = F.col("sig").bitwiseAND(F.lit(BAND)).cast("int")
    base, high = (F.element_at(F.array(*(F.lit(x) for x in xs)), band + 1) for xs in zip(*((bands.shared(b), bands.bounds(b)[1]) for b in range(last + 1))))
    both = F.col("n") + F.least(high, F.floor(F.col("n") * 100 / config.threshold))
    known = members.join(sizes, "cls").withColumn("band", band).withColumn("share", base - most_apart(both, config.threshold))
    larger = Window.partitionBy("cls", "band").orderBy(F.col("m").desc()).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    kept = known.withColumn("upto", F.sum("times").over(larger)).where(F.col("upto") >= F.col("share"))
    return kept.select("sig", F.count(F.lit(1)).over(Window.partitionBy("sig")).alias("m"), "cls").where("m > 1")


def sharing(placed: DataFrame, sketches: DataFrame, config: JaccardConfig) -> DataFrame:
    """Pairs (a, b) of different components that share a signature of ``placed``, if their sketches allow a link."""
    rows = placed.join(sketches.select("cls", "sketch"), "cls")
    one, two = (rows.select("sig", *(F.col(c).alias(f"{c}{i}") for c in ("cls", "comp", "n", "sketch"))) for i in (1, 2))
    fits = (F.col("comp1") != F.col("comp2")) & (F.col("cls1") < F.col("cls2")) & can_link(F.col("n1"), F.col("n2"), config.threshold)
    met = one.join(two, (one["sig"] == two["sig"]) & fits & few_flips("sketch1", "sketch2", F.col("n1") + F.col("n2"), config))
    return met.select(F.col("cls1").alias("a"), F.col("cls2").alias("b"))


def hubs_to_split(large: DataFrame, each: DataFrame, config: JaccardConfig) -> DataFrame:
    """(hub) whose groups in ``large`` (sig, hub, cls, comp, n) have more pairs of different components than splitting has rows.

    ``each`` holds the classes of ``large`` other than hubs once for each hub: (hub, cls, comp, n, home).
    """
    groups = large.groupBy("hub", "sig", "comp").agg(F.count(F.lit(1)).alias("c")).groupBy("hub", "sig").agg(F.sum("c").alias("m"), F.sum(F.col("c") * F.col("c")).alias("inside"))
    pairs = groups.groupBy("hub").agg((F.sum(F.col("m") * F.col("m") - F.col("inside")) / 2).alias("pairs"))
    k = most_apart(2 * F.col("n"), config.threshold)
    rows = each.groupBy("hub").agg(F.sum(F.when(F.col("comp") == F.col("home"), k / 4 + 1).otherwise(k + 1)).alias("rows"))
    return pairs.join(rows, "hub").where(F.col("pairs") * config.prefer > F.col("rows")).select("hub")


def difference_keys(near: DataFrame, sets: DataFrame, config: JaccardConfig) -> DataFrame:
    """(hub, key, at, cls, comp, n, d, first) for classes of large groups; ``near`` is (hub, cls, comp, n, home).

    ``home`` is the hub's component. A class differs from its hub in ``d`` shingles; those that the
    hub lacks come first, each part in order of its hashes, but after both parts those that the
    hub's witness differs in too, one class of the hub's component if any: most near copies of one
    text share what sets them apart from the hub's own edits. ``at`` is the place of ``key`` in that
    list. A pair x, y differs in k = most(|x| + |y|) at most, so that Dx and Dy share
    (dx + dy - k) / 2 or more, and x's first (dx - dy + k) / 2 + 1 keys or fewer hold one of them.
    If dx + dy <= k, both are similar to the hub, and so in its component. A class of the hub's
    component has partners outside only, which differ from the hub in more than a similar set can.
    ``first``: whether the key can be shared as the one of a pair with the smaller d.
    """
    t = config.threshold
    salts = near.groupBy("hub").agg(F.expr(f"cast(count(1) div {HUB_ROWS} as int) + 1").alias("salts"), F.max("n").alias("largest"), F.max_by("cls", F.struct(F.col("comp") == F.col("home"), "cls")).alias("witness"))
    dealt = near.join(salts, "hub").withColumn("salt", F.pmod(F.xxhash64("cls"), F.col("salts")).cast("int"))
    hubs = salts.drop("largest").join(sets.select(F.col("cls").alias("hub"), F.col("n").alias("hub_n"), F.col("items").alias("base")), "hub").join(sets.select(F.col("cls").alias("witness"), F.col("items").alias("seen")), "witness").withColumn("salt", F.explode(F.expr("sequence(0, salts - 1)"))).drop("salts")
    hubs = hubs.withColumn("seen", F.concat(F.array_except("seen", "base"), F.array_except("base", "seen"))).drop("witness")
    met = dealt.drop("salts", "n", "witness").join(sets, "cls").join(hubs, ["hub", "salt"])
    differ = F.concat(F.array_except("items", "base"), F.array_except("base", "items"))
    met = met.withColumn("differ", differ).withColumn("differ", F.concat(F.array_except("differ", "seen"), F.array_intersect("differ", "seen")))
    rows = met.select("hub", "cls", "comp", "home", "n", "hub_n", "largest", "differ").withColumn("d", F.size("differ"))
    k = most_apart(F.col("n") + F.least(F.floor(F.col("n") * 100 / t), "largest"), t)
    beyond = most_apart(F.ceil(F.col("n") * t / 100) + F.col("hub_n"), t)
    length = F.when(F.col("comp") == F.col("home"), F.floor((k - beyond - 1 + F.col("d")) / 2) + 1).otherwise(k + 1)
    length = F.greatest(F.lit(0), F.least(length, "d")).cast("int")
    rows = rows.select("hub", "cls", "comp", "n", "d", (F.floor(k / 2) + 1).alias("half"), F.slice("differ", F.lit(1), length).alias("keys"))
    keys = rows.repartition("cls", "hub").select("hub", "cls", "comp", "n", "d", "half", F.posexplode("keys").alias("at", "key"))
    return keys.select("hub", "key", "at", "cls", "comp", "n", "d", (F.col("at") < F.col("half")).alias("first"))


def pairs_by_differences(keys: DataFrame, config: JaccardConfig) -> DataFrame:
    """Pairs (a, b) of different components that meet at a key and can share enough differences beyond it."""
    t = config.threshold
    x = keys.where("first").select("hub", "key", *(F.col(c).alias(f"{c}1") for c in ("at", "cls", "comp", "n", "d")))
    y = keys.select("hub", "key", *(F.col(c).alias(f"{c}2") for c in ("at", "cls", "comp", "n", "d")))
    k = most_apart(F.col("n1") + F.col("n2"), t)
    share = F.ceil((F.col("d1") + F.col("d2") - k) / 2)
    order = (F.col("d1") < F.col("d2")) | ((F.col("d1") == F.col("d2")) & (F.col("cls1") < F.col("cls2")))
    fits = order & (F.col("comp1") != F.col("comp2")) & can_link(F.col("n1"), F.col("n2"), t) & (F.least(F.col("d1") - F.col("at1"), F.col("d2") - F.col("at2")) >= share)
    met = x.join(y, (x["hub"] == y["hub"]) & (x["key"] == y["key"]) & fits)
    return met.select(F.least("cls1", "cls2").alias("a"), F.greatest("cls1", "cls2").alias("b"))


def components(nodes: DataFrame, links: DataFrame, scratch: Scratch) -> DataFrame:
    """(id, comp): the smallest id that is reachable over ``links`` (a, b), for ids that have a link.

    A label spreads to the neighbours and to the node that was their label before, and labels are
    followed once more at each step, so that the steps grow with the logarithm of a component.
    """
    ways = scratch.keep(links.select("a", "b").union(links.select("b", "a")).distinct())
    label = scratch.keep(ways.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("m")).select("id", F.least("id", "m").alias("comp")))
    while True:
        seen = ways.join(label.select(F.col("id").alias("b"), "comp"), "b").groupBy(F.col("a").alias("id")).agg(F.min("comp").alias("m"))
        both = label.join(seen, "id")
        told = label.select("id", F.col("comp").alias("old"), "comp").union(both.select("id", F.lit(None).cast("long"), "m")).union(both.where("comp <> m").select(F.col("comp"), F.lit(None).cast("long"), "m"))
        step = told.groupBy("id").agg(F.max("old").alias("old"), F.min("comp").alias("mid"))
        jump = step.select(F.col("id").alias("mid"), F.col("mid").alias("far"))
        after = scratch.keep(step.join(jump, "mid", "left").select("id", F.least("mid", F.coalesce("far", "mid")).alias("comp"), "old"))
        changed = after.where("comp <> old").limit(1).count()
        scratch.drop(label)
        label = after.select("id", "comp")
        label._scratch = after._scratch
        if not changed:
            scratch.drop(ways)
            return label


def link_components(df: DataFrame, config: JaccardConfig = JaccardConfig()) -> DataFrame:
    """doc_id, n_shingles and component_id of every row of (doc_id, text).

    Words are runs of bytes other than blanks, A-Z lower-cased; a set holds the distinct shingles
    of ``words`` words, or a shorter text's whole word sequence. Documents link from ``threshold``
    per cent on; component_id is the smallest doc_id that links reach. Null, empty and blank texts
    have no shingles and link with nothing. Rows with a null doc_id get a null component_id and
    link nothing. Repeated rows stay. Further columns are ignored.
    """
    spark = df.sparkSession
    small_batches(spark)
    scratch = Scratch(spark, "jaccard")
    docs = df.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    known, seed = docs.where(F.col("doc_id").isNotNull()), 0
    while True:
        prints = scratch.keep(fingerprints(docs, config, seed))
        classes = prints.where("n_shingles > 0 and doc_id is not null").groupBy("cls").agg(F.min("doc_id").alias("doc_id"), F.min("n_shingles").alias("n"), F.min("check").alias("low"), F.max("check").alias("high"))
        classes = scratch.keep(classes)
        if not classes.where("low <> high").limit(1).count():
            break
        scratch.drop(prints, classes)  # two different sets have one fingerprint: take others
        seed += 1
    by = Window.partitionBy("sig")
    rows = signature_rows(known, config, seed)
    rows = rows.select("sig", "cls", F.min("cls").over(by).alias("low"), F.max("cls").over(by).alias("high")).where("low <> high").select("sig", "cls").distinct()
    rows = scratch.keep(rows)
    # signatures of a band with the same classes are kept once
    digest = F.bit_xor(F.xxhash64("cls", F.lit(7)))
    rows_of = rows.select("sig", "cls", digest.over(by).alias("who"), F.count(F.lit(1)).over(by).alias("m"))
    band = F.col("sig").bitwiseAND(F.lit(BAND))
    members = rows_of.groupBy("who", "m", "cls", band.alias("band")).agg(F.min("sig").alias("sig"), F.count(F.lit(1)).alias("times")).select("sig", "m", "times", "cls")
    members = scratch.keep(members)
    scratch.drop(rows)
    if config.spare:
        whole, members = members, scratch.keep(thinned(members, classes.select("cls", "n"), config))
        scratch.drop(whole)
    company = members.groupBy("cls").agg(F.sum("m").alias("company"))
    reps = scratch.keep(classes.select("cls", "doc_id").join(company, "cls"))
    buckets = max(12, buckets_for(reps.count()))
    made: list[str] = []

    def stored(of: DataFrame, what: str) -> DataFrame:
        """``class_sets`` as a table in buckets by class, so that only pairs move."""
        made.append(f"jaccard_{uuid.uuid4().hex}")
        class_sets(known, of, config, seed, buckets, what).write.option("compression", "none").bucketBy(buckets, "cls").format("parquet").saveAsTable(made[-1])
        return spark.table(made[-1])

    def whole_sets(ids: DataFrame) -> DataFrame:
        return stored(scratch.keep(reps.select("cls", "doc_id").join(ids.distinct(), "cls", "left_semi")), "items")

    def ends(pairs: DataFrame) -> DataFrame:
        return pairs.select(F.col("a").alias("cls")).union(pairs.select("b"))

    try:
        sketches = stored(reps.select("cls", "doc_id"), "sketch")
        best = F.max(F.struct("company", "cls")).over(by)["cls"].alias("hub")
        hubbed = scratch.keep(members.join(reps.select("cls", "company"), "cls").select("sig", "m", "cls", best))
        asked = hubbed.where("cls <> hub").select(F.least("cls", "hub").alias("a"), F.greatest("cls", "hub").alias("b")).distinct()
        near = scratch.keep(alike(asked, sketches, config))
        links = scratch.keep(verified(near, whole_sets(ends(near)), config))
        comp = components(reps, links, scratch)
        scratch.drop(near, members)
        # what is left: signatures whose classes lie in different components
        placed = hubbed.join(comp.withColumnRenamed("id", "cls"), "cls", "left").withColumn("comp", F.coalesce("comp", "cls"))
        placed = placed.select("*", F.min("comp").over(by).alias("_a"), F.max("comp").over(by).alias("_b")).where("_a <> _b").drop("_a", "_b")
        placed = scratch.keep(placed.join(sketches.select("cls", "n"), "cls"))
        large = placed.where(F.col("m") > config.paired)
        home = large.select("hub").distinct().join(comp.withColumnRenamed("id", "hub"), "hub", "left").select("hub", F.coalesce("comp", "hub").alias("home"))
        each = scratch.keep(large.where(F.col("cls") != F.col("hub")).select("hub", "cls", "comp", "n").distinct().join(home, "hub"))
        split = scratch.keep(hubs_to_split(large, each, config))
        paired = placed.where(F.col("m") <= config.paired).unionByName(large.join(split, "hub", "left_anti").select(placed.columns))
        near = sharing(paired, sketches, config)
        many = scratch.keep(each.join(split, "hub", "left_semi"))
        if many.limit(1).count():
            keys = difference_keys(many, whole_sets(many.select("cls").union(many.select("hub"))), config)
            near = near.union(alike(pairs_by_differences(scratch.keep(keys), config).distinct(), sketches, config))
        near = scratch.keep(near.distinct())
        if near.limit(1).count():
            more = scratch.keep(verified(near, whole_sets(ends(near)), config))
            comp = components(reps, scratch.keep(links.union(more)), scratch)
    finally:
        for name in made:
            spark.sql(f"DROP TABLE IF EXISTS {name}")
    # components of classes become components of documents
    classes = classes.join(comp.withColumnRenamed("id", "cls"), "cls", "left").withColumn("comp", F.coalesce("comp", "cls"))
    lowest = classes.groupBy("comp").agg(F.min("doc_id").alias("_least"))  # partial sums first, as a component may be large
    least = scratch.keep(classes.join(lowest, "comp").select("cls", "_least"))
    # large classes are joined by broadcast or by a split skewed join; null ids and empty sets stay alone
    linked = prints.where("n_shingles > 0 and doc_id is not null").join(least, "cls").select("doc_id", "n_shingles", F.col("_least").alias("component_id"))
    alone = prints.where("n_shingles = 0 or doc_id is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return linked.unionByName(alone)


def keep_one(df: DataFrame, config: JaccardConfig = JaccardConfig()) -> DataFrame:
    """``df`` with one document of each component, the one with its smallest doc_id.

    Rows that repeat that doc_id collapse to one, the one with the smallest text (null first; ties:
    any one of them); rows with a null doc_id stay. Columns may have any names.
    """
    kept_id, row = free_names(df, "kept", "row")
    kept = link_components(df.select("doc_id", "text"), config).where("doc_id = component_id").select(F.col("doc_id").alias(kept_id)).distinct()
    named = df.where(F.col("doc_id").isNotNull()).join(kept, F.col("doc_id").cast("long") == F.col(kept_id), "left_semi")
    whole = F.struct(*(F.col(quoted(c)) for c in df.columns))
    first = named.groupBy("doc_id").agg(F.min_by(whole, F.struct("text")).alias(row))
    return first.select(*(F.col(row)[c].alias(c) for c in df.columns)).unionByName(df.where(F.col("doc_id").isNull()))
