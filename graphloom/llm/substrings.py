"""Exact removal of long repeated byte strings by a logarithmic family of sparse suffix arrays (operator 7).

A string of ``length`` bytes is repeated if it also starts anywhere else, in the same text or another. Of each such string the suffix
that starts at its minimiser (the leftmost of the smallest hashed ``GRAM``-grams in it) is an entry: equal strings have equal entries at
equal offsets, so suffixes at minimisers, about one in 70, are all that must be indexed. An entry covers the run of consecutive windows
that share a minimiser; ``key`` is the hash of its GRAM-gram, ``seg`` that of all bytes the run touches.

A batch's sparse suffix array is its entries in the order of the (hashed) gram with which the suffix begins, one row for each gram: rows,
one seg, and whether there are several. New batches are merge-scanned against the existing levels, which yields the grams found in both;
then the batch becomes a run of level 0, and two runs of a level merge into one of the next. Runs are bucketed tables in gram order, so
a scan or merge doesn't move the existing levels.

For the repeated grams only, entries are looked at again. Equal segs repeat whole. Where a gram has several segs, the windows they share
are found from the bytes around it: up to ``GROUP`` segs are compared by the longest match on both sides, more are compared by digests of
blocks of windows, then of windows, so that no group is gathered in one place and no pair is emitted. Digests have 128 bits, grams and segs 64 each.

Defined results: null and empty texts have no bytes; repeated rows repeat one another; texts shorter than ``length`` lose nothing; a null
doc_id is a document like any other; an empty table gives no rows; other columns are ignored. Removal may part a character: what is
left is given as bytes.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, pieces, release, shared_dir, small_batches, written

LENGTH, GRAM = 200, 64
BATCHES, GROUP = 4, 64
BLOCK = 16
PIECE_BYTES = 1 << 20  # a dozen arrays of 8 bytes for each byte of a piece live at once
BASE = 0x9E3779B97F4A7C15
MIX1, MIX2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
LOW = np.uint64(0xFFFFFFFF)
ROW = ["r1", "r2"]


def powers(n: int, base: int) -> np.ndarray:
    """base**0 .. base**(n - 1) modulo 2**64."""
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * MIX1
    x = (x ^ (x >> np.uint64(33))) * MIX2
    return x ^ (x >> np.uint64(33))


class Grams:
    """Hashes of all GRAM-grams of a buffer: differences of one running polynomial sum."""

    def __init__(self):
        self.up = self.down = np.zeros(0, np.uint64)

    def __call__(self, data: np.ndarray) -> np.ndarray:
        n = len(data)
        if len(self.up) < n + 1:
            self.up = powers(n + 1, BASE)
            self.down = powers(n + 1, pow(BASE, -1, 1 << 64))
        total = np.zeros(n + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * self.up[:n], out=total[1:])
        return mixed((total[GRAM:] - total[:-GRAM]) * self.down[: n - GRAM + 1])


def window_minimum(x: np.ndarray, width: int) -> np.ndarray:
    """The minimum of each ``width`` neighbours, from block prefixes and suffixes."""
    n = len(x)
    blocks = -(-n // width)
    padded = np.full(blocks * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = x
    square = padded.reshape(blocks, width)
    prefix = np.minimum.accumulate(square, axis=1).ravel()
    suffix = np.minimum.accumulate(square[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(suffix[: n - width + 1], prefix[width - 1 : n])


def entries(data: bytes, starts: np.ndarray, sizes: np.ndarray, grams: Grams, length: int) -> tuple[np.ndarray, ...]:
    """Of texts laid end to end in data: (text, first window, windows, offset of the gram in it, key, seg) of each entry."""
    none = tuple(np.zeros(0, t) for t in (np.int64, np.int32, np.int16, np.int16, np.int64, np.int64))
    n = np.maximum(sizes - length + 1, 0)
    if not n.sum():
        return none
    h = grams(np.frombuffer(data, np.uint8))
    packed = (h & ~LOW) | np.arange(len(h), dtype=np.uint64)  # ties of the upper half go to the left, whatever the buffer
    at = (window_minimum(packed, length - GRAM + 1) & LOW).astype(np.int64)
    text = np.repeat(np.arange(len(n)), n)
    first = np.repeat(starts - np.concatenate(([0], np.cumsum(n)[:-1])), n)
    place = np.arange(len(text)) + first  # of every window in data
    gram = at[place]
    cut = np.flatnonzero((np.diff(gram, prepend=-1) != 0) | (np.diff(text, prepend=-1) != 0))
    count = np.diff(cut, append=len(text))
    p = place[cut]
    digest = xxhash.xxh3_64_intdigest
    seg = np.fromiter((digest(data[a:b]) for a, b in zip(p.tolist(), (p + count + length - 1).tolist(), strict=True)), np.uint64, len(p))
    return text[cut], (p - starts[text[cut]]).astype(np.int32), count.astype(np.int16), (gram[cut] - p).astype(np.int16), h[gram[cut]].view(np.int64), seg.view(np.int64)


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id and text with two hashes that name the row (equal rows share them)."""
    return docs.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("r1"), F.xxhash64("text", F.lit(1), "doc_id").alias("r2"))


def suffix_entries(docs: DataFrame, batches: int, length: int) -> DataFrame:
    """(batch, r1, r2, p, c, m, key, seg): the entries of every document."""

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams = Grams()
        for piece in pieces(source, limit=PIECE_BYTES):
            texts = [t or b"" for t in piece.column(1).cast(pa.binary()).to_pylist()]
            sizes = np.array([len(t) for t in texts], np.int64)
            text, p, c, m, key, seg = entries(b"".join(texts), np.cumsum(sizes) - sizes, sizes, grams, length)
            if len(text):
                r1, r2 = (piece.column(i).to_numpy()[text] for i in (2, 3))
                arrays = (np.mod(r1, batches).astype(np.int32), r1, r2, p, c, m, key, seg)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in arrays], names=["batch", "r1", "r2", "p", "c", "m", "key", "seg"])

    return small_batches(keyed(docs)).mapInArrow(run, "batch int, r1 long, r2 long, p int, c short, m short, key long, seg long")


class SuffixLevels:
    """The family of runs (key, n, seg, several), each sorted and bucketed by key; ``found`` holds the repeated keys."""

    def __init__(self, spark: SparkSession, buckets: int | None = None):
        self.spark = spark
        self.buckets = buckets or min(int(spark.conf.get("spark.sql.shuffle.partitions")), 8192)
        self.levels: list[list[str]] = []
        self.found: list[DataFrame] = []

    def _write(self, rows: DataFrame) -> str:
        name = f"suffix_run_{uuid.uuid4().hex}"
        rows.select("key", "n", "seg", "several").write.bucketBy(self.buckets, "key").sortBy("key").format("parquet").saveAsTable(name)
        return name

    def add(self, batch: DataFrame) -> None:
        """A batch of entries: build its run, scan it against every level, then let it in."""
        lo, hi = F.min("seg"), F.max("seg")
        name = self._write(batch.groupBy("key").agg(F.count("*").alias("n"), lo.alias("seg"), (lo != hi).alias("several")))
        run = self.spark.table(name)
        matches = [run.filter("n > 1").select("key", "several")]
        for level in self.levels:
            for old in level:
                o = self.spark.table(old).select("key", F.col("seg").alias("oseg"), F.col("several").alias("oseveral"))
                both = run.join(o.hint("merge"), "key")
                matches.append(both.select("key", (F.col("several") | F.col("oseveral") | (F.col("seg") != F.col("oseg"))).alias("several")))
        self.found.append(written(reduce(DataFrame.unionByName, matches), "suffix-matches"))
        self._put(name, 0)
        release(self.spark)

    def _put(self, run: str, level: int) -> None:
        if level == len(self.levels):
            self.levels.append([])
        self.levels[level].append(run)
        if len(self.levels[level]) == 2:
            old, self.levels[level] = self.levels[level], []
            a, b = (self.spark.table(n).select("key", *(F.col(c).alias(f"{c}{i}") for c in ("n", "seg", "several"))) for i, n in enumerate(old))
            differ = F.coalesce(F.col("seg0") != F.col("seg1"), F.lit(False))
            both = a.hint("merge").join(b, "key", "full_outer")
            n = F.coalesce("n0", F.lit(0)) + F.coalesce("n1", F.lit(0))
            several = F.coalesce("several0", F.lit(False)) | F.coalesce("several1", F.lit(False)) | differ
            self._put(self._write(both.select("key", n.alias("n"), F.coalesce("seg0", "seg1").alias("seg"), several.alias("several"))), level + 1)
            for n in old:
                self.spark.sql(f"DROP TABLE {n}")

    def repeated(self) -> DataFrame:
        """(key, several) of the grams found twice or more."""
        return reduce(DataFrame.unionByName, self.found).groupBy("key").agg(F.max("several").alias("several"))

    def drop(self) -> None:
        for level in self.levels:
            for name in level:
                self.spark.sql(f"DROP TABLE {name}")
        self.levels = []


def match_lengths(segs: list[bytes], m: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """(left, right): bytes in which segs i and j agree before, and from, their grams' starts."""
    n = len(segs)
    left, right = max(m), max(len(s) - k for s, k in zip(segs, m, strict=True))
    a = np.full((n, left), -1, np.int16)
    b = np.full((n, right), -1, np.int16)
    for i, (s, k) in enumerate(zip(segs, m, strict=True)):
        x = np.frombuffer(s, np.uint8)
        a[i, :k] = x[:k][::-1]
        b[i, : len(x) - k] = x[k:]

    def agree(x: np.ndarray) -> np.ndarray:
        same = (x[:, None] == x[None]) & (x[:, None] >= 0)
        return np.where(same.all(2), x.shape[1], same.argmin(2)) if x.shape[1] else np.zeros((n, n), int)

    return agree(a), agree(b)


def shared_windows(segs: list[bytes], m: list[int], c: list[int], length: int) -> list[list[tuple[int, int]]]:
    """For each seg the runs [from, to) of its windows that another seg holds too."""
    left, right = match_lengths(segs, m)
    out = []
    for i in range(len(segs)):
        before = m[i] - np.arange(c[i])  # bytes of the window in front of the gram
        fits = (left[i][:, None] >= before) & (right[i][:, None] >= length - before)
        fits[i] = False
        out.append(runs(fits.any(0)))
    return out


def runs(flags: np.ndarray) -> list[tuple[int, int]]:
    edge = np.flatnonzero(np.diff(np.concatenate(([0], flags.view(np.int8), [0]))))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True))


RUNS = "array<struct<a:int,b:int>>"


def fetched(docs: DataFrame, segs: DataFrame, length: int) -> DataFrame:
    """(key, seg, c, m, bytes) of the segs (key, seg, rep: a place that has it): their bytes, read from the documents."""
    wanted = segs.select("key", "seg", "rep.*").groupBy(*ROW).agg(F.collect_list(F.struct("key", "seg", "p", "c", "m")).alias("want"))
    joined = docs.join(wanted, ROW).select("text", "want")

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(source, limit=PIECE_BYTES):
            rows = [(w["key"], w["seg"], w["c"], w["m"], t[w["p"] : w["p"] + w["c"] + length - 1]) for t, want in zip(piece.column(0).cast(pa.binary()).to_pylist(), piece.column(1).to_pylist(), strict=True) for w in want]
            cols = list(zip(*rows, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(cols, (pa.int64(), pa.int64(), pa.int16(), pa.int16(), pa.binary()), strict=True)], names=["key", "seg", "c", "m", "bytes"])

    return joined.mapInArrow(run, "key long, seg long, c short, m short, bytes binary")


def compared(segs: DataFrame, length: int) -> DataFrame:
    """(key, seg, runs) by comparing the few segs of each key."""
    lists = segs.groupBy("key").agg(F.collect_list(F.struct("seg", "c", "m", "bytes")).alias("s"))

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            keys, ids, found = [], [], []
            for key, s in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for x, got in zip(s, shared_windows([x["bytes"] for x in s], [x["m"] for x in s], [x["c"] for x in s], length), strict=True):
                    if got:
                        keys.append(key)
                        ids.append(x["seg"])
                        found.append([{"a": a, "b": b} for a, b in got])
            kind = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(ids, pa.int64()), pa.array(found, kind)], names=["key", "seg", "runs"])

    return lists.mapInArrow(run, f"key long, seg long, runs {RUNS}")


def digested(segs: DataFrame, length: int) -> DataFrame:
    """(key, seg, runs) for keys with many segs, in two steps; a seg has no window twice.

    Windows are taken by blocks of BLOCK offsets of the gram in them. A block whose bytes another seg has whole is done. Where only the
    bytes that all of its windows share are found elsewhere too, the block's windows are compared one by one, one seg for each distinct
    block; where not even those are, no window of the block is shared.
    """

    def spans(c: int, m: int) -> Iterator[tuple[int, int, int]]:
        """(block, first window, end) of a seg's c windows, the first of which has its gram at m."""
        for j in range((m - c + 1) // BLOCK, m // BLOCK + 1):
            yield j, max(m - BLOCK * j - BLOCK + 1, 0), min(m - BLOCK * j + 1, c)

    def whole(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            rows = []
            for key, seg, c, m, data in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                for j, a, b in spans(c, m):
                    mark = (m - a).to_bytes(2, "little") + (b - a).to_bytes(2, "little")
                    common = data[m - BLOCK * j : m - BLOCK * j - BLOCK + 1 + length]
                    u1, u2 = np.frombuffer(xxhash.xxh3_128_digest(mark + data[a : b + length - 1]), "<i8").tolist()
                    rows.append((key, seg, j, a, b, u1, u2, int(np.uint64(xxhash.xxh3_64_intdigest(common)).view(np.int64))))
            types = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            cols = list(zip(*rows, strict=True)) or [()] * 8
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(cols, types, strict=True)], names=["key", "seg", "j", "a", "b", "u1", "u2", "x"])

    blocks = written(segs.select("key", "seg", "c", "m", "bytes").mapInArrow(whole, "key long, seg long, j int, a int, b int, u1 long, u2 long, x long"), "window-blocks")
    same = written(blocks.groupBy("key", "j", "u1", "u2", "x").agg(F.count("*").alias("n"), F.min("seg").alias("seg")), "distinct-blocks")
    full = blocks.join(same.filter("n > 1").select("key", "j", "u1", "u2"), ["key", "j", "u1", "u2"], "left_semi").select("key", "seg", F.struct("a", "b").alias("run"))
    several = same.groupBy("key", "j", "x").agg(F.count("*").alias("kinds")).filter("kinds > 1").select("key", "j", "x")
    open_ = same.join(several, ["key", "j", "x"], "left_semi").groupBy("key", "seg").agg(F.collect_list("j").alias("js"))

    def single(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            for key, seg, c, m, data, js in zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True):
                at = np.array([i for j, a, b in spans(c, m) if j in set(js) for i in range(a, b)], np.int32)
                h = np.frombuffer(b"".join(xxhash.xxh3_128_digest(data[i : i + length]) for i in at.tolist()), "<i8").reshape(-1, 2)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), key)), pa.array(np.full(len(at), seg)), pa.array(at), pa.array(h[:, 0].copy()), pa.array(h[:, 1].copy())], names=["key", "seg", "i", "h1", "h2"])

    wanted = segs.join(open_, ["key", "seg"]).select("key", "seg", "c", "m", "bytes", "js")
    windows = written(wanted.mapInArrow(single, "key long, seg long, i int, h1 long, h2 long"), "windows")
    twice = windows.groupBy("h1", "h2").agg(F.count("*").alias("n")).filter("n > 1").select("h1", "h2")
    hit = windows.join(twice, ["h1", "h2"], "left_semi")
    one = hit.select("key", "seg", F.struct(F.col("i").alias("a"), (F.col("i") + 1).alias("b")).alias("run"))
    return full.unionByName(one).groupBy("key", "seg").agg(F.collect_list("run").alias("runs"))


def repeated_spans(docs: DataFrame, length: int = LENGTH, batches: int = BATCHES, group: int = GROUP) -> DataFrame:
    """(r1, r2, spans): for each row named by r1 and r2 that has any, the byte spans of its repeated strings (they may overlap)."""
    spark = docs.sparkSession
    shared_dir(spark)
    every = written(suffix_entries(docs, batches, length), "suffix-entries", ("batch",))
    levels = SuffixLevels(spark)
    try:
        for i in range(batches):
            levels.add(every.filter(F.col("batch") == i).select("key", "seg"))
        repeated = written(levels.repeated(), "repeated-grams")
    finally:
        levels.drop()
    hits = written(every.drop("batch").join(repeated, "key"), "suffix-hits")
    discard(every, repeated, *levels.found)
    release(spark)

    place = F.struct(*ROW, "p", "c", "m")
    segs = written(hits.filter("several").groupBy("key", "seg").agg(F.count("*").alias("n"), F.min(place).alias("rep")), "segs")
    of_key = segs.groupBy("key").agg(F.count("*").alias("size"))
    read = written(fetched(keyed(docs), segs, length).join(of_key, "key"), "seg-bytes")
    few = compared(read.filter(F.col("size") <= group).drop("size"), length)
    many = digested(read.filter(F.col("size") > group).drop("size"), length)
    single = few.unionByName(many).withColumnRenamed("runs", "some")
    release(spark)

    whole = hits.filter(~F.col("several")).select(*ROW, "p", "c")
    again = hits.filter("several").join(segs.filter("n > 1").select("key", "seg"), ["key", "seg"], "left_semi").select(*ROW, "p", "c")
    span = lambda a, b: F.struct(a.cast("int").alias("a"), (b + length - 1).cast("int").alias("b"))
    full = whole.unionByName(again).select(*ROW, span(F.col("p"), F.col("p") + F.col("c")).alias("s"))
    part = hits.filter("several").join(single, ["key", "seg"]).select(*ROW, "p", F.explode("some").alias("x"))
    part = part.select(*ROW, span(F.col("p") + F.col("x.a"), F.col("p") + F.col("x.b")).alias("s"))
    return full.unionByName(part).groupBy(*ROW).agg(F.collect_set("s").alias("spans"))  # rows that are equal share their spans


def cut(data: bytes, spans: list[tuple[int, int]]) -> tuple[bytes, int, int]:
    """(bytes that are left, removed bytes, maximal removed runs)."""
    if not spans:
        return data, 0, 0
    edge = np.zeros(len(data) + 1, np.int64)
    a, b = np.array(spans, np.int64).T
    np.add.at(edge, a, 1)
    np.add.at(edge, b, -1)
    gone = np.cumsum(edge[:-1]) > 0
    return np.frombuffer(data, np.uint8)[~gone].tobytes(), int(gone.sum()), len(runs(gone))


def remove_repeats(docs: DataFrame, length: int = LENGTH, batches: int = BATCHES, group: int = GROUP) -> DataFrame:
    """doc_id, kept (the bytes that are left), n_bytes, n_removed, n_spans for each row of docs (doc_id, text)."""
    spans = written(repeated_spans(docs, length, batches, group), "repeated-spans")
    release(docs.sparkSession)
    joined = keyed(docs).join(spans, ROW, "left").select("doc_id", "text", F.col("spans.a").alias("a"), F.col("spans.b").alias("b"))

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(source, limit=PIECE_BYTES):
            texts = [t or b"" for t in piece.column(1).cast(pa.binary()).to_pylist()]
            spans = [list(zip(a, b, strict=True)) if a else [] for a, b in zip(piece.column(2).to_pylist(), piece.column(3).to_pylist(), strict=True)]
            left = [cut(t, s) for t, s in zip(texts, spans, strict=True)]
            numbers = ([len(t) for t in texts], [x[1] for x in left], [x[2] for x in left])
            yield pa.RecordBatch.from_arrays([piece.column(0), pa.array([x[0] for x in left], pa.binary()), *(pa.array(x, pa.int64()) for x in numbers)], names=["doc_id", "kept", "n_bytes", "n_removed", "n_spans"])

    return joined.mapInArrow(run, "doc_id long, kept binary, n_bytes long, n_removed long, n_spans long")
