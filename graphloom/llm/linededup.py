"""Line de-duplication over levelled sorted runs of line hashes (operator 5).

A line's key is the line stripped of ASCII white space and lower-cased in A-Z; a run holds (128-bit key hash, number of documents), sorted
and bucketed by hash, as a table in the warehouse. Documents come in batches. A new batch is merge-anti-joined with the settled runs (keys
already known to be frequent need no more counting) and what is left becomes a run of its own on level 0. ``fanout`` runs of a level are
merged into one of the next, where counts add up and keys that reach the limit move to a settled run. As runs are bucketed alike, neither
the anti-join nor a merge shuffles an existing run.

The final pass takes the frequent keys to the documents: broadcast if they are at most ``BROADCAST_KEYS`` (16 bytes each), else by a join
from each document's own distinct keys, so that no set grows beyond a document.

Defined results: a null text is one empty line, as is an empty one; an empty key never counts; each row of the table is a document, so
repeated rows count as many and all give a result; an empty table gives no rows; a null doc_id is a document like any other; other
columns are ignored by ``dedup_lines``.
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

from .common import discard, pieces, shared_dir, small_batches, written

SPACE = b" \t\n\x0b\x0c\r"
BROADCAST_KEYS = 1_000_000
LEAST_DOCS, BATCHES, FANOUT = 10, 4, 2
HASH = ["h1", "h2"]


def key_hash(line: bytes) -> bytes:
    """16 bytes of the line's key; none for an empty key."""
    key = line.strip(SPACE).lower()
    return xxhash.xxh3_128_digest(key) if key else b""


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id and text with two hashes that name the row (equal rows share them)."""
    return docs.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("r1"), F.xxhash64("text", F.lit(1), "doc_id").alias("r2"))


def line_keys(docs: DataFrame, batches: int) -> DataFrame:
    """(batch, r1, r2, h1, h2): the distinct keys of each document."""

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(source):
            texts = piece.column(1).cast(pa.binary()).to_pylist()
            sets = [{h for x in (t or b"").split(b"\n") if (h := key_hash(x))} for t in texts]
            n = np.array([len(s) for s in sets])
            h = np.frombuffer(b"".join(x for s in sets for x in s), "<i8").reshape(-1, 2)
            r1, r2 = (np.repeat(piece.column(i).to_numpy(), n) for i in (2, 3))
            arrays = [np.mod(r1, batches).astype(np.int32), r1, r2, np.ascontiguousarray(h[:, 0]), np.ascontiguousarray(h[:, 1])]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in arrays], names=["batch", "r1", "r2", "h1", "h2"])

    return small_batches(keyed(docs)).mapInArrow(run, "batch int, r1 long, r2 long, h1 long, h2 long")


class LineRuns:
    """The levelled runs of one collection."""

    def __init__(self, spark: SparkSession, least_docs: int = LEAST_DOCS, fanout: int = FANOUT, buckets: int | None = None):
        self.spark, self.least, self.fanout = spark, least_docs, fanout
        self.buckets = buckets or min(int(spark.conf.get("spark.sql.shuffle.partitions")), 4096)
        self.levels: list[list[str]] = []
        self.settled: list[str] = []

    def _write(self, counts: DataFrame) -> str:
        name = f"line_run_{uuid.uuid4().hex}"
        counts.select(*HASH, "n").write.bucketBy(self.buckets, *HASH).sortBy(*HASH).format("parquet").saveAsTable(name)
        return name

    def _merged(self, names: list[str]) -> DataFrame:
        """The runs as one, counts added: full outer merge joins of tables bucketed alike.

        Not a union and a sum: Spark 4.1 takes the union of bucketed tables for partitioned by their key and leaves equal keys apart.
        """

        def pair(a: DataFrame, b: DataFrame) -> DataFrame:
            both = a.withColumnRenamed("n", "n0").hint("merge").join(b.withColumnRenamed("n", "n1"), HASH, "full_outer")
            return both.select(*HASH, (F.coalesce("n0", F.lit(0)) + F.coalesce("n1", F.lit(0))).alias("n"))

        return reduce(pair, (self.spark.table(n) for n in names))

    def add(self, keys: DataFrame) -> None:
        """One batch: (h1, h2) rows, each key once for each of its documents."""
        counts = keys.groupBy(*HASH).agg(F.count("*").alias("n"))
        for name in self.settled:
            counts = counts.join(self.spark.table(name).hint("merge"), HASH, "left_anti")
        self._put(self._write(counts), 0)

    def _put(self, run: str, level: int) -> None:
        if level == len(self.levels):
            self.levels.append([])
        self.levels[level].append(run)
        if len(self.levels[level]) == self.fanout:
            old, self.levels[level] = self.levels[level], []
            self._merge(old, level + 1)

    def _merge(self, old: list[str], level: int) -> None:
        whole = self._write(self._merged(old))
        frequent = F.col("n") >= self.least
        self.settled.append(self._write(self.spark.table(whole).filter(frequent)))
        self._put(self._write(self.spark.table(whole).filter(~frequent)), level)
        for name in (*old, whole):
            self.spark.sql(f"DROP TABLE {name}")

    def frequent(self) -> DataFrame:
        """(h1, h2) of the keys in at least ``least_docs`` documents of all batches so far."""
        known = [self.spark.table(n).select(*HASH) for n in self.settled]
        names = [n for level in self.levels for n in level]
        if names:
            known.append(self._merged(names).filter(F.col("n") >= self.least).select(*HASH))
        return reduce(DataFrame.unionByName, known)  # no key is in two of them

    def drop(self) -> None:
        """Removes the runs; for a caller that keeps no collection beyond one table."""
        for name in (*self.settled, *(n for level in self.levels for n in level)):
            self.spark.sql(f"DROP TABLE {name}")
        self.levels, self.settled = [], []


SCHEMA = "doc_id long, text string, n_lines long, n_dropped long"


def strip_lines(text: bytes | None, gone: set[bytes] | frozenset[bytes]) -> tuple[bytes, int, int]:
    """(kept text, lines, dropped lines)."""
    lines = (text or b"").split(b"\n")
    kept = [x for x in lines if key_hash(x) not in gone]
    return b"\n".join(kept), len(lines), len(lines) - len(kept)


def dedup_lines(docs: DataFrame, least_docs: int = LEAST_DOCS, batches: int = BATCHES, fanout: int = FANOUT, broadcast_keys: int = BROADCAST_KEYS) -> DataFrame:
    """doc_id, the text that is left, lines and dropped lines, for each row of docs (doc_id, text)."""
    spark = docs.sparkSession
    shared_dir(spark)
    keys = written(line_keys(docs, batches), "line-keys", ("batch",))
    runs = LineRuns(spark, least_docs, fanout)
    try:
        for i in range(batches):
            runs.add(keys.filter(F.col("batch") == i).select(*HASH))
        frequent = written(runs.frequent(), "frequent-lines")
    finally:
        runs.drop()
    if frequent.count() <= broadcast_keys:
        rows = frequent.toArrow()
        discard(keys, frequent)
        gone = spark.sparkContext.broadcast(np.column_stack([rows.column(c).to_numpy() for c in HASH]).astype("<i8").tobytes())

        def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            data = gone.value
            dropped = frozenset(data[i : i + 16] for i in range(0, len(data), 16))
            for piece in pieces(source):
                yield result(piece.column(0), [strip_lines(t, dropped) for t in piece.column(1).cast(pa.binary()).to_pylist()])

        return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)

    own = keys.select("r1", "r2", *HASH).join(frequent, HASH, "left_semi").groupBy("r1", "r2").agg(F.collect_set(F.struct(*HASH)).alias("gone"))
    joined = keyed(docs).join(own, ["r1", "r2"], "left").select("doc_id", "text", F.transform("gone", lambda x: x["h1"]).alias("g1"), F.transform("gone", lambda x: x["h2"]).alias("g2"))

    def each(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(source):
            g1, g2 = piece.column(2).to_pylist(), piece.column(3).to_pylist()
            sets = [set(map(bytes, np.column_stack([a, b]).astype("<i8").view(np.uint8))) if a else frozenset() for a, b in zip(g1, g2, strict=True)]
            yield result(piece.column(0), [strip_lines(t, s) for t, s in zip(piece.column(1).cast(pa.binary()).to_pylist(), sets, strict=True)])

    return joined.mapInArrow(each, SCHEMA)


def result(ids: pa.Array, found: list[tuple[bytes, int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([ids, pa.array([x[0] for x in found], pa.binary()).cast(pa.string()), *(pa.array([x[i] for x in found], pa.int64()) for i in (1, 2))], names=["doc_id", "text", "n_lines", "n_dropped"])


ORACLE_SQL = """
WITH lines AS (
  SELECT doc_id, i, l, translate(trim(l, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS l, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS i FROM documents)
), gone AS (SELECT k FROM lines WHERE length(k) >= 1 GROUP BY k HAVING count(DISTINCT doc_id) >= 10)
SELECT doc_id, CAST(count(*) AS BIGINT) AS n_lines, CAST(count(*) FILTER (WHERE k IN (SELECT k FROM gone)) AS BIGINT) AS n_dropped,
  sha256(coalesce(string_agg(l, chr(10) ORDER BY i) FILTER (WHERE k NOT IN (SELECT k FROM gone)), '')) AS kept_sha256
FROM lines GROUP BY doc_id
"""
