"""Benchmark decontamination by training suffix arrays (operator 6).

Each shard (a bounded piece of an Arrow batch) of the documents gets a suffix array over its word sequence, benchmark suffixes are
binary-searched in it, and the equal range of a suffix gives every verbatim occurrence with its place, from which matches are extended
to their longest. Words become ids of the benchmark's vocabulary, any other word is 0. The array is sparse: it holds the suffixes whose
first words are all in the vocabulary, as many as the shortest window has; no other suffix can begin with a window.

A shard holds whole documents, so a document's result is final where it is made and nothing is shuffled. The benchmark is read in
blocks of at most ``BLOCK_BYTES`` of text, each broadcast; the hits of earlier blocks travel with the row.

Defined results: a null, empty or blank text has no words, no hits and the digest of no items; an item without words never occurs; an
item of fewer words than a window is one window; items with one item_id count once; a null item_id is left out of the digest but its
words hit; empty tables give no rows, an empty benchmark no hits; repeated rows give repeated results; other columns are ignored by
``match`` and kept by ``drop_contaminated`` and ``drop_affected``.
"""

from __future__ import annotations

import pickle
import re
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pieces, small_batches

WINDOW = 8
BLOCK_BYTES = 4 << 20  # a worker holds some thirty times that as dictionaries
#: Over UTF-8 bytes: every byte of a character beyond ASCII is part of a word.
WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words_of(text: bytes | str | None) -> list[bytes]:
    data = text.encode() if isinstance(text, str) else text
    return WORD.findall(data.lower()) if data else []  # bytes.lower() changes A-Z only


class Queries:
    """The benchmark's side of the search: vocabulary, items as id sequences, and their windows as sorted distinct suffix heads."""

    def __init__(self, items: list[tuple[int | None, str | None]], window: int = WINDOW):
        self.window, self.ids, self.vocabulary = window, [], {}
        sequences = []
        for item, text in items:
            if w := words_of(text):
                self.ids.append(item)
                sequences.append([self.vocabulary.setdefault(x, len(self.vocabulary) + 1) for x in w])
        heads: dict[tuple[int, ...], list[tuple[int, int]]] = {}
        for k, s in enumerate(sequences):
            size = min(window, len(s))
            for i in range(len(s) - size + 1):
                heads.setdefault(tuple(s[i : i + size]), []).append((k, i))
        self.sequences = [np.array(s, np.int32) for s in sequences]
        self.shortest = min((len(h) for h in heads), default=window)
        self.heads = sorted(heads)
        self.owners = [heads[h] for h in self.heads]


def suffix_array(seq: np.ndarray, least: int, depth: int) -> np.ndarray:
    """The places whose first ``least`` ids are nonzero, sorted by their first ``depth`` ids."""
    known = np.concatenate(([0], np.cumsum(seq != 0)))
    places = np.flatnonzero(known[least:] - known[:-least] == least) if len(seq) >= least else np.zeros(0, np.int64)
    padded = np.concatenate((seq, np.zeros(depth, seq.dtype)))
    return places[np.lexsort([padded[places + d] for d in range(depth - 1, -1, -1)])] if len(places) else places


def equal_range(padded: np.ndarray, array: np.ndarray, head: tuple[int, ...]) -> tuple[int, int]:
    """Binary search, one id after the other inside the range so far: the suffixes that begin with head."""
    lo, hi = 0, len(array)
    for d, x in enumerate(head):
        if lo == hi:
            break
        view = padded[array[lo:hi] + d]
        lo, hi = lo + int(np.searchsorted(view, x, "left")), lo + int(np.searchsorted(view, x, "right"))
    return lo, hi


def ranges(padded: np.ndarray, array: np.ndarray, heads: list[tuple[int, ...]]) -> Iterator[tuple[int, int, int]]:
    """(query, from, to) of each head that occurs; first ids are looked up all at once."""
    if not len(array) or not heads:
        return
    first = padded[array]
    starts = np.searchsorted(first, [h[0] for h in heads], "left")
    ends = np.searchsorted(first, [h[0] for h in heads], "right")
    for q in np.flatnonzero(starts < ends):
        lo, hi = int(starts[q]), int(ends[q])
        a, b = equal_range(padded, array[lo:hi], heads[q])
        if a < b:
            yield int(q), lo + a, lo + b


def search(texts: list[bytes | str | None], queries: Queries, longest: bool = True) -> list[tuple[int, np.ndarray, set[int], int, int]]:
    """For each text: words, hit word places, items (places in queries.ids), words and place of its longest match."""
    split = [words_of(t) for t in texts]
    get = queries.vocabulary.get
    # one 0 between documents: no match crosses them
    seq = np.fromiter(chain.from_iterable(chain(map(get, w, repeat(0)), (0,)) for w in split), np.int32)
    sizes = np.array([len(w) for w in split], np.int64)
    starts = np.concatenate(([0], np.cumsum(sizes + 1)))
    padded = np.concatenate((seq, np.zeros(queries.window + 1, np.int32)))
    array = suffix_array(seq, queries.shortest, queries.window)
    edge = np.zeros(len(seq) + 1, np.int64)
    items: list[set[int]] = [set() for _ in texts]
    best = [(0, -1)] * len(texts)
    for q, lo, hi in ranges(padded, array, queries.heads):
        head = queries.heads[q]
        places = array[lo:hi]
        np.add.at(edge, places, 1)
        np.add.at(edge, places + len(head), -1)
        docs = np.searchsorted(starts, places, "right") - 1
        for doc in np.unique(docs):
            items[doc].update(k for k, _ in queries.owners[q])
        if longest:
            for k, i in queries.owners[q]:
                for n, p in zip(*extend(padded, places, queries.sequences[k], i), strict=True):
                    doc = int(np.searchsorted(starts, p, "right")) - 1
                    best[doc] = max(best[doc], (int(n), -int(p - starts[doc]) - 1))
    hit = np.cumsum(edge[:-1]) > 0
    return [(int(n), np.flatnonzero(hit[s : s + n]), found, m, -p - 1) for n, s, found, (m, p) in zip(sizes, starts[:-1], items, best, strict=True)]


def extend(padded: np.ndarray, places: np.ndarray, item: np.ndarray, start: int) -> tuple[np.ndarray, np.ndarray]:
    """(length, place) of the verbatim matches between item[start:] and the text at the places."""
    length, live = np.zeros(len(places), np.int64), np.arange(len(places))
    for d, x in enumerate(item[start:]):
        at = places[live] + d
        live = live[(at < len(padded)) & (padded[np.minimum(at, len(padded) - 1)] == x)]
        if not len(live):
            break
        length[live] = d + 1
    return length, places


def blocks(benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> Iterator[list[tuple]]:
    """The benchmark's rows in parts of about block_bytes of text each, one at a time on the driver."""
    rows = benchmark.select("item_id", "text").filter("text is not null")
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = total // block_bytes + 1
    for i in range(n):
        part = rows if n == 1 else rows.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == i)
        yield [tuple(r) for r in part.collect()]


STATE = "n_words long, hits array<int>, items array<string>, longest long, longest_at long"


def pass_over(docs: DataFrame, items: list[tuple], window: int) -> DataFrame:
    """docs (payload columns and text, or also the state of earlier passes) with the state brought up to date."""
    shared = docs.sparkSession.sparkContext.broadcast(pickle.dumps(Queries(items, window)))
    own = [c for c in docs.columns if not c.startswith("_s_")]
    again = len(own) < len(docs.columns)
    at = own.index("text")
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries = pickle.loads(shared.value)
        for piece in pieces(batches):
            found = search(piece.column(at).cast(pa.binary()).to_pylist(), queries)
            state = [(n, hit.tolist(), sorted({str(queries.ids[k]) for k in got if queries.ids[k] is not None}), m, p) for n, hit, got, m, p in found]
            if again:
                old = zip(*(piece.column(len(own) + i).to_pylist() for i in range(5)), strict=True)
                state = [(n, sorted({*hit, *o[1]}), sorted({*got, *o[2]}), *max((m, p), (o[3], o[4]))) for (n, hit, got, m, p), o in zip(state, old, strict=True)]
            cols = list(zip(*state, strict=True))
            types = (pa.int64(), pa.list_(pa.int32()), pa.list_(pa.string()), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([piece.column(i) for i in range(len(own))] + [pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=names)

    state = [f"_s_{x.split()[0]}" for x in STATE.split(", ")]
    names = own + state
    schema = ", ".join([f"`{c}` {kinds[c]}" for c in own] + [f"_s_{x}" for x in STATE.split(", ")])
    return small_batches(docs).mapInArrow(run, schema)


def matched(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """docs with the _s_ columns: words, hit places, item ids as strings, longest match and its place."""
    for items in blocks(benchmark):
        docs = pass_over(docs, items, window)
    return docs


def match(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, least_items: int = 2) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items (sorted ids as strings), contaminated, longest_match and its first word."""
    n = F.size("_s_items").cast("long")
    found = matched(docs.select("doc_id", "text"), benchmark, window)
    at = F.when(F.col("_s_longest") > 0, F.col("_s_longest_at"))
    return found.select("doc_id", F.col("_s_n_words").alias("n_words"), F.size("_s_hits").cast("long").alias("n_hit"), n.alias("n_items"), F.col("_s_items").alias("items"), (n >= least_items).alias("contaminated"), F.col("_s_longest").alias("longest_match"), at.alias("longest_match_at"))


def rows_found(docs: DataFrame, benchmark: DataFrame, window: int) -> DataFrame:
    """docs as one column ``row``, with text and the _s_ columns."""
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")
    return matched(docs.select(row, F.col("text").alias("text")), benchmark, window)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, least_items: int = 2) -> DataFrame:
    """The rows of docs, with their own columns, that are not contaminated as the query's column says."""
    return rows_found(docs, benchmark, window).filter(F.size("_s_items") < least_items).select("row.*")


def drop_affected(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The rows of docs, with their own columns, in which no window of any item occurs; items without an id count too."""
    return rows_found(docs, benchmark, window).filter(F.size("_s_hits") == 0).select("row.*")



ORACLE_SQL = """
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark
), windows AS (
  SELECT DISTINCT item_id, least(8, len(w)) AS size, array_to_string(w[i : i + least(8, len(w)) - 1], ' ') AS win
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(8, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)
), sizes AS (SELECT DISTINCT size FROM windows),
spots AS (
  SELECT doc_id, size, i, array_to_string(w[i : i + size - 1], ' ') AS win
  FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM d, sizes WHERE len(w) >= size)
), occ AS (SELECT DISTINCT doc_id, i, spots.size, item_id FROM spots JOIN windows USING (win)),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + size)) AS p FROM occ) GROUP BY 1),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS id FROM occ) GROUP BY 1)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_items, 0) >= 2 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id)
"""
