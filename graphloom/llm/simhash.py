"""SimHash near-duplicates by covering locality-sensitive hashing (operator 10).

Fingerprints: 64 majority bits over the XXH64 (seed 42) of a text's word shingles. Rows with one fingerprint are one node. For radius r
each bit position gets a nonzero vector of r + 1 bits; each of the 2^(r+1) - 1 nonzero vectors v selects the positions whose vector has
an odd inner product with it. Up to r differing positions leave some v orthogonal to all of their vectors, so every pair within the
radius agrees on all selected bits of some table: no link is missed.

Buckets of more than ``BUCKET`` fingerprints are covered anew on the bits that their mask left free (a pair in the bucket differs only
there, so the guarantee holds again), until they are small or so few bits are free that a bucket can't be large. Only then are the
fingerprints of a bucket compared, and a spanning forest of its links is emitted, not its pairs. No bucket is capped.

Defined results: null, empty and blank texts have fingerprint zero and link like any other; fewer words than a shingle give one shingle
of all the words; repeated rows share a component; an empty table gives no rows. A null doc_id never names a component (the smallest id
that isn't null does); a component without any id has a null component_id. Other columns are ignored by ``near_duplicates``.

``drop_near_duplicates`` (the pipeline's stage) takes similarity, not bits: Jaccard of the sets of ``width``-word shingles. A node is a
distinct sequence of words (rows with one are copies). It gets PRINTS fingerprints of its distinct words, each with bits of its own; two
texts that share four in five of their five-word shingles share nearly all of their words, so some of these fingerprints differ in RADIUS
bits at most, and the covering masks make every such pair collide. Exact similarity of the shingles decides; the only pairs that can be
missed are those whose fingerprints all differ in more bits (recall 0.98 on 1 973 pairs of the test tables, 0.96 between 0.80 and 0.85).

Its tables are looked up in rounds that grow, and what is similar to an earlier node of its bucket goes before the next round, so a large group
of near copies is settled by its first members and never emitted as pairs. A bucket of at most PIVOTS nodes is compared in pairs, a larger one
with its first node. Those of larger buckets that stay are a crowd: alike, as most of their words are the same, but not similar to the first. They are
not compared bucket by bucket, which would be every pair of them, but found by their rarest shingles (``rare_keys``): exactly, as each similar
pair of the crowd shares one. The nodes of such a key are compared with its first one, then with its next ones, then with more at a time, until
nobody is left: no bucket and no key is capped. Defined results of the stage: no two rows that stay are similar
(but for that recall); each row that goes is a copy of an earlier row (by doc_id, null last) or similar to one; null, empty and blank
texts are copies of each other; of rows equal in doc_id and text any one stays; an empty table gives no rows; all columns are kept.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import accumulate

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed, compact, pieces, release, small_batches
from .components import components

SEED = 42
BUCKET = 64
PRINTS, RADIUS, PIVOTS = 6, 3, 16
#: Pairs that differ in more of the 64 * PRINTS bits aren't compared: of the pairs at 0.8 or more on the test tables none differs in more than half as many.
FAR = 16 * PRINTS
#: Counters of the shingles of a crowd; any number gives the same pairs, more of them tell rare shingles from common ones more sharply.
SLOTS = 1 << 17
MIX1, MIX2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)


def fingerprint(text: str | None, width: int = 3) -> int:
    data = (text or "").encode("utf-8", "surrogatepass").lower()  # bytes.lower() changes A-Z only, bytes.split() parts at \x20, \x09-\x0D
    words = data.split()
    n = len(words)
    if not n:
        return 0
    if n <= width:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    line = b" ".join(words)
    ends = list(accumulate(map(len, words)))  # ends[i] + i: end of word i in line
    h = xxhash.xxh64_intdigest
    hashes = [h(line[(ends[i - 1] + i if i else 0) : ends[i + width - 1] + i + width - 1], SEED) for i in range(n - width + 1)]
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 65536):
        part = np.array(hashes[at : at + 65536], ">u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, width: int = 3) -> DataFrame:
    """(doc_id, fp): fp is the fingerprint's 64 bits as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches):
            fps = np.array([fingerprint(t, width) for t in piece.column(1).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([piece.column(0), pa.array(fps.view(np.int64))], names=["doc_id", "fp"])

    return small_batches(docs).select("doc_id", "text").mapInArrow(run, "doc_id long, fp long")


def covering(free: int, radius: int) -> list[int]:
    """The masks over the set bits of ``free``; free bits in order get the nonzero vectors of radius + 1 bits in turn."""
    places = [i for i in range(64) if free >> i & 1]
    vectors = {p: j % ((1 << radius + 1) - 1) + 1 for j, p in enumerate(places)}
    return [sum(1 << p for p in places if (vectors[p] & v).bit_count() & 1) for v in range(1, 1 << radius + 1)]


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def tables(rows: DataFrame, masks: dict[int, list[int]]) -> DataFrame:
    """(fp, mask, key): each row (fp, mask) once for each further mask of its bucket: mask grows by the bits of the new cover."""
    more = [(signed(have), [signed(have | m) for m in cover]) for have, cover in masks.items()]  # 343 entries at most for radius 2
    options = F.broadcast(rows.sparkSession.createDataFrame(more, "mask long, masks array<bigint>"))
    out = rows.join(options, "mask").select("fp", F.explode("masks").alias("mask"))
    return out.withColumn("key", F.col("fp").bitwiseAND(F.col("mask")))


def links(fps: DataFrame, radius: int = 2, bucket: int = BUCKET) -> DataFrame:
    """(a, b): links between distinct fingerprints ``fp`` that differ in at most ``radius`` bits, enough to keep every component."""
    full = (1 << 64) - 1
    masks = {0: covering(full, radius)}
    found = None
    rows = fps.select("fp", F.lit(0).cast("long").alias("mask"))
    while True:
        rows = tables(rows, masks)
        sizes = rows.groupBy("mask", "key").agg(F.count("*").alias("n")).filter("n > 1")
        kept = sorted({h | m for h, more in masks.items() for m in more})
        # buckets that can't be large: a mask leaves free bits, and a bucket holds one fingerprint for each setting of them at most;
        # six free bits always end it, as fewer can't be covered much further
        last = [m for m in kept if 1 << (64 - m.bit_count()) <= max(bucket, BUCKET)]
        small = (F.col("n") <= bucket) | F.col("mask").isin([signed(m) for m in last])
        tagged = rows.join(sizes.withColumn("small", small), ["mask", "key"])
        tagged = checkpointed(tagged)
        pairs = compared(tagged.filter("small"), radius)
        found = pairs if found is None else found.unionByName(pairs)
        masks = {m: covering(full & ~m, radius) for m in kept if m not in last}
        rows = tagged.filter("not small").select("fp", "mask")
        if not masks or rows.isEmpty():
            return found.distinct()


def compared(rows: DataFrame, radius: int) -> DataFrame:
    """A spanning forest of the links inside each small bucket."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for fps in frame["fps"]:
                x = np.asarray(fps, np.int64).view(np.uint64)
                near = np.bitwise_count(x[:, None] ^ x[None, :]) <= radius
                seen = np.zeros(len(x), bool)
                for root in range(len(x)):
                    if seen[root]:
                        continue
                    seen[root], queue = True, [root]
                    while queue:
                        i = queue.pop()
                        for j in np.flatnonzero(near[i] & ~seen):
                            seen[j] = True
                            queue.append(int(j))
                            out.append((x[i], x[j]))
            pairs = np.array(out, np.uint64).reshape(-1, 2).view(np.int64)
            yield pd.DataFrame({"a": pairs[:, 0], "b": pairs[:, 1]})

    lists = rows.groupBy("mask", "key").agg(F.collect_list("fp").alias("fps")).select("fps")
    return lists.mapInPandas(run, "a long, b long")


def near_duplicates(docs: DataFrame, width: int = 3, radius: int = 2) -> DataFrame:
    """(doc_id, fp, component_id) for each row of docs (doc_id, text)."""
    rows = checkpointed(fingerprints(docs, width))
    nodes = checkpointed(rows.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = components(links(nodes, radius), "a", "b")
    named = nodes.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    smallest = named.groupBy("root").agg(F.min("least").alias("component_id"))
    of = named.join(smallest, "root").select("fp", "component_id")
    return rows.join(of, "fp").select("doc_id", "fp", "component_id")


def word_prints(words: set[bytes], count: int = PRINTS) -> list[int]:
    """Majority bits over the words' hashes, ``count`` times with other bits; signed."""
    ones = np.zeros(64 * count, np.int64)
    hashes = np.fromiter((xxhash.xxh64_intdigest(w, SEED) for w in words), np.uint64, len(words))
    salts = np.arange(1, count + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for at in range(0, len(hashes), 8192):
        z = hashes[at : at + 8192, None] ^ salts
        z = (z ^ (z >> np.uint64(33))) * MIX1
        z = (z ^ (z >> np.uint64(33))) * MIX2
        z ^= z >> np.uint64(33)
        ones += np.unpackbits(z.astype(">u8").view(np.uint8).reshape(len(z), -1), axis=1).sum(0, dtype=np.int64)
    return np.packbits(ones * 2 > len(hashes)).view(">i8").tolist()


def shingles(words: list[bytes], width: int) -> np.ndarray:
    """The sorted distinct hashes of the shingles of lower-cased words; fewer words than a shingle are one shingle."""
    if not words:
        return np.zeros(0, np.uint64)
    line = b" ".join(words)
    if len(words) <= width:
        return np.array([xxhash.xxh64_intdigest(line, SEED)], np.uint64)
    ends = list(accumulate(map(len, words)))
    h = xxhash.xxh64_intdigest
    return np.unique(np.array([h(line[(ends[i - 1] + i if i else 0) : ends[i + width - 1] + i + width - 1], SEED) for i in range(len(words) - width + 1)], np.uint64))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def named(words: list[bytes]) -> int:
    return signed(xxhash.xxh64_intdigest(b" ".join(words), SEED))


def jaccard(x: np.ndarray, y: np.ndarray) -> float:
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both / (len(x) + len(y) - both) if len(x) or len(y) else 1.0


def keyed(docs: DataFrame) -> DataFrame:
    """docs with a key of (doc_id, text)."""
    return docs.withColumn("_s_key", F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), "text"))


def signatures(docs: DataFrame, prints: int) -> DataFrame:
    """(node, doc_id, key, prints) of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches):
            split = [words_of(t) for t in piece.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(list(map(named, split)), pa.int64()), piece.column(0), piece.column(1), pa.array([word_prints(set(w), prints) for w in split], pa.list_(pa.int64()))], names=["node", "doc_id", "key", "prints"])

    return small_batches(keyed(docs)).select("doc_id", "_s_key", "text").mapInArrow(run, "node long, doc_id long, key long, prints array<bigint>")


def shingle_sets(docs: DataFrame, keys: DataFrame, width: int) -> DataFrame:
    """(node, found): the shingles of the rows with these keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches):
            split = [words_of(t) for t in piece.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(list(map(named, split)), pa.int64()), pa.array([shingles(w, width).tobytes() for w in split], pa.binary())], names=["node", "found"])

    texts = keyed(docs).join(keys.select(F.col("key").alias("_s_key")), "_s_key", "left_semi").select("text")
    return compact(texts.mapInArrow(run, "node long, found binary").dropDuplicates(["node"]), 2_000)[0]


def rounds(prints: int, radius: int) -> list[list[tuple[int, int]]]:
    """The tables (fingerprint, mask) of each round: whole fingerprints and one mask of each, then all others."""
    masks = [(1 << 64) - 1, *covering((1 << 64) - 1, radius)]
    return [[(i, masks[j]) for i in range(prints) for j in some] for some in (range(2), range(2, len(masks)))]


def bucket_keys(nodes: DataFrame, tables: list[tuple[int, int]]) -> DataFrame:
    """(node, key): nodes (node, prints) once for each table, with the key of their bucket in it."""
    at, mask = np.array([i for i, _ in tables]), np.array([m for _, m in tables], np.uint64)
    mark = (mask * MIX1 + at.astype(np.uint64)) * MIX2  # tells the tables apart

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(i, 500) for i in range(0, batch.num_rows, 500)):
                prints = part.column(1).flatten().to_numpy().view(np.uint64).reshape(part.num_rows, -1)
                z = (prints[:, at] & mask) ^ mark
                z = (z ^ (z >> np.uint64(33))) * MIX1  # one to one
                z = (z ^ (z >> np.uint64(33))) * MIX2
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(part.column(0).to_numpy(), len(tables))), pa.array(z.ravel().view(np.int64))], names=["node", "key"])

    return nodes.select("node", "prints").mapInArrow(run, "node long, key long")


def crowded(rows: DataFrame) -> tuple[DataFrame, int]:
    """(rows whose key others have too, with the number ``n`` of those; how many rows that are)."""
    many = rows.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
    return compact(rows.join(many.hint("shuffle_hash"), "key"))


def similar_pairs(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """(node): b of each pair (a, b) that is similar."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            b, x, y = (batch.column(i).to_pylist() for i in range(3))
            out = [n for n, s, t in zip(b, x, y, strict=True) if jaccard(np.frombuffer(s, np.uint64), np.frombuffer(t, np.uint64)) >= similarity]
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.int64())], names=["node"])

    side = lambda n: sets.select(F.col("node").alias(n), F.col("found").alias(f"{n}_found"))
    both = pairs.join(side("a"), "a").join(side("b"), "b").select("b", "a_found", "b_found")
    return both.mapInArrow(run, "node long").distinct()


def distance(a: Column, b: Column, prints: int) -> Column:
    return sum((F.bit_count(F.get(a, F.lit(i)).bitwiseXOR(F.get(b, F.lit(i)))) for i in range(1, prints)), F.bit_count(F.get(a, F.lit(0)).bitwiseXOR(F.get(b, F.lit(0)))))


def overlapping(a: Column, b: Column, similarity: float) -> Column:
    """Whether sets that share the shingle at places a and b (size, rest) of their orders may be similar: no more than the rest of either is shared."""
    return F.least(a["rest"], b["rest"]) * (1 + similarity) + 0.001 >= (a["size"] + b["size"]) * similarity


def rare_keys(crowd: DataFrame, sets: DataFrame, similarity: float, slots: int = SLOTS) -> tuple[DataFrame, int]:
    """((node, least, at, met, key, n): the nodes of crowd (node, least, met) once for each key they share with others; how many rows that are).

    All shingles have one order, rarest in the crowd first (by counters that several shingles may share, then by hash). Sets that are similar
    share similarity / (1 + similarity) of the sum of their sizes, so the first shingle that they share has that many left, itself
    included, in either set. So only the first shingles of a set are its keys. What all the crowd has in common comes last in the order.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(slots, np.int64)
        for batch in batches:
            for found in batch.column(0).to_pylist():
                np.add.at(total, (np.frombuffer(found, np.uint64) % np.uint64(slots)).astype(np.int64), 1)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["slot", "n"])

    of = sets.join(crowd, "node")
    counts = of.select("found").mapInArrow(count, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    common = np.zeros(slots, np.int64)
    common[counts.column("slot").to_numpy()] = counts.column("n").to_numpy()
    common = common.clip(max=(1 << 31) - 1).astype(np.int32)  # travels with the tasks

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(i, 100) for i in range(0, batch.num_rows, 100)):
                out, sizes, rests = [], [], []
                for found in part.column(3).to_pylist():
                    x = np.frombuffer(found, np.uint64)
                    order = np.lexsort((x, common[(x % np.uint64(slots)).astype(np.int64)]))
                    out.append(x[order[: int(len(x) * (1 - similarity) + 0.001) + 1]])
                    sizes.append(len(x))
                    rests.append(len(x) - np.arange(len(out[-1])))
                times = [len(k) for k in out]
                many = lambda i: part.column(i).take(pa.array(np.repeat(np.arange(part.num_rows), times)))  # noqa: B023, E731
                yield pa.RecordBatch.from_arrays([*map(many, range(3)), pa.array(np.concatenate(out).view(np.int64)), pa.array(np.repeat(sizes, times)), pa.array(np.concatenate(rests))], names=["node", "least", "met", "key", "size", "rest"])

    rows = of.select("node", "least", "met", "found").mapInArrow(keys, "node long, least long, met boolean, key long, size long, rest long")
    rows = compact(rows.select("node", "least", F.struct("size", "rest").alias("at"), "met", "key"))[0]
    # beside the smallest set of its key a set may be too large to have this shingle among its first ones
    least = rows.groupBy("key").agg(F.count("*").alias("n"), F.min("at.size").alias("few")).filter("n > 1").select("key", "few")
    rows = rows.join(least.hint("shuffle_hash"), "key").filter(overlapping(F.col("at"), F.struct(F.col("few").alias("size"), F.col("at.rest").alias("rest")), similarity))
    return crowded(compact(rows.drop("few"))[0])


def settled(rows: DataFrame, sets: DataFrame, similarity: float, near: Callable[[Column, Column], Column], pivots: int, seen: DataFrame | None, once: bool = False) -> tuple[DataFrame, DataFrame, DataFrame, int]:
    """(node): the nodes of rows (node, least, at, met, key, n) that are similar to an earlier one of their key that itself was met first.

    Pairs are compared only if ``near`` of their ``at`` holds and not both have been ``met``.
    seen: the pairs (a, b) compared so far; they are not compared again, and come back with those compared here. Then come the rows that are left
    and their number: none, or with ``once`` what is left of large keys that were compared with their first node only.
    """
    gone, most, open_ = None, 0, 1
    while open_:
        if most:
            rank = F.row_number().over(Window.partitionBy("key").orderBy("least", "node"))  # the planner keeps ``most`` of a key in each task
            first = rows.withColumn("rank", rank).filter(F.col("rank") <= most).select("key", "least", "node", "at", "met")
        else:  # a large bucket may be a group of near copies: its first node settles most of it
            one = rows.filter(F.col("n") > pivots).groupBy("key").agg(F.min(F.struct("least", "node", "at", "met")).alias("p")).select("key", "p.*")
            first = one.unionByName(rows.filter(F.col("n") <= pivots).select("key", "least", "node", "at", "met"))
        first = compact(first)[0]
        both = rows.join(first.select("key", *(F.col(c).alias(f"a_{c}") for c in ("node", "least", "at", "met"))), "key")
        both = both.filter((F.struct("a_least", "a_node") < F.struct("least", "node")) & ~(F.col("a_met") & F.col("met")) & near(F.col("a_at"), F.col("at")))
        pairs = both.select(F.col("a_node").alias("a"), F.col("node").alias("b")).distinct()
        pairs = compact(pairs if seen is None else pairs.join(seen, ["a", "b"], "left_anti"))[0]
        seen = pairs if seen is None else seen.unionByName(pairs)
        out = compact(similar_pairs(pairs, sets, similarity))[0]
        gone = out if gone is None else gone.unionByName(out)
        rows, open_ = crowded(rows.drop("n").join(first.select("key", "node"), ["key", "node"], "left_anti").join(out, "node", "left_anti"))
        if once:
            break
        most = min(4 * most, 16 * pivots) if most else 2 * pivots
    return gone.distinct(), seen, rows, open_


def drop_near_duplicates(docs: DataFrame, width: int = 5, similarity: float = 0.8, prints: int = PRINTS, radius: int = RADIUS, far: int = FAR, pivots: int = PIVOTS) -> DataFrame:
    """The rows of docs, with their own columns, that are neither a copy of an earlier row nor similar to one."""
    found = checkpointed(signatures(docs, prints))
    last = F.coalesce("doc_id", F.lit((1 << 63) - 1))
    one = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")).alias("one")
    nodes, _ = compact(found.groupBy("node").agg(F.min(last).alias("least"), one, F.any_value("prints").alias("prints")).select("node", "least", F.col("one.key").alias("key"), "prints"), 5_000)
    gone = seen = crowd = None
    for some in rounds(prints, radius):
        left = nodes if gone is None else nodes.join(gone, "node", "left_anti")
        rows, n = crowded(bucket_keys(left, some))
        release(docs.sparkSession)
        if not n:
            continue
        of = left.select("node", "least", F.col("prints").alias("at"))
        if crowd is None:
            of = of.withColumn("met", F.lit(False))
        else:  # all similar pairs of the last crowd have been found
            of = of.join(crowd.select("node", F.lit(True).alias("met")), "node", "left").fillna(False, ["met"])
        rows = compact(rows.join(of, "node"))[0]
        sets = shingle_sets(docs, left.join(rows, "node", "left_semi").select("key"), width)
        new, seen, rows, n = settled(rows, sets, similarity, lambda a, b: distance(a, b, prints) <= far, pivots, seen, once=True)
        if n:
            crowd = compact(rows.select("node", "least", "met").distinct())[0]
            rows, n = rare_keys(crowd, sets, similarity)
        if n:
            more, seen, _, _ = settled(rows, sets, similarity, lambda a, b: overlapping(a, b, similarity), pivots, seen)
            new = new.unionByName(more)
        gone = compact(new if gone is None else gone.unionByName(new))[0]
        release(docs.sparkSession)
    stay = (nodes if gone is None else nodes.join(gone, "node", "left_anti")).select(F.col("key").alias("_s_key"))
    return keyed(docs).join(stay, "_s_key", "left_semi").dropDuplicates(["_s_key"]).select(*(F.col(f"`{c}`") for c in docs.columns))
