"""Sharding by histogram sort (operator 8); DataFrame functions only. Law ``bytes``: the sizes of the shards are near equal.

Rows are ordered by a 126-bit key, (hash of the text, hash of doc_id and text), so that equal texts are neighbours and a group too large
for one shard is cut between its members. The key domain is probed at even boundaries; the exact bytes and rows below every probe are
counted in one aggregation with a partial sum for each task. A splitter whose probes are farther apart than the tolerance gets new probes
inside its interval, and so does an interval of too many rows; rounds go on until all splitters meet the tolerance or stand next to a
single row. Then every row finds its interval by comparing key prefixes, and the rows are exchanged once, by interval; slots are the
interval's offset plus the rank inside it, so no task ever holds a whole shard.

Histograms on the driver have one row for each interval: 2**bits of them and a further 2**BITS for each interval that is refined.

Defined results: a null text counts no bytes, has the check sum of an empty text and stands with the other nulls and empty texts; rows
that are equal in doc_id and text are told apart by nothing, so any of them may have either slot; an empty table gives no rows; a null
doc_id is hashed like any other; other columns are ignored by ``assign``, kept by ``shard``, whose own columns replace any that clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed

SHARDS = 40
OVERHEAD = 16
TOLERANCE = 0.005
MOST_ROWS = 1_000_000
BITS, WIDTH = 12, 126


def sized(docs: DataFrame) -> DataFrame:
    """docs with ``size`` and the key halves ``k1``, ``k2`` (63 bits each)."""
    half = lambda *c: F.shiftrightunsigned(F.xxhash64(*c), 1)
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.withColumns({"size": F.octet_length(text).cast("long") + OVERHEAD, "k1": half(text), "k2": half("doc_id", text, F.lit(8))})


def bits(start: int, n: int) -> Column:
    """Bits start to start + n of the key, from the most significant; they may lie on both halves."""

    def part(half: str, a: int, b: int) -> Column:
        return F.shiftrightunsigned(F.col(half), 63 - b).bitwiseAND(F.lit((1 << (b - a)) - 1))

    a, b = start, start + n
    if b <= 63:
        return part("k1", a, b)
    if a >= 63:
        return part("k2", a - 63, b - 63)
    return F.shiftleft(part("k1", a, 63), b - 63) + part("k2", 0, b - 63)


class Interval:
    """The keys with one prefix: start and stop as 126-bit numbers, exact rows and bytes."""

    __slots__ = ("path", "depth", "start", "rows", "bytes")

    def __init__(self, path: str, depth: int, start: int, rows: int, size: int):
        self.path, self.depth, self.start, self.rows, self.bytes = path, depth, start, rows, size


def first_bits(rows: int, most_rows: int) -> int:
    """So many bits that an even interval holds a quarter of most_rows at most; 4 096 intervals at least, 2**20 at most."""
    n = BITS
    while n < 20 and rows >> n > most_rows // 4:
        n += 1
    return n


def path_of(depths: list[int], refined: list[list[str]]) -> Column:
    """The interval of a row: its first digits, and further ones as long as the path so far was refined."""
    digits = lambda a, b: F.conv(bits(a, b - a).cast("string"), 10, 16)
    out = digits(0, depths[0])
    for i, paths in enumerate(refined):
        out = longer(out, paths, digits(depths[i], depths[i + 1]))
    return out


def longer(path: Column, refined: list[str], digits: Column) -> Column:
    """path, with the digits if it is a refined one; bound once, as a level that named it three times would triple the expression."""
    return F.transform(F.array(path), lambda p: F.when(p.isin(refined), F.concat(p, F.lit("."), digits)).otherwise(p))[0]


def histogram(keys: DataFrame, shards: int, tolerance: float = TOLERANCE, most_rows: int = MOST_ROWS) -> tuple[list[Interval], list[int], list[list[str]], list[int]]:
    """(intervals in key order, splitters as places between them, refined paths of each level, depths)."""
    rows, total = keys.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    depths = [first_bits(rows, most_rows)]
    count = lambda df, path: df.groupBy(path.alias("path")).agg(F.count("*").alias("rows"), F.sum("size").alias("bytes")).collect()
    found = [Interval(r["path"], depths[0], int(r["path"], 16) << (WIDTH - depths[0]), r["rows"], r["bytes"]) for r in count(keys, path_of(depths, []))]
    refined: list[list[str]] = []
    while True:
        found.sort(key=lambda x: x.start)
        splitters, poor = split(found, shards, total, tolerance)
        again = {x for x in found if x.depth == depths[-1] and x.rows > 1 and (x in poor or x.rows > most_rows)}
        if not again or depths[-1] == WIDTH:
            return found, splitters, refined, depths
        refined.append(sorted(x.path for x in again))
        depths.append(min(depths[-1] + BITS, WIDTH))
        inside = keys.filter(path_of(depths[:-1], refined[:-1]).isin(refined[-1]))
        parents = {x.path: x for x in again}
        found = [x for x in found if x not in again]
        for r in count(inside, path_of(depths, refined)):
            parent, digit = r["path"].rsplit(".", 1)
            found.append(Interval(r["path"], depths[-1], parents[parent].start + (int(digit, 16) << (WIDTH - depths[-1])), r["rows"], r["bytes"]))


def split(found: list[Interval], shards: int, total: int, tolerance: float) -> tuple[list[int], set[Interval]]:
    """The boundary nearest to each splitter's target bytes, and the intervals that must be refined for the tolerance."""
    splitters, poor, at, below = [], set(), 0, 0
    for j in range(1, shards):
        target = total * j / shards
        while at < len(found) and below + found[at].bytes <= target:
            below += found[at].bytes
            at += 1
        over = found[at].bytes if at < len(found) else 0
        up = over and below + over - target < target - below
        splitters.append(at + bool(up))
        if at < len(found) and min(target - below, below + over - target) > tolerance * total / shards:
            poor.add(found[at])
    return splitters, poor


def placed(rows: DataFrame, keys: DataFrame, shards: int, tolerance: float, most_rows: int) -> DataFrame:
    """rows (with k1, k2) with ``shard`` and ``slot``, by the histogram of keys; the one exchange is by interval.

    The table of intervals is joined by the same partitioning, so that it is the only other thing that moves.
    """
    found, splitters, refined, depths = histogram(keys, shards, tolerance, most_rows)
    table, j, first = [], 0, 0
    for i, x in enumerate(found):
        while j < len(splitters) and splitters[j] <= i:
            j, first = j + 1, 0
        table.append((x.path, j, first))
        first += x.rows
    places = rows.sparkSession.createDataFrame(table, "_path string, shard int, _first long")
    rank = F.row_number().over(Window.partitionBy("_path").orderBy("k1", "k2"))
    out = rows.withColumn("_path", path_of(depths, refined)).withColumn("_rank", rank).join(places, "_path")
    return out.withColumn("slot", F.col("_first") + F.col("_rank") - 1).drop("_path", "_rank", "_first", "k1", "k2")


def assign(docs: DataFrame, shards: int = SHARDS, tolerance: float = TOLERANCE, most_rows: int = MOST_ROWS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard for each row of docs; the text itself is not exchanged."""
    crc = F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32")
    rows = checkpointed(sized(docs.select("doc_id", "text")).select("doc_id", "size", crc, "k1", "k2"))
    out = placed(rows, rows, shards, tolerance, most_rows)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def shard(docs: DataFrame, shards: int = SHARDS, tolerance: float = TOLERANCE, most_rows: int = MOST_ROWS) -> DataFrame:
    """docs with ``size``, ``law``, ``shard`` and ``slot``: one pass for the counts, one with the exchange."""
    keys = checkpointed(sized(docs.select("doc_id", "text")).select("size", "k1", "k2"))
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row")
    rows = sized(docs.select(row, "doc_id", "text")).select("_row", "size", "k1", "k2")
    own = [F.col("_row")[c].alias(c) for c in docs.columns if c.lower() not in {"size", "law", "shard", "slot"}]
    return placed(rows, keys, shards, tolerance, most_rows).select(*own, "size", F.lit("bytes").alias("law"), "shard", "slot")
