"""Neighbourhood codecs: gaps as variable-length bytes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, LongType


def varint(x: int) -> bytes:
    """Seven bits a byte, low ones first; the high bit says that more follow."""
    out = bytearray()
    while x > 0x7F:
        out.append(x & 0x7F | 0x80)
        x >>= 7
    out.append(x)
    return bytes(out)


def zigzag(x: int) -> int:
    return x * 2 if x >= 0 else -x * 2 - 1


def unzigzag(x: int) -> int:
    return x >> 1 if x & 1 == 0 else -((x + 1) >> 1)


def read_varints(data: bytes) -> Iterator[int]:
    value = shift = 0
    for b in data:
        value |= (b & 0x7F) << shift
        shift += 7
        if b < 0x80:
            yield value
            value = shift = 0


def encode(node: int, neighbors: list[int]) -> bytes:
    """Sorted neighbours: the first as a signed distance from the node, the others as gaps."""
    if not len(neighbors):
        return b""
    s = sorted(int(x) for x in neighbors)
    return varint(zigzag(s[0] - node)) + b"".join(varint(b - a) for a, b in zip(s, s[1:], strict=False))


def decode(node: int, data: bytes) -> list[int]:
    out: list[int] = []
    for x in read_varints(data):
        out.append(node + unzigzag(x) if not out else out[-1] + x)
    return out


def byte_lengths(x: np.ndarray) -> np.ndarray:
    """Bytes of each number's variable-length form."""
    out = np.ones(len(x), np.int64)
    for bits in range(7, 64, 7):
        out += x >> np.uint64(bits) > 0
    return out


def varints(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(the bytes of all numbers one after the other, the length of each)."""
    size = byte_lengths(x)
    place = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
    low = (np.repeat(x, size) >> (place * 7).astype(np.uint64)).astype(np.uint8) & 0x7F
    return low | np.where(place < np.repeat(size, size) - 1, 0x80, 0).astype(np.uint8), size


def numbers(data: np.ndarray) -> np.ndarray:
    """The numbers whose variable-length forms stand one after the other in data."""
    ends = np.flatnonzero(data < 0x80)
    starts = np.concatenate(([0], ends[:-1] + 1))
    place = np.arange(len(data)) - np.repeat(starts, ends - starts + 1)
    return np.add.reduceat((data & 0x7F).astype(np.uint64) << (place * 7).astype(np.uint64), starts) if len(ends) else np.zeros(0, np.uint64)


def split(x: np.ndarray, sizes: np.ndarray) -> list[np.ndarray]:
    return np.split(x, np.cumsum(sizes)[:-1]) if len(sizes) else []


@F.pandas_udf(BinaryType())
def encode_column(node: pd.Series, neighbors: pd.Series) -> pd.Series:
    """``encode`` over a whole batch; the neighbours are sorted."""
    n = neighbors.map(len).to_numpy(np.int64)
    if not n.sum():
        return pd.Series([b""] * len(n))
    all_ = np.concatenate([np.asarray(v, np.int64) for v in neighbors])
    first = (np.cumsum(n) - n)[n > 0]
    x = np.diff(all_, prepend=0)
    signed = all_[first] - node.to_numpy(np.int64)[n > 0]
    x[first] = np.where(signed >= 0, signed * 2, -signed * 2 - 1)
    data, size = varints(x.astype(np.uint64))
    per_row = np.bincount(np.repeat(np.arange(len(n)), n), size, len(n)).astype(np.int64)
    return pd.Series([b.tobytes() for b in split(data, per_row)])


@F.pandas_udf(ArrayType(LongType()))
def decode_column(node: pd.Series, data: pd.Series) -> pd.Series:
    """``decode`` over a whole batch."""
    raw = np.frombuffer(b"".join(data), np.uint8)
    x = numbers(raw).astype(np.int64)
    owner = np.repeat(np.arange(len(data)), data.map(len).to_numpy(np.int64))[raw < 0x80]
    n = np.bincount(owner, minlength=len(data))
    if not n.sum():
        return pd.Series([np.zeros(0, np.int64)] * len(data))
    first = (np.cumsum(n) - n)[n > 0]
    z = x[first]
    x[first] = node.to_numpy(np.int64)[n > 0] + np.where(z & 1 == 0, z >> 1, -((z + 1) >> 1))
    run = np.cumsum(x)
    return pd.Series(split(run - np.repeat((run[first] - x[first]), n[n > 0]), n))


def varint_length(c: Column) -> Column:
    """Bytes of a number's variable-length form."""
    return F.ceil(F.length(F.bin(c)) / 7)


def compression_statistics(edges: DataFrame) -> DataFrame:
    """One row: neighbours, stretches of consecutive ones, bytes as gaps, and how often eight plain bytes a neighbour are that; native."""
    w = Window.partitionBy("src").orderBy("dst")
    gap = F.col("dst") - F.lag("dst").over(w)
    signed = F.col("dst") - F.col("src")
    x = edges.select(gap.alias("gap"), F.when(signed >= 0, signed * 2).otherwise(-signed * 2 - 1).alias("first"))
    size = varint_length(F.coalesce("gap", "first"))
    out = x.agg(F.count("*").alias("neighbors"), F.sum((F.coalesce("gap", F.lit(0)) != 1).cast("long")).alias("stretches"), F.sum(size).alias("bytes"))
    return out.withColumn("ratio", F.col("neighbors") * 8 / F.col("bytes"))


def gaps(neighbors: Column) -> Column:
    """The differences of a sorted array, as a column expression."""
    return F.zip_with(F.slice(neighbors, 2, F.greatest(F.size(neighbors) - 1, F.lit(0))), F.slice(neighbors, 1, F.greatest(F.size(neighbors) - 1, F.lit(0))), lambda b, a: b - a)
