"""Integer helpers, as plain Python for the driver and as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def floor_log2(x: int) -> int:
    return x.bit_length() - 1


def ceil_log2(x: int) -> int:
    return (x - 1).bit_length()


def floor2(x: int) -> int:
    return 1 << floor_log2(x)


def ceil2(x: int) -> int:
    return 1 << ceil_log2(x)


def is_power_of_2(x: int) -> bool:
    return x > 0 and x & (x - 1) == 0


def div_ceil(a: int, b: int) -> int:
    return -(-a // b)


def split_integral(value: int, ratio: float = 0.5) -> tuple[int, int]:
    """(rounded-up share, rest)."""
    first = -int(-(value * ratio) // 1)
    return first, value - first


def local_range(n: int, size: int, rank: int) -> tuple[int, int]:
    """The rank-th of ``size`` contiguous ranges of n elements; the first n % size are one longer."""
    chunk, rest = divmod(n, size)
    start = rank * chunk + min(rank, rest)
    return start, start + chunk + (rank < rest)


def local_range_rank(n: int, size: int, element: int) -> int:
    """The range that holds the element."""
    chunk, rest = divmod(n, size)
    edge = rest * (chunk + 1)
    return element // (chunk + 1) if element < edge else rest + (element - edge) // max(chunk, 1)


def round_robin(global_id: int, size: int, n: int) -> int:
    """The place of an element dealt in turn to ``size`` ranges and then laid out range by range."""
    owner, at = global_id % size, global_id // size
    return local_range(n, size, owner)[0] + at


def grid_encode(row: int, column: int, columns: int) -> int:
    return row * columns + column


def grid_decode(x: int, columns: int) -> tuple[int, int]:
    return divmod(x, columns)


def floor_log2_column(c: Column) -> Column:
    """Exact for every positive long: the length of the binary digits."""
    return F.length(F.bin(c)) - 1


def degree_bucket(c: Column) -> Column:
    """0 for degree 0, else 1 + floor(log2(degree))."""
    return F.when(c == 0, F.lit(0)).otherwise(F.length(F.bin(c))).cast("int")


def lowest_degree(bucket: int) -> int:
    return 0 if bucket == 0 else 1 << (bucket - 1)


def relative_gain(gain: Column, weight: Column) -> Column:
    """gain * weight if it is positive, else gain / weight."""
    return F.when(gain > 0, (gain * weight).cast("double")).otherwise(gain / weight)


def local_rank_column(id_: Column, n: int, size: int) -> Column:
    chunk, rest = divmod(n, size)
    edge = rest * (chunk + 1)
    return F.when(id_ < edge, F.floor(id_ / (chunk + 1))).otherwise(rest + F.floor((id_ - edge) / max(chunk, 1))).cast("int")


#: A prime below 2**31: products of two residues fit a long, in Spark and in plain SQL alike.
PRIME = 2_147_483_647


def scrambled(c: Column, seed: int = 0) -> Column:
    """A seeded permutation-like hash of small longs in plain integer arithmetic, so that any SQL engine gives the same."""
    return ((c % PRIME) * F.lit(48_271) + F.lit(seed * 16_807 + 12_345)) % PRIME


def scrambled_sql(c: str, seed: int = 0) -> str:
    return f"(((({c}) % {PRIME}) * 48271 + {seed * 16807 + 12345}) % {PRIME})"


def gain_bucket(gain: Column, base: float = 1.1) -> Column:
    """0 for no loss, then by the logarithm of the loss; gains mirror it below 0."""
    return F.when(gain > 0, -F.ceil(F.log(1 + gain) / F.log(F.lit(base)))).otherwise(F.ceil(F.log(1 - gain) / F.log(F.lit(base)))).cast("int")


def div_ceil_column(a: Column, b: Column) -> Column:
    return F.floor((a + b - 1) / b)


def div_floor_column(a: Column, b: Column) -> Column:
    return F.floor(a / b)


def abs_diff_column(a: Column, b: Column) -> Column:
    return F.abs(a - b)


def is_square_column(c: Column) -> Column:
    root = F.round(F.sqrt(c)).cast("long")
    return root * root == c


def edge_hash(src: Column, dst: Column, seed: int = 0) -> Column:
    """A seeded hash of an edge, the same in both directions."""
    return scrambled(scrambled(F.least(src, dst), seed) + F.greatest(src, dst), seed + 1)
