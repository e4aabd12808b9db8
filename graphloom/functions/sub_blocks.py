"""How k final blocks are spread over the k' blocks of a coarser level, and the limits that follow from it."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from .integers import ceil_log2


def final_k(block: int, current_k: int, k: int) -> int:
    """Final blocks inside ``block`` of ``current_k``: halving, larger half first, by the bits of the block from the top.

    current_k is a power of two (or k itself, where every block is final).
    """
    if current_k == k:
        return 1
    level = ceil_log2(current_k)
    base, rest = k >> level, k & ((1 << level) - 1)
    reverse = int(format(block, f"0{level}b")[::-1], 2) if level else 0
    return base + (reverse < rest)


def final_k_column(block: Column, current_k: int, k: Column) -> Column:
    """The same for columns of blocks and of k; current_k is a power of two."""
    level = ceil_log2(current_k)
    if level == 0:
        return k.cast("int")
    reverse = F.conv(F.reverse(F.lpad(F.bin(block), level, "0")), 2, 10).cast("long")
    base, rest = F.floor(k / current_k), k % current_k
    return (base + (reverse < rest).cast("int")).cast("int")


def first_sub_block(block: int, current_k: int, k: int) -> int:
    return sum(final_k(b, current_k, k) for b in range(block))


def first_invalid_sub_block(block: int, current_k: int, k: int) -> int:
    return first_sub_block(block + 1, current_k, k)


def k_for_n(n: int, contraction_limit: int, k: int) -> int:
    """Blocks that a level of n nodes should have."""
    if n < 2 * contraction_limit:
        return min(2, k)
    return max(2, min(1 << ceil_log2(max(1, n // contraction_limit)), k)) if k > 1 else 1


def next_k(current: int, k: int) -> int:
    return min(2 * current, k)


def uniform_limit(total: int, k: int, epsilon: float) -> int:
    return int((1.0 + epsilon) * math.ceil(total / k))


def relaxed_limit(limit: int, epsilon: float, max_node_weight: int) -> int:
    """On coarse levels one node more than perfect balance fits."""
    return max(limit, math.ceil(limit / (1.0 + epsilon)) + max_node_weight)


def inferred_epsilon(limits: list[int], total: int) -> float:
    return sum(limits) / total - 1.0 if total else 0.0


def perfect_weight(limit: int, epsilon: float) -> int:
    return math.ceil(limit / (1.0 + epsilon))


def max_cluster_weight(total: int, n: int, k: int, epsilon: float, contraction_limit: int, kind: str = "epsilon-block-weight", multiplier: float = 1.0) -> int:
    if kind == "zero":
        return 0
    if kind == "one":
        return int(multiplier)
    if kind == "static-block-weight":
        return int((1.0 + epsilon) * total / k * multiplier)
    return int(epsilon * total / max(2, min(n // max(contraction_limit, 1), k)) * multiplier)


def adapted_epsilon(epsilon: float, total: int, sub_total: int, k: int, sub_k: int) -> float:
    """The slack of one bisection such that all of them together stay within epsilon."""
    if sub_k < 2 or not sub_total:
        return epsilon
    base = (1.0 + epsilon) * sub_k * total / k / sub_total
    return max(base ** (1.0 / ceil_log2(sub_k)) - 1.0, 1e-4)


def repetition_count(multiplier: float, sub_blocks: int, k: int, least: int, most: int) -> int:
    """How often a bisection into so many of k blocks is tried: more often where more hangs on it."""
    return max(least, min(most, math.ceil(multiplier * sub_blocks / max(ceil_log2(k), 1))))
