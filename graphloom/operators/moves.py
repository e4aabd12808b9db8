"""Admission of proposed moves: which of them a capacity lets through, without sorting a target's proposals in one task.

Proposals are ranked by (gain downwards, bucket, id), bucket being a hash of the id. The weights per (target, gain, bucket) are summed
first, with a partial sum for each task; running sums over this histogram say what comes before each bucket, and rows are ranked only
inside theirs. The moves are read twice, so callers materialise them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.integers import scrambled

BUCKETS = 1024


def bucket(seed: int = 0) -> Column:
    return (scrambled(F.col("id"), seed) % BUCKETS).cast("int")


def running(moves: DataFrame, group: str, rank: str = "gain", seed: int = 0) -> DataFrame:
    """moves with ``group_before`` and ``group_upto``: running weights per ``group`` of the histogram cell that holds the move."""
    cells = moves.withColumn("cell", bucket(seed))
    h = cells.groupBy(group, rank, "cell").agg(F.sum("weight").alias("cell_weight"))
    run = Window.partitionBy(group).orderBy(F.desc(rank), "cell").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    h = h.withColumn("group_upto", F.sum("cell_weight").over(run)).withColumn("group_before", F.col("group_upto") - F.col("cell_weight")).drop("cell_weight")
    return cells.join(h, [group, rank, "cell"])


def ranked(moves: DataFrame, group: str, rank: str, seed: int) -> DataFrame:
    """moves with ``upto``, the running weight of their group: what comes before their cell plus the running weight inside it.

    A cell is one gain and one hash bucket of one group, so no task ranks a whole group.
    """
    inside = Window.partitionBy(group, rank, "cell").orderBy("id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return running(moves, group, rank, seed).withColumn("upto", F.col("group_before") + F.sum("weight").over(inside))


def admit(moves: DataFrame, rooms: DataFrame, group: str = "to", rank: str = "gain", seed: int = 0) -> DataFrame:
    """ADMIT: the moves (id, to, gain, weight, ...) whose running weight per target stays within ``room``. rooms: (to, room)."""
    return ranked(moves, group, rank, seed).join(rooms, group).filter(F.col("upto") <= F.col("room")).select(*moves.columns)


def cover(moves: DataFrame, needs: DataFrame, group: str = "from", rank: str = "gain", seed: int = 0) -> DataFrame:
    """The smallest prefix per source that covers its ``need``: moves whose running weight before them is below it. needs: (from, need)."""
    return ranked(moves, group, rank, seed).join(needs, group).filter(F.col("upto") - F.col("weight") < F.col("need")).select(*moves.columns)


def best_n(moves: DataFrame, n: int, group: str = "from", rank: str = "gain") -> DataFrame:
    """The n best moves of each group, ties to the smaller id."""
    at = F.row_number().over(Window.partitionBy(group).orderBy(F.desc(rank), "id"))
    return moves.withColumn("at", at).filter(F.col("at") <= n).drop("at")


def cutoff(moves: DataFrame, needs: DataFrame, group: str = "from", rank: str = "bucket") -> DataFrame:
    """(group, cutoff): the first bucket, from the best on, up to which a group's moves cover its ``need``; the last one if they never do.

    needs: (group, need). One row for each group and bucket is all that a window sees.
    """
    h = moves.groupBy(group, rank).agg(F.sum("weight").alias("w"))
    run = Window.partitionBy(group).orderBy(rank).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    h = h.withColumn("upto", F.sum("w").over(run)).join(F.broadcast(needs), group)
    first = F.min(F.when(F.col("upto") >= F.col("need"), F.col(rank)))
    return h.groupBy(group).agg(F.coalesce(first, F.max(rank)).alias("cutoff"))


def batches(clusters: DataFrame, limit: int, group: str = "from", rank: str = "gain") -> DataFrame:
    """(group, cluster, batch): a group's clusters (cluster, weight, gain), best first, in batches: a batch takes what begins below its limit."""
    keyed = clusters.withColumnRenamed("cluster", "id")
    at = ranked(keyed, group, rank, 0)
    return at.select(group, F.col("id").alias("cluster"), F.floor((F.col("upto") - F.col("weight")) / limit).alias("batch"))
