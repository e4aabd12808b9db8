"""Partition metrics and graph statistics: one-row or per-block aggregates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.integers import degree_bucket
from ..functions.sub_blocks import uniform_limit
from ..graph import Graph


def with_blocks(edges: DataFrame, partition: DataFrame, label: str = "block") -> DataFrame:
    """edges with the labels of both ends, ``bu`` and ``bv``."""
    u = partition.select(F.col("id").alias("src"), F.col(label).alias("bu"))
    v = partition.select(F.col("id").alias("dst"), F.col(label).alias("bv"))
    return edges.join(u, "src").join(v, "dst")


def edge_cut(graph: Graph, partition: DataFrame) -> DataFrame:
    """edge_cut: the weight of undirected edges between blocks."""
    cut = F.coalesce(F.sum(F.when(F.col("bu") != F.col("bv"), F.col("weight"))), F.lit(0))
    return with_blocks(graph.edges, partition).agg(F.floor(cut / 2).cast("long").alias("edge_cut"))


def block_weights(graph: Graph, partition: DataFrame, k: int) -> DataFrame:
    """(block, weight) with k rows; the node weights are pre-aggregated before the k rows meet."""
    w = graph.nodes.join(partition, "id").groupBy("block").agg(F.sum("weight").alias("w"))
    blocks = graph.nodes.sparkSession.range(k).select(F.col("id").cast("int").alias("block"))
    return blocks.join(w, "block", "left").select("block", F.coalesce("w", F.lit(0)).cast("long").alias("weight"))


def limits(spark, k: int, total: int, epsilon: float | None = None, max_weights: Sequence[int] | None = None, max_factors: Sequence[float] | None = None, min_epsilon: float | None = None, min_weights: Sequence[int] | None = None, min_factors: Sequence[float] | None = None) -> DataFrame:
    """(block, min_weight, max_weight): exactly one way to set the maxima, at most one for the minima."""
    import math

    if sum(x is not None for x in (epsilon, max_weights, max_factors)) != 1:
        raise ValueError("give exactly one of epsilon, max_weights and max_factors")
    if sum(x is not None for x in (min_epsilon, min_weights, min_factors)) > 1:
        raise ValueError("give at most one of min_epsilon, min_weights and min_factors")
    if epsilon is not None:
        upper = [uniform_limit(total, k, epsilon)] * k
    else:
        upper = list(max_weights) if max_weights is not None else [math.ceil(f * total) for f in max_factors]
    if len(upper) != k:
        raise ValueError(f"{len(upper)} limits for {k} blocks")
    if sum(upper) < total:
        raise ValueError("the maximum block weights can't hold all nodes")
    perfect = math.ceil(total / k) if k else 0
    lower = [0] * k
    if min_epsilon is not None:
        lower = [math.ceil((1.0 - min_epsilon) * perfect)] * k
    elif min_weights is not None:
        lower = list(min_weights)
    elif min_factors is not None:
        lower = [math.ceil(f * total) for f in min_factors]
    if sum(lower) > total or any(a > b for a, b in zip(lower, upper, strict=True)):
        raise ValueError("the minimum block weights can't be met")
    return spark.createDataFrame(list(zip(range(k), lower, upper, strict=True)), "block int, min_weight long, max_weight long")


def balance(graph: Graph, partition: DataFrame, k: int) -> DataFrame:
    """imbalance (0 at least) and min_imbalance (0 at most) over the perfect weight ceil(W / k)."""
    w = block_weights(graph, partition, k)
    total = graph.nodes.agg(F.sum("weight").alias("total"))
    perfect = F.ceil(F.col("total") / k)
    return w.join(F.broadcast(total)).agg(
        F.greatest(F.max(F.col("weight") / perfect) - 1.0, F.lit(0.0)).alias("imbalance"),
        F.least(F.min(F.col("weight") / perfect) - 1.0, F.lit(0.0)).alias("min_imbalance"),
    )


def overload(graph: Graph, partition: DataFrame, block_limits: DataFrame, k: int) -> DataFrame:
    """total_overload, overloaded blocks, imbalance_l1, imbalance_l2 and whether the partition is balanced, against the limits."""
    w = block_weights(graph, partition, k).join(block_limits, "block")
    over = F.greatest(F.col("weight") - F.col("max_weight"), F.lit(0))
    return w.agg(
        F.sum(over).cast("long").alias("total_overload"), F.sum((over > 0).cast("long")).alias("overloaded_blocks"), F.sum(over).cast("double").alias("imbalance_l1"),
        F.sqrt(F.sum(over.cast("double") * over)).alias("imbalance_l2"), (F.max(over) == 0).alias("feasible"), F.bool_and(F.col("weight") >= F.col("min_weight")).alias("min_feasible"),
    )


def degrees(graph: Graph) -> DataFrame:
    """(id, degree, weighted_degree), zeros included."""
    d = graph.edges.groupBy("src").agg(F.count("*").alias("d"), F.sum("weight").alias("wd"))
    zero = F.lit(0)
    return graph.nodes.join(d, F.col("id") == F.col("src"), "left").select("id", F.coalesce("d", zero).alias("degree"), F.coalesce("wd", zero).alias("weighted_degree"))


def degree_buckets(graph: Graph) -> DataFrame:
    return degrees(graph).groupBy(degree_bucket(F.col("degree")).alias("bucket")).agg(F.count("*").alias("n"))


def properties(graph: Graph) -> DataFrame:
    """One row: n, m, total weights, largest and mean degree, isolated nodes."""
    d = degrees(graph).agg(F.count("*").alias("n"), F.sum("degree").alias("m"), F.sum("weighted_degree").alias("total_edge_weight"), F.max("degree").alias("max_degree"), F.sum((F.col("degree") == 0).cast("long")).alias("isolated"))
    w = graph.nodes.agg(F.sum("weight").alias("total_node_weight"), F.max("weight").alias("max_node_weight"))
    return d.join(F.broadcast(w)).withColumn("avg_degree", F.col("m") / F.col("n"))


def quotient_graph(graph: Graph, partition: DataFrame) -> DataFrame:
    """(b1, b2, cut, edges) of each pair of adjacent blocks, b1 < b2."""
    e = with_blocks(graph.edges, partition).filter("bu < bv")
    return e.groupBy(F.col("bu").alias("b1"), F.col("bv").alias("b2")).agg(F.sum("weight").alias("cut"), F.count("*").alias("edges"))


def connections(edges: DataFrame, partition: DataFrame, label: str = "block") -> DataFrame:
    """RATE: (id, label, conn): the weight from each node to each label next to it."""
    v = partition.select(F.col("id").alias("dst"), F.col(label))
    return edges.join(v, "dst").groupBy(F.col("src").alias("id"), label).agg(F.sum("weight").alias("conn"))


def gains(edges: DataFrame, partition: DataFrame) -> DataFrame:
    """(id, from, to, conn, gain): moves to adjacent other blocks; gain = connection there less connection here."""
    c = connections(edges, partition).join(partition.select("id", F.col("block").alias("from")), "id")
    own = Window.partitionBy("id")
    here = F.coalesce(F.max(F.when(F.col("block") == F.col("from"), F.col("conn"))).over(own), F.lit(0))
    return c.withColumn("here", here).filter(F.col("block") != F.col("from")).select("id", "from", F.col("block").alias("to"), "conn", (F.col("conn") - F.col("here")).alias("gain"))


def best_moves(edges: DataFrame, partition: DataFrame) -> DataFrame:
    """PICK: each border node's best move, ties to the smaller block."""
    best = F.max_by(F.struct("from", "to", "gain"), F.struct("gain", -F.col("to")))
    return gains(edges, partition).groupBy("id").agg(best.alias("x")).select("id", "x.*")


def summary(graph: Graph, partition: DataFrame, block_limits: DataFrame, k: int) -> DataFrame:
    """One row: edge_cut, imbalance, min_imbalance, feasible, min_feasible."""
    cut = edge_cut(graph, partition)
    b = balance(graph, partition, k)
    o = overload(graph, partition, block_limits, k).select("feasible", "min_feasible", "total_overload")
    return cut.join(F.broadcast(b)).join(F.broadcast(o))


def spread(rows: DataFrame, column: str) -> DataFrame:
    """One row: n, least, mean, most, median and 90th percentile (interpolated), and the variance over all rows."""
    c = F.col(column)
    return rows.agg(
        F.count("*").alias("n"), F.min(c).alias("least"), F.avg(c).alias("mean"), F.max(c).alias("most"), F.percentile(c, 0.5).alias("median"), F.percentile(c, 0.9).alias("p90"), F.var_pop(c).alias("variance"),
    )


def partition_properties(graph: Graph, partition: DataFrame) -> DataFrame:
    """One row, from nothing but the graph and the labels: k (the largest block plus 1), blocks in use, cut, heaviest block, imbalance, and whether
    every node has exactly one block."""
    k = partition.agg((F.max("block") + 1).alias("k"), F.count_distinct("block").alias("used"))
    labels = partition.groupBy("id").agg(F.count("*").alias("c"), F.min("block").alias("block"))
    whole = graph.nodes.join(labels, "id", "full_outer").agg(F.bool_and(F.coalesce((F.col("c") == 1) & F.col("weight").isNotNull(), F.lit(False))).alias("complete"))
    heaviest = graph.nodes.join(partition, "id").groupBy("block").agg(F.sum("weight").alias("w")).agg(F.max("w").alias("heaviest"), F.sum("w").alias("total"))
    out = edge_cut(graph, partition).join(F.broadcast(k)).join(F.broadcast(heaviest)).join(F.broadcast(whole))
    return out.select("k", "used", "edge_cut", "heaviest", (F.col("heaviest") / F.ceil(F.col("total") / F.col("k")) - 1.0).alias("imbalance"), "complete")


def gain_statistics(moves: DataFrame, group: str = "from") -> DataFrame:
    """(group, moves, positive, zero, gain): how many moves of each group win, draw, and what all that win come to."""
    g = F.col("gain")
    return moves.groupBy(group).agg(F.count("*").alias("moves"), F.sum((g > 0).cast("long")).alias("positive"), F.sum((g == 0).cast("long")).alias("zero"), F.sum(F.greatest(g, F.lit(0))).alias("gain"))


def best_of(graph: Graph, partitions: Sequence[DataFrame], limit: float) -> DataFrame:
    """One row (rep, cut, heaviest): the best of several partitions, feasible ones first, then by cut, then by the heaviest block."""
    every = None
    for rep, p in enumerate(partitions):
        one = p.select("id", "block", F.lit(rep).alias("rep"))
        every = one if every is None else every.unionByName(one)
    # an edge travels once, with its ends' blocks in all partitions, not once for each of them
    reps = range(len(partitions))
    wide = every.groupBy("id").agg(*(F.max(F.when(F.col("rep") == r, F.col("block"))).alias(f"b{r}") for r in reps))
    u, v = (wide.select(F.col("id").alias(c), *(F.col(f"b{r}").alias(f"{c}{r}") for r in reps)) for c in ("src", "dst"))
    apart = lambda r: F.sum(F.when(F.col(f"src{r}") != F.col(f"dst{r}"), F.col("weight")).otherwise(0))
    cuts = graph.edges.join(u, "src").join(v, "dst").agg(*(F.floor(apart(r) / 2).cast("long").alias(f"c{r}") for r in reps))
    cut = cuts.select(F.inline(F.array(*(F.struct(F.lit(r).alias("rep"), F.col(f"c{r}").alias("cut")) for r in reps)))).filter("cut is not null")
    w = graph.nodes.join(every, "id").groupBy("rep", "block").agg(F.sum("weight").alias("w")).groupBy("rep").agg(F.max("w").alias("heaviest"))
    return cut.join(w, "rep").orderBy(F.col("heaviest") > F.lit(limit), "cut", "heaviest").limit(1).select("rep", "cut", "heaviest")
