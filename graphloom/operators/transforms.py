"""Relabelling, subgraphs, contraction, sparsification, isolated nodes."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.integers import degree_bucket, edge_hash
from ..graph import Graph, dense_ids
from . import supersteps
from .metrics import degrees, with_blocks


def permutation_by(nodes: DataFrame, bucket: Column) -> DataFrame:
    """(old_id, new_id): dense ids in the order of (bucket, id)."""
    keyed = nodes.select(F.struct(bucket.alias("b"), F.col("id").alias("i")).alias("key"))
    return dense_ids(keyed, "key", "new_id").select(F.col("key.i").alias("old_id"), "new_id")


def by_degree(graph: Graph) -> DataFrame:
    """Degree buckets upwards, isolated nodes last."""
    bucket = degree_bucket(F.col("degree"))
    return permutation_by(degrees(graph), F.when(bucket == 0, F.lit(99)).otherwise(bucket))


def by_partition(partition: DataFrame) -> DataFrame:
    """Blocks one after the other."""
    return permutation_by(partition, F.col("block"))


def permuted(graph: Graph, permutation: DataFrame) -> Graph:
    new = lambda c: permutation.select(F.col("old_id").alias(c), F.col("new_id").alias(f"new_{c}"))
    nodes = graph.nodes.join(new("id"), "id").select(F.col("new_id").alias("id"), "weight")
    edges = graph.edges.join(new("src"), "src").join(new("dst"), "dst").select(F.col("new_src").alias("src"), F.col("new_dst").alias("dst"), "weight")
    return Graph(nodes, edges)


def unpermuted(partition: DataFrame, permutation: DataFrame) -> DataFrame:
    return partition.join(permutation, F.col("id") == F.col("new_id")).select(F.col("old_id").alias("id"), "block")


def edge_order(edges: DataFrame) -> DataFrame:
    """Edges of each node by target, hashed by source; ``run`` numbers the stretches of consecutive targets."""
    w = Window.partitionBy("src").orderBy("dst")
    return edges.withColumn("run", F.col("dst") - F.row_number().over(w))


def induced(graph: Graph, partition: DataFrame, block: int) -> tuple[Graph, DataFrame]:
    """The subgraph of one block with dense ids, and (id, new_id)."""
    inside = partition.filter(F.col("block") == block).select("id")
    ids = dense_ids(inside, "id", "new_id")
    new = lambda c: ids.select(F.col("id").alias(c), F.col("new_id").alias(f"new_{c}"))
    nodes = graph.nodes.join(new("id"), "id").select(F.col("new_id").alias("id"), "weight")
    edges = graph.edges.join(new("src"), "src").join(new("dst"), "dst").select(F.col("new_src").alias("src"), F.col("new_dst").alias("dst"), "weight")
    return Graph(nodes, edges), ids


def inner_edges(graph: Graph, partition: DataFrame) -> DataFrame:
    """(block, src, dst, weight) of the edges inside a block: all block subgraphs at once."""
    return with_blocks(graph.edges, partition).filter("bu = bv").select(F.col("bu").alias("block"), "src", "dst", "weight")


def subgraph_sizes(graph: Graph, partition: DataFrame) -> DataFrame:
    """(block, n, m, node_weight, edge_weight) of each block's subgraph."""
    n = graph.nodes.join(partition, "id").groupBy("block").agg(F.count("*").alias("n"), F.sum("weight").alias("node_weight"))
    m = inner_edges(graph, partition).groupBy("block").agg(F.count("*").alias("m"), F.sum("weight").alias("edge_weight"))
    return n.join(m, "block", "left").select("block", "n", F.coalesce("m", F.lit(0)).alias("m"), "node_weight", F.coalesce("edge_weight", F.lit(0)).alias("edge_weight"))


def copy_back(partition: DataFrame, sub: DataFrame, first: DataFrame) -> DataFrame:
    """Blocks of a refined partition: a block's first sub-block plus the node's sub-block. sub: (id, sub); first: (block, first)."""
    return partition.join(sub, "id").join(F.broadcast(first), "block").select("id", (F.col("first") + F.col("sub")).cast("int").alias("block"))


def contract(graph: Graph, clusters: DataFrame, keep: Column | None = None) -> tuple[Graph, DataFrame]:
    """CONTRACT: (coarse graph, mapping). Parallel edges add up, inner edges go; keep: a filter on coarse edges (sparsification)."""
    ids = dense_ids(clusters.select("cluster").distinct(), "cluster", "coarse_id")
    mapping = clusters.join(ids, "cluster").select("id", "coarse_id")
    nodes = graph.nodes.join(mapping, "id").groupBy(F.col("coarse_id").alias("id")).agg(F.sum("weight").alias("weight"))
    if "packed" in graph.facts:  # a graph that has seen supersteps
        edges = supersteps.contracted_edges(graph, mapping)
    else:
        c = with_blocks(graph.edges, mapping, "coarse_id").filter("bu <> bv")
        edges = c.groupBy(F.col("bu").alias("src"), F.col("bv").alias("dst")).agg(F.sum("weight").alias("weight"))
    return Graph(nodes, edges if keep is None else edges.filter(keep)), mapping


def project_up(mapping: DataFrame, coarse: DataFrame) -> DataFrame:
    """The fine partition that a coarse one stands for."""
    return mapping.join(coarse.select(F.col("id").alias("coarse_id"), "block"), "coarse_id").select("id", "block")


def project_down(mapping: DataFrame, fine: DataFrame, label: str = "block") -> DataFrame:
    """A label of each coarse node: the smallest among its members (equal where the clustering respects the labels)."""
    return mapping.join(fine, "id").groupBy(F.col("coarse_id").alias("id")).agg(F.min(label).alias(label))


def overlay_clusters(a: DataFrame, b: DataFrame) -> DataFrame:
    """Nodes share a cluster iff they do in both; a cluster is named by its smallest member."""
    both = a.select("id", F.col("cluster").alias("ca")).join(b.select("id", F.col("cluster").alias("cb")), "id")
    names = both.groupBy("ca", "cb").agg(F.min("id").alias("cluster"))
    return both.join(names, ["ca", "cb"]).select("id", "cluster")


def kth_largest(values: DataFrame, column: str, k: int) -> DataFrame:
    """One row: the exact k-th largest value, the number of larger and of equal ones: a histogram and a running sum over distinct values."""
    h = values.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("equal"))
    above = F.coalesce(F.sum("equal").over(Window.orderBy(F.desc("value")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return h.withColumn("larger", above).filter((F.col("larger") < k) & (F.col("larger") + F.col("equal") >= k)).select("value", "larger", "equal")


def sparsification_target(graph: Graph, coarse: Graph, edge_factor: float = 0.5, density_factor: float = 0.5) -> int:
    m, n = graph.m(), max(graph.n(), 1)
    return int(min(edge_factor * m, density_factor * m / n * coarse.n()))


def sparsified(coarse: Graph, target: int, seed: int = 0) -> Graph:
    """About ``target`` directed edges: all above the threshold weight, and a share of the equal ones drawn alike in both directions."""
    t = kth_largest(coarse.edges, "weight", max(target, 1)).first()
    if t is None or coarse.m() <= target:
        return coarse
    share = (target - t["larger"]) / t["equal"]
    drawn = edge_hash(F.col("src"), F.col("dst"), seed) < F.lit(int(share * 2_147_483_647))
    return Graph(coarse.nodes, coarse.edges.filter((F.col("weight") > t["value"]) | ((F.col("weight") == t["value"]) & drawn)))


def without_isolated(graph: Graph) -> tuple[Graph, DataFrame, DataFrame]:
    """(graph of the other nodes with dense ids, their (old_id, new_id), the isolated nodes)."""
    live = graph.edges.select(F.col("src").alias("id")).distinct()
    ids = dense_ids(live, "id", "new_id").withColumnRenamed("id", "old_id")
    isolated = graph.nodes.join(live, "id", "left_anti")
    kept = Graph(graph.nodes.join(live, "id", "left_semi"), graph.edges)
    return permuted(kept, ids), ids, isolated


def assign_isolated(isolated: DataFrame, weights: DataFrame, block_limits: DataFrame) -> DataFrame:
    """Isolated nodes (id, weight) fill the blocks in order: heavier nodes first, each where its whole weight fits.

    weights: (block, weight) so far. Weights are taken by classes, rounded up to seven binary digits (exact below 128), so that the driver plans a
    few thousand classes whatever the nodes are. What fits nowhere goes to the last block.
    """
    spark = isolated.sparkSession
    over = F.greatest(F.length(F.bin("weight")) - 7, F.lit(0)).alias("over")
    sized = isolated.select("id", "weight", over).selectExpr("id", "shiftleft(shiftright(weight + shiftleft(1L, over) - 1, over), over) AS size")
    keyed = sized.select(F.struct((-F.col("size")).alias("s"), F.col("id").alias("i")).alias("key"))
    order = dense_ids(keyed, "key", "at").select(F.col("key.i").alias("id"), "at")
    state = weights.join(F.broadcast(block_limits), "block").select("block", F.greatest(F.col("max_weight") - F.col("weight"), F.lit(0)).alias("room")).orderBy("block").collect()  # k rows
    blocks, room = np.array([r["block"] for r in state]), np.array([r["room"] for r in state], np.int64)
    ranges, at = [], 0
    for size, count in sorted(((r["size"], r["n"]) for r in sized.groupBy("size").agg(F.count("*").alias("n")).collect()), reverse=True):
        fit = np.minimum(room // size, count)
        upto = np.minimum(np.cumsum(fit), count)
        taken = np.diff(upto, prepend=0)
        room -= taken * size
        used = np.flatnonzero(taken)
        ranges += zip((at + upto[used] - taken[used]).tolist(), (at + upto[used]).tolist(), blocks[used].tolist(), strict=True)
        if (left := count - int(taken.sum())) > 0:
            ranges.append((at + count - left, at + count, int(blocks[-1])))
        at += count
    width = 1024
    table = spark.createDataFrame(ranges, "low long, high long, block int")
    table = table.withColumn("part", F.explode(F.sequence(F.floor(F.col("low") / width), F.floor((F.col("high") - 1) / width))))
    hit = order.withColumn("part", F.floor(F.col("at") / width)).join(table, "part").filter("at >= low and at < high")
    return hit.select("id", "block")


def reintegrated(graph: Graph, ids: DataFrame, isolated: DataFrame) -> Graph:
    """The graph that ``without_isolated`` took apart: its nodes under their old ids, and the isolated ones."""
    old = ids.select(F.col("new_id").alias("old_id"), F.col("old_id").alias("new_id"))
    back = permuted(graph, old)
    return Graph(back.nodes.unionByName(isolated.select("id", "weight")), back.edges)


def blocks_from_sizes(nodes: DataFrame, sizes: DataFrame) -> DataFrame:
    """The partition of contiguous ids with the given (block, size)."""
    run = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, Window.currentRow)  # k rows
    ranges = sizes.withColumn("high", F.sum("size").over(run)).select("block", (F.col("high") - F.col("size")).alias("low"), "high")
    return nodes.select("id").join(F.broadcast(ranges), (F.col("id") >= F.col("low")) & (F.col("id") < F.col("high"))).select("id", "block")


def block_sizes(spark, partition: DataFrame, k: int) -> DataFrame:
    counts = partition.groupBy("block").agg(F.count("*").alias("c"))
    return spark.range(k).select(F.col("id").cast("int").alias("block")).join(counts, "block", "left").select("block", F.coalesce("c", F.lit(0)).alias("size"))


def replicated(graph: Graph, copies: int) -> Graph:
    """Copies of the graph side by side; node u of copy c is u + c * n."""
    n, times = graph.n(), F.explode(F.sequence(F.lit(0), F.lit(copies - 1))).alias("c")
    shift = F.col("c") * F.lit(n)
    nodes = graph.nodes.select("id", "weight", times).select((F.col("id") + shift).alias("id"), "weight")
    return Graph(nodes, graph.edges.select("src", "dst", "weight", times).select((F.col("src") + shift).alias("src"), (F.col("dst") + shift).alias("dst"), "weight"))


def gathered(partition: DataFrame, n: int, copy: int) -> DataFrame:
    """The partition of one copy of a replicated graph, under the graph's own ids."""
    return partition.filter(F.floor(F.col("id") / n) == copy).select((F.col("id") - copy * n).alias("id"), "block")
