"""Predicates and neighbourhood scans."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..graph import Graph, dense_ids
from .metrics import degrees, with_blocks


def neighbors(graph: Graph, ids: DataFrame) -> DataFrame:
    """Edges out of the given ids."""
    return graph.edges.join(ids.select(F.col("id").alias("src")), "src", "left_semi")


def first_neighbors(graph: Graph, most: int) -> DataFrame:
    """At most ``most`` edges out of each node, to the smallest neighbours."""
    at = F.row_number().over(Window.partitionBy("src").orderBy("dst"))
    return graph.edges.withColumn("at", at).filter(F.col("at") <= most).drop("at")


def isolated(graph: Graph) -> DataFrame:
    return graph.nodes.join(graph.edges.select(F.col("src").alias("id")), "id", "left_anti")


def border(graph: Graph, partition: DataFrame) -> DataFrame:
    """Nodes with a neighbour in another block."""
    return with_blocks(graph.edges, partition).filter("bu <> bv").select(F.col("src").alias("id")).distinct()


def low_degree(graph: Graph, limit: int) -> DataFrame:
    """Nodes of degree at most ``limit``: the others are passed over by label propagation."""
    return degrees(graph).filter(F.col("degree") <= limit).select("id")


def within_communities(graph: Graph, communities: DataFrame) -> DataFrame:
    """Edges inside one community."""
    return with_blocks(graph.edges, communities, "community").filter("bu = bv").select("src", "dst", "weight")


def active(graph: Graph, moved: DataFrame) -> DataFrame:
    """Neighbours of the moved nodes: all that the next round must look at."""
    return graph.edges.join(moved.select(F.col("id").alias("dst")), "dst", "left_semi").select(F.col("src").alias("id")).distinct()


def overlay(partition: DataFrame, delta: DataFrame) -> DataFrame:
    """The partition with the delta's blocks in place of its own."""
    d = delta.select("id", F.col("block").alias("new"))
    return partition.join(d, "id", "left").select("id", F.coalesce("new", "block").alias("block"))


def reverse_violations(edges: DataFrame) -> DataFrame:
    """Edges without a reverse edge of equal weight."""
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight")
    return edges.join(back, ["src", "dst", "weight"], "left_anti")


def reverse_index(edges: DataFrame) -> DataFrame:
    """(src, dst, edge, reverse): the place of each edge in the order of (src, dst), and that of the edge back."""
    keyed = edges.select(F.struct("src", "dst").alias("key"))
    at = dense_ids(keyed, "key", "edge").select(F.col("key.src").alias("src"), F.col("key.dst").alias("dst"), "edge")
    return at.join(at.select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.col("edge").alias("reverse")), ["src", "dst"])


def multi_edges(edges: DataFrame) -> DataFrame:
    return edges.groupBy("src", "dst").agg(F.count("*").alias("n")).filter("n > 1")


def invalid(graph: Graph) -> DataFrame:
    """(problem, n): what is wrong with a graph; no rows if it is valid."""
    e = graph.edges
    ends = e.select(F.col("dst").alias("id")).join(graph.nodes, "id", "left_anti")
    found = [
        (reverse_violations(e), "edge without its reverse"), (multi_edges(e), "repeated edge"), (e.filter("src = dst"), "loop"), (e.filter("weight <= 0"), "edge weight"),
        (graph.nodes.filter("weight <= 0"), "node weight"), (ends, "edge to no node"), (graph.nodes.groupBy("id").count().filter("count > 1"), "repeated node"),
    ]
    out = None
    for df, problem in found:
        row = df.agg(F.count("*").alias("n")).select(F.lit(problem).alias("problem"), "n")
        out = row if out is None else out.unionByName(row)
    return out.filter("n > 0")


def small_groups(labels: DataFrame, fraction: float) -> DataFrame:
    """Labels to pass over: the smallest groups that together hold at most ``fraction`` of all rows (ties by label)."""
    sizes = labels.groupBy("label").agg(F.count("*").alias("size"))
    total = sizes.agg(F.sum("size").alias("total"))
    run = Window.orderBy("size", "label").rowsBetween(Window.unboundedPreceding, Window.currentRow)  # one row per label
    out = sizes.withColumn("upto", F.sum("size").over(run)).join(F.broadcast(total))
    return out.filter(F.col("upto") <= F.lit(fraction) * F.col("total")).select("label", "size")


def independent_border(graph: Graph, partition: DataFrame, seed: int = 0) -> DataFrame:
    """Border nodes whose seeded score is below that of all border neighbours."""
    from ..functions.integers import scrambled

    b = border(graph, partition).withColumn("score", scrambled(F.col("id"), seed))
    e = graph.edges.select("src", "dst").join(b.select(F.col("id").alias("dst"), F.struct("score", F.col("id").alias("node")).alias("other")), "dst")
    low = e.groupBy(F.col("src").alias("id")).agg(F.min("other").alias("low"))
    out = b.join(low, "id", "left")
    return out.filter(F.col("low").isNull() | (F.struct("score", F.col("id").alias("node")) < F.col("low"))).select("id", "score")
