"""Synthetic graphs, generated in parallel from ranges of ids."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..functions.integers import scrambled
from ..graph import Graph


def _nodes(spark: SparkSession, n: int):
    return spark.range(n).withColumn("weight", F.lit(1).cast("long"))


def grid(spark: SparkSession, rows: int, columns: int) -> Graph:
    ids = spark.range(rows * columns)
    right = ids.filter((F.col("id") + 1) % columns != 0).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    down = ids.filter(F.col("id") < (rows - 1) * columns).select(F.col("id").alias("src"), (F.col("id") + columns).alias("dst"))
    return Graph.from_edges(right.unionByName(down), _nodes(spark, rows * columns))


def path(spark: SparkSession, length: int) -> Graph:
    return grid(spark, 1, length)


def complete_bipartite(spark: SparkSession, n: int, m: int) -> Graph:
    pairs = spark.range(n * m).select(F.floor(F.col("id") / m).alias("src"), (F.col("id") % m + n).alias("dst"))
    return Graph.from_edges(pairs, _nodes(spark, n + m))


def star(spark: SparkSession, leaves: int) -> Graph:
    return complete_bipartite(spark, 1, leaves)


def complete(spark: SparkSession, n: int) -> Graph:
    pairs = spark.range(n * n).select(F.floor(F.col("id") / n).alias("src"), (F.col("id") % n).alias("dst")).filter("src < dst")
    return Graph.from_edges(pairs, _nodes(spark, n))


def matching(spark: SparkSession, m: int) -> Graph:
    return Graph.from_edges(spark.range(m).select((F.col("id") * 2).alias("src"), (F.col("id") * 2 + 1).alias("dst")), _nodes(spark, 2 * m))


def geometric(spark: SparkSession, n: int, radius: float, seed: int = 0) -> Graph:
    """Random geometric graph: points by hash, joined by cells as wide as the radius."""
    unit = lambda s: scrambled(scrambled(F.col("id"), s), s + 1) / F.lit(2_147_483_647.0)
    cell = lambda c: F.floor(F.col(c) / radius)
    p = spark.range(n).withColumns({"x": unit(seed), "y": unit(seed + 77)}).withColumns({"cx": cell("x"), "cy": cell("y")})
    around = F.explode(F.array(*(F.struct((F.col("cx") + i).alias("cx"), (F.col("cy") + j).alias("cy")) for i in (-1, 0, 1) for j in (-1, 0, 1))))
    q = p.select(F.col("id").alias("dst"), F.col("x").alias("x2"), F.col("y").alias("y2"), around.alias("c")).select("dst", "x2", "y2", "c.*")
    near = (F.col("x") - F.col("x2")) ** 2 + (F.col("y") - F.col("y2")) ** 2 <= radius * radius
    pairs = p.join(q, ["cx", "cy"]).filter(near & (F.col("id") < F.col("dst"))).select(F.col("id").alias("src"), "dst")
    return Graph.from_edges(pairs, _nodes(spark, n))


def recursive_matrix(spark: SparkSession, scale: int, edges: int, a: float = 0.57, b: float = 0.19, c: float = 0.19, seed: int = 0) -> Graph:
    """Skewed random graph: each bit of an edge's ends is drawn by a hash, one quadrant at a time."""
    src, dst = F.lit(0).cast("long"), F.lit(0).cast("long")
    for bit in range(scale):
        u = F.pmod(F.xxhash64("id", F.lit(seed * 1000 + bit)), F.lit(1 << 30)) / F.lit(float(1 << 30))
        src = src * 2 + (u >= a + b).cast("long")
        dst = dst * 2 + (((u >= a) & (u < a + b)) | (u >= a + b + c)).cast("long")
    return Graph.from_edges(spark.range(edges).select(src.alias("src"), dst.alias("dst")), _nodes(spark, 1 << scale)).unweighted(nodes=False)
