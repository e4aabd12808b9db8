"""Graphs from relational tables: bipartite counts and co-occurrence."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..graph import Graph, dense_ids
from ..session import sized_for

OFFSET = 1_000_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return sized_for(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def bipartite(pairs: DataFrame, left: str, right: str, offset: int = OFFSET, nodes: DataFrame | None = None) -> Graph:
    """One node for each left and right key (right keys shifted by offset), edges weighted by the number of rows.

    nodes: (key) of all nodes, shifted likewise, where some may have no edge.

    Rows are counted where they are shuffled to, not where they are read: few repeat, and a file's row groups, which no setting splits, would
    else decide how many pairs a task holds.
    """
    rows = pairs.select(F.col(left).alias("a"), (F.col(right) + offset).alias("b")).repartition("a", "b")
    one = rows.groupBy("a", "b").agg(F.count("*").alias("weight"))
    keys = nodes
    if nodes is None:  # from the rows themselves: what numbers the keys would otherwise count all edges again
        keys = pairs.select(F.col(left).alias("key")).distinct().unionByName(pairs.select((F.col(right) + offset).alias("key")).distinct()).distinct()
    ids = dense_ids(keys, "key", "id")
    e = one.join(ids.select(F.col("key").alias("a"), F.col("id").alias("src")), "a").join(ids.select(F.col("key").alias("b"), F.col("id").alias("dst")), "b").select("src", "dst", "weight")
    both = e.unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight"))
    return Graph(ids.select("id", F.lit(1).cast("long").alias("weight")), both)


def supplier_part(spark: SparkSession, sf_dir: str) -> Graph:
    return bipartite(table(spark, sf_dir, "lineitem").select("l_suppkey", "l_partkey"), "l_suppkey", "l_partkey")


def customer_supplier(spark: SparkSession, sf_dir: str) -> Graph:
    """Customers and suppliers, also those without orders (isolated nodes)."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    pairs = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey").join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    customers = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"))
    suppliers = table(spark, sf_dir, "supplier").select((F.col("s_suppkey") + OFFSET).alias("key"))
    return bipartite(pairs, "o_custkey", "l_suppkey", nodes=customers.unionByName(suppliers).distinct())


def customer_orders(spark: SparkSession, sf_dir: str) -> Graph:
    """Customers and their orders: a star for each customer."""
    return bipartite(table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey"), "o_custkey", "o_orderkey")


def urgent_suppliers(spark: SparkSession, sf_dir: str) -> Graph:
    """Customers, suppliers and parts; an edge for each customer and supplier that share an order of the highest priority. Parts have no edge."""
    orders = table(spark, sf_dir, "orders").filter("o_orderpriority = '1-URGENT'").select("o_orderkey", "o_custkey")
    pairs = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey").join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    key = lambda name, column, offset: table(spark, sf_dir, name).select((F.col(column) + offset).alias("key"))
    every = key("customer", "c_custkey", 0).unionByName(key("supplier", "s_suppkey", OFFSET)).unionByName(key("part", "p_partkey", 2 * OFFSET))
    return bipartite(pairs, "o_custkey", "l_suppkey", nodes=every.distinct())


def copurchase(spark: SparkSession, sf_dir: str) -> Graph:
    """Parts bought in one order; weight: the number of such orders.

    Lines get their parts' ids before they meet in orders, and pairs are made in both directions where the order lies, so that they are shuffled
    once, to their source, where they are counted and whatever is asked of a node's edges finds them together.
    """
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey").filter("l_orderkey is not null and l_partkey is not null")
    mixed = lines.groupBy("l_orderkey").agg(F.collect_set("l_partkey").alias("parts")).filter(F.size("parts") > 1)
    ids = dense_ids(mixed.select(F.explode("parts").alias("key")).distinct(), "key", "id")
    orders = lines.join(ids, F.col("l_partkey") == F.col("key")).groupBy("l_orderkey").agg(F.collect_set("id").alias("parts")).filter(F.size("parts") > 1)
    pairs = orders.select(F.explode("parts").alias("src"), "parts").select("src", F.explode("parts").alias("dst")).filter("src <> dst")
    edges = pairs.repartition("src").groupBy("src", "dst").agg(F.count("*").alias("weight"))
    return Graph(ids.select("id", F.lit(1).cast("long").alias("weight")), edges)
