"""The data model: a graph is two relations.

``nodes(id, weight)`` with ids 0..n-1 and ``edges(src, dst, weight)`` with both directions of every edge, no loops, no repeats. A partition
is ``(id, block)``, a clustering ``(id, cluster)``, a contraction mapping ``(id, coarse_id)``, block limits ``(block, min_weight, max_weight)``.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .session import checkpointed


@dataclass(frozen=True)
class Graph:
    nodes: DataFrame
    edges: DataFrame
    facts: dict = field(default_factory=dict, compare=False)

    def _fact(self, name: str, df: DataFrame) -> int:
        if name not in self.facts:
            self.facts[name] = df.first()[0] or 0
        return self.facts[name]

    def n(self) -> int:
        return self._fact("n", self.nodes.agg(F.count("*")))

    def m(self) -> int:
        """Directed edges: twice the undirected ones."""
        return self._fact("m", self.edges.agg(F.count("*")))

    def total_node_weight(self) -> int:
        return self._fact("node_weight", self.nodes.agg(F.sum("weight")))

    def total_edge_weight(self) -> int:
        return self._fact("edge_weight", self.edges.agg(F.sum("weight")))

    def max_node_weight(self) -> int:
        return self._fact("max_node_weight", self.nodes.agg(F.max("weight")))

    def checkpointed(self) -> Graph:
        return Graph(checkpointed(self.nodes), checkpointed(self.edges), self.facts)

    def partitioned(self, parts: int | None = None) -> Graph:
        """Edges hashed by src and kept: rounds of a loop join labels to them without moving them again."""
        edges = self.edges.repartition(parts, "src") if parts else self.edges.repartition("src")
        return Graph(self.nodes, edges.sortWithinPartitions("src", "dst").persist(), self.facts)

    def unweighted(self, nodes: bool = True, edges: bool = True) -> Graph:
        one = F.lit(1).cast("long")
        return Graph(self.nodes.withColumn("weight", one) if nodes else self.nodes, self.edges.withColumn("weight", one) if edges else self.edges)

    @staticmethod
    def from_edges(edges: DataFrame, nodes: DataFrame | None = None) -> Graph:
        """From one row per undirected edge, (src, dst[, weight]): both directions, repeats summed, loops dropped."""
        w = F.col("weight") if "weight" in edges.columns else F.lit(1)
        one = edges.select(F.col("src").cast("long"), F.col("dst").cast("long"), w.cast("long").alias("weight")).filter("src <> dst")
        both = one.unionByName(one.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight"))
        both = both.groupBy("src", "dst").agg(F.sum("weight").alias("weight"))
        if nodes is None:
            nodes = both.select(F.col("src").alias("id")).distinct().withColumn("weight", F.lit(1).cast("long"))
        return Graph(nodes, both)

    @staticmethod
    def from_csr(spark: SparkSession, xadj: Sequence[int], adjncy: Sequence[int], vwgt: Sequence[int] | None = None, adjwgt: Sequence[int] | None = None) -> Graph:
        """From compressed rows in memory; absent weights are 1."""
        import pandas as pd

        xadj, adjncy = np.asarray(xadj, np.int64), np.asarray(adjncy, np.int64)
        n = max(len(xadj) - 1, 0)
        ids = np.arange(n)
        nodes = pd.DataFrame({"id": ids, "weight": np.ones(n, np.int64) if vwgt is None else np.asarray(vwgt, np.int64)})
        edges = pd.DataFrame({"src": np.repeat(ids, np.diff(xadj)) if n else ids, "dst": adjncy, "weight": np.ones(len(adjncy), np.int64) if adjwgt is None else np.asarray(adjwgt, np.int64)})
        return Graph(spark.createDataFrame(nodes, "id long, weight long"), spark.createDataFrame(edges, "src long, dst long, weight long"))

    @staticmethod
    def from_ranks(ranks: DataFrame) -> Graph:
        """From compressed rows that lie in several places: (first, xadj, adjncy, vwgt, adjwgt), a row for each range of ids that starts at first.

        Offsets count from the range's own start, neighbours are global ids, null weights are 1.
        """
        at = ranks.select("first", "xadj", "adjncy", "vwgt", "adjwgt", F.posexplode(F.slice("xadj", 1, F.size("xadj") - 1)).alias("i", "a"))
        at = at.withColumns({"id": F.col("first") + F.col("i"), "d": F.get("xadj", F.col("i") + 1) - F.col("a")})
        nodes = at.select("id", F.coalesce(F.get("vwgt", F.col("i")), F.lit(1)).cast("long").alias("weight"))
        mine = lambda c: F.slice(c, (F.col("a") + 1).cast("int"), F.col("d").cast("int"))
        edges = at.filter("d > 0").select("id", mine("adjncy").alias("to"), F.when(F.col("adjwgt").isNotNull(), mine("adjwgt")).alias("w")).select(F.col("id").alias("src"), F.posexplode("to").alias("j", "dst"), "w")
        return Graph(nodes, edges.select("src", "dst", F.coalesce(F.get("w", F.col("j")), F.lit(1)).cast("long").alias("weight")))

    def to_ranks(self, parts: int = 1, width: int = 1024) -> DataFrame:
        """The compressed rows that ``from_ranks`` takes, and the ``part`` of each: ids are dealt to ``parts`` ranges, of which a row holds ``width``."""
        from .functions.integers import local_range, local_rank_column

        n = self.n()
        part = local_rank_column(F.col("id"), n, parts)
        starts = F.array(*(F.lit(local_range(n, parts, r)[0]).cast("long") for r in range(parts)))
        lists = self.edges.groupBy(F.col("src").alias("id")).agg(F.sort_array(F.collect_list(F.struct("dst", "weight"))).alias("l"))
        rows = self.nodes.join(lists, "id", "left").withColumn("part", part).withColumn("start", F.get(starts, F.col("part")))
        first = (F.col("start") + F.floor((F.col("id") - F.col("start")) / width) * width).alias("first")
        at = rows.groupBy("part", first).agg(F.sort_array(F.collect_list(F.struct("id", "weight", "l"))).alias("rows"))
        sizes = F.transform("rows", lambda x: F.coalesce(F.size(x["l"]), F.lit(0)).cast("long"))
        xadj = F.aggregate(sizes, F.array(F.lit(0).cast("long")), lambda a, d: F.concat(a, F.array(F.element_at(a, -1) + d)))
        lists = F.filter(F.col("rows.l"), lambda x: x.isNotNull())
        flat = lambda c: F.flatten(F.transform(lists, lambda x: x[c]))
        return at.select("part", "first", xadj.alias("xadj"), flat("dst").alias("adjncy"), F.col("rows.weight").alias("vwgt"), flat("weight").alias("adjwgt"))

    def to_csr(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(xadj, adjncy, node weights, edge weights): for graphs of the local tier, whose size the caller has checked."""
        nodes = self.nodes.select("id", "weight").toPandas().sort_values("id")
        edges = self.edges.select("src", "dst", "weight").toPandas().sort_values(["src", "dst"])
        counts = np.bincount(edges["src"].to_numpy(), minlength=len(nodes)) if len(nodes) else np.zeros(0, np.int64)
        return np.concatenate(([0], np.cumsum(counts))).astype(np.int64), edges["dst"].to_numpy(), nodes["weight"].to_numpy(), edges["weight"].to_numpy()


def dense_ids(keys: DataFrame, key: str, out: str) -> DataFrame:
    """keys with ``out``: 0..n-1 in the order of key, without a window over all rows.

    Keys are range-partitioned and sorted; a key's id is its place in its partition plus the sizes of the partitions before.
    """
    spark = keys.sparkSession
    sorted_keys = checkpointed(keys.repartitionByRange(key).sortWithinPartitions(key).withColumn("_at", F.monotonically_increasing_id()))
    sizes = sorted_keys.groupBy(F.shiftright("_at", 33).alias("_part")).agg(F.count("*").alias("c")).collect()  # one row per partition
    rows, total = [], 0
    for r in sorted(sizes, key=lambda r: r["_part"]):
        rows.append((r["_part"], total))
        total += r["c"]
    offsets = F.broadcast(spark.createDataFrame(rows, "_part long, _offset long"))
    placed = sorted_keys.withColumn("_part", F.shiftright("_at", 33)).join(offsets, "_part")
    return placed.withColumn(out, F.col("_offset") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))).drop("_at", "_part", "_offset")
