"""Graphs built node by node, or from callbacks that give a node's degree and neighbours; both end in the columnar form."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..graph import Graph


class GraphBuilder:
    """Nodes in the order of their ids, each with its neighbours; batches of ``batch`` edges are appended to the shared folder."""

    def __init__(self, spark: SparkSession, path: str, batch: int = 1_000_000):
        self.spark, self.path, self.batch, self.n = spark, path, batch, 0
        self._clear()

    def _clear(self) -> None:
        self._nodes, self._edges, self._held = [], [], 0

    def add_node(self, neighbors: Sequence[int], edge_weights: Sequence[int] | None = None, weight: int = 1) -> int:
        """The new node's id."""
        if edge_weights is not None and len(edge_weights) != len(neighbors):
            raise ValueError(f"{len(edge_weights)} weights for {len(neighbors)} neighbours")
        self._nodes.append((self.n, weight))
        to = np.asarray(neighbors, np.int64)
        self._edges.append((np.full(len(to), self.n), to, np.ones(len(to), np.int64) if edge_weights is None else np.asarray(edge_weights, np.int64)))
        self._held += len(to) + 1
        self.n += 1
        if self._held >= self.batch:
            self._flush()
        return self.n - 1

    def _flush(self) -> None:
        if self._nodes:
            nodes = pd.DataFrame(self._nodes, columns=["id", "weight"])
            edges = pd.DataFrame(dict(zip(("src", "dst", "weight"), map(np.concatenate, zip(*self._edges, strict=True)), strict=True)))
            self.spark.createDataFrame(nodes, "id long, weight long").write.mode("append").parquet(f"{self.path}/nodes")
            self.spark.createDataFrame(edges, "src long, dst long, weight long").write.mode("append").parquet(f"{self.path}/edges")
        self._clear()

    def build(self) -> Graph:
        self._flush()
        read = lambda name, schema: self.spark.read.schema(schema).parquet(f"{self.path}/{name}")
        if not self.n:
            return Graph(self.spark.createDataFrame([], "id long, weight long"), self.spark.createDataFrame([], "src long, dst long, weight long"))
        return Graph(read("nodes", "id long, weight long"), read("edges", "src long, dst long, weight long"))


def from_callbacks(spark: SparkSession, n: int, neighborhood: Callable[[int], tuple[Sequence[int], Sequence[int] | None]], weight: Callable[[int], int] | None = None, parts: int = 8) -> Graph:
    """A graph whose neighbourhoods are asked for where they are needed: neighborhood(u) gives (neighbours, their weights or None)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(i, 1000) for i in range(0, batch.num_rows, 1000)):
                ids = part.column(0).to_pylist()
                found = [neighborhood(u) for u in ids]
                sizes = [len(to) for to, _ in found]
                to = np.concatenate([np.asarray(x, np.int64) for x, _ in found]) if sum(sizes) else np.zeros(0, np.int64)
                w = np.concatenate([np.ones(len(x), np.int64) if y is None else np.asarray(y, np.int64) for x, y in found]) if sum(sizes) else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, sizes).astype(np.int64)), pa.array(to), pa.array(w)], names=["src", "dst", "weight"])

    ids = spark.range(0, n, 1, parts)
    one = F.lit(1).cast("long")
    nodes = ids.withColumn("weight", one) if weight is None else ids.withColumn("weight", F.udf(weight, "long")("id"))
    return Graph(nodes, ids.mapInArrow(run, "src long, dst long, weight long"))


def callbacks_of(graph: DataFrame) -> DataFrame:
    """(id, degree, neighbors, weights): what the callbacks of a graph's edges would answer, for callers that want rows."""
    pairs = F.sort_array(F.collect_list(F.struct("dst", "weight")))
    return graph.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("degree"), pairs.alias("p")).select("id", "degree", F.col("p.dst").alias("neighbors"), F.col("p.weight").alias("weights"))
