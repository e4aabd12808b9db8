"""Keeping a partition up to date while edges arrive: each micro-batch is merged and refined from the partition before."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..graph import Graph
from ..operators import metrics, refinement
from ..session import checkpointed

TABLES = {"nodes": "id long, weight long", "edges": "src long, dst long, weight long", "partition": "id long, block int"}


class WarmPartition:
    """Graph and partition of all edges so far. New nodes join their strongest block with room, then two rounds of refinement follow.

    With ``state``, a folder that the driver and executors share, every batch leaves graph and partition there under its number, and a follower
    that starts again goes on from the last whole one; a batch that is delivered again is passed over.
    """

    def __init__(self, graph: Graph, partition: DataFrame, k: int, epsilon: float = 0.03, state: str | None = None):
        self.graph, self.partition, self.k, self.epsilon, self.state = graph, partition, k, epsilon, state
        self.last = -1
        if state is not None:
            self._load()

    def _files(self, spark: SparkSession):
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.state)
        return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path

    def _whole(self, spark: SparkSession) -> list[int]:
        """The numbers of the batches whose partition, which is written last, is there."""
        fs, path = self._files(spark)
        if not fs.exists(path):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(path)]
        done = lambda name: fs.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.state}/{name}/partition/_SUCCESS"))
        return sorted(int(n.removeprefix("batch-")) for n in names if n.startswith("batch-") and done(n))

    def _load(self) -> None:
        spark = self.graph.nodes.sparkSession
        if found := self._whole(spark):
            self.last = found[-1]
            nodes, edges, self.partition = (spark.read.schema(s).parquet(f"{self.state}/batch-{self.last}/{t}") for t, s in TABLES.items())
            self.graph = Graph(nodes, edges)

    def _save(self, batch_id: int) -> None:
        spark = self.graph.nodes.sparkSession
        for name, df in zip(TABLES, (self.graph.nodes, self.graph.edges, self.partition), strict=True):
            df.write.mode("overwrite").parquet(f"{self.state}/batch-{batch_id}/{name}")
        self._load()
        fs, _ = self._files(spark)
        for old in self._whole(spark)[:-2]:
            fs.delete(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.state}/batch-{old}"), True)

    def update(self, batch: DataFrame, batch_id: int = 0) -> None:
        """Adds undirected edges (src, dst[, weight])."""
        if batch.isEmpty() or (self.state is not None and batch_id <= self.last):
            return
        new = Graph.from_edges(batch)
        both = self.graph.edges.unionByName(new.edges).groupBy("src", "dst").agg(F.sum("weight").alias("weight"))
        fresh = checkpointed(new.nodes.join(self.graph.nodes, "id", "left_anti"))
        self.graph = Graph(self.graph.nodes.unionByName(fresh), both).checkpointed()
        c = metrics.connections(self.graph.edges.join(fresh.select(F.col("id").alias("src")), "src", "left_semi"), self.partition)
        best = c.groupBy("id").agg(F.max_by("block", F.struct("conn", -F.col("block"))).alias("block"))
        placed = fresh.select("id").join(best, "id", "left").select("id", F.coalesce("block", (F.col("id") % self.k).cast("int")).alias("block"))
        part = checkpointed(self.partition.unionByName(placed))
        spark = part.sparkSession
        limits = metrics.limits(spark, self.k, self.graph.total_node_weight(), epsilon=self.epsilon)
        part = refinement.balance_overload(self.graph, part, limits, self.k)
        self.partition = checkpointed(refinement.lp_refine(self.graph, part, limits, self.k, rounds=2))
        if self.state is not None:
            self._save(batch_id)

    def follow(self, stream: DataFrame, checkpoint: str) -> StreamingQuery:
        """Runs update on every micro-batch that is there, then stops."""
        return stream.writeStream.foreachBatch(self.update).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
