"""Text and binary graph files, partition files.

Readers return DataFrames and go through Spark, so any file system that Spark reads will do. A METIS file's node ids are its line numbers,
so its lines are numbered first: per-partition counts give the offsets, and no line travels to the driver.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..graph import Graph, dense_ids
from ..session import checkpointed


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line, value): the lines of a text file, or of a folder's files in the order of their names, from 0.

    Spark deals slices of files to partitions by size, so a partition's place says nothing: lines are counted in each slice, and the slices are
    ordered by file name and place. Inside a slice, rows come in file order.
    """
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_start"))
    names = sorted(r["_file"] for r in lines.select("_file").distinct().collect())  # one row per file
    files = F.broadcast(spark.createDataFrame(list(zip(names, range(len(names)), strict=True)), "_file string, _place int"))
    lines = lines.withColumn("_at", F.monotonically_increasing_id()).join(files, "_file").select("_place", "_start", "_at", "value")
    lines = checkpointed(lines)
    counts = lines.groupBy("_place", "_start").agg(F.count("*").alias("c"), F.min("_at").alias("first")).collect()  # one row per slice
    offsets, total = [], 0
    for r in sorted(counts, key=lambda r: (r["_place"], r["_start"])):
        offsets.append((r["_place"], r["_start"], total - r["first"]))
        total += r["c"]
    o = F.broadcast(spark.createDataFrame(offsets, "_place int, _start long, _shift long"))
    return lines.join(o, ["_place", "_start"]).select((F.col("_at") + F.col("_shift")).alias("line"), "value")


def read_metis(spark: SparkSession, path: str) -> Graph:
    """Header ``n m [fmt]``, one line per node with 1-based neighbours, ``%`` comments; fmt digits: sizes, node weights, edge weights."""
    lines = numbered_lines(spark, path).filter(~F.col("value").startswith("%"))
    header = lines.orderBy("line").first()
    if header is None:
        raise ValueError(f"{path} has no header")
    head = [int(x) for x in header["value"].split()]
    n, m = head[0], head[1]
    fmt = f"{head[2] if len(head) > 2 else 0:03d}"
    sizes, node_weights, edge_weights = (c == "1" for c in fmt)
    body = dense_ids(lines.filter(F.col("line") > header["line"]), "line", "id").filter(F.col("id") < n)
    items = F.transform(F.array_remove(F.split(F.trim("value"), r"\s+"), ""), lambda x: x.cast("long"))
    skip = int(sizes) + int(node_weights)
    one = F.lit(1).cast("long")
    rows = body.select("id", items.alias("x"))
    nodes = rows.select("id", F.get("x", F.lit(int(sizes))).alias("weight") if node_weights else one.alias("weight"))
    step = 2 if edge_weights else 1
    far = F.filter("x", lambda x, i: (i >= skip) & ((i - skip) % step == 0))
    weight = F.filter("x", lambda x, i: (i >= skip) & ((i - skip) % step == 1)) if edge_weights else F.transform(far, lambda x: one)
    pairs = F.explode(F.arrays_zip(far.alias("dst"), weight.alias("weight"))).alias("p")
    edges = rows.select(F.col("id").alias("src"), pairs).select("src", (F.col("p.dst") - 1).alias("dst"), F.col("p.weight").alias("weight"))
    graph = Graph(nodes, edges)
    if graph.m() != 2 * m or graph.n() != n:
        raise ValueError(f"{path}: header promises {n} nodes and {m} edges, found {graph.n()} and {graph.m()} directed ones")
    bad = edges.filter((F.col("src") == F.col("dst")) | (F.col("weight") <= 0) | (F.col("dst") < 0) | (F.col("dst") >= n))
    if not bad.isEmpty():
        raise ValueError(f"{path}: loops, weights below 1 or neighbours out of range")
    return graph


def metis_lines(graph: Graph) -> DataFrame:
    """(id, value): the body of a METIS file, isolated nodes as empty lists. Weights are written if any is not 1."""
    node_w, edge_w = (not x.filter("weight <> 1").isEmpty() for x in (graph.nodes, graph.edges))
    lists = graph.edges.groupBy("src").agg(F.sort_array(F.collect_list(F.struct("dst", "weight"))).alias("l"))
    text = F.array_join(F.transform("l", lambda x: F.concat_ws(" ", x["dst"] + 1, x["weight"]) if edge_w else (x["dst"] + 1).cast("string")), " ")
    out = graph.nodes.join(lists, F.col("id") == F.col("src"), "left")
    body = F.coalesce(text, F.lit(""))
    value = F.rtrim(F.concat_ws(" ", "weight", body)) if node_w else body
    head = f"{graph.n()} {graph.m() // 2}" + (f" {int(node_w)}{int(edge_w)}" if node_w or edge_w else "")
    return graph.nodes.sparkSession.createDataFrame([(-1, head)], "id long, value string").unionByName(out.select("id", value.alias("value")))


def write_metis(graph: Graph, path: str) -> None:
    write_lines(metis_lines(graph), path)


def write_lines(rows: DataFrame, path: str) -> None:
    """(id, value) as text in the order of id: a folder of files whose names sort in that order."""
    rows.repartitionByRange("id").sortWithinPartitions("id").select("value").write.mode("overwrite").text(path)


PARHIP_HEADER = 24


def parhip_bytes(xadj: np.ndarray, adj: np.ndarray, vw: np.ndarray | None = None, ew: np.ndarray | None = None) -> bytes:
    """Header (version bits, n, m), byte offsets of the neighbourhoods, targets, node weights, edge weights; 64-bit.

    The version's bits: 1 no edge weights, 2 no node weights, 4 32-bit edge ids, 8 32-bit node ids, 16 and 32 32-bit weights of either kind.
    """
    version = (1 if ew is None else 0) | (2 if vw is None else 0)
    n, m = len(xadj) - 1, len(adj)
    start = PARHIP_HEADER + 8 * (n + 1)
    parts = [np.array([version, n, m], "<u8"), np.asarray(xadj, "<u8") * 8 + start, np.asarray(adj, "<u8")]
    return b"".join(p.astype("<u8").tobytes() for p in parts + [x for x in (vw, ew) if x is not None])


#: What a task of the binary form holds at once: so many nodes or edges.
STEP = 1 << 20


def write_parhip(graph: Graph, path: str) -> None:
    """One binary file under a path that driver and executors see as a local one: each task writes its own slices of it.

    Edges are numbered in the order of (src, dst) and nodes by id; the driver holds a row for each partition.
    """
    from ..operators.metrics import degrees

    spark, n, m = graph.nodes.sparkSession, graph.n(), graph.m()
    has_vw, has_ew = (not x.filter("weight <> 1").isEmpty() for x in (graph.nodes, graph.edges))
    start = PARHIP_HEADER + 8 * (n + 1)
    after = start + 8 * m
    with open(path, "wb") as f:
        f.write(np.array([(not has_ew) | (not has_vw) << 1, n, m], "<u8").tobytes())
        f.truncate(after + 8 * n * has_vw + 8 * m * has_ew)
        f.seek(PARHIP_HEADER + 8 * n)
        f.write(np.array([after], "<u8").tobytes())
    numbers = lambda batch: [c.to_numpy() for c in batch.columns]

    def runs(at: np.ndarray) -> list[tuple[int, int]]:
        """Stretches of consecutive numbers."""
        edges = [0, *(np.flatnonzero(np.diff(at) != 1) + 1).tolist(), len(at)]
        return [(a, b) for a, b in zip(edges, edges[1:], strict=False) if b > a]

    def put_nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done, before = 0, None
        with open(path, "r+b") as f:
            for ids, degree, weight, first in map(numbers, batches):
                if not len(ids):
                    continue
                before = first[0] if before is None else before
                xadj = before + np.cumsum(degree) - degree
                before, done = before + degree.sum(), done + len(ids)
                for a, b in runs(ids):
                    f.seek(PARHIP_HEADER + 8 * int(ids[a]))
                    f.write((xadj[a:b] * 8 + start).astype("<u8").tobytes())
                    if has_vw:
                        f.seek(after + 8 * int(ids[a]))
                        f.write(weight[a:b].astype("<u8").tobytes())
        yield pa.RecordBatch.from_arrays([pa.array([done])], names=["done"])

    def put_edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done = 0
        with open(path, "r+b") as f:
            for at, dst, weight in map(numbers, batches):
                done += len(at)
                for a, b in runs(at):
                    f.seek(start + 8 * int(at[a]))
                    f.write(dst[a:b].astype("<u8").tobytes())
                    if has_ew:
                        f.seek(after + 8 * (n * has_vw + int(at[a])))
                        f.write(weight[a:b].astype("<u8").tobytes())
        yield pa.RecordBatch.from_arrays([pa.array([done])], names=["done"])

    nodes = degrees(graph).join(graph.nodes, "id").select("id", "degree", "weight").repartitionByRange("id").sortWithinPartitions("id")
    nodes = checkpointed(nodes.withColumn("_part", F.spark_partition_id()))
    offsets, total = [], 0
    for r in nodes.groupBy("_part").agg(F.sum("degree").alias("d")).orderBy("_part").collect():  # one row per partition
        offsets.append((r["_part"], total))
        total += r["d"]
    nodes = nodes.join(F.broadcast(spark.createDataFrame(offsets, "_part int, _first long")), "_part").select("id", "degree", "weight", "_first")
    edges = dense_ids(graph.edges.select(F.struct("src", "dst").alias("key"), "weight"), "key", "at").select("at", F.col("key.dst").alias("dst"), "weight")
    for rows, put, count in ((nodes, put_nodes, n), (edges, put_edges, m)):
        done = rows.mapInArrow(put, "done long").agg(F.sum("done")).first()[0] or 0
        if done != count:
            raise ValueError(f"{path}: {done} of {count} rows written")


def _ranges(offset: Callable[[int], int], n: int, parts: int, by: str = "edges") -> list[tuple[int, int]]:
    """Contiguous node ranges: equal nodes, or about equal edges, or about equal bytes (edges plus a node's own entry). Few offsets are looked at."""
    load = (lambda i: i) if by == "nodes" else lambda i: offset(i) - offset(0) + (i if by == "bytes" else 0)
    cuts = [bisect_left(range(n + 1), load(n) * r / parts, key=load) for r in range(1, parts)]
    edges = [0, *cuts, n]
    return [(a, b) for a, b in zip(edges, edges[1:], strict=False) if b > a]


def read_parhip(spark: SparkSession, path: str, parts: int | None = None, by: str = "edges") -> Graph:
    """Node ranges are read side by side: each task seeks to its own slices of the file, which all executors must see as a local path.

    The frames read the file whenever they are used. parts: 8, or as many as leave each about ``STEP`` nodes and edges.
    """
    with open(path, "rb") as f:
        version, n, m = (int(x) for x in np.frombuffer(f.read(PARHIP_HEADER), "<u8"))
    edge_id, node_id, vw_size, ew_size = (4 if version & b else 8 for b in (4, 8, 16, 32))
    has_vw, has_ew = not version & 2, not version & 1
    start = PARHIP_HEADER + edge_id * (n + 1)
    after = start + node_id * m
    raw = np.memmap(path, f"<u{edge_id}", "r", PARHIP_HEADER, (n + 1,))
    offset = lambda i: (int(raw[i]) - start) // node_id
    step = STEP
    parts = max(8, -(-(n + m) // step)) if parts is None else parts
    jobs = spark.createDataFrame(_ranges(offset, n, parts, by), "a long, b long").repartition(parts)

    def at(f, place: int, count: int, size: int) -> np.ndarray:
        f.seek(place)
        return np.frombuffer(f.read(size * count), f"<u{size}").astype(np.int64)

    def stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int]]:
        for batch in batches:
            for a, b in zip(*(batch.column(i).to_pylist() for i in range(2)), strict=True):
                yield from ((x, min(x + step, b)) for x in range(a, b, step))

    def load_nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with open(path, "rb") as f:
            for a, b in stretches(batches):
                vw = at(f, after + vw_size * a, b - a, vw_size) if has_vw else np.ones(b - a, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(a, b)), pa.array(vw)], names=["id", "weight"])

    def load_edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with open(path, "rb") as f:
            for a, b in stretches(batches):
                xadj = (at(f, PARHIP_HEADER + edge_id * a, b - a + 1, edge_id) - start) // node_id
                for e in range(int(xadj[0]), int(xadj[-1]), step):  # a hub's edges too come in pieces
                    g = min(e + step, int(xadj[-1]))
                    src = np.searchsorted(xadj, np.arange(e, g), "right") - 1 + a
                    ew = at(f, after + vw_size * n * has_vw + ew_size * e, g - e, ew_size) if has_ew else np.ones(g - e, np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(src), pa.array(at(f, start + node_id * e, g - e, node_id)), pa.array(ew)], names=["src", "dst", "weight"])

    return Graph(jobs.mapInArrow(load_nodes, "id long, weight long"), jobs.mapInArrow(load_edges, "src long, dst long, weight long"), {"n": n, "m": m})


def write_columnar(graph: Graph, path: str) -> None:
    """The compact form: Parquet sorted by (src, dst), so that deltas and runs compress neighbourhoods."""
    graph.nodes.repartitionByRange("id").sortWithinPartitions("id").write.mode("overwrite").parquet(f"{path}/nodes")
    graph.edges.repartitionByRange("src", "dst").sortWithinPartitions("src", "dst").write.mode("overwrite").parquet(f"{path}/edges")


def read_columnar(spark: SparkSession, path: str) -> Graph:
    return Graph(spark.read.parquet(f"{path}/nodes"), spark.read.parquet(f"{path}/edges"))


def read_graph(spark: SparkSession, path: str, format: str = "metis", ordering: str = "natural", compress: str | None = None) -> Graph:  # noqa: A002
    """A graph from a file. ordering ``degree-buckets`` numbers its nodes anew by degree, isolated ones last; compress: a folder for the columnar form."""
    readers = {"metis": read_metis, "parhip": read_parhip, "columnar": read_columnar}
    if format not in readers:
        raise ValueError(f"no graph format {format!r}; there are {', '.join(readers)}")
    if ordering not in ("natural", "degree-buckets"):
        raise ValueError(f"no node ordering {ordering!r}; there are natural, degree-buckets")
    graph = readers[format](spark, path)
    if ordering == "degree-buckets":
        from ..operators.transforms import by_degree, permuted

        graph = graph.checkpointed()
        graph = permuted(graph, by_degree(graph))
    if compress is not None:
        write_columnar(graph, compress)
        graph = read_columnar(spark, compress)
    return graph


def write_partition(partition: DataFrame, path: str) -> None:
    """Line i holds the block of node i."""
    write_lines(partition.select("id", F.col("block").cast("string").alias("value")), path)


def read_partition(spark: SparkSession, path: str) -> DataFrame:
    return numbered_lines(spark, path).select(F.col("line").alias("id"), F.col("value").cast("int").alias("block"))


def write_block_sizes(partition: DataFrame, k: int, path: str) -> None:
    from ..operators.transforms import block_sizes

    sizes = block_sizes(partition.sparkSession, partition, k)
    write_lines(sizes.select(F.col("block").cast("long").alias("id"), F.col("size").cast("string").alias("value")), path)


def read_block_sizes(spark: SparkSession, path: str, nodes: DataFrame) -> DataFrame:
    """Sizes of contiguous ranges of ids, as a partition."""
    from ..operators.transforms import blocks_from_sizes

    sizes = numbered_lines(spark, path).select(F.col("line").cast("int").alias("block"), F.col("value").cast("long").alias("size"))
    return blocks_from_sizes(nodes, sizes)


def write_remapping(permutation: DataFrame, path: str) -> None:
    """Line i holds the new id of node i."""
    write_lines(permutation.select(F.col("old_id").alias("id"), F.col("new_id").cast("string").alias("value")), path)


def write_level(graph: Graph, partition: DataFrame, path: str, pattern: str = "n%n_m%m_k%k_seed%seed", k: int = 0, seed: int = 0) -> str:
    """A dump of one level: graph and partition under a name made from the pattern."""
    name = pattern
    for key, value in (("%seed", seed), ("%n", graph.n()), ("%m", graph.m()), ("%k", k)):
        name = name.replace(key, str(value))
    write_columnar(graph, f"{path}/{name}")
    partition.write.mode("overwrite").parquet(f"{path}/{name}/partition")
    return f"{path}/{name}"
