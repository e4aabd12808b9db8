"""What the corpus operators share: the shared scratch folder, Arrow batches in bounded pieces, digests."""

from __future__ import annotations

import gc
import hashlib
import re
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

#: Bytes of text that one numpy pass takes at most; a longer text is a piece of its own.
PIECE_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or (unset, in local mode only) one of our own."""
    sc = spark.sparkContext
    path = sc.getConf().get("spark.checkpoint.dir", None)
    if path is None and sc.getCheckpointDir() is None and not re.match(r"local(\[|$)", sc.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(path or tempfile.mkdtemp(prefix="graphloom-"))
    return path or sc.getCheckpointDir()


def written(df: DataFrame, name: str, partition_by: tuple[str, ...] = ()) -> DataFrame:
    """df as a Parquet table in the shared folder: cuts lineage and outlives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.partitionBy(*partition_by).parquet(path)
    schema = StructType([f for f in df.schema if f.name not in partition_by] + [df.schema[c] for c in partition_by])
    out = spark.read.schema(schema).parquet(path)
    out._path = path
    return out


def discard(*frames: DataFrame) -> None:
    """Removes tables that ``written`` made and that no plan still to run reads."""
    for df in frames:
        jvm = df.sparkSession.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(df._path)
        path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def checkpointed(df: DataFrame) -> DataFrame:
    """df after a reliable checkpoint; for small and middling tables.

    A checkpoint runs its plan once to count and again to write, so the rows are held (on disk if need be) in between.
    """
    shared_dir(df.sparkSession)
    held = df.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        return held.checkpoint(eager=True)
    finally:
        held.unpersist()


def compact(df: DataFrame, rows: int = 20_000) -> tuple[DataFrame, int]:
    """(df after a checkpoint, in no more partitions than one for each ``rows`` rows; its rows): what a loop has left may be far less than it began with."""
    out = checkpointed(df)
    n = out.coalesce(df.sparkSession.sparkContext.defaultParallelism).count()  # the driver keeps a record of every task
    return out.coalesce(n // rows + 1), n


def release(spark: SparkSession) -> None:
    """Lets Spark's cleaner free the shuffle files of plans that are done."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def small_batches(docs: DataFrame, rows: int = 1000) -> DataFrame:
    """docs, with Arrow batches of at most ``rows`` rows from now on: a batch of texts stands in memory several times over.

    The setting is read when the query runs, which is after this call, so it holds for the rest of the session; a smaller one is kept.
    """
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    conf = docs.sparkSession.conf
    if not 0 < int(conf.get(name)) <= rows:
        conf.set(name, str(rows))
    return docs


def pieces(batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut so that each holds at most ``limit`` bytes of text, or one row."""
    for batch in batches:
        col = batch.column(batch.schema.get_field_index(text))
        if not batch.num_rows:
            continue
        sizes = pa.compute.fill_null(pa.compute.binary_length(col), 0).to_pylist()
        start = held = 0
        for i, n in enumerate(sizes):
            if held and held + n > limit:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += n
        yield batch.slice(start)


def sha256_hex(data: str | bytes) -> str:
    return hashlib.sha256(data.encode() if isinstance(data, str) else data).hexdigest()


def spans_text(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
