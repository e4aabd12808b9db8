"""Session defaults and the ways to cut lineage."""

from __future__ import annotations

import os
import re
import tempfile

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession


def session(cores: int | str = "*", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session with the settings that the engine expects; on a cluster the caller brings its own."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName("graphloom")
    settings = {
        "spark.sql.shuffle.partitions": shuffle_partitions,
        "spark.sql.adaptive.enabled": "true",
        "spark.driver.memory": os.environ.get("GRAPHLOOM_DRIVER_MEMORY", memory),
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    }
    for k, v in settings.items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or (unset, in local mode only) one of our own."""
    sc = spark.sparkContext
    path = sc.getConf().get("spark.checkpoint.dir", None)
    if path is None and sc.getCheckpointDir() is None and not re.match(r"local(\[|$)", sc.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(path or tempfile.mkdtemp(prefix="graphloom-"))
    return path or sc.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """df, computed once into the shared folder; survives lost executors and ends the lineage of a loop.

    A checkpoint runs its plan once to count and again to write, so the rows are held (on disk if need be) in between.
    """
    shared_dir(df.sparkSession)
    held = df.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        return held.checkpoint(eager=True)
    finally:
        held.unpersist()


#: Bytes of input files for each partition of a shuffle, the bytes up to which adaptive execution merges partitions, and those of a task that reads.
INPUT_BYTES, MERGED_BYTES, READ_BYTES = 4 << 20, 8 << 20, 32 << 20


def sized_for(df: DataFrame) -> DataFrame:
    """df itself; from here on the session's shuffles have partitions enough for its files, so that tasks don't grow with the input.

    The settings are only ever made finer: a fixed number of partitions, or merging up to 64 MB, lets sorts and windows grow to gigabytes in a task.
    """
    conf = df.sparkSession.conf
    wanted = -(-int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) // INPUT_BYTES)
    if int(conf.get("spark.sql.shuffle.partitions")) < wanted:
        conf.set("spark.sql.shuffle.partitions", str(wanted))
    for name, most in (("spark.sql.adaptive.advisoryPartitionSizeInBytes", MERGED_BYTES), ("spark.sql.files.maxPartitionBytes", READ_BYTES)):
        if df.sparkSession._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(conf.get(name)) > most:
            conf.set(name, str(most))
    return df


def small(df: DataFrame) -> DataFrame:
    """df as rows of the plan itself; for tables of a row for each block."""
    return df.sparkSession.createDataFrame(df.collect(), df.schema)
