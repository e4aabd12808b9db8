"""The corpus pipeline: quality rules, near-duplicates, benchmark decontamination, source mixing, sharding.

Every stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept; all but the last return the columns of
``documents``. ``run`` writes each stage's rows as Parquet in the shared folder and reads them again for the next.

Defined results: null, empty and blank texts have too few words and go in the first stage, so later stages see none of them in a run (alone,
they handle them as their operators' docstrings say). Long texts count whole. Rows equal in doc_id and text are copies of one another: one
stays. A null doc_id stays behind all others among near copies. Ties of key or order are settled by hashes of doc_id and text, so a run gives
the same rows each time; of rows equal in both any one may stay. Empty tables give empty stages; without labels the likelihood ratio is 0 and
only the base rules reject, without a benchmark nothing is contaminated. Columns beside those of ``documents`` are carried along, and
the last stage's own columns (size, law, shard, slot) replace any of that name. Mixing may emit a document several times.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from graphloom.llm import decontaminate, mixing, quality, sharding, simhash
from graphloom.llm.common import table, written


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.drop_near_duplicates(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.drop_affected(docs, table(spark, sf_dir, "benchmark"))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs)


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sharding.shard(docs)


STAGES = [
    ("quality", quality_rules),
    ("near-duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("mixing", source_mixing),
    ("sharding", shards),
]

#: No SQL: the likelihood ratio and the fingerprints need XXH64, which the oracle's SQL lacks; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
