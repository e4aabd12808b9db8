"""The registered queries: each applies one operator to its whole table and derives the digest columns from its outputs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, linededup, lmscore, mixing, pii, quality, secrets, sharding, simhash, substrings
from .common import table


def op1_pii_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_pii(table(spark, sf_dir, "documents"))


def op2_mix_temperature(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.draw(table(spark, sf_dir, "documents"))


def op3_quality_llr(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = quality.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), columns=("doc_id",))
    return scored.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.round("llr", 6).alias("llr"))


def op4_secret_structure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.find_secrets(table(spark, sf_dir, "documents"))


def op5_line_dedup_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = linededup.dedup_lines(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def op6_decontaminate_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.match(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


def op7_suffix_dedup_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substrings.remove_repeats(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op8_shard_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign(table(spark, sf_dir, "documents"))


def op9_lm_pseudo_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lmscore.score(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_tokens", F.round("pll", 2).alias("pll"), F.round("pll_mean", 4).alias("pll_mean"))


def op10_simhash_covering(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_pii_crf, op2_mix_temperature, op3_quality_llr, op4_secret_structure, op5_line_dedup_runs, op6_decontaminate_suffix, op7_suffix_dedup_levels, op8_shard_histogram, op9_lm_pseudo_likelihood, op10_simhash_covering)}


def oracle_sql() -> dict[str, str]:
    return {"op2_mix_temperature": mixing.ORACLE_SQL, "op5_line_dedup_runs": linededup.ORACLE_SQL, "op6_decontaminate_suffix": decontaminate.ORACLE_SQL}
