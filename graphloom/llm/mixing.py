"""Mixing sources to target weights by temperature (operator 2); DataFrame functions only.

A source with token share p gets weight p**a / sum(p**a). Entropy falls and the largest repetition falls as the exponent a grows from 0
(equal weights) to 1 (shares as they are), so the smallest exponent that meets a target entropy or a repetition limit is found by
bisection; a pass over the table of sources evaluates ``PROBES`` exponents at once.

The weights become whole permutations: a source's documents are dealt to blocks of about ``BLOCK_TOKENS`` tokens by hash; a block with r
repetitions is emitted floor(r) times whole, each time in another order, and once more up to the budget that is left of it, in the order
of that permutation. Blocks carry the same budget in proportion to their tokens, so nothing is summed across blocks and a hot source is
as many tasks' work as it has blocks.

``budget=None`` takes the least number of tokens that emits every document at least once; a number takes that many.

Defined results: a null source is a source of its own; a document without words has no tokens, is emitted with its block's whole
permutations and with the last part; a null text has no words; repeated rows are drawn each for itself; a source without tokens is emitted
once; an empty table gives no rows. Columns that clash with ours are replaced by ``draw`` and kept by ``mix``.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from .common import checkpointed

ENTROPY = 0.9  # of the entropy of equal weights
REPEATS = 2.0
BLOCK_TOKENS = 200_000
PROBES, PASSES = 16, 7
SEED = 17
BROADCAST_SOURCES, SALTS = 50_000, 64


def tokens(text: Column) -> Column:
    """Words between ASCII white space."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def shares(sized: DataFrame) -> DataFrame:
    """(source, tokens, docs, p): one row for each source; p is its share of all tokens, null without any."""
    by = sized.groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("docs"))
    total = by.agg(F.sum("tokens")).first()[0] or 0
    return by.withColumn("p", F.when(F.col("tokens") > 0, F.col("tokens") / F.lit(float(total or 1))))


def exponent(by: DataFrame, entropy: float | None = ENTROPY, repeats: float | None = REPEATS, budget_share: float | None = None) -> float:
    """The smallest exponent in [0, 1] with entropy at most ``entropy`` times that of equal weights, and repetition at most ``repeats``.

    Repetition is weight / share, in units of the corpus if budget_share is given, else of the least-drawn source.
    """
    live = by.filter("p is not null")
    low, high = 0.0, 1.0
    for _ in range(PASSES):
        step = (high - low) / (PROBES + 1)
        probes = [low + step * (i + 1) for i in range(PROBES)]
        x = live.select("p", F.explode(F.array(*map(F.lit, probes))).alias("a")).withColumn("q", F.pow("p", "a"))
        z, zq = F.sum("q"), F.sum(F.col("q") * F.log("q"))
        r = F.col("q") / F.col("p")
        most = F.max(r) / F.min(r) if budget_share is None else F.max(r) * budget_share / z
        found = {row["a"]: row for row in x.groupBy("a").agg(F.count("*").alias("n"), (F.log(z) - zq / z).alias("h"), most.alias("most")).collect()}  # PROBES rows
        if not found:
            return 1.0

        def meets(row: Row) -> bool:
            return (entropy is None or row["h"] <= entropy * math.log(row["n"]) + 1e-12) and (repeats is None or row["most"] <= repeats + 1e-12)

        good = [a for a in probes if meets(found[a])]
        high = good[0] if good else high
        low = max((a for a in probes if a < high and a not in good), default=low)
    return round(high, 6)


def plan(sized: DataFrame, entropy: float | None = ENTROPY, repeats: float | None = REPEATS, budget: int | None = None) -> DataFrame:
    """(source, weight, repetition, blocks), one row for each source; sized has ``source`` and ``n_tokens``."""
    by = checkpointed(shares(sized))
    total = by.agg(F.sum("tokens")).first()[0] or 0
    a = exponent(by, entropy, repeats, budget / total if budget and total else None)
    norm, least = by.agg(F.sum(F.pow("p", F.lit(a))), F.min(F.pow("p", F.lit(a - 1)))).first()
    per_share = F.pow("p", F.lit(a - 1))
    repetition = per_share / F.lit(float(least or 1)) if budget is None else per_share / F.lit(float(norm or 1)) * F.lit(budget / max(total, 1))
    return by.select(
        "source", F.coalesce(F.pow("p", F.lit(a)) / F.lit(float(norm or 1)), F.lit(0.0)).alias("weight"),
        F.round(F.coalesce(repetition, F.lit(1.0)), 9).alias("repetition"),
        F.greatest(F.lit(1), F.floor(F.greatest(F.col("tokens") / F.lit(BLOCK_TOKENS), F.col("docs") / F.lit(BLOCK_TOKENS)))).cast("long").alias("blocks"),
    )


def order_key(seed: int, epoch: Column) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.col("mark")).cast("binary"))


def with_plan(rows: DataFrame, planned: DataFrame) -> DataFrame:
    """rows with their source's repetition and blocks. A plan beyond the broadcast bound is spread over salts, as one source may be hot."""
    right = planned.select(F.col("source").alias("_source"), "repetition", "blocks")
    on = F.col("source").eqNullSafe(F.col("_source"))
    if planned.count() <= BROADCAST_SOURCES:
        return rows.join(F.broadcast(right), on).drop("_source")
    salted = right.withColumn("_salted", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    own = rows.withColumn("_salt", F.pmod(F.xxhash64("doc_id", "mark"), F.lit(SALTS)).cast("int"))
    return own.join(salted, on & (F.col("_salt") == F.col("_salted"))).drop("_source", "_salt", "_salted")


def emitted(sized: DataFrame, planned: DataFrame, seed: int = SEED) -> DataFrame:
    """sized (doc_id, source, n_tokens, mark: a digest of the text, more) once for each emission, with ``epoch``, ``block``, ``order_key``.

    Sorting by epoch, block and order_key gives the permutations; blocks may be interleaved in any way.
    """
    number = F.conv(F.substring(order_key(seed, F.lit(-1)), 1, 12), 16, 10).cast("long")
    rows = with_plan(sized, planned).withColumn("block", F.pmod(number, F.col("blocks")))
    whole = F.floor("repetition").cast("int")
    block = Window.partitionBy("source", "block")
    upto = block.orderBy("_last", "doc_id", "mark").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("_last", order_key(seed, whole)).withColumns({"_upto": F.sum("n_tokens").over(upto), "_all": F.sum("n_tokens").over(block)})
    # a document belongs to the last part if its middle lies within the budget
    inside = 2 * F.col("_upto") - F.col("n_tokens") < 2 * (F.col("repetition") - whole) * F.col("_all")
    rows = rows.withColumn("_times", whole + inside.cast("int")).filter("_times > 0")
    out = rows.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.col("_times") - 1)))
    return out.withColumn("order_key", order_key(seed, F.col("epoch"))).drop("_last", "_upto", "_all", "_times", "repetition", "blocks")


def draw(docs: DataFrame, entropy: float | None = ENTROPY, repeats: float | None = REPEATS, budget: int | None = None, seed: int = SEED) -> DataFrame:
    """doc_id, source, n_tokens, epoch, block and order_key of each emission of a row of docs (doc_id, text, source)."""
    mark = F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("mark")
    sized = checkpointed(docs.select("doc_id", "source", tokens(F.col("text")).alias("n_tokens"), mark))
    return emitted(sized, plan(sized, entropy, repeats, budget), seed).select("doc_id", "source", "n_tokens", "epoch", "block", "order_key")


def mix(docs: DataFrame, entropy: float | None = ENTROPY, repeats: float | None = REPEATS, budget: int | None = None, seed: int = SEED) -> DataFrame:
    """The rows of docs, with their own columns, as often as the mixture emits them."""
    mark = F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("mark")
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row")
    planned = plan(docs.select("source", tokens(F.col("text")).alias("n_tokens")), entropy, repeats, budget)
    sized = docs.select(row, "doc_id", "source", tokens(F.col("text")).alias("n_tokens"), mark)
    return emitted(sized, planned, seed).select("_row.*")


ORACLE_SQL = """
WITH RECURSIVE d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS n_tokens, md5(coalesce(text, '')) AS mark FROM documents
), t AS (SELECT source, sum(n_tokens) AS tokens, count(*) AS docs FROM d GROUP BY source),
s AS (SELECT source, tokens, docs, CASE WHEN tokens > 0 THEN CAST(tokens AS DOUBLE) / (SELECT sum(tokens) FROM t) END AS p FROM t),
live AS (SELECT p FROM s WHERE p IS NOT NULL),
bisect(i, low, high) AS (
  SELECT 0, CAST(0.0 AS DOUBLE), CAST(1.0 AS DOUBLE)
  UNION ALL
  SELECT i + 1, CASE WHEN ok THEN low ELSE (low + high) / 2 END, CASE WHEN ok THEN (low + high) / 2 ELSE high END
  FROM (SELECT i, low, high, (SELECT ln(sum(pow(p, (low + high) / 2))) - sum(pow(p, (low + high) / 2) * ln(pow(p, (low + high) / 2))) / sum(pow(p, (low + high) / 2)) <= 0.9 * ln(count(*)) + 1e-12
      AND max(pow(p, (low + high) / 2) / p) / min(pow(p, (low + high) / 2) / p) <= 2.0 + 1e-12 FROM live) AS ok FROM bisect WHERE i < 40)
), a AS (SELECT round(high, 6) AS a FROM bisect WHERE i = 40),
plan AS (
  SELECT source, round(coalesce(pow(p, a - 1) / (SELECT min(pow(p, a - 1)) FROM live), 1.0), 9) AS repetition,
    greatest(1, CAST(floor(greatest(tokens / 200000.0, docs / 200000.0)) AS BIGINT)) AS blocks
  FROM s, a
), r AS (
  SELECT d.*, repetition, CAST(floor(repetition) AS INT) AS whole,
    CAST('0x' || substr(md5(concat_ws(':', '17', '-1', coalesce(CAST(doc_id AS VARCHAR), '-'), mark)), 1, 12) AS BIGINT) % blocks AS block,
    md5(concat_ws(':', '17', CAST(CAST(floor(repetition) AS INT) AS VARCHAR), coalesce(CAST(doc_id AS VARCHAR), '-'), mark)) AS last
  FROM d JOIN plan ON d.source IS NOT DISTINCT FROM plan.source
), w AS (
  SELECT *, sum(n_tokens) OVER (PARTITION BY source, block ORDER BY last, doc_id, mark ROWS UNBOUNDED PRECEDING) AS upto, sum(n_tokens) OVER (PARTITION BY source, block) AS total FROM r
), x AS (SELECT *, unnest(range(whole + CAST(2 * upto - n_tokens < 2 * (repetition - whole) * total AS INT))) AS e FROM w)
SELECT doc_id, source, n_tokens, CAST(e AS INT) AS epoch, block, md5(concat_ws(':', '17', CAST(e AS VARCHAR), coalesce(CAST(doc_id AS VARCHAR), '-'), mark)) AS order_key FROM x
"""
