"""Quality rules with a hashed n-gram likelihood ratio (operator 3); DataFrame functions only.

Two multinomials over ``BUCKETS`` hashed n-grams (words, word pairs, word ends): one of all documents, one of the trusted ones (labels
with quality 1). Their log ratio, summed over a document's n-grams and divided by their number, is held against one threshold for all.
Pseudo-counts are in proportion to the two totals, so an n-gram too rare to tell gets a ratio near 1 at every corpus size.

The threshold is fitted on every labelled row that passes the base rules: of all cuts the one with the best mean accuracy over the two
classes, of equally good ones the middle of the widest gap, of equally wide ones the lowest. Without labelled rows of both classes it
is ``THRESHOLD``. A document on the threshold is kept. An id that is labelled both ways counts as quality 1. The ratios are computed once,
written without the texts' words and judged when they are read again; cuts are counted over ranges of the ratio, never in one task.

All trusted ids mark their documents: up to ``BROADCAST_IDS`` are broadcast, more are joined by hash. The raw counts cover every document.
The ratio table is a literal of BUCKETS doubles, whatever the corpus; one plan of a run holds it.

Defined results: null and empty texts have no words, so they fail the base rules; a document of one word has no pairs; an empty table
gives no rows; repeated rows count and return repeatedly; a null doc_id is kept and is never trusted; columns besides those named are
ignored by ``score`` and kept by ``keep``.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed, written

BUCKETS = 1 << 16
BROADCAST_IDS = 200_000
PSEUDO = 30.0
THRESHOLD = -0.55
MIN_WORDS, REPEAT_PERCENT = 50, 50


def bound(value: Column, body) -> Column:
    """body(value) with the value computed once, also where body uses it inside another lambda."""
    return F.transform(F.array(value), body)[0]


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), "")


def word_hashes(w: Column) -> Column:
    return F.transform(w, lambda x: F.xxhash64(x))


def ngram_buckets(w: Column, h: Column, n: Column) -> Column:
    """The bucket of each word, each pair of neighbours and each word's last two characters. h: the words' hashes, computed once for all."""
    bucket = lambda x: F.pmod(x, F.lit(BUCKETS)).cast("int")
    less = F.greatest(n - 1, F.lit(0))
    return F.concat(
        F.transform(h, bucket),
        F.zip_with(F.slice(h, 1, less), F.slice(h, 2, less), lambda a, b: bucket(F.xxhash64(a, b))),
        F.transform(w, lambda x: bucket(F.xxhash64(F.substring(x, -2, 2)))),
    )


def repeated_words(h: Column, n: Column) -> Column:
    """Words inside a 3-word window that the text holds twice or more: windows sorted by hash, neighbours compared, positions covered."""

    def covered(windows: Column) -> Column:
        pairs = F.array_sort(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        twice = bound(pairs, lambda s: F.filter(s, lambda x, i: (i > 0) & (F.get(s, i - 1)["h"] == x["h"]) | F.coalesce(F.get(s, i + 1)["h"] == x["h"], F.lit(False))))
        places = F.sort_array(F.transform(twice, lambda x: x["i"]))
        start = F.struct(F.lit(-3).alias("last"), F.lit(0).alias("sum"))
        return F.aggregate(places, start, lambda acc, x: F.struct(x.alias("last"), (acc["sum"] + F.least(F.lit(3), x - acc["last"])).alias("sum")))["sum"]

    def over(h: Column) -> Column:
        windows = F.transform(F.slice(h, 1, F.greatest(n - 2, F.lit(0))), lambda x, i: F.xxhash64(x, F.get(h, i + 1), F.get(h, i + 2)))
        return bound(windows, lambda v: F.when(F.size(F.array_distinct(v)) == F.size(v), F.lit(0)).otherwise(covered(v)))

    return bound(h, over)  # as a variable: an optimiser that inlines h into the lambda would make it quadratic


def duplicate_lines(text: Column) -> Column:
    lines = F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return bound(lines, lambda v: F.size(v) - F.size(F.array_distinct(v)))


def base(docs: DataFrame) -> DataFrame:
    """docs with ``w``, ``h`` and the base columns."""
    text, n = F.coalesce(F.col("text"), F.lit("")), F.col("n_words")
    out = docs.withColumn("w", words(F.col("text"))).withColumns({"n_words": F.size("w"), "h": word_hashes(F.col("w"))})
    out = out.withColumns({"word_chars": F.length(F.array_join("w", "")).cast("long"), "n_symbols": F.length(F.regexp_replace(text, r"[^#*$%&|<>]+", "")).cast("long"), "n_dup_lines": duplicate_lines(F.col("text")).cast("long"), "n_repeat_words": repeated_words(F.col("h"), n).cast("long")})
    return out.withColumn("base_failed", (n < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * n.cast("long")))


def trusted_ids(labels: DataFrame, most: int | None = None) -> DataFrame:
    """The ids with quality 1: all of them, or (``most`` given) a hash-chosen share of about as many."""
    good = labels.filter((F.col("quality") == 1) & F.col("doc_id").isNotNull()).select("doc_id")
    if most is not None and (n := good.count()) > most:
        good = good.filter(F.pmod(F.xxhash64("doc_id", F.lit(42)), F.lit(1 << 30)) < int((1 << 30) * most / n))
    return good.distinct().withColumn("trusted", F.lit(1))


def log_ratios(docs: DataFrame, labels: DataFrame) -> list[float]:
    """The log ratio of each bucket. Raises nothing on empty tables: without trusted documents every ratio is 0."""
    trusted = trusted_ids(labels)
    trusted = F.broadcast(trusted) if trusted.count() <= BROADCAST_IDS else trusted.hint("shuffle_hash")
    marked = docs.select("doc_id", "text").join(trusted, "doc_id", "left")
    w = marked.select("trusted", words(F.col("text")).alias("w")).withColumn("h", word_hashes(F.col("w")))
    counts = (
        w.select("trusted", F.explode(ngram_buckets(F.col("w"), F.col("h"), F.size("w"))).alias("bucket"))
        .groupBy("bucket").agg(F.count("*").alias("raw"), F.count("trusted").alias("target"))
        .collect()  # at most BUCKETS rows
    )
    total_raw, total = sum(r["raw"] for r in counts), sum(r["target"] for r in counts)
    out = [0.0] * BUCKETS
    if total:
        share = total / total_raw
        for r in counts:
            out[r["bucket"]] = math.log((r["target"] + PSEUDO * share) / ((r["raw"] + PSEUDO) * share))
    return out


def best_cut(found: list[tuple[float, int]]) -> float:
    """The threshold from (ratio, quality) rows: rows below it are rejected."""
    n = [sum(q == k for _, q in found) for k in (0, 1)]
    if not all(n):
        return THRESHOLD
    by: dict[float, list[int]] = {}
    for x, q in found:
        by.setdefault(x, [0, 0])[q] += 1
    values, right, cuts = sorted(by), [0, n[1]], []
    for x, after in zip(values, values[1:], strict=False):
        right = [right[0] + by[x][0], right[1] - by[x][1]]
        cuts.append((round(right[0] / n[0] + right[1] / n[1], 12), after - x, -x, (x + after) / 2))
    return max(cuts)[3] if cuts else THRESHOLD


def widest_cut(values: DataFrame) -> float:
    """The cut of ``best_cut`` from (llr, bad, good): the labelled rows of either class at each distinct ratio, counted over ranges of it."""
    ranged = checkpointed(values.repartitionByRange("llr").withColumn("part", F.spark_partition_id()))
    parts = ranged.groupBy("part").agg(F.min("llr").alias("first"), F.sum("bad").alias("bad"), F.sum("good").alias("good")).collect()  # a row for each partition
    parts.sort(key=lambda r: r["first"])
    n = [sum(r[k] for r in parts) for k in ("bad", "good")]
    if not all(n):
        return THRESHOLD
    ends, bad, good = [], 0, 0
    for i, r in enumerate(parts):
        ends.append((r["part"], bad, good, parts[i + 1]["first"] if i + 1 < len(parts) else None))
        bad, good = bad + r["bad"], good + r["good"]
    rows = ranged.join(F.broadcast(values.sparkSession.createDataFrame(ends, "part int, bad_before long, good_before long, following double")), "part")
    order = Window.partitionBy("part").orderBy("llr")
    until = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    right = (F.col("bad_before") + F.sum("bad").over(until)) * n[1] + (n[1] - F.col("good_before") - F.sum("good").over(until)) * n[0]
    cuts = rows.select("llr", right.alias("right"), F.coalesce(F.lead("llr").over(order), "following").alias("after")).filter("after is not null")
    best = cuts.agg(F.max(F.struct("right", F.col("after") - F.col("llr"), -F.col("llr"), ((F.col("llr") + F.col("after")) / 2).alias("cut"))).alias("best")).first()["best"]
    return best["cut"] if best else THRESHOLD


def fitted_threshold(rows: DataFrame, labels: DataFrame) -> float:
    """The threshold from all labelled rows of rows (doc_id, llr, base_failed) that pass the base rules."""
    known = labels.filter(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("quality").cast("long").alias("quality"))
    judged = rows.filter("not base_failed").select("doc_id", "llr").join(known, "doc_id")
    return widest_cut(judged.groupBy("llr").agg(F.sum(1 - F.col("quality")).alias("bad"), F.sum("quality").alias("good")))


def with_ratio(rows: DataFrame, ratios: Column) -> DataFrame:
    """rows of ``base`` with ``llr``: the mean log ratio, null without words."""
    grams = ngram_buckets(F.col("w"), F.col("h"), F.col("n_words"))
    total = bound(grams, lambda g: F.aggregate(g, F.lit(0.0), lambda acc, b: acc + F.get(ratios, b)) / F.size(g))
    return rows.withColumn("llr", F.when(F.col("n_words") > 0, total))


def rated(docs: DataFrame, labels: DataFrame, *columns: str) -> DataFrame:
    """These columns of docs, the base columns and ``llr`` (mean log ratio, null without words)."""
    own = docs.select("text", *(F.col(f"`{c}`") for c in columns if c != "text"))
    ratios = F.split(F.lit(",".join(map(repr, log_ratios(docs, labels)))), ",").cast("array<double>")  # folded into one literal
    out = with_ratio(base(own), ratios)
    return out.withColumn("n_words", F.col("n_words").cast("long")).drop("w", "h", *(() if "text" in columns else ("text",)))


def score(docs: DataFrame, labels: DataFrame, threshold: float | None = None, columns: tuple[str, ...] | None = None) -> DataFrame:
    """docs (or these columns of it) with the base columns, ``llr``, ``base_failed`` and ``kept``; the threshold is fitted if not given."""
    made = {"w", "h", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "llr"}
    out = rated(docs, labels, *(c for c in columns or docs.columns if c.lower() not in made))
    if threshold is None:
        out = written(out, "quality-rated")
        threshold = fitted_threshold(out, labels)
    return out.withColumn("kept", ~F.col("base_failed") & F.coalesce(F.col("llr") >= threshold, F.lit(False)))


def keep(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs, with their own columns, that the rules keep."""
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")
    rows = rated(docs.select("doc_id", "text", row), labels, "doc_id", "row").select("doc_id", "llr", "base_failed", "row")
    rows = written(rows, "quality-rated")  # all of them: a filter here would be computed apart from the ratios, which doubles the work
    return rows.filter(~F.col("base_failed") & (F.col("llr") >= fitted_threshold(rows, labels))).select("row.*")
