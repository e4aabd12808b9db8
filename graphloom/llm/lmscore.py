"""Masked pseudo-likelihood by a bidirectional window network in numpy (operator 9).

A word is a leaf of a tree of LEVELS digits (two from the hash of its last two characters, two from its own) and a share of that leaf:

    log P(word | both sides) = sum over levels of log P(digit | higher digits, SIDE words to either side) + log(count of word / count of leaf)

This is a proper distribution over all words of the corpus. The network predicts every digit of the masked middle word: an embedding for
each place of the window (an own one for each of the OWN commonest words, else one for the last two characters), for each level an
embedding of the digits above it, a tanh layer and a softmax over the digits, whose biases are the log frequencies in the corpus. Word and
leaf counts cover every word of every document; the commonest COMMON words travel with the tasks, all others are joined by their hash.

Training is one round of local stochastic gradient steps on every window of every document. Documents are dealt to groups of about
GROUP_TOKENS tokens by the hash of the row and taken in hash order, every group starts from the same weights, and the groups' weights are
averaged by their number of windows in fixed point. Hence scores depend on the rows only, not on how the table is
partitioned, but for the last bits of single precision, as the texts of a piece share matrix products.

Defined results: null, empty and blank texts have 0 tokens, a sum of 0 and a null mean; a single word is predicted from padding alone; an
empty table gives no rows; repeated rows give equal scores; a null doc_id is kept; other columns are ignored; words with equal counts are
common or not together, and are numbered in byte order. A word is what lies between ASCII white space. Long texts are cut at white space
while they are read, and count as a whole.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pieces, release, small_batches, written

COMMON, OWN, TAILS = 30_000, 1024, 256
LEVELS, DIGITS = 4, 16
LEAVES = DIGITS**LEVELS
CLASSES = OWN + TAILS  # of the words around the masked one; CLASSES itself stands for padding
DIM, SIDE = 16, 2
OFFSETS = [o for o in range(-SIDE, SIDE + 1) if o]
BATCH, RATE = 4096, 0.08
GROUP_TOKENS, PIECE_TOKENS = 2_500_000, 400_000
ONES, EVERY_DIGIT = np.ones((DIGITS, 1), np.float32), np.arange(DIGITS)[:, None]
SEED = 3
FIXED = 1 << 20
CACHE = 1 << 20  # rare words that a task remembers
CUT_BYTES = 1 << 20


def tail_of(word: bytes) -> int:
    """The class of the word's last two characters."""
    end = word[-2:] if word[-2:].isascii() else word.decode("utf-8", "replace")[-2:].encode()
    return xxhash.xxh64_intdigest(end, 42) % TAILS


def leaf_of(word: bytes) -> int:
    return tail_of(word) << 8 | xxhash.xxh64_intdigest(word, 42) & 255


class Vocabulary(dict):
    """word -> place in the arrays: leaf, class as a neighbour, hash, and log(count / count of leaf), 0 for rare words."""

    def __init__(self, common: list[tuple[str, int]], totals: np.ndarray):
        super().__init__()
        self.common, self.totals = common, totals
        n = len(common) + CACHE
        self.leaf, self.cls = np.zeros(n, np.uint16), np.zeros(n, np.uint16)
        self.hash, self.logw = np.zeros(n, np.int64), np.zeros(n)
        self.fill()

    def fill(self) -> None:
        self.clear()
        self.used = 0
        for i, (word, n) in enumerate(self.common):
            at = self[word.encode()]
            if i < OWN:
                self.cls[at] = i
            self.logw[at] = math.log(n / self.totals[self.leaf[at]])

    def __missing__(self, word: bytes) -> int:
        at = self.used
        self.used += 1
        h, tail = xxhash.xxh64_intdigest(word, 42), tail_of(word)
        self.leaf[at], self.cls[at] = tail << 8 | h & 255, OWN + tail
        self.hash[at] = h - (1 << 64) if h >> 63 else h
        self[word] = at
        return at

    def encode(self, text: bytes | None) -> tuple[np.ndarray, np.ndarray, float, np.ndarray]:
        """(leaves, classes, sum of logw over the common words, hashes of the rare ones) of a text's words."""
        parts = []
        for part in cut(text or b""):
            if self.used > len(self.leaf) - CUT_BYTES // 2 - 1:
                self.fill()
            words = part.split()
            at = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
            rare = at >= len(self.common)
            parts.append((self.leaf[at], self.cls[at], float(self.logw[at].sum()), self.hash[at[rare]]))
        if len(parts) == 1:
            return parts[0]
        a, b, c, d = zip(*parts, strict=True)
        return np.concatenate(a), np.concatenate(b), math.fsum(c), np.concatenate(d)


def cut(data: bytes, limit: int = CUT_BYTES) -> Iterator[bytes]:
    """The text in parts of about ``limit`` bytes that end at white space; a word isn't parted."""
    at = 0
    while len(data) - at > limit:
        end = at + limit
        while end < len(data) and data[end] not in b" \t\n\x0b\x0c\r":
            end += 1
        yield data[at:end]
        at = end
    yield data[at:]


# ---------------------------------------------------------------------- counts


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, n, h, leaf) of every word of every document."""
    words = docs.select(F.explode(F.split(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+")).alias("word")).filter("word <> ''")
    counts = words.groupBy("word").agg(F.count("*").alias("n")).withColumn("h", F.xxhash64("word"))
    tail = F.pmod(F.xxhash64(F.right("word", F.lit(2))), F.lit(TAILS))
    return written(counts.withColumn("leaf", (F.shiftleft(tail, 8) + F.col("h").bitwiseAND(F.lit(255))).cast("int")), "word-counts")


def commonest(counts: DataFrame, most: int = COMMON) -> tuple[list[tuple[str, int]], DataFrame]:
    """At most ``most`` words that are commoner than the others, commonest first, and the counts of the others."""
    size = F.floor(F.log2("n") * 8)
    histogram = sorted(((r["b"], r["c"]) for r in counts.groupBy(size.alias("b")).agg(F.count("*").alias("c")).collect()), reverse=True)  # a few hundred rows
    least, have = float("inf"), 0
    for b, c in histogram:
        if have + c > most:
            break
        least, have = b, have + c
    if not have:
        return [], counts
    chosen = counts.filter(size >= least).select("word", "n").collect()  # ``most`` rows at most
    return sorted(((r["word"], r["n"]) for r in chosen), key=lambda x: (-x[1], x[0].encode())), counts.filter(size < least)


def leaf_totals(counts: DataFrame) -> np.ndarray:
    out = np.zeros(LEAVES, np.int64)
    for r in counts.groupBy("leaf").agg(F.sum("n").alias("n")).collect():  # LEAVES rows at most
        out[r["leaf"]] = r["n"]
    return out


def biases(totals: np.ndarray) -> list[np.ndarray]:
    """For each level (digits above, digit): the log frequency of the digit; -30 where no word has it."""
    out = []
    for level in range(LEVELS):
        n = totals.reshape(DIGITS**level, DIGITS, -1).sum(2).astype(np.float64)
        with np.errstate(divide="ignore", invalid="ignore"):
            out.append(np.where(n > 0, np.log(n / n.sum(1, keepdims=True)), -30.0).astype(np.float32))
    return out


# ---------------------------------------------------------------------- network


#: Embeddings of the window, their bias; for each level the weights of its digits; embeddings of the digits above: first, first two, third.
SHAPES = [(2 * SIDE, CLASSES + 1, DIM), (DIM,), (LEVELS, DIM, DIGITS), (DIGITS, DIM), (DIGITS**2, DIM), (DIGITS**2, DIM), (DIGITS, DIM)]


def start_weights() -> list[np.ndarray]:
    rng = np.random.default_rng(SEED)
    return [(rng.standard_normal(s) * (0.3 if i < 2 and len(s) > 1 else 0.1 if len(s) > 1 else 0)).astype(np.float32) for i, s in enumerate(SHAPES)]


def flat(weights: list[np.ndarray]) -> np.ndarray:
    return np.concatenate([w.ravel() for w in weights])


def unflat(x: np.ndarray) -> list[np.ndarray]:
    out, at = [], 0
    for s in SHAPES:
        n = int(np.prod(s))
        out.append(x[at : at + n].reshape(s).astype(np.float32))
        at += n
    return out


def above(leaves: np.ndarray) -> list[list[tuple[int, np.ndarray]]]:
    """For each level the (weights, row) of the embeddings of its higher digits."""
    d1, d12, d3 = leaves >> 12, leaves >> 8, leaves >> 4 & 15
    return [[], [(3, d1)], [(4, d12)], [(5, d12), (6, d3)]]


def window(weights: list[np.ndarray], padded: np.ndarray, places: np.ndarray) -> np.ndarray:
    h = weights[0][0].take(padded.take(places + OFFSETS[0]), 0)
    for k, o in enumerate(OFFSETS[1:], 1):
        h += weights[0][k].take(padded.take(places + o), 0)
    h += weights[1]
    return h


def powers(z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(exp of z less a bound, sums of its rows, as a column); z loses the bound too. One bound does for all rows unless they lie far apart."""
    z -= z.max()
    e = np.exp(z)
    total = e @ ONES
    if total.min() < 1e-20:
        z -= z.max(1, keepdims=True)
        e = np.exp(z)
        total = e @ ONES
    return e, total


def levels(weights: list[np.ndarray], bias: list[np.ndarray], h: np.ndarray, leaves: np.ndarray) -> Iterator[tuple[int, list, np.ndarray, np.ndarray, np.ndarray]]:
    """For each level: its embeddings' rows, hidden units, scores of all digits (log-probabilities but for a term of the row), and the digit."""
    for level, rows in enumerate(above(leaves)):
        a = h
        for k, at in rows:
            a = a + weights[k].take(at, 0)
        a = np.tanh(a)
        z = a @ weights[2][level]
        z += bias[level].take(leaves >> 4 * (LEVELS - level), 0)
        yield level, rows, a, z, leaves >> 4 * (LEVELS - level - 1) & 15


def log_leaf(weights: list[np.ndarray], bias: list[np.ndarray], padded: np.ndarray, places: np.ndarray, leaves: np.ndarray) -> np.ndarray:
    """log P(leaf | both sides) of the words at the places."""
    out = np.zeros(len(places))
    for at in range(0, len(places), BATCH):
        some = leaves[at : at + BATCH].astype(np.int32)
        h = window(weights, padded, places[at : at + BATCH])
        every = np.arange(len(some))
        for _, _, _, z, digit in levels(weights, bias, h, some):
            _, total = powers(z)
            out[at : at + BATCH] += z[every, digit] - np.log(total[:, 0])
    return out


def by_row(rows: np.ndarray, *gs: np.ndarray) -> tuple[np.ndarray, ...]:
    """(distinct rows, for each of gs the sums of their gradients)."""
    order = np.argsort(rows.astype(np.uint16), kind="stable")
    rows = rows.take(order)
    cuts = np.flatnonzero(np.concatenate(([True], rows[1:] != rows[:-1])))
    return rows.take(cuts), *(np.add.reduceat(g.take(order, 0), cuts) for g in gs)


def by_digit(rows: np.ndarray, g: np.ndarray) -> np.ndarray:
    """For each digit the sum of the gradients of its rows."""
    return (rows == EVERY_DIGIT).astype(np.float32) @ g


class Trainer:
    """Adagrad on the cross-entropy of the masked word's digits."""

    def __init__(self, weights: list[np.ndarray], bias: list[np.ndarray]):
        self.w, self.bias = [x.copy() for x in weights], bias
        self.g2 = [np.full_like(x, 1e-4) for x in weights]
        self.seen = 0

    def update(self, w: np.ndarray, g2: np.ndarray, at, g: np.ndarray) -> None:
        seen = g2[at] + g * g
        g2[at] = seen
        w[at] -= RATE * g / np.sqrt(seen)

    def step(self, padded: np.ndarray, places: np.ndarray, leaves: np.ndarray) -> None:
        n = len(places)
        h, some, every = window(self.w, padded, places), leaves.astype(np.int32), np.arange(n)
        dh, changes = np.zeros_like(h), []
        das = []
        for level, _, a, z, digit in levels(self.w, self.bias, h, some):
            z, total = powers(z)
            z /= total
            z[every, digit] -= 1
            z /= n
            da = (z @ self.w[2][level].T) * (1 - a * a)
            dh += da
            das.append(da)
            changes.append((2, level, a.T @ z))
        _, [(_, d1)], [(_, d12)], [_, (_, d3)] = above(some)
        changes += [(3, slice(None), by_digit(d1, das[1])), (6, slice(None), by_digit(d3, das[3]))]
        at, g4, g5 = by_row(d12, das[2], das[3])
        changes += [(4, at, g4), (5, at, g5)]
        for k, at, g in changes:
            self.update(self.w[k], self.g2[k], at, g)
        self.update(self.w[1], self.g2[1], slice(None), dh.sum(0))
        for k, o in enumerate(OFFSETS):
            rows, g = by_row(padded[places + o], dh)
            self.update(self.w[0][k], self.g2[0][k], rows, g)
        self.seen += n

    def learn(self, texts: list[tuple[np.ndarray, np.ndarray]], number: int) -> None:
        """One step for each BATCH of the windows of all words of the texts (leaves, classes), in drawn order."""
        padded, places, leaves = laid_out(texts)
        drawn = np.random.default_rng((SEED, number)).permutation(len(places))
        for at in range(0, len(drawn), BATCH):
            some = drawn[at : at + BATCH]
            self.step(padded, places[some], leaves[some])


def laid_out(texts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(classes padded by SIDE on either side of each text, place of each word in them, leaves), texts one after the other."""
    n = np.array([len(x) for x, _ in texts], np.int64)
    places = np.arange(int(n.sum())) + np.repeat(np.arange(1, len(n) + 1) * SIDE, n)
    padded = np.full(int(n.sum()) + SIDE * (len(n) + 1), CLASSES, np.int32)
    if len(places):
        padded[places] = np.concatenate([c for _, c in texts])
    return padded, places, np.concatenate([x for x, _ in texts]) if len(texts) else np.zeros(0, np.uint16)


# ---------------------------------------------------------------------- passes


def encoded(docs: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """(uid, doc_id, r1, r2, n, common, leaves, classes, rare) of every row; leaves and classes are arrays of two-byte numbers."""
    shared = docs.sparkSession.sparkContext.broadcast(pickle.dumps((vocabulary.common, vocabulary.totals)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = Vocabulary(*pickle.loads(shared.value))
        for piece in pieces(batches, "text"):
            found = [v.encode(t) for t in piece.column(3).cast(pa.binary()).to_pylist()]
            columns = [pa.array([len(x[0]) for x in found], pa.int64()), pa.array([x[2] for x in found], pa.float64())]
            columns += [pa.array([x[i].tobytes() for x in found], pa.binary()) for i in (0, 1)] + [pa.array([x[3] for x in found], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([*piece.columns[:3], *columns], names=["doc_id", "r1", "r2", "n", "common", "leaves", "classes", "rare"])

    rows = small_batches(docs).select("doc_id", F.xxhash64("doc_id", "text").alias("r1"), F.xxhash64("text", F.lit(1), "doc_id").alias("r2"), "text")
    out = rows.mapInArrow(run, "doc_id long, r1 long, r2 long, n long, common double, leaves binary, classes binary, rare array<bigint>")
    return written(out.withColumn("uid", F.monotonically_increasing_id()), "lm-encoded")


def arrays(leaves: pa.Array, classes: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    return [(np.frombuffer(a, np.uint16), np.frombuffer(b, np.uint16)) for a, b in zip(leaves.to_pylist(), classes.to_pylist(), strict=True)]


def train(rows: DataFrame, bias: list[np.ndarray], group_tokens: int = GROUP_TOKENS) -> list[np.ndarray]:
    """The average of the groups' weights; rows as ``encoded`` gives them."""
    start = start_weights()
    groups = max(1, round((rows.agg(F.sum("n")).first()[0] or 0) / group_tokens))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trainer, group, held, words, number = None, None, [], 0, 0

        def learned() -> None:
            nonlocal held, words, number
            if words:
                trainer.learn(held, number)
            held, words, number = [], 0, number + 1

        def result() -> pa.RecordBatch:
            fixed = np.round(flat(trainer.w).astype(np.float64) * FIXED).astype(np.int64)
            return pa.RecordBatch.from_arrays([pa.array([trainer.seen], pa.int64()), pa.array([fixed], pa.list_(pa.int64()))], names=["seen", "w"])

        for batch in batches:  # in the order of (group, row), whatever the batches are
            for g, text in zip(batch.column(0).to_pylist(), arrays(batch.column(1), batch.column(2)), strict=True):
                if g != group:
                    if trainer is not None:
                        learned()
                        yield result()
                    trainer, group, number = Trainer(start, bias), g, 0
                held.append(text)
                words += len(text[0])
                if words >= PIECE_TOKENS:
                    learned()
        if trainer is not None:
            learned()
            yield result()

    dealt = rows.filter("n > 0").select(F.pmod(F.xxhash64("r1", "r2"), F.lit(groups)).alias("g"), "r1", "r2", "leaves", "classes")
    dealt = dealt.repartition(4 * groups, "g").sortWithinPartitions("g", "r1", "r2").select("g", "leaves", "classes")
    local = dealt.mapInArrow(run, "seen long, w array<bigint>")
    total = F.sum(F.col("w").cast("decimal(38,0)") * F.col("seen")) / F.sum("seen")
    mean = local.select("seen", F.posexplode("w").alias("i", "w")).groupBy("i").agg(total.cast("double").alias("w")).collect()  # one row for each weight
    if not mean:
        return start
    x = np.zeros(sum(int(np.prod(s)) for s in SHAPES))
    for r in mean:
        x[r["i"]] = r["w"] / FIXED
    return unflat(x)


def rare_sums(rows: DataFrame, rest: DataFrame, totals: np.ndarray) -> DataFrame:
    """(uid, rare): the sum of log(count / count of leaf) over a row's rare words, in units of 1 / FIXED."""
    spark = rows.sparkSession
    of_leaf = spark.createDataFrame([(int(i), float(n)) for i, n in enumerate(totals) if n], "leaf int, total double")  # LEAVES rows at most
    counts = rest.join(F.broadcast(of_leaf), "leaf").select("h", F.round(F.log(F.col("n") / F.col("total")) * FIXED).cast("long").alias("log"))
    words = rows.select("uid", F.explode("rare").alias("h"))  # no rare word is frequent: no hash is hot
    return words.join(counts.hint("shuffle_hash"), "h").groupBy("uid").agg(F.sum("log").alias("rare"))


def fitted(docs: DataFrame, common: int, group_tokens: int) -> tuple[DataFrame, DataFrame, np.ndarray, list[np.ndarray]]:
    """(encoded rows, counts of the rare words, counts of the leaves, weights)."""
    counts = word_counts(small_batches(docs))
    totals = leaf_totals(counts)
    chosen, rest = commonest(counts, common)
    release(docs.sparkSession)
    rows = encoded(docs, Vocabulary(chosen, totals))
    weights = train(rows, biases(totals), group_tokens)
    release(docs.sparkSession)
    return rows, rest, totals, weights


def score(docs: DataFrame, common: int = COMMON, group_tokens: int = GROUP_TOKENS) -> DataFrame:
    """doc_id, n_tokens, pll (sum of the conditional log-probabilities), pll_mean for each row of docs (doc_id, text)."""
    rows, rest, totals, weights = fitted(docs, common, group_tokens)
    bias = biases(totals)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                net = scored(arrays(batch.column(4), batch.column(5)), weights, bias)
                yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(net + batch.column(3).to_numpy())], names=["uid", "doc_id", "n", "part"])

    net = rows.select("uid", "doc_id", "n", "common", "leaves", "classes").mapInArrow(run, "uid long, doc_id long, n long, part double")
    out = net.join(rare_sums(rows, rest, totals), "uid", "left")
    pll = F.col("part") + F.coalesce(F.col("rare") / F.lit(float(FIXED)), F.lit(0.0))
    return out.select("doc_id", F.col("n").alias("n_tokens"), pll.alias("pll"), F.when(F.col("n") > 0, pll / F.col("n")).alias("pll_mean"))


def scored(texts: list[tuple[np.ndarray, np.ndarray]], weights: list[np.ndarray], bias: list[np.ndarray]) -> np.ndarray:
    """The sum of log P(leaf | both sides) over the words of each text (leaves, classes); texts are taken by about PIECE_TOKENS words."""
    out, at = np.zeros(len(texts)), 0
    while at < len(texts):
        end, words = at, 0
        while end < len(texts) and (end == at or words + len(texts[end][0]) <= PIECE_TOKENS):
            words += len(texts[end][0])
            end += 1
        padded, places, leaves = laid_out(texts[at:end])
        logs = log_leaf(weights, bias, padded, places, leaves)
        out[at:end] = np.bincount(np.repeat(np.arange(end - at), [len(x) for x, _ in texts[at:end]]), logs, end - at)
        at = end
    return out
