"""Quality, mixing, sharding, language-model scores and the pipeline."""

import math
import re
from collections import Counter, defaultdict

import brute
import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from graphloom.llm import lmscore, mixing, quality, queries, sharding


@pytest.fixture(scope="module")
def labels(spark, rows):
    return spark.createDataFrame([(r[0], int(i % 3 > 0), 0) for i, r in enumerate(rows) if r[0] is not None and i % 2 == 0], "doc_id long, quality int, toxic int")


def ratios(rows, labels):
    good = {r.doc_id for r in labels.collect() if r.quality == 1}
    raw, target = Counter(), Counter()
    for r in rows:
        g = brute.grams(r[1], quality.BUCKETS)
        raw.update(g)
        if r[0] in good:
            target.update(g)
    share = sum(target.values()) / sum(raw.values())
    return {b: math.log((target[b] + quality.PSEUDO * share) / ((n + quality.PSEUDO) * share)) for b, n in raw.items()}


def test_quality_against_brute_force(docs, rows, labels):
    llr = ratios(rows, labels)
    got = sorted(quality.score(docs, labels).collect(), key=lambda r: str((r.doc_id, r.text)))
    assert len(got) == len(rows)
    known = {r.doc_id: r.quality for r in labels.collect()}
    judged = [(x.llr, known[x.doc_id]) for x in got if x.doc_id in known and not x.base_failed]
    values = sorted({v for v, _ in judged})
    right = lambda cut, q: np.mean([(v >= cut) == (q == 1) for v, k in judged if k == q])
    cuts = [((a + b) / 2, b - a) for a, b in zip(values, values[1:], strict=False)]
    top = max(right(c, 0) + right(c, 1) for c, _ in cuts)
    cut = max((width, -c) for c, width in cuts if right(c, 0) + right(c, 1) > top - 1e-9)[1] * -1
    for x, r in zip(got, sorted(rows, key=lambda r: str((r[0], r[1]))), strict=True):
        want = brute.quality(r[1])
        assert (x.n_words, x.word_chars, x.n_symbols, x.n_dup_lines, x.n_repeat_words, x.base_failed) == want
        g = brute.grams(r[1], quality.BUCKETS)
        mean = sum(llr[b] for b in g) / len(g) if g else None
        assert x.llr == (pytest.approx(mean, abs=1e-9) if g else None)
        assert x.kept == (not want[5] and mean is not None and mean >= cut)


def test_quality_keeps_columns(docs, labels, empty, spark):
    kept = quality.keep(docs, labels)
    assert kept.columns == docs.columns and 0 < kept.count() < docs.count()
    assert quality.keep(empty, labels).count() == 0
    none = quality.score(docs, labels.limit(0)).filter("llr is not null and llr <> 0")
    assert none.isEmpty()


def test_trusted_sample_is_bounded(spark):
    many = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit(1).alias("quality"))
    assert 300 < quality.trusted_ids(many, 500).count() < 700
    assert quality.trusted_ids(many, 5000).count() == 4000


def test_threshold_takes_every_labelled_row(spark):
    rng = np.random.default_rng(5)
    rows = [(i, " ".join(f"w{x}" for x in rng.integers(0, 40, 55) + (i % 3) * 8)) for i in range(6000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    labels = spark.createDataFrame([(i, int(i % 3 > 0) if rng.random() < 0.8 else int(rng.random() < 0.5)) for i in range(6000)], "doc_id long, quality int")
    got = quality.score(docs, labels).collect()
    known = {r.doc_id: r.quality for r in labels.collect()}
    cut = quality.best_cut([(r.llr, known[r.doc_id]) for r in got if not r.base_failed])
    assert [r.kept for r in got] == [not r.base_failed and r.llr >= cut for r in got]


def test_pipeline_threshold_takes_every_labelled_row(spark, tmp_path):
    rng = np.random.default_rng(8)
    rows = [(i, " ".join(f"w{x}" for x in rng.integers(0, 40, 49 + i % 9) + (i % 3) * 8), i % 5) for i in range(6000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, base_failed int").repartition(4)
    labels = spark.createDataFrame([(i, int(i % 3 > 0) if rng.random() < 0.8 else int(rng.random() < 0.5), 0) for i in range(6000)], "doc_id long, quality int, toxic int")
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    got = quality.score(docs.select("doc_id", "text"), labels, 0.0).collect()
    known = {r.doc_id: r.quality for r in labels.collect()}
    cut = quality.best_cut([(r.llr, known[r.doc_id]) for r in got if not r.base_failed])
    want = {r.doc_id for r in got if not r.base_failed and r.llr >= cut}
    assert sorted(map(tuple, corpus_pipeline.quality_rules(spark, docs, str(tmp_path)).collect())) == [r for r in rows if r[0] in want]


def test_cut_over_ranges_is_the_best_cut(spark):
    rng = np.random.default_rng(6)
    for n, step in ((0, 1), (1, 1), (12, 4), (3000, 0.01), (3000, 0.5)):
        found = [(float(round(x / step) * step), int(q)) for x, q in zip(rng.normal(size=n), rng.integers(0, 2, n), strict=True)]
        rows = spark.createDataFrame(found, "llr double, q long")
        values = rows.groupBy("llr").agg(F.sum(1 - F.col("q")).alias("bad"), F.sum("q").alias("good"))
        assert quality.widest_cut(values) == quality.best_cut(found)
    one = spark.createDataFrame([(0.5, 3, 4)], "llr double, bad long, good long")
    assert quality.widest_cut(one) == quality.THRESHOLD


def test_all_trusted_ids_count_on_either_side(spark, docs, labels, monkeypatch):
    many = spark.range(250_000).select(F.col("id").alias("doc_id"), F.lit(1).alias("quality"))
    assert quality.trusted_ids(many).count() == 250_000
    near = {r.doc_id: r.llr for r in quality.score(docs, labels, 0.0).collect()}
    monkeypatch.setattr(quality, "BROADCAST_IDS", 0)
    assert {r.doc_id: r.llr for r in quality.score(docs, labels, 0.0).collect()} == near


def test_separates_planted_junk(spark):
    import random

    rng = random.Random(0)
    vocabulary = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(300)]
    rows = [(i, " ".join(rng.choice(vocabulary) + ("###" if i % 5 == 0 else "") for _ in range(120))) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 5 > 0)) for i in range(0, 300, 2)], "doc_id long, quality int")
    kept = {r.doc_id for r in quality.keep(docs, labels).collect()}
    assert kept == {i for i in range(300) if i % 5}


def test_mixing_matches_sql(spark, docs, tmp_path):
    docs.drop("block").write.parquet(str(tmp_path / "d"))
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/d/*.parquet'")
    want = con.execute(mixing.ORACLE_SQL).fetchall()
    got = mixing.draw(docs).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    assert max(Counter(r.epoch for r in got)) >= 1  # sources other than the hot one repeat


def test_mixing_weights_and_order(docs, rows):
    plan = {r.source: r for r in mixing.plan(docs.select("source", mixing.tokens(F.col("text")).alias("n_tokens"))).collect()}
    assert sum(r.weight for r in plan.values()) == pytest.approx(1) and min(r.repetition for r in plan.values()) == 1
    assert max(r.repetition for r in plan.values()) <= mixing.REPEATS + 1e-6
    got = mixing.draw(docs).collect()
    assert {str(r.doc_id) for r in got} == {str(r[0]) for r in rows}  # the default budget draws every document
    first = [r.doc_id for r in sorted((r for r in got if r.epoch == 0), key=lambda r: (str(r.source), r.block, r.order_key))]
    again = [r.doc_id for r in sorted((r for r in got if r.epoch == 1), key=lambda r: (str(r.source), r.block, r.order_key))]
    assert first != again
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns and mixed.count() == len(got)


def test_mixing_to_a_budget_of_tokens(docs):
    sized = docs.select("source", mixing.tokens(F.col("text")).alias("n_tokens"))
    total = sized.agg(F.sum("n_tokens")).first()[0]
    got = mixing.draw(docs, None, 3.0, total // 2).agg(F.sum("n_tokens")).first()[0]
    assert abs(got - total // 2) < 10_000  # half a document for each block, the longest has 9 000 words


def test_exponent_meets_its_targets(spark):
    by = spark.createDataFrame([(i, p) for i, p in enumerate([0.7, 0.2, 0.06, 0.04])], "source long, p double")

    def entropy(a):
        q = np.array([0.7, 0.2, 0.06, 0.04]) ** a
        q /= q.sum()
        return float(-(q * np.log(q)).sum())

    a = mixing.exponent(by, 0.8, None)
    assert entropy(a) == pytest.approx(0.8 * math.log(4), abs=1e-5)
    r = mixing.exponent(by, None, 2.0)
    assert (0.7 / 0.04) ** (1 - r) == pytest.approx(2.0, abs=1e-4)
    assert mixing.exponent(by, None, None) == 0.0 and mixing.exponent(by.limit(0), 0.5, None) == 1.0


def test_sources_beyond_the_broadcast_bound(docs, monkeypatch):
    whole = sorted(map(str, mixing.draw(docs).collect()))
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 0)
    assert sorted(map(str, mixing.draw(docs).collect())) == whole


def test_empty_mixture(empty):
    assert mixing.draw(empty).count() == 0


@pytest.mark.parametrize(("shards", "most_rows"), [(40, 1_000_000), (7, 5)])
def test_shards(docs, rows, shards, most_rows):
    import zlib

    got = sharding.assign(docs, shards, most_rows=most_rows).collect()
    want = sorted(str((r[0], len((r[1] or "").encode()) + 16, zlib.crc32((r[1] or "").encode()))) for r in rows)
    assert sorted(str((r.doc_id, r.size, r.text_crc32)) for r in got) == want
    slots, sizes = defaultdict(list), Counter()
    for r in got:
        assert 0 <= r.shard < shards and r.law == "bytes" and r.grown_shard is None
        slots[r.shard].append(r.slot)
        sizes[r.shard] += r.size
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    biggest, mean = max(r.size for r in got), sum(sizes.values()) / shards
    assert all(abs(sizes[s] - mean) <= biggest for s in range(shards))
    again = sharding.assign(docs.repartition(5), shards, most_rows=most_rows).collect()
    assert sorted(str((r.doc_id, r.size, r.shard)) for r in again) == sorted(str((r.doc_id, r.size, r.shard)) for r in got)


def test_shards_keep_columns(docs, empty):
    out = sharding.shard(docs, 5)
    assert out.columns[:7] == [c for c in docs.columns if c not in ("size", "shard")][:7] and out.count() == docs.count()
    assert sharding.assign(empty).count() == 0 and sharding.shard(empty).count() == 0


def test_equal_texts_are_neighbours(spark):
    docs = spark.createDataFrame([(i, "same" if i % 3 == 0 else f"text {i}") for i in range(300)], "doc_id long, text string")
    got = sharding.assign(docs, 4).collect()
    assert len({r.shard for r in got if r.doc_id % 3 == 0}) <= 3
    sizes = Counter()
    for r in got:
        sizes[r.shard] += r.size
    assert max(sizes.values()) - min(sizes.values()) <= 60


def test_lm_scores(docs, rows, empty):
    got = lmscore.score(docs).collect()
    n = Counter(str((r[0], len(brute.WS.findall(r[1] or "")))) for r in rows)
    assert Counter(str((r.doc_id, r.n_tokens)) for r in got) == n
    for r in got:
        assert r.pll <= 0 and (r.pll_mean is None) == (r.n_tokens == 0)
        if r.n_tokens:
            assert r.pll_mean == pytest.approx(r.pll / r.n_tokens)
    assert lmscore.score(empty).count() == 0


def test_language_model_scores_do_not_depend_on_the_partitioning(docs):
    a, b = (lmscore.score(d, common=40, group_tokens=4000).toPandas() for d in (docs, docs.repartition(7)))
    a, b = (x.fillna({"doc_id": -1}).sort_values(["doc_id", "n_tokens", "pll"]) for x in (a, b))
    assert a.doc_id.tolist() == b.doc_id.tolist() and a.n_tokens.tolist() == b.n_tokens.tolist()
    assert np.allclose(a.pll, b.pll, rtol=1e-6, atol=1e-4)  # texts that share a matrix product differ in the last bits


@pytest.mark.parametrize("common", [40, 1_000_000])
def test_language_model_against_plain_loops(docs, rows, common):
    """The sums of log-probabilities, word by word and digit by digit, and that the probabilities of all words add up to one."""
    encoded, _, totals, w = lmscore.fitted(docs, common, 4000)
    got = {(r.doc_id, r.n_tokens): r.pll for r in lmscore.score(docs, common, 4000).collect()}
    counts = Counter(x.encode() for r in rows for x in brute.WS.findall(r[1] or ""))
    assert encoded.count() == len(rows) and sum(counts.values()) == totals.sum()
    assert all(totals[leaf] == sum(n for x, n in counts.items() if lmscore.leaf_of(x) == leaf) for leaf in map(lmscore.leaf_of, list(counts)[:30]))
    size = Counter(int(math.log2(n) * 8) for n in counts.values())
    least = min((b for b in size if sum(c for x, c in size.items() if x >= b) <= common), default=10**9)
    named = sorted((x for x, n in counts.items() if int(math.log2(n) * 8) >= least), key=lambda x: (-counts[x], x))
    own = {x: i for i, x in enumerate(named[: lmscore.OWN])}
    of = lambda x: own.get(x, lmscore.OWN + lmscore.tail_of(x))

    def digits(words, i):
        """The log-probability of every digit, for given digits above."""
        around = [of(words[i + o]) if 0 <= i + o < len(words) else lmscore.CLASSES for o in lmscore.OFFSETS]
        h = sum(w[0][k][c].astype(float) for k, c in enumerate(around)) + w[1]

        def level(up, n):
            extra = [0, w[3][up] if n == 1 else 0, w[4][up] if n == 2 else 0, w[5][up >> 4] + w[6][up & 15] if n == 3 else 0][n]
            below = totals.reshape(16**n, 16, -1)[up].sum(1)
            z = np.tanh(h + extra) @ w[2][n] + np.array([math.log(x / below.sum()) if x else -30.0 for x in below])
            return z - z.max() - math.log(np.exp(z - z.max()).sum())

        return level

    def log_p(words, i, x):
        level, leaf = digits(words, i), lmscore.leaf_of(x)
        return sum(level(leaf >> 4 * (4 - n), n)[leaf >> 4 * (3 - n) & 15] for n in range(4)) + math.log(counts[x] / totals[leaf])

    some = [r for r in rows if r[0] is not None and 0 < len(brute.WS.findall(r[1] or "")) < 70][:12]
    for r in some:
        words = [x.encode() for x in brute.WS.findall(r[1])]
        assert got[r[0], len(words)] == pytest.approx(sum(log_p(words, i, x) for i, x in enumerate(words)), abs=0.01 + 1e-4 * len(words))
    words = [x.encode() for x in brute.WS.findall(some[-1][1])]
    assert sum(math.exp(log_p(words, 0, x)) for x in counts) == pytest.approx(1, abs=1e-3)


def test_threshold_is_the_middle_of_the_widest_best_gap():
    assert quality.best_cut([(-2.0, 0), (-1.0, 0), (0.0, 1), (1.0, 1)]) == -0.5
    assert quality.best_cut([(-2.0, 0), (0.5, 0), (0.0, 1), (0.25, 1)]) == -1.0  # one class wins as much on either side of the middle
    assert quality.best_cut([(0.0, 1), (1.0, 1)]) == quality.best_cut([]) == quality.best_cut([(0.0, 0), (0.0, 1)]) == quality.THRESHOLD


def test_one_bound_does_for_rows_near_and_far():
    rng = np.random.default_rng(2)
    near = rng.normal(size=(50, 16)).astype(np.float32)
    for z in (near, near - 30 * (near > 1), near + np.linspace(-300, 300, 50, dtype=np.float32)[:, None]):
        wide = z.astype(np.float64)
        want = wide - wide.max(1, keepdims=True)
        want -= np.log(np.exp(want).sum(1, keepdims=True))
        left = z.copy()
        e, total = lmscore.powers(left)
        assert np.allclose(left - np.log(total), want, atol=1e-3) and np.allclose(e / total, np.exp(want), atol=1e-4)


def test_a_step_is_one_of_gradients_added_row_by_row():
    rng = np.random.default_rng(3)
    n, bias = 300, lmscore.biases(rng.integers(1, 9, lmscore.LEAVES))
    leaves, classes = rng.integers(0, lmscore.LEAVES, n).astype(np.uint16), rng.integers(0, lmscore.CLASSES, n).astype(np.uint16)
    padded, places, _ = lmscore.laid_out([(leaves, classes)])
    t = lmscore.Trainer(lmscore.start_weights(), bias)
    old = [w.astype(np.float64) for w in t.w]
    t.step(padded, places, leaves)
    some, want, dh = leaves.astype(int), [np.zeros_like(w) for w in old], np.zeros((n, lmscore.DIM))
    h = sum(old[0][k][padded[places + o]] for k, o in enumerate(lmscore.OFFSETS)) + old[1]
    for level, rows in enumerate(lmscore.above(some)):
        a = np.tanh(h + sum(old[k][at] for k, at in rows))
        p = np.exp(a @ old[2][level] + bias[level][some >> 4 * (4 - level)])
        p /= p.sum(1, keepdims=True)
        p[np.arange(n), some >> 4 * (3 - level) & 15] -= 1
        da = (p / n @ old[2][level].T) * (1 - a * a)
        dh += da
        want[2][level] = a.T @ p / n
        for k, at in rows:
            np.add.at(want[k], at, da)
    want[1] = dh.sum(0)
    for k, o in enumerate(lmscore.OFFSETS):
        np.add.at(want[0][k], padded[places + o], dh)
    for w, g, new in zip(old, want, t.w, strict=True):
        assert np.allclose(new, w - lmscore.RATE * g / np.sqrt(1e-4 + g * g), atol=1e-4)


def toy(n=400, seed=1):
    """Texts in which a word is known from its neighbours on both sides."""
    rng = np.random.default_rng(seed)
    out = []
    for _ in range(n):
        t = []
        for _ in range(20):
            a, b = rng.integers(6, size=2)
            t += [f"l{a}", f"m{(a + b) % 6}", f"r{b}"]
        out.append(" ".join(t).encode())
    return out


def vocabulary(texts):
    counts = Counter(x for t in texts for x in t.split())
    totals = np.zeros(lmscore.LEAVES, np.int64)
    for x, n in counts.items():
        totals[lmscore.leaf_of(x)] += n
    return lmscore.Vocabulary(sorted(((x.decode(), n) for x, n in counts.items()), key=lambda x: (-x[1], x[0])), totals)


def coded(texts, v):
    return [v.encode(t)[:2] for t in texts]


def test_training_lowers_the_loss_on_held_out_texts():
    v = vocabulary(toy())
    train, held, bias = coded(toy(), v), coded(toy(50, 9), v), lmscore.biases(v.totals)
    n = sum(len(x) for x, _ in held)
    t = lmscore.Trainer(lmscore.start_weights(), bias)
    before = lmscore.scored(held, t.w, bias).sum() / n
    for i in range(40):
        t.learn(train, i)
    after = lmscore.scored(held, t.w, bias).sum() / n
    assert after > 0.6 * before and after > -math.log(18)


def test_every_window_is_learned_from():
    v = vocabulary(toy(70))
    train = coded(toy(70), v)
    t, met = lmscore.Trainer(lmscore.start_weights(), lmscore.biases(v.totals)), []
    step = t.step
    t.step = lambda padded, drawn, leaves: (met.extend(drawn.tolist()), step(padded, drawn, leaves))
    t.learn(train, 0)
    assert sorted(met) == lmscore.laid_out(train)[1].tolist() and t.seen == len(met) > lmscore.BATCH


def test_gradient_is_the_slope():
    v = vocabulary(toy(20))
    bias = lmscore.biases(v.totals)
    padded, places, leaves = lmscore.laid_out(coded(toy(3), v))
    w = lmscore.start_weights()
    loss = lambda ws: -lmscore.log_leaf(ws, bias, padded, places, leaves).mean()
    t = lmscore.Trainer(w, bias)
    t.step(padded, places, leaves)
    rows = [int(np.abs(t.w[k] - w[k]).sum(-1).argmax()) for k in (3, 4, 5, 6)]
    for k, i in ((0, (1, 2, 3)), (1, (5,)), *((2, (n, 3, 4)) for n in range(4)), *((k, (r, 7)) for k, r in zip((3, 4, 5, 6), rows, strict=True))):
        change = w[k][i] - t.w[k][i]
        step = [x.astype(np.float64) for x in w]
        step[k][i] += 1e-3
        slope = loss(step) - loss([x.astype(np.float64) for x in w])
        assert abs(change) < 1e-6 or abs(slope) < 1e-9 or np.sign(slope) == np.sign(change)


def test_long_texts_are_cut_at_white_space():
    data = b" ".join(b"w%d" % i for i in range(3000))
    parts = list(lmscore.cut(data, 100))
    assert b"".join(parts) == data and [w for p in parts for w in p.split()] == data.split() and len(parts) > 50
    assert list(lmscore.cut(b"x" * 500, 100)) == [b"x" * 500, b""] and list(lmscore.cut(b"")) == [b""]


def test_pipeline_on_the_smallest_tables(spark, sf):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert len(names) == 5
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    seen = {r.doc_id: r.text for r in docs.collect()}
    bench = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs
        docs = stage(spark, docs, sf).checkpoint()
        assert docs.columns == columns
        old, new = Counter(r.doc_id for r in before.collect()), Counter(r.doc_id for r in docs.collect())
        assert set(new) <= set(old)
        if name == "near-duplicates":
            every = [(i, seen[i]) for i in old]
            assert brute.near_left([(i, seen[i]) for i in new]) == 0
            assert all(brute.has_earlier(every, (i, seen[i])) for i in set(old) - set(new))
        if name == "decontamination":
            ids = sorted(old)
            bad = brute.contamination([seen[i] for i in ids], bench)
            assert set(new) == {i for i, x in zip(ids, bad, strict=True) if not x[1]}  # not one word lies in a window of an item
        if name == "mixing":
            assert set(new) == set(old)
    out = corpus_pipeline.STAGES[-1][1](spark, docs, sf)
    assert out.count() == docs.count() and set(columns) < set(out.columns)


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_matches_sql(spark, sf, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "labels"):
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    a, b = queries.queries()[name](spark, sf).toPandas(), con.execute(queries.oracle_sql()[name]).df()
    cols = sorted(a.columns)
    assert cols == sorted(b.columns)
    assert sorted(map(str, a[cols].itertuples(index=False, name=None))) == sorted(map(str, b[cols].itertuples(index=False, name=None)))


def test_every_operator_is_registered():
    numbers = {int(re.match(r"op(\d+)_", n)[1]) for n in queries.queries()}
    assert numbers == set(range(1, 11))
