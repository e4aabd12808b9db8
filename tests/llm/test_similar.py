"""Near-duplicates by word shingles against brute force: recall, order, crowded buckets."""

import random

import numpy as np
import pytest

import corpus_pipeline
from graphloom.llm import common, simhash

import brute


def texts(n=60, seed=5, copies=3):
    """Near copies with one to four changed words, over a range of similarities on both sides of 0.8."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    out = []
    for _ in range(n):
        base = [word() for _ in range(120)]
        out.append(" ".join(base))
        for _ in range(copies):
            w = list(base)
            for _ in range(rng.randint(1, 4)):
                w[rng.randrange(len(w))] = word()
            out.append(" ".join(w))
    rng.shuffle(out)
    return out


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, w string").repartition(3)


def judged(rows, kept):
    """How many kept pairs are similar; each other row is similar to an earlier one."""
    stay = [(r.doc_id, r.text) for r in kept]
    every = [(r[0], r[1]) for r in rows]
    assert all(brute.has_earlier(every, g) for g in set(every) - set(stay))
    return brute.near_left(stay)


@pytest.mark.parametrize("pivots", [16, 1])
def test_recall_and_order(spark, pivots):
    rows = [(i, t, "x") for i, t in enumerate(texts())]
    kept = simhash.drop_near_duplicates(frame(spark, rows), pivots=pivots)
    assert kept.columns == ["doc_id", "text", "w"]
    all_ = [brute.shingle_set(t) for _, t, _ in rows]
    want = {i for i, s in enumerate(all_) if any(brute.similar(s, t) for t in all_[:i])}
    got = kept.collect()
    gone = set(range(len(rows))) - {r.doc_id for r in got}
    # of a chain of similar texts the later ones may stay, if what they are similar to goes: no pair of kept texts is similar
    assert judged(rows, got) == 0 and gone <= want and len(gone) >= 0.95 * len(want) > 80


def test_rows_without_id_shared_ids_and_odd_texts(spark):
    a, b, c = (t for t in texts(3, 8, 0))
    near_a = a.rsplit(" ", 1)[0] + " other"
    rows = [(1, a, "x"), (None, near_a, "x"), (7, b, "x"), (7, c, "x"), (None, "", "x"), (3, None, "x"), (4, " \n", "x"), (5, "one two", "x"), (5, "one two", "x"), (9, c, "x")]
    got = sorted(map(str, ((r.doc_id, r.text) for r in simhash.drop_near_duplicates(frame(spark, rows)).collect())))
    assert got == sorted(map(str, [(1, a), (7, b), (7, c), (3, None), (5, "one two")]))
    assert simhash.drop_near_duplicates(frame(spark, rows).limit(0)).count() == 0


def test_a_large_group_of_near_copies(spark):
    rows = [(i, t, "x") for i, t in enumerate(texts(1, 2, 120))]
    assert judged(rows, simhash.drop_near_duplicates(frame(spark, rows)).collect()) == 0


def test_counting_what_a_loop_has_left_takes_few_tasks(spark):
    sc = spark.sparkContext
    sc.setJobGroup("compact", "compact")
    try:
        out, n = common.compact(spark.range(0, 100, 1, 64))
        last = max(sc.statusTracker().getJobIdsForGroup("compact"))
        tasks = [sc.statusTracker().getStageInfo(i).numTasks for i in sc.statusTracker().getJobInfo(last).stageIds]
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    assert n == 100 and out.rdd.getNumPartitions() == 1 and sorted(r.id for r in out.collect()) == list(range(100))
    assert max(tasks) <= sc.defaultParallelism < 64


def test_the_stage_finds_a_copy_with_a_few_changed_words(spark):
    base = texts(1, 3, 0)[0].split()
    rows = [(0, " ".join(base), "x"), (1, " ".join([*base[:40], "changed", *base[41:]]), "x"), (2, "quite another text", "x")]
    assert sorted(r.doc_id for r in corpus_pipeline.near_duplicates(spark, frame(spark, rows), "").collect()) == [0, 2]


def crowd_of(n, seed=11):
    """Texts of one base that differ from it, and nearly all from each other, in too many words to be similar, and near copies of every tenth."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    base = [word() for _ in range(150)]
    out = []
    for i in range(n):
        w = list(base)
        for at in rng.sample(range(3, 147, 6), 5):
            w[at] = word()
        out.append(" ".join(w))
        if not i % 10:
            w[rng.choice((0, 149))] = word()
            out.append(" ".join(w))
    rng.shuffle(out)
    return [" ".join(base), *out]


def test_a_crowd_that_is_not_similar_is_not_compared_in_pairs(spark, monkeypatch):
    rows = [(i, t, "x") for i, t in enumerate(crowd_of(200))]
    compared, similar_pairs = [], simhash.similar_pairs

    def counted(pairs, sets, similarity):
        compared.append(pairs.count())
        return similar_pairs(pairs, sets, similarity)

    monkeypatch.setattr(simhash, "similar_pairs", counted)
    got = simhash.drop_near_duplicates(frame(spark, rows), pivots=1).collect()
    assert judged(rows, got) == 0 and len(got) == 201 and len(rows) == 221
    assert sum(compared) < 15 * len(rows)


@pytest.mark.parametrize("slots", [1 << 17, 4])
def test_similar_sets_of_any_size_share_a_rare_key(spark, slots):
    rng = random.Random(6)
    found = []
    for _ in range(40):
        base = rng.sample(range(1 << 62), rng.randint(1, 60))
        for _ in range(4):
            found.append(np.unique(np.array([x for x in base if rng.random() < 0.95] + rng.sample(base, 1) + rng.sample(range(1 << 62), rng.randint(0, 6)), np.uint64)))
    found += [np.zeros(0, np.uint64), found[0]]
    sets = spark.createDataFrame([(i, x.tobytes()) for i, x in enumerate(found)], "node long, found binary").repartition(3)
    crowd = spark.createDataFrame([(i, i, False) for i in range(len(found))], "node long, least long, met boolean")
    rows, n = simhash.rare_keys(crowd, sets, 0.8, slots)
    a, b = rows.alias("a"), rows.alias("b")
    both = a.join(b, "key").filter("a.node < b.node").filter(simhash.overlapping(simhash.F.col("a.at"), simhash.F.col("b.at"), 0.8))
    got = {(r[0], r[1]) for r in both.select("a.node", "b.node").collect()}
    want = {(i, j) for j, y in enumerate(found) for i, x in enumerate(found[:j]) if simhash.jaccard(x, y) >= 0.8}
    assert rows.count() == n and len(want) > 30 and want <= got
