"""Line and substring removal, near-duplicates: against brute force, on every path."""

import random

import brute
import pytest
from pyspark.sql import functions as F

from graphloom.llm import components, linededup, simhash, substrings


@pytest.mark.parametrize("broadcast", [1_000_000, 0])
def test_lines_against_brute_force(docs, rows, broadcast):
    got = linededup.dedup_lines(docs, 10, 3, 2, broadcast).select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("h")).collect()
    want = [(r[0], *x) for r, x in zip(rows, brute.lines([r[1] for r in rows], 10), strict=True)]
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want)) and sum(w[2] for w in want) > 20


def test_lines_of_an_empty_table(empty):
    assert linededup.dedup_lines(empty, batches=2).count() == 0


def test_runs_count_over_batches_and_settle(spark):
    runs = linededup.LineRuns(spark, 3, 2, 2)
    for batch in ([1, 1, 2], [1, 3], [2, 3], [3, 4], [1, 2]):
        runs.add(spark.createDataFrame([(x, x) for x in batch], "h1 long, h2 long"))
    assert sorted(r.h1 for r in runs.frequent().distinct().collect()) == [1, 2, 3]
    assert [len(x) for x in runs.levels] == [1, 0, 1]


@pytest.mark.parametrize(("length", "group"), [(200, 64), (200, 1), (90, 3)])
def test_substrings_against_brute_force(docs, rows, length, group):
    got = substrings.remove_repeats(docs, length, 3, group).collect()
    want = [(r[0], *x) for r, x in zip(rows, brute.repeats([r[1] for r in rows], length), strict=True)]
    assert sorted(map(str, ((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, brute.sha(bytes(r.kept))) for r in got))) == sorted(map(str, want))


def test_substrings_of_an_empty_table(empty):
    assert substrings.remove_repeats(empty, batches=2).count() == 0


def test_fingerprints_and_components_against_brute_force(docs, rows, empty):
    got = simhash.near_duplicates(docs).collect()
    fps = [brute.fingerprint(r[1]) for r in rows]
    comp = brute.components([r[0] for r in rows], fps, 2)
    want = [(r[0], brute.signed(f), c) for r, f, c in zip(rows, fps, comp, strict=True)]
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    assert len({c for c in comp}) < len(set(fps))  # some texts that differ are linked
    assert simhash.near_duplicates(empty).count() == 0


def test_near_copies_go_and_only_they(docs, rows):
    kept = simhash.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    stay = [(r.doc_id, r.text) for r in kept.collect()]
    assert brute.near_left(stay) == 0 and len(stay) == len(set(stay))
    gone = {(r[0], r[1]) for r in rows} - set(stay)
    assert gone and all(brute.has_earlier([(r[0], r[1]) for r in rows], g) for g in gone)


@pytest.mark.parametrize("radius", [1, 2, 3])
def test_masks_cover_every_pair(radius):
    rng = random.Random(radius)
    for free in ((1 << 64) - 1, rng.getrandbits(64)):
        masks = simhash.covering(free, radius)
        places = [i for i in range(64) if free >> i & 1]
        for _ in range(500):
            d = sum(1 << p for p in rng.sample(places, min(radius, len(places))))
            assert any(not m & d for m in masks)


@pytest.mark.parametrize("bucket", [64, 2])
def test_links_of_crowded_buckets(spark, bucket):
    """Many fingerprints that differ in few places: buckets are covered anew and again, and no link is lost."""
    rng = random.Random(1)
    base = rng.getrandbits(64)
    fps = {base ^ sum(1 << p for p in rng.sample(range(64), rng.randint(0, 4))) for _ in range(150)}
    fps |= {rng.getrandbits(64) for _ in range(20)}
    fps = sorted(fps)
    frame = spark.createDataFrame([(brute.signed(f), i) for i, f in enumerate(fps)], "fp long, id long")
    links = simhash.links(frame, 2, bucket).collect()
    assert all(((r.a ^ r.b) & (1 << 64) - 1).bit_count() <= 2 for r in links)
    roots = {r.node: r.root for r in components.components(simhash.links(frame, 2, bucket), "a", "b").collect()}
    got = [roots.get(brute.signed(f), brute.signed(f)) for f in fps]
    want = brute.components(list(range(len(fps))), fps, 2)
    assert len(set(zip(got, want, strict=True))) == len(set(got)) == len(set(want))


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    assert all(got.get(i, 0) == 0 for i in range(41)) and all(got.get(i, 100) == 100 for i in range(100, 130))
