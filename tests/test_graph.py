"""Small graphs with known values."""

import inspect

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom.functions import codecs
from graphloom.functions import integers as I  # noqa: N812
from graphloom.functions import sub_blocks as S  # noqa: N812
from graphloom.graph import Graph
from graphloom.operators import clustering, metrics, moves, refinement, select, transforms, traversal
from graphloom.sources import files, generators, tables


def part(spark, blocks):
    return spark.createDataFrame(list(enumerate(blocks)), "id long, block int")


@pytest.fixture(scope="module")
def star(spark):
    return Graph.from_csr(spark, [0, 4, 5, 6, 7, 8], [1, 2, 3, 4, 0, 0, 0, 0], [4, 1, 1, 1, 1], [3] * 8)


@pytest.mark.parametrize(("blocks", "cut", "imbalance"), [([0, 1, 1, 1, 1], 12, 0.0), ([1, 1, 1, 1, 1], 0, None), ([0, 0, 0, 1, 1], 6, 0.5), ([0, 1, 2, 3, 4], 12, None)])
def test_weighted_star(spark, star, blocks, cut, imbalance):
    p = part(spark, blocks)
    assert metrics.edge_cut(star, p).first()[0] == cut
    if imbalance is not None:
        assert metrics.balance(star, p, 2).first()["imbalance"] == pytest.approx(imbalance)


def test_feasibility_of_isolated_nodes(spark):
    g = Graph.from_csr(spark, [0] * 5, [], [200, 100, 100, 100])
    lim = metrics.limits(spark, 4, 500, max_weights=[S.relaxed_limit(125, 0.0, 200)] * 4)
    assert metrics.overload(g, part(spark, [0, 1, 2, 3]), lim, 4).first()["feasible"]
    assert not metrics.overload(g, part(spark, [0, 0, 0, 1]), lim, 4).first()["feasible"]


def test_generators(spark):
    assert (generators.grid(spark, 3, 4).n(), generators.grid(spark, 3, 4).m()) == (12, 2 * 17)
    assert generators.path(spark, 5).m() == 8
    assert generators.complete_bipartite(spark, 3, 4).m() == 24
    assert generators.star(spark, 4).m() == 8
    assert generators.complete(spark, 5).m() == 20
    assert generators.matching(spark, 3).m() == 6
    g = generators.geometric(spark, 60, 0.2)
    assert select.invalid(g).isEmpty() and g.m() > 0
    assert select.invalid(generators.recursive_matrix(spark, 5, 60)).isEmpty()


@pytest.mark.parametrize(("clusters", "n", "m", "weight"), [([0, 0, 0, 0], 1, 0, 0), ([0, 1, 1, 1], 2, 2, 4)])
def test_contract_grid(spark, clusters, n, m, weight):
    g = generators.grid(spark, 2, 2)
    c = spark.createDataFrame(list(enumerate(clusters)), "id long, cluster long")
    coarse, mapping = transforms.contract(g, c)
    assert (coarse.n(), coarse.m(), coarse.total_edge_weight(), coarse.total_node_weight()) == (n, m, weight, 4)
    assert mapping.count() == 4


def test_contract_columns(spark):
    g = generators.grid(spark, 2, 4)
    w = spark.createDataFrame(list(enumerate([1, 2, 3, 4, 10, 20, 30, 40])), "id long, weight long")
    coarse, _ = transforms.contract(Graph(w, g.edges), g.nodes.select("id", (F.col("id") % 4).alias("cluster")))
    assert (coarse.n(), coarse.m(), coarse.total_edge_weight()) == (4, 6, 12)
    assert sorted(r["weight"] for r in coarse.nodes.collect()) == [11, 22, 33, 44]


def test_degree_permutation(spark):
    g = Graph.from_csr(spark, [0, 2, 3, 7, 8, 10, 10], [1, 2, 0, 0, 3, 4, 4, 2, 2, 2])
    new = {r["old_id"]: r["new_id"] for r in transforms.by_degree(g).collect()}
    assert new[2] == 4 and new[5] == 5 and {new[1], new[3]} == {0, 1} and {new[0], new[4]} == {2, 3}


def test_isolated_nodes_are_taken_away(spark):
    g = Graph.from_csr(spark, [0, 0, 1, 3, 4, 5, 5, 5, 7, 8, 8, 8, 8], [2, 1, 3, 2, 7, 4, 8, 7])
    live, ids, alone = transforms.without_isolated(g)
    assert (live.n(), live.m(), alone.count(), ids.count()) == (6, 8, 6, 6)


def test_sub_blocks():
    assert [S.final_k(b, 2, 11) for b in range(2)] == [6, 5]
    assert [S.final_k(b, 4, 11) for b in range(4)] == [3, 3, 3, 2]
    assert [S.final_k(b, 8, 11) for b in range(8)] == [2, 1, 2, 1, 2, 1, 1, 1]

    def halves(k, level):
        return [k] if level == 0 else halves((k + 1) // 2, level - 1) + halves(k // 2, level - 1)

    for k in range(1, 600):
        level = 0
        while 1 << level < k:
            assert [S.final_k(b, 1 << level, k) for b in range(1 << level)] == halves(k, level)
            level += 1


def test_limits(spark):
    assert S.uniform_limit(10, 4, 0.03) == 3
    rows = metrics.limits(spark, 2, 10, max_factors=[0.7, 0.3], min_factors=[0.5, 0.1]).orderBy("block").collect()
    assert [tuple(r) for r in rows] == [(0, 5, 7), (1, 1, 3)]
    for bad in ({"epsilon": 0.1, "max_weights": [5, 5]}, {}, {"max_weights": [1, 1]}, {"epsilon": 0.0, "min_weights": [9, 9]}):
        with pytest.raises(ValueError):
            metrics.limits(spark, 2, 10, **bad)


def test_integers():
    assert [I.floor_log2(x) for x in (1, 2, 3, 4, 9)] == [0, 1, 1, 2, 3]
    assert [I.ceil_log2(x) for x in (1, 2, 3, 4, 9)] == [0, 1, 2, 2, 4]
    assert (I.floor2(9), I.ceil2(9), I.is_power_of_2(8), I.is_power_of_2(0)) == (8, 16, True, False)
    for n, size in ((10, 3), (7, 7), (3, 5)):
        ranges = [I.local_range(n, size, r) for r in range(size)]
        assert ranges[0][0] == 0 and ranges[-1][1] == n and all(a[1] == b[0] for a, b in zip(ranges, ranges[1:], strict=False))
        assert all(ranges[I.local_range_rank(n, size, e)][0] <= e < ranges[I.local_range_rank(n, size, e)][1] for e in range(n))
        assert sorted(I.round_robin(e, size, n) for e in range(n)) == list(range(n))
    assert I.grid_decode(I.grid_encode(2, 3, 5), 5) == (2, 3)


def test_codecs():
    for node, far in ((5, [1, 2, 900]), (0, []), (7, [8]), (1000, [0, 1, 2, 3, 10**9])):
        assert codecs.decode(node, codecs.encode(node, far)) == far
    assert [codecs.unzigzag(codecs.zigzag(x)) for x in (-3, -1, 0, 1, 5)] == [-3, -1, 0, 1, 5]


def test_components_and_bfs(spark):
    g = generators.matching(spark, 4)
    assert {r["id"]: r["component"] for r in traversal.components(g).collect()} == {i: i // 2 * 2 for i in range(8)}
    p = generators.path(spark, 6)
    assert {r["id"]: r["distance"] for r in traversal.bfs(p, p.nodes.filter("id = 0")).collect()} == {i: i for i in range(6)}
    assert sorted(traversal.far_apart_pair(p, 2)) == [0, 5]
    lone = Graph.from_csr(spark, [0, 0, 1, 2], [2, 1])
    assert traversal.largest_component(lone)[0].n() == 2


def test_balls(spark):
    g = generators.path(spark, 6)
    seeds, blocks = g.nodes.filter("id = 0"), part(spark, [0, 0, 0, 1, 1, 1])
    assert (traversal.ball(g, seeds, 2).n(), traversal.ball(g, seeds, 2).m()) == (3, 4)
    assert traversal.ball(g, seeds, 2, exterior="include").n() == 4
    c = traversal.ball(g, seeds, 2, blocks, "contract")
    assert {r["id"]: r["weight"] for r in c.nodes.collect()} == {0: 1, 1: 1, 2: 1, -2: 3} and c.m() == 6


def test_admit_and_cover_match_a_loop(spark):
    rng = np.random.default_rng(1)
    rows = [(i, int(rng.integers(3)), int(rng.integers(3)), int(rng.integers(-3, 4)), int(rng.integers(1, 5))) for i in range(200)]
    m = spark.createDataFrame(rows, "id long, `from` int, `to` int, gain long, weight long")
    hashed = lambda i: (i % I.PRIME * 48271 + 12345) % I.PRIME % moves.BUCKETS
    order = sorted(rows, key=lambda r: (-r[3], hashed(r[0]), r[0]))
    took, covered = set(), set()
    for t in range(3):
        run = 0
        for r in (r for r in order if r[2] == t):
            run += r[4]
            if run <= 30:
                took.add(r[0])
        run = 0
        for r in (r for r in order if r[1] == t):
            if run < 25:
                covered.add(r[0])
            run += r[4]
    rooms = spark.createDataFrame([(i, 30) for i in range(3)], "`to` int, room long")
    needs = spark.createDataFrame([(i, 25) for i in range(3)], "`from` int, need long")
    assert {r["id"] for r in moves.admit(m, rooms).collect()} == took
    assert {r["id"] for r in moves.cover(m, needs).collect()} == covered


def test_clusterings_hold_their_limits(spark):
    g = generators.grid(spark, 6, 6).checkpointed()
    for c in (clustering.LabelPropagation(rounds=2)(g, 4), clustering.hem(g, 2, 3)):
        assert c.count() == 36
        assert clustering.cluster_weights(g, c).agg(F.max("cluster_weight")).first()[0] <= 4
        coarse, _ = transforms.contract(g, c)
        assert coarse.n() < 36 and select.invalid(coarse).isEmpty() and coarse.total_node_weight() == 36


def test_coloring_is_proper(spark):
    g = generators.grid(spark, 5, 5).checkpointed()
    c = refinement.coloring(g)
    assert c.count() == 25
    assert metrics.with_blocks(g.edges, c, "color").filter("bu = bv").isEmpty()


def test_coloring_leaves_no_node_open(spark):
    """A clique takes a round for each node; there is no bound on rounds, and a loop doesn't stop a node."""
    assert list(inspect.signature(refinement.coloring).parameters) == ["graph"]
    nodes = spark.range(4).select("id", F.lit(1).cast("long").alias("weight"))
    edges = spark.createDataFrame([(i, j, 1) for i in range(4) for j in range(4) if i != j or i == 0], "src long, dst long, weight long")
    assert sorted(r.color for r in refinement.coloring(Graph(nodes, edges)).collect()) == [0, 1, 2, 3]


def test_refiners_keep_feasibility_and_lower_the_cut(spark):
    g = generators.grid(spark, 8, 8).checkpointed()
    p = g.nodes.select("id", (F.col("id") % 2).cast("int").alias("block")).checkpoint()
    lim = metrics.limits(spark, 2, 64, epsilon=0.1)
    before = metrics.edge_cut(g, p).first()[0]
    for q in (refinement.lp_refine(g, p, lim, 2, rounds=2), refinement.jet(g, p, lim, 2, most=2)):
        row = metrics.summary(g, q, lim, 2).first()
        assert row["feasible"] and row["edge_cut"] <= before and q.count() == 64


def test_balancers(spark):
    g = generators.grid(spark, 6, 6).checkpointed()
    skewed = g.nodes.select("id", F.when(F.col("id") < 30, F.lit(0)).otherwise(F.lit(1)).cast("int").alias("block")).checkpoint()
    lim = metrics.limits(spark, 2, 36, epsilon=0.05)
    assert metrics.summary(g, refinement.balance_overload(g, skewed, lim, 2), lim, 2).first()["feasible"]
    low = metrics.limits(spark, 2, 36, max_weights=[36, 36], min_weights=[10, 10])
    assert metrics.summary(g, refinement.balance_underload(g, skewed, low, 2), low, 2).first()["min_feasible"]


RGG = """16 24 11
1 2 1 9 21 16 16
2 1 1 3 2 10 22
3 2 2 4 3 11 23
4 3 3 5 4 12 24
5 4 4 6 5 13 25
6 5 5 7 6 14 26
7 6 6 8 7 15 27
8 7 7 9 8 16 28
9 8 8 10 9 1 21
10 9 9 11 10 2 22
11 10 10 12 11 3 23
12 11 11 13 12 4 24
13 12 12 14 13 5 25
14 13 13 15 14 6 26
15 14 14 16 15 7 27
16 15 15 1 16 8 28
"""


def test_metis_files(spark, tmp_path):
    f = tmp_path / "g.metis"
    f.write_text("% a comment\n" + RGG)
    g = files.read_metis(spark, str(f))
    assert (g.n(), g.m(), g.total_node_weight(), g.total_edge_weight()) == (16, 48, 136, 664)
    assert select.invalid(g).isEmpty()
    files.write_metis(g, str(tmp_path / "out"))
    again = files.read_metis(spark, str(tmp_path / "out"))
    assert sorted(map(tuple, again.edges.select("src", "dst", "weight").collect())) == sorted(map(tuple, g.edges.select("src", "dst", "weight").collect()))
    f.write_text("2 5\n2\n1\n")
    with pytest.raises(ValueError):
        files.read_metis(spark, str(f))
    with pytest.raises(ValueError):
        files.read_graph(spark, str(f), "nonsense")


def test_binary_and_columnar_files(spark, tmp_path):
    f = tmp_path / "g.metis"
    f.write_text(RGG)
    g = files.read_metis(spark, str(f)).checkpointed()
    edges = sorted(map(tuple, g.edges.select("src", "dst", "weight").collect()))
    files.write_parhip(g, str(tmp_path / "g.parhip"))
    for by in ("nodes", "edges", "bytes"):
        h = files.read_parhip(spark, str(tmp_path / "g.parhip"), 3, by)
        assert sorted(map(tuple, h.edges.select("src", "dst", "weight").collect())) == edges and h.total_node_weight() == 136
    files.write_columnar(g, str(tmp_path / "g.col"))
    assert files.read_graph(spark, str(tmp_path / "g.col"), "columnar").m() == 48


def test_partition_files(spark, tmp_path):
    p = part(spark, [0, 0, 1, 2, 2, 2])
    files.write_partition(p, str(tmp_path / "p"))
    assert [r["block"] for r in files.read_partition(spark, str(tmp_path / "p")).orderBy("id").collect()] == [0, 0, 1, 2, 2, 2]
    files.write_block_sizes(p, 4, str(tmp_path / "s"))
    q = files.read_block_sizes(spark, str(tmp_path / "s"), p.select("id"))
    assert [r["block"] for r in q.orderBy("id").collect()] == [0, 0, 1, 2, 2, 2]


def test_lines_are_numbered_in_file_order_whatever_the_sizes(spark, tmp_path):
    lines, at = [], 0
    for i, count in enumerate((3, 4000, 50, 700)):
        mine = [f"{at + j}" for j in range(count)]
        (tmp_path / f"part-{i:05d}.txt").write_text("\n".join(mine) + "\n")
        lines, at = lines + mine, at + count
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in (old, "5000", "40000"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            got = files.numbered_lines(spark, str(tmp_path)).orderBy("line").collect()
            assert [(r["line"], r["value"]) for r in got] == list(enumerate(lines))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_pairs_run_over_all_ids_of_a_group(spark):
    ids = [1, 5, 65_534, 65_535, 65_536, 70_000, 200_000]
    nodes = spark.createDataFrame([(i, 1) for i in ids], "id long, weight long")
    g = Graph(nodes, spark.createDataFrame([], "src long, dst long, weight long"))
    got = {r["id"]: r["cluster"] for r in clustering.isolated_clusters(g, clustering.singletons(g), 2).collect()}
    assert got == {1: 1, 5: 1, 65_534: 65_534, 65_535: 65_534, 65_536: 65_536, 70_000: 65_536, 200_000: 200_000}
    communities = spark.createDataFrame([(i, int(i > 5 and i != 70_000)) for i in ids], "id long, community long")
    got = {r["id"]: r["cluster"] for r in clustering.isolated_clusters(g, clustering.singletons(g), 2, communities=communities).collect()}
    assert got == {1: 1, 5: 1, 70_000: 70_000, 65_534: 65_534, 65_535: 65_534, 65_536: 65_536, 200_000: 65_536}
    many = spark.range(70_001).select("id", F.lit(7).alias("g")).unionByName(spark.createDataFrame([(100_000, 8), (100_001, 8)], "id long, g int"))
    pairs = clustering.paired(many, "g")
    assert pairs.filter("leader <> case when g_id < 70001 then g_id - g_id % 2 else 100000 end".replace("g_id", "id")).isEmpty() and pairs.count() == 70_003


def test_compressed_rows_and_binary_form_never_reach_the_driver(spark, tmp_path, monkeypatch):
    n = 3000
    pairs = {(0, i) for i in range(1, n - 5, 2)} | {(i, (i * 7) % (n - 5)) for i in range(n - 5)}
    half = sorted({(min(p), max(p)) for p in pairs if p[0] != p[1]})
    both = sorted([(a, b, 1 + (a + b) % 5) for a, b in half] + [(b, a, 1 + (a + b) % 5) for a, b in half])
    nodes = [(i, 1 + i % 3) for i in range(n)]  # the last five have no edge
    g = Graph(spark.createDataFrame(nodes, "id long, weight long"), spark.createDataFrame(both, "src long, dst long, weight long")).checkpointed()
    xadj, adjncy, vw, ew = g.to_csr()
    files_path = tmp_path / "g.parhip"

    def never(self):
        raise AssertionError("the whole graph in the driver")

    monkeypatch.setattr(Graph, "to_csr", never)
    monkeypatch.setattr(files, "STEP", 1000)
    for parts in (1, 5):
        back = Graph.from_ranks(g.to_ranks(parts, 100))
        assert sorted(map(tuple, back.edges.collect())) == both and sorted(map(tuple, back.nodes.collect())) == nodes
    for graph, v, e in ((g, vw, ew), (g.unweighted(), None, None), (g.unweighted(nodes=False), vw, None)):
        files.write_parhip(graph, str(files_path))
        assert files_path.read_bytes() == files.parhip_bytes(xadj, adjncy, v, e)
        for by in ("nodes", "edges", "bytes"):
            h = files.read_parhip(spark, str(files_path), by=by)
            assert sorted(map(tuple, h.edges.collect())) == [(a, b, w if e is not None else 1) for a, b, w in both]
            assert sorted(map(tuple, h.nodes.collect())) == (nodes if v is not None else [(i, 1) for i in range(n)])


def test_pairs_are_counted_where_they_are_shuffled_to(spark, sf):
    """What a reading task holds must not depend on the rows of a file's row group."""
    plan = tables.supplier_part(spark, sf).edges._jdf.queryExecution().executedPlan().toString().splitlines()
    counts = [i for i, line in enumerate(plan) if "partial_count" in line]
    assert counts
    for i in counts:
        below = next(line for line in plan[i + 1 :] if "Exchange" in line or "FileScan" in line)
        assert "Exchange hashpartitioning" in below


def test_shuffles_are_sized_by_the_input(spark, sf, monkeypatch):
    from graphloom import session
    from graphloom.sources import tables

    names = ("spark.sql.shuffle.partitions", "spark.sql.adaptive.advisoryPartitionSizeInBytes", "spark.sql.files.maxPartitionBytes")
    old = [spark.conf.get(x) for x in names]
    try:
        for x, value in zip(names, ("4", "64MB", "128MB"), strict=True):
            spark.conf.set(x, value)
        monkeypatch.setattr(session, "INPUT_BYTES", 10_000)
        tables.table(spark, sf, "lineitem")
        wide = int(spark.conf.get(names[0]))
        assert wide >= 11  # 116 347 bytes
        assert [int(spark.conf.get(x)) for x in names[1:]] == [session.MERGED_BYTES, session.READ_BYTES]
        tables.table(spark, sf, "supplier")
        assert int(spark.conf.get(names[0])) == wide  # never coarser
    finally:
        for x, value in zip(names, old, strict=True):
            spark.conf.set(x, value)


def test_keys_are_numbered_without_counting_edges(spark, tmp_path):
    from graphloom.sources import tables

    lines = [(1, 10), (1, 10), (1, 20), (2, 30), (3, 20), (3, 10), (3, None), (4, None), (4, 50), (None, 60), (5, 40), (5, 10)]
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long").write.parquet(str(tmp_path / "lineitem.parquet"))
    g = tables.copurchase(spark, str(tmp_path))
    assert sorted(map(tuple, g.edges.collect())) == [(0, 1, 2), (0, 2, 1), (1, 0, 2), (2, 0, 1)] and g.n() == 3  # parts 10, 20, 40
    b = tables.bipartite(spark.createDataFrame([(1, 1), (1, 1), (3, 1)], "a long, b long"), "a", "b")
    assert sorted(map(tuple, b.edges.collect())) == [(0, 2, 2), (1, 2, 1), (2, 0, 2), (2, 1, 1)] and b.n() == 3


def test_best_of_carries_each_edge_once(spark, star):
    parts = [part(spark, b) for b in ([0, 1, 1, 1, 1], [1, 1, 1, 1, 1], [0, 0, 0, 1, 1], [0, 1, 2, 3, 4])]
    assert tuple(metrics.best_of(star, parts, 8).first()) == (1, 0, 8) and tuple(metrics.best_of(star, parts, 6).first()) == (2, 6, 6)
    out = metrics.best_of(star, parts, 4)
    assert tuple(out.first())[1:] == (12, 4)  # two are as good
    joins = [line for line in out._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join" in line]
    assert not [line for line in joins if "dst#" in line and "rep#" in line]  # edges meet labels by node alone


@pytest.fixture
def small_ranges(monkeypatch):
    """Packed ranges of few edges, so that a small graph has many."""
    from graphloom.operators import supersteps

    monkeypatch.setattr(supersteps, "PART_EDGES", 700)


def tuples(df):
    return sorted(map(tuple, df.collect()))


def test_supersteps_are_the_joins(spark, sf, small_ranges):
    from graphloom.operators import clustering, refinement, supersteps
    from graphloom.sources import tables

    g = tables.supplier_part(spark, sf).checkpointed()
    g = Graph(g.nodes.select("id", (1 + F.col("id") % 3).alias("weight")), g.edges)
    c = g.nodes.select("id", (F.floor(F.col("id") / 5) * 5).cast("long").alias("cluster"))
    odd = clustering.chunk_edges(g.edges, 1, 2, 3)
    assert tuples(clustering.propagation(g, c, clustering.cluster_weights(g, c), 18, (1, 2, 3))) == tuples(clustering.proposals(g, c, 18, odd)) != []
    free = g.nodes.filter("id % 3 <> 0").select("id")
    assert tuples(clustering.matching(g, free, 4)) == tuples(clustering.hem_proposals(g, free, 4)) != []
    p = g.nodes.select("id", F.when(F.col("id") % 3 == 0, F.col("id") % 4).otherwise(F.col("id") % 2).cast("int").alias("block"))
    lim = spark.createDataFrame([(b, 10, g.total_node_weight() // 4 + 3 * b) for b in range(4)], "block int, min_weight long, max_weight long")
    state = refinement.rooms(g, p, lim, 4)
    joins = refinement.proposals(g, p, state, odd).select("id", "from", "to", "gain", "weight")
    assert tuples(refinement.picked(g, p, state, 4, (1, 2, 3))) == tuples(joins) != []
    assert tuples(refinement.jet_moves(g, p, 0.5)) == tuples(refinement.jet_filter(g.edges, p, refinement.jet_find(g.edges, p, 0.5))) != []
    assert tuples(supersteps.edge_cut(g, p)) == tuples(metrics.edge_cut(g, p))
    coarse = g.nodes.select("id", (F.col("id") % 50).alias("coarse_id"))
    joins = metrics.with_blocks(g.edges, coarse, "coarse_id").filter("bu <> bv").groupBy("bu", "bv").agg(F.sum("weight"))
    assert tuples(supersteps.contracted_edges(g, coarse)) == tuples(joins)
    assert len({r["part"] for r in supersteps.packed(g).edges.select("part").collect()}) > 2


def test_packed_edges_stay_where_they_are(spark, sf, small_ranges):
    """Only states travel: no exchange lies between the packed edges and the superstep."""
    from graphloom.operators import supersteps
    from graphloom.sources import tables

    g = tables.supplier_part(spark, sf).checkpointed()
    step = supersteps.superstep(g, g.nodes.select("id", F.lit(0).alias("block")), supersteps.cut_weight, "cut long")
    plan = step._jdf.queryExecution().executedPlan().toString()
    edges = plan[: plan.index("InMemoryTableScan")]
    assert "Exchange" not in edges


def test_coloring_takes_few_supersteps(spark, sf, small_ranges, monkeypatch):
    """Waiting for one another in the order of a hash, 210 nodes took dozens of rounds; sides of different degrees take few."""
    from graphloom.operators import refinement, supersteps
    from graphloom.sources import tables

    g = tables.supplier_part(spark, sf).checkpointed()
    steps, step = [], supersteps.superstep
    monkeypatch.setattr(supersteps, "superstep", lambda *a: steps.append(1) or step(*a))
    c = refinement.coloring(g).checkpoint()
    assert len(steps) <= 3 and c.count() == 210
    assert metrics.with_blocks(g.edges, c, "color").filter("bu = bv").count() == 0


def test_copurchase_counts_orders_and_meets_no_null(spark, tmp_path):
    lines = [(1, 10), (1, 20), (1, 20), (2, 20), (2, 10), (3, 30), (4, 20), (4, 40), (4, 10), (None, 50), (None, 60), (5, None), (5, 40)]
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long").write.parquet(str(tmp_path / "lineitem.parquet"))
    g = tables.copurchase(spark, str(tmp_path))
    assert sorted(r.id for r in g.nodes.collect()) == [0, 1, 2]  # 10, 20, 40: parts of orders without a key are no pair
    assert sorted(map(tuple, g.edges.collect())) == [(0, 1, 3), (0, 2, 1), (1, 0, 3), (1, 2, 1), (2, 0, 1), (2, 1, 1)]
    assert g.edges.groupBy("src").count()._jdf.queryExecution().executedPlan().toString().count("hashpartitioning(src") == 1


@pytest.mark.parametrize(("few", "bins"), [(20_000, 4096), (3, 4)])
def test_packed_loops_give_what_single_supersteps_give(spark, sf, monkeypatch, few, bins):
    from graphloom.operators import ranges, supersteps
    from graphloom.session import checkpointed

    monkeypatch.setattr(supersteps, "PART_EDGES", 2000)
    monkeypatch.setattr(ranges, "FEW", few)
    monkeypatch.setattr(ranges, "BINS", bins)
    g = tables.supplier_part(spark, sf).checkpointed()
    rows, tracker = (lambda df: sorted(map(tuple, df.collect()))), spark.sparkContext.statusTracker()

    def counted(name, f):
        spark.sparkContext.setJobGroup(f"{name}-{few}", name)
        out = rows(f())
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        return out, len(tracker.getJobIdsForGroup(f"{name}-{few}"))

    def clustered():
        c = clustering.singletons(g)
        for chunk in range(2):
            w = clustering.cluster_weights(g, c)
            m = checkpointed(clustering.propagation(g, c, w, 13, (chunk, 2, 0)))
            c = checkpointed(clustering.move(c, moves.admit(m, w.selectExpr("cluster as to", "13 - cluster_weight as room"))))
        return c

    old, many = counted("single", clustered)
    new, fewer = counted("packed", lambda: clustering.LabelPropagation(rounds=1, two_hop="off", isolated="keep")(g, 13))
    assert new == old and 0 < 2 * fewer < many

    lim = metrics.limits(spark, 4, g.total_node_weight(), epsilon=0.1, min_epsilon=0.08)
    skewed = checkpointed(g.nodes.selectExpr("id", "cast(if(id % 3 = 0, id % 4, 0) as int) as block"))
    once = refinement.moved(skewed, checkpointed(refinement.overload_moves(g, skewed, lim, 4, 5)))
    assert rows(refinement.balance_overload(g, skewed, lim, 4, rounds=1, seed=5)) == rows(once)
    even = checkpointed(g.nodes.selectExpr("id", "cast(id % 4 as int) as block"))
    once = refinement.moved(even, checkpointed(refinement.lp_refine_round(g, even, lim, 4, (0, 1, 3))))
    assert rows(refinement.lp_refine(g, even, lim, 4, rounds=1, chunks=1, seed=3)) == rows(once)
