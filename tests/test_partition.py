"""Whole partitioning runs: invariants, small exact cuts, the Python interface."""

import itertools

import numpy as np
import pytest

from graphloom.api import Partitioner, edge_cut, from_edge_list
from graphloom.graph import Graph
from graphloom.local import bipartition, kway
from graphloom.local.csr import CSR
from graphloom.operators import metrics
from graphloom.plans import schemes
from graphloom.plans.presets import Context, Scheme, TwoHop, preset, presets
from graphloom.sources import generators, tables


def grid(rows, columns):
    ids = np.arange(rows * columns).reshape(rows, columns)
    a = np.concatenate([ids[:, :-1].ravel(), ids[:-1].ravel()])
    b = np.concatenate([ids[:, 1:].ravel(), ids[1:].ravel()])
    return CSR.from_edges(ids.size, np.concatenate([a, b]), np.concatenate([b, a]), np.ones(2 * len(a)), np.ones(ids.size))


def limits(g, k, epsilon=0.03):
    return schemes.Limits(np.full(k, int((1 + epsilon) * -(-g.total // k))), np.zeros(k, np.int64), epsilon)


@pytest.mark.parametrize("name", sorted(presets()))
def test_presets_on_a_grid(name):
    g = grid(20, 20)
    c = preset(name).override("coarsening.contraction_limit", 40)
    lim = limits(g, 4, 0.05)
    p = schemes.partition_local(g, lim, c, 1)
    assert set(p) == {0, 1, 2, 3} and (np.bincount(p, minlength=4) <= lim.upper).all()
    assert g.cut(p) <= 75  # 40 is the best; stripes have 60
    assert (schemes.partition_local(g, lim, c, 1) == p).all()


@pytest.mark.parametrize("scheme", ["deep", "kway", "rb", "vcycle"])
@pytest.mark.parametrize("k", [2, 3, 5, 7, 8])
def test_schemes_and_odd_k(scheme, k):
    g = grid(16, 16)
    lim = limits(g, k)
    p = schemes.partition_local(g, lim, Context(scheme=Scheme(scheme)).override("coarsening.contraction_limit", 30), 0)
    assert len(set(p)) == k and (np.bincount(p, minlength=k) <= lim.upper).all()


def test_bisection_near_the_optimum_of_small_graphs():
    rng = np.random.default_rng(3)
    for _ in range(5):
        n = 10
        pairs = [(a, b) for a, b in itertools.combinations(range(n), 2) if rng.random() < 0.35]
        a, b = map(np.array, zip(*pairs, strict=True))
        g = CSR.from_edges(n, np.concatenate([a, b]), np.concatenate([b, a]), np.ones(2 * len(a)), np.ones(n))
        best = min(g.cut(np.array([i in s for i in range(n)], int)) for s in map(set, itertools.combinations(range(n), 5)))
        assert g.cut(bipartition.bisect(g, (5, 5), 0)) <= best + 1


def test_flow_equals_the_smallest_cut():
    rng = np.random.default_rng(5)
    for _ in range(20):
        n = 7
        w = rng.integers(0, 4, (n, n))
        net = kway.FlowNetwork(n)
        for i in range(n):
            for j in range(n):
                if i != j and w[i, j]:
                    net.edge(i, j, int(w[i, j]))
        best = min(sum(int(w[i, j]) for i in s for j in range(n) if j not in s and i != j) for r in range(n - 1) for t in itertools.combinations(range(2, n), r) for s in [{0, *t}])
        assert net.max_flow(0, 1) == best


def test_flow_refinement_finds_the_narrow_place():
    g = grid(4, 12)
    p = (np.arange(48) % 12 >= 5).astype(np.int64)
    p[[4, 5]] = [1, 0]  # a notch
    q = kway.flow_refine(g, p, np.array([28, 28]))
    assert g.cut(q) == 4 and np.bincount(q, minlength=2).max() <= 28


def test_matchings_hold_every_pair_once():
    pairs = list(itertools.combinations(range(5), 2))
    rounds = kway.matchings(pairs)
    assert sorted(p for r in rounds for p in r) == pairs
    assert all(len({x for p in r for x in p}) == 2 * len(r) for r in rounds)


def test_minimum_weights():
    g = grid(6, 6)
    p = kway.rebalance(g, np.zeros(36, np.int64), np.array([20, 20]), np.array([16, 16]))
    assert sorted(np.bincount(p)) == sorted(np.bincount(p).clip(16, 20))


def test_interface(spark):
    g = generators.geometric(spark, 200, 0.12).checkpointed()
    p = Partitioner(spark).set_graph(g)
    for kwargs in ({"k": 4, "epsilon": 0.03}, {"max_block_weights": [55] * 4}, {"max_block_weight_factors": [0.25] * 4}):
        part = p.compute_partition(**kwargs)
        rows = part.collect()
        assert len(rows) == 200 and {r["block"] for r in rows} <= {0, 1, 2, 3}
        assert p.summary(part).first()["feasible"]
        assert isinstance(edge_cut(g, part), int)
    a = p.reseed(1).compute_partition(k=4, epsilon=0.03)
    assert sorted(a.collect()) == sorted(p.compute_partition(k=4, epsilon=0.03).collect())
    for bad in ({"max_block_weights": [1, 1]}, {"max_block_weight_factors": [0.2] * 4}, {"k": 4, "epsilon": -0.5}):
        with pytest.raises(ValueError):
            p.compute_partition(**bad)


def test_empty_and_edgeless_graphs(spark):
    empty = Graph.from_csr(spark, [0], [])
    assert Partitioner(spark).set_graph(empty).compute_partition(4, 0.03).count() == 0
    lone = Graph.from_csr(spark, [0] * 9, [])
    rows = Partitioner(spark).set_graph(lone).compute_partition(4, 0.03).collect()
    assert len(rows) == 8 and sorted(r["block"] for r in rows) == [0, 0, 1, 1, 2, 2, 3, 3]


def test_edge_list(spark):
    g = from_edge_list(spark, [(0, 1), (1, 2, 5)], 4)
    assert (g.n(), g.m(), g.total_edge_weight()) == (4, 4, 12)


def test_frame_tier_beats_a_hash_partition(spark, sf):
    g = tables.supplier_part(spark, sf).checkpointed()
    c = Context(local_edges=1500).override("coarsening.contraction_limit", 32).override("coarsening.rounds", 2).override("refinement.lp_rounds", 2)
    p = Partitioner(spark, c).set_graph(g)
    part = p.compute_partition(4, 0.03)
    hashed = g.nodes.selectExpr("id", "cast(id % 4 as int) as block")
    assert p.summary(part).first()["feasible"] and edge_cut(g, part) < edge_cut(g, hashed)


def test_extension_of_blocks_side_by_side(spark):
    g = generators.grid(spark, 8, 8).checkpointed()
    halves = g.nodes.selectExpr("id", "cast(id >= 32 as int) as block")
    lim = schemes.Limits(np.full(5, 14), np.zeros(5, np.int64), 0.05)
    out = schemes.extend_partition(g, halves, 2, lim, Context())
    w = {r["block"]: r["weight"] for r in metrics.block_weights(g, out, 5).collect()}
    assert out.count() == 64 and set(w) == set(range(5)) and all(x > 0 for x in w.values())
    first = {r["block"] for r in out.filter("id < 32").collect()}
    assert first == {0, 1, 2}


def test_warm_partition_follows_a_stream(spark, tmp_path):
    from graphloom.streaming.warm import WarmPartition

    g = generators.grid(spark, 4, 4).checkpointed()
    w = WarmPartition(g, g.nodes.selectExpr("id", "cast(id >= 8 as int) as block"), 2, 0.2)
    spark.createDataFrame([(15, 16), (16, 17), (0, 17)], "src long, dst long").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("src long, dst long").parquet(str(tmp_path / "in"))
    w.follow(stream, str(tmp_path / "check")).awaitTermination()
    assert w.graph.n() == 18 and w.partition.count() == 18


def test_cli(tmp_path, spark, capsys):
    from graphloom import cli

    f = tmp_path / "g.metis"
    f.write_text("4 4\n2 4\n1 3\n2 4\n1 3\n")
    assert cli.main([str(f), "2", "-o", str(tmp_path / "p"), "--validate"]) == 0
    assert "edge_cut=2" in capsys.readouterr().out
    assert cli.main([str(f), "--tool", "components"]) == 0
    assert "'components': 1" in capsys.readouterr().out
    assert cli.main([str(f), "2", "--dump-config", "--set", "coarsening.rounds=3"]) == 0
    assert "rounds=3" in capsys.readouterr().out


def test_a_warm_partition_goes_on_after_a_restart(spark, tmp_path):
    from graphloom.streaming.warm import WarmPartition

    g = generators.grid(spark, 4, 4).checkpointed()
    part = g.nodes.selectExpr("id", "cast(id >= 8 as int) as block")
    batch = lambda *e: spark.createDataFrame(list(e), "src long, dst long")
    w = WarmPartition(g, part, 2, 0.5, str(tmp_path / "state"))
    w.update(batch((0, 16), (16, 17)), 0)
    w.update(batch((17, 18)), 1)
    again = WarmPartition(g, part, 2, 0.5, str(tmp_path / "state"))
    assert again.last == 1 and again.graph.n() == 19 and again.partition.count() == 19
    again.update(batch((17, 18)), 1)  # delivered twice: passed over
    assert again.graph.m() == w.graph.m()
    again.update(batch((18, 5)), 2)
    again.update(batch((5, 6)), 3)
    assert again.graph.m() == w.graph.m() + 2 and len(list((tmp_path / "state").glob("batch-*"))) == 2


def test_presets_differ():
    by = {}
    for name, context in presets().items():
        by.setdefault(context, []).append(name)
    assert [names for names in by.values() if len(names) > 1] == []


def test_deep_scheme_splits_blocks_on_frames_and_survives_a_stall(spark):
    g = generators.grid(spark, 24, 24).checkpointed()
    for context in (
        Context(local_edges=700).override("coarsening.contraction_limit", 40),
        Context(local_edges=100).override("coarsening.contraction_limit", 40).override("coarsening.rounds", 0).override("coarsening.two_hop", TwoHop.OFF),  # nothing is coarsened
    ):
        part = Partitioner(spark, context).set_graph(g).compute_partition(4, 0.1)
        p = metrics.partition_properties(g, part).first()
        assert p.complete and p.used == 4 and p.heaviest <= 1.1 * 144 and p.edge_cut < metrics.edge_cut(g, g.nodes.selectExpr("id", "cast(id % 4 as int) as block")).first()[0]


def test_levels_get_small_where_clustering_stalls(spark):
    """So that the first partition comes from bisection at any size, not from ranges of ids."""
    g = generators.grid(spark, 24, 24).checkpointed()
    c = Context(local_edges=100).override("coarsening.contraction_limit", 40).override("coarsening.rounds", 0).override("coarsening.two_hop", TwoHop.OFF)
    halves = g.nodes.selectExpr("id", "id % 2 as community")
    levels = schemes.coarsen_frame(g, c, 4, 0.1, 0, halves)
    coarsest, _, communities = levels[-1]
    assert coarsest.m() <= 400 and coarsest.nodes.groupBy().sum("weight").first()[0] == 576 and coarsest.max_node_weight() <= 576 // 4
    for (fine, _, above), (_, mapping, below) in itertools.pairwise(levels):
        assert mapping.count() == fine.n()
        both = mapping.join(above, "id").join(below.selectExpr("id as coarse_id", "community as c"), "coarse_id")
        assert both.filter("community <> c").isEmpty()


def test_builders(spark, tmp_path):
    from graphloom.sources.builder import GraphBuilder, callbacks_of, from_callbacks

    b = GraphBuilder(spark, str(tmp_path / "g"), batch=4)
    for to, w in (([1, 2], [5, 6]), ([0], [5]), ([0], [6]), ([], None)):
        b.add_node(to, w, weight=len(to) + 1)
    g = b.build()
    assert sorted(map(tuple, g.edges.collect())) == [(0, 1, 5), (0, 2, 6), (1, 0, 5), (2, 0, 6)]
    assert sorted(map(tuple, g.nodes.collect())) == [(0, 3), (1, 2), (2, 2), (3, 1)]
    with pytest.raises(ValueError):
        b.add_node([1], [1, 2])
    assert GraphBuilder(spark, str(tmp_path / "none")).build().n() == 0
    rows = {r.id: (r.neighbors, r.weights) for r in callbacks_of(g.edges).collect()}
    h = from_callbacks(spark, 4, lambda u: rows.get(u, ([], None)), lambda u: u + 1)
    assert sorted(map(tuple, h.edges.collect())) == sorted(map(tuple, g.edges.collect())) and h.total_node_weight() == 10


def test_isolated_nodes_fit_whole(spark):
    from graphloom.operators import transforms

    nodes = spark.createDataFrame([(i, w) for i, w in enumerate([7, 5, 5, 300, 1, 1, 9])], "id long, weight long")
    state = spark.createDataFrame([(0, 0, 10), (1, 0, 12), (2, 0, 1000)], "block int, weight long, max_weight long")
    got = transforms.assign_isolated(nodes, state.select("block", "weight"), state.select("block", "max_weight"))
    load = {r.block: r.w for r in got.join(nodes, "id").groupBy("block").sum("weight").toDF("block", "w").collect()}
    assert got.count() == 7 and load[0] <= 10 and load[1] <= 12
    assert transforms.assign_isolated(nodes.limit(0), state.select("block", "weight"), state.select("block", "max_weight")).count() == 0


def test_a_program_adds_its_own_clusterer_and_refiner(spark, monkeypatch):
    g, seen = generators.grid(spark, 10, 10).checkpointed(), []
    pairs = lambda context, seed: lambda g, w, communities: g.nodes.selectExpr("id", "id div 2 * 2 as cluster")
    monkeypatch.setitem(schemes.CLUSTERERS, "pairs", pairs)
    monkeypatch.setitem(schemes.REFINERS, "watch", lambda level, part: seen.append((level.k, level.fine)) or part)
    c = Context(local_edges=200).override("coarsening.clusterer", "pairs").override("coarsening.contraction_limit", 20).override("refinement.algorithms", ("watch",))
    part = schemes.partition_graph(g, schemes.Limits(np.full(4, 30), np.zeros(4, np.int64), 0.2), c)
    assert part.count() == 100 and seen[-1] == (4, True) and part.select("block").distinct().count() == 4


@pytest.mark.parametrize("rule", sorted(bipartition.SIDES))
@pytest.mark.parametrize("adaptive", [False, True])
def test_two_way_search_under_every_rule(rule, adaptive):
    g, rng = grid(14, 14), np.random.default_rng(2)
    start = (rng.permutation(g.n) < g.n // 2).astype(np.int64)
    part = bipartition.two_way_search(g, start, (105, 105), rule=rule, adaptive=adaptive)
    w = np.bincount(part, g.vw, 2)
    assert (w <= 105).all() and g.cut(part) < 0.5 * g.cut(start)
    heavy = bipartition.two_way_search(g, np.zeros(g.n, np.int64), (105, 105), rule=rule, adaptive=adaptive)
    assert (np.bincount(heavy, g.vw, 2) <= 105).all()
