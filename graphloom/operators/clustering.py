"""Size-constrained clustering: label propagation in chunked supersteps, two-hop and isolated-node clustering, heavy-edge matching.

Every step is deterministic: higher rating wins, then the smaller label. A superstep moves only the nodes of one chunk, since fully
synchronous label propagation oscillates on bipartite graphs.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.integers import scrambled
from ..graph import Graph, dense_ids
from ..session import checkpointed
from . import ranges, supersteps
from .moves import admit

#: Ids whose nodes may be packed in bins with one another where only that they have no better place joins them.
SLOT = 1 << 16


def singletons(graph: Graph) -> DataFrame:
    return graph.nodes.select("id", F.col("id").alias("cluster"))


def cluster_weights(graph: Graph, clusters: DataFrame) -> DataFrame:
    return graph.nodes.join(clusters, "id").groupBy("cluster").agg(F.sum("weight").alias("cluster_weight"))


def ratings(edges: DataFrame, clusters: DataFrame) -> DataFrame:
    """RATE: (id, cluster, rating)."""
    v = clusters.select(F.col("id").alias("dst"), "cluster")
    return edges.join(v, "dst").groupBy(F.col("src").alias("id"), "cluster").agg(F.sum("weight").alias("rating"))


def proposals(graph: Graph, clusters: DataFrame, max_weight: int, edges: DataFrame | None = None) -> DataFrame:
    """PICK: (id, to, gain, weight): the best cluster with room that beats the node's own, ties to the smaller label."""
    r = ratings(graph.edges if edges is None else edges, clusters)
    own = clusters.select("id", F.col("cluster").alias("own")).join(graph.nodes, "id")
    x = r.join(own, "id").join(cluster_weights(graph, clusters), "cluster")
    fits = (F.col("cluster") == F.col("own")) | (F.col("cluster_weight") + F.col("weight") <= max_weight)
    x = x.filter(fits)
    best = F.max_by(F.struct("cluster", "rating", "own", "weight"), F.struct("rating", -F.col("cluster"))).alias("b")
    here = F.coalesce(F.max(F.when(F.col("cluster") == F.col("own"), F.col("rating"))), F.lit(0)).alias("here")
    picked = x.groupBy("id").agg(best, here).filter("b.cluster <> b.own and b.rating > here")
    return picked.select("id", F.col("b.cluster").alias("to"), (F.col("b.rating") - F.col("here")).alias("gain"), F.col("b.weight").alias("weight"))


def move(clusters: DataFrame, moves: DataFrame) -> DataFrame:
    return clusters.join(moves.select("id", F.col("to").alias("new")), "id", "left").select("id", F.coalesce("new", "cluster").alias("cluster"))


def lp_round(graph: Graph, clusters: DataFrame, max_weight: int, edges: DataFrame | None = None, seed: int = 0) -> DataFrame:
    """The moves that one superstep lets through."""
    p = checkpointed(proposals(graph, clusters, max_weight, edges))
    rooms = cluster_weights(graph, clusters).select(F.col("cluster").alias("to"), (F.lit(max_weight) - F.col("cluster_weight")).alias("room"))
    return admit(p, rooms, seed=seed)


def propagation(graph: Graph, clusters: DataFrame, weights: DataFrame, max_weight: int, chunk: tuple[int, int, int] | None = None, communities: DataFrame | None = None, degrees: tuple[int, int] = (1, 1 << 62)) -> DataFrame:
    """``proposals`` as a superstep over packed edges. chunk: (chunk, chunks, seed) of the nodes that may move; degrees: the least and the most that
    they may have; communities: only edges inside one count. weights: ``cluster_weights``."""
    state = clusters.join(graph.nodes, "id").join(weights, "cluster").select("id", "cluster", "cluster_weight", "weight")
    if communities is not None:
        state = state.join(communities.select("id", "community"), "id")
    return supersteps.superstep(graph, state, proposer(max_weight, chunk, communities is not None, degrees), "id long, to long, gain long, weight long")


def proposer(max_weight: int, chunk: tuple[int, int, int] | None, inside: bool, degrees: tuple[int, int]) -> Callable[[supersteps.View], dict]:
    """What ``propagation`` does in a range. inside: only edges inside a community count."""
    least, most = degrees

    def f(x: supersteps.View) -> dict:
        degree = np.bincount(x.src, minlength=x.width)
        moving = (degree >= least) & (degree <= most)
        if chunk is not None:
            moving &= supersteps.scrambled(x.first + np.arange(x.width), chunk[2]) % chunk[1] == chunk[0]
        e = moving[x.src]
        if inside:
            e &= x.own["community"][x.src] == x.far["community"][x.dst]
        src, label, rating = supersteps.summed(x.src[e], x.far["cluster"][x.dst[e]], x.weight[e])
        names, at = np.unique(x.far["cluster"], return_index=True)
        full = x.far["cluster_weight"][at][np.searchsorted(names, label)]
        own, weight = x.own["cluster"], x.own["weight"]
        fits = (label == own[src]) | (full + weight[src] <= max_weight)
        src, label, rating = src[fits], label[fits], rating[fits]
        here = supersteps.own_sums(x.width, src, label, rating, own)
        b = supersteps.firsts(src, -rating, label)
        b = b[(label[b] != own[src[b]]) & (rating[b] > here[src[b]])]
        u = src[b]
        return {"id": x.first + u, "to": label[b], "gain": rating[b] - here[u], "weight": weight[u]}

    return f


def chunk_edges(edges: DataFrame, chunk: int, chunks: int, seed: int) -> DataFrame:
    return edges.filter(scrambled(F.col("src"), seed) % chunks == chunk)


@dataclass(frozen=True)
class LabelPropagation:
    """Rounds of chunked supersteps, then two-hop and isolated-node clustering."""

    rounds: int = 5
    chunks: int = 2
    two_hop: str = "match"  # match, cluster or off
    isolated: str = "match"  # match, cluster or keep
    two_hop_threshold: float = 0.5
    seed: int = 0
    max_degree: int | None = None  # nodes of more neighbours are never moved
    hub_degree: int | None = None  # nodes of more neighbours move in a superstep of their own, after all others

    def __call__(self, graph: Graph, max_weight: int, desired: int = 0, communities: DataFrame | None = None) -> DataFrame:
        edges = graph.edges
        if communities is not None:
            from .select import within_communities

            edges = within_communities(graph, communities)
        every = 1 << 62
        low = every if self.max_degree is None else self.max_degree
        light = low if self.hub_degree is None else min(low, self.hub_degree)
        steps = []
        for r in range(self.rounds):
            parts = [((chunk, self.chunks, self.seed + r), (1, light)) for chunk in range(self.chunks)]
            if self.hub_degree is not None:
                parts.append((None, (self.hub_degree + 1, low)))
            steps.append(parts)
        clusters = ranges.propagated(graph, max_weight, steps, self.seed, proposer, communities, desired)
        n = graph.n()
        left = clusters.select("cluster").distinct().count()
        if self.isolated != "keep":
            clusters = checkpointed(isolated_clusters(graph, clusters, max_weight, self.isolated, communities))
        if self.two_hop != "off" and left > self.two_hop_threshold * n:
            clusters = checkpointed(two_hop_clusters(Graph(graph.nodes, edges), clusters, max_weight, self.two_hop))
        return clusters


def paired(rows: DataFrame, group: str) -> DataFrame:
    """(id, leader): rows of a group, by id, in pairs; an odd one out stays alone.

    All rows are numbered in the order of (group, id); a pair is two neighbours counted from the first of their group. What is first meets its
    group in stretches of 65536 numbers, so that no task sees a large group.
    """
    key = rows.select(F.struct(F.col(group).alias("g"), F.col("id").alias("i")).alias("key"))
    at = dense_ids(key, "key", "at").select(F.col("key.g").alias("g"), F.col("key.i").alias("id"), "at", F.shiftright("at", 16).alias("part"))
    first = at.groupBy("g").agg(F.min("at").alias("first"), F.max("at").alias("last"))
    first = first.select("g", "first", F.explode(F.sequence(F.shiftright("first", 16), F.shiftright("last", 16))).alias("part"))
    pairs = at.join(first, ["g", "part"]).withColumn("pair", F.floor((F.col("at") - F.col("first")) / 2))
    return pairs.select("id", F.min("id").over(Window.partitionBy("g", "pair")).alias("leader"))


def packed(rows: DataFrame, group: str, max_weight: int) -> DataFrame:
    """(id, leader): rows (id, weight) of a group, by id, in bins of half the limit: no bin outgrows the limit if no row outweighs its half."""
    run = Window.partitionBy(group).orderBy("id").rowsBetween(Window.unboundedPreceding, -1)
    half = max(max_weight // 2, 1)
    at = rows.withColumn("bin", F.floor(F.coalesce(F.sum("weight").over(run), F.lit(0)) / half))
    return at.withColumn("leader", F.min("id").over(Window.partitionBy(group, "bin"))).select("id", "leader")


def favored(graph: Graph, clusters: DataFrame, max_weight: int) -> DataFrame:
    """(id, favored, weight) of the nodes that are alone in their cluster, weigh half the limit at most and have edges: the best cluster, room or not."""
    size = clusters.groupBy("cluster").agg(F.count("*").alias("size"))
    alone = clusters.join(size, "cluster").filter("size = 1 and id = cluster").select("id").join(graph.nodes, "id").filter(F.col("weight") * 2 <= max_weight)
    r = ratings(graph.edges.join(alone.select(F.col("id").alias("src")), "src", "left_semi"), clusters).filter("id <> cluster")
    best = r.groupBy("id").agg(F.max_by("cluster", F.struct("rating", -F.col("cluster"))).alias("favored"))
    return alone.join(best, "id")


def two_hop_clusters(graph: Graph, clusters: DataFrame, max_weight: int, mode: str = "match") -> DataFrame:
    """Nodes that favour the same full cluster are merged: in pairs, or in bins."""
    f = favored(graph, clusters, max_weight)
    if mode == "match":
        pairs = paired(f, "favored")
    else:  # a hub's many suitors lie in many slots
        pairs = packed(f.withColumn("slot", F.struct("favored", F.floor(F.col("id") / SLOT).alias("part"))), "slot", max_weight)
    return move(clusters, pairs.filter("id <> leader").select("id", F.col("leader").alias("to")))


def isolated_clusters(graph: Graph, clusters: DataFrame, max_weight: int, mode: str = "match", communities: DataFrame | None = None, slot_width: int = SLOT) -> DataFrame:
    """Nodes without edges are merged: in pairs, or in bins inside ranges of ``slot_width`` ids; either way no task sees all of them."""
    alone = graph.nodes.join(graph.edges.select(F.col("src").alias("id")), "id", "left_anti").filter(F.col("weight") * 2 <= max_weight)
    if communities is None:
        alone = alone.withColumn("community", F.lit(0))
    else:
        alone = alone.join(communities, "id")
    if mode == "match":
        pairs = paired(alone, "community")
    else:
        pairs = packed(alone.withColumn("slot", F.struct("community", F.floor(F.col("id") / slot_width).alias("part"))), "slot", max_weight)
    return move(clusters, pairs.filter("id <> leader").select("id", F.col("leader").alias("to")))


def hem_proposals(graph: Graph, free: DataFrame | None = None, max_weight: int | None = None) -> DataFrame:
    """(id, to, weight): the heaviest edge of each free node to a free node, ties to the smaller neighbour."""
    e = graph.edges
    if free is not None:
        e = e.join(free.select(F.col("id").alias("src")), "src", "left_semi").join(free.select(F.col("id").alias("dst")), "dst", "left_semi")
    if max_weight is not None:
        w = lambda c: graph.nodes.select(F.col("id").alias(c), F.col("weight").alias(f"w_{c}"))
        e = e.join(w("src"), "src").join(w("dst"), "dst").filter(F.col("w_src") + F.col("w_dst") <= max_weight)
    best = F.max_by(F.struct("dst", "weight"), F.struct("weight", -F.col("dst"))).alias("b")
    return e.groupBy(F.col("src").alias("id")).agg(best).select("id", F.col("b.dst").alias("to"), F.col("b.weight").alias("weight"))


def matching(graph: Graph, free: DataFrame, max_weight: int) -> DataFrame:
    """``hem_proposals`` as a superstep over packed edges. free: (id)."""

    def f(x: supersteps.View) -> dict:
        u, v = x.own["weight"][x.src], x.far["weight"][x.dst]
        e = np.flatnonzero((u >= 0) & (v >= 0) & (u + v <= max_weight))
        b = e[supersteps.firsts(x.src[e], -x.weight[e], x.dst[e])]
        return {"id": x.first + x.src[b], "to": x.ids[x.dst[b]], "weight": x.weight[b]}

    return supersteps.superstep(graph, graph.nodes.join(free, "id").select("id", "weight"), f, "id long, to long, weight long")


def hem(graph: Graph, max_weight: int, rounds: int = 8) -> DataFrame:
    """Heavy-edge matching: mutual proposals match at once; else the heaviest request to a target that wants another wins (ties: smaller id)."""
    free = checkpointed(graph.nodes.select("id"))
    clusters = singletons(graph)
    matched = None
    for _ in range(rounds):
        p = checkpointed(matching(graph, free, max_weight))
        back = p.select(F.col("id").alias("to"), F.col("to").alias("id"))
        mutual = p.join(back, ["id", "to"], "left_semi").filter("id < to").select("id", "to")
        taken = mutual.select("id").unionByName(mutual.select(F.col("to").alias("id")))
        rest = p.join(taken, "id", "left_anti").join(taken.select(F.col("id").alias("to")), "to", "left_anti")
        asked = rest.groupBy("to").agg(F.max_by("id", F.struct("weight", -F.col("id"))).alias("id"))
        askers = asked.select(F.col("id").alias("to"))
        asked = asked.join(askers, "to", "left_anti").select("id", "to")  # a target that itself was granted doesn't accept
        new = checkpointed(mutual.unionByName(asked))
        if new.isEmpty():
            break
        matched = new if matched is None else checkpointed(matched.unionByName(new))
        used = new.select("id").unionByName(new.select(F.col("to").alias("id")))
        free = checkpointed(free.join(used, "id", "left_anti"))
    return clusters if matched is None else move(clusters, matched)


def hem_or_lp(graph: Graph, max_weight: int, fallback: LabelPropagation | None = None) -> DataFrame:
    """Matching, or label propagation if matching shrinks the graph by less than a tenth."""
    clusters = checkpointed(hem(graph, max_weight))
    if clusters.select("cluster").distinct().count() > 0.9 * graph.n():
        return (fallback or LabelPropagation())(graph, max_weight)
    return clusters


def overlaid(graph: Graph, max_weight: int, levels: int = 1, base: LabelPropagation | None = None) -> DataFrame:
    """2**levels clusterings of different seeds, intersected."""
    from dataclasses import replace

    from .transforms import overlay_clusters

    lp = base or LabelPropagation()
    out = None
    for i in range(1 << levels):
        c = replace(lp, seed=lp.seed + 101 * i)(graph, max_weight)
        out = c if out is None else checkpointed(overlay_clusters(out, c))
    return out
