"""Refinement and balancing of a partition by supersteps."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.integers import relative_gain, scrambled
from ..graph import Graph
from ..session import checkpointed, small
from . import ranges, supersteps
from .metrics import block_weights, connections, degrees, gains
from .moves import admit, cover
from .select import overlay


def moved(partition: DataFrame, moves: DataFrame) -> DataFrame:
    return overlay(partition, moves.select("id", F.col("to").cast("int").alias("block")))


def rooms(graph: Graph, partition: DataFrame, block_limits: DataFrame, k: int) -> DataFrame:
    """(block, weight, min_weight, max_weight): k rows, computed once."""
    return small(block_weights(graph, partition, k).join(F.broadcast(block_limits), "block"))


def proposals(graph: Graph, partition: DataFrame, state: DataFrame, edges: DataFrame | None = None) -> DataFrame:
    """PICK for blocks: positive gain first, or no loss into a block that is less loaded; targets keep their limit, sources their minimum.

    A target above its limit is allowed if its overload stays below the source's. Ties: less loaded target, then smaller block.
    """
    g = gains(graph.edges if edges is None else edges, partition).join(graph.nodes, "id")
    to = state.select(F.col("block").alias("to"), (F.col("weight") - F.col("max_weight")).alias("to_over"))
    of = state.select(F.col("block").alias("from"), (F.col("weight") - F.col("max_weight")).alias("from_over"), (F.col("weight") - F.col("min_weight")).alias("slack"))
    x = g.join(F.broadcast(to), "to").join(F.broadcast(of), "from")
    fits = (F.col("to_over") + F.col("weight") <= 0) | (F.greatest(F.col("to_over") + F.col("weight"), F.lit(0)) < F.greatest(F.col("from_over"), F.lit(0)))
    better = (F.col("gain") > 0) | ((F.col("gain") == 0) & (F.col("to_over") + F.col("weight") < F.col("from_over")))
    x = x.filter(fits & better & (F.col("slack") >= F.col("weight")))
    best = F.max_by(F.struct("from", "to", "gain", "weight"), F.struct("gain", -F.col("to_over"), -F.col("to"))).alias("b")
    return x.groupBy("id").agg(best).select("id", "b.*")


def table(state: DataFrame, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(weight, min_weight, max_weight) of ``rooms``, by block."""
    rows = {r["block"]: r for r in state.collect()}  # k rows
    return tuple(np.array([rows[b][c] for b in range(k)], np.int64) for c in ("weight", "min_weight", "max_weight"))


def picked(graph: Graph, partition: DataFrame, state: DataFrame, k: int, chunk: tuple[int, int, int] | None = None, changed: DataFrame | None = None, only: DataFrame | None = None) -> DataFrame:
    """``proposals`` as a superstep over packed edges. chunk: (chunk, chunks, seed) of the nodes that may move; changed: (id), only these and their
    neighbours are looked at; only: (id) of the nodes that may move."""
    weight, least, most = table(state, k)
    over, slack = weight - most, weight - least
    rows = partition.join(graph.nodes, "id").select("id", "block", "weight")
    for ids, name in ((changed, "changed"), (only, "only")):
        if ids is not None:
            rows = rows.join(ids.select("id", F.lit(1).alias(name)), "id", "left")
            rows = rows.withColumn(name, F.coalesce(name, F.lit(0)))
    f = picker(over, slack, chunk, changed is not None, only is not None)
    return supersteps.superstep(graph, rows, f, "id long, from int, to int, gain long, weight long")


def picker(over: np.ndarray, slack: np.ndarray, chunk: tuple[int, int, int] | None, near: bool, some: bool) -> Callable[[supersteps.View], dict]:
    """What ``picked`` does in a range. near: only ids that changed and their neighbours; some: only ids marked so."""

    def f(x: supersteps.View) -> dict:
        moving = np.ones(x.width, bool)
        if chunk is not None:
            moving = supersteps.scrambled(x.first + np.arange(x.width), chunk[2]) % chunk[1] == chunk[0]
        if near:
            moving &= (x.own["changed"] == 1) | x.touched(x.far["changed"][x.dst] == 1)
        if some:
            moving &= x.own["only"] == 1
        e = moving[x.src]
        u, to, conn = supersteps.summed(x.src[e], x.far["block"][x.dst[e]], x.weight[e])
        own, w = x.own["block"], x.own["weight"]
        gain = conn - supersteps.own_sums(x.width, u, to, conn, own)[u]
        after, of = over[to] + w[u], over[own[u]]
        fits = (after <= 0) | (np.maximum(after, 0) < np.maximum(of, 0))
        ok = (to != own[u]) & fits & ((gain > 0) | ((gain == 0) & (after < of))) & (slack[own[u]] >= w[u])
        u, to, gain = u[ok], to[ok], gain[ok]
        b = supersteps.firsts(u, -gain, over[to], to)
        u = u[b]
        return {"id": x.first + u, "from": own[u], "to": to[b], "gain": gain[b], "weight": w[u]}

    return f


def lp_refine_round(graph: Graph, partition: DataFrame, block_limits: DataFrame, k: int, chunk: tuple[int, int, int] | None = None, changed: DataFrame | None = None, only: DataFrame | None = None) -> DataFrame:
    """The moves of one superstep: limits of targets and minima of sources hold whatever subset of the others is made."""
    state = rooms(graph, partition, block_limits, k)
    p = picked(graph, partition, state, k, chunk, changed, only)
    room = state.select(F.col("block").alias("to"), F.greatest(F.col("max_weight") - F.col("weight"), F.lit(0)).alias("room"))
    admitted = admit(checkpointed(p), F.broadcast(room))
    if not table(state, k)[1].any():  # a block can always spare its own nodes
        return admitted
    slack = state.select(F.col("block").alias("from"), (F.col("weight") - F.col("min_weight")).alias("room"))
    return admit(checkpointed(admitted), F.broadcast(slack), group="from")


def lp_refine(graph: Graph, partition: DataFrame, block_limits: DataFrame, k: int, rounds: int = 5, chunks: int = 2, seed: int = 0) -> DataFrame:
    """Rounds over the active nodes, chunk by chunk."""
    lower, upper = limit_arrays(block_limits, k)
    return ranges.refined(graph, partition, k, lower, upper, rounds, chunks, seed, picker)


def limit_arrays(block_limits: DataFrame, k: int) -> tuple[np.ndarray, np.ndarray]:
    rows = {r["block"]: r for r in block_limits.collect()}  # k rows
    return tuple(np.array([rows[b][c] for b in range(k)], np.int64) for c in ("min_weight", "max_weight"))


def overload_moves(graph: Graph, partition: DataFrame, block_limits: DataFrame, k: int, seed: int = 0, state: DataFrame | None = None) -> DataFrame:
    """One round of R2: out of each overloaded block the best relative gains that cover the overload, into blocks with room.

    A node without an adjacent block with room goes to a light block chosen by hash. state: the ``rooms``, if they are known.
    """
    state = rooms(graph, partition, block_limits, k) if state is None else state
    need = state.filter("weight > max_weight").select(F.col("block").alias("from"), (F.col("weight") - F.col("max_weight")).alias("need"))
    room = state.select(F.col("block").alias("to"), F.greatest(F.col("max_weight") - F.col("weight"), F.lit(0)).alias("room"))
    weight, _, most = table(state, k)
    rows = partition.join(graph.nodes, "id").select("id", "block", "weight")
    x = checkpointed(supersteps.superstep(graph, rows, leaver(weight, most, seed), "id long, from int, to int, gain double, weight long"))
    chosen = checkpointed(cover(x, F.broadcast(need), group="from", seed=seed))
    return admit(chosen, F.broadcast(room), seed=seed)


def leaver(weight: np.ndarray, most: np.ndarray, seed: int) -> Callable[[supersteps.View], dict]:
    """What ``overload_moves`` does in a range."""
    free = np.maximum(most - weight, 0)
    light = np.flatnonzero(free > 0)

    def f(x: supersteps.View) -> dict:
        own, w = x.own["block"], x.own["weight"]
        out = (own >= 0) & (weight > most)[own]
        e = out[x.src]
        u, to, conn = supersteps.summed(x.src[e], x.far["block"][x.dst[e]], x.weight[e])
        here = supersteps.own_sums(x.width, u, to, conn, own)
        fits = (to != own[u]) & (w[u] <= free[to])
        u, to, conn = u[fits], to[fits], conn[fits]
        b = supersteps.firsts(u, -conn, to)
        best, there = np.full(x.width, -1, np.int64), np.zeros(x.width, np.int64)
        best[u[b]], there[u[b]] = to[b], conn[b]
        ids = x.first + np.arange(x.width)
        if len(light):
            best = np.where(best < 0, light[supersteps.scrambled(ids, seed) % len(light)], best)
        i = np.flatnonzero(out & (best >= 0))
        gain = (there - here)[i]
        return {"id": ids[i], "from": own[i], "to": best[i], "gain": np.where(gain > 0, gain * w[i], gain / w[i]), "weight": w[i]}

    return f


def balance_overload(graph: Graph, partition: DataFrame, block_limits: DataFrame, k: int, rounds: int = 12, seed: int = 0) -> DataFrame:
    """R2: rounds until no block is overloaded or nothing moves."""
    return ranges.balanced(graph, partition, k, limit_arrays(block_limits, k)[1], rounds, seed, leaver)


def underload_moves(graph: Graph, partition: DataFrame, block_limits: DataFrame, k: int) -> DataFrame:
    """One round of R3: the best relative gains into underloaded blocks, as much as they need and their sources can spare."""
    state = rooms(graph, partition, block_limits, k)
    need = state.filter("weight < min_weight").select(F.col("block").alias("to"), (F.col("min_weight") - F.col("weight")).alias("need"), (F.col("max_weight") - F.col("weight")).alias("room"))
    spare = state.select(F.col("block").alias("from"), (F.col("weight") - F.col("min_weight")).alias("slack"))
    g = gains(graph.edges, partition).join(graph.nodes, "id").join(F.broadcast(need), "to").join(F.broadcast(spare), "from").filter("weight <= room and weight <= slack")
    g = g.withColumn("gain", relative_gain(F.col("gain"), F.col("weight")))
    best = F.max_by(F.struct("from", "to", "gain", "weight"), F.struct("gain", -F.col("to"))).alias("b")
    x = checkpointed(g.groupBy("id").agg(best).select("id", "b.*"))
    wanted = checkpointed(cover(x, F.broadcast(need.select("to", "need")), group="to"))
    fit = checkpointed(admit(wanted, F.broadcast(need.select("to", "room"))))
    return admit(fit, F.broadcast(spare.select("from", F.col("slack").alias("room"))), group="from")


def balance_underload(graph: Graph, partition: DataFrame, block_limits: DataFrame, k: int, rounds: int = 12) -> DataFrame:
    for _ in range(rounds):
        if rooms(graph, partition, block_limits, k).filter("weight < min_weight").isEmpty():
            break
        m = checkpointed(underload_moves(graph, partition, block_limits, k))
        if m.isEmpty():
            break
        partition = checkpointed(moved(partition, m))
    return partition


def jet_find(edges: DataFrame, partition: DataFrame, temperature: float, locked: DataFrame | None = None) -> DataFrame:
    """JET candidates (id, from, to, gain): the best other block of a border node if gain > -floor(temperature * connection to its own)."""
    c = connections(edges, partition).join(partition.select("id", F.col("block").alias("from")), "id")
    here = F.coalesce(F.max(F.when(F.col("block") == F.col("from"), F.col("conn"))), F.lit(0)).alias("here")
    there = F.max_by(F.struct("block", "conn", "from"), F.when(F.col("block") != F.col("from"), F.struct("conn", -F.col("block")))).alias("b")
    x = c.groupBy("id").agg(here, there).filter("b.block <> b.from")
    x = x.select("id", F.col("b.from").alias("from"), F.col("b.block").alias("to"), (F.col("b.conn") - F.col("here")).alias("gain"), "here")
    x = x.filter(F.col("gain") > -F.floor(F.lit(temperature) * F.col("here"))).drop("here")
    return x if locked is None else x.join(locked, "id", "left_anti")


def jet_filter(edges: DataFrame, partition: DataFrame, candidates: DataFrame, least: int = 1) -> DataFrame:
    """JET afterburner: a candidate's gain if all better candidates (higher gain, then smaller id) had moved; kept if at least ``least``."""
    e = edges.join(candidates.select(F.col("id").alias("src"), "from", "to", "gain"), "src")
    v = candidates.select(F.col("id").alias("dst"), F.col("to").alias("vto"), F.col("gain").alias("vgain"))
    at = partition.select(F.col("id").alias("dst"), F.col("block").alias("vblock"))
    e = e.join(at, "dst").join(v, "dst", "left")
    first = (F.col("vgain") > F.col("gain")) | ((F.col("vgain") == F.col("gain")) & (F.col("dst") < F.col("src")))
    block = F.when(first, F.col("vto")).otherwise(F.col("vblock"))
    w = F.when(block == F.col("to"), F.col("weight")).when(block == F.col("from"), -F.col("weight")).otherwise(F.lit(0))
    return e.groupBy(F.col("src").alias("id"), "from", "to", "gain").agg(F.sum(w).alias("projected")).filter(F.col("projected") >= least)


def jet_moves(graph: Graph, partition: DataFrame, temperature: float, locked: DataFrame | None = None) -> DataFrame:
    """What ``jet_filter`` keeps of ``jet_find``, as two supersteps over packed edges."""

    def find(x: supersteps.View) -> dict:
        own = x.own["block"]
        u, to, conn = supersteps.summed(x.src, x.far["block"][x.dst], x.weight)
        here = supersteps.own_sums(x.width, u, to, conn, own)
        other = to != own[u]
        u, to, conn = u[other], to[other], conn[other]
        b = supersteps.firsts(u, -conn, to)
        u, to = u[b], to[b]
        gain = conn[b] - here[u]
        ok = gain > -np.floor(temperature * here[u])
        return {"id": x.first + u[ok], "from": own[u[ok]], "to": to[ok], "gain": gain[ok]}

    def keep(x: supersteps.View) -> dict:
        own, to, gain = x.own["block"], x.own["to"], x.own["gain"]
        e = to[x.src] >= 0
        u, v, w = x.src[e], x.dst[e], x.weight[e]
        first = (x.far["to"][v] >= 0) & ((x.far["gain"][v] > gain[u]) | ((x.far["gain"][v] == gain[u]) & (x.ids[v] < x.first + u)))
        block = np.where(first, x.far["to"][v], x.far["block"][v])
        projected = np.zeros(x.width, np.int64)
        np.add.at(projected, u, np.where(block == to[u], w, np.where(block == own[u], -w, 0)))
        i = np.flatnonzero((to >= 0) & (projected >= 1))
        return {"id": x.first + i, "from": own[i], "to": to[i], "gain": gain[i], "projected": projected[i]}

    found = supersteps.superstep(graph, partition.select("id", "block"), find, "id long, from int, to int, gain long")
    if locked is not None:
        found = found.join(locked, "id", "left_anti")
    state = partition.select("id", "block").join(checkpointed(found).select("id", "to", "gain"), "id", "left")
    state = state.select("id", "block", F.coalesce("to", F.lit(-1)).alias("to"), F.coalesce("gain", F.lit(0)).alias("gain"))
    return supersteps.superstep(graph, state, keep, "id long, from int, to int, gain long, projected long")


def jet(graph: Graph, partition: DataFrame, block_limits: DataFrame, k: int, temperatures: tuple[float, ...] = (0.25,), fruitless: int = 12, most: int = 30, seed: int = 0) -> DataFrame:
    """Unconstrained rounds with a lock of one round, rebalanced, the best feasible partition kept."""
    from .metrics import overload

    def rank(p: DataFrame) -> tuple[int, int]:
        row = overload(graph, p, block_limits, k).join(F.broadcast(supersteps.edge_cut(graph, p))).first()
        return row["total_overload"], row["edge_cut"]

    best, best_rank = partition, rank(partition)
    for temperature in temperatures:
        current, locked, idle = best, None, 0
        for r in range(most):
            m = checkpointed(jet_moves(graph, current, temperature, locked))
            if m.isEmpty():
                break
            current = balance_overload(graph, checkpointed(moved(current, m)), block_limits, k, rounds=4, seed=seed + r)
            locked = m.select("id")
            now = rank(current)
            idle = 0 if now[0] < best_rank[0] or (now[0] == best_rank[0] and now[1] < 0.999 * best_rank[1]) else idle + 1
            if now < best_rank:
                best, best_rank = current, now
            if idle >= fruitless:
                break
    return best


def coloring(graph: Graph) -> DataFrame:
    """(id, color): nodes in the order of (binary digits of the degree, most first; hash; id) take the smallest color that no neighbour has.

    A superstep colours all whose neighbours before them have their colors, and inside a range goes on until none is left. Nodes of many
    neighbours first: the longest chain of nodes that wait for one another is short (between sides of different degrees, two), where in the order of the
    hash alone it grows with the degree. Loops don't count.
    """
    rank = F.floor(F.log2(F.greatest("degree", F.lit(1)))).alias("rank")
    colors = checkpointed(degrees(graph).select("id", rank, F.lit(-1).alias("color")))

    def f(x: supersteps.View) -> dict:
        ids = x.first + np.arange(x.width)
        key = ((63 - x.own["rank"]) << 31) | supersteps.scrambled(ids)
        far = ((63 - x.far["rank"]) << 31) | supersteps.scrambled(x.ids)
        there = np.flatnonzero((x.ids >= x.first) & (x.ids < x.first + x.width))
        here = x.ids[there] - x.first
        color, seen = x.own["color"].copy(), x.far["color"].copy()
        start = (color < 0) & (x.own["rank"] >= 0)
        open_ = start.copy()
        src, dst = x.src, x.dst
        while open_.any():
            e = open_[src] & (ids[src] != x.ids[dst])
            src, dst = src[e], dst[e]
            waits = (seen[dst] < 0) & ((far[dst] < key[src]) | ((far[dst] == key[src]) & (x.ids[dst] < ids[src])))
            ready = open_.copy()
            ready[src[waits]] = False
            if not ready.any():
                break
            e = ready[src] & (seen[dst] >= 0)
            u, c, _ = supersteps.summed(src[e], seen[dst[e]], np.ones(int(e.sum()), np.int64))
            first = np.flatnonzero(np.diff(u, prepend=-1))
            place = np.arange(len(u)) - np.repeat(first, np.diff(np.append(first, len(u))))
            color[ready] = 0
            np.add.at(color, u[c == place], 1)  # colors in use are distinct and in order: the smallest free one is how many are in their place
            open_ &= ~ready
            seen[there] = color[here]
        new = np.flatnonzero(start & (color >= 0))
        return {"id": ids[new], "color": color[new]}

    left = graph.n()
    while left:
        new = checkpointed(supersteps.superstep(graph, colors, f, "id long, color int"))
        left -= new.count()
        now = new.withColumnRenamed("color", "new")
        colors = checkpointed(colors.join(now, "id", "left").select("id", "rank", F.coalesce("new", "color").alias("color")))
    return colors.select("id", "color")


def colored_lp_refine(graph: Graph, partition: DataFrame, block_limits: DataFrame, k: int, colors: DataFrame, rounds: int = 3) -> DataFrame:
    """A superstep for each color: no two neighbours move at once, so every admitted gain is the true one."""
    n = colors.agg(F.max("color")).first()[0]
    for _ in range(rounds):
        any_ = False
        for c in range((n if n is not None else -1) + 1):
            m = checkpointed(lp_refine_round(graph, partition, block_limits, k, only=colors.filter(F.col("color") == c).select("id")))
            if not m.isEmpty():
                any_, partition = True, checkpointed(moved(partition, m))
        if not any_:
            break
    return partition


def move_sets(graph: Graph, partition: DataFrame, sources: DataFrame, max_weight: int, rounds: int = 3) -> DataFrame:
    """(id, cluster): label propagation inside the given blocks only."""
    from .clustering import LabelPropagation

    inside = partition.join(F.broadcast(sources.select("block")), "block", "left_semi")
    nodes = graph.nodes.join(inside, "id", "left_semi")
    from .transforms import inner_edges

    edges = inner_edges(Graph(nodes, graph.edges.join(nodes.select(F.col("id").alias("src")), "src", "left_semi")), inside).select("src", "dst", "weight")
    return LabelPropagation(rounds=rounds, two_hop="off", isolated="keep")(Graph(nodes, edges).checkpointed(), max_weight)


def cluster_balance(graph: Graph, partition: DataFrame, block_limits: DataFrame, k: int, rounds: int = 4) -> DataFrame:
    """Move sets of overloaded blocks are contracted to nodes and balanced like nodes; single nodes finish."""
    from .transforms import contract, project_up

    for r in range(rounds):
        over = rooms(graph, partition, block_limits, k).filter("weight > max_weight").select("block", (F.col("weight") - F.col("max_weight")).alias("over"))
        row = over.agg(F.min("over")).first()
        if row[0] is None:
            return partition
        sets = move_sets(graph, partition, over, max(int(row[0]), 1))
        rest = graph.nodes.join(sets, "id", "left_anti").select("id", F.col("id").alias("cluster"))
        coarse, mapping = contract(graph, checkpointed(sets.unionByName(rest)))
        coarse, mapping = coarse.checkpointed(), checkpointed(mapping)
        of = mapping.join(partition, "id").groupBy(F.col("coarse_id").alias("id")).agg(F.min("block").alias("block"))
        m = checkpointed(overload_moves(coarse, of, block_limits, k, r))
        if m.isEmpty():
            break
        partition = checkpointed(project_up(mapping, moved(of, m)))
    return balance_overload(graph, partition, block_limits, k)


def probabilistic(moves: DataFrame, state: DataFrame, seed: int = 0) -> DataFrame:
    """A move goes ahead with probability (share of its target's gain) * residual room / weight, by a seeded hash; overfull targets roll back."""
    total = F.sum("gain").over(Window.partitionBy("to"))
    room = state.select(F.col("block").alias("to"), F.greatest(F.col("max_weight") - F.col("weight"), F.lit(0)).alias("room"))
    p = F.col("gain") / total * F.col("room") / F.col("weight")
    drawn = moves.filter("gain > 0").withColumn("p", p) if "room" in moves.columns else moves.filter("gain > 0").join(F.broadcast(room), "to").withColumn("p", p)
    kept = drawn.filter(scrambled(F.col("id"), seed) < F.col("p") * 2_147_483_647).select(*moves.columns)
    return admit(kept, F.broadcast(room), seed=seed)


def snapshot_better(best: tuple[float, int], now: tuple[float, int]) -> bool:
    """Rank of (L1 imbalance, cut): less imbalance while imbalanced, else no larger cut."""
    return now[0] < best[0] if best[0] > 0 else now[0] == 0 and now[1] <= best[1]


def pair_order(quotient: DataFrame, moves: DataFrame) -> DataFrame:
    """(b1, b2, cut, gain, place): adjacent pairs of blocks, those first whose moves gain most, then those with the larger cut; at most k * k rows."""
    pair = moves.groupBy(F.least("from", "to").alias("b1"), F.greatest("from", "to").alias("b2")).agg(F.sum(F.greatest("gain", F.lit(0))).alias("gain"))
    both = quotient.select("b1", "b2", "cut").join(pair, ["b1", "b2"], "left").withColumn("gain", F.coalesce("gain", F.lit(0)))
    return both.withColumn("place", F.row_number().over(Window.orderBy(F.desc("gain"), F.desc("cut"), "b1", "b2")))
