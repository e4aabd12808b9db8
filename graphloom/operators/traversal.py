"""Connected components and breadth-first search as loops of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.integers import floor_log2_column, scrambled
from ..graph import Graph, dense_ids
from ..session import checkpointed

SALTS = 8


def components(graph: Graph) -> DataFrame:
    """(id, component): the smallest id reachable. Rounds of hooking to the smallest neighbouring label, then a jump to the label's label."""
    labels = checkpointed(graph.nodes.select("id", F.col("id").alias("component")))
    while True:
        near = graph.edges.join(labels.select(F.col("id").alias("dst"), "component"), "dst").groupBy(F.col("src").alias("id")).agg(F.min("component").alias("near"))
        new = labels.join(near, "id", "left").select("id", F.least("component", F.coalesce("near", "component")).alias("component"), F.col("component").alias("old"))
        new = checkpointed(new)
        # only labels that have a further label jump: the giant component's own is none of them, and the others are spread over salts
        jump = new.filter("id <> component").select(F.col("id").alias("component"), F.col("component").alias("further"))
        jump = jump.join(new.select("component").distinct(), "component", "left_semi").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        salted = new.withColumn("salt", (F.col("id") % SALTS).cast("int"))
        new = checkpointed(salted.join(jump, ["component", "salt"], "left").select("id", F.coalesce("further", "component").alias("component"), "old"))
        if new.filter("component <> old").isEmpty():
            return new.select("id", "component")
        labels = new.select("id", "component")


def component_sizes(graph: Graph) -> DataFrame:
    return components(graph).groupBy("component").agg(F.count("*").alias("size"))


def size_histogram(sizes: DataFrame) -> DataFrame:
    """(bucket, components): components by the logarithm of their size."""
    return sizes.groupBy(floor_log2_column(F.col("size")).cast("int").alias("bucket")).agg(F.count("*").alias("components"))


def largest_component(graph: Graph) -> tuple[Graph, DataFrame]:
    """The largest component (ties to the smaller name) with dense ids, and (id, new_id)."""
    labels = checkpointed(components(graph))
    best = labels.groupBy("component").agg(F.count("*").alias("size")).orderBy(F.desc("size"), "component").limit(1)
    inside = labels.join(F.broadcast(best), "component", "left_semi").select("id")
    ids = dense_ids(inside, "id", "new_id")
    new = lambda c: ids.select(F.col("id").alias(c), F.col("new_id").alias(f"new_{c}"))
    nodes = graph.nodes.join(new("id"), "id").select(F.col("new_id").alias("id"), "weight")
    return Graph(nodes, graph.edges.join(new("src"), "src").join(new("dst"), "dst").select(F.col("new_src").alias("src"), F.col("new_dst").alias("dst"), "weight")), ids


def bfs(graph: Graph, seeds: DataFrame, most: int | None = None) -> DataFrame:
    """(id, distance) of the nodes within ``most`` hops of the seeds (all that are reachable, without a bound)."""
    reached = checkpointed(seeds.select("id").distinct().withColumn("distance", F.lit(0)))
    frontier, hop = reached, 0
    while most is None or hop < most:
        hop += 1
        next_ = graph.edges.join(frontier.select(F.col("id").alias("src")), "src").select(F.col("dst").alias("id")).distinct()
        frontier = checkpointed(next_.join(reached, "id", "left_anti").withColumn("distance", F.lit(hop)))
        if frontier.isEmpty():
            break
        reached = checkpointed(reached.unionByName(frontier)) if hop % 4 == 0 else reached.unionByName(frontier)
    return reached


def furthest(graph: Graph, seed: int) -> tuple[int, int]:
    """(node, distance): a node at the largest distance from the seed, the smallest id among them."""
    start = graph.nodes.filter(F.col("id") == seed)
    row = bfs(graph, start).agg(F.max_by("id", F.struct("distance", -F.col("id"))).alias("id"), F.max("distance").alias("d")).first()
    return row["id"], row["d"]


def far_apart_pair(graph: Graph, seed: int, rounds: int = 2) -> tuple[int, int]:
    """Two nodes far from each other: walk to the furthest node, then to the furthest from there, and so on."""
    a, b = seed, seed
    for _ in range(rounds):
        a, b = b, furthest(graph, b)[0]
    return a, b


def ball(graph: Graph, seeds: DataFrame, hops: int, partition: DataFrame | None = None, exterior: str = "exclude", high_degree: int | None = None, strategy: str = "ignore", seed: int = 0) -> Graph:
    """The subgraph around the seeds. exterior: ``exclude`` drops edges that leave it, ``include`` keeps their ends as nodes, ``contract``
    maps the ends to one pseudo-node per block (id -1 - block). Nodes above ``high_degree`` are reached, and what lies behind them follows the
    strategy: ``ignore`` doesn't pass them, ``take`` passes all of their edges, ``cut`` the first ``high_degree`` by target, ``sample`` as
    many by a seeded hash of the target."""
    inner = graph
    if strategy not in ("ignore", "take", "cut", "sample"):
        raise ValueError(f"no strategy {strategy!r}; there are ignore, take, cut, sample")
    if high_degree is not None and strategy in ("cut", "sample"):
        key = [F.col("dst")] if strategy == "cut" else [scrambled(F.col("dst"), seed), F.col("dst")]
        at = F.row_number().over(Window.partitionBy("src").orderBy(*key))  # the planner keeps ``high_degree`` of a node in each task
        inner = Graph(graph.nodes, checkpointed(graph.edges.withColumn("at", at).filter(F.col("at") <= high_degree).drop("at")))
    elif high_degree is not None and strategy == "ignore":
        from .metrics import degrees

        passable = degrees(graph).filter(F.col("degree") <= high_degree).select(F.col("id").alias("src"))
        inner = Graph(graph.nodes, graph.edges.join(passable, "src", "left_semi"))
    inside = checkpointed(bfs(inner, seeds, hops).select("id"))
    src = graph.edges.join(inside.select(F.col("id").alias("src")), "src", "left_semi")
    nodes = graph.nodes.join(inside, "id", "left_semi")
    if exterior == "exclude":
        return Graph(nodes, src.join(inside.select(F.col("id").alias("dst")), "dst", "left_semi").select("src", "dst", "weight"))
    if exterior == "include":
        ends = src.select(F.col("dst").alias("id")).join(inside, "id", "left_anti").distinct()
        out = src.join(ends.select(F.col("id").alias("dst")), "dst", "left_semi").select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight")
        return Graph(nodes.unionByName(graph.nodes.join(ends, "id", "left_semi")), src.unionByName(out))
    mark = inside.withColumn("inside", F.lit(True))
    ends = src.join(mark.select(F.col("id").alias("dst"), "inside"), "dst", "left").join(partition.select(F.col("id").alias("dst"), "block"), "dst")
    to = F.when(F.col("inside"), F.col("dst")).otherwise(-1 - F.col("block"))
    kept = ends.select("src", to.alias("dst"), "weight").groupBy("src", "dst").agg(F.sum("weight").alias("weight"))
    back = kept.filter("dst < 0").select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight")
    outside = graph.nodes.join(inside, "id", "left_anti").join(partition, "id").groupBy((-1 - F.col("block")).cast("long").alias("id")).agg(F.sum("weight").alias("weight"))
    return Graph(nodes.unionByName(outside), kept.unionByName(back))
