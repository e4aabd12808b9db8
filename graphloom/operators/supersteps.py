"""Supersteps over packed edges: the edges of a range of ids stay in one row, only the labels of their far ends travel.

A graph is packed once: ranges of ids of about ``PART_EDGES`` edges, each a row of numpy bytes, held where they are hashed to. A superstep sends
every range the state of the nodes that its edges end in, once per range and node, and a numpy function makes rows from both. Sums are of
integers, so results are those of the joins that the functions replace.
"""

from __future__ import annotations

import weakref
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.integers import PRIME
from ..graph import Graph
from ..session import checkpointed

#: Edges of a packed range, on the average, and the most ids in it.
PART_EDGES, MOST_IDS = 500_000, 1 << 17

PACKED = "part long, at long, src binary, dst binary, weight binary, far binary"


def narrow(a: np.ndarray) -> bytes:
    """The bytes of integers, four for each if all fit."""
    fits = not len(a) or (a.min() >= -(1 << 31) and a.max() < 1 << 31)
    return (b"4" + a.astype("<i4").tobytes()) if fits else (b"8" + a.astype("<i8").tobytes())


def wide(b: bytes) -> np.ndarray:
    return np.frombuffer(b, "<i4" if b[:1] == b"4" else "<i8", offset=1).astype(np.int64)


@dataclass(eq=False)
class Packed:
    width: int
    edges: DataFrame
    routes: DataFrame


def packed(graph: Graph) -> Packed:
    """The packed edges of a graph, made at its first superstep; they go when the graph goes."""
    if "packed" in graph.facts:
        return graph.facts["packed"]
    n, m = max(graph.n(), 1), max(graph.m(), 1)
    width = int(min(max(PART_EDGES * n // m, 16), MOST_IDS))

    def pack(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        part = int(key[0])
        src, dst, weight = (rows[c].to_numpy() for c in ("src", "dst", "weight"))
        by = np.lexsort((dst, src))
        src, dst, weight = src[by] - part * width, dst[by], weight[by]
        far, at = np.unique(dst, return_inverse=True)
        first = np.flatnonzero(np.diff(far // width, prepend=far[0] // width - 1))
        routes = [(part, int(far[a] // width), None, None, None, narrow(far[a:b] % width)) for a, b in zip(first, [*first[1:], len(far)], strict=True)]
        return pd.DataFrame([(part, -1, narrow(src), narrow(at), narrow(weight), narrow(far)), *routes], columns=["part", "at", "src", "dst", "weight", "far"])

    spark = graph.nodes.sparkSession
    rows = checkpointed(graph.edges.select(F.floor(F.col("src") / width).alias("part"), "src", "dst", "weight").groupBy("part").applyInPandas(pack, PACKED))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    edges = rows.filter("at < 0").select("part", "src", "dst", "weight", "far").repartition(parts, "part").persist(StorageLevel.MEMORY_AND_DISK)
    routes = rows.filter("at >= 0").select("part", "at", "far").repartition(parts, "at").persist(StorageLevel.MEMORY_AND_DISK)
    for df in (edges, routes):  # only what is held already is known to lie where it is hashed to
        df.count()
    p = Packed(width, edges, routes)
    weakref.finalize(p, released, edges, routes).atexit = False
    graph.facts["packed"] = p
    return p


def released(*held: DataFrame) -> None:
    for df in held:
        if df.sparkSession.sparkContext._jsc is not None:
            df.unpersist()


@dataclass
class View:
    """What a superstep sees of a range: edges as (src, dst) indices and weights by (src, dst), the state of its ids and that of the far ends.

    ``own[c][src]`` and ``far[c][dst]`` are a column's values at both ends, -1 where the state has no row; ``ids`` are the far ends' ids.
    """

    first: int
    width: int
    src: np.ndarray
    dst: np.ndarray
    weight: np.ndarray
    ids: np.ndarray
    own: dict[str, np.ndarray]
    far: dict[str, np.ndarray]

    def touched(self, edges: np.ndarray) -> np.ndarray:
        """Which ids of the range have one of the edges."""
        out = np.zeros(self.width, bool)
        out[self.src[edges]] = True
        return out


def superstep(graph: Graph, state: DataFrame, f: Callable[[View], dict], schema: str) -> DataFrame:
    """The rows that f makes of every range. state: (id, integer columns), at most a row for each node; f gives a dict of arrays."""
    p = packed(graph)
    width, columns = p.width, [c for c in state.columns if c != "id"]

    def send(key: tuple, rows: pd.DataFrame, routes: pd.DataFrame) -> pd.DataFrame:
        at = int(key[0])
        values = np.full((len(columns), width), -1, np.int64)
        values[:, rows["id"].to_numpy() - at * width] = rows[columns].to_numpy().T
        out = [(at, -1, [narrow(v) for v in values])]
        for part, far in zip(routes["part"], routes["far"], strict=True):
            i = wide(far)
            out.append((int(part), at, [narrow(v[i]) for v in values]))
        return pd.DataFrame(out, columns=["part", "at", "values"])

    def run(key: tuple, edges: pd.DataFrame, sent: pd.DataFrame) -> pd.DataFrame:
        part, none = int(key[0]), np.zeros(0, np.int64)
        sent = sent.sort_values("at")
        src, dst, weight, ids = (wide(edges[c].iloc[0]) for c in ("src", "dst", "weight", "far")) if len(edges) else (none,) * 4
        own = {c: np.full(width, -1, np.int64) for c in columns}
        far: dict[str, list] = {c: [none] for c in columns}
        for at, values in zip(sent["at"], sent["values"], strict=True):
            for c, v in zip(columns, values, strict=True):
                if at < 0:
                    own[c] = wide(v)
                else:
                    far[c].append(wide(v))
        return pd.DataFrame(f(View(part * width, width, src, dst, weight, ids, own, {c: np.concatenate(v) for c, v in far.items()})))

    at = state.select(F.floor(F.col("id") / width).alias("at"), "id", *(F.col(c).cast("long") for c in columns))
    sent = at.groupBy("at").cogroup(p.routes.groupBy("at")).applyInPandas(send, "part long, at long, values array<binary>")
    return p.edges.groupBy("part").cogroup(sent.groupBy("part")).applyInPandas(run, schema)


# ---------------------------------------------------------------------- numpy steps


def scrambled(ids: np.ndarray, seed: int = 0) -> np.ndarray:
    return ((ids % PRIME) * 48_271 + (seed * 16_807 + 12_345)) % PRIME


def summed(src: np.ndarray, label: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(src, label, sum of weight) of each pair that occurs, in order."""
    if not len(src):
        return src, label, weight
    by = np.lexsort((label, src)) if label.min() < 0 or label.max() >= 1 << 44 else np.argsort((src << 44) | label)
    src, label = src[by], label[by]
    new = np.flatnonzero((np.diff(src, prepend=-1) != 0) | (np.diff(label, prepend=label[0]) != 0))
    return src[new], label[new], np.add.reduceat(weight[by], new)


def firsts(src: np.ndarray, *order: np.ndarray) -> np.ndarray:
    """The row of each src that comes first by the given keys, ascending, the most important first."""
    if not len(src):
        return np.zeros(0, np.int64)
    by = np.lexsort((*order[::-1], src))
    return by[np.flatnonzero(np.diff(src[by], prepend=-1))]


def own_sums(width: int, src: np.ndarray, label: np.ndarray, total: np.ndarray, own: np.ndarray) -> np.ndarray:
    """The sum of each id of the range to its own label, 0 if there is none."""
    here = np.zeros(width, np.int64)
    mine = label == own[src]
    here[src[mine]] = total[mine]
    return here


def cut_weight(x: View) -> dict:
    apart = x.own["block"][x.src] != x.far["block"][x.dst]
    return {"cut": np.array([x.weight[apart].sum()], np.int64)}


def edge_cut(graph: Graph, partition: DataFrame) -> DataFrame:
    """edge_cut, as ``metrics.edge_cut``."""
    return superstep(graph, partition.select("id", "block"), cut_weight, "cut long").agg(F.floor(F.coalesce(F.sum("cut"), F.lit(0)) / 2).cast("long").alias("edge_cut"))


def contracted_edges(graph: Graph, mapping: DataFrame) -> DataFrame:
    """(src, dst, weight) between the coarse nodes of a mapping (id, coarse_id), summed in every range before they travel."""

    def f(x: View) -> dict:
        u, v = x.own["coarse_id"][x.src], x.far["coarse_id"][x.dst]
        apart = u != v
        by = np.lexsort((v[apart], u[apart]))
        u, v, w = u[apart][by], v[apart][by], x.weight[apart][by]
        new = np.flatnonzero((np.diff(u, prepend=-1) != 0) | (np.diff(v, prepend=-1) != 0))
        return {"src": u[new], "dst": v[new], "weight": np.add.reduceat(w, new) if len(new) else w}

    return superstep(graph, mapping.select("id", "coarse_id"), f, "src long, dst long, weight long").groupBy("src", "dst").agg(F.sum("weight").alias("weight"))
