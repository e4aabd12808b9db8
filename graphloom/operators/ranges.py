"""Loops of supersteps whose state stays packed: a range of ids is one row of arrays from the first superstep to the last.

Labels, weights and messages are numpy arrays keyed by range, and so is what is admitted: no row for each node is made before the loop ends.
Every shuffle goes by range to the same places, so a superstep of refinement moves labels only, and one of clustering is a single job. Results are
those of the joins in ``clustering`` and ``refinement``, to which the functions on a ``View`` belong.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark import RDD, StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..graph import Graph
from ..session import checkpointed
from .supersteps import View, narrow, packed, scrambled, wide

#: Supersteps after which the state is written, so that the plan of a long loop stays short.
WRITTEN_EVERY = 5
#: Rows of a group that are collected once no more are left where its limit falls, and bins of a pass that narrows them down.
FEW, BINS = 20_000, 4096
#: Different gains of a range up to which it names them instead of bins.
NAMED = 256


def place(part: int) -> int:
    return part


def by_range(width: int, ids: np.ndarray, *columns: np.ndarray) -> Iterator[tuple[int, list[np.ndarray]]]:
    """The rows of each range that occurs in ids."""
    if not len(ids):
        return
    at = ids // width
    by = np.argsort(at, kind="stable")
    first = np.flatnonzero(np.diff(at[by], prepend=-1))
    for a, b in zip(first, [*first[1:], len(by)], strict=True):
        yield int(at[by[a]]), [c[by[a:b]] for c in (ids, *columns)]


def prefix(group: np.ndarray, order: tuple[np.ndarray, ...], weight: np.ndarray, room: np.ndarray) -> np.ndarray:
    """Rows whose running weight in their group, by the order, stays within the room of the row's group."""
    by = np.lexsort((*order[::-1], group))
    upto, g = np.cumsum(weight[by]), group[by]
    first = np.flatnonzero(np.diff(g, prepend=-1))
    before = np.repeat(upto[first] - weight[by][first], np.diff(np.append(first, len(g))))
    return by[upto - before <= room[by]]


def descending(gain: np.ndarray) -> np.ndarray:
    """Integers in the falling order of gain; those of doubles by their bits."""
    if gain.dtype.kind == "f":
        bits = (gain + 0.0).view(np.int64)
        gain = np.where(bits < 0, np.int64(-(1 << 63)) - bits, bits)
    return -gain


class Ranges:
    """The packed edges of a graph where its ranges lie."""

    def __init__(self, graph: Graph):
        p = packed(graph)
        self.graph, self.spark, self.width = graph, graph.nodes.sparkSession, p.width
        count = -(-max(graph.n(), 1) // p.width)
        self.parts = min(count, max(int(self.spark.conf.get("spark.sql.shuffle.partitions")), self.spark.sparkContext.defaultParallelism))
        self.edges = self.placed(p.edges.rdd.map(lambda r: (r["part"], ("edges", r["src"], r["dst"], r["weight"], r["far"])))).persist(StorageLevel.MEMORY_AND_DISK)
        self.routes = self.placed(p.routes.rdd.map(lambda r: (r["at"], ("route", r["part"], r["far"])))).persist(StorageLevel.MEMORY_AND_DISK)
        self.held: list[RDD] = []
        self.steps = 0

    def placed(self, rows: RDD) -> RDD:
        return rows.partitionBy(self.parts, place)

    def together(self, f: Callable[[Iterable], Iterable], *rows: RDD, stays: bool = True) -> RDD:
        """f over the rows of the same places, in the order of the given sets. stays: what f gives belongs where it is made."""
        every = self.spark.sparkContext.union(list(rows))
        assert every.getNumPartitions() == self.parts
        return every.mapPartitions(f, preservesPartitioning=stays)

    def keep(self, rows: RDD) -> RDD:
        self.held.append(rows.persist(StorageLevel.MEMORY_AND_DISK))
        return rows

    def settled(self, state: RDD, f: Callable[[tuple], object]) -> list:
        """What f gives of each range of a new state, which is held (and written now and then) in place of what led to it."""
        state.persist(StorageLevel.MEMORY_AND_DISK)
        self.steps += 1
        if self.steps % WRITTEN_EVERY == 0:
            state.checkpoint()
        out = state.map(f).collect()  # a row for each range
        for old in self.held:
            old.unpersist()
        self.held = [state]
        return out

    def close(self) -> None:
        for old in (*self.held, self.edges, self.routes):
            old.unpersist()
        self.held = []

    def state(self, rows: DataFrame) -> RDD:
        """rows (id, integer columns) as a row of arrays for each range, -1 where there is no row."""
        width, columns = self.width, [c for c in rows.columns if c != "id"]

        def pack(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
            values = np.full((len(columns), width), -1, np.int64)
            values[:, rows["id"].to_numpy() - int(key[0]) * width] = rows[columns].to_numpy().T
            return pd.DataFrame([(int(key[0]), [narrow(v) for v in values])], columns=["part", "values"])

        at = rows.select(F.floor(F.col("id") / width).alias("part"), "id", *(F.col(c).cast("long") for c in columns))
        packs = at.groupBy("part").applyInPandas(pack, "part long, values array<binary>")
        return self.placed(packs.rdd.map(lambda r: (r["part"], ("state", {c: wide(bytes(v)) for c, v in zip(columns, r["values"], strict=True)}))))

    def frame(self, state: RDD, column: str, kind: str) -> DataFrame:
        """(id, column) of the ids that have a weight."""
        width = self.width

        def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                for part, values, live in zip(batch["part"], batch["values"], batch["live"], strict=True):
                    i = np.flatnonzero(wide(live) >= 0)
                    yield pd.DataFrame({"id": part * width + i, column: wide(values)[i]})

        packs = state.map(lambda r: (r[0], bytearray(narrow(r[1][1][column])), bytearray(narrow(r[1][1]["weight"]))))
        return self.spark.createDataFrame(packs, "part long, values binary, live binary").mapInPandas(rows, f"id long, {column} {kind}")

    def run(self, state: RDD, columns: tuple[str, ...], f: Callable[[View], dict]) -> RDD:
        """(part, ("rows", what f makes of the range)); far ends see the given columns."""
        width = self.width

        def send(rows: Iterable) -> Iterator:
            own: dict[int, dict] = {}
            for at, row in rows:
                if row[0] == "state":
                    own[at] = row[1]
                elif at in own:
                    i = wide(row[2])
                    yield row[1], ("sent", at, [narrow(own[at][c][i]) for c in columns])

        def step(rows: Iterable) -> Iterator:
            own, sent, none = {}, {}, np.zeros(0, np.int64)

            def view(part: int, src: np.ndarray, dst: np.ndarray, weight: np.ndarray, ids: np.ndarray) -> tuple:
                got = sorted(sent.pop(part, []), key=lambda x: x[0])
                far = {c: np.concatenate([none, *(wide(v[i]) for _, v in got)]) for i, c in enumerate(columns)}
                return part, ("rows", f(View(part * width, width, src, dst, weight, ids, own.pop(part), far)))

            for part, row in rows:
                if row[0] == "state":
                    own[part] = row[1]
                elif row[0] == "sent":
                    sent.setdefault(part, []).append(row[1:])
                else:
                    yield view(part, *(wide(b) for b in row[1:]))
            for part in list(own):  # ranges without edges
                yield view(part, none, none, none, none)

        messages = self.placed(self.together(send, state, self.routes, stays=False))
        return self.together(step, state, messages, self.edges)

    # ------------------------------------------------------------------ what a limit lets through

    def limited(self, rows: RDD, group: str, limits: np.ndarray, seed: int, cover: bool = False) -> RDD:
        """``moves.admit`` (or ``moves.cover``) for a few groups: the rows of ``run`` up to each group's limit by (gain, hash, id).

        The driver narrows down where a limit falls by sums over bins, group by group, until few rows are left there; no task sees a whole group.
        """

        def keys(r: dict) -> tuple[np.ndarray, np.ndarray]:
            return descending(np.asarray(r["gain"])), ((scrambled(r["id"], seed) % 1024) << 44) | r["id"]

        def spans(row: tuple) -> list:
            r, out = row[1][1], []
            first, second = keys(r)
            for g in np.unique(r[group]):
                i = r[group] == g
                out.append((int(g), int(first[i].min()), int(first[i].max()), int(r["weight"][i].sum()), int(i.sum()), int(second[i].min()), int(second[i].max())))
            return out

        total: dict[int, list[int]] = {}
        for g, a, b, w, c, s, t in (x for r in rows.map(spans).collect() for x in r):
            o = total.setdefault(g, [a, b, 0, 0, s, t])
            total[g] = [min(o[0], a), max(o[1], b), o[2] + w, o[3] + c, min(o[4], s), max(o[5], t)]
        ends: dict[int, tuple | None] = {}  # group -> the last key that passes; None: all pass
        todo: dict[int, dict] = {}
        for g, (a, b, w, c, s, t) in total.items():
            limit = int(limits[g])
            if w < limit or (w == limit and not cover):
                ends[g] = None
            elif cover and limit <= 0:
                ends[g] = (-(1 << 63), -1)
            else:
                todo[g] = {"at": None, "lo": a, "hi": b, "second": (s, t), "before": 0, "count": c, "last": (-(1 << 63), -1)}

        def inside(r: dict, g: int, x: dict) -> tuple[np.ndarray, np.ndarray]:
            first, second = keys(r)
            key = first if x["at"] is None else second
            i = (r[group] == g) & (key >= x["lo"]) & (key <= x["hi"])
            if x["at"] is not None:
                i &= first == x["at"]
            return np.flatnonzero(i), key

        def width_of(x: dict) -> int:
            return max(-(-(x["hi"] - x["lo"] + 1) // BINS), 1)

        def binned(values: np.ndarray, x: dict) -> np.ndarray:
            if x["hi"] - x["lo"] < 1 << 62:
                return (values - x["lo"]) // width_of(x)
            return np.array([(int(v) - x["lo"]) // width_of(x) for v in values], np.int64)

        def bins(row: tuple, todo: dict) -> dict:
            out = {}
            for g, x in todo.items():
                i, key = inside(row[1][1], g, x)
                if x["count"] <= FEW:
                    first, second = keys(row[1][1])
                    out[g] = (first[i], second[i], row[1][1]["weight"][i])
                else:
                    values, at = np.unique(key[i], return_inverse=True)
                    if x["at"] is not None or len(values) > NAMED:
                        values, at = np.unique(binned(values, x)[at], return_inverse=True)
                        named = False
                    else:
                        named = True
                    out[g] = (named, values, np.bincount(at, row[1][1]["weight"][i], len(values)).astype(np.int64), np.bincount(at, minlength=len(values)))
            return out

        while todo:
            asked = dict(todo)
            parts = rows.map(lambda row: bins(row, asked)).collect()
            for g, x in asked.items():
                limit = int(limits[g]) - x["before"]
                passes = (lambda upto, w: upto - w < limit) if cover else (lambda upto, w: upto <= limit)  # noqa: B023
                if x["count"] <= FEW:
                    first, second, w = (np.concatenate([p[g][i] for p in parts]) for i in range(3))
                    by = np.lexsort((second, first))
                    ok = int(passes(np.cumsum(w[by]), w[by]).sum())
                    last = x["last"] if x["at"] is None else max(x["last"], (x["at"], x["lo"] - 1))
                    ends[g] = (int(first[by[ok - 1]]), int(second[by[ok - 1]])) if ok else last
                    del todo[g]
                    continue
                named = all(p[g][0] for p in parts)
                values = np.concatenate([p[g][1] if p[g][0] == named else binned(p[g][1], x) for p in parts])
                values, at = np.unique(values, return_inverse=True)
                w, c = (np.bincount(at, np.concatenate([p[g][i] for p in parts]), len(values)).astype(np.int64) for i in (2, 3))
                size = 1 if named else width_of(x)
                crossing = (np.cumsum(w) >= limit) if cover else (np.cumsum(w) > limit)
                b = int(np.argmax(crossing))
                lo = int(values[b]) if named else x["lo"] + int(values[b]) * size
                last = (lo - 1, 1 << 62) if x["at"] is None else (x["at"], lo - 1)
                y = {**x, "lo": lo, "hi": min(lo + size - 1, x["hi"]), "before": x["before"] + int(w[:b].sum()), "count": int(c[b]), "last": last}
                if x["at"] is None and y["lo"] == y["hi"]:  # one gain is left: by hash and id
                    y |= {"at": y["lo"], "lo": x["second"][0], "hi": x["second"][1]}
                todo[g] = y

        def admitted(row: tuple) -> tuple:
            r = row[1][1]
            first, second = keys(r)
            ok = np.zeros(len(first), bool)
            for g, end in ends.items():
                mine = r[group] == g
                ok |= mine if end is None else mine & ((first < end[0]) | ((first == end[0]) & (second <= end[1])))
            return row[0], ("rows", {c: v[ok] for c, v in r.items()})

        return rows.map(admitted, preservesPartitioning=True)

    def moved(self, state: RDD, moves: RDD, mark: str | None = None) -> RDD:
        """The state with its blocks changed; mark: the column that notes who moved."""
        width = self.width

        def apply(rows: Iterable) -> Iterator:
            to = {}
            for part, row in rows:
                if row[0] == "rows":
                    to[part] = row[1]
                    continue
                own, r = dict(row[1]), to.get(part)
                if r is not None and len(r["id"]):
                    i = r["id"] - part * width
                    own["block"] = own["block"].copy()
                    own["block"][i] = r["to"]
                    if mark:
                        own[mark] = own[mark].copy()
                        own[mark][i] = 1
                own["moved"] = np.array([0 if r is None else len(r["id"])])
                yield part, ("state", own)

        return self.together(apply, moves, state)


def block_sums(k: int) -> Callable[[tuple], tuple[np.ndarray, int]]:
    def f(row: tuple) -> tuple[np.ndarray, int]:
        own = row[1][1]
        live = own["weight"] >= 0
        sums = np.zeros(k, np.int64)
        np.add.at(sums, own["block"][live], own["weight"][live])
        return sums, int(own["moved"][0]) if "moved" in own else 0

    return f


def propagated(graph: Graph, max_weight: int, steps: Iterable, seed: int, proposer: Callable, communities: DataFrame | None = None, desired: int = 0) -> DataFrame:
    """(id, cluster) after rounds of label propagation. steps: a list of (chunk, degrees) for each round; proposer: as ``clustering.proposer``."""
    rows = graph.nodes.select("id", "weight", F.col("id").alias("cluster"))
    if communities is not None:
        rows = rows.join(communities.select("id", "community"), "id")
    r = Ranges(graph)
    width = r.width

    def ask(row: tuple) -> Iterator:
        part, own = row[0], row[1][1]
        live = own["weight"] >= 0
        labels, at = np.unique(own["cluster"][live], return_inverse=True)
        sums = np.zeros(len(labels), np.int64)
        np.add.at(sums, at, own["weight"][live])
        for to, (ids, s) in by_range(width, labels, sums):
            yield to, ("asked", part, ids, s)

    def add(rows: Iterable) -> Iterator:
        got: dict[int, list] = {}
        for at, row in rows:
            got.setdefault(at, []).append(row[1:])
        for at, asked in got.items():
            total = np.zeros(width, np.int64)
            for _, ids, s in asked:
                total[ids - at * width] += s
            yield at, ("total", total, [(part, ids) for part, ids, _ in asked])

    def answer(row: tuple) -> Iterator:
        for part, ids in row[1][2]:
            yield part, ("answer", ids, row[1][1][ids - row[0] * width])

    def known(rows: Iterable) -> Iterator:
        got: dict[int, list] = {}
        for part, row in rows:
            if row[0] == "answer":
                got.setdefault(part, []).append(row[1:])
                continue
            own = dict(row[1])
            live = own["weight"] >= 0
            ids, total = (np.concatenate(x) for x in zip(*got[part], strict=True)) if part in got else (np.zeros(0, np.int64),) * 2
            by = np.argsort(ids)
            own["cluster_weight"] = np.full(width, -1, np.int64)
            own["cluster_weight"][live] = total[by][np.searchsorted(ids[by], own["cluster"][live])]
            yield part, ("state", own)

    def offer(row: tuple) -> Iterator:
        p = row[1][1]
        for to, (t, i, g, w) in by_range(width, p["to"], p["id"], p["gain"], p["weight"]):
            yield to, ("offer", i, t, g, w)

    def admit(rows: Iterable) -> Iterator:
        offers: dict[int, list] = {}
        for at, row in rows:
            if row[0] == "offer":
                offers.setdefault(at, []).append(row[1:])
            elif at in offers:
                i, t, g, w = (np.concatenate(x) for x in zip(*offers.pop(at), strict=True))
                ok = prefix(t, (-g, scrambled(i, seed) % 1024, i), w, max_weight - row[1][t - at * width])
                for part, (ids, to) in by_range(width, i[ok], t[ok]):
                    yield part, ("new", ids, to)

    def renamed(rows: Iterable) -> Iterator:
        new: dict[int, list] = {}
        for part, row in rows:
            if row[0] == "new":
                new.setdefault(part, []).append(row[1:])
                continue
            own, got = dict(row[1]), new.get(part, [])
            own["cluster"] = own["cluster"].copy()
            for ids, to in got:
                own["cluster"][ids - part * width] = to
            own["moved"] = np.array([sum(len(ids) for ids, _ in got)])
            yield part, ("state", own)

    def totals(state: RDD) -> RDD:
        return r.placed(state.flatMap(ask)).mapPartitions(add, preservesPartitioning=True)

    try:
        state = r.state(rows)
        r.settled(state, lambda row: 0)
        sees = ("cluster", "cluster_weight") if communities is None else ("cluster", "cluster_weight", "community")
        for step in steps:
            moved = 0
            for chunk, degrees in step:
                total = r.keep(totals(state))
                full = r.together(known, r.placed(total.flatMap(answer)), state)
                offers = r.placed(r.run(full, sees, proposer(max_weight, chunk, communities is not None, degrees)).flatMap(offer))
                state = r.together(renamed, r.placed(r.together(admit, offers, total, stays=False)), state)
                moved += sum(r.settled(state, lambda row: int(row[1][1]["moved"][0])))
            if not moved or (desired and totals(state).map(lambda x: int((x[1][1] > 0).sum())).sum() <= desired):
                break
        return checkpointed(r.frame(state, "cluster", "long"))
    finally:
        r.close()


def refined(graph: Graph, partition: DataFrame, k: int, lower: np.ndarray, upper: np.ndarray, rounds: int, chunks: int, seed: int, picker: Callable) -> DataFrame:
    """``refinement.lp_refine``; picker: as ``refinement.picker``."""
    r = Ranges(graph)
    try:
        zero = F.lit(0).cast("long")
        state = r.state(partition.join(graph.nodes, "id").select("id", "block", "weight", zero.alias("changed"), zero.alias("now")))
        weight = sum(w for w, _ in r.settled(state, block_sums(k)))
        near = any_ = False
        for i in range(rounds):
            count = 0
            for chunk in range(chunks):
                f = picker(weight - upper, weight - lower, (chunk, chunks, seed + i), near, False)
                found = r.keep(r.run(state, ("block", "changed") if near else ("block",), f))
                moves = r.limited(found, "to", np.maximum(upper - weight, 0), 0)
                if lower.any():
                    moves = r.limited(r.keep(moves), "from", weight - lower, 0)
                state = r.moved(state, moves, "now")
                got = r.settled(state, block_sums(k))
                weight = sum(w for w, _ in got)
                count += sum(m for _, m in got)
            if not count:
                break
            any_ = near = True
            state = state.map(lambda row: (row[0], ("state", {**row[1][1], "changed": row[1][1]["now"], "now": np.where(row[1][1]["weight"] >= 0, 0, -1)})), preservesPartitioning=True)
        return checkpointed(r.frame(state, "block", "int")) if any_ else partition
    finally:
        r.close()


def balanced(graph: Graph, partition: DataFrame, k: int, upper: np.ndarray, rounds: int, seed: int, leaver: Callable) -> DataFrame:
    """``refinement.balance_overload``; leaver: as ``refinement.leaver``."""
    weights = {x["block"]: x["w"] for x in partition.join(graph.nodes, "id").groupBy("block").agg(F.sum("weight").alias("w")).collect()}  # k rows
    weight = np.array([weights.get(b, 0) for b in range(k)], np.int64)
    if not (weight > upper).any():
        return partition
    r = Ranges(graph)
    try:
        state, any_ = r.state(partition.join(graph.nodes, "id").select("id", "block", "weight")), False
        r.settled(state, lambda row: 0)
        for i in range(rounds):
            if not (weight > upper).any():
                break
            found = r.keep(r.run(state, ("block",), leaver(weight, upper, seed + i)))
            chosen = r.keep(r.limited(found, "from", np.maximum(weight - upper, 0), seed + i, cover=True))
            state = r.moved(state, r.limited(chosen, "to", np.maximum(upper - weight, 0), seed + i))
            got = r.settled(state, block_sums(k))
            weight = sum(w for w, _ in got)
            if not sum(m for _, m in got):
                break
            any_ = True
        return checkpointed(r.frame(state, "block", "int")) if any_ else partition
    finally:
        r.close()
