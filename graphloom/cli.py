"""Command line: ``python -m graphloom.cli GRAPH K`` and the tools ``components``, ``properties``, ``partition-properties``, ``rearrange``."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .api import Partitioner
from .operators import metrics, transforms, traversal
from .plans.presets import presets
from .session import session
from .sources import files

TOOLS = ("components", "properties", "partition-properties", "rearrange", "compress")


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="graphloom", description=__doc__)
    p.add_argument("graph")
    p.add_argument("k", nargs="?", type=int)
    p.add_argument("-f", "--format", default="metis")
    p.add_argument("-P", "--preset", default="default", choices=sorted(presets()))
    p.add_argument("-e", "--epsilon", type=float, default=0.03)
    p.add_argument("-s", "--seed", type=int, default=0)
    p.add_argument("-o", "--output")
    p.add_argument("--output-block-sizes")
    p.add_argument("--output-rearranged")
    p.add_argument("--max-block-weights", type=int, nargs="+")
    p.add_argument("--max-block-weight-factors", type=float, nargs="+")
    p.add_argument("--ignore-node-weights", action="store_true")
    p.add_argument("--ignore-edge-weights", action="store_true")
    p.add_argument("--validate", action="store_true")
    p.add_argument("--set", dest="settings", action="append", default=[], metavar="KEY=VALUE", help="override a setting, e.g. coarsening.rounds=3")
    p.add_argument("--dump-config", action="store_true")
    p.add_argument("--tool", choices=TOOLS)
    p.add_argument("--partition")
    return p


def value_of(text: str):
    for kind in (int, float):
        try:
            return kind(text)
        except ValueError:
            pass
    return {"true": True, "false": False}.get(text, text)


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    context = presets()[a.preset].override("seed", a.seed)
    for s in a.settings:
        key, _, value = s.partition("=")
        context = context.override(key, value_of(value))
    if a.dump_config:
        print(context)
        return 0
    spark = SparkSession.getActiveSession() or session()
    g = files.read_graph(spark, a.graph, a.format)
    if a.ignore_node_weights or a.ignore_edge_weights:
        g = g.unweighted(a.ignore_node_weights, a.ignore_edge_weights)
    if a.tool:
        return tool(spark, g, a)
    if a.validate:
        from .operators.select import invalid

        if problems := invalid(g).collect():
            print(*problems, sep="\n")
            return 1
    if a.k is None and not a.max_block_weights and not a.max_block_weight_factors:
        raise SystemExit("give the number of blocks")
    p = Partitioner(spark, context).set_graph(g)
    part = p.compute_partition(a.k, None if a.max_block_weights or a.max_block_weight_factors else a.epsilon, a.max_block_weights, a.max_block_weight_factors)
    row = p.summary(part).first().asDict()
    print(*(f"{k}={v}" for k, v in row.items()))
    if a.output:
        files.write_partition(part, a.output)
    if a.output_block_sizes:
        files.write_block_sizes(part, p._k, a.output_block_sizes)
    if a.output_rearranged:
        files.write_metis(transforms.permuted(g, transforms.by_partition(part)), a.output_rearranged)
    return 0


def tool(spark, g, a) -> int:
    if a.tool == "properties":
        print(metrics.properties(g).first().asDict())
    elif a.tool == "components":
        sizes = traversal.component_sizes(g)
        print(sizes.agg(F.count("*").alias("components"), F.max("size").alias("largest"), F.max_by("component", F.struct("size", -F.col("component"))).alias("start")).first().asDict())
        print(*traversal.size_histogram(sizes).orderBy("bucket").collect(), sep="\n")
        if a.output:
            files.write_metis(traversal.largest_component(g)[0], a.output)
    elif a.tool == "partition-properties":
        part = files.read_partition(spark, a.partition)
        k = a.k or part.agg(F.max("block")).first()[0] + 1
        print(metrics.edge_cut(g, part).first().asDict(), metrics.balance(g, part, k).first().asDict())
        print(*metrics.block_weights(g, part, k).orderBy("block").collect(), sep="\n")
    elif a.tool == "rearrange":
        files.write_metis(transforms.permuted(g, transforms.by_degree(g)), a.output)
    else:
        files.write_columnar(g, a.output)
    return 0


if __name__ == "__main__":
    sys.exit(main())
