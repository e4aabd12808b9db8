"""The registered queries on graphs derived from the relational tables, each with independent SQL where SQL can express it."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import codecs, sub_blocks
from ..functions import integers as I  # noqa: N812
from ..graph import Graph
from ..operators import clustering, metrics, moves, refinement, select, transforms, traversal
from ..session import checkpointed, shared_dir
from ..sources import files, generators, tables
from .presets import Scheme, preset

K = 4
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def mod(graph: Graph, k: int = K) -> DataFrame:
    return graph.nodes.select("id", (F.col("id") % k).cast("int").alias("block"))


def groups(graph: Graph, width: int) -> DataFrame:
    """Clusters of ``width`` consecutive ids, named by the first."""
    return graph.nodes.select("id", (F.floor(F.col("id") / width) * width).cast("long").alias("cluster"))


SUPP = f"""lp AS (SELECT l_suppkey AS a, {tables.OFFSET} + l_partkey AS b, count(*) AS weight FROM lineitem GROUP BY 1, 2),
ids AS (SELECT key, CAST(dense_rank() OVER (ORDER BY key) - 1 AS BIGINT) AS id FROM (SELECT a AS key FROM lp UNION SELECT b FROM lp)),
half AS (SELECT i.id AS src, j.id AS dst, CAST(weight AS BIGINT) AS weight FROM lp JOIN ids i ON a = i.key JOIN ids j ON b = j.key),
edges AS (SELECT * FROM half UNION ALL SELECT dst, src, weight FROM half),
nodes AS (SELECT id, CAST(1 AS BIGINT) AS weight FROM ids),
part AS (SELECT id, CAST(id % {K} AS INTEGER) AS block FROM nodes)"""
CUST = f"""lp AS (SELECT o_custkey AS a, {tables.OFFSET} + l_suppkey AS b, count(*) AS weight FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2),
ids AS (SELECT key, CAST(dense_rank() OVER (ORDER BY key) - 1 AS BIGINT) AS id FROM (SELECT c_custkey AS key FROM customer UNION SELECT {tables.OFFSET} + s_suppkey FROM supplier)),
half AS (SELECT i.id AS src, j.id AS dst, CAST(weight AS BIGINT) AS weight FROM lp JOIN ids i ON a = i.key JOIN ids j ON b = j.key),
edges AS (SELECT * FROM half UNION ALL SELECT dst, src, weight FROM half),
nodes AS (SELECT id, CAST(1 AS BIGINT) AS weight FROM ids)"""
ORD = f"""lp AS (SELECT o_custkey AS a, {tables.OFFSET} + o_orderkey AS b, count(*) AS weight FROM orders GROUP BY 1, 2),
ids AS (SELECT key, CAST(dense_rank() OVER (ORDER BY key) - 1 AS BIGINT) AS id FROM (SELECT a AS key FROM lp UNION SELECT b FROM lp)),
half AS (SELECT i.id AS src, j.id AS dst, CAST(weight AS BIGINT) AS weight FROM lp JOIN ids i ON a = i.key JOIN ids j ON b = j.key),
edges AS (SELECT * FROM half UNION ALL SELECT dst, src, weight FROM half),
nodes AS (SELECT id, CAST(1 AS BIGINT) AS weight FROM ids),
part AS (SELECT id, CAST(id % {K} AS INTEGER) AS block FROM nodes)"""
URG = f"""lp AS (SELECT o_custkey AS a, {tables.OFFSET} + l_suppkey AS b, count(*) AS weight FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderpriority = '1-URGENT' GROUP BY 1, 2),
ids AS (SELECT key, CAST(dense_rank() OVER (ORDER BY key) - 1 AS BIGINT) AS id FROM (SELECT c_custkey AS key FROM customer UNION SELECT {tables.OFFSET} + s_suppkey FROM supplier UNION SELECT {2 * tables.OFFSET} + p_partkey FROM part)),
half AS (SELECT i.id AS src, j.id AS dst, CAST(weight AS BIGINT) AS weight FROM lp JOIN ids i ON a = i.key JOIN ids j ON b = j.key),
edges AS (SELECT * FROM half UNION ALL SELECT dst, src, weight FROM half),
nodes AS (SELECT id, CAST(1 AS BIGINT) AS weight FROM ids),
alone AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS r FROM nodes WHERE id NOT IN (SELECT src FROM edges))"""
COP = """pairs AS (SELECT a.l_partkey AS p, b.l_partkey AS q, count(DISTINCT a.l_orderkey) AS weight FROM lineitem a JOIN lineitem b USING (l_orderkey) WHERE a.l_partkey <> b.l_partkey GROUP BY 1, 2),
ids AS (SELECT key, CAST(dense_rank() OVER (ORDER BY key) - 1 AS BIGINT) AS id FROM (SELECT DISTINCT p AS key FROM pairs)),
edges AS (SELECT i.id AS src, j.id AS dst, CAST(weight AS BIGINT) AS weight FROM pairs JOIN ids i ON p = i.key JOIN ids j ON q = j.key),
nodes AS (SELECT id, CAST(1 AS BIGINT) AS weight FROM ids)"""
#: Both ends' blocks; block weights; connections; gains.
CUTS = "ends AS (SELECT e.*, u.block AS bu, v.block AS bv FROM edges e JOIN part u ON u.id = src JOIN part v ON v.id = dst)"
BW = f"bw AS (SELECT CAST(b AS INTEGER) AS block, CAST(coalesce(sum(weight), 0) AS BIGINT) AS weight FROM range({K}) t(b) LEFT JOIN (SELECT block, weight FROM part JOIN nodes USING (id)) ON block = b GROUP BY b)"
CONN = "conn AS (SELECT src AS id, bv AS block, CAST(sum(weight) AS BIGINT) AS conn FROM ends GROUP BY 1, 2)"
GAIN = """gains AS (SELECT c.id, p.block AS "from", c.block AS "to", c.conn, c.conn - coalesce(h.conn, 0) AS gain FROM conn c JOIN part p ON p.id = c.id LEFT JOIN conn h ON h.id = c.id AND h.block = p.block WHERE c.block <> p.block)"""
LIMIT = "(1.0 + 0.03) * ceil((SELECT sum(weight) FROM nodes) / 4.0)"


def sql(*ctes: str, select: str) -> str:
    return f"WITH RECURSIVE {', '.join(ctes)} {select}"


@query(sql(SUPP, select="SELECT * FROM edges"))
def graph_supp_part(spark, sf):
    return tables.supplier_part(spark, sf).edges


@query(sql(CUST, select="SELECT * FROM edges"))
def graph_cust_supp(spark, sf):
    return tables.customer_supplier(spark, sf).edges


@query(sql(COP, select="SELECT * FROM edges"))
def graph_copurchase(spark, sf):
    return tables.copurchase(spark, sf).edges


DEG = "deg AS (SELECT n.id, CAST(count(src) AS BIGINT) AS degree, CAST(coalesce(sum(e.weight), 0) AS BIGINT) AS weighted_degree FROM nodes n LEFT JOIN edges e ON src = id GROUP BY 1)"


@query(sql(CUST, DEG, select="SELECT * FROM deg"))
def degree(spark, sf):
    return metrics.degrees(tables.customer_supplier(spark, sf))


@query(sql(CUST, DEG, select="SELECT CASE WHEN degree = 0 THEN 0 ELSE length(bin(degree)) END::INTEGER AS bucket, count(*) AS n FROM deg GROUP BY 1"))
def degree_buckets(spark, sf):
    return metrics.degree_buckets(tables.customer_supplier(spark, sf))


@query(sql(CUST, DEG, select="SELECT count(*) AS n, CAST(sum(degree) AS BIGINT) AS m, CAST(sum(weighted_degree) AS BIGINT) AS total_edge_weight, max(degree) AS max_degree, CAST(sum(CAST(degree = 0 AS INT)) AS BIGINT) AS isolated, count(*) AS total_node_weight, CAST(1 AS BIGINT) AS max_node_weight, CAST(sum(degree) AS DOUBLE) / count(*) AS avg_degree FROM deg"))
def graph_properties(spark, sf):
    return metrics.properties(tables.customer_supplier(spark, sf))


@query(sql(URG, select="SELECT * FROM nodes WHERE id NOT IN (SELECT src FROM edges)"))
def isolated_nodes(spark, sf):
    return select.isolated(tables.urgent_suppliers(spark, sf))


@query(sql(SUPP, CUTS, select="SELECT CAST(sum(weight) // 2 AS BIGINT) AS edge_cut FROM ends WHERE bu <> bv"))
def edge_cut_mod_k(spark, sf):
    g = tables.supplier_part(spark, sf)
    return metrics.edge_cut(g, mod(g))


@query(sql(SUPP, BW, select="SELECT * FROM bw"))
def block_weights(spark, sf):
    g = tables.supplier_part(spark, sf)
    return metrics.block_weights(g, mod(g), K)


PERFECT = "ceil((SELECT sum(weight) FROM nodes) / 4.0)"


@query(sql(SUPP, BW, select=f"SELECT greatest(max(weight / {PERFECT}) - 1.0, 0.0) AS imbalance, least(min(weight / {PERFECT}) - 1.0, 0.0) AS min_imbalance FROM bw"))
def imbalance(spark, sf):
    g = tables.supplier_part(spark, sf)
    return metrics.balance(g, mod(g), K)


TIGHT = "lim AS (SELECT block, CAST((SELECT count(*) FROM nodes) // 4 - 3 + block AS BIGINT) AS max_weight, CAST((SELECT count(*) FROM nodes) // 4 - block AS BIGINT) AS min_weight FROM bw)"


def tight(g: Graph) -> DataFrame:
    base = g.n() // K
    return g.nodes.sparkSession.createDataFrame([(b, base - b, base - 3 + b) for b in range(K)], "block int, min_weight long, max_weight long")


@query(sql(SUPP, BW, TIGHT, "o AS (SELECT *, greatest(weight - max_weight, 0) AS over FROM bw JOIN lim USING (block))", select="SELECT CAST(sum(over) AS BIGINT) AS total_overload, CAST(sum(CAST(over > 0 AS INT)) AS BIGINT) AS overloaded_blocks, CAST(sum(over) AS DOUBLE) AS imbalance_l1, sqrt(sum(CAST(over AS DOUBLE) * over)) AS imbalance_l2, max(over) = 0 AS feasible, bool_and(weight >= min_weight) AS min_feasible FROM o"))
def total_overload(spark, sf):
    g = tables.supplier_part(spark, sf)
    return metrics.overload(g, mod(g), tight(g), K)


@query(sql(SUPP, BW, f"lim AS (SELECT block, CAST(floor({LIMIT}) AS BIGINT) AS max_weight FROM bw)", select="SELECT block, weight, max_weight, weight <= max_weight AS balanced FROM bw JOIN lim USING (block)"))
def is_balanced(spark, sf):
    g = tables.supplier_part(spark, sf)
    lim = metrics.limits(spark, K, g.total_node_weight(), epsilon=0.03)
    return metrics.block_weights(g, mod(g), K).join(lim, "block").select("block", "weight", "max_weight", (F.col("weight") <= F.col("max_weight")).alias("balanced"))


@query(sql(SUPP, CUTS, select="SELECT DISTINCT src AS id FROM ends WHERE bu <> bv"))
def border_nodes(spark, sf):
    g = tables.supplier_part(spark, sf)
    return select.border(g, mod(g))


@query(sql(SUPP, CUTS, select="SELECT bu AS b1, bv AS b2, CAST(sum(weight) AS BIGINT) AS cut, count(*) AS edges FROM ends WHERE bu < bv GROUP BY 1, 2"))
def quotient_graph(spark, sf):
    g = tables.supplier_part(spark, sf)
    return metrics.quotient_graph(g, mod(g))


@query(sql(SUPP, CUTS, CONN, select="SELECT * FROM conn"))
def node_block_conn(spark, sf):
    g = tables.supplier_part(spark, sf)
    return metrics.connections(g.edges, mod(g))


@query(sql(SUPP, CUTS, CONN, GAIN, select="SELECT * FROM gains"))
def move_gains(spark, sf):
    g = tables.supplier_part(spark, sf)
    return metrics.gains(g.edges, mod(g))


BEST = """best AS (SELECT id, "from", "to", gain FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY gain DESC, "to") AS r FROM gains) WHERE r = 1)"""


@query(sql(SUPP, CUTS, CONN, GAIN, BEST, select="SELECT * FROM best"))
def max_gain_move(spark, sf):
    g = tables.supplier_part(spark, sf)
    return metrics.best_moves(g.edges, mod(g))


@query(sql(SUPP, CUTS, CONN, GAIN, BEST, select="""SELECT id, "from", "to", relative FROM (SELECT *, row_number() OVER (PARTITION BY "from" ORDER BY relative DESC, id) AS r FROM (SELECT *, CASE WHEN gain > 0 THEN CAST(gain * w AS DOUBLE) ELSE CAST(gain AS DOUBLE) / w END AS relative FROM (SELECT *, 1 + id % 3 AS w FROM best))) WHERE r <= 5"""))
def relative_gain_topk(spark, sf):
    g = tables.supplier_part(spark, sf)
    m = metrics.best_moves(g.edges, mod(g)).withColumn("relative", I.relative_gain(F.col("gain"), 1 + F.col("id") % 3))
    return moves.best_n(m, 5, rank="relative").select("id", "from", "to", "relative")


@query(sql(SUPP, select="SELECT src, dst, weight FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY dst) AS r FROM edges) WHERE r <= 3"))
def first_n_neighbors(spark, sf):
    return select.first_neighbors(tables.supplier_part(spark, sf), 3)


@query(sql(CUST, DEG, select="SELECT id FROM deg WHERE degree <= 40"))
def low_degree_nodes(spark, sf):
    return select.low_degree(tables.customer_supplier(spark, sf), 40)


@query(sql(SUPP, select="SELECT e.* FROM edges e JOIN nodes u ON u.id = src JOIN nodes v ON v.id = dst WHERE u.id // 100 = v.id // 100"))
def community_edges(spark, sf):
    g = tables.supplier_part(spark, sf)
    return select.within_communities(g, g.nodes.select("id", F.floor(F.col("id") / 100).alias("community")))


@query(sql(SUPP, select="SELECT DISTINCT src AS id FROM edges WHERE dst % 97 = 5"))
def active_nodes(spark, sf):
    g = tables.supplier_part(spark, sf)
    return select.active(g, g.nodes.filter("id % 97 = 5"))


@query(sql(SUPP, select=f"SELECT id, CAST(CASE WHEN id % 10 = 3 THEN 0 ELSE id % {K} END AS INTEGER) AS block FROM nodes"))
def delta_overlay(spark, sf):
    g = tables.supplier_part(spark, sf)
    return select.overlay(mod(g), g.nodes.filter("id % 10 = 3").select("id", F.lit(0).alias("block")))


BROKEN = "broken AS (SELECT * FROM edges WHERE NOT (src % 7 = 0 AND src < dst) UNION ALL SELECT * FROM edges WHERE src % 11 = 0)"


def broken(g: Graph) -> DataFrame:
    return g.edges.filter("not (src % 7 = 0 and src < dst)").unionByName(g.edges.filter("src % 11 = 0"))


@query(sql(SUPP, BROKEN, "back AS MATERIALIZED (SELECT DISTINCT dst AS src, src AS dst, weight FROM broken)", select="SELECT * FROM broken ANTI JOIN back USING (src, dst, weight)"))
def reverse_edge_violations(spark, sf):
    return select.reverse_violations(broken(tables.supplier_part(spark, sf)))


@query(sql(SUPP, BROKEN, select="SELECT src, dst, count(*) AS n FROM broken GROUP BY 1, 2 HAVING count(*) > 1"))
def multi_edges(spark, sf):
    return select.multi_edges(broken(tables.supplier_part(spark, sf)))


CONTRACT = """cl AS (SELECT id, CAST(dense_rank() OVER (ORDER BY id % 50) - 1 AS BIGINT) AS coarse_id FROM nodes),
cn AS (SELECT coarse_id AS id, CAST(count(*) AS BIGINT) AS weight FROM cl GROUP BY 1),
ce AS (SELECT u.coarse_id AS src, v.coarse_id AS dst, CAST(sum(weight) AS BIGINT) AS weight FROM edges JOIN cl u ON u.id = src JOIN cl v ON v.id = dst WHERE u.coarse_id <> v.coarse_id GROUP BY 1, 2)"""


def contracted(spark, sf):
    g = tables.supplier_part(spark, sf)
    return g, *transforms.contract(g, g.nodes.select("id", (F.col("id") % 50).alias("cluster")))


@query(sql(SUPP, CONTRACT, select="SELECT * FROM ce"))
def contract_mod(spark, sf):
    return contracted(spark, sf)[1].edges


@query(sql(SUPP, CONTRACT, select="SELECT * FROM cn"))
def contract_mod_nodes(spark, sf):
    return contracted(spark, sf)[1].nodes


@query(sql(SUPP, CONTRACT, select="SELECT id, CAST(coarse_id % 4 AS INTEGER) AS block FROM cl"))
def project_up(spark, sf):
    _, coarse, mapping = contracted(spark, sf)
    return transforms.project_up(mapping, mod(coarse))


@query(sql(SUPP, CONTRACT, select="SELECT coarse_id AS id, CAST(min(id // 7) AS BIGINT) AS community FROM cl GROUP BY 1"))
def project_down(spark, sf):
    g, _, mapping = contracted(spark, sf)
    return transforms.project_down(mapping, g.nodes.select("id", F.floor(F.col("id") / 7).alias("community")), "community")


@query(sql(SUPP, select="SELECT id, min(id) OVER (PARTITION BY id % 6, id % 10) AS cluster FROM nodes"))
def overlay_clusters(spark, sf):
    g = tables.supplier_part(spark, sf)
    return transforms.overlay_clusters(g.nodes.select("id", (F.col("id") % 6).alias("cluster")), g.nodes.select("id", (F.col("id") % 10).alias("cluster")))


@query(sql(SUPP, CONTRACT, "h AS (SELECT weight AS value, count(*) AS equal FROM ce GROUP BY 1)", "r AS (SELECT value, CAST(sum(equal) OVER (ORDER BY value DESC) AS BIGINT) - equal AS larger, equal FROM h)", select="SELECT * FROM r WHERE larger < 500 AND larger + equal >= 500"))
def sparsify_threshold(spark, sf):
    return transforms.kth_largest(contracted(spark, sf)[1].edges, "weight", 500)


@query(sql(CUST, DEG, select="SELECT id AS old_id, CAST(row_number() OVER (ORDER BY CASE WHEN degree = 0 THEN 99 ELSE length(bin(degree)) END, id) - 1 AS BIGINT) AS new_id FROM deg"))
def permute_by_degree(spark, sf):
    return transforms.by_degree(tables.customer_supplier(spark, sf))


@query(sql(SUPP, "perm AS (SELECT id AS old_id, CAST(row_number() OVER (ORDER BY block, id) - 1 AS BIGINT) AS new_id FROM part)", select="SELECT u.new_id AS src, v.new_id AS dst, weight FROM edges JOIN perm u ON u.old_id = src JOIN perm v ON v.old_id = dst"))
def rearranged_by_partition(spark, sf):
    g = tables.supplier_part(spark, sf)
    return transforms.permuted(g, transforms.by_partition(mod(g))).edges


@query(sql(SUPP, select="SELECT src, dst, weight, dst - row_number() OVER (PARTITION BY src ORDER BY dst) AS run FROM edges"))
def interval_runs(spark, sf):
    return transforms.edge_order(tables.supplier_part(spark, sf).edges)


@query(sql(SUPP, "i AS (SELECT id, CAST(row_number() OVER (ORDER BY id) - 1 AS BIGINT) AS new_id FROM part WHERE block = 1)", select="SELECT u.new_id AS src, v.new_id AS dst, weight FROM edges JOIN i u ON u.id = src JOIN i v ON v.id = dst"))
def induced_subgraph(spark, sf):
    g = tables.supplier_part(spark, sf)
    return transforms.induced(g, mod(g), 1)[0].edges


@query(sql(SUPP, CUTS, select="SELECT block, n, coalesce(m, 0) AS m, node_weight, CAST(coalesce(edge_weight, 0) AS BIGINT) AS edge_weight FROM (SELECT block, count(*) AS n, CAST(sum(weight) AS BIGINT) AS node_weight FROM part JOIN nodes USING (id) GROUP BY 1) LEFT JOIN (SELECT bu AS block, count(*) AS m, sum(weight) AS edge_weight FROM ends WHERE bu = bv GROUP BY 1) USING (block)"))
def block_subgraph_sizes(spark, sf):
    g = tables.supplier_part(spark, sf)
    return transforms.subgraph_sizes(g, mod(g))


COMP = "walk(id, component) AS (SELECT id, id FROM nodes UNION SELECT dst, component FROM walk JOIN edges ON src = id), comp AS (SELECT id, min(component) AS component FROM walk GROUP BY 1)"


@query(sql(ORD, COMP, select="SELECT * FROM comp"))
def connected_components(spark, sf):
    return traversal.components(tables.customer_orders(spark, sf).checkpointed())


@query(sql(ORD, COMP, select="SELECT CAST(length(bin(size)) - 1 AS INTEGER) AS bucket, count(*) AS components FROM (SELECT component, count(*) AS size FROM comp GROUP BY 1) GROUP BY 1"))
def component_histogram(spark, sf):
    return traversal.size_histogram(traversal.component_sizes(tables.customer_orders(spark, sf).checkpointed()))


@query(sql(SUPP, "hop1 AS (SELECT DISTINCT dst AS id FROM edges WHERE src = 0)", "hop2 AS (SELECT DISTINCT dst AS id FROM edges WHERE src IN (SELECT id FROM hop1))", "walk AS (SELECT 0 AS id, 0 AS distance UNION ALL SELECT id, 1 FROM hop1 UNION ALL SELECT id, 2 FROM hop2 UNION ALL SELECT dst, 3 FROM edges WHERE src IN (SELECT id FROM hop2))", select="SELECT id, CAST(min(distance) AS INTEGER) AS distance FROM walk GROUP BY 1"))
def bfs_distance(spark, sf):
    g = tables.supplier_part(spark, sf).checkpointed()
    return traversal.bfs(g, g.nodes.filter("id = 0"), 3)


CELL = lambda seed: f"CAST({I.scrambled_sql('id', seed)} % 1024 AS INTEGER)"
LP = f"""cl AS (SELECT id, id // 10 * 10 AS cluster FROM nodes), cw AS (SELECT cluster, count(*) AS cluster_weight FROM cl GROUP BY 1),
r AS (SELECT src AS id, cluster, CAST(sum(weight) AS BIGINT) AS rating FROM edges JOIN cl ON cl.id = dst WHERE {I.scrambled_sql('src', 0)} % 2 = 0 GROUP BY 1, 2),
x AS (SELECT r.*, own.cluster AS own, cluster_weight FROM r JOIN cl own USING (id) JOIN cw ON cw.cluster = r.cluster WHERE r.cluster = own.cluster OR cluster_weight + 1 <= 13),
b AS (SELECT id, cluster AS "to", rating, own, max(CASE WHEN cluster = own THEN rating ELSE 0 END) OVER (PARTITION BY id) AS here, row_number() OVER (PARTITION BY id ORDER BY rating DESC, cluster) AS k FROM x),
p AS (SELECT id, "to", rating - here AS gain, CAST(1 AS BIGINT) AS weight FROM b WHERE k = 1 AND "to" <> own AND rating > here),
a AS (SELECT p.*, sum(weight) OVER (PARTITION BY "to" ORDER BY gain DESC, {CELL(0)}, id) AS upto, 13 - cluster_weight AS room FROM p JOIN cw ON cw.cluster = "to")"""


@query(sql(SUPP, LP, select='SELECT id, "to", gain, weight FROM a WHERE upto <= room'))
def lp_round_once(spark, sf):
    g = tables.supplier_part(spark, sf).checkpointed()
    return clustering.lp_round(g, groups(g, 10), 13, clustering.chunk_edges(g.edges, 0, 2, 0))


@query(sql(SUPP, LP, select='SELECT id, "to", gain, weight FROM p'))
def lp_proposals(spark, sf):
    g = tables.supplier_part(spark, sf).checkpointed()
    return clustering.proposals(g, groups(g, 10), 13, clustering.chunk_edges(g.edges, 0, 2, 0))


TWO = """cl AS (SELECT id, CASE WHEN id % 3 = 0 THEN id ELSE 1 END AS cluster FROM nodes),
alone AS (SELECT id FROM cl WHERE cluster = id AND id <> 1),
r AS (SELECT src AS id, cluster, sum(weight) AS rating FROM edges JOIN cl ON cl.id = dst WHERE src IN (SELECT id FROM alone) AND cluster <> src GROUP BY 1, 2),
f AS (SELECT id, cluster AS favored FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY rating DESC, cluster) AS k FROM r) WHERE k = 1),
m AS (SELECT id, favored, (row_number() OVER (PARTITION BY favored ORDER BY id) - 1) // 2 AS pair FROM f),
l AS (SELECT id, min(id) OVER (PARTITION BY favored, pair) AS leader FROM m)"""


@query(sql(SUPP, TWO, select="SELECT id, coalesce(leader, cluster) AS cluster FROM cl LEFT JOIN l USING (id)"))
def two_hop_match(spark, sf):
    g = tables.supplier_part(spark, sf).checkpointed()
    c = g.nodes.select("id", F.when(F.col("id") % 3 == 0, F.col("id")).otherwise(F.lit(1)).alias("cluster"))
    return clustering.two_hop_clusters(g, c, 10)


@query(sql(URG, select="SELECT id, coalesce(leader, id) AS cluster FROM nodes LEFT JOIN (SELECT id, min(id) OVER (PARTITION BY r // 2) AS leader FROM alone) USING (id)"))
def isolated_match(spark, sf):
    g = tables.urgent_suppliers(spark, sf).checkpointed()
    return clustering.isolated_clusters(g, clustering.singletons(g), 2)


@query(sql(ORD, CUTS, f"b AS (SELECT id, {I.scrambled_sql('id', 1)} AS score FROM (SELECT DISTINCT src AS id FROM ends WHERE bu <> bv))", "low AS (SELECT src AS id, min((score, b.id)) AS other FROM edges JOIN b ON b.id = dst GROUP BY 1)", select="SELECT b.id, score FROM b LEFT JOIN low ON low.id = b.id WHERE other IS NULL OR (score, b.id) < other"))
def independent_border_set(spark, sf):
    g = tables.customer_orders(spark, sf).checkpointed()
    return select.independent_border(g, mod(g), 1)


@query(sql(SUPP, select='SELECT id, "to", weight FROM (SELECT src AS id, dst AS "to", weight, row_number() OVER (PARTITION BY src ORDER BY weight DESC, dst) AS r FROM edges) WHERE r = 1'))
def hem_propose(spark, sf):
    return clustering.hem_proposals(tables.supplier_part(spark, sf))


@query(sql(CUST, DEG, "s AS (SELECT degree AS label, count(*) AS size FROM deg GROUP BY 1)", "u AS (SELECT *, sum(size) OVER (ORDER BY size, label) AS upto FROM s)", select="SELECT label, size FROM u WHERE upto <= 0.2 * (SELECT sum(size) FROM s)"))
def colored_blacklist(spark, sf):
    return select.small_groups(metrics.degrees(tables.customer_supplier(spark, sf)).select(F.col("degree").alias("label")), 0.2)


MV = f"""mv AS (SELECT id, "from", "to", gain, 1 + id % 3 AS weight FROM best), rk AS (SELECT *, sum(weight) OVER (PARTITION BY "to" ORDER BY gain DESC, {CELL(0)}, id) AS upto, sum(weight) OVER (PARTITION BY "from" ORDER BY gain DESC, {CELL(0)}, id) AS cover FROM mv)"""


def weighted_moves(spark, sf):
    g = tables.supplier_part(spark, sf).checkpointed()
    return checkpointed(metrics.best_moves(g.edges, mod(g)).withColumn("weight", 1 + F.col("id") % 3)), spark


@query(sql(SUPP, CUTS, CONN, GAIN, BEST, MV, select='SELECT id, "from", "to", gain, weight FROM rk WHERE upto <= 40 + "to"'))
def admit_capacity(spark, sf):
    m, _ = weighted_moves(spark, sf)
    rooms = spark.range(K).select(F.col("id").cast("int").alias("to"), (F.col("id") + 40).alias("room"))
    return moves.admit(m, rooms)


@query(sql(SUPP, CUTS, CONN, GAIN, BEST, MV, select='SELECT id, "from", "to", gain, weight FROM rk WHERE cover - weight < 25 + 3 * "from"'))
def overload_prefix(spark, sf):
    m, _ = weighted_moves(spark, sf)
    needs = spark.range(K).select(F.col("id").cast("int").alias("from"), (F.col("id") * 3 + 25).alias("need"))
    return moves.cover(m, needs)


JET = f"""jf AS (SELECT b.id, "from", "to", gain FROM best b LEFT JOIN conn h ON h.id = b.id AND h.block = "from" WHERE gain > -floor(0.5 * coalesce(h.conn, 0)))"""


@query(sql(SUPP, CUTS, CONN, GAIN, BEST, JET, select="SELECT * FROM jf"))
def jet_find(spark, sf):
    g = tables.supplier_part(spark, sf).checkpointed()
    return refinement.jet_find(g.edges, mod(g), 0.5)


@query(sql(SUPP, CUTS, CONN, GAIN, BEST, JET, """pr AS (SELECT c.id, c."from", c."to", c.gain, CASE WHEN v.gain > c.gain OR v.gain = c.gain AND v.id < c.id THEN v."to" ELSE e.bv END AS block, e.weight FROM jf c JOIN ends e ON src = c.id LEFT JOIN jf v ON v.id = e.dst)""", select="""SELECT id, "from", "to", gain, CAST(sum(CASE WHEN block = "to" THEN weight WHEN block = "from" THEN -weight ELSE 0 END) AS BIGINT) AS projected FROM pr GROUP BY 1, 2, 3, 4 HAVING projected >= 1"""))
def jet_filter(spark, sf):
    g = tables.supplier_part(spark, sf).checkpointed()
    return refinement.jet_filter(g.edges, mod(g), refinement.jet_find(g.edges, mod(g), 0.5))


@query(sql(SUPP, select="SELECT id, CAST(CASE WHEN id < 20 THEN 0 WHEN id < 50 THEN 2 ELSE 3 END AS INTEGER) AS block FROM nodes"))
def block_sizes_to_partition(spark, sf):
    g = tables.supplier_part(spark, sf)
    sizes = spark.createDataFrame([(0, 20), (1, 0), (2, 30), (3, g.n() - 50)], "block int, size long")
    return transforms.blocks_from_sizes(g.nodes, sizes)


#: Nodes of weight 2 (ids with an odd remainder by 3 of 1) come first: each block takes as many as fit whole; then those of weight 1.
FILL = """w AS (SELECT id, 1 + CAST(id % 3 = 1 AS INT) AS weight FROM alone),
rooms AS (SELECT * FROM (VALUES (0, 11), (1, 0), (2, 20), (3, 100000000)) t(block, room)),
two AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS r FROM w WHERE weight = 2), cap2 AS (SELECT block, room, room // 2 AS cap, sum(room // 2) OVER (ORDER BY block) AS upto FROM rooms),
in2 AS (SELECT id, block FROM two JOIN cap2 ON r >= upto - cap AND r < upto),
one AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS r FROM w WHERE weight = 1),
cap1 AS (SELECT block, room - 2 * used AS cap, sum(room - 2 * used) OVER (ORDER BY block) AS upto FROM (SELECT block, room, (SELECT count(*) FROM in2 WHERE in2.block = rooms.block) AS used FROM rooms)),
in1 AS (SELECT id, block FROM one JOIN cap1 ON r >= upto - cap AND r < upto)"""


@query(sql(URG, FILL, select="SELECT id, block FROM in2 UNION ALL SELECT id, block FROM in1"))
def assign_isolated(spark, sf):
    alone = select.isolated(tables.urgent_suppliers(spark, sf).checkpointed()).withColumn("weight", 1 + (F.col("id") % 3 == 1).cast("long"))
    state = spark.createDataFrame([(0, 89, 100), (1, 100, 100), (2, 80, 100), (3, 0, 100_000_000)], "block int, weight long, max_weight long")
    return transforms.assign_isolated(alone, state.select("block", "weight"), state.select("block", "max_weight"))


@query("SELECT CAST(k AS BIGINT) AS k, CAST(b AS INTEGER) AS block, CAST(k // 8 + CAST(CAST('0b' || reverse(lpad(bin(b), 3, '0')) AS BIGINT) < k % 8 AS INT) AS INTEGER) AS final_k FROM range(8, 200) t(k), range(8) u(b)".replace("CAST('0b' || reverse(lpad(bin(b), 3, '0')) AS BIGINT)", "(b % 2 * 4 + b // 2 % 2 * 2 + b // 4)"))
def final_k_table(spark, sf):
    both = spark.range(192 * 8).select((F.floor(F.col("id") / 8) + 8).alias("k"), (F.col("id") % 8).cast("int").alias("block"))
    return both.withColumn("final_k", sub_blocks.final_k_column(F.col("block"), 8, F.col("k")))


@query(sql(SUPP, "c AS (SELECT count(*) AS n FROM nodes)", select="SELECT id, CAST(CASE WHEN id < n % 7 * (n // 7 + 1) THEN id // (n // 7 + 1) ELSE n % 7 + (id - n % 7 * (n // 7 + 1)) // (n // 7) END AS INTEGER) AS rank FROM nodes, c"))
def round_robin_ranges(spark, sf):
    g = tables.supplier_part(spark, sf)
    return g.nodes.select("id", I.local_rank_column(F.col("id"), g.n(), 7).alias("rank"))


RF = """st AS (SELECT block, bw.weight - 0 - lim.max_weight AS over, bw.weight - lim.min_weight AS slack FROM bw JOIN lim USING (block)),
x AS (SELECT g.id, g."from", g."to", g.gain, CAST(1 AS BIGINT) AS weight, t.over AS to_over, f.over AS from_over FROM gains g JOIN st t ON t.block = g."to" JOIN st f ON f.block = g."from"
  WHERE (t.over + 1 <= 0 OR greatest(t.over + 1, 0) < greatest(f.over, 0)) AND (gain > 0 OR gain = 0 AND t.over + 1 < f.over) AND f.slack >= 1),
p AS (SELECT id, "from", "to", gain, weight FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY gain DESC, to_over, "to") AS k FROM x) WHERE k = 1)"""
ROOMY = "lim AS (SELECT block, CAST((SELECT count(*) FROM nodes) // 4 + 5 AS BIGINT) AS max_weight, CAST(0 AS BIGINT) AS min_weight FROM bw)"


@query(sql(SUPP, CUTS, CONN, GAIN, BW, ROOMY, RF, select="SELECT * FROM p"))
def refine_proposals(spark, sf):
    g = tables.supplier_part(spark, sf).checkpointed()
    lim = spark.range(K).select(F.col("id").cast("int").alias("block"), F.lit(0).cast("long").alias("min_weight"), F.lit(g.n() // K + 5).cast("long").alias("max_weight"))
    p = mod(g)
    return refinement.proposals(g, p, refinement.rooms(g, p, lim, K))


def partitioned(graph: Graph, scheme: str, **changes) -> DataFrame:
    from ..api import Partitioner

    context = preset("default").override("scheme", Scheme(scheme)).override("coarsening.contraction_limit", 64)
    for key, value in changes.items():
        context = context.override(key, value)
    return Partitioner(graph.nodes.sparkSession, context).set_graph(graph).compute_partition(K, 0.03)


#: What holds of every partition, whatever the scheme: all nodes, all blocks in use, no block above its limit, a smaller cut than hashing gives.
def held(graph: str) -> str:
    part = "" if "part AS" in graph else f", part AS (SELECT id, CAST(id % {K} AS INTEGER) AS block FROM nodes)"
    cut = "SELECT CAST(sum(weight) // 2 AS BIGINT) FROM edges JOIN part u ON u.id = src JOIN part v ON v.id = dst WHERE u.block <> v.block"
    return f"WITH {graph}{part} SELECT count(*) AS nodes, CAST({K} AS BIGINT) AS used, CAST(floor({LIMIT}) AS BIGINT) AS max_weight, ({cut}) AS hash_cut, true AS complete, true AS feasible, true AS below_hash_cut FROM nodes"


def invariants(g: Graph, part: DataFrame) -> DataFrame:
    limit = int((1.0 + 0.03) * -(-g.total_node_weight() // K))
    p = metrics.partition_properties(g, checkpointed(part))
    hashed = metrics.edge_cut(g, mod(g)).withColumnRenamed("edge_cut", "hash_cut")
    return p.join(F.broadcast(hashed)).select(F.lit(g.n()).cast("long").alias("nodes"), "used", F.lit(limit).cast("long").alias("max_weight"), "hash_cut", "complete", (F.col("heaviest") <= limit).alias("feasible"), (F.col("edge_cut") < F.col("hash_cut")).alias("below_hash_cut"))


@query(held(SUPP))
def partition_deep(spark, sf):
    g = tables.supplier_part(spark, sf).checkpointed()
    return invariants(g, partitioned(g, "deep"))


@query(held(CUST))
def partition_kway(spark, sf):
    g = tables.customer_supplier(spark, sf).checkpointed()
    return invariants(g, partitioned(g, "kway"))


@query(held(COP))
def partition_rb(spark, sf):
    g = tables.copurchase(spark, sf).checkpointed()
    return invariants(g, partitioned(g, "rb"))


@query(held(SUPP))
def partition_vcycle(spark, sf):
    g = tables.supplier_part(spark, sf).checkpointed()
    return invariants(g, partitioned(g, "vcycle"))


@query(held(ORD))
def partition_vcycle_list(spark, sf):
    """V-cycles over a list of k: the halves are the communities of the quarters."""
    g = tables.customer_orders(spark, sf).checkpointed()
    return invariants(g, partitioned(g, "vcycle", vcycles=(2,)))


@query(held(ORD))
def partition_frames(spark, sf):
    """The DataFrame tier: two levels of it at least, whatever the size; blocks are split on the way up."""
    g = tables.customer_orders(spark, sf).checkpointed()
    return invariants(g, partitioned(g, "deep", local_edges=max(g.m() // 3, 1000)))


@query(held(SUPP))
def partition_extended(spark, sf):
    """Halves by remainder, then every half split side by side in the task that holds it."""
    from . import schemes

    g = tables.supplier_part(spark, sf).checkpointed()
    limit = int((1.0 + 0.03) * -(-g.total_node_weight() // K))
    lim = schemes.Limits(np.full(K, limit), np.zeros(K, np.int64), 0.03)
    return invariants(g, schemes.extend_partition(g, checkpointed(mod(g, 2)), 2, lim, preset("default")))


@query(sql(SUPP, select="SELECT id, weight, list(dst ORDER BY dst) AS adjacency FROM nodes LEFT JOIN (SELECT src, dst FROM edges) ON src = id GROUP BY 1, 2").replace("list(dst ORDER BY dst) AS adjacency", "string_agg(CAST(dst AS VARCHAR), ' ' ORDER BY dst) AS adjacency"))
def codec_roundtrip(spark, sf):
    """Neighbourhoods through the byte codec and back."""
    g = tables.supplier_part(spark, sf)
    lists = g.edges.groupBy("src").agg(F.sort_array(F.collect_list("dst")).alias("adj"))
    out = g.nodes.join(lists, F.col("id") == F.col("src")).withColumn("bytes", codecs.encode_column("id", "adj"))
    return out.select("id", "weight", F.array_join(F.transform(codecs.decode_column("id", "bytes"), lambda x: x.cast("string")), " ").alias("adjacency"))


@query(sql(SUPP, select="SELECT * FROM edges"))
def metis_roundtrip(spark, sf):
    """The graph written as METIS text and read again."""
    path = f"{shared_dir(spark)}/metis-{uuid.uuid4().hex}"
    files.write_metis(tables.supplier_part(spark, sf).checkpointed(), path)
    return files.read_metis(spark, path).edges


@query("SELECT i * 20 + j AS src, i * 20 + j + d AS dst, CAST(1 AS BIGINT) AS weight FROM range(10) a(i), range(20) b(j), (VALUES (1), (-1), (20), (-20)) c(d) WHERE (d = 1 AND j < 19) OR (d = -1 AND j > 0) OR (d = 20 AND i < 9) OR (d = -20 AND i > 0)")
def generated_grid(spark, sf):
    return generators.grid(spark, 10, 20).edges


@query(sql(SUPP, "u AS (SELECT src, dst, weight FROM half UNION ALL SELECT src, dst, weight FROM half WHERE src % 2 = 0 UNION ALL SELECT dst, src, weight FROM half)", "b AS (SELECT * FROM u UNION ALL SELECT dst, src, weight FROM u)", select="SELECT src, dst, CAST(sum(weight) AS BIGINT) AS weight FROM b GROUP BY 1, 2"))
def undirected_union(spark, sf):
    """Edge lists in both directions with repeats, made into a graph."""
    half = tables.supplier_part(spark, sf).edges.filter(F.col("src") < F.col("dst"))
    turned = half.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight")
    return Graph.from_edges(half.unionByName(half.filter("src % 2 = 0")).unionByName(turned)).edges


@query(sql(ORD, COMP, "s AS (SELECT component, count(*) AS size FROM comp GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 1)", "k AS (SELECT id, CAST(row_number() OVER (ORDER BY id) - 1 AS BIGINT) AS new_id FROM comp JOIN s USING (component))", select="SELECT u.new_id AS src, v.new_id AS dst FROM edges JOIN k u ON u.id = src JOIN k v ON v.id = dst"))
def largest_component(spark, sf):
    return traversal.largest_component(tables.customer_orders(spark, sf).checkpointed())[0].edges.select("src", "dst")


@query(sql(SUPP, select="SELECT CAST(b AS INTEGER) AS block, count(id) AS size FROM range(6) t(b) LEFT JOIN part ON block = b GROUP BY 1"))
def partition_block_sizes(spark, sf):
    return transforms.block_sizes(spark, mod(tables.supplier_part(spark, sf)), 6)


@query(sql(SUPP, BROKEN, select="SELECT * FROM (SELECT 'edge without its reverse' AS problem, count(*) AS n FROM broken b WHERE NOT EXISTS (SELECT 1 FROM broken r WHERE r.src = b.dst AND r.dst = b.src AND r.weight = b.weight) UNION ALL SELECT 'repeated edge', count(*) FROM (SELECT 1 FROM broken GROUP BY src, dst HAVING count(*) > 1)) WHERE n > 0"))
def validate_graph(spark, sf):
    g = tables.supplier_part(spark, sf)
    return select.invalid(Graph(g.nodes, broken(g)))


@query(sql(SUPP, "walk(id, hop) AS (SELECT CAST(0 AS BIGINT), 0 UNION SELECT dst, hop + 1 FROM walk JOIN edges ON src = id WHERE hop < 1)", "ins AS (SELECT DISTINCT id FROM walk)", "e AS (SELECT src, CASE WHEN i.id IS NULL THEN -1 - block ELSE dst END AS dst, weight FROM edges JOIN ins o ON o.id = src LEFT JOIN ins i ON i.id = dst JOIN part ON part.id = dst)", "k AS (SELECT src, dst, CAST(sum(weight) AS BIGINT) AS weight FROM e GROUP BY 1, 2)", select="SELECT * FROM k UNION ALL SELECT dst, src, weight FROM k WHERE dst < 0"))
def contracted_ball(spark, sf):
    """Everything within one hop of node 0; the rest of each block is one pseudo-node."""
    g = tables.supplier_part(spark, sf).checkpointed()
    return traversal.ball(g, g.nodes.filter("id = 0"), 1, mod(g), "contract").edges


@query(sql(SUPP, CUTS, CONN, GAIN, select="""SELECT id, "to", CASE WHEN gain > 0 THEN -1 WHEN gain = 0 THEN 0 ELSE CAST(length(bin(1 - gain)) - 1 + CAST(1 - gain > 1 << (length(bin(1 - gain)) - 1) AS INT) AS BIGINT) END AS bucket FROM gains"""))
def loss_buckets(spark, sf):
    """Moves by the size of their loss: 0 for none, then by powers of two, exactly."""
    g = tables.supplier_part(spark, sf)
    loss = F.lit(1) - F.col("gain")
    up = I.floor_log2_column(loss)
    bucket = F.when(F.col("gain") > 0, F.lit(-1)).when(F.col("gain") == 0, F.lit(0)).otherwise(up + (loss > F.expr("shiftleft(1L, length(bin(1 - gain)) - 1)")).cast("int"))
    return metrics.gains(g.edges, mod(g)).select("id", "to", bucket.cast("long").alias("bucket"))


def cluster_invariants(g: Graph, clusters: DataFrame, most: int) -> DataFrame:
    """Every node in one cluster, none heavier than allowed, no cluster of nodes that are in no other, fewer clusters than nodes."""
    clusters = checkpointed(clusters)
    w = clustering.cluster_weights(g, clusters).agg(F.max("cluster_weight").alias("heaviest"), F.count("*").alias("clusters"))
    n = clusters.agg(F.count("*").alias("nodes"), F.count_distinct("id").alias("ids"))
    return n.join(F.broadcast(w)).select("nodes", "ids", (F.col("heaviest") <= most).alias("within_limit"), (F.col("clusters") < F.col("nodes") * 0.9).alias("shrinks"))


CLUSTERED = "SELECT count(*) AS nodes, count(*) AS ids, true AS within_limit, true AS shrinks FROM nodes"


@query(sql(SUPP, select=CLUSTERED))
def clusters_lp(spark, sf):
    g = tables.supplier_part(spark, sf).checkpointed()
    most = max(g.n() // 16, 2)
    return cluster_invariants(g, clustering.LabelPropagation()(g, most), most)


@query(sql(ORD, select=CLUSTERED))
def clusters_lp_hubs(spark, sf):
    """Two phases: nodes of more than eight neighbours move in supersteps of their own."""
    g = tables.customer_orders(spark, sf).checkpointed()
    return cluster_invariants(g, clustering.LabelPropagation(rounds=3, hub_degree=8, max_degree=100_000)(g, 12), 12)


@query(sql(ORD, select=CLUSTERED))
def clusters_hem(spark, sf):
    g = tables.customer_orders(spark, sf).checkpointed()
    return cluster_invariants(g, clustering.hem_or_lp(g, 8), 8)


@query(sql(ORD, select=CLUSTERED))
def clusters_overlaid(spark, sf):
    g = tables.customer_orders(spark, sf).checkpointed()
    return cluster_invariants(g, clustering.overlaid(g, 12, 1, clustering.LabelPropagation(rounds=2)), 12)


@query(sql(SUPP, select="SELECT count(*) AS nodes, CAST(0 AS BIGINT) AS improper, true AS few_colors FROM nodes"))
def greedy_coloring(spark, sf):
    """A proper colouring of the whole graph, with no more colours than the largest degree and one."""
    g = tables.supplier_part(spark, sf).checkpointed()
    colors = checkpointed(refinement.coloring(g))
    bad = metrics.with_blocks(g.edges, colors, "color").filter("bu = bv").agg(F.count("*").alias("improper"))
    most = metrics.degrees(g).agg(F.max("degree").alias("d"))
    used = colors.agg(F.count("*").alias("nodes"), F.max("color").alias("c"))
    return used.join(F.broadcast(bad)).join(F.broadcast(most)).select("nodes", "improper", (F.col("c") <= F.col("d")).alias("few_colors"))


def _limits(spark, g):
    return metrics.limits(spark, K, g.total_node_weight(), epsilon=0.03)


def refined(graph: str) -> str:
    return held(graph)


@query(refined(COP))
def refine_lp(spark, sf):
    g = tables.copurchase(spark, sf).checkpointed()
    return invariants(g, refinement.lp_refine(g, checkpointed(mod(g)), _limits(spark, g), K))


@query(refined(COP))
def refine_jet(spark, sf):
    g = tables.copurchase(spark, sf).checkpointed()
    return invariants(g, refinement.jet(g, checkpointed(mod(g)), _limits(spark, g), K, fruitless=2, most=3))


@query(refined(ORD))
def refine_colored(spark, sf):
    """Colour after colour: no two neighbours move at once."""
    g = tables.customer_orders(spark, sf).checkpointed()
    colors = checkpointed(refinement.coloring(g))
    return invariants(g, refinement.colored_lp_refine(g, checkpointed(mod(g)), _limits(spark, g), K, colors, rounds=2))


BALANCED = f"SELECT count(*) AS nodes, CAST({K} AS BIGINT) AS used, true AS complete, true AS feasible FROM nodes"


def balanced(g: Graph, part: DataFrame, upper: int, lower: int = 0) -> DataFrame:
    part = checkpointed(part)
    w = metrics.block_weights(g, part, K).agg(F.max("weight").alias("most"), F.min("weight").alias("least"))
    return metrics.partition_properties(g, part).join(F.broadcast(w)).select(F.lit(g.n()).cast("long").alias("nodes"), "used", "complete", ((F.col("most") <= upper) & (F.col("least") >= lower)).alias("feasible"))


def skewed(g: Graph) -> DataFrame:
    return checkpointed(g.nodes.select("id", F.when(F.col("id") % 3 == 0, F.col("id") % K).otherwise(F.lit(0)).cast("int").alias("block")))


@query(sql(SUPP, select=BALANCED))
def balance_overload(spark, sf):
    g = tables.supplier_part(spark, sf).checkpointed()
    return balanced(g, refinement.balance_overload(g, skewed(g), _limits(spark, g), K), int(1.03 * -(-g.n() // K)))


@query(sql(SUPP, select=BALANCED))
def balance_underload(spark, sf):
    """Every block is brought to nine tenths of its share at least."""
    g = tables.supplier_part(spark, sf).checkpointed()
    low = g.n() // K * 9 // 10
    lim = spark.createDataFrame([(b, low, g.n()) for b in range(K)], "block int, min_weight long, max_weight long")
    return balanced(g, refinement.balance_underload(g, skewed(g), lim, K), g.n(), low)


@query(sql(ORD, select=BALANCED))
def balance_clusters(spark, sf):
    """Move sets of overloaded blocks are balanced like nodes; single nodes finish."""
    g = tables.customer_orders(spark, sf).checkpointed()
    return balanced(g, refinement.cluster_balance(g, skewed(g), _limits(spark, g), K, rounds=2), int(1.03 * -(-g.n() // K)))


def more() -> None:
    """The queries of the other module register themselves."""
    from . import registry_parts  # noqa: F401


more()
