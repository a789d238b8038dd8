"""Queries over trees and graphs, and their oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from arbora import schema
from arbora.functions.statistics import rounded
from arbora.operators import forest as T
from arbora.operators.upward import subtree_sums
from arbora.session import table


def _edges(spark, d):
    """The graph between parts and suppliers: an edge for each pair that occurs in any line."""
    return _pairs(table(spark, d, "lineitem"))


def _pairs(rows):
    return rows.select((F.col("l_partkey") * 2).alias("src"), (F.col("l_suppkey") * 2 + 1).alias("dst")).distinct()


def whole_node_degrees(spark, d):
    return T.degrees(_edges(spark, d))


def whole_degree_histogram(spark, d):
    return _histogram(_edges(spark, d))


def whole_graph_components(spark, d):
    return T.components(_edges(spark, d))


def whole_component_sizes(spark, d):
    return _sizes(_edges(spark, d))


def whole_cycle_count(spark, d):
    return _cycles(_edges(spark, d))


def node_degrees(spark, d):
    return T.degrees(_edges(spark, d))


def degree_histogram(spark, d):
    return _histogram(_edges(spark, d))


def _histogram(edges):
    return T.degrees(edges).groupBy("degree").agg(F.count("*").alias("n_nodes"))


def tree_levels(spark, d):
    return T.levels(schema.tree(spark, d))


def strahler_orders(spark, d):
    return T.strahler(schema.tree(spark, d))


def strahler_summary(spark, d):
    own = T.strahler(schema.tree(spark, d)).join(schema.tree(spark, d), "node")
    return rounded(own.groupBy("strahler").agg(F.count("*").alias("n"), F.avg("radius").alias("radius"), F.max("depth").alias("deepest")))


def ancestors(spark, d):
    return T.closure(schema.tree(spark, d))


def subtree_sizes(spark, d):
    t = schema.tree(spark, d)
    leaf = t.join(t.where("parent is not null").select(F.col("parent").alias("node")).distinct().withColumn("inner", F.lit(1)), "node", "left").select("node", "radius", "parent", F.when(F.col("inner").isNull(), 1).otherwise(0).alias("tips"))
    return rounded(subtree_sums(leaf, ["radius", "tips"]))


def exponent_points(spark, d):
    """Log tip count against log radius of inner nodes: slope by least squares and reduced major axis."""
    s = subtree_sizes(spark, d).select("node", "tips").join(schema.tree(spark, d), "node").where("tips > 1").select(F.log("radius").alias("x"), F.log("tips").alias("y"))
    y, x = F.col("y"), F.col("x")
    return rounded(s.agg(F.count("*").alias("n"), F.regr_slope(y, x).alias("slope"), (F.when(F.corr(y, x) < 0, -1.0).otherwise(1.0) * F.sqrt(F.regr_syy(y, x) / F.regr_sxx(y, x))).alias("rma")))


def descent(spark, d):
    """The nearest ancestor whose key is a multiple of seven, and how far it is."""
    t = schema.tree(spark, d)
    marked = t.where("node % 7 = 0").select("node", F.col("node").alias("vessel"))
    return T.nearest_above(t, marked, "vessel")


def flow_fractions(spark, d):
    return rounded(T.flow_split(schema.tree(spark, d)), 9)


def outlet_fractions(spark, d):
    """Flow of the leaves summed to the deepest cut (a node at depth 4) on their way to the root."""
    t = schema.tree(spark, d)
    leaves = t.join(t.select(F.col("parent").alias("node")).where("node is not null").distinct(), "node", "left_anti")
    cuts = T.levels(t).where("depth = 4").select("node", F.col("node").alias("cut"))
    own = T.nearest_above(t, cuts, "cut").join(leaves.select("node"), "node").join(T.flow_split(t), "node")
    total = own.groupBy("cut").agg(F.sum("flow").alias("flow"), F.count("*").alias("n_leaves"))
    whole = total.agg(F.sum("flow").alias("whole"))
    return rounded(total.crossJoin(F.broadcast(whole)).select("cut", "n_leaves", (F.col("flow") / F.col("whole")).alias("fraction")), 9)  # whole is one row


def crop_walk(spark, d):
    return T.walk_until(schema.tree(spark, d), "node > 20 and radius < 9.7 and node % 3 = 0")


def prune_terminals(spark, d):
    return T.prune_terminals(schema.tree(spark, d), "node % 5 < 3").select("node", "parent")


def contract(spark, d):
    t = T.prune_terminals(schema.tree(spark, d), "node % 5 < 3")
    return rounded(T.contract_chains(t, "radius"))


def graph_components(spark, d):
    return T.components(_edges(spark, d))


def component_sizes(spark, d):
    return _sizes(_edges(spark, d))


def _sizes(edges):
    """Components and the share of the largest each has."""
    n = T.components(edges).groupBy("component").agg(F.count("*").alias("n_nodes"))
    top = n.agg(F.max("n_nodes").alias("top"))
    return rounded(n.crossJoin(F.broadcast(top)).select("component", "n_nodes", (F.col("n_nodes") / F.col("top")).alias("share")))  # top is one row


def cycle_count(spark, d):
    return _cycles(_edges(spark, d))


def _cycles(e):
    c = T.components(e)
    return e.agg(F.count("*").alias("n_edges")).crossJoin(c.agg(F.count("*").alias("n_nodes"), F.countDistinct("component").alias("n_components"))).withColumn("cycles", F.col("n_edges") - F.col("n_nodes") + F.col("n_components"))  # one row each


def murray(spark, d):
    """Cubes of radii at every node with children: the parent's and the sum of the children's."""
    t = schema.tree(spark, d)
    kids = t.where("parent is not null").groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("n"), F.sum("radius").alias("sum_child"), F.sum(F.col("radius") ** 3).alias("cube_child"))
    return rounded(t.join(kids, "node").where("parent is not null").select("node", "radius", (F.col("radius") ** 3).alias("cube_parent"), "n", "sum_child", "cube_child", (F.col("cube_child") / F.col("radius") ** 3).alias("ratio")), 7)


def element_pairs(spark, d):
    e = T.strahler(schema.tree(spark, d)).join(schema.tree(spark, d), "node").where("parent is not null").select(F.col("node").alias("edge_id"), F.col("parent").alias("src"), F.col("node").alias("dst"), "strahler")
    return T.elements(e)


def nation_forest(spark, d):
    """Customers below nations below regions: depth and root of every node of the forest."""
    c = table(spark, d, "customer").select((F.col("c_custkey") + 1000).alias("node"), (F.col("c_nationkey") + 100).cast("long").alias("parent"))
    n = table(spark, d, "nation").select((F.col("n_nationkey") + 100).cast("long").alias("node"), F.col("n_regionkey").cast("long").alias("parent"))
    r = table(spark, d, "region").select(F.col("r_regionkey").cast("long").alias("node"), F.lit(None).cast("long").alias("parent"))
    return T.levels(c.unionByName(n).unionByName(r)).groupBy("root", "depth").agg(F.count("*").alias("n"))


_LEVELS = "levels(node, depth, root) AS (SELECT node, CAST(0 AS BIGINT), node FROM tree WHERE parent IS NULL UNION ALL SELECT t.node, depth + 1, root FROM tree t JOIN levels l ON t.parent = l.node)"
_CLOSURE = "paths(node, ancestor, hops) AS (SELECT node, node, CAST(0 AS BIGINT) FROM tree UNION ALL SELECT p.node, t.parent, hops + 1 FROM paths p JOIN tree t ON t.node = p.ancestor WHERE t.parent IS NOT NULL)"
_SHARES = "shares AS (SELECT node, parent, CASE WHEN parent IS NULL THEN 1 ELSE pow(2 * radius, 2.27) / sum(pow(2 * radius, 2.27)) OVER (PARTITION BY parent) END AS share FROM tree)"
_FLOW = _SHARES + ", flows(node, flow) AS (SELECT node, CAST(1 AS DOUBLE) FROM shares WHERE parent IS NULL UNION ALL SELECT s.node, flow * share FROM shares s JOIN flows f ON s.parent = f.node)"
# A node of a binary tree has order k or more exactly if a perfect tree of height k - 1 can be embedded below it: of order k + 1 are nodes below two
# children of which descendants of order k are found. In rounds, as often as the deepest level asks for.
_ROUNDS = 12
_STRAHLER = _CLOSURE + """,
""" + _LEVELS + """,
o1 AS (SELECT node FROM tree),
""" + ",\n".join(f"o{k + 1} AS (SELECT DISTINCT p.ancestor AS node FROM paths p JOIN (SELECT t.parent AS node FROM tree t JOIN o{k} USING (node) WHERE t.parent IS NOT NULL GROUP BY t.parent HAVING count(*) >= 2) f ON f.node = p.node)" for k in range(1, _ROUNDS)) + """,
orders AS (SELECT l.node, l.depth, count(*) AS strahler FROM levels l JOIN (""" + " UNION ALL ".join(f"SELECT node FROM o{k}" for k in range(1, _ROUNDS + 1)) + """) o USING (node) GROUP BY l.node, l.depth)"""
_GRAPH = "graph AS (SELECT DISTINCT l_partkey * 2 AS src, l_suppkey * 2 + 1 AS dst FROM lineitem)"
_ENDS = f"WITH {_GRAPH}, ends AS (SELECT node, count(*) AS degree FROM (SELECT src AS node FROM graph UNION ALL SELECT dst FROM graph) GROUP BY node)"
# one row a node, of which a round keeps the smallest label that a neighbour has
SMALLEST = """both_ways AS (SELECT src AS u, dst AS v FROM graph UNION SELECT dst, src FROM graph),
comp(node, component) USING KEY (node) AS (SELECT u, min(least(u, v)) FROM both_ways GROUP BY u
  UNION SELECT b.u, min(c.component) FROM comp c JOIN both_ways b ON b.v = c.node JOIN recurring.comp r ON r.node = b.u WHERE c.component < r.component GROUP BY b.u)"""
_REACH = _GRAPH + ", " + SMALLEST


def _rec(body: str, more: str, *names: str) -> str:
    return schema.sql(body, *names, more=more, recursive=True)


QUERIES = {f.__name__: f for f in (node_degrees, degree_histogram, tree_levels, strahler_orders, strahler_summary, ancestors, subtree_sizes, exponent_points, descent, flow_fractions, outlet_fractions, crop_walk, prune_terminals, graph_components, component_sizes, cycle_count, murray, element_pairs, nation_forest, whole_node_degrees, whole_degree_histogram, whole_graph_components, whole_component_sizes, whole_cycle_count)} | {"contract_chains": contract}
_TIPS = _CLOSURE + ", sizes AS (SELECT ancestor AS node, count(*) AS n_nodes, sum(radius) AS radius, CAST(sum(CASE WHEN node NOT IN (SELECT parent FROM tree WHERE parent IS NOT NULL) THEN 1 ELSE 0 END) AS BIGINT) AS tips FROM paths JOIN tree USING (node) GROUP BY 1)"
ORACLES = {
    "node_degrees": f"{_ENDS} SELECT node, degree FROM ends",
    "degree_histogram": f"{_ENDS} SELECT degree, count(*) AS n_nodes FROM ends GROUP BY degree",
    "whole_node_degrees": f"{_ENDS} SELECT node, degree FROM ends",
    "whole_degree_histogram": f"{_ENDS} SELECT degree, count(*) AS n_nodes FROM ends GROUP BY degree",
    "tree_levels": _rec("SELECT * FROM levels", _LEVELS, "tree"),
    "strahler_orders": _rec("SELECT * FROM orders", _STRAHLER, "tree"),
    "strahler_summary": _rec("SELECT strahler, count(*) AS n, round(avg(radius), 6) AS radius, max(depth) AS deepest FROM orders JOIN tree USING (node) GROUP BY strahler", _STRAHLER, "tree"),
    "ancestors": _rec("SELECT * FROM paths", _CLOSURE, "tree"),
    "subtree_sizes": _rec("SELECT node, n_nodes, round(radius, 6) AS radius, tips FROM sizes", _TIPS, "tree"),
    "exponent_points": _rec("SELECT count(*) AS n, round(regr_slope(y, x), 6) AS slope, round(CASE WHEN corr(y, x) < 0 THEN -1 ELSE 1 END * sqrt(var_pop(y) / var_pop(x)), 6) AS rma FROM (SELECT ln(t.radius) AS x, ln(tips) AS y FROM sizes s JOIN tree t USING (node) WHERE tips > 1)", _TIPS, "tree"),
    "descent": _rec("SELECT node, arg_min(ancestor, hops) AS vessel, min(hops) AS hops FROM paths WHERE ancestor % 7 = 0 GROUP BY node", _CLOSURE, "tree"),
    "flow_fractions": _rec("SELECT node, round(flow, 9) AS flow FROM flows", _FLOW, "tree"),
    "outlet_fractions": _rec("SELECT cut, count(*) AS n_leaves, round(sum(flow) / sum(sum(flow)) OVER (), 9) AS fraction FROM (SELECT p.node, p.ancestor AS cut, flow FROM paths p JOIN levels l ON l.node = p.ancestor AND l.depth = 4 JOIN flows f ON f.node = p.node WHERE p.node NOT IN (SELECT parent FROM tree WHERE parent IS NOT NULL)) GROUP BY cut", ", ".join([_CLOSURE, _LEVELS, _FLOW]), "tree"),
    "crop_walk": _rec("SELECT * FROM walk", "flagged AS (SELECT *, node > 20 AND radius < 9.7 AND node % 3 = 0 AS rejected FROM tree), walk(node, rejected) AS (SELECT node, rejected FROM flagged WHERE parent IS NULL UNION ALL SELECT f.node, f.rejected FROM flagged f JOIN walk w ON f.parent = w.node WHERE NOT w.rejected)", "tree"),
    "prune_terminals": _rec("SELECT node, parent FROM tree WHERE parent IS NULL OR node IN (SELECT ancestor FROM paths WHERE node % 5 >= 3)", _CLOSURE, "tree"),
    "contract_chains": _rec("""SELECT node, parent, n AS n_merged, round(length, 6) AS length FROM (SELECT *, row_number() OVER (PARTITION BY node ORDER BY n DESC) AS k FROM up) WHERE k = 1""", _CLOSURE + """,
kept AS (SELECT node, parent, radius FROM tree WHERE parent IS NULL OR node IN (SELECT ancestor FROM paths WHERE node % 5 >= 3)),
kids AS (SELECT parent AS node, count(*) AS k FROM kept WHERE parent IS NOT NULL GROUP BY 1),
marked AS (SELECT kept.*, coalesce(k = 1 AND kept.parent IS NOT NULL, false) AS through FROM kept LEFT JOIN kids USING (node)),
up(node, parent, n, length) AS (SELECT node, parent, CAST(0 AS BIGINT), radius FROM marked WHERE NOT through UNION ALL SELECT u.node, m.parent, n + 1, u.length + m.radius FROM up u JOIN marked m ON m.node = u.parent WHERE m.through)""", "tree"),
    "graph_components": f"WITH RECURSIVE {_REACH} SELECT * FROM comp",
    "component_sizes": f"WITH RECURSIVE {_REACH} SELECT component, count(*) AS n_nodes, round(count(*) / max(count(*)) OVER (), 6) AS share FROM comp GROUP BY component",
    "cycle_count": f"WITH RECURSIVE {_REACH} SELECT n_edges, n_nodes, n_components, n_edges - n_nodes + n_components AS cycles FROM (SELECT count(*) AS n_edges FROM graph), (SELECT count(*) AS n_nodes, count(DISTINCT component) AS n_components FROM comp)",
    "whole_graph_components": f"WITH RECURSIVE {_REACH} SELECT * FROM comp",
    "whole_component_sizes": f"WITH RECURSIVE {_REACH} SELECT component, count(*) AS n_nodes, round(count(*) / max(count(*)) OVER (), 6) AS share FROM comp GROUP BY component",
    "whole_cycle_count": f"WITH RECURSIVE {_REACH} SELECT n_edges, n_nodes, n_components, n_edges - n_nodes + n_components AS cycles FROM (SELECT count(*) AS n_edges FROM graph), (SELECT count(*) AS n_nodes, count(DISTINCT component) AS n_components FROM comp)",
    "murray": schema.sql("SELECT t.node, round(t.radius, 7) AS radius, round(t.radius ** 3, 7) AS cube_parent, count(*) AS n, round(sum(c.radius), 7) AS sum_child, round(sum(c.radius ** 3), 7) AS cube_child, round(sum(c.radius ** 3) / t.radius ** 3, 7) AS ratio FROM tree t JOIN tree c ON c.parent = t.node WHERE t.parent IS NOT NULL GROUP BY t.node, t.radius", "tree"),
    "element_pairs": _rec("SELECT node, min(edge_id) AS a, max(edge_id) AS b FROM (SELECT *, max(strahler) OVER (PARTITION BY node) AS top FROM (SELECT node AS edge_id, strahler, parent AS node FROM orders JOIN tree USING (node) WHERE parent IS NOT NULL UNION ALL SELECT node, strahler, node FROM orders JOIN tree USING (node) WHERE parent IS NOT NULL)) WHERE strahler = top GROUP BY node HAVING count(*) = 2", _STRAHLER, "tree"),
    "nation_forest": "SELECT r_regionkey AS root, CAST(0 AS BIGINT) AS depth, count(*) AS n FROM region GROUP BY 1 UNION ALL SELECT n_regionkey, 1, count(*) FROM nation GROUP BY 1 UNION ALL SELECT n_regionkey, 2, count(*) FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1",
}
