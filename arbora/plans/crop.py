"""Queries over crop plans, and their oracles.

The segments are all orders, as a heap by their keys; a segment's take-off is measured on its order's points. The main vessels are the ways down the left and the
right side of the heap for a few branchings.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from arbora import schema
from arbora.functions.statistics import rounded
from arbora.operators import crop as C
from arbora.operators.forest import strahler
from arbora.plans.forest import _CLOSURE, _STRAHLER
from arbora.session import stash, table

FACTOR, ORDER, RADIUS, RATIO = 0.2, 3, 25.0, 0.7
VESSELS = {"left": (1, 3, 7, 15, 31), "right": (2, 6, 14, 30)}
DROPPED, PRUNED = (62, 8, 3), (17, 30, 129)


def _tree(spark, d):
    return stash(table(spark, d, "orders").select(F.col("o_orderkey").alias("node"), F.when(F.col("o_orderkey") > 0, F.expr("(o_orderkey - 1) div 2")).alias("parent")), "tree")


def _measured(spark, d, tree):
    """The segments of a tree with the radii at their take-offs."""
    radii = C.takeoff_radius(schema.points(spark, d), FACTOR)
    return tree.join(radii.withColumnRenamed("edge_id", "node").hint("merge"), "node", "left")


def _segments(spark, d):
    tree = _tree(spark, d)
    return stash(_measured(spark, d, tree).join(strahler(tree).select("node", "strahler").hint("merge"), "node"), "segments")


def _named(spark):
    return spark.createDataFrame([(n, v) for v, nodes in VESSELS.items() for n in nodes], "node long, vessel string")


def takeoff_radii(spark, d):
    return rounded(C.takeoff_radius(schema.points(spark, d), FACTOR))


def vessel_ostia(spark, d):
    return rounded(C.vessel_ostia(_measured(spark, d, _tree(spark, d)), _named(spark)))


def _plan(spark, d, tree):
    marks = lambda ids: spark.createDataFrame([(i,) for i in ids], "node long")
    return C.crop_plan(tree, _named(spark), ORDER, RADIUS, RATIO, False, marks(DROPPED), marks(PRUNED))


def crop_plan(spark, d):
    """One row a segment, with the first rule that drops it."""
    return rounded(_plan(spark, d, _segments(spark, d)))


def crop_counts(spark, d):
    tree = _segments(spark, d)
    return C.crop_counts(stash(_plan(spark, d, tree), "plan"), tree)


_NAMED = "named AS (SELECT * FROM (VALUES " + ", ".join(f"(CAST({n} AS BIGINT), '{v}')" for v, nodes in VESSELS.items() for n in nodes) + ") v(node, vessel))"
_TAKEOFF = f"""lengths AS (SELECT edge_id, pos, r, sum(step) OVER (PARTITION BY edge_id ORDER BY pos) AS s, first_value(r) OVER (PARTITION BY edge_id ORDER BY pos) AS r0 FROM (
  SELECT *, coalesce(sqrt((x - lag(x) OVER w) ** 2 + (y - lag(y) OVER w) ** 2 + (z - lag(z) OVER w) ** 2), 0) AS step FROM points WINDOW w AS (PARTITION BY edge_id ORDER BY pos))),
takeoffs AS (SELECT edge_id, arg_min(r, {{s: s, pos: pos}}) AS takeoff FROM (SELECT *, max(s) OVER (PARTITION BY edge_id) AS size FROM lengths) WHERE s >= least({FACTOR} * r0, size) GROUP BY edge_id)"""
_PLAN = f"""tree AS (SELECT o_orderkey AS node, CASE WHEN o_orderkey > 0 THEN (o_orderkey - 1) // 2 END AS parent FROM orders),
{_TAKEOFF}, {_NAMED}, {_CLOSURE.replace("paths(", "paths_(", 1).replace("paths p", "paths_ p")}, paths AS MATERIALIZED (FROM paths_)"""
_RULES = f"""segs AS MATERIALIZED (SELECT t.node, t.parent, k.takeoff, o.strahler, o.depth FROM tree t JOIN ranks o USING (node) LEFT JOIN takeoffs k ON k.edge_id = t.node),
guard AS (SELECT DISTINCT ancestor AS node FROM paths JOIN named USING (node)),
belongs AS (SELECT p.node, arg_min(n.vessel, hops) AS vessel FROM paths p JOIN named n ON n.node = p.ancestor GROUP BY p.node),
ostia AS MATERIALIZED (SELECT vessel, arg_min(node, {{d: depth, n: node}}) AS node, arg_min({{t: takeoff}}, {{d: depth, n: node}}).t AS ostium, min(depth) AS depth, count(*) AS n_segments FROM named JOIN segs USING (node) GROUP BY vessel),
judged AS MATERIALIZED (SELECT s.node, s.parent, s.depth, takeoff, b.vessel, {RATIO} * ostium AS threshold, s.parent IS NULL OR g.node IS NOT NULL AS protected,
  CASE WHEN s.parent IS NULL OR g.node IS NOT NULL THEN NULL WHEN strahler < {ORDER} THEN 'strahler' WHEN takeoff < {RADIUS} THEN 'radius' WHEN takeoff < {RATIO} * ostium THEN 'ratio' END AS own
  FROM segs s LEFT JOIN guard g USING (node) LEFT JOIN belongs b USING (node) LEFT JOIN ostia o ON o.vessel = b.vessel),
tops AS (SELECT p.node, arg_max(j.node, hops) AS top FROM paths p JOIN judged j ON j.node = p.ancestor WHERE own IS NOT NULL GROUP BY p.node),
hands AS (SELECT p.node, arg_max(j.node, hops) AS hand_top FROM paths p JOIN judged j ON j.node = p.ancestor WHERE NOT protected AND j.node IN {PRUNED} GROUP BY p.node),
sizes AS (SELECT ancestor AS node, count(*) AS n FROM paths GROUP BY ancestor),
planned AS MATERIALIZED (SELECT j.node, j.parent, coalesce(u.own, CASE WHEN j.node IN {DROPPED} AND NOT j.protected THEN 'hand' END, CASE WHEN hand_top IS NOT NULL THEN 'hand-subtree' END) AS rule,
  coalesce(t.top, CASE WHEN j.node IN {DROPPED} AND NOT j.protected THEN j.node END, hand_top) AS takeoff_node, CASE WHEN t.top = j.node AND j.own = 'ratio' THEN j.vessel END AS vessel,
  CASE WHEN t.top = j.node AND j.own <> 'strahler' THEN j.takeoff END AS radius, CASE WHEN t.top = j.node THEN CASE j.own WHEN 'radius' THEN {RADIUS} WHEN 'ratio' THEN j.threshold END END AS threshold, j.protected, n
  FROM judged j LEFT JOIN tops t USING (node) LEFT JOIN judged u ON u.node = t.top LEFT JOIN hands USING (node) JOIN sizes USING (node))"""
# a perfect heap's orders follow from the levels below, counted as in strahler_orders
_RANKS = _STRAHLER.partition("orders AS")[0].replace(_CLOSURE + ",\n", "", 1) + "ranks AS MATERIALIZED (SELECT" + _STRAHLER.partition("orders AS (SELECT")[2]
_ROWS = "SELECT node, rule, takeoff_node, vessel, round(radius, 6) AS radius, round(threshold, 6) AS threshold, protected, CASE WHEN takeoff_node = node THEN CASE WHEN rule = 'hand' THEN 1 ELSE n END END AS n_subtree FROM planned"
_COUNTS = "SELECT count(*) AS n_before, count(*) FILTER (rule IS NULL) AS n_after, " + ", ".join(f"count(*) FILTER (rule = '{r}' AND takeoff_node = node) AS n_{r.replace('-', '_')}" for r in ("strahler", "radius", "ratio", "unattributed", "hand", "hand-subtree")) + ", count(*) FILTER (rule IS NULL AND (parent IS NULL OR parent IN (SELECT node FROM planned WHERE rule IS NOT NULL))) AS n_parts FROM planned"

QUERIES = {f.__name__: f for f in (takeoff_radii, vessel_ostia, crop_plan, crop_counts)}
ORACLES = {
    "takeoff_radii": schema.sql("SELECT edge_id, round(takeoff, 6) AS takeoff FROM takeoffs", "points", more=_TAKEOFF),
    "vessel_ostia": schema.sql("SELECT vessel, node, round(ostium, 6) AS ostium, depth, n_segments FROM ostia", "points", more=", ".join([_PLAN, _RANKS, _RULES]), recursive=True),
    "crop_plan": schema.sql(_ROWS, "points", more=", ".join([_PLAN, _RANKS, _RULES]), recursive=True),
    "crop_counts": schema.sql(_COUNTS, "points", more=", ".join([_PLAN, _RANKS, _RULES]), recursive=True),
}
