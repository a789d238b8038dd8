"""Queries of folds from the leaves to the root over the heap of parts, and their oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from arbora import schema
from arbora.functions.statistics import rounded
from arbora.operators import upward as U
from arbora.plans.forest import _CLOSURE, _STRAHLER, _rec

OUTLET, PRESSURE, THICK = 2.0, 100.0, 19.0
DEEPEST = 24


def folded_orders(spark, d):
    return U.strahler(schema.tree(spark, d))


def downstream_lengths(spark, d):
    return rounded(U.downstream(schema.tree(spark, d), "radius"))


def holding_thick(spark, d):
    return U.holding(schema.tree(spark, d), f"radius > {THICK}")


def network_flow(spark, d):
    return rounded(U.network(schema.tree(spark, d).withColumn("outlet", F.lit(OUTLET)), "radius", "outlet", PRESSURE), 8)


def bifurcation_levels(spark, d):
    return U.bifurcation_levels(schema.tree(spark, d))


def distal_terminals(spark, d):
    return rounded(U.distal_terminals(schema.tree(spark, d), "radius"))


_DIST = "ways(node, depth, root, dist) AS (SELECT node, CAST(0 AS BIGINT), node, radius FROM tree WHERE parent IS NULL UNION ALL SELECT t.node, depth + 1, root, dist + radius FROM tree t JOIN ways w ON t.parent = w.node)"
_LEAVES = "leaves AS (SELECT * FROM ways WHERE node NOT IN (SELECT parent FROM tree WHERE parent IS NOT NULL))"
# from the deepest level up; deeper heaps than DEEPEST levels need more of these steps
_TOTALS = _DIST + f""",
t{DEEPEST} AS (SELECT node, parent, radius AS r, radius + {OUTLET} AS total FROM tree JOIN ways USING (node) WHERE depth = {DEEPEST})""" + "".join(
    f""",
t{k} AS (SELECT t.node, t.parent, t.radius AS r, t.radius + coalesce(1 / g, {OUTLET}) AS total FROM tree t JOIN ways w USING (node) LEFT JOIN (SELECT parent AS node, sum(1 / total) AS g FROM t{k + 1} GROUP BY parent) USING (node) WHERE depth = {k})"""
    for k in range(DEEPEST - 1, -1, -1)
) + """,
totals AS (""" + " UNION ALL ".join(f"SELECT * FROM t{k}" for k in range(DEEPEST + 1)) + f"""),
shares AS (SELECT *, (1 / total) / sum(1 / total) OVER (PARTITION BY parent) AS share FROM totals),
flows(node, total, r, flow) AS (SELECT node, total, r, {PRESSURE} / total FROM shares WHERE parent IS NULL UNION ALL SELECT s.node, s.total, s.r, f.flow * s.share FROM shares s JOIN flows f ON s.parent = f.node)"""

QUERIES = {f.__name__: f for f in (folded_orders, downstream_lengths, holding_thick, network_flow, bifurcation_levels, distal_terminals)}
ORACLES = {
    "folded_orders": _rec("SELECT * FROM orders", _STRAHLER, "tree"),
    "downstream_lengths": _rec("SELECT p.ancestor AS node, round(max(b.dist) - any_value(a.dist) + any_value(t.radius), 6) AS downstream FROM paths p JOIN ways a ON a.node = p.ancestor JOIN ways b ON b.node = p.node JOIN tree t ON t.node = p.ancestor GROUP BY p.ancestor", f"{_CLOSURE}, {_DIST}", "tree"),
    "holding_thick": _rec(f"SELECT p.ancestor AS node, bool_or(t.radius > {THICK}) AS holds FROM paths p JOIN tree t USING (node) GROUP BY p.ancestor", _CLOSURE, "tree"),
    "network_flow": _rec("SELECT node, round(total, 8) AS total, round(flow, 8) AS flow, round(flow * (total - r), 8) AS pressure FROM flows", _TOTALS, "tree"),
    "bifurcation_levels": _rec("SELECT node, level FROM met", "kids AS (SELECT parent AS node, count(*) AS k FROM tree WHERE parent IS NOT NULL GROUP BY 1), forks AS (SELECT node, parent, CAST(coalesce(k, 0) + CASE WHEN parent IS NULL THEN 0 ELSE 1 END >= 3 AS BIGINT) AS fork FROM tree LEFT JOIN kids USING (node)), met(node, level) AS (SELECT node, fork FROM forks WHERE parent IS NULL UNION ALL SELECT f.node, level + fork FROM forks f JOIN met m ON m.node = f.parent)", "tree"),
    "distal_terminals": _rec("SELECT root, node, round(dist, 6) AS dist FROM leaves QUALIFY row_number() OVER (PARTITION BY root ORDER BY round(dist, 9) DESC, node) = 1", f"{_DIST}, {_LEAVES}", "tree"),
}
