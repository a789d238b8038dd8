"""Queries over voxel runs, and their oracles."""

from __future__ import annotations

from arbora import schema
from arbora.operators import voxels as V
from arbora.operators.proximity import voxels
from arbora.session import stash


def _runs(spark, d):
    return V.encode(voxels(schema.points(spark, d), 1.0))


def mask_runs(spark, d):
    return V.encode(voxels(schema.points(spark, d), 1.0))


def mask_round_trip(spark, d):
    return V.decode(mask_runs(spark, d))


def mask_components(spark, d):
    return V.label(_runs(spark, d))


def mask_component_sizes(spark, d):
    return V.sizes(V.label(_runs(spark, d)))


def mask_culled(spark, d):
    return V.cull_small(V.label(_runs(spark, d)), 4)


TREE = ["tree"]


def tree_mask_runs(spark, d):
    """A mask for each tree, of all points of its segments."""
    own = schema.points(spark, d).join(schema.edges(spark, d).select("edge_id", "tree"), "edge_id")
    return V.encode(voxels(own, 1.0, TREE), keys=TREE)


def tree_mask_round_trip(spark, d):
    return V.decode(tree_mask_runs(spark, d), TREE)


def _labelled(spark, d):
    return V.label(stash(tree_mask_runs(spark, d), "runs"), TREE)


def tree_mask_components(spark, d):
    return _labelled(spark, d)


def tree_mask_component_sizes(spark, d):
    return V.sizes(_labelled(spark, d), TREE)


def tree_mask_culled(spark, d):
    return V.cull_small(_labelled(spark, d), 4, TREE)


_VOX = ("vox AS (SELECT DISTINCT CAST(floor(x) AS BIGINT) AS vx, CAST(floor(y) AS BIGINT) AS vy, CAST(floor(z) AS BIGINT) AS vz FROM points), runs AS (SELECT vz AS z, vy AS y, min(vx) AS x0, max(vx) + 1 AS x1 FROM (SELECT *, vx - row_number() OVER (PARTITION BY vz, vy ORDER BY vx) AS g FROM vox) GROUP BY vz, vy, g)")

_LABEL = _VOX + """,
named AS (SELECT *, z * 1000000000000 + y * 1000000 + x0 AS node FROM runs),
touch AS (SELECT a.node AS u, b.node AS v FROM named a JOIN named b ON abs(a.z - b.z) <= 1 AND abs(a.y - b.y) <= 1 AND a.x1 + 1 > b.x0 AND b.x1 + 1 > a.x0),
reach(node, seen) AS (SELECT node, node FROM named UNION SELECT t.v, r.seen FROM reach r JOIN touch t ON t.u = r.node),
labelled AS (SELECT n.z, n.y, n.x0, n.x1, l.label FROM named n JOIN (SELECT node, min(seen) AS label FROM reach GROUP BY node) l USING (node)),
sized AS (SELECT label, CAST(sum(x1 - x0) AS BIGINT) AS n_voxels, count(*) AS n_runs, min(z) AS z_low, max(z) AS z_high, min(y) AS y_low, max(y) AS y_high, min(x0) AS x_low, max(x1) - 1 AS x_high FROM labelled GROUP BY label)"""

_TREE_VOX = "vox AS (SELECT DISTINCT tree, CAST(floor(x) AS BIGINT) AS vx, CAST(floor(y) AS BIGINT) AS vy, CAST(floor(z) AS BIGINT) AS vz FROM points JOIN edges USING (edge_id)), runs AS (SELECT tree, vz AS z, vy AS y, min(vx) AS x0, max(vx) + 1 AS x1 FROM (SELECT *, vx - row_number() OVER (PARTITION BY tree, vz, vy ORDER BY vx) AS g FROM vox) GROUP BY tree, vz, vy, g)"
_TREE_LABEL = _TREE_VOX + """,
named AS (SELECT *, z * 1000000000000 + y * 1000000 + x0 AS node FROM runs),
touch AS (SELECT a.tree, a.node AS u, b.node AS v FROM named a JOIN named b ON a.tree = b.tree AND abs(a.z - b.z) <= 1 AND abs(a.y - b.y) <= 1 AND a.x1 + 1 > b.x0 AND b.x1 + 1 > a.x0),
reach(tree, node, seen) AS (SELECT tree, node, node FROM named UNION SELECT t.tree, t.v, r.seen FROM reach r JOIN touch t ON t.tree = r.tree AND t.u = r.node),
labelled AS (SELECT n.tree, n.z, n.y, n.x0, n.x1, l.label FROM named n JOIN (SELECT tree, node, min(seen) AS label FROM reach GROUP BY tree, node) l USING (tree, node)),
sized AS (SELECT tree, label, CAST(sum(x1 - x0) AS BIGINT) AS n_voxels, count(*) AS n_runs, min(z) AS z_low, max(z) AS z_high, min(y) AS y_low, max(y) AS y_high, min(x0) AS x_low, max(x1) - 1 AS x_high FROM labelled GROUP BY tree, label)"""

QUERIES = {f.__name__: f for f in (mask_runs, mask_round_trip, mask_components, mask_component_sizes, mask_culled, tree_mask_runs, tree_mask_round_trip, tree_mask_components, tree_mask_component_sizes, tree_mask_culled)}
ORACLES = {
    "mask_runs": schema.sql("SELECT z, y, x0, x1 FROM runs", "points", more=_VOX),
    "mask_round_trip": schema.sql("SELECT vx, vy, vz FROM vox", "points", more=_VOX),
    "mask_components": schema.sql("SELECT * FROM labelled", "points", more=_LABEL, recursive=True),
    "mask_component_sizes": schema.sql("SELECT * FROM sized", "points", more=_LABEL, recursive=True),
    "mask_culled": schema.sql("SELECT l.* FROM labelled l JOIN sized s USING (label) WHERE n_voxels >= 4", "points", more=_LABEL, recursive=True),
    "tree_mask_runs": schema.sql("SELECT tree, z, y, x0, x1 FROM runs", "points", "edges", more=_TREE_VOX),
    "tree_mask_round_trip": schema.sql("SELECT tree, vx, vy, vz FROM vox", "points", "edges", more=_TREE_VOX),
    "tree_mask_components": schema.sql("SELECT * FROM labelled", "points", "edges", more=_TREE_LABEL, recursive=True),
    "tree_mask_component_sizes": schema.sql("SELECT * FROM sized", "points", "edges", more=_TREE_LABEL, recursive=True),
    "tree_mask_culled": schema.sql("SELECT l.* FROM labelled l JOIN sized s USING (tree, label) WHERE n_voxels >= 4", "points", "edges", more=_TREE_LABEL, recursive=True),
}
