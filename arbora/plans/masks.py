"""Queries over the topology, closing and distances of masks, and their oracles, which count voxels one by one.

SQL is too slow for tree_mask_betti on whole tables (the background's components); tests hold its operator against brute force.

A tree's thick mask has voxels of THICK units, those of its points and their neighbours, so that it has solid parts.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from arbora import schema
from arbora.functions.statistics import rounded
from arbora.operators import masks as K
from arbora.operators import voxels as V
from arbora.operators.proximity import voxels
from arbora.plans.voxels import TREE, _TREE_VOX, tree_mask_runs
from arbora.session import stash

THICK, RADIUS, SPACING = 5.0, 2, (1.0, 1.5, 2.0)


def thick_runs(spark, d):
    own = schema.points(spark, d).join(schema.edges(spark, d).select("edge_id", "tree"), "edge_id")
    return stash(K.dilated(V.encode(voxels(own, THICK, TREE), keys=TREE), 1, TREE), "thick")


def tree_mask_euler(spark, d):
    return K.euler(tree_mask_runs(spark, d), TREE)


def tree_mask_betti(spark, d):
    return K.betti(thick_runs(spark, d), TREE)


def tree_mask_distances(spark, d):
    return rounded(K.squared_distances(thick_runs(spark, d), SPACING, TREE))


def tree_mask_closing(spark, d):
    """Voxels that closing adds to every thick mask."""
    return V.decode(K.closing_additions(thick_runs(spark, d), RADIUS, keys=TREE), TREE)


def tree_mask_cores(spark, d):
    """Voxels of every thick mask that erosion by one leaves."""
    return V.decode(K.eroded(thick_runs(spark, d), 1, TREE), TREE)


def lumen_radii(spark, d):
    """At every point the distance to the outside of its tree's thick mask."""
    at = schema.points(spark, d).join(schema.edges(spark, d).select("edge_id", "tree"), "edge_id").select("tree", "edge_id", "pos", *(F.floor(F.col(c) / THICK).alias(f"v{c}") for c in "xyz"))
    return rounded(K.radii_at(at, thick_runs(spark, d), SPACING, TREE).select("edge_id", "pos", "radius"))


def _ball(r: int) -> str:
    side = ", ".join(f"({i})" for i in range(-r, r + 1))
    return f"(SELECT dx, dy, dz FROM (VALUES {side}) a(dx), (VALUES {side}) b(dy), (VALUES {side}) c(dz) WHERE dx * dx + dy * dy + dz * dz <= {r * r})"


_THICK = f"""cores AS (SELECT DISTINCT tree, CAST(floor(x / {THICK}) AS BIGINT) AS cx, CAST(floor(y / {THICK}) AS BIGINT) AS cy, CAST(floor(z / {THICK}) AS BIGINT) AS cz FROM points JOIN edges USING (edge_id)),
vox AS MATERIALIZED (SELECT DISTINCT tree, cx + dx AS vx, cy + dy AS vy, cz + dz AS vz FROM cores, {_ball(1)} o)"""
_CELLS = """SELECT tree, CAST(sum(CASE WHEN (abs(fx) % 2) + (abs(fy) % 2) + (abs(fz) % 2) IN (0, 2) THEN 1 ELSE -1 END) AS BIGINT) AS euler FROM (
  SELECT DISTINCT tree, 2 * vx + 1 + dx AS fx, 2 * vy + 1 + dy AS fy, 2 * vz + 1 + dz AS fz FROM vox, (VALUES (-1), (0), (1)) a(dx), (VALUES (-1), (0), (1)) b(dy), (VALUES (-1), (0), (1)) c(dz)) GROUP BY tree"""
_AROUND = """boxes AS (SELECT tree, min(vx) - 1 AS xa, max(vx) + 1 AS xb, min(vy) - 1 AS ya, max(vy) + 1 AS yb, min(vz) - 1 AS za, max(vz) + 1 AS zb FROM vox GROUP BY tree),
cells AS (SELECT tree, vx, vy, vz FROM (SELECT tree, unnest(range(xa, xb + 1)) AS vx, ya, yb, za, zb FROM boxes), LATERAL (SELECT unnest(range(ya, yb + 1)) AS vy), LATERAL (SELECT unnest(range(za, zb + 1)) AS vz)),
back AS MATERIALIZED (SELECT * FROM cells ANTI JOIN vox USING (tree, vx, vy, vz))"""
_D2 = "min(pow({0} * (v.vx - b.vx), 2) + pow({1} * (v.vy - b.vy), 2) + pow({2} * (v.vz - b.vz), 2))".format(*SPACING)
_DISTANCES = f"far AS (SELECT v.tree, v.vx, v.vy, v.vz, {_D2} AS d2 FROM vox v JOIN back b USING (tree) GROUP BY v.tree, v.vx, v.vy, v.vz)"


_CLOSED = f"""ball AS {_ball(RADIUS)},
grown AS MATERIALIZED (SELECT DISTINCT tree, vx + dx AS vx, vy + dy AS vy, vz + dz AS vz FROM vox, ball),
whole AS (SELECT g.tree, g.vx, g.vy, g.vz FROM grown g, ball o JOIN grown h ON h.tree = g.tree AND h.vx = g.vx + dx AND h.vy = g.vy + dy AND h.vz = g.vz + dz GROUP BY ALL HAVING count(*) = (SELECT count(*) FROM ball))"""
_CORES = f"SELECT v.tree, v.vx, v.vy, v.vz FROM vox v, {_ball(1)} o JOIN vox h ON h.tree = v.tree AND h.vx = v.vx + dx AND h.vy = v.vy + dy AND h.vz = v.vz + dz GROUP BY ALL HAVING count(*) = 7"

QUERIES = {f.__name__: f for f in (tree_mask_euler, tree_mask_betti, tree_mask_distances, tree_mask_closing, tree_mask_cores, lumen_radii)}
ORACLES = {
    "tree_mask_euler": schema.sql(_CELLS, "points", "edges", more=_TREE_VOX),
    "tree_mask_distances": schema.sql("SELECT tree, vx, vy, vz, round(d2, 6) AS d2 FROM far", "points", "edges", more=f"{_THICK}, {_AROUND}, {_DISTANCES}"),
    "tree_mask_closing": schema.sql("SELECT * FROM whole ANTI JOIN vox USING (tree, vx, vy, vz)", "points", "edges", more=f"{_THICK}, {_CLOSED}"),
    "tree_mask_cores": schema.sql(_CORES, "points", "edges", more=_THICK),
    "lumen_radii": schema.sql(f"SELECT p.edge_id, p.pos, round(sqrt(d2), 6) AS radius FROM points p JOIN edges e USING (edge_id) JOIN far f ON f.tree = e.tree AND f.vx = floor(p.x / {THICK}) AND f.vy = floor(p.y / {THICK}) AND f.vz = floor(p.z / {THICK})", "points", "edges", more=f"{_THICK}, {_AROUND}, {_DISTANCES}"),
}
