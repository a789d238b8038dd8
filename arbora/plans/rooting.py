"""Queries over undirected graphs and branch points, and their oracles.

The forest: customers, nations and regions as nodes, joined by edges that point either way; a component is a region's. The tree of branch points
is the heap over the parts with places and radii of its own.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from arbora import schema
from arbora.functions.statistics import rounded
from arbora.operators import morphometry as M
from arbora.operators import rooting as R
from arbora.operators.forest import strahler
from arbora.operators.voxels import label
from arbora.plans.forest import _STRAHLER, SMALLEST
from arbora.plans.voxels import TREE, _TREE_LABEL, tree_mask_runs
from arbora.session import stash, table


def _forest(spark, d):
    pick = lambda c, odd: F.when(odd, F.col("up")).otherwise(F.col("down")) if c == "src" else F.when(odd, F.col("down")).otherwise(F.col("up"))
    c = table(spark, d, "customer").select((F.col("c_custkey") + 1000).alias("down"), (F.col("c_nationkey") + 100).cast("long").alias("up"), F.abs("c_acctbal").alias("radius"), (F.col("c_custkey") % 2 == 1).alias("odd"))
    n = table(spark, d, "nation").select((F.col("n_nationkey") + 100).cast("long").alias("down"), F.col("n_regionkey").cast("long").alias("up"), F.col("n_nationkey").cast("double").alias("radius"), (F.col("n_nationkey") % 2 == 1).alias("odd"))
    return c.unionByName(n).select(F.col("down").alias("edge_id"), pick("src", F.col("odd")).alias("src"), pick("dst", F.col("odd")).alias("dst"), "radius")


def forest_roots(spark, d):
    return R.auto_roots(_forest(spark, d))


def oriented_forest(spark, d):
    """Every component directed from its thickest edge."""
    edges = _forest(spark, d)
    return R.oriented(edges, stash(R.auto_roots(edges), "roots"))


def oriented_tree(spark, d):
    """One root, that of the first component: edges of all others are not reached and have order 0."""
    edges = _forest(spark, d)
    return R.oriented(edges, stash(R.auto_roots(edges).orderBy("component").limit(1), "roots"))


def _branching(spark, d):
    """(node, parent, radius, x, y, z): radii fall with the level, so that exponents exist."""
    return table(spark, d, "part").select(F.col("p_partkey").alias("node"), F.when(F.col("p_partkey") > 0, F.expr("(p_partkey - 1) div 2")).alias("parent"), (10 / F.sqrt(F.col("p_partkey") + 1) + F.col("p_size") / 1000).alias("radius"), F.col("p_size").cast("double").alias("x"), (F.col("p_retailprice") % 17).alias("y"), F.length("p_name").cast("double").alias("z"))


def murray_exponents(spark, d):
    return rounded(R.murray(_branching(spark, d)), 5)


def vertex_angles(spark, d):
    return rounded(R.vertex_angles(_branching(spark, d)), 4)


def edge_angles(spark, d):
    return rounded(R.edge_angles(_branching(spark, d)), 4)


def branch_counts(spark, d):
    t = schema.tree(spark, d)
    edges = t.join(strahler(t).select("node", "strahler"), "node").where("parent is not null").select(F.col("node").alias("src"), F.col("parent").alias("dst"), "strahler")
    return R.branch_counts(edges)


def _graph_of(spark, d, state):
    """The end points of the segments of a state as nodes, and the segments as edges."""
    at = F.struct("x", "y", "z")
    ends = schema.points(spark, d).join(schema.edges(spark, d).where(F.col("state") == state).select("edge_id"), "edge_id").groupBy("edge_id").agg(F.min_by(at, "pos").alias("a"), F.max_by(at, "pos").alias("b"))
    places = ends.select("edge_id", F.posexplode(F.array("a", "b")).alias("end", "at")).select("at", (2 * F.col("edge_id") + F.col("end")).alias("id"))
    nodes = stash(places.groupBy("at").agg(F.min("id").alias("node")), "nodes")
    to = lambda c: nodes.select(F.col("at").alias(c), F.col("node").alias("src" if c == "a" else "dst"))
    return nodes.select("node", "at.*"), ends.join(to("a"), "a").join(to("b"), "b").select("edge_id", "src", "dst")


def merged_graphs(spark, d):
    return R.merged(*_graph_of(spark, d, "F"), *_graph_of(spark, d, "O"))


def labels_at(spark, d):
    """The component of its tree's mask that every point lies in."""
    runs = label(stash(tree_mask_runs(spark, d), "runs"), TREE)
    at = schema.points(spark, d).join(schema.edges(spark, d).select("edge_id", "tree"), "edge_id").select("tree", "edge_id", "pos", *(F.floor(c).alias(f"v{c}") for c in "xyz"))
    on = (F.col("vz") == F.col("z")) & (F.col("vy") == F.col("y")) & (F.col("vx") >= F.col("x0")) & (F.col("vx") < F.col("x1"))
    return at.join(runs.withColumnRenamed("tree", "of"), (F.col("tree") == F.col("of")) & on, "left").select("edge_id", "pos", "label")


def compared_states(spark, d):
    """Number of segments and mean radius of every order, of two states and of all, and how far the states are apart in percent of all."""
    seg = M.segment_geometry(schema.points(spark, d)).join(schema.edges(spark, d), "edge_id")
    of = lambda rows, s: rows.groupBy("ord").agg(F.count("*").alias(f"n_{s}"), F.avg("r_mean").alias(f"r_{s}"))
    both = of(seg.where("state = 'F'"), "left").join(of(seg.where("state = 'P'"), "right"), "ord", "full_outer").join(of(seg, "all"), "ord", "full_outer")
    return rounded(both.withColumn("apart", 100 * F.abs(F.col("r_left") - F.col("r_right")) / F.nullif(F.abs("r_all"), F.lit(0.0))))


_FOREST = """graph AS (SELECT down AS edge_id, CASE WHEN odd THEN up ELSE down END AS src, CASE WHEN odd THEN down ELSE up END AS dst, radius FROM (
  SELECT c_custkey + 1000 AS down, CAST(c_nationkey + 100 AS BIGINT) AS up, abs(c_acctbal) AS radius, c_custkey % 2 = 1 AS odd FROM customer
  UNION ALL SELECT CAST(n_nationkey + 100 AS BIGINT), CAST(n_regionkey AS BIGINT), CAST(n_nationkey AS DOUBLE), n_nationkey % 2 = 1 FROM nation)),
""" + SMALLEST + """,
ends AS (SELECT node, count(*) AS degree FROM (SELECT src AS node FROM graph UNION ALL SELECT dst FROM graph) GROUP BY node),
picked AS (SELECT component, CASE WHEN a.degree <= b.degree THEN src ELSE dst END AS node FROM (SELECT c.component, g.*, row_number() OVER (PARTITION BY c.component ORDER BY g.radius DESC, g.edge_id) AS k FROM graph g JOIN comp c ON c.node = g.src) t JOIN ends a ON a.node = src JOIN ends b ON b.node = dst WHERE k = 1)"""
_WALK = """walk(node, parent, dist, root) AS (SELECT node, CAST(NULL AS BIGINT), CAST(0 AS BIGINT), node FROM {roots} UNION ALL SELECT b.v, w.node, w.dist + 1, w.root FROM walk w JOIN both_ways b ON b.u = w.node WHERE w.parent IS NULL OR b.v <> w.parent),
tree AS (SELECT node, parent FROM walk),
"""
_ORIENTED = """SELECT g.edge_id, g.radius, CASE WHEN coalesce(u.node = g.dst, false) THEN g.dst ELSE g.src END AS src, CASE WHEN coalesce(u.node = g.dst, false) THEN g.src ELSE g.dst END AS dst, coalesce(u.node = g.dst, false) AS flipped,
CAST(CASE WHEN u.node IS NULL THEN -1 WHEN u.node = g.src THEN 0 ELSE 1 END AS INTEGER) AS child, u.root, u.dist, coalesce(o.strahler, 0) AS strahler
FROM graph g LEFT JOIN walk u ON (u.node = g.src AND u.parent = g.dst) OR (u.node = g.dst AND u.parent = g.src) LEFT JOIN orders o ON o.node = u.node"""
_FIRST = "first_root AS (SELECT * FROM picked ORDER BY component LIMIT 1)"
_PART = """t AS (SELECT p_partkey AS node, CASE WHEN p_partkey > 0 THEN (p_partkey - 1) // 2 END AS parent, 10 / sqrt(p_partkey + 1) + p_size / 1000 AS radius, CAST(p_size AS DOUBLE) AS x, p_retailprice % 17 AS y, CAST(length(p_name) AS DOUBLE) AS z FROM part),
kids AS (SELECT parent AS node, count(*) AS k FROM t WHERE parent IS NOT NULL GROUP BY 1),
branch AS (SELECT t.* FROM t JOIN kids USING (node) WHERE k + CASE WHEN parent IS NULL THEN 0 ELSE 1 END >= 3)"""
_ANGLE = "degrees(acos(least(greatest(({0}x * {1}x + {0}y * {1}y + {0}z * {1}z) / nullif(sqrt({0}x * {0}x + {0}y * {0}y + {0}z * {0}z) * sqrt({1}x * {1}x + {1}y * {1}y + {1}z * {1}z), 0), -1), 1)))"
_EXCESS = "list_sum(list_transform(r, lambda v: pow(v / p, {0}))) - 1"
_ENDS_OF = """ends_of AS (SELECT e.edge_id, e.state, arg_min({x: x, y: y, z: z}, pos) AS a, arg_max({x: x, y: y, z: z}, pos) AS b FROM points p JOIN edges e USING (edge_id) GROUP BY ALL),
places AS (SELECT state, a AS place, 2 * edge_id AS id FROM ends_of UNION ALL SELECT state, b, 2 * edge_id + 1 FROM ends_of),
nodes AS (SELECT state, place, min(id) AS node FROM places WHERE state IN ('F', 'O') GROUP BY state, place),
ids AS (SELECT o.place, coalesce(f.node, o.node + (SELECT max(node) + 1 FROM nodes WHERE state = 'F')) AS id FROM nodes o LEFT JOIN nodes f ON f.state = 'F' AND f.place = o.place WHERE o.state = 'O')"""

QUERIES = {f.__name__: f for f in (forest_roots, oriented_forest, oriented_tree, murray_exponents, vertex_angles, edge_angles, branch_counts, merged_graphs, labels_at, compared_states)}
ORACLES = {
    "forest_roots": f"WITH RECURSIVE {_FOREST} SELECT * FROM picked",
    "oriented_forest": f"WITH RECURSIVE {_FOREST}, {_WALK.format(roots='picked')}{_STRAHLER} {_ORIENTED}",
    "oriented_tree": f"WITH RECURSIVE {_FOREST}, {_FIRST}, {_WALK.format(roots='first_root')}{_STRAHLER} {_ORIENTED}",
    "murray_exponents": f"""WITH RECURSIVE {_PART},
sums AS (SELECT b.node, b.radius AS p, sum(c.radius) AS s1, sum(c.radius ** 3) AS s3, list(c.radius ORDER BY c.radius) AS r FROM branch b JOIN t c ON c.parent = b.node WHERE b.parent IS NOT NULL GROUP BY b.node, b.radius),
halved(node, p, r, lo, hi, i) AS (SELECT node, p, r, CAST(0.01 AS DOUBLE), CAST(64 AS DOUBLE), 0 FROM sums WHERE {_EXCESS.format('0.01')} > 0 AND {_EXCESS.format('64')} < 0
  UNION ALL SELECT node, p, r, CASE WHEN {_EXCESS.format('((lo + hi) / 2)')} > 0 THEN (lo + hi) / 2 ELSE lo END, CASE WHEN {_EXCESS.format('((lo + hi) / 2)')} > 0 THEN hi ELSE (lo + hi) / 2 END, i + 1 FROM halved WHERE i < 60)
SELECT s.node, round(s.p, 5) AS parent_rad, round(s.p ** 3, 5) AS parent_rad_cubed, round(s1, 5) AS sumchild, round(s3, 5) AS sumchild_cubed, round((lo + hi) / 2, 5) AS gamma_eff FROM sums s LEFT JOIN halved h ON h.node = s.node AND i = 60""",
    "vertex_angles": f"WITH {_PART}, v AS (SELECT b.node, b.x - c.x AS x, b.y - c.y AS y, b.z - c.z AS z, row_number() OVER (PARTITION BY b.node ORDER BY c.node) AS k FROM branch b JOIN t c ON c.parent = b.node) SELECT a.node, round({_ANGLE.format('a.', 'b.')}, 4) AS a12, round({_ANGLE.format('b.', 'c.')}, 4) AS a23, round({_ANGLE.format('a.', 'c.')}, 4) AS a13 FROM v a JOIN v b ON b.node = a.node AND b.k = 2 LEFT JOIN v c ON c.node = a.node AND c.k = 3 WHERE a.k = 1",
    "edge_angles": f"WITH {_PART}, v AS (SELECT c.node AS child, b.x - u.x AS px, b.y - u.y AS py, b.z - u.z AS pz, b.x - c.x AS cx, b.y - c.y AS cy, b.z - c.z AS cz FROM branch b JOIN t c ON c.parent = b.node JOIN t u ON u.node = b.parent) SELECT child, round({_ANGLE.format('p', 'c')}, 4) AS angle FROM v",
    "branch_counts": schema.sql("SELECT strahler, count(*) FILTER (degree >= 3) AS n_bifurcations, count(*) FILTER (degree = 1) AS n_terminals, max(degree) AS largest_degree FROM (SELECT node, count(*) AS degree, max(strahler) AS strahler FROM (SELECT o.node, strahler FROM orders o JOIN tree t USING (node) WHERE parent IS NOT NULL UNION ALL SELECT parent, strahler FROM orders o JOIN tree t USING (node) WHERE parent IS NOT NULL) GROUP BY node) GROUP BY strahler", "tree", more=_STRAHLER, recursive=True),
    "merged_graphs": schema.sql("SELECT edge_id, a.node AS src, b.node AS dst, CAST(1 AS INTEGER) AS part FROM ends_of e JOIN nodes a ON a.state = 'F' AND a.place = e.a JOIN nodes b ON b.state = 'F' AND b.place = e.b WHERE e.state = 'F' UNION ALL SELECT edge_id, a.id, b.id, 2 FROM ends_of e JOIN ids a ON a.place = e.a JOIN ids b ON b.place = e.b WHERE e.state = 'O'", "points", "edges", more=_ENDS_OF),
    "labels_at": schema.sql("SELECT p.edge_id, p.pos, l.label FROM points p JOIN edges e USING (edge_id) LEFT JOIN labelled l ON l.tree = e.tree AND l.z = floor(p.z) AND l.y = floor(p.y) AND floor(p.x) >= l.x0 AND floor(p.x) < l.x1", "points", "edges", more=_TREE_LABEL, recursive=True),
    "compared_states": schema.sql("SELECT ord, CAST(nullif(count(*) FILTER (state = 'F'), 0) AS BIGINT) AS n_left, round(avg(r_mean) FILTER (state = 'F'), 6) AS r_left, CAST(nullif(count(*) FILTER (state = 'P'), 0) AS BIGINT) AS n_right, round(avg(r_mean) FILTER (state = 'P'), 6) AS r_right, count(*) AS n_all, round(avg(r_mean), 6) AS r_all, round(100 * abs(avg(r_mean) FILTER (state = 'F') - avg(r_mean) FILTER (state = 'P')) / nullif(abs(avg(r_mean)), 0), 6) AS apart FROM (SELECT edge_id, avg(r) AS r_mean FROM points GROUP BY edge_id) JOIN edges USING (edge_id) GROUP BY ord", "points", "edges"),
}
