"""Queries that join points in space and sets of cells, and their oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from arbora import schema
from arbora.functions.statistics import rounded
from arbora.operators import proximity as P
from arbora.operators.morphometry import segment_geometry, with_steps
from arbora.operators.spans import with_tangents
from arbora.plans.morphometry import GEOMETRY

_ODD, _EVEN = "pt_id % 2 = 1", "pt_id % 2 = 0"


def _sides(spark, d):
    c = schema.cloud(spark, d)
    return c.where(_ODD).withColumnRenamed("pt_id", "q_id"), c.where(_EVEN).withColumnRenamed("pt_id", "b_id")


def nearest_gated(spark, d):
    q, b = _sides(spark, d)
    return rounded(P.nearest(q, b, 0.15).select("q_id", "b_id", "d"))


def nearest_any(spark, d):
    q, b = _sides(spark, d)
    return rounded(P.nearest_widening(q, b, 0.05))


def cloud_owner(spark, d):
    q, b = _sides(spark, d)
    return rounded(P.assign(q, b.withColumn("radius", F.abs("value") / 2), "radius", 1.5, 0.4))


def cloud_group_stats(spark, d):
    """Weighted mean and SD of the values each centre owns."""
    q, b = _sides(spark, d)
    own = P.assign(q, b.withColumn("radius", F.abs("value") / 2), "radius", 1.5, 0.4).where("owner >= 0").join(q.select("q_id", "value"), "q_id")
    w = F.col("d") + 0.01
    out = own.groupBy("owner").agg(F.count("*").alias("n"), (F.sum(w * F.col("value")) / F.sum(w)).alias("mean"), (F.sum(w * F.col("value") ** 2) / F.sum(w)).alias("square"))
    sd = F.when(F.col("n") > 1, F.sqrt(F.greatest(F.col("square") - F.col("mean") ** 2, F.lit(0.0))))
    return rounded(out.select("owner", "n", "mean", sd.alias("sd")))


def intervessel_distance(spark, d):
    c = schema.cloud(spark, d)
    pairs = P.within(c.withColumnRenamed("pt_id", "q_id"), c.withColumnRenamed("pt_id", "b_id"), 0.2, []).where("q_id <> b_id")
    return rounded(pairs.groupBy("q_id").agg(F.min("d").alias("distance"), F.count("*").alias("n_near")))


def surface_metrics(spark, d):
    q, b = _sides(spark, d)
    there = P.nearest_widening(q, b, 0.05)
    back = P.nearest_widening(b, q, 0.05, q_id="b_id", b_id="q_id")
    return rounded(P.surface_distances(there, back))


def coincident_pairs(spark, d):
    c = schema.cloud(spark, d)
    return rounded(P.within(c.withColumnRenamed("pt_id", "q_id"), c.withColumnRenamed("pt_id", "b_id"), 0.06, []).where("q_id < b_id").select("q_id", "b_id", "d"))


def endpoint_proposals(spark, d):
    """Points of one half that see one of the other within the gates: the best target of each by distance; directions are those from the origin."""
    q, b = _sides(spark, d)
    r = lambda df: df.withColumn("r", F.abs("value") + 0.01)
    dot = sum((F.col(f"q_{c}") * F.col(f"b_{c}") for c in P.AXES), F.lit(0.0))
    size = F.sqrt(sum((F.col(f"q_{c}") ** 2 for c in P.AXES), F.lit(0.0))) * F.sqrt(sum((F.col(f"b_{c}") ** 2 for c in P.AXES), F.lit(0.0)))
    accept = lambda pairs: P.gate_reason(pairs.withColumn("cos", dot / F.nullif(size, F.lit(0.0))), 0.1, 0.5, 4.0).where("verdict = 'accept'")
    best = P.nearest_accepted(r(q), r(b), 0.12, ["r"], accept)
    return rounded(best.select("q_id", "b_id", "d", F.lit(1).cast("long").alias("rank")))


def gate_counts(spark, d):
    q, b = _sides(spark, d)
    r = lambda df: df.withColumn("r", F.abs("value") + 0.01)
    pairs = P.within(r(q), r(b), 0.12, ["r"]).withColumn("cos", F.lit(1.0))
    return P.gate_reason(pairs, 0.1, 0.5, 4.0).groupBy("verdict").agg(F.count("*").alias("n"))


def voxel_overlap(spark, d):
    p = schema.points(spark, d)
    return rounded(P.overlap(P.voxels(p.where("edge_id % 2 = 0"), 5.0), P.voxels(p.where("edge_id % 3 = 0"), 5.0), ["vx", "vy", "vz"]))


def line_voxels(spark, d):
    """How many cells every segment's digital lines pass."""
    p = with_steps(schema.points(spark, d))
    from arbora.operators.morphometry import along

    lines = p.withColumns({f"{c}1": F.lead(c).over(along()) for c in P.AXES}).where("x1 is not null")
    return P.rasterise(lines, 4.0).groupBy("edge_id").agg(F.count("*").alias("n_voxels"))


def majority_label(spark, d):
    """Each segment's label by majority of its points' state of return flag, where it reaches half."""
    from arbora.session import table

    votes = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("edge_id"), F.ascii("l_returnflag").cast("long").alias("label"))
    return P.majority(votes, "edge_id", "label")


def coverage_labels(spark, d):
    """Centreline samples inside, missed or cropped by their distance to the nearest surface point."""
    q, b = _sides(spark, d)
    near = P.nearest_widening(q, b, 0.05).join(q.select("q_id", "value"), "q_id")
    label = F.when(F.col("value") > 0.1, "inside").when(F.col("d") <= F.greatest(F.abs("value") * 1.5, F.lit(0.08)), "missed").otherwise("cropped")
    return near.groupBy(label.alias("label")).agg(F.count("*").alias("n"))


def box_subset(spark, d):
    """Whole segments that touch a box, with how many points they have in it."""
    p = schema.points(spark, d)
    inside = p.where("x between 10 and 20 and y between 2 and 6 and z between 1 and 5").groupBy("edge_id").agg(F.count("*").alias("n_inside"))
    return rounded(segment_geometry(p.join(inside, "edge_id", "left_semi")).select("edge_id", "n_points", "length").join(inside, "edge_id"))


def padded_bounds(spark, d):
    p = schema.points(spark, d).join(schema.edges(spark, d), "edge_id")
    sides = [f(F.col(c) + s * 2 * F.col("r")).alias(f"{c}_{n}") for c in P.AXES for n, f, s in (("low", F.min, -1), ("high", F.max, 1))]
    return rounded(p.groupBy("ord").agg(*sides))


def axial_component(spark, d):
    """Mean of the value along each segment's tangents."""
    t = with_tangents(schema.points(spark, d))
    dot = F.abs(F.col("tx") * F.col("r") + F.col("ty") * 2 + F.col("tz"))
    return rounded(t.groupBy("edge_id").agg(F.avg(dot).alias("axial"), F.count("tx").alias("n")).where("n > 0"))


def merge_rows(spark, d):
    """Anatomy and flow rows of every order and state joined on both, whichever side has them."""
    seg = segment_geometry(schema.points(spark, d)).join(schema.edges(spark, d), "edge_id")
    a = seg.where("ord <> 2").groupBy("ord").agg(F.avg("length").alias("anatomy"))
    b = seg.where("ord <> 4").groupBy("ord").agg(F.avg("volume").alias("flow"))
    return rounded(a.join(b, "ord", "full_outer"), 5)


def filter_segments(spark, d):
    """Segments but those of a list (the orders of open state), and the points that belong to them."""
    keep = schema.edges(spark, d).join(schema.edges(spark, d).where("state = 'O'").select("edge_id"), "edge_id", "left_anti")
    return schema.points(spark, d).join(keep, "edge_id", "left_semi").groupBy("edge_id").agg(F.count("*").alias("n_points"))


_NN = """pairs AS (SELECT q.pt_id AS q_id, b.pt_id AS b_id, q.value AS qv, b.value AS bv, sqrt((q.x - b.x) ** 2 + (q.y - b.y) ** 2 + (q.z - b.z) ** 2) AS d,
  (q.x * b.x + q.y * b.y + q.z * b.z) / nullif(sqrt(q.x ** 2 + q.y ** 2 + q.z ** 2) * sqrt(b.x ** 2 + b.y ** 2 + b.z ** 2), 0) AS cos
  FROM cloud q JOIN cloud b ON q.pt_id % 2 = 1 AND b.pt_id % 2 = 0),
near AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY round(d, 9), b_id) AS k FROM pairs) WHERE k = 1),
back AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY b_id ORDER BY round(d, 9), q_id) AS k FROM pairs) WHERE k = 1),
own AS (SELECT q_id, qv, CASE WHEN d <= 0.4 AND d <= 1.5 * (abs(bv) / 2) THEN b_id ELSE -1 END AS owner, CASE WHEN d <= 0.4 THEN d END AS d FROM near)"""
_SELF = """pairs AS (SELECT q.pt_id AS q_id, b.pt_id AS b_id, sqrt((q.x - b.x) ** 2 + (q.y - b.y) ** 2 + (q.z - b.z) ** 2) AS d FROM cloud q JOIN cloud b ON q.pt_id <> b.pt_id)"""
_VERDICT = "CASE WHEN d > 0.1 THEN 'reach' WHEN coalesce({cos}, -1) < 0.5 THEN 'cone' WHEN greatest(abs(qv) + 0.01, abs(bv) + 0.01) / least(abs(qv) + 0.01, abs(bv) + 0.01) > 4 THEN 'radius' ELSE 'accept' END"

QUERIES = {f.__name__: f for f in (nearest_gated, nearest_any, cloud_owner, cloud_group_stats, intervessel_distance, surface_metrics, coincident_pairs, endpoint_proposals, gate_counts, voxel_overlap, line_voxels, majority_label, coverage_labels, box_subset, padded_bounds, axial_component, merge_rows, filter_segments)}
ORACLES = {
    "nearest_gated": schema.sql("SELECT q_id, b_id, round(d, 6) AS d FROM near WHERE d <= 0.15", "cloud", more=_NN),
    "nearest_any": schema.sql("SELECT q_id, b_id, round(d, 6) AS d FROM near", "cloud", more=_NN),
    "cloud_owner": schema.sql("SELECT q_id, owner, round(d, 6) AS d FROM own", "cloud", more=_NN),
    "cloud_group_stats": schema.sql("SELECT owner, n, round(mean, 6) AS mean, round(CASE WHEN n > 1 THEN sqrt(greatest(sq - mean ** 2, 0)) END, 6) AS sd FROM (SELECT owner, count(*) AS n, sum((d + 0.01) * qv) / sum(d + 0.01) AS mean, sum((d + 0.01) * qv ** 2) / sum(d + 0.01) AS sq FROM own WHERE owner >= 0 GROUP BY owner)", "cloud", more=_NN),
    "intervessel_distance": schema.sql("SELECT q_id, round(min(d), 6) AS distance, count(*) AS n_near FROM pairs WHERE d <= 0.2 GROUP BY q_id", "cloud", more=_SELF),
    "surface_metrics": schema.sql('SELECT count(*) AS n, round(avg(d), 6) AS mean, round(quantile_cont(d, 0.5), 6) AS "median", round(quantile_cont(d, 0.95), 6) AS hd95, round(max(d), 6) AS hausdorff FROM (SELECT d FROM near UNION ALL SELECT d FROM back)', "cloud", more=_NN),
    "coincident_pairs": schema.sql("SELECT q_id, b_id, round(d, 6) AS d FROM pairs WHERE d <= 0.06 AND q_id < b_id", "cloud", more=_SELF),
    "endpoint_proposals": schema.sql(f"SELECT q_id, b_id, round(d, 6) AS d, rank FROM (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY round(d, 9), b_id) AS rank FROM pairs WHERE d <= 0.12 AND {_VERDICT.format(cos='cos')} = 'accept') WHERE rank = 1", "cloud", more=_NN),
    "gate_counts": schema.sql(f"SELECT {_VERDICT.format(cos='1.0')} AS verdict, count(*) AS n FROM pairs WHERE d <= 0.12 GROUP BY 1", "cloud", more=_NN),
    "voxel_overlap": schema.sql("""SELECT n_a, n_b, n_both, round(2 * n_both / (n_a + n_b), 6) AS dice, round(n_both / (n_a + n_b - n_both), 6) AS jaccard, round(n_both / n_b, 6) AS "precision", round(n_both / n_a, 6) AS recall FROM (
SELECT count(*) FILTER (a) AS n_a, count(*) FILTER (b) AS n_b, count(*) FILTER (a AND b) AS n_both FROM (SELECT floor(x / 5) AS vx, floor(y / 5) AS vy, floor(z / 5) AS vz, bool_or(edge_id % 2 = 0) AS a, bool_or(edge_id % 3 = 0) AS b FROM points GROUP BY ALL))""", "points"),
    "line_voxels": schema.sql("""SELECT edge_id, count(*) AS n_voxels FROM (SELECT DISTINCT edge_id, floor(cx + t * (dx - cx) + 0.5) AS vx, floor(cy + t * (dy - cy) + 0.5) AS vy, floor(cz + t * (dz - cz) + 0.5) AS vz FROM (
SELECT *, CASE WHEN n > 0 THEN k / n ELSE 0 END AS t FROM (SELECT *, unnest(range(CAST(n AS BIGINT) + 1)) AS k FROM (SELECT *, greatest(abs(dx - cx), abs(dy - cy), abs(dz - cz)) AS n FROM (
SELECT edge_id, floor(x / 4) AS cx, floor(y / 4) AS cy, floor(z / 4) AS cz, floor(lead(x) OVER w / 4) AS dx, floor(lead(y) OVER w / 4) AS dy, floor(lead(z) OVER w / 4) AS dz FROM points WINDOW w AS (PARTITION BY edge_id ORDER BY pos)) WHERE dx IS NOT NULL)))) GROUP BY edge_id""", "points"),
    "majority_label": "SELECT edge_id, CASE WHEN n / total >= 0.5 THEN label END AS label, n AS votes, CAST(total AS BIGINT) AS total FROM (SELECT *, sum(n) OVER (PARTITION BY edge_id) AS total, row_number() OVER (PARTITION BY edge_id ORDER BY n DESC, label) AS k FROM (SELECT l_orderkey AS edge_id, CAST(ascii(l_returnflag) AS BIGINT) AS label, count(*) AS n FROM lineitem GROUP BY 1, 2)) WHERE k = 1",
    "coverage_labels": schema.sql("SELECT CASE WHEN qv > 0.1 THEN 'inside' WHEN d <= greatest(abs(qv) * 1.5, 0.08) THEN 'missed' ELSE 'cropped' END AS label, count(*) AS n FROM near GROUP BY 1", "cloud", more=_NN),
    "box_subset": schema.sql("SELECT s.edge_id, s.n_points, round(length, 6) AS length, i.n_inside FROM segments s JOIN (SELECT edge_id, count(*) AS n_inside FROM points WHERE x BETWEEN 10 AND 20 AND y BETWEEN 2 AND 6 AND z BETWEEN 1 AND 5 GROUP BY 1) i USING (edge_id)", "points", "edges", more=GEOMETRY),
    "padded_bounds": schema.sql("SELECT ord, " + ", ".join(f"round({f}({c} {s} 2 * r), 6) AS {c}_{n}" for c in "xyz" for n, f, s in (("low", "min", "-"), ("high", "max", "+"))) + " FROM points JOIN edges USING (edge_id) GROUP BY ord", "points", "edges"),
    "axial_component": schema.sql("SELECT edge_id, round(avg(abs(dx / n * r + dy / n * 2 + dz / n)), 6) AS axial, count(n) AS n FROM (SELECT *, nullif(sqrt(dx ** 2 + dy ** 2 + dz ** 2), 0) AS n FROM (SELECT edge_id, r, coalesce(lead(x) OVER w, x) - coalesce(lag(x) OVER w, x) AS dx, coalesce(lead(y) OVER w, y) - coalesce(lag(y) OVER w, y) AS dy, coalesce(lead(z) OVER w, z) - coalesce(lag(z) OVER w, z) AS dz FROM points WINDOW w AS (PARTITION BY edge_id ORDER BY pos))) GROUP BY edge_id HAVING count(n) > 0", "points"),
    "merge_rows": schema.sql("SELECT coalesce(a.ord, b.ord) AS ord, round(anatomy, 5) AS anatomy, round(flow, 5) AS flow FROM (SELECT ord, avg(length) AS anatomy FROM labelled WHERE ord <> 2 GROUP BY ord) a FULL JOIN (SELECT ord, avg(volume) AS flow FROM labelled WHERE ord <> 4 GROUP BY ord) b ON a.ord = b.ord", "points", "edges", more=GEOMETRY),
    "filter_segments": schema.sql("SELECT edge_id, count(*) AS n_points FROM points JOIN edges USING (edge_id) WHERE state <> 'O' GROUP BY edge_id", "points", "edges"),
}
