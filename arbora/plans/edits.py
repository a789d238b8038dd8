"""Queries that edit and compare graphs, and their oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from arbora import schema
from arbora.functions.statistics import rounded
from arbora.operators import edits as E
from arbora.operators.morphometry import segment_geometry
from arbora.operators.spans import with_turns
from arbora.plans.morphometry import GEOMETRY, STEPS
from arbora.session import table


def split_segments(spark, d):
    p = schema.points(spark, d)
    return E.split_segments(p, p.where("r > 55").select("edge_id", F.col("pos").alias("at"))).select("edge_id", "pos", "part", "at")


def weld_nodes(spark, d):
    """Suppliers of one nation are one node: edges between parts and nations, without doubles."""
    # parts are even and all others odd, so that no part has the number of a supplier or nation, however many there are
    odd = lambda c: c.cast("long") * 2 + 1
    e = table(spark, d, "lineitem").select((F.col("l_partkey") * 2).alias("src"), odd(F.col("l_suppkey") + 1000000).alias("dst")).distinct()
    s = table(spark, d, "supplier").select(odd(F.col("s_suppkey") + 1000000).alias("node"), odd(F.col("s_nationkey") + 2000000).alias("keep"))
    return E.weld(e, s).groupBy(F.shiftright("src", 1).alias("src"), F.shiftright("dst", 1).alias("dst")).agg(F.count("*").alias("n_edges"))


def renumbered(spark, d):
    return E.renumber(schema.edges(spark, d).select("tree", "edge_id"), "tree", "edge_id", "dense")


def fingerprints(spark, d):
    return E.fingerprints(schema.points(spark, d))


def replayed_log(spark, d):
    return E.replay(schema.series(spark, d).withColumn("value", F.coalesce("value", F.lit(-1.0))), "edge_id", "pos", "value", 20)


def smoothed_radius(spark, d):
    return rounded(E.smooth(schema.points(spark, d), "r").select("edge_id", "pos", "smooth"))


def segment_resistance(spark, d):
    return rounded(E.segment_resistance(schema.points(spark, d)), 9)


def score_terms(spark, d):
    rows = segment_geometry(schema.points(spark, d)).join(schema.edges(spark, d), "edge_id").groupBy("tree").agg(F.avg("length").alias("a"), F.max("length").alias("b"), F.avg(F.when(F.col("n_points") > 3, 1.0).otherwise(0.0)).alias("cover"))
    return rounded(E.score_terms(rows, "a", "b", "cover", 3).select("tree", "relative", "miss", "score"))


def sidecar_fields(spark, d):
    """Fields of the JSON documents of events, read with a schema; documents that do not fit count as none."""
    rows = table(spark, d, "events").select("event_type", F.from_json("props", "k bigint").alias("j"))
    return rounded(rows.groupBy("event_type").agg(F.count("j.k").alias("n"), F.sum("j.k").alias("total"), F.max("j.k").alias("largest")))


def curvature_windows(spark, d):
    """Sum of the turns within two positions of every point."""
    rows = with_turns(schema.points(spark, d)).select("edge_id", "pos", F.coalesce("turn", F.lit(0.0)).alias("turn"))
    near = F.sum("turn").over(E.along().rowsBetween(-2, 2))
    return rounded(rows.select("edge_id", "pos", near.alias("turning")), 4)


_T = """turns AS (SELECT edge_id, pos, coalesce(degrees(acos(greatest(least((ax * bx + ay * by_ + az * bz) / nullif(sqrt(ax ** 2 + ay ** 2 + az ** 2) * sqrt(bx ** 2 + by_ ** 2 + bz ** 2), 0), 1), -1))), 0) AS turn FROM (
  SELECT edge_id, pos, x - lag(x) OVER w AS ax, y - lag(y) OVER w AS ay, z - lag(z) OVER w AS az, lead(x) OVER w - x AS bx, lead(y) OVER w - y AS by_, lead(z) OVER w - z AS bz FROM points WINDOW w AS (PARTITION BY edge_id ORDER BY pos)))"""

QUERIES = {f.__name__: f for f in (weld_nodes, renumbered, replayed_log, smoothed_radius, score_terms, sidecar_fields, curvature_windows)} | {"split_segments": split_segments, "segment_fingerprints": fingerprints, "laminar_resistance": segment_resistance}
ORACLES = {
    "split_segments": schema.sql("""SELECT edge_id, pos, part, row_number() OVER (PARTITION BY edge_id, part ORDER BY pos) - 1 AS at FROM (
SELECT edge_id, pos, unnest(CASE WHEN r > 55 AND pos > 0 AND pos < stop THEN [before, before + 1] ELSE [before] END) AS part FROM (
SELECT *, CAST(coalesce(sum(CASE WHEN r > 55 AND pos > 0 AND pos < stop THEN 1 ELSE 0 END) OVER (PARTITION BY edge_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before FROM (SELECT *, max(pos) OVER (PARTITION BY edge_id) AS stop FROM points)))""", "points"),
    "weld_nodes": "SELECT src, coalesce(s_nationkey + 2000000, dst) AS dst, count(*) AS n_edges FROM (SELECT DISTINCT l_partkey AS src, l_suppkey + 1000000 AS dst FROM lineitem) LEFT JOIN supplier ON s_suppkey + 1000000 = dst GROUP BY 1, 2",
    "renumbered": schema.sql("SELECT tree, edge_id, dense_rank() OVER (PARTITION BY tree ORDER BY edge_id) - 1 AS dense FROM edges", "edges"),
    "segment_fingerprints": schema.sql("""SELECT edge_id, sha256(least(string_agg(p, ',' ORDER BY pos), string_agg(p, ',' ORDER BY pos DESC))) AS fingerprint FROM (
SELECT edge_id, pos, CAST(floor(x / 0.001 + 0.5) AS BIGINT) || ':' || CAST(floor(y / 0.001 + 0.5) AS BIGINT) || ':' || CAST(floor(z / 0.001 + 0.5) AS BIGINT) AS p FROM points) GROUP BY edge_id""", "points"),
    "replayed_log": schema.sql("SELECT edge_id, arg_max(coalesce(value, -1), pos) AS value, max(pos) AS last_edit FROM series WHERE pos <= 20 GROUP BY edge_id", "series"),
    "smoothed_radius": schema.sql("SELECT edge_id, pos, round(coalesce((-3 * lag(r, 2) OVER w + 12 * lag(r) OVER w + 17 * r + 12 * lead(r) OVER w - 3 * lead(r, 2) OVER w) / 35, r), 6) AS smooth FROM points WINDOW w AS (PARTITION BY edge_id ORDER BY pos)", "points"),
    "laminar_resistance": schema.sql("SELECT edge_id, round(8 * 0.0035 / pi() * coalesce(sum(step * (a * a + a * r + r * r) / (3 * a ** 3 * r ** 3)), 0), 9) AS resistance FROM (SELECT *, lag(r) OVER (PARTITION BY edge_id ORDER BY pos) AS a FROM steps) GROUP BY edge_id", "points", more=STEPS),
    "score_terms": schema.sql("""SELECT tree, round(rel, 6) AS "relative", round(miss, 6) AS miss, round(coalesce(rel, 0) + coalesce(miss, 0), 6) AS score FROM (
SELECT tree, abs(a - b) / nullif(abs(a), 0) AS rel, CASE WHEN cover > 0 THEN (1 - cover) / cover ** 3 ELSE CAST('Infinity' AS DOUBLE) END AS miss FROM (
SELECT tree, avg(length) AS a, max(length) AS b, avg(CASE WHEN n_points > 3 THEN 1.0 ELSE 0.0 END) AS cover FROM labelled GROUP BY tree))""", "points", "edges", more=GEOMETRY),
    "sidecar_fields": "SELECT event_type, count(k) AS n, CAST(sum(k) AS BIGINT) AS total, max(k) AS largest FROM (SELECT event_type, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events) GROUP BY event_type",
    "curvature_windows": schema.sql("SELECT edge_id, pos, round(sum(turn) OVER (PARTITION BY edge_id ORDER BY pos ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING), 4) AS turning FROM turns", "points", more=_T),
}
