"""Morphometry queries (segment geometry and its aggregates) and their oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from arbora import schema
from arbora.functions.statistics import rma, rounded, stats11_sql
from arbora.operators import morphometry as M
from arbora.session import table

STEPS = """steps AS (SELECT *, coalesce(sqrt((x - lag(x) OVER w) ** 2 + (y - lag(y) OVER w) ** 2 + (z - lag(z) OVER w) ** 2), 0) AS step
  FROM points WINDOW w AS (PARTITION BY edge_id ORDER BY pos))"""
GEOMETRY = STEPS + """,
ends AS (SELECT edge_id, count(*) AS n_points, sum(step) AS length, avg(r) AS r_mean, max(r) AS r_max, min(r) AS r_min, stddev_pop(r) AS r_sd,
  sqrt((arg_max(x, pos) - arg_min(x, pos)) ** 2 + (arg_max(y, pos) - arg_min(y, pos)) ** 2 + (arg_max(z, pos) - arg_min(z, pos)) ** 2) AS chord
  FROM steps GROUP BY edge_id),
segments AS (SELECT edge_id, n_points, length, chord, CASE WHEN chord > 1e-9 THEN length / chord ELSE 0 END AS tortuosity, r_mean, r_max, r_min, r_sd,
  pi() * r_mean ** 2 * length AS volume, 2 * pi() * r_mean * length AS area FROM ends),
labelled AS (SELECT * FROM segments JOIN edges USING (edge_id))"""
ROUND = "round({0}, 6) AS {0}".format


def _segments(spark, d):
    return M.segment_geometry(schema.points(spark, d))


def _labelled(spark, d):
    return _segments(spark, d).join(schema.edges(spark, d), "edge_id")


def segment_morphometry(spark, d):
    return rounded(_segments(spark, d))


def order_statistics(spark, d):
    return rounded(M.stats_by(_labelled(spark, d), ["ord"], ["length", "tortuosity", "r_mean"]))


def state_statistics(spark, d):
    return rounded(M.stats_by(_labelled(spark, d), ["state", "ord"], ["volume"]), 4)


def order_totals(spark, d):
    return rounded(M.with_total(_labelled(spark, d), "ord", ["length", "r_mean"]), 4)


def branching_ratio(spark, d):
    return rounded(M.branching_ratio(_labelled(spark, d).where("n_points > 4")))


def radius_bins(spark, d):
    return rounded(M.log_bins(_segments(spark, d), "r_mean"))


def edge_midpoints(spark, d):
    return rounded(M.midpoints(schema.points(spark, d)))


def collapse_elements(spark, d):
    return rounded(M.collapse(_labelled(spark, d), "tree", "length", "r_mean", "r_sd", ["volume", "n_points"]), 4)


def radius_agreement(spark, d):
    return rounded(M.agreement(_labelled(spark, d), "ord", "r_mean", "r_max"))


def radius_weighted_quantile(spark, d):
    return rounded(M.weighted_quantile(_labelled(spark, d), ["state", "ord"], "r_mean", "length", 0.75))


def rma_regression(spark, d):
    rows = _labelled(spark, d).where("r_mean > 0 and length > 0").select("ord", F.log("r_mean").alias("lr"), F.log("length").alias("ll"))
    return rounded(rows.groupBy("ord").agg(*(x.alias(k) for k, x in rma("lr", "ll").items())))


def state_contrast(spark, d):
    """Mean radius of every order, a column for each state, and the first state's difference from the second in percent."""
    wide = _labelled(spark, d).groupBy("ord").pivot("state", ["F", "O", "P"]).agg(F.avg("r_mean"))
    return rounded(wide.withColumn("change_percent", 100 * F.abs(F.col("F") - F.col("O")) / F.nullif(F.abs("O"), F.lit(0.0))).withColumnsRenamed({"F": "state_f", "O": "state_o", "P": "state_p"}))


def tidy_states(spark, d):
    """Long form: (state, ord, metric, mean, sd)."""
    rows = _labelled(spark, d).select("state", "ord", "length", "tortuosity", "r_mean").unpivot(["state", "ord"], ["length", "tortuosity", "r_mean"], "metric", "value")
    return rounded(rows.groupBy("state", "ord", "metric").agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("sd")))


def outlet_resistances(spark, d):
    seg = _labelled(spark, d)
    shares = seg.withColumn("fraction", F.col("volume") / F.nullif(F.sum("volume").over(M.Window.partitionBy("tree")), F.lit(0.0))).where("fraction > 0")
    return rounded(M.outlet_resistances(shares, "tree", "fraction", 1.5, 90.0).select("edge_id", "tree", "fraction", "resistance", "parallel"), 4)


def size_fit(spark, d):
    """Log-log fit of segment count against bin size: slope, intercept, r2 per order."""
    rows = _labelled(spark, d).groupBy("ord", "n_points").agg(F.count("*").alias("n")).select("ord", F.log("n_points").alias("x"), F.log("n").alias("y"))
    y, x = F.col("y"), F.col("x")
    return rounded(rows.groupBy("ord").agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.regr_r2(y, x).alias("r2")))


def consistency(spark, d):
    """Integrity: segments without points, points without segments, and numbers of both."""
    seg, edges = _segments(spark, d), schema.edges(spark, d)
    both = edges.select("edge_id", F.lit(1).alias("e")).join(seg.select("edge_id", "n_points"), "edge_id", "full_outer")
    return both.agg(F.count("e").alias("n_edges"), F.count_if(F.col("n_points").isNull()).alias("edges_without_points"), F.count_if(F.col("e").isNull()).alias("points_without_edge"), F.sum("n_points").alias("n_points"))


def degenerate_segments(spark, d):
    """Segments most of whose length is one step."""
    rows = M.with_steps(schema.points(spark, d)).groupBy("edge_id").agg(F.count("*").alias("n"), F.max("step").alias("largest"), F.sum("step").alias("length"))
    return rounded(rows.where("n >= 4 and largest > 20 and largest / length > 0.5"))


def lumped_areas(spark, d):
    """A third of each triangle's area to each of its corners: triangles are consecutive point triples of a segment."""
    p = schema.points(spark, d)
    at = lambda c, k: F.lead(c, k).over(M.along())
    u = [at(c, 1) - F.col(c) for c in "xyz"]
    v = [at(c, 2) - F.col(c) for c in "xyz"]
    cross = [u[1] * v[2] - u[2] * v[1], u[2] * v[0] - u[0] * v[2], u[0] * v[1] - u[1] * v[0]]
    area = F.sqrt(sum((c * c for c in cross), F.lit(0.0))) / 2
    tri = p.select("edge_id", "pos", area.alias("area")).where("area is not null")
    corners = tri.select("edge_id", F.explode(F.sequence(F.col("pos"), F.col("pos") + 2)).alias("pos"), (F.col("area") / 3).alias("share"))
    return rounded(corners.groupBy("edge_id", "pos").agg(F.sum("share").alias("area")))


def part_prices(spark, d):
    """Shortest relative distance to a target size: the three best parts of each brand."""
    rank = F.row_number().over(M.Window.partitionBy("p_brand").orderBy(F.round(F.abs(F.log(F.col("p_retailprice") / 1000)), 9), "p_partkey"))
    return table(spark, d, "part").where("p_retailprice > 0").select("p_brand", "p_partkey", rank.cast("long").alias("rank")).where("rank <= 3")


def _seg(body: str, digits: int = 6) -> str:
    return schema.sql(body, "points", "edges", more=GEOMETRY)


QUERIES = {f.__name__: f for f in (segment_morphometry, order_statistics, state_statistics, order_totals, branching_ratio, radius_bins, edge_midpoints, collapse_elements, radius_agreement, radius_weighted_quantile, rma_regression, state_contrast, tidy_states, outlet_resistances, size_fit, consistency, degenerate_segments, lumped_areas)} | {"representative_ranks": part_prices}
ORACLES = {
    "segment_morphometry": _seg("SELECT edge_id, n_points, " + ", ".join(map(ROUND, "length chord tortuosity r_mean r_max r_min r_sd volume area".split())) + " FROM segments"),
    "order_statistics": _seg(f"SELECT ord, {stats11_sql('length')}, {stats11_sql('tortuosity')}, {stats11_sql('r_mean')} FROM labelled GROUP BY ord"),
    "state_statistics": _seg(f"SELECT state, ord, {stats11_sql('volume', 4)} FROM labelled GROUP BY state, ord"),
    "order_totals": _seg("SELECT ord, count(*) AS n, round(avg(length), 4) AS length_avg, round(sum(length), 4) AS length_sum, round(avg(r_mean), 4) AS r_mean_avg, round(sum(r_mean), 4) AS r_mean_sum FROM labelled GROUP BY ROLLUP (ord)"),
    "branching_ratio": _seg("SELECT a.ord, a.n, round(a.n / b.n, 6) AS ratio FROM (SELECT ord, count(*) AS n FROM labelled WHERE n_points > 4 GROUP BY ord) a LEFT JOIN (SELECT ord, count(*) AS n FROM labelled WHERE n_points > 4 GROUP BY ord) b ON b.ord = a.ord + 1 WHERE a.ord < (SELECT max(ord) FROM labelled WHERE n_points > 4)"),
    "radius_bins": _seg("""SELECT b.bin, round(exp(lo + b.bin * (hi - lo) / 8), 6) AS "from", round(exp(lo + (b.bin + 1) * (hi - lo) / 8), 6) AS "to", count(s.r_mean) AS n, round(avg(s.r_mean), 6) AS mean
FROM (SELECT unnest(range(8)) AS bin) b CROSS JOIN (SELECT ln(min(r_mean)) AS lo, ln(max(r_mean) * 1.001) AS hi FROM segments WHERE r_mean > 0) e
LEFT JOIN segments s ON s.r_mean > 0 AND floor((ln(s.r_mean) - lo) / ((hi - lo) / 8)) = b.bin GROUP BY b.bin, lo, hi"""),
    "edge_midpoints": schema.sql("SELECT edge_id, pos, round(x, 6) AS x, round(y, 6) AS y, round(z, 6) AS z FROM (SELECT *, row_number() OVER (PARTITION BY edge_id ORDER BY round(abs(s - total / 2), 9), pos) AS k FROM (SELECT *, sum(step) OVER (PARTITION BY edge_id ORDER BY pos) AS s, sum(step) OVER (PARTITION BY edge_id) AS total FROM steps)) WHERE k = 1", "points", more=STEPS),
    "collapse_elements": _seg("""SELECT tree, count(*) AS n_segments, round(sum(length), 4) AS total, round(any_value(m), 4) AS mean, round(sum(volume), 4) AS volume, CAST(sum(n_points) AS BIGINT) AS n_points,
round(sqrt(coalesce(sum(length * (r_sd ** 2 + (r_mean - m) ** 2)) FILTER (length > 0) / nullif(sum(length), 0), avg(r_sd ** 2 + (r_mean - m) ** 2))), 4) AS pooled_sd
FROM (SELECT *, coalesce(sum(length * r_mean) OVER (PARTITION BY tree) / nullif(sum(length) OVER (PARTITION BY tree), 0), avg(r_mean) OVER (PARTITION BY tree)) AS m FROM labelled) GROUP BY tree"""),
    "radius_agreement": _seg("""SELECT ord, n, round(bias, 6) AS bias, round(sd, 6) AS sd, round(rmse, 6) AS rmse, round(mae, 6) AS mae, round(rel_bias, 6) AS rel_bias, round(bias - 1.96 * sd, 6) AS loa_low, round(bias + 1.96 * sd, 6) AS loa_high
FROM (SELECT ord, count(*) AS n, avg(d) AS bias, coalesce(stddev_samp(d), 0) AS sd, sqrt(avg(d ** 2)) AS rmse, avg(abs(d)) AS mae, avg(d / nullif(r_mean, 0)) AS rel_bias FROM (SELECT ord, r_mean, r_max - r_mean AS d FROM labelled) GROUP BY ROLLUP (ord))"""),
    "radius_weighted_quantile": _seg("""SELECT state, ord, round(CASE WHEN a IS NULL THEN b WHEN b IS NULL THEN a WHEN cb > ca THEN a + (b - a) * (0.75 - ca) / (cb - ca) ELSE a END, 6) AS quantile FROM (
SELECT state, ord, max(c) FILTER (c <= 0.75) AS ca, arg_max(r_mean, c) FILTER (c <= 0.75) AS a, min(c) FILTER (c >= 0.75) AS cb, arg_min(r_mean, c) FILTER (c >= 0.75) AS b FROM (
SELECT state, ord, r_mean, (sum(length) OVER (PARTITION BY state, ord ORDER BY r_mean, length ROWS UNBOUNDED PRECEDING) - length / 2) / sum(length) OVER (PARTITION BY state, ord) AS c FROM labelled WHERE length > 0) GROUP BY state, ord)"""),
    "rma_regression": _seg("""SELECT ord, CAST(regr_count(ll, lr) AS BIGINT) AS n, round(slope, 6) AS slope, round(avg(ll) - slope * avg(lr), 6) AS intercept, round(corr(ll, lr), 6) AS r FROM (
SELECT *, CASE WHEN corr(ll, lr) OVER (PARTITION BY ord) < 0 THEN -1 ELSE 1 END * sqrt(var_pop(ll) OVER (PARTITION BY ord) / var_pop(lr) OVER (PARTITION BY ord)) AS slope
FROM (SELECT ord, ln(r_mean) AS lr, ln(length) AS ll FROM labelled WHERE r_mean > 0 AND length > 0)) GROUP BY ord, slope"""),
    "state_contrast": _seg("SELECT ord, round(f, 6) AS state_f, round(o, 6) AS state_o, round(p, 6) AS state_p, round(100 * abs(f - o) / nullif(abs(o), 0), 6) AS change_percent FROM (SELECT ord, avg(r_mean) FILTER (state = 'F') AS f, avg(r_mean) FILTER (state = 'O') AS o, avg(r_mean) FILTER (state = 'P') AS p FROM labelled GROUP BY ord)"),
    "tidy_states": _seg("SELECT state, ord, metric, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS sd FROM (SELECT state, ord, unnest(['length', 'tortuosity', 'r_mean']) AS metric, unnest([length, tortuosity, r_mean]) AS value FROM labelled) GROUP BY state, ord, metric"),
    "outlet_resistances": _seg("""SELECT edge_id, tree, round(fraction, 4) AS fraction, round(60.0 / greatest(fraction, 1e-12), 4) AS resistance, round(1 / sum(greatest(fraction, 1e-12) / 60.0) OVER (PARTITION BY tree), 4) AS parallel
FROM (SELECT edge_id, tree, volume / sum(volume) OVER (PARTITION BY tree) AS fraction FROM labelled) WHERE fraction > 0 AND isfinite(fraction)"""),
    "size_fit": _seg("SELECT ord, round(regr_slope(y, x), 6) AS slope, round(regr_intercept(y, x), 6) AS intercept, round(regr_r2(y, x), 6) AS r2 FROM (SELECT ord, ln(n_points) AS x, ln(count(*)) AS y FROM labelled GROUP BY ord, n_points) GROUP BY ord"),
    "consistency": _seg("SELECT count(e.edge_id) AS n_edges, count(*) FILTER (s.edge_id IS NULL) AS edges_without_points, count(*) FILTER (e.edge_id IS NULL) AS points_without_edge, CAST(sum(n_points) AS BIGINT) AS n_points FROM edges e FULL JOIN segments s ON e.edge_id = s.edge_id"),
    "degenerate_segments": schema.sql("SELECT edge_id, count(*) AS n, round(max(step), 6) AS largest, round(sum(step), 6) AS length FROM steps GROUP BY edge_id HAVING count(*) >= 4 AND max(step) > 20 AND max(step) / sum(step) > 0.5", "points", more=STEPS),
    "lumped_areas": schema.sql("""SELECT edge_id, pos + k AS pos, round(sum(area / 3), 6) AS area FROM (SELECT edge_id, pos, unnest([0, 1, 2]) AS k,
sqrt((uy * vz - uz * vy) ** 2 + (uz * vx - ux * vz) ** 2 + (ux * vy - uy * vx) ** 2) / 2 AS area FROM (
SELECT edge_id, pos, lead(x) OVER w - x AS ux, lead(y) OVER w - y AS uy, lead(z) OVER w - z AS uz, lead(x, 2) OVER w - x AS vx, lead(y, 2) OVER w - y AS vy, lead(z, 2) OVER w - z AS vz
FROM points WINDOW w AS (PARTITION BY edge_id ORDER BY pos)) WHERE vx IS NOT NULL) GROUP BY 1, 2""", "points"),
    "representative_ranks": "SELECT p_brand, p_partkey, rank FROM (SELECT p_brand, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY round(abs(ln(p_retailprice / 1000)), 9), p_partkey) AS rank FROM part WHERE p_retailprice > 0) WHERE rank <= 3",
}
