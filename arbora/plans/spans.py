"""Queries along segments (windows, brackets, spans) and their oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from arbora import schema
from arbora.functions.statistics import rounded
from arbora.operators import morphometry as M
from arbora.operators import spans as S
from arbora.plans.morphometry import STEPS


def arclength(spark, d):
    return rounded(M.with_steps(schema.points(spark, d)).select("edge_id", "pos", "step", "s"))


def tangents(spark, d):
    return rounded(S.with_tangents(schema.points(spark, d)).select("edge_id", "pos", "tx", "ty", "tz"))


def turn_statistics(spark, d):
    rows = S.with_turns(schema.points(spark, d)).join(schema.edges(spark, d), "edge_id")
    return rounded(rows.groupBy("ord").agg(F.count("turn").alias("n"), F.percentile("turn", F.lit(0.5)).alias("median"), F.percentile("turn", F.lit(0.95)).alias("p95"), F.avg(F.when(F.col("turn") > 90, 1.0).when(F.col("turn").isNotNull(), 0.0)).alias("roughness")), 4)


def resampled_stations(spark, d):
    return rounded(S.stations(schema.points(spark, d), 10.0))


def radius_outliers(spark, d):
    rows = S.mark_outliers(schema.points(spark, d), "edge_id", "r", 12.0, 88.0)
    return rounded(S.fill_nearest(rows, "edge_id", "pos", "r", "outlier").select("edge_id", "pos", "r", "outlier", "filled"))


def radius_percentiles(spark, d):
    return rounded(S.percentile_by_position(schema.points(spark, d), "edge_id", "r", 30.0))


def sampling_jumps(spark, d):
    return rounded(S.jumps(schema.points(spark, d), 15.0, 1.4))


def split_jumps(spark, d):
    return S.split_at_jumps(schema.points(spark, d), 15.0, 1.4)


def flagged_runs(spark, d):
    return S.runs(schema.points(spark, d), "edge_id", "pos", F.col("r") < 30, 1, 1)


def merged_runs(spark, d):
    p = schema.points(spark, d)
    both = S.runs(p, "edge_id", "pos", F.col("r") < 30).unionByName(S.runs(p, "edge_id", "pos", F.col("x") > 25))
    return S.merge_runs(both, "edge_id")


def taper_fit(spark, d):
    return rounded(S.log_taper(M.with_steps(schema.points(spark, d)), "edge_id", "s", "r").where("n >= 3 and r2 is not null"))


def outlier_spans(spark, d):
    return S.outlier_spans(schema.points(spark, d))


def supported_values(spark, d):
    return rounded(S.interpolate_supported(schema.series(spark, d), "edge_id", "s", "value").select("edge_id", "pos", "value", "supported"), 5)


def straight_bridges(spark, d):
    return S.straight_bridges(schema.points(spark, d))


def contour_windows(spark, d):
    ring = schema.points(spark, d).join(schema.edges(spark, d), "edge_id").select("tree", (F.col("x") * 7 + F.col("z") * 11).alias("phi"), "r")
    return rounded(S.arc_windows(ring, "tree", "phi", "r"))


def arc_bins(spark, d):
    """Fixed bins along every segment: points and mean radius in each."""
    rows = M.with_steps(schema.points(spark, d)).withColumn("bin", F.floor(F.round(F.col("s") / 20, 9)))
    return rounded(rows.groupBy("edge_id", "bin").agg(F.count("*").alias("n"), F.avg("r").alias("r_mean")))


def terminal_shrink(spark, d):
    """Last radii clamped to not less than half of the one before."""
    before = F.lag("r").over(M.along())
    ends = schema.points(spark, d).withColumn("before", before).withColumn("last", F.lead("pos").over(M.along()).isNull())
    return rounded(ends.where("last and before is not null").select("edge_id", "r", F.greatest("r", F.col("before") / 2).alias("clamped")))


def sector_bands(spark, d):
    """Area-weighted means by eighths of a turn about the first axis."""
    rows = schema.points(spark, d).join(schema.edges(spark, d), "edge_id")
    turn = F.pmod(F.degrees(F.atan2(F.col("z") - 4, F.col("y") - 5)), F.lit(360.0))
    sector = F.least(F.floor(F.round(turn / 45, 9)), F.lit(7))
    return rounded(rows.groupBy("ord", sector.alias("sector")).agg(F.count("*").alias("n"), (F.sum(F.col("r") * F.col("x")) / F.sum("x")).alias("mean"), F.min("r").alias("low"), F.max("r").alias("high")))


_W = "WINDOW w AS (PARTITION BY edge_id ORDER BY pos)"
_TURNS = """turns AS (SELECT edge_id, pos, r, degrees(acos(greatest(least((ax * bx + ay * by_ + az * bz) / nullif(sqrt(ax ** 2 + ay ** 2 + az ** 2) * sqrt(bx ** 2 + by_ ** 2 + bz ** 2), 0), 1), -1))) AS turn,
  abs(lag(r) OVER w - 2 * r + lead(r) OVER w) / greatest(abs(r), 1e-12) AS second FROM (
  SELECT edge_id, pos, r, x - lag(x) OVER w AS ax, y - lag(y) OVER w AS ay, z - lag(z) OVER w AS az, lead(x) OVER w - x AS bx, lead(y) OVER w - y AS by_, lead(z) OVER w - z AS bz FROM points """ + _W + ") " + _W + ")"
_ARC = STEPS + ", arc AS (SELECT *, sum(step) OVER (PARTITION BY edge_id ORDER BY pos) AS s FROM steps)"
_JUMPS = STEPS + """, gaps AS (SELECT *, median(CASE WHEN pos > 0 THEN step END) OVER (PARTITION BY edge_id) AS med FROM steps),
jumps AS (SELECT edge_id, pos, step, med AS "median" FROM gaps WHERE pos > 0 AND step > greatest(15, 1.4 * med))"""


def _prctile(key: str, p: float, name: str) -> str:
    return f"""{name} AS (SELECT {key}, coalesce(CASE WHEN qb > qa THEN a + (b - a) * ({p} - qa) / (qb - qa) ELSE a END, a, b) AS lim FROM (
  SELECT {key}, max(q) FILTER (q <= {p}) AS qa, max(r) FILTER (q <= {p}) AS a, min(q) FILTER (q >= {p}) AS qb, min(r) FILTER (q >= {p}) AS b FROM (
  SELECT {key}, r, 100 * (row_number() OVER (PARTITION BY {key} ORDER BY r) - 0.5) / count(*) OVER (PARTITION BY {key}) AS q FROM points) GROUP BY {key}))"""


def _runs(name: str, flag: str) -> str:
    return f"""{name} AS (SELECT edge_id, min(pos) AS i0, max(pos) AS i1, count(*) AS n, any_value(stop) AS stop FROM (
  SELECT edge_id, pos, stop, pos - row_number() OVER (PARTITION BY edge_id ORDER BY pos) AS g FROM (SELECT *, max(pos) OVER (PARTITION BY edge_id) AS stop FROM points) WHERE {flag}) GROUP BY edge_id, g)"""


QUERIES = {f.__name__: f for f in (arclength, tangents, turn_statistics, resampled_stations, radius_outliers, radius_percentiles, sampling_jumps, split_jumps, flagged_runs, merged_runs, taper_fit, outlier_spans, supported_values, straight_bridges, contour_windows, arc_bins, terminal_shrink, sector_bands)}
ORACLES = {
    "arclength": schema.sql("SELECT edge_id, pos, round(step, 6) AS step, round(s, 6) AS s FROM arc", "points", more=_ARC),
    "tangents": schema.sql(f"SELECT edge_id, pos, round(dx / n, 6) AS tx, round(dy / n, 6) AS ty, round(dz / n, 6) AS tz FROM (SELECT *, nullif(sqrt(dx ** 2 + dy ** 2 + dz ** 2), 0) AS n FROM (SELECT edge_id, pos, coalesce(lead(x) OVER w, x) - coalesce(lag(x) OVER w, x) AS dx, coalesce(lead(y) OVER w, y) - coalesce(lag(y) OVER w, y) AS dy, coalesce(lead(z) OVER w, z) - coalesce(lag(z) OVER w, z) AS dz FROM points {_W}))", "points"),
    "turn_statistics": schema.sql("SELECT ord, count(turn) AS n, round(quantile_cont(turn, 0.5), 4) AS \"median\", round(quantile_cont(turn, 0.95), 4) AS p95, round(avg(CASE WHEN turn > 90 THEN 1.0 WHEN turn IS NOT NULL THEN 0.0 END), 4) AS roughness FROM turns JOIN edges USING (edge_id) GROUP BY ord", "points", "edges", more=_TURNS),
    "resampled_stations": schema.sql(f"""SELECT edge_id, k AS station, round(x + t * (coalesce(x1, x) - x), 6) AS x, round(y + t * (coalesce(y1, y) - y), 6) AS y, round(z + t * (coalesce(z1, z) - z), 6) AS z, round(r + t * (coalesce(r1, r) - r), 6) AS r
FROM (SELECT *, CASE WHEN s1 > s THEN (k * 10 - s) / (s1 - s) ELSE 0 END AS t FROM (
SELECT *, unnest(CASE WHEN x1 IS NULL AND round(s / 10, 9) = floor(round(s / 10, 9)) THEN [CAST(floor(round(s / 10, 9)) AS BIGINT)] ELSE range(CAST(ceil(round(s / 10, 9)) AS BIGINT), CAST(ceil(round(s1 / 10, 9)) AS BIGINT)) END) AS k
FROM (SELECT *, coalesce(lead(s) OVER w, s) AS s1, lead(x) OVER w AS x1, lead(y) OVER w AS y1, lead(z) OVER w AS z1, lead(r) OVER w AS r1 FROM arc {_W})))""", "points", more=_ARC),
    "radius_outliers": schema.sql("""SELECT edge_id, pos, round(r, 6) AS r, outlier, round(CASE WHEN NOT outlier THEN r WHEN pa IS NULL AND pb IS NULL THEN r WHEN pa IS NULL THEN vb WHEN pb IS NULL OR pos - pa <= pb - pos THEN va ELSE vb END, 6) AS filled FROM (
SELECT *, max(CASE WHEN NOT outlier THEN pos END) OVER b AS pa, arg_max(r, CASE WHEN NOT outlier THEN pos END) OVER b AS va, min(CASE WHEN NOT outlier THEN pos END) OVER f AS pb, arg_min(r, CASE WHEN NOT outlier THEN pos END) OVER f AS vb
FROM (SELECT p.*, r < lo.lim OR r > hi.lim AS outlier FROM points p JOIN lo USING (edge_id) JOIN hi USING (edge_id))
WINDOW b AS (PARTITION BY edge_id ORDER BY pos ROWS UNBOUNDED PRECEDING), f AS (PARTITION BY edge_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))""", "points", more=_prctile("edge_id", 12.0, "lo") + ", " + _prctile("edge_id", 88.0, "hi")),
    "radius_percentiles": schema.sql('SELECT edge_id, round(lim, 6) AS "limit" FROM p30', "points", more=_prctile("edge_id", 30.0, "p30")),
    "sampling_jumps": schema.sql('SELECT edge_id, pos, round(step, 6) AS step, round("median", 6) AS "median" FROM jumps', "points", more=_JUMPS),
    "split_jumps": schema.sql("SELECT edge_id, pos, part, row_number() OVER (PARTITION BY edge_id, part ORDER BY pos) - 1 AS at FROM (SELECT p.edge_id, p.pos, CAST(sum(CASE WHEN j.pos IS NULL THEN 0 ELSE 1 END) OVER (PARTITION BY p.edge_id ORDER BY p.pos) AS BIGINT) AS part FROM points p LEFT JOIN jumps j ON j.edge_id = p.edge_id AND j.pos = p.pos)", "points", more=_JUMPS),
    "flagged_runs": schema.sql("SELECT edge_id, greatest(i0 - 1, 0) AS i0, least(i1 + 1, stop) AS i1, n FROM a", "points", more=_runs("a", "r < 30")),
    "merged_runs": schema.sql("SELECT edge_id, min(i0) AS i0, max(i1) AS i1, count(*) AS n_spans FROM (SELECT *, sum(new) OVER (PARTITION BY edge_id ORDER BY i0, i1 ROWS UNBOUNDED PRECEDING) AS g FROM (SELECT *, CASE WHEN i0 <= max(i1) OVER (PARTITION BY edge_id ORDER BY i0, i1 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 1 THEN 0 ELSE 1 END AS new FROM (SELECT edge_id, i0, i1 FROM a UNION ALL SELECT edge_id, i0, i1 FROM b))) GROUP BY edge_id, g", "points", more=_runs("a", "r < 30") + ", " + _runs("b", "x > 25")),
    "taper_fit": schema.sql("SELECT * FROM (SELECT edge_id, count(*) AS n, round(regr_slope(ln(r), s), 6) AS slope, round(regr_intercept(ln(r), s), 6) AS intercept, round(regr_r2(ln(r), s), 6) AS r2 FROM arc WHERE r > 0 GROUP BY edge_id) WHERE n >= 3 AND r2 IS NOT NULL", "points", more=_ARC),
    "outlier_spans": schema.sql("""SELECT edge_id, min(pos) AS i0, max(pos) AS i1, count(*) AS n FROM (SELECT edge_id, pos, pos - row_number() OVER (PARTITION BY edge_id ORDER BY pos) AS g FROM (
SELECT u.*, max(pos) OVER (PARTITION BY u.edge_id) AS stop, slope, intercept FROM usable u JOIN again a ON a.edge_id = u.edge_id) WHERE r < 0.6 * exp(intercept + slope * s) AND pos >= 1 AND pos <= stop - 1) GROUP BY edge_id, g HAVING count(*) >= 2""", "points", more=_ARC + """,
usable AS (SELECT * FROM (SELECT edge_id, pos, s, r, ln(r) AS lr, count(*) OVER (PARTITION BY edge_id) AS size FROM arc WHERE r > 0) WHERE size >= 6),
fit AS (SELECT edge_id, regr_slope(lr, s) AS slope, regr_intercept(lr, s) AS intercept FROM usable GROUP BY edge_id),
off AS (SELECT u.*, round(lr - intercept - slope * s, 9) AS off FROM usable u JOIN fit USING (edge_id) WHERE slope IS NOT NULL),
again AS (SELECT * FROM (SELECT edge_id, count(*) AS n, regr_slope(lr, s) AS slope, regr_intercept(lr, s) AS intercept FROM (SELECT *, median(off) OVER (PARTITION BY edge_id) AS mid FROM off) WHERE off >= mid GROUP BY edge_id) WHERE n >= 4 AND slope IS NOT NULL)"""),
    "supported_values": schema.sql("""SELECT edge_id, pos, round(value, 5) AS value, round(coalesce(value, va + (vb - va) * (s - sa) / (sb - sa)), 5) AS supported FROM (
SELECT *, max(CASE WHEN value IS NOT NULL THEN s END) OVER b AS sa, arg_max(value, CASE WHEN value IS NOT NULL THEN s END) OVER b AS va, min(CASE WHEN value IS NOT NULL THEN s END) OVER f AS sb, arg_min(value, CASE WHEN value IS NOT NULL THEN s END) OVER f AS vb FROM series
WINDOW b AS (PARTITION BY edge_id ORDER BY s ROWS UNBOUNDED PRECEDING), f AS (PARTITION BY edge_id ORDER BY s ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))""", "series"),
    "straight_bridges": schema.sql("SELECT edge_id, min(pos) AS i0, max(pos) AS i1, count(*) AS n FROM (SELECT edge_id, pos, pos - row_number() OVER (PARTITION BY edge_id ORDER BY pos) AS g FROM turns WHERE cos(radians(turn)) >= 0.99 AND second <= 0.2) GROUP BY edge_id, g", "points", more=_TURNS),
    "contour_windows": schema.sql("""SELECT tree, round(max(m), 6) AS arc_max, round(min(m), 6) AS arc_min, CAST(first(c ORDER BY m DESC, c) AS BIGINT) AS max_at, CAST(first(c ORDER BY m, c) AS BIGINT) AS min_at, round(any_value(ring), 6) AS ring FROM (
SELECT tree, c, round(avg(r), 9) AS m, any_value(ring) AS ring FROM (SELECT *, avg(r) OVER (PARTITION BY tree) AS ring FROM (SELECT tree, x * 7 + z * 11 AS phi, r FROM points JOIN edges USING (edge_id))), (SELECT unnest(range(0, 360, 5)) AS c)
WHERE abs((((phi - c + 180) % 360) + 360) % 360 - 180) <= 45 + 1e-9 GROUP BY tree, c) GROUP BY tree""", "points", "edges"),
    "arc_bins": schema.sql("SELECT edge_id, CAST(floor(round(s / 20, 9)) AS BIGINT) AS bin, count(*) AS n, round(avg(r), 6) AS r_mean FROM arc GROUP BY 1, 2", "points", more=_ARC),
    "terminal_shrink": schema.sql(f"SELECT edge_id, round(r, 6) AS r, round(greatest(r, before / 2), 6) AS clamped FROM (SELECT edge_id, r, lag(r) OVER w AS before, lead(pos) OVER w AS nxt FROM points {_W}) WHERE nxt IS NULL AND before IS NOT NULL", "points"),
    "sector_bands": schema.sql("SELECT ord, least(CAST(floor(round(((degrees(atan2(z - 4, y - 5)) % 360) + 360) % 360 / 45, 9)) AS BIGINT), 7) AS sector, count(*) AS n, round(sum(r * x) / sum(x), 6) AS mean, round(min(r), 6) AS low, round(max(r), 6) AS high FROM points JOIN edges USING (edge_id) GROUP BY 1, 2", "points", "edges"),
}
