"""Queries over the scalar formulas, and their oracles."""

from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import functions as F

from arbora import schema
from arbora.functions import geometry as G
from arbora.functions.statistics import rma, rounded
from arbora.operators import morphometry as M
from arbora.session import table

BLEND = {"k_base": 2.0, "reference": 10.0, "low": 0.3, "high": 1.5}


def radius_scalars(spark, d):
    """Every point's radius as an inflated, corrected, meshed and loaded one."""
    r, lam = F.col("r"), (F.col("y") + 1) / 11
    a, b = G.semi_axes(r, lam)
    re, im = G.impedance((F.col("pos") + 1).cast("double"), r, F.col("x"), (F.col("z") + 1) / 100)
    return rounded(
        schema.points(spark, d).select(
            "edge_id", "pos", G.ramanujan_h(lam).alias("h"), a.alias("a"), b.alias("b"), G.correct_perimeter_radius(r, F.col("z")).alias("corrected"), G.adaptive_smin_k(r, **BLEND).alias("k"),
            G.radius_mesh_size(r, F.col("x"), 0.02, 40.0).alias("mesh"), G.boundary_layer_thickness(r, 6.0).alias("layer"), G.calibrated_size(F.col("x"), r, F.col("y") + 1).alias("size"),
            re.alias("re"), im.alias("im"), G.local_euler(F.col("pos")).alias("euler"),
        )
    )


def field_values(spark, d):
    """Distance of every second next point to the capsule and the round cone of a point and the next, and the blended radii."""
    at = lambda c, k: F.lead(c, k).over(M.along())
    p = schema.points(spark, d)
    p = p.select("edge_id", "pos", "x", "y", "z", "r", *(at(c, k).alias(f"{c}{k}") for k in (1, 2) for c in "xyz"), at("r", 1).alias("r1")).where("x2 is not null")
    a, b, q = (tuple(F.col(f"{c}{k}") for c in "xyz") for k in ("", 1, 2))
    value, radius, t = G.tapered_capsule(q, a, b, F.col("r"), F.col("r1"))
    return rounded(p.select("edge_id", "pos", value.alias("capsule"), radius.alias("radius"), t.alias("t"), G.round_cone(q, a, b, F.col("r"), F.col("r1")).alias("cone"), G.smooth_min_poly_pair(F.col("r"), F.col("r1"), 5.0).alias("blend"), G.soft_cap(F.col("r"), 40.0, 5.0).alias("soft"), G.soft_cap(F.col("r"), 40.0, 0.0).alias("hard")))


def smooth_minima(spark, d):
    return rounded(G.smooth_min_exp(schema.points(spark, d), ["edge_id"], "r", 0.5))


def polygon_sections(spark, d):
    return rounded(G.polygon_area_centroid(schema.points(spark, d), "edge_id", "pos"))


def parsed_specs(spark, d):
    spec = F.concat("p_type", F.lit(" [size="), "p_size", F.lit("; max-key ="), "p_partkey", F.lit("]"))
    name, params = G.parse_candidate(spec)
    omega = G.parse_omega(F.when(F.col("p_size") % 2 == 0, F.concat("p_size", F.lit(":"), F.col("p_size") + 3)).otherwise(F.concat("p_size", F.lit(", 7,"), "p_partkey")))
    rows = table(spark, d, "part").select("p_partkey", name.alias("name"), params.alias("params"), omega.alias("omega"))
    return rows.select("p_partkey", "name", F.element_at("params", "size").alias("size"), F.element_at("params", "max_key").alias("max_key"), F.size("omega").cast("long").alias("n_omega"), F.aggregate("omega", F.lit(0).cast("long"), lambda a, x: a + x).alias("sum_omega"))


def config_digests(spark, d):
    return schema.edges(spark, d).select("edge_id", G.config_digest({"tree": F.col("tree"), "ord": F.col("ord"), "state": F.col("state")}).alias("digest"))


def rma_intervals(spark, d):
    """The reduced-major-axis line of log length by log radius of every order, with Ricker's and Jolicoeur and Mosimann's intervals at 95 %."""
    rows = M.segment_geometry(schema.points(spark, d)).join(schema.edges(spark, d), "edge_id").where("r_mean > 0 and length > 0").select("ord", F.log("r_mean").alias("x"), F.log("length").alias("y"))
    y, x = F.col("y"), F.col("x")
    sums = {"sxx": F.regr_sxx(y, x), "syy": F.regr_syy(y, x), "sxy": F.regr_sxy(y, x), "mx": F.regr_avgx(y, x), "my": F.regr_avgy(y, x)}
    line = rows.groupBy("ord").agg(*(c.alias(k) for k, c in (rma("x", "y") | sums).items())).where("n > 3")
    t = G.student_t(0.975, F.col("n") - 2)
    half = t * F.sqrt((F.col("syy") - F.col("sxy") ** 2 / F.col("sxx")) / (F.col("n") - 2) / F.col("sxx"))
    b = t * t * (1 - F.col("r") ** 2) / (F.col("n") - 2)
    low, high = F.col("slope") - half, F.col("slope") + half
    one, two = F.col("slope") * (F.sqrt(b + 1) - F.sqrt(b)), F.col("slope") * (F.sqrt(b + 1) + F.sqrt(b))
    jm_low, jm_high = F.least(one, two), F.greatest(one, two)
    other = lambda s: F.col("my") - F.col("mx") * s
    pair = lambda a, z: (F.least(other(a), other(z)), F.greatest(other(a), other(z)))
    named = {"ricker_slope_low": low, "ricker_slope_high": high, "jm_slope_low": jm_low, "jm_slope_high": jm_high}
    named |= dict(zip(("ricker_intercept_low", "ricker_intercept_high"), pair(low, high))) | dict(zip(("jm_intercept_low", "jm_intercept_high"), pair(jm_low, jm_high)))
    return rounded(line.select("ord", "n", "slope", "intercept", "r", *(c.alias(k) for k, c in named.items())))


def _dot(a: str, b: str) -> str:
    return " + ".join(f"({a.format(c)}) * ({b.format(c)})" for c in "xyz")


_SQL_PAIR = "least({a}, {b}) - power(greatest({k} - abs({a} - {b}), 0), 2) / (4 * {k})"
_STEPS = "steps AS (SELECT * FROM (SELECT *, " + ", ".join(f"lead({c}, {k}) OVER w AS {c}{k}" for k in (1, 2) for c in "xyz") + ", lead(r) OVER w AS r1 FROM points WINDOW w AS (PARTITION BY edge_id ORDER BY pos)) WHERE x2 IS NOT NULL)"
_FIELD = _STEPS + f""",
laid AS (SELECT *, {_dot("{0}1 - {0}", "{0}1 - {0}")} AS size2, {_dot("{0}2 - {0}", "{0}1 - {0}")} AS ahead, {_dot("{0}2 - {0}", "{0}2 - {0}")} AS off2, r - r1 AS narrow FROM steps),
footed AS (SELECT *, least(greatest(ahead / greatest(size2, 1e-30), 0), 1) AS t, sqrt(greatest(size2, 1e-300)) AS size, size2 - narrow * narrow AS flat FROM laid),
sided AS (SELECT *, ahead / size AS along, sqrt(greatest(off2 - (ahead / size) * (ahead / size), 0)) AS aside, sqrt(greatest(flat, 0)) AS slope FROM footed),
ends AS (SELECT *, (along * slope - aside * narrow) / size AS foot, sqrt(off2) - r AS to_a, sqrt({_dot("{0}2 - {0}1", "{0}2 - {0}1")}) - r1 AS to_b FROM sided)"""
_Z = NormalDist().inv_cdf(0.975)
_T = "({z} + {a} / (n - 2) + {b} / power(n - 2, 2) + {c} / power(n - 2, 3) + {d} / power(n - 2, 4))".format(z=_Z, a=(_Z**3 + _Z) / 4, b=(5 * _Z**5 + 16 * _Z**3 + 3 * _Z) / 96, c=(3 * _Z**7 + 19 * _Z**5 + 17 * _Z**3 - 15 * _Z) / 384, d=(79 * _Z**9 + 776 * _Z**7 + 1482 * _Z**5 - 1920 * _Z**3 - 945 * _Z) / 92160)
_SEGMENTS = """seg AS (SELECT edge_id, avg(r) AS r_mean, sum(step) AS length FROM (SELECT *, coalesce(sqrt(power(x - lag(x) OVER w, 2) + power(y - lag(y) OVER w, 2) + power(z - lag(z) OVER w, 2)), 0) AS step FROM points WINDOW w AS (PARTITION BY edge_id ORDER BY pos)) GROUP BY edge_id),
logs AS (SELECT ord, ln(r_mean) AS x, ln(length) AS y FROM seg JOIN edges USING (edge_id) WHERE r_mean > 0 AND length > 0),
sums AS (SELECT ord, count(*) AS n, regr_sxx(y, x) AS sxx, regr_syy(y, x) AS syy, regr_sxy(y, x) AS sxy, avg(x) AS mx, avg(y) AS my, corr(y, x) AS r FROM logs GROUP BY ord HAVING count(*) > 3),
lines AS (SELECT *, CASE WHEN r < 0 THEN -1 ELSE 1 END * sqrt(syy / sxx) AS slope, """ + _T + """ * sqrt((syy - sxy * sxy / sxx) / (n - 2) / sxx) AS half, """ + _T + " * " + _T + """ * (1 - r * r) / (n - 2) AS b FROM sums),
bounds AS (SELECT *, slope - half AS rl, slope + half AS rh, least(slope * (sqrt(b + 1) - sqrt(b)), slope * (sqrt(b + 1) + sqrt(b))) AS jl, greatest(slope * (sqrt(b + 1) - sqrt(b)), slope * (sqrt(b + 1) + sqrt(b))) AS jh FROM lines)"""

QUERIES = {f.__name__: f for f in (radius_scalars, field_values, smooth_minima, polygon_sections, parsed_specs, config_digests, rma_intervals)}
ORACLES = {
    "radius_scalars": schema.sql(
        f"""SELECT edge_id, pos, round(h, 6) AS h, round(2 * r / h, 6) AS a, round(lam * 2 * r / h, 6) AS b, round(CASE WHEN r > 0 THEN r / {G.CHAIN_CODE_FACTOR} + {G.CENTRE_TRACE_INSET} * z ELSE r END, 6) AS corrected,
round(least(greatest(20.0 / greatest(r, 1e-12), 0.3), 1.5), 6) AS k, round(CASE WHEN r > 0 AND x > 0 THEN least(greatest(2 * r / x, 0.02), 40) END, 6) AS mesh, round(least(6.0, 0.15 * r), 6) AS layer,
round(CASE WHEN x > 0 AND r > 0 THEN x * pow(r / (y + 1), 1 / 3) END, 6) AS size, round(r + x / (1 + turn * turn), 6) AS re, round(-x * turn / (1 + turn * turn), 6) AS im, 2 - pos AS euler
FROM (SELECT *, 3 * (1 + lam) - sqrt((3 + lam) * (1 + 3 * lam)) AS h, (pos + 1) * x * (z + 1) / 100 AS turn FROM (SELECT *, (y + 1) / 11 AS lam FROM points))""",
        "points",
    ),
    "field_values": schema.sql(
        f"""SELECT edge_id, pos, round(sqrt(off2 - 2 * t * ahead + t * t * size2) - (r + t * (r1 - r)), 6) AS capsule, round(r + t * (r1 - r), 6) AS radius, round(t, 6) AS t,
round(CASE WHEN flat <= 0 THEN CASE WHEN r >= r1 THEN to_a ELSE to_b END WHEN foot <= 0 THEN to_a WHEN foot >= slope THEN to_b ELSE (aside * slope + along * narrow) / size - r END, 6) AS cone,
round({_SQL_PAIR.format(a="r", b="r1", k=5.0)}, 6) AS blend, round({_SQL_PAIR.format(a="r", b=40.0, k=5.0)}, 6) AS soft, round(least(r, 40), 6) AS hard FROM ends""",
        "points", more=_FIELD,
    ),
    "smooth_minima": schema.sql("SELECT edge_id, round(min(m) - ln(sum(exp(-0.5 * (r - m)))) / 0.5, 6) AS smooth_min FROM (SELECT *, min(r) OVER (PARTITION BY edge_id) AS m FROM points) GROUP BY edge_id", "points"),
    "polygon_sections": schema.sql("SELECT edge_id, round(abs(a), 6) AS area, round(sx / (6 * a), 6) AS cx, round(sy / (6 * a), 6) AS cy FROM (SELECT edge_id, CASE WHEN abs(sum(c) / 2) > 1e-12 THEN sum(c) / 2 END AS a, sum((x + x1) * c) AS sx, sum((y + y1) * c) AS sy FROM (SELECT *, x * y1 - x1 * y AS c FROM (SELECT edge_id, x, y, coalesce(lead(x) OVER w, first_value(x) OVER w) AS x1, coalesce(lead(y) OVER w, first_value(y) OVER w) AS y1 FROM points WINDOW w AS (PARTITION BY edge_id ORDER BY pos))) GROUP BY edge_id)", "points"),
    "parsed_specs": "SELECT p_partkey, p_type AS name, CAST(p_size AS VARCHAR) AS size, CAST(p_partkey AS VARCHAR) AS max_key, CASE WHEN p_size % 2 = 0 THEN CAST(4 AS BIGINT) ELSE 3 END AS n_omega, CAST(CASE WHEN p_size % 2 = 0 THEN 4 * p_size + 6 ELSE p_size + 7 + p_partkey END AS BIGINT) AS sum_omega FROM part",
    "config_digests": schema.sql("""SELECT edge_id, substr(sha256('{"ord": ' || ord || ', "state": "' || state || '", "tree": ' || tree || '}'), 1, 16) AS digest FROM edges""", "edges"),
    "rma_intervals": schema.sql("SELECT ord, n, round(slope, 6) AS slope, round(my - mx * slope, 6) AS intercept, round(r, 6) AS r, round(rl, 6) AS ricker_slope_low, round(rh, 6) AS ricker_slope_high, round(jl, 6) AS jm_slope_low, round(jh, 6) AS jm_slope_high, round(least(my - mx * rl, my - mx * rh), 6) AS ricker_intercept_low, round(greatest(my - mx * rl, my - mx * rh), 6) AS ricker_intercept_high, round(least(my - mx * jl, my - mx * jh), 6) AS jm_intercept_low, round(greatest(my - mx * jl, my - mx * jh), 6) AS jm_intercept_high FROM bounds", "points", "edges", more=_SEGMENTS),
}
