"""Scalar formulas as column expressions: nulls give null, and inputs outside a formula's domain give null instead of an error."""

from __future__ import annotations

import math
from statistics import NormalDist

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Fixed values of the digitisation correction: by how much a traced contour is too long, and how far inside the edge it runs (voxels).
CHAIN_CODE_FACTOR, CENTRE_TRACE_INSET = 1.0548, 0.5
Point = tuple[Column, Column, Column]


def clip(x: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def ramanujan_h(lam: Column) -> Column:
    """The factor of an ellipse's perimeter, pi * a * h, for the ratio lam of its axes."""
    return 3 * (1 + lam) - F.sqrt((3 + lam) * (1 + 3 * lam))


def semi_axes(r0: Column, lam: Column) -> tuple[Column, Column]:
    """The axes of the ellipse of ratio lam that has the perimeter of a circle of radius r0."""
    a = 2 * r0 / ramanujan_h(lam)
    return a, lam * a


def correct_perimeter_radius(r: Column, spacing: Column) -> Column:
    return F.when(r > 0, r / CHAIN_CODE_FACTOR + CENTRE_TRACE_INSET * spacing).otherwise(r)


def smooth_min_poly_pair(a: Column, b: Column, k: Column | float) -> Column:
    k = k if isinstance(k, Column) else F.lit(float(k))
    near = F.greatest(k - F.abs(a - b), F.lit(0.0))
    return F.least(a, b) - near * near / (4 * F.greatest(k, F.lit(1e-9)))


def soft_cap(x: Column, cap: Column | float, knee: float) -> Column:
    cap = cap if isinstance(cap, Column) else F.lit(float(cap))
    return smooth_min_poly_pair(x, cap, knee) if knee > 0 else F.least(x, cap)


def adaptive_smin_k(radius: Column, k_base: float, reference: float, low: float, high: float) -> Column:
    """A sharpness that falls with the radius, so that k * r stays the same, within its bounds."""
    return clip(k_base * reference / F.greatest(radius, F.lit(1e-12)), low, high)


def smooth_min_exp(rows: DataFrame, keys: list[str], value: str, k: float) -> DataFrame:
    """(keys, smooth_min): -ln(sum exp(-k v)) / k of each group, measured from its minimum. One shuffle."""
    least = F.min(value).over(Window.partitionBy(*keys))
    return rows.select(*keys, value, least.alias("least_")).groupBy(*keys).agg((F.min("least_") - F.ln(F.sum(F.exp(-k * (F.col(value) - F.col("least_"))))) / k).alias("smooth_min"))


def radius_mesh_size(radius: Column, n_d: Column, low: float = 0.02, high: float = 0.4) -> Column:
    return F.when((radius > 0) & (n_d > 0), clip(2 * radius / F.when(n_d > 0, n_d), low, high))


def boundary_layer_thickness(radius: Column, requested: float = 0.2, ratio: float = 0.15) -> Column:
    return F.least(F.lit(requested), ratio * radius)


def calibrated_size(old_h: Column, old_count: Column, target_count: Column) -> Column:
    """The size that gives target_count cells if old_h gave old_count: counts go with the cube of the size."""
    fine = (old_h > 0) & (old_count > 0) & (target_count > 0)
    return F.when(fine, old_h * F.pow(old_count / F.when(target_count > 0, target_count), F.lit(1 / 3)))


def local_euler(chi: Column) -> Column:
    return 2 - chi


def impedance(omega: Column, rp: Column, rd: Column, compliance: Column) -> tuple[Column, Column]:
    """Real and imaginary part of rp + rd / (1 + i omega rd compliance)."""
    turn = omega * rd * compliance
    return rp + rd / (1 + turn * turn), -rd * turn / (1 + turn * turn)


def _dot(a: Point, b: Point) -> Column:
    return sum((x * y for x, y in zip(a, b)), F.lit(0.0))


def _less(a: Point, b: Point) -> Point:
    return tuple(x - y for x, y in zip(a, b))


def tapered_capsule(p: Point, a: Point, b: Point, ra: Column, rb: Column) -> tuple[Column, Column, Column]:
    """Distance from p to the axis less the radius there, that radius, and where on the axis (0 to 1) it is."""
    axis = _less(b, a)
    t = clip(_dot(_less(p, a), axis) / F.greatest(_dot(axis, axis), F.lit(1e-30)), 0.0, 1.0)
    off = _less(p, tuple(x + t * y for x, y in zip(a, axis)))
    radius = ra + t * (rb - ra)
    return F.sqrt(_dot(off, off)) - radius, radius, t


def round_cone(p: Point, a: Point, b: Point, ra: Column, rb: Column) -> Column:
    """Exact signed distance from p to the hull of two balls: to the flank where its foot is on it, else to a ball; to the larger ball if that holds the other."""
    axis, off, narrow = _less(b, a), _less(p, a), ra - rb
    size2 = _dot(axis, axis)
    flat = size2 - narrow * narrow
    size = F.sqrt(F.greatest(size2, F.lit(1e-300)))
    along = _dot(off, axis) / size
    aside = F.sqrt(F.greatest(_dot(off, off) - along * along, F.lit(0.0)))
    slope = F.sqrt(F.greatest(flat, F.lit(0.0)))
    # the flank leans by narrow over size: measured along its direction, its ends are at 0 and slope
    foot = (along * slope + aside * -narrow) / size
    to = lambda c, r: F.sqrt(_dot(_less(p, c), _less(p, c))) - r
    flank = (aside * slope + along * narrow) / size - ra
    return F.when(flat <= 0, F.when(ra >= rb, to(a, ra)).otherwise(to(b, rb))).when(foot <= 0, to(a, ra)).when(foot >= slope, to(b, rb)).otherwise(flank)


def polygon_area_centroid(points: DataFrame, key: str, order: str, x: str = "x", y: str = "y") -> DataFrame:
    """(key, area, cx, cy) of every closed polygon by the shoelace rule; null where it has no area."""
    row = Window.partitionBy(key).orderBy(order)
    nxt = lambda c: F.coalesce(F.lead(c).over(row), F.first(c).over(row.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    sides = points.select(key, F.col(x).alias("x"), F.col(y).alias("y"), nxt(x).alias("x1"), nxt(y).alias("y1"))
    cross = F.col("x") * F.col("y1") - F.col("x1") * F.col("y")
    sums = sides.groupBy(key).agg((F.sum(cross) / 2).alias("a"), F.sum((F.col("x") + F.col("x1")) * cross).alias("sx"), F.sum((F.col("y") + F.col("y1")) * cross).alias("sy"))
    area = F.when(F.abs("a") > 1e-12, F.col("a"))
    return sums.select(key, F.abs(area).alias("area"), (F.col("sx") / (6 * area)).alias("cx"), (F.col("sy") / (6 * area)).alias("cy"))


def parse_candidate(spec: Column) -> tuple[Column, Column]:
    """Name and parameters (map of strings, - in names as _) of `name[key=value;key=value]`; a null map where the brackets or an item are malformed."""
    body = F.regexp_extract(F.trim(spec), r"^[^\[]*\[(.*)\]$", 1)
    items = F.filter(F.transform(F.split(body, ";"), lambda i: F.trim(i)), lambda i: i != "")
    named = F.map_from_entries(F.transform(items, lambda i: F.struct(F.replace(F.trim(F.substring_index(i, "=", 1)), F.lit("-"), F.lit("_")), F.trim(F.substr(i, F.instr(i, "=") + 1)))))
    whole = ~F.contains(spec, F.lit("[")) | F.rlike(F.trim(spec), F.lit(r"\]$"))
    return F.trim(F.substring_index(spec, "[", 1)), F.when(whole & F.forall(items, lambda i: F.contains(i, F.lit("="))), named)


def parse_omega(spec: Column) -> Column:
    """The whole numbers of `lo:hi` (null if they descend) or `a,b,c`."""
    low, high = F.try_element_at(F.split(spec, ":"), F.lit(1)).try_cast("int"), F.try_element_at(F.split(spec, ":"), F.lit(2)).try_cast("int")
    listed = F.transform(F.filter(F.split(spec, ","), lambda v: F.trim(v) != ""), lambda v: F.trim(v).try_cast("int"))
    return F.when(F.contains(spec, F.lit(":")), F.when(low <= high, F.sequence(F.least(low, high), F.greatest(low, high)))).otherwise(listed)


def config_digest(values: dict[str, Column]) -> Column:
    """The first 16 hex digits of the SHA-256 of the values as JSON with sorted keys, `{"a": 1, "b": "x"}`."""
    shown = lambda c: F.substr(F.to_json(F.array(c)), F.lit(2), F.length(F.to_json(F.array(c))) - 2)
    parts = [F.concat(F.lit(f'"{k}": '), F.coalesce(shown(v), F.lit("null"))) for k, v in sorted(values.items())]
    return F.substring(F.sha2(F.concat(F.lit("{"), F.concat_ws(", ", *parts), F.lit("}")), 256), 1, 16)


def _t_below(t: float, n: int) -> float:
    """Student's distribution function at t >= 0 for n whole degrees of freedom: a finite sum of powers of the cosine of atan(t / sqrt(n))."""
    angle = math.atan(t / math.sqrt(n))
    c2, term, total = math.cos(angle) ** 2, 1.0, 0.0
    if n % 2:
        for k in range(1, n - 1, 2):  # cos + 2/3 cos^3 + 2*4/(3*5) cos^5 ...
            total += term
            term *= c2 * (k + 1) / (k + 2)
        inside = (angle + math.sin(angle) * math.cos(angle) * total) * 2 / math.pi
    else:
        for k in range(0, n - 1, 2):  # 1 + 1/2 cos^2 + 1*3/(2*4) cos^4 ...
            total += term
            term *= c2 * (k + 1) / (k + 2)
        inside = math.sin(angle) * total
    return 0.5 + inside / 2


def t_quantile(p: float, n: int) -> float:
    """Quantile of Student's distribution for n whole degrees of freedom, by bisection."""
    if p < 0.5:
        return -t_quantile(1 - p, n)
    low, high = 0.0, 1.0
    while _t_below(high, n) < p and high < 1e12:
        high *= 2
    for _ in range(200):
        middle = (low + high) / 2
        low, high = (middle, high) if _t_below(middle, n) < p else (low, middle)
    return (low + high) / 2


#: Degrees of freedom up to which quantiles are exact; beyond, the expansion about the normal quantile is right to 1e-8.
EXACT_DEGREES = 40


def student_t(p: float, df: Column) -> Column:
    """Quantile of Student's distribution by whole degrees of freedom; null below 1."""
    z = NormalDist().inv_cdf(p)
    terms = [(z**3 + z) / 4, (5 * z**5 + 16 * z**3 + 3 * z) / 96, (3 * z**7 + 19 * z**5 + 17 * z**3 - 15 * z) / 384, (79 * z**9 + 776 * z**7 + 1482 * z**5 - 1920 * z**3 - 945 * z) / 92160]
    n = F.when(df > 0, df.cast("double"))
    far = F.lit(z) + sum((F.lit(t) / F.pow(n, F.lit(float(i + 1))) for i, t in enumerate(terms)), F.lit(0.0))
    exact = F.get(F.array(*(F.lit(t_quantile(p, k)) for k in range(1, EXACT_DEGREES + 1))), (n - 1).cast("int"))
    return F.when(n <= EXACT_DEGREES, exact).otherwise(far)
