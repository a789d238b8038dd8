"""Operators along a segment: arc length, brackets, turns, outliers, runs of flagged points and their repair. All are windows by segment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from arbora.operators.morphometry import along, distance, with_steps


def with_tangents(points: DataFrame) -> DataFrame:
    """Add the unit tangent (tx, ty, tz): central difference, one-sided at the ends, null where the points coincide."""
    ahead = lambda c: F.coalesce(F.lead(c).over(along()), F.col(c)) - F.coalesce(F.lag(c).over(along()), F.col(c))
    out = points
    for c in "xyz":
        out = out.withColumn(f"t{c}", ahead(c))
    norm = F.nullif(F.sqrt(F.col("tx") ** 2 + F.col("ty") ** 2 + F.col("tz") ** 2), F.lit(0.0))
    return out.withColumn("norm", norm).withColumns({f"t{c}": F.col(f"t{c}") / F.col("norm") for c in "xyz"}).drop("norm")


def angle(dot: Column) -> Column:
    return F.degrees(F.acos(F.greatest(F.least(dot, F.lit(1.0)), F.lit(-1.0))))


def with_turns(points: DataFrame) -> DataFrame:
    """Add the angle between the step into a point and the step out of it; null at ends and at steps of length 0."""
    into = [F.col(c) - F.lag(c).over(along()) for c in "xyz"]
    out_of = [F.lead(c).over(along()) - F.col(c) for c in "xyz"]
    dot = sum((a * b for a, b in zip(into, out_of)), F.lit(0.0))
    size = F.sqrt(sum((a * a for a in into), F.lit(0.0))) * F.sqrt(sum((b * b for b in out_of), F.lit(0.0)))
    return points.withColumn("turn", angle(dot / F.nullif(size, F.lit(0.0))))


def stations(points: DataFrame, interval: float) -> DataFrame:
    """Points every `interval` along each segment, linearly between its own: each pair of neighbours makes the stations in its half-open stretch."""
    rows = with_steps(points)
    nxt = {c: F.lead(c).over(along()) for c in ("s", "x", "y", "z", "r")}
    pairs = rows.withColumns({f"{c}1": v for c, v in nxt.items()}).withColumn("s1", F.coalesce("s1", "s"))
    last = F.lead("pos").over(along()).isNull()
    first_k, end_k = F.ceil(F.round(F.col("s") / interval, 9)), F.ceil(F.round(F.col("s1") / interval, 9))
    ks = F.when(F.col("last") & (F.floor(F.round(F.col("s") / interval, 9)) == F.round(F.col("s") / interval, 9)), F.array(first_k.cast("long"))).when(end_k > first_k, F.sequence(first_k.cast("long"), (end_k - 1).cast("long"))).otherwise(F.array().cast("array<bigint>"))
    at = pairs.withColumn("last", last).withColumn("k", F.explode(ks))
    t = F.when(F.col("s1") > F.col("s"), (F.col("k") * interval - F.col("s")) / (F.col("s1") - F.col("s"))).otherwise(0.0)
    return at.select("edge_id", F.col("k").alias("station"), *((F.col(c) + t * (F.coalesce(f"{c}1", c) - F.col(c))).alias(c) for c in ("x", "y", "z", "r")))


def percentile_by_position(rows: DataFrame, key: str, value: str, p: float) -> DataFrame:
    """Percentile with positions 100 (i - 1/2) / n, linear between and clamped outside."""
    order = Window.partitionBy(key).orderBy(value)
    fine = rows.where(F.col(value).isNotNull() & ~F.isnan(value))
    at = fine.withColumn("q", 100 * (F.row_number().over(order) - 0.5) / F.count("*").over(Window.partitionBy(key)))
    got = at.groupBy(key).agg(F.max(F.when(F.col("q") <= p, F.struct("q", value))).alias("a"), F.min(F.when(F.col("q") >= p, F.struct("q", value))).alias("b"))
    a, b, qa, qb = F.col(f"a.{value}"), F.col(f"b.{value}"), F.col("a.q"), F.col("b.q")
    return got.select(key, F.coalesce(F.when(qb > qa, a + (b - a) * (p - qa) / (qb - qa)).otherwise(a), a, b).alias("limit"))


def mark_outliers(rows: DataFrame, key: str, value: str, lower: float, upper: float) -> DataFrame:
    """Add outlier: below the lower or above the upper percentile of its segment."""
    lo = percentile_by_position(rows, key, value, lower).withColumnRenamed("limit", "low")
    hi = percentile_by_position(rows, key, value, upper).withColumnRenamed("limit", "high")
    return rows.join(lo, key, "left").join(hi, key, "left").withColumn("outlier", F.coalesce((F.col(value) < F.col("low")) | (F.col(value) > F.col("high")), F.lit(True))).drop("low", "high")


def fill_nearest(rows: DataFrame, key: str, pos: str, value: str, bad: str) -> DataFrame:
    """Replace bad values by the nearest good one of the segment; the one before on a tie; as it is without any."""
    before = Window.partitionBy(key).orderBy(pos).rowsBetween(Window.unboundedPreceding, 0)
    after = Window.partitionBy(key).orderBy(pos).rowsBetween(0, Window.unboundedFollowing)
    good = F.when(~F.col(bad), F.struct(F.col(pos).alias("p"), F.col(value).alias("v")))
    a, b = F.last(good, True).over(before), F.first(good, True).over(after)
    out = rows.withColumn("a", a).withColumn("b", b)
    gap_a, gap_b = F.col(pos) - F.col("a.p"), F.col("b.p") - F.col(pos)
    filled = F.when(F.col("a").isNull(), F.col("b.v")).when(F.col("b").isNull() | (gap_a <= gap_b), F.col("a.v")).otherwise(F.col("b.v"))
    return out.withColumn("filled", F.coalesce(F.when(F.col(bad), filled), F.col(value))).drop("a", "b")


def runs(rows: DataFrame, key: str, pos: str, flag: Column, min_points: int = 1, pad: int = 0) -> DataFrame:
    """Longest runs of flagged points: first and last position (padded inside the segment) and size."""
    size = Window.partitionBy(key)
    marked = rows.select(key, pos, flag.alias("f"), F.max(pos).over(size).alias("end")).where("f")
    grouped = marked.withColumn("island", F.col(pos) - F.row_number().over(Window.partitionBy(key).orderBy(pos)))
    found = grouped.groupBy(key, "island").agg(F.min(pos).alias("i0"), F.max(pos).alias("i1"), F.count("*").alias("n"), F.first("end").alias("end"))
    return found.where(F.col("n") >= min_points).select(key, F.greatest(F.col("i0") - pad, F.lit(0)).alias("i0"), F.least(F.col("i1") + pad, F.col("end")).alias("i1"), "n")


def merge_runs(spans: DataFrame, key: str) -> DataFrame:
    """Union of overlapping or touching spans of a segment."""
    order = Window.partitionBy(key).orderBy("i0", "i1")
    reach = F.max("i1").over(order.rowsBetween(Window.unboundedPreceding, -1))
    new = spans.withColumn("new", F.when(F.col("i0") <= reach + 1, 0).otherwise(1))
    group = new.withColumn("g", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return group.groupBy(key, "g").agg(F.min("i0").alias("i0"), F.max("i1").alias("i1"), F.count("*").alias("n_spans")).drop("g")


def jumps(points: DataFrame, floor: float, ratio: float) -> DataFrame:
    """Steps longer than the floor and than ratio times the segment's median step."""
    rows = with_steps(points).withColumn("real", F.when(F.col("pos") > 0, F.col("step")))
    median = F.percentile("real", F.lit(0.5)).over(Window.partitionBy("edge_id"))
    return rows.withColumn("median", median).where(F.col("real") > F.greatest(F.lit(floor), ratio * F.col("median"))).select("edge_id", "pos", "step", "median")


def split_at_jumps(points: DataFrame, floor: float, ratio: float) -> DataFrame:
    """Cut segments at their jumps: part numbers from 0, and positions inside the part."""
    cut = jumps(points, floor, ratio).select("edge_id", "pos", F.lit(1).alias("cut"))
    part = points.join(cut, ["edge_id", "pos"], "left").withColumn("part", F.sum(F.coalesce("cut", F.lit(0))).over(along()))
    return part.withColumn("at", F.row_number().over(Window.partitionBy("edge_id", "part").orderBy("pos")).cast("long") - 1).select("edge_id", "pos", "part", "at")


def log_taper(rows: DataFrame, key: str, s: str, r: str) -> DataFrame:
    """Least squares of ln r on s: slope, intercept, r2; null with fewer than two positions."""
    y, x = F.log(F.when(F.col(r) > 0, F.col(r))), F.col(s)
    return rows.groupBy(key).agg(F.count(y).alias("n"), F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.regr_r2(y, x).alias("r2"))


def outlier_spans(points: DataFrame, factor: float = 0.6, min_segment: int = 6, min_points: int = 2, clip: int = 1) -> DataFrame:
    """Runs of radii below factor times a trend fitted twice: to all, then to the healthier half of the residuals."""
    rows = with_steps(points).withColumn("lr", F.log(F.when(F.col("r") > 0, F.col("r"))))
    size = F.count("lr").over(Window.partitionBy("edge_id"))
    usable = rows.withColumn("size", size).where((F.col("size") >= min_segment) & F.col("lr").isNotNull())
    first = log_taper(usable, "edge_id", "s", "r").where("slope is not null").select("edge_id", "slope", "intercept")
    off = usable.join(first, "edge_id").withColumn("off", F.round(F.col("lr") - F.col("intercept") - F.col("slope") * F.col("s"), 9)).drop("slope", "intercept")
    half = off.withColumn("mid", F.percentile("off", F.lit(0.5)).over(Window.partitionBy("edge_id"))).where("off >= mid")
    again = log_taper(half, "edge_id", "s", "r").where("slope is not null and n >= 4").select("edge_id", "slope", "intercept")
    low = usable.join(again, "edge_id").withColumn("last", F.max("pos").over(Window.partitionBy("edge_id")))
    bad = (F.col("r") < factor * F.exp(F.col("intercept") + F.col("slope") * F.col("s"))) & (F.col("pos") >= clip) & (F.col("pos") <= F.col("last") - clip)
    return runs(low, "edge_id", "pos", bad, min_points)


def interpolate_supported(rows: DataFrame, key: str, s: str, value: str) -> DataFrame:
    """Missing values linearly between the nearest known ones on both sides; none outside them."""
    before = Window.partitionBy(key).orderBy(s).rowsBetween(Window.unboundedPreceding, 0)
    after = Window.partitionBy(key).orderBy(s).rowsBetween(0, Window.unboundedFollowing)
    known = F.when(F.col(value).isNotNull(), F.struct(F.col(s).alias("s"), F.col(value).alias("v")))
    out = rows.withColumn("a", F.last(known, True).over(before)).withColumn("b", F.first(known, True).over(after))
    between = F.when(F.col("b.s") > F.col("a.s"), F.col("a.v") + (F.col("b.v") - F.col("a.v")) * (F.col(s) - F.col("a.s")) / (F.col("b.s") - F.col("a.s"))).otherwise(F.col("a.v") + F.col("b.v") * 0)
    return out.withColumn("supported", F.coalesce(F.col(value), between)).drop("a", "b")


def straight_bridges(points: DataFrame, cos: float = 0.99, flat: float = 0.2) -> DataFrame:
    """Runs of points where the line goes straight on and the radius has no second difference."""
    turned = with_turns(points)
    second = F.abs(F.lag("r").over(along()) - 2 * F.col("r") + F.lead("r").over(along())) / F.greatest(F.abs("r"), F.lit(1e-12))
    flagged = turned.withColumn("f", F.coalesce((F.cos(F.radians("turn")) >= cos) & (second <= flat), F.lit(False)))
    return runs(flagged, "edge_id", "pos", F.col("f"))


def arc_windows(rows: DataFrame, key: str, phi: str, value: str, arc: float = 90.0, step: int = 5) -> DataFrame:
    """Largest and smallest mean over windows of `arc` degrees turned in steps, with the first centre that has it, and the ring's mean."""
    centres = F.explode(F.sequence(F.lit(0), F.lit(355), F.lit(step)))
    spread = rows.select(key, phi, value, centres.alias("centre"))
    apart = F.abs(F.pmod(F.col(phi) - F.col("centre") + 180.0, F.lit(360.0)) - 180.0)
    # sums of decimals, so that windows over the same rows have the same mean in whatever order the rows come
    exact = F.col(value).try_cast("decimal(32,16)")
    mean = F.when(F.count(exact) == F.count(value), F.try_sum(exact).cast("double") / F.count(value))
    means = spread.where(apart <= arc / 2 + 1e-9).groupBy(key, "centre").agg(F.round(F.coalesce(mean, F.avg(value)), 9).alias("m"))
    best = means.groupBy(key).agg(F.max("m").alias("arc_max"), F.min("m").alias("arc_min"), F.max_by("centre", F.struct("m", -F.col("centre"))).cast("long").alias("max_at"), F.min_by("centre", F.struct("m", "centre")).cast("long").alias("min_at"))
    return best.join(rows.groupBy(key).agg(F.avg(value).alias("ring")), key)
