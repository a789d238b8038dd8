"""Repair along segments: evenly spaced points, sparse segments made denser, spans of radii refilled from the taper on both sides.

Points are (edge_id, pos, x, y, z, r) with pos from 0 without gaps. Spans are (edge_id, i0, i1), both ends in them. What a span learns from its sides comes by an
equi-join of its places with the points, so the spans of a segment don't meet all its points.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from arbora.functions.statistics import finite
from arbora.operators.morphometry import along, with_steps

PLACE = ("x", "y", "z", "r")


def evenly(points: DataFrame, wanted: Column) -> DataFrame:
    """(edge_id, pos, x, y, z, r, raw_n): segments as `wanted` points at even arc lengths, linear in between; its first and last points stay.

    wanted is an expression of raw_n, the number of points, and total, the length; where it is null, not above 1, or the length is 0 or null, the segment stays as it is.
    """
    whole = Window.partitionBy("edge_id")
    rows = with_steps(points.select("edge_id", "pos", *PLACE)).withColumn("raw_n", F.count("*").over(whole)).withColumn("total", F.max("s").over(whole))
    rows = rows.withColumn("m", F.when((F.col("total") > 0) & (F.col("raw_n") > 1), wanted.cast("long"))).withColumns({f"{c}_1": F.lead(c).over(along()) for c in ("s", *PLACE)})
    rows = rows.withColumn("last", F.lead("pos").over(along()).isNull())
    # places on a scale from 0 to m - 1; a pair of neighbours makes those in its half-open stretch
    at = lambda c: F.round(F.col(c) * (F.col("m") - 1) / F.col("total"), 9)
    first, end = F.ceil(at("s")), F.ceil(at("s_1"))
    ks = F.when(~(F.col("m") > 1) | F.col("m").isNull(), F.array("pos")).when(F.col("last"), F.array(F.col("m") - 1)).when(end > first, F.sequence(first, end - 1)).otherwise(F.array().cast("array<bigint>"))
    rows = rows.withColumn("k", F.explode(ks))
    t = F.when(~F.col("last") & (F.col("m") > 1) & (F.col("s_1") > F.col("s")), F.greatest(F.least((F.col("k") * F.col("total") / (F.col("m") - 1) - F.col("s")) / (F.col("s_1") - F.col("s")), F.lit(1.0)), F.lit(0.0)))
    value = lambda c: F.when(F.col("t").isNull() | (F.col("t") == 0), F.col(c)).otherwise(F.col(c) + F.col("t") * (F.col(f"{c}_1") - F.col(c)))
    return rows.withColumn("t", t).select("edge_id", F.col("k").alias("pos"), *(value(c).alias(c) for c in PLACE), "raw_n")


def densify(points: DataFrame, spacing: float, min_points: int) -> DataFrame:
    """Segments with fewer points than their length asks for at this spacing, or than min_points, as evenly spaced ones; all others as they are."""
    need = F.greatest(F.lit(min_points).cast("long"), F.ceil(F.round(F.col("total") / max(spacing, 1e-9), 9)) + 1)
    return evenly(points, F.when(F.col("raw_n") < need, need))


def _sides(points: DataFrame, spans: DataFrame, window: int, exclude: str | None) -> DataFrame:
    """One row a span: what its two sides hold of usable radii, at most window places away."""
    columns = ["edge_id", "pos", "r", *([exclude] if exclude else [])]
    rows = with_steps(points.select(*dict.fromkeys([*columns, "x", "y", "z"]))).select(*columns, "s")
    usable = finite("r") > 0
    if exclude:
        usable = usable & ~F.coalesce(F.col(exclude), F.lit(False))
    places = F.sequence(F.greatest(F.col("i0") - window, F.lit(0).cast("long")), F.col("i1") + window)
    near = spans.select("edge_id", "i0", "i1", F.explode(places).alias("pos")).where("pos < i0 or pos > i1").join(rows.where(usable), ["edge_id", "pos"])
    out = []
    for name, mine, edge in (("a", F.col("pos") < F.col("i0"), F.max_by), ("b", F.col("pos") > F.col("i1"), F.min_by)):
        s, y, p = F.when(mine, F.col("s")), F.when(mine, F.log("r")), F.when(mine, F.col("pos"))
        flat = F.max(s) - F.min(s) < 1e-9
        slope = F.when(flat | (F.count(s) < 2), 0.0).otherwise(F.regr_slope(y, s))
        fit = F.when(flat | (F.count(s) < 2), 0.0).when(F.regr_syy(y, s) <= 1e-12, 1.0).otherwise(F.regr_r2(y, s))
        out += [F.count(s).alias(f"n_{name}"), slope.alias(f"slope_{name}"), fit.alias(f"r2_{name}"), edge(F.struct(F.col("s"), F.col("r")), p).alias(f"edge_{name}"), F.max(F.when(mine, F.col("r"))).alias(f"top_{name}")]
    return near.groupBy("edge_id", "i0", "i1").agg(*out)


def taper_fill(
    points: DataFrame, spans: DataFrame, min_healthy: int = 5, window: int = 40, most_taper: float = 0.0005, most_bulge: float = 1.05, only_increase: bool = True, exclude: str | None = None
) -> tuple[DataFrame, DataFrame]:
    """(points with r filled, told), (edge_id, i0, i1, sides, slope, r2, n_points, n_clipped): radii of spans from the tapers beside them.

    On each side with min_healthy usable radii (positive, finite, not excluded) ln r is fitted to the arc length, its slope held within most_taper, and carried on from
    the radius next to the span. Two sides are blended smoothly and kept within most_bulge of the two radii; one side may not rise above most_bulge times the largest it
    learnt from. With only_increase a radius that is larger stays. A span without such a side stays as it is, sides null. told says which points were in a filled
    span; a point in several takes the first. Spans may reach past the end of their segment; those that hold no point are reported with none.
    """
    given = spans.where("edge_id is not null and i0 <= i1").select("edge_id", F.greatest(F.col("i0").cast("long"), F.lit(0).cast("long")).alias("i0"), F.col("i1").cast("long").alias("i1")).where("i0 <= i1").distinct()
    size = points.groupBy("edge_id").agg(F.max("pos").alias("end"))
    given = given.join(size, "edge_id").select("edge_id", "i0", F.least("i1", "end").alias("i1")).where("i0 <= i1").distinct()
    held = lambda c: F.greatest(F.least(F.col(c), F.lit(most_taper)), F.lit(-most_taper))
    fits = given.join(_sides(points, given, window, exclude), ["edge_id", "i0", "i1"], "left")
    enough = {k: F.coalesce(F.col(f"n_{k}"), F.lit(0)) >= min_healthy for k in "ab"}
    sides = F.when(enough["a"] & enough["b"], "both").when(enough["a"], "proximal").when(enough["b"], "distal")
    pick = lambda c: F.when(F.col("sides") == "proximal", F.col(f"{c}_a")).when(F.col("sides") == "distal", F.col(f"{c}_b"))
    fits = fits.withColumn("sides", sides).withColumns({f"slope_{k}": held(f"slope_{k}") for k in "ab"})
    fits = fits.withColumn("slope", F.when(F.col("sides") == "both", (F.col("slope_a") + F.col("slope_b")) / 2).otherwise(pick("slope")))
    fits = fits.withColumn("r2", F.when(F.col("sides") == "both", F.least("r2_a", "r2_b")).otherwise(pick("r2")))
    inside = fits.withColumn("pos", F.explode(F.sequence("i0", "i1")))
    rows = inside.join(with_steps(points.select("edge_id", "pos", *PLACE)).select("edge_id", "pos", "s", "r"), ["edge_id", "pos"])
    carried = {k: F.log(F.col(f"edge_{k}.r")) + F.col(f"slope_{k}") * (F.col("s") - F.col(f"edge_{k}.s")) for k in "ab"}
    t = F.greatest(F.least((F.col("s") - F.col("edge_a.s")) / F.greatest(F.col("edge_b.s") - F.col("edge_a.s"), F.lit(1e-9)), F.lit(1.0)), F.lit(0.0))
    rows = rows.withColumn("t", t).withColumn("w", F.col("t") * F.col("t") * (3 - 2 * F.col("t")))
    free = F.exp(F.when(F.col("sides") == "both", (1 - F.col("w")) * carried["a"] + F.col("w") * carried["b"]).when(F.col("sides") == "proximal", carried["a"]).when(F.col("sides") == "distal", carried["b"]))
    top = F.when(F.col("sides") == "both", F.greatest("edge_a.r", "edge_b.r")).otherwise(pick("top")) * most_bulge
    bottom = F.when(F.col("sides") == "both", F.least("edge_a.r", "edge_b.r") / most_bulge).otherwise(0.0)
    rows = rows.withColumn("free", free).withColumn("bound", F.greatest(F.least("free", top), bottom))
    clipped = F.abs(F.col("bound") - F.col("free")) > 1e-8 + 1e-5 * F.abs("free")
    new = F.greatest("bound", finite("r")) if only_increase else F.col("bound")
    rows = rows.withColumn("new", F.when(F.col("sides").isNotNull(), new)).withColumn("clipped", F.coalesce(clipped, F.lit(False)))
    report = rows.groupBy("edge_id", "i0", "i1", "sides", "slope", "r2").agg(F.count("*").alias("n_points"), F.count_if("clipped").alias("n_clipped"))
    first = rows.where("sides is not null").groupBy("edge_id", "pos").agg(F.min_by("new", F.struct("i0", "i1")).alias("new"))
    filled = points.join(first, ["edge_id", "pos"], "left").withColumn("told", F.col("new").isNotNull()).withColumn("r", F.coalesce("new", "r")).select(*points.columns, "told")
    return filled, report
