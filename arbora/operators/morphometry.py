"""Per-segment geometry and its aggregates over orders, bins, elements and states."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from arbora.functions.statistics import finite, stats11, weighted_mean

def along():
    """The frame of a segment's points in order."""
    return Window.partitionBy("edge_id").orderBy("pos")


def distance(*pairs: tuple[Column, Column]) -> Column:
    return F.sqrt(sum(((a - b) * (a - b) for a, b in pairs), F.lit(0.0)))


def with_steps(points: DataFrame) -> DataFrame:
    """Add the distance from the previous point (0 at the first) and the arc length s so far."""
    step = distance(*((F.col(c), F.lag(c).over(along())) for c in "xyz"))
    return points.withColumn("step", F.coalesce(step, F.lit(0.0))).withColumn("s", F.sum("step").over(along()))


def segment_geometry(points: DataFrame, min_chord: float = 1e-9) -> DataFrame:
    """Length, chord, tortuosity, radius statistics (population SD), volume and lateral area of every segment. One shuffle."""
    place = F.struct("x", "y", "z")
    rows = with_steps(points).groupBy("edge_id").agg(
        F.count("*").alias("n_points"),
        F.sum("step").alias("length"),
        F.min_by(place, "pos").alias("a"),
        F.max_by(place, "pos").alias("b"),
        F.avg(finite("r")).alias("r_mean"),
        F.max(finite("r")).alias("r_max"),
        F.min(finite("r")).alias("r_min"),
        F.stddev_pop(finite("r")).alias("r_sd"),
    )
    rows = rows.withColumn("chord", distance(*((F.col(f"a.{c}"), F.col(f"b.{c}")) for c in "xyz")))
    ratio = F.when(F.col("chord") > min_chord, F.col("length") / F.col("chord")).otherwise(0.0)
    return rows.select("edge_id", "n_points", "length", "chord", ratio.alias("tortuosity"), "r_mean", "r_max", "r_min", "r_sd", (F.pi() * F.col("r_mean") ** 2 * F.col("length")).alias("volume"), (2 * F.pi() * F.col("r_mean") * F.col("length")).alias("area"))


def midpoints(points: DataFrame) -> DataFrame:
    """The point of each segment nearest to half its arc length, the first on a tie."""
    total = F.sum("step").over(Window.partitionBy("edge_id"))
    near = with_steps(points).withColumn("off", F.abs(F.col("s") - total / 2))
    return near.groupBy("edge_id").agg(F.min_by(F.struct("pos", "x", "y", "z"), F.struct(F.round("off", 9), "pos")).alias("m")).select("edge_id", "m.*")


def stats_by(rows: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """The eleven statistics of every column per group."""
    return rows.groupBy(*keys).agg(*(x for c in columns for x in stats11(c)))


def with_total(rows: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Count, mean and sum per key and, with a null key, over all: one pass by rollup."""
    return rows.rollup(key).agg(F.count("*").alias("n"), *(f(finite(c)).alias(f"{c}_{f.__name__}") for c in columns for f in (F.avg, F.sum)))


def branching_ratio(counts: DataFrame, order: str = "ord") -> DataFrame:
    """n(k) / n(k + 1) of every order but the last; null where order k + 1 is missing."""
    n = counts.groupBy(order).agg(F.count("*").alias("n"))
    above = n.select((F.col(order) - 1).alias(order), F.col("n").alias("above"))
    last = n.agg(F.max(order).alias("last"))
    return n.join(above, order, "left").crossJoin(F.broadcast(last)).where(F.col(order) < F.col("last")).select(order, "n", (F.col("n") / F.col("above")).alias("ratio"))  # last is one row


def log_bins(rows: DataFrame, column: str, n_bins: int = 8) -> DataFrame:
    """Count and mean of every logarithmic bin from the smallest to 1.001 times the largest positive value, empty bins too."""
    edge = rows.where(F.col(column) > 0).agg(F.log(F.min(column)).alias("lo"), F.log(F.max(column) * 1.001).alias("hi"))
    width = (F.col("hi") - F.col("lo")) / n_bins
    bins = edge.select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_bins - 1).cast("long"))).alias("bin"), "lo", "hi").select("bin", F.exp(F.col("lo") + F.col("bin") * width).alias("from"), F.exp(F.col("lo") + (F.col("bin") + 1) * width).alias("to"))
    own = rows.where(F.col(column) > 0).crossJoin(F.broadcast(edge)).select(F.floor((F.log(column) - F.col("lo")) / width).alias("bin"), column)  # edge is one row
    found = own.groupBy("bin").agg(F.count("*").alias("n"), F.avg(column).alias("mean"))
    return bins.join(found, "bin", "left").select("bin", "from", "to", F.coalesce("n", F.lit(0)).alias("n"), "mean")


def collapse(rows: DataFrame, key: str, length: str, mean: str, sd: str, extensive: list[str]) -> DataFrame:
    """Elements of several segments: length-weighted mean, pooled SD (within and between), sums of what adds up."""
    first = rows.groupBy(key).agg(F.count("*").alias("n_segments"), F.sum(length).alias("total"), weighted_mean(mean, length).alias("mean"), *(F.sum(c).alias(c) for c in extensive))
    spread = F.col(sd) ** 2 + (F.col(mean) - F.col("mean")) ** 2
    pooled = rows.select(key, length, mean, sd).join(first.select(key, "mean"), key).withColumn("spread", spread).groupBy(key).agg(weighted_mean("spread", length).alias("var"))
    return first.join(pooled, key).withColumn("pooled_sd", F.sqrt("var")).drop("var")


def agreement(rows: DataFrame, group: str, given: str, found: str) -> DataFrame:
    """Bias, limits of agreement, RMSE, MAE and relative bias per group and, as group null, over all."""
    d = F.col(found) - F.col(given)
    ok = rows.where(finite(given).isNotNull() & finite(found).isNotNull()).select(group, F.col(given).alias("g"), d.alias("d"))
    out = ok.rollup(group).agg(F.count("*").alias("n"), F.avg("d").alias("bias"), F.coalesce(F.stddev_samp("d"), F.lit(0.0)).alias("sd"), F.sqrt(F.avg(F.col("d") ** 2)).alias("rmse"), F.avg(F.abs("d")).alias("mae"), F.avg(F.col("d") / F.nullif(F.col("g"), F.lit(0.0))).alias("rel_bias"))
    return out.withColumn("loa_low", F.col("bias") - 1.96 * F.col("sd")).withColumn("loa_high", F.col("bias") + 1.96 * F.col("sd"))


def weighted_quantile(rows: DataFrame, keys: list[str], value: str, weight: str, q: float) -> DataFrame:
    """Quantile of weighted values: each value stands at the middle of its weight; linear between, clamped outside."""
    fine = rows.where(finite(value).isNotNull() & (finite(weight) > 0))
    upto = Window.partitionBy(*keys).orderBy(value, weight).rowsBetween(Window.unboundedPreceding, 0)
    at = fine.withColumn("c", (F.sum(weight).over(upto) - F.col(weight) / 2) / F.sum(weight).over(Window.partitionBy(*keys)))
    low, high = F.col("c") <= q, F.col("c") >= q
    got = at.groupBy(*keys).agg(F.max_by(F.struct("c", value), F.when(low, F.struct("c", value))).alias("a"), F.min_by(F.struct("c", value), F.when(high, F.struct("c", value))).alias("b"))
    a, b, ca, cb = F.col(f"a.{value}"), F.col(f"b.{value}"), F.col("a.c"), F.col("b.c")
    between = F.when(cb > ca, a + (b - a) * (q - ca) / (cb - ca)).otherwise(a)
    return got.select(*keys, F.coalesce(between, a, b).alias("quantile"))


def outlet_resistances(outlets: DataFrame, tree: str, fraction: str, flow: float, drop: float) -> DataFrame:
    """Each tree's total resistance shared by the outlets' flow fractions, and what they give in parallel."""
    share = F.greatest(F.col(fraction), F.lit(1e-12))
    own = outlets.withColumn("resistance", F.lit(drop / flow) / share)
    return own.withColumn("parallel", 1 / F.sum(1 / F.col("resistance")).over(Window.partitionBy(tree)))
