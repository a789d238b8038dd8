"""Edits of a graph as DataFrame steps: split, weld, merge, renumber, fingerprints, and a log that can be replayed to any step."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from arbora.operators.morphometry import along


def split_segments(points: DataFrame, at: DataFrame) -> DataFrame:
    """Cut segments at interior positions (edge_id, at): the joint point ends one part and begins the next; parts and positions from 0."""
    ends = points.groupBy("edge_id").agg(F.max("pos").alias("stop"))
    cut = at.join(ends, "edge_id").where("at > 0 and at < stop").groupBy("edge_id").agg(F.array_sort(F.collect_set("at")).alias("cuts"))
    rows = points.join(cut, "edge_id", "left").withColumn("cuts", F.coalesce("cuts", F.array().cast("array<bigint>")))
    part = F.size(F.filter("cuts", lambda c: c < F.col("pos")))
    joint = F.array_contains("cuts", F.col("pos"))
    rows = rows.withColumn("part", F.explode(F.when(joint, F.array(part, part + 1)).otherwise(F.array(part)))).drop("cuts")
    order = Window.partitionBy("edge_id", "part").orderBy("pos")
    return rows.withColumn("part", F.col("part").cast("long")).withColumn("at", F.row_number().over(order).cast("long") - 1)


def weld(edges: DataFrame, same: DataFrame) -> DataFrame:
    """Replace nodes by what they are welded to (node, keep); edges that become loops go."""
    out = edges
    for end in ("src", "dst"):
        out = out.join(same.select(F.col("node").alias(end), F.col("keep").alias(f"k_{end}")), end, "left").withColumn(end, F.coalesce(f"k_{end}", end)).drop(f"k_{end}")
    return out.where("src <> dst")


def renumber(rows: DataFrame, key: str, old: str, new: str) -> DataFrame:
    """Dense ids from 0 inside every graph, in order of the old ones."""
    return rows.withColumn(new, F.dense_rank().over(Window.partitionBy(key).orderBy(old)).cast("long") - 1)


def fingerprints(points: DataFrame, unit: float = 0.001) -> DataFrame:
    """A segment's key: a hash of its rounded coordinates, the same whichever end it starts from."""
    place = F.concat_ws(":", *(F.floor(F.col(c) / unit + 0.5).cast("string") for c in "xyz"))
    lists = points.select("edge_id", "pos", place.alias("p")).groupBy("edge_id").agg(F.array_sort(F.collect_list(F.struct("pos", "p"))).alias("l"))
    there = F.array_join(F.transform("l", lambda s: s["p"]), ",")
    back = F.array_join(F.reverse(F.transform("l", lambda s: s["p"])), ",")
    return lists.select("edge_id", F.sha2(F.least(there, back), 256).alias("fingerprint"))


def replay(log: DataFrame, entity: str, seq: str, value: str, upto: int) -> DataFrame:
    """The state after the first edits: what each entity was last set to."""
    return log.where(F.col(seq) <= upto).groupBy(entity).agg(F.max_by(value, seq).alias(value), F.max(seq).alias("last_edit"))


def smooth(points: DataFrame, column: str) -> DataFrame:
    """Five-point quadratic smoothing; the first and last two points of a segment stay."""
    weights = {-2: -3, -1: 12, 0: 17, 1: 12, 2: -3}
    at = lambda k: F.lead(column, k).over(along()) if k > 0 else F.lag(column, -k).over(along()) if k else F.col(column)
    total = sum((w * at(k) for k, w in weights.items()), F.lit(0.0)) / 35
    return points.withColumn("smooth", F.coalesce(total, F.col(column)))


def segment_resistance(points: DataFrame, viscosity: float = 0.0035) -> DataFrame:
    """Laminar resistance of segments whose radius is linear between points (steps of no length have none)."""
    from arbora.operators.morphometry import with_steps

    rows = with_steps(points).withColumn("a", F.lag("r").over(along()))
    a, b = F.col("a"), F.col("r")
    piece = F.col("step") * (a * a + a * b + b * b) / (3 * F.pow(a, F.lit(3.0)) * F.pow(b, F.lit(3.0)))
    return rows.groupBy("edge_id").agg((F.lit(8 * viscosity) / F.pi() * F.coalesce(F.sum(piece), F.lit(0.0))).alias("resistance"))


def score_terms(rows: DataFrame, given: str, found: str, overlap: str, power: int) -> DataFrame:
    """Relative and overlap terms and their sum: null terms count as none, an infinite one makes the sum infinite."""
    relative = F.abs(F.col(given) - F.col(found)) / F.nullif(F.abs(given), F.lit(0.0))
    share = F.when(F.col(overlap) > 0, (1 - F.col(overlap)) / F.pow(F.col(overlap), F.lit(float(power)))).when(F.col(overlap).isNotNull(), F.lit(float("inf")))
    return rows.withColumn("relative", relative).withColumn("miss", share).withColumn("score", F.coalesce("relative", F.lit(0.0)) + F.coalesce("miss", F.lit(0.0)))
