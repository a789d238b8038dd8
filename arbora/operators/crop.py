"""Crop plans of rooted segments: which take-offs rules reject, and what goes with them.

Segments are (node, parent, ...): a node is a segment, its parent the one it leaves. Main vessels are named segments. A segment is protected if it is a root, a
main vessel or on the way to one. Rules judge each unprotected segment's take-off, in this order: its order, its radius just past the take-off, the share of its
vessel's ostium that this radius is (a branch belongs to the nearest main vessel above it), and that it belongs to none. The first rule that rejects it
names it; a rejected take-off goes with all below it, and what lies below another take-off is not counted again. Marks made by hand come last: one
segment, or a segment with all below it; either is refused where it would touch a protected segment.

Folds along the way to the root take log rounds, whatever the depth. A missing order or radius rejects nothing. Segments that reach no root are left out;
marks of segments that aren't there say nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from arbora.operators.forest import above, to_root
from arbora.operators.morphometry import along, with_steps
from arbora.session import stash


def takeoff_radius(points: DataFrame, factor: float = 2.0, from_end: str | None = None) -> DataFrame:
    """(edge_id, takeoff): the radius of the first point at least factor radii of the segment's first point away from it along the segment, or of the last point.

    from_end names a column that is true where the segment is read from its other end.
    """
    rows = with_steps(points)
    whole = Window.partitionBy("edge_id")
    back = F.col(from_end) if from_end else F.lit(False)
    rows = rows.withColumn("_size", F.max("s").over(whole)).withColumn("_first", F.last("r").over(along().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)) if from_end else F.first("r").over(along().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    if from_end:
        head = F.first("r").over(along().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
        rows = rows.withColumn("_first", F.when(back, F.col("_first")).otherwise(head))
    rows = rows.withColumn("_away", F.when(back, F.col("_size") - F.col("s")).otherwise(F.col("s"))).withColumn("_place", F.when(back, -F.col("pos")).otherwise(F.col("pos")))
    far = rows.where(F.col("_away") >= F.least(factor * F.col("_first"), F.col("_size")))
    return far.groupBy("edge_id").agg(F.min_by("r", F.struct("_away", "_place")).alias("takeoff"))


def vessel_ostia(tree: DataFrame, vessels: DataFrame, radius: str = "takeoff") -> DataFrame:
    """(vessel, node, ostium, depth, n_segments): of every named vessel its segment nearest the root (the smallest of several) and the radius at its take-off."""
    deep = to_root(tree).select("node", "depth").hint("merge")
    return _ostia(vessels.join(tree.select("node", F.col(radius).alias("ostium")).hint("merge"), "node").join(deep, "node"))


def _ostia(rows: DataFrame) -> DataFrame:
    top = F.min_by(F.struct("node", "ostium", "depth"), F.struct("depth", "node"))
    return rows.groupBy("vessel").agg(top.alias("t"), F.count("*").alias("n_segments")).select("vessel", "t.*", "n_segments")


def crop_plan(
    tree: DataFrame, vessels: DataFrame, min_strahler: int | None = None, min_radius: float | None = None, ratio: float | None = None, prune_unattributed: bool = False,
    drop_segments: DataFrame | None = None, prune_at: DataFrame | None = None,
) -> DataFrame:
    """(node, rule, takeoff_node, vessel, radius, threshold, protected, n_subtree) of every segment of a tree (node, parent, takeoff, strahler).

    rule is that of the take-off with which a segment goes: strahler, radius, ratio, unattributed, hand or hand-subtree; null for what stays. radius, threshold,
    vessel and n_subtree are the take-off's own, and null below it. vessels: (node, vessel), one vessel a segment; drop_segments and prune_at: tables of node.
    """
    own = stash(tree.select("node", "parent", F.col("takeoff").cast("double").alias("takeoff"), F.col("strahler").cast("long").alias("strahler")), "segments")
    named = stash(vessels.groupBy("node").agg(F.min("vessel").alias("vessel")), "vessels")
    main = own.select("node", "parent").join(named, "node", "left")
    placed = stash(to_root(main, vessel=(F.col("vessel"), lambda a, b: F.coalesce(a, b))).select("node", "depth", "vessel"), "placed")
    held = above(own, named).withColumn("above_main", F.lit(True))
    ostia = stash(_ostia(named.join(own.select("node", F.col("takeoff").alias("ostium")), "node").join(placed.select("node", "depth").hint("merge"), "node")).select("vessel", "ostium"), "ostia")
    # tables of a row a segment meet by merge, see forest.py
    rows = own.hint("merge").join(placed, "node").join(held.hint("merge"), "node", "left").join(ostia, "vessel", "left").withColumn("protected", F.col("parent").isNull() | F.coalesce("above_main", F.lit(False)))
    limit = F.lit(ratio).cast("double") * F.when(~F.isnan("ostium"), F.col("ostium"))
    told = lambda name, radius, threshold, vessel: F.struct(F.lit(name).alias("rule"), radius.cast("double").alias("radius"), threshold.cast("double").alias("threshold"), vessel.cast(named.schema["vessel"].dataType).alias("vessel"))
    none, measured = F.lit(None), ~F.isnan("takeoff")
    verdicts = []
    if min_strahler is not None:
        verdicts.append(F.when(F.col("strahler") < min_strahler, told("strahler", none, none, none)))
    if min_radius is not None:
        verdicts.append(F.when(measured & (F.col("takeoff") < min_radius), told("radius", F.col("takeoff"), F.lit(min_radius), none)))
    if ratio is not None:
        verdicts.append(F.when(measured & (F.col("takeoff") < limit), told("ratio", F.col("takeoff"), limit, F.col("vessel"))))
    if prune_unattributed:
        verdicts.append(F.when(F.col("vessel").isNull(), told("unattributed", none, none, none)))
    empty = F.when(F.lit(False), told("", none, none, none))
    flag = lambda t, name: t.select("node").distinct().withColumn(name, F.lit(True)) if t is not None else own.limit(0).select("node", F.lit(True).alias(name))
    judged = rows.select("node", "parent", "protected", F.when(~F.col("protected"), F.coalesce(*verdicts, empty)).alias("verdict"))
    judged = judged.join(flag(drop_segments, "dropped"), "node", "left").join(flag(prune_at, "pruned"), "node", "left")
    # protected segments lie above or in what they protect, so a subtree is free of them if its top is
    judged = stash(judged.withColumns({c: F.coalesce(c, F.lit(False)) & ~F.col("protected") for c in ("dropped", "pruned")}), "judged")
    # the take-off and the mark nearest the root, at or above every node
    upper = lambda a, b: F.coalesce(b, a)
    tops = to_root(judged, top=(F.when(F.col("verdict").isNotNull(), F.struct("node", "verdict.rule")), upper), hand_top=(F.when(F.col("pruned"), F.col("node")), upper))
    tops = stash(tops.select("node", F.col("top.node").alias("top"), F.col("top.rule").alias("top_rule"), "hand_top"), "tops")
    # all that lies below one of these has it as its own, so its rows are its subtree
    size = lambda c: tops.where(F.col(c).isNotNull()).groupBy(F.col(c).alias("node")).agg(F.count("*").alias(f"n_{c}")).hint("merge")
    told_ = judged.join(tops.hint("merge"), "node").join(size("top"), "node", "left").join(size("hand_top"), "node", "left")
    takeoff = F.coalesce("top", F.when(F.col("dropped"), F.col("node")), "hand_top")
    rule = F.coalesce("top_rule", F.when(F.col("dropped"), F.lit("hand")), F.when(F.col("hand_top").isNotNull(), F.lit("hand-subtree")))
    at_top = lambda c: F.when(F.col("top") == F.col("node"), c)
    counted = F.when(takeoff == F.col("node"), F.when(rule == "hand", F.lit(1)).otherwise(F.when(F.col("top").isNotNull(), F.col("n_top")).otherwise(F.col("n_hand_top"))))
    return told_.select("node", rule.alias("rule"), takeoff.alias("takeoff_node"), *(at_top(F.col(f"verdict.{c}")).alias(c) for c in ("vessel", "radius", "threshold")), "protected", counted.cast("long").alias("n_subtree"))


def crop_counts(plan: DataFrame, tree: DataFrame) -> DataFrame:
    """One row: segments before and after, take-offs by rule, parts after (kept segments whose parent is gone or missing)."""
    kept = plan.where("rule is null").select("node").join(tree.select("node", "parent").hint("merge"), "node")
    parts = kept.join(kept.select(F.col("node").alias("parent")).hint("merge"), "parent", "left_anti").agg(F.count("*").alias("n_parts"))
    rules = [F.count_if((F.col("rule") == r) & (F.col("takeoff_node") == F.col("node"))).alias(f"n_{r.replace('-', '_')}") for r in ("strahler", "radius", "ratio", "unattributed", "hand", "hand-subtree")]
    return plan.agg(F.count("*").alias("n_before"), F.count_if(F.col("rule").isNull()).alias("n_after"), *rules).crossJoin(F.broadcast(parts))  # one row each
