"""Spanning forests and the choice of links, in rounds over all components at once.

spanning_forest takes each component's best edge in every round and merges what they join (Boruvka), so rounds follow the logarithm of the number
of nodes; of parallel edges between two components only the best is carried on. select_links takes, in every round, the candidates that are the best at
both their ends and of one of the components they touch: what a greedy pass by rank would take, because nothing better can still use their ends or join that
component to anything. So one large component does not wait for its links one by one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arbora.operators.forest import components, to_root
from arbora.session import drop, stash


def spanning_forest(edges: DataFrame, *rank: Column) -> DataFrame:
    """edge_id of a spanning forest's edges, smallest by rank first, then by edge_id. Null ranks come first; edges with a null end and loops are in none."""
    live = edges.where("src <> dst").select(F.col("src").alias("a"), F.col("dst").alias("b"), F.struct(*(r.alias(f"r{i}") for i, r in enumerate(rank)), F.col("edge_id").alias("id")).alias("rank"))
    live, chosen = stash(_lightest(live), "live"), None
    while not live.isEmpty():
        both = live.select(F.explode(F.array(F.struct(F.col("a").alias("node"), F.col("b").alias("other"), "rank"), F.struct(F.col("b").alias("node"), F.col("a").alias("other"), "rank"))).alias("e"))
        best = stash(both.groupBy("e.node").agg(F.min(F.struct("e.rank", "e.other")).alias("m")).select("node", F.col("m.other").alias("other"), F.col("m.rank.id").alias("edge_id")), "best")
        chosen = best.select("edge_id") if chosen is None else chosen.unionByName(best.select("edge_id"))
        # two components that choose the same edge would be each other's parents: the smaller one is the root
        same = best.groupBy("edge_id").agg(F.count("*").alias("k"), F.min("node").alias("low"))
        tree = best.join(same, "edge_id").select("node", F.when((F.col("k") == 1) | (F.col("node") != F.col("low")), F.col("other")).alias("parent"))
        root = to_root(tree).select("node", "root")
        to = lambda c: root.select(F.col("node").alias(c), F.col("root").alias(f"{c}_"))
        moved = live.join(to("a"), "a").join(to("b"), "b").where("a_ <> b_").select(F.col("a_").alias("a"), F.col("b_").alias("b"), "rank")
        before, live = live, stash(_lightest(moved), "live")
        drop(before)
    return (chosen if chosen is not None else edges.limit(0).select("edge_id")).distinct()


def _lightest(live: DataFrame) -> DataFrame:
    return live.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.min("rank").alias("rank"))


def loop_breaks(edges: DataFrame, radius: str = "radius", length: str = "length") -> DataFrame:
    """The edges to remove so that no loop is left: in every loop the thinnest goes, of equals the longest, then the one with the smallest id.

    A missing radius counts as infinite, a missing length as 0. Edges from a node to itself go.
    """
    thick = F.coalesce(F.col(radius).cast("double"), F.lit(float("inf")))
    kept = spanning_forest(edges, -thick, F.coalesce(F.col(length).cast("double"), F.lit(0.0)), -F.col("edge_id"))
    return edges.where("src is not null and dst is not null").join(kept, "edge_id", "left_anti")


def select_links(candidates: DataFrame, nodes: DataFrame) -> DataFrame:
    """(cand_id, chosen, reason) of candidates (cand_id, source, target, confidence, status): a maximum-confidence forest that uses every end once.

    nodes has node and component; a node without one is a component of its own. Candidates come by confidence, then by cand_id.
    Only those with status 'accept' compete; others keep their status as reason. reason is 'accept', 'end in use' (a better link has the source or
    target) or 'loop' (better links already join the two sides). A null target takes no end: then anchor, a node, says what is joined.
    """
    order = F.struct(F.negative("confidence").alias("c"), F.col("cand_id").alias("id"))
    ranked = candidates.select("cand_id", "source", "target", F.coalesce("target", *(["anchor"] if "anchor" in candidates.columns else [])).alias("anchor"), "status", order.alias("rank"))
    of = lambda c, name: nodes.select(F.col("node").alias(c), F.concat(F.lit("c"), "component").alias(name))
    own = lambda c, name: F.coalesce(name, F.concat(F.lit("n"), F.col(c))).alias(name)
    live = ranked.where("status = 'accept'").join(of("source", "a"), "source", "left").join(of("anchor", "b"), "anchor", "left")
    live = stash(live.select("cand_id", "source", "target", "rank", own("source", "a"), own("anchor", "b")), "live")
    chosen = stash(live.limit(0).select("cand_id", "source", "target", "rank"), "chosen")
    while not (open_ := live.where("a <> b")).isEmpty():
        top = lambda *sides: open_.select("rank", F.explode(F.array(*sides)).alias("side")).where("side is not null").groupBy("side").agg(F.min("rank").alias("top"))  # noqa: E731, B023
        parts, at_ends = top("a", "b"), top("source", "target")
        at = lambda best, c: best.select(F.col("side").alias(c), F.col("top").alias(f"top_{c}"))
        ranks = open_.join(at(parts, "a"), "a").join(at(parts, "b"), "b").join(at(at_ends, "source"), "source").join(at(at_ends, "target"), "target", "left")
        first = (F.col("rank") == F.col("top_source")) & (F.col("target").isNull() | (F.col("rank") == F.col("top_target"))) & ((F.col("rank") == F.col("top_a")) | (F.col("rank") == F.col("top_b")))
        won = stash(ranks.where(first).select("cand_id", "source", "target", "rank", "a", "b"), "won")
        before, chosen = chosen, stash(chosen.unionByName(won.select("cand_id", "source", "target", "rank")), "chosen")
        drop(before)
        used = won.select(F.explode(F.array("source", "target")).alias("end")).where("end is not null").distinct()
        left = open_.join(used, F.col("source") == F.col("end"), "left_anti").join(used, F.col("target") == F.col("end"), "left_anti")
        # links of one round join no ring, but many components can meet
        into = components(won, "a", "b").select(F.col("node").alias("from"), F.col("component").alias("to"))
        for c in "ab":
            left = left.join(into.withColumnsRenamed({"from": c, "to": "to_"}), c, "left").withColumn(c, F.coalesce("to_", c)).drop("to_")
        before, live = live, stash(left.select("cand_id", "source", "target", "rank", "a", "b"), "live")
        drop(before)
    taken = stash(chosen.select(F.explode(F.array_distinct(F.array("source", "target"))).alias("end"), "rank").where("end is not null"), "taken").groupBy("end").agg(F.min("rank").alias("by"))
    by = lambda c: taken.select(F.col("end").alias(c), F.col("by").alias(f"by_{c}"))
    told = ranked.join(chosen.select("cand_id", F.lit(True).alias("won")), "cand_id", "left").join(by("source"), "source", "left").join(by("target"), "target", "left")
    busy = F.coalesce(F.col("by_source") < F.col("rank"), F.lit(False)) | F.coalesce(F.col("by_target") < F.col("rank"), F.lit(False))
    reason = F.when(F.col("status") != "accept", F.col("status")).when(F.col("won"), "accept").when(busy, "end in use").otherwise("loop")
    return told.select("cand_id", F.coalesce("won", F.lit(False)).alias("chosen"), reason.alias("reason"))
