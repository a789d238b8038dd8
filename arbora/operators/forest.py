"""Trees and graphs: degrees, components, levels, orders, closures, flow and pruning.

What is folded along a node's way to its root (depth, flow, rejection) takes rounds that double the way: log depth joins of one row a node. Such joins are by
merge, because files of a table between rounds are so much smaller than its rows that Spark would broadcast millions of them. Orders go up level by level. Each round's table goes through the shared folder, so lineage and plans stay short. Nothing about nodes is held by
the driver but whether a round changed anything. Nodes that reach no root (a parent that is missing, a cycle) are left out of walks; folds
that need every node refuse a cycle.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arbora.session import drop, stash

LEVELS = 20

def degrees(edges: DataFrame, a: str = "src", b: str = "dst") -> DataFrame:
    """Number of edge ends at every node; an edge from a node to itself counts twice."""
    return edges.select(F.explode(F.array(a, b)).alias("node")).groupBy("node").agg(F.count("*").alias("degree"))


def roots(tree: DataFrame) -> DataFrame:
    return tree.where("parent is null").select("node")


def to_root(tree: DataFrame, **folds: tuple[Column, Callable[[Column, Column], Column]]) -> DataFrame:
    """(node, root, depth, folds...) of every node that reaches a root.

    A fold is (own, both): a column of the node itself, and how that of a lower part of the way meets that of the part above it.
    """
    own = {k: c.alias(k) for k, (c, _) in folds.items()}
    now = stash(tree.select("node", F.col("parent").alias("at"), F.col("node").alias("root"), F.lit(0).cast("long").alias("depth"), *own.values()), "ways")
    for _ in range(2 + max(now.count(), 1).bit_length()):
        going = now.where("at is not null")
        if going.isEmpty():
            break
        up = now.select(F.col("node").alias("at"), F.col("at").alias("at_"), F.col("root").alias("root_"), F.col("depth").alias("depth_"), *(F.col(k).alias(f"{k}_") for k in folds)).hint("merge")
        met = going.join(up, "at").select("node", F.col("at_").alias("at"), F.col("root_").alias("root"), (F.col("depth") + F.col("depth_") + 1).alias("depth"), *(f(F.col(k), F.col(f"{k}_")).alias(k) for k, (_, f) in folds.items()))
        before, now = now, stash(met.unionByName(now.where("at is null")), "ways")
        drop(before)
    return now.where("at is null").drop("at")


def levels(tree: DataFrame) -> DataFrame:
    """Every reachable node's depth and root."""
    return to_root(tree).select("node", "depth", "root")


def strahler(tree: DataFrame) -> DataFrame:
    """Order of every reachable node: 1 without children, else the largest of its children's, one more if two share it. Deepest level first, a job a level.

    Trees of more than LEVELS levels are folded in log rounds instead (upward.py).
    """
    deep = stash(levels(tree).join(tree.select("node", "parent").hint("merge"), "node"), "levels")
    last = deep.agg(F.max("depth")).first()[0]
    if last is not None and last > LEVELS:
        from arbora.operators import upward  # it builds on this module

        return upward.strahler(tree)
    done = below = None
    for depth in range(last if last is not None else -1, -1, -1):
        here = deep.where(F.col("depth") == depth).select("node", "parent", "depth")
        if below is None:
            own = here.withColumn("strahler", F.lit(1).cast("long"))
        else:
            n = below.groupBy(F.col("parent").alias("node"), "strahler").agg(F.count("*").alias("k"))
            top = n.groupBy("node").agg(F.max(F.struct("strahler", "k")).alias("t")).select("node", (F.col("t.strahler") + F.when(F.col("t.k") > 1, 1).otherwise(0)).alias("o"))
            own = here.join(top.hint("merge"), "node", "left").withColumn("strahler", F.coalesce("o", F.lit(1).cast("long"))).drop("o")
        below = stash(own, "orders")
        done = below if done is None else done.unionByName(below)
    return (done if done is not None else deep.withColumn("strahler", F.lit(1).cast("long"))).select("node", "depth", "strahler")


def closure(tree: DataFrame, start: DataFrame | None = None) -> DataFrame:
    """(node, ancestor, hops) of every node in start (all nodes if None) and every ancestor, itself at 0 hops. By doubling: log depth rounds."""
    up = tree.where("parent is not null").select("node", F.col("parent").alias("ancestor"), F.lit(1).cast("long").alias("hops"))
    own = (tree if start is None else start).select("node", F.col("node").alias("ancestor"), F.lit(0).cast("long").alias("hops"))
    paths, jump, size = own, up, 1
    limit = 2 + max(tree.count(), 1).bit_length()
    while not jump.isEmpty():
        if (limit := limit - 1) < 0:
            raise ValueError("the parents go in a circle")
        further = paths.join(jump.select(F.col("node").alias("ancestor"), F.col("ancestor").alias("top"), F.col("hops").alias("more")), "ancestor").select("node", F.col("top").alias("ancestor"), (F.col("hops") + F.col("more")).alias("hops"))
        paths = stash(paths.unionByName(further), "closure")
        jump = stash(jump.join(jump.select(F.col("node").alias("ancestor"), F.col("ancestor").alias("top"), F.col("hops").alias("more")), "ancestor").select("node", F.col("top").alias("ancestor"), (F.col("hops") + F.col("more")).alias("hops")), "jumps")
        size *= 2
    return paths


def nearest_marked(paths: DataFrame, marked: DataFrame, label: str) -> DataFrame:
    """The label of every node's nearest marked ancestor or itself."""
    hit = paths.join(marked.select(F.col("node").alias("ancestor"), label), "ancestor")
    return hit.groupBy("node").agg(F.min_by(F.struct(label, "hops"), "hops").alias("m")).select("node", "m.*")


def nearest_above(tree: DataFrame, marked: DataFrame, label: str) -> DataFrame:
    """(node, label, hops): the nearest marked ancestor or itself of every node that reaches a root and has one. A row a node and round, no closure."""
    own = tree.select("node", "parent").join(marked.select("node", label), "node", "left")
    here = F.when(F.col(label).isNotNull(), F.struct(F.col(label).alias("label"), F.lit(0).cast("long").alias("hops")))
    # where two parts of a way meet, depth is the lower one's length
    further = lambda b: F.when(b.isNotNull(), F.struct(b["label"].alias("label"), (b["hops"] + F.col("depth") + 1).alias("hops")))
    found = to_root(own, mark=(here, lambda a, b: F.coalesce(a, further(b))))
    return found.where("mark is not null").select("node", F.col("mark.label").alias(label), "mark.hops")


def above(tree: DataFrame, marked: DataFrame) -> DataFrame:
    """(node): marked nodes and all that lie on their ways to the root. By doubling: log depth rounds of at most one row a node."""
    found = stash(tree.join(marked.select("node").distinct(), "node", "left_semi").select("node"), "above")
    jump = stash(tree.where("parent is not null").select("node", F.col("parent").alias("at")), "jumps")
    for _ in range(2 + max(jump.count(), 1).bit_length()):
        if jump.isEmpty():
            break
        far = jump.select(F.col("node").alias("at"), F.col("at").alias("further")).hint("merge")
        reached = found.join(jump.hint("merge"), "node").select(F.col("at").alias("node"))
        before, found = found, stash(found.unionByName(reached).distinct(), "above")
        drop(before)
        before, jump = jump, stash(jump.join(far, "at").select("node", F.col("further").alias("at")), "jumps")
        drop(before)
    return found.join(tree.select("node").hint("merge"), "node", "left_semi")


def flow_split(tree: DataFrame, radius: str = "radius", power: float = 2.27) -> DataFrame:
    """Share of the root's flow in every node: siblings share their parent's by diameter to the power; equally where all are 0."""
    weight = F.pow(2 * F.col(radius), F.lit(power))
    per = tree.where("parent is not null").groupBy("parent").agg(F.sum(weight).alias("total"), F.count("*").alias("k"))
    share = F.when(F.col("total") > 0, weight / F.col("total")).otherwise(1 / F.col("k"))
    own = tree.join(per, "parent", "left").select("node", "parent", F.when(F.col("parent").isNull(), 1.0).otherwise(share).alias("share"))
    return to_root(own, flow=(F.col("share"), lambda a, b: a * b)).select("node", "flow")


def walk_until(tree: DataFrame, reject: str) -> DataFrame:
    """Walk down from the roots and stop at nodes where reject holds: (node, rejected) of all that the walk reaches."""
    flagged = tree.select("node", "parent", F.coalesce(F.expr(reject), F.lit(False)).alias("rejected"))
    # what stops a node is a rejected one above it, so its own flag is kept apart from the fold
    found = to_root(flagged, rejected=(F.col("rejected"), lambda a, b: a), any=(F.col("rejected"), lambda a, b: a | b))
    above = found.select(F.col("node").alias("parent"), F.col("any").alias("stopped"))
    return found.select("node", "rejected").join(tree.select("node", "parent"), "node").join(above, "parent", "left").where(~F.coalesce("stopped", F.lit(False))).select("node", "rejected")


def prune_terminals(tree: DataFrame, thin: str, rounds: int | None = None) -> DataFrame:
    """Drop leaves for which thin holds, again and again until none is left (or for a number of rounds)."""
    now, done = tree, 0
    while rounds is None or done < rounds:
        inner = now.where("parent is not null").select(F.col("parent").alias("node")).distinct()
        gone = stash(now.where(thin).where("parent is not null").join(inner, "node", "left_anti").select("node"), "pruned")
        if gone.isEmpty():
            break
        now = stash(now.join(gone, "node", "left_anti"), "kept")
        done += 1
    return now


def contract_chains(tree: DataFrame, length: str) -> DataFrame:
    """Merge pass-through nodes (one child, not a root) into the branch below them: (node, parent, n_merged, length) of what remains."""
    kids = tree.where("parent is not null").groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("k"))
    marked = stash(tree.join(kids, "node", "left").select("node", "parent", length, ((F.col("k") == 1) & F.col("parent").isNotNull()).alias("through")).fillna(False, ["through"]), "through")
    over = marked.where("through").select(F.col("node").alias("parent"), F.col("parent").alias("above"), F.lit(1).cast("long").alias("m"), F.col(length).alias("more"))
    over = stash(over.withColumn("moved", F.lit(True)), "chains")
    limit = 2 + max(over.count(), 1).bit_length()
    while not over.where("moved").isEmpty():  # each pass-through node takes over what the one above it reaches, so reaches double
        if (limit := limit - 1) < 0:
            raise ValueError("the parents go in a circle")
        nxt = over.select(F.col("parent").alias("above"), F.col("above").alias("above2"), F.col("m").alias("m2"), F.col("more").alias("more2"))
        over = stash(over.join(nxt, "above", "left").select("parent", F.coalesce("above2", "above").alias("above"), (F.col("m") + F.coalesce("m2", F.lit(0))).alias("m"), (F.col("more") + F.coalesce("more2", F.lit(0.0))).alias("more"), F.col("above2").isNotNull().alias("moved")), "chains")
    kept = marked.where("not through").select("node", "parent", F.col(length).alias("length"))
    whole = F.col("length") + F.coalesce("more", F.lit(0.0))
    return kept.join(over.drop("moved"), "parent", "left").select("node", F.coalesce("above", "parent").alias("parent"), F.coalesce("m", F.lit(0).cast("long")).alias("n_merged"), whole.alias("length"))


def components(edges: DataFrame, a: str = "src", b: str = "dst") -> DataFrame:
    """(node, component): the smallest node that edges reach.

    In each round every node goes to the smallest of itself and its neighbours, ways of such steps are followed to their ends, and the edges become those between the
    ends, each once: what is left of the graph is at most half as many nodes after two rounds.
    """
    ends = edges.select(F.col(a).alias("u"), F.col(b).alias("v"))
    live = stash(ends.where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), "live")
    # nodes with no edge but to themselves
    own = ends.where("u = v").select(F.col("u").alias("node")).distinct()
    steps = []
    while not live.isEmpty():
        both = live.unionByName(live.select(F.col("v").alias("u"), F.col("u").alias("v")))
        top = stash(both.groupBy("u").agg(F.min("v").alias("l")).select("u", F.least("u", "l").alias("l")), "labels")
        while True:
            up = top.where("u <> l").alias("a").join(top.select(F.col("u").alias("l"), F.col("l").alias("ll")).hint("merge"), "l").select("u", F.col("ll").alias("l"), (F.col("ll") != F.col("l")).alias("moved"))
            nxt = stash(up.unionByName(top.where("u = l").select("u", "l", F.lit(False).alias("moved"))), "labels")
            before, top = top, nxt.select("u", "l")
            drop(before)
            if nxt.where("moved").isEmpty():
                break
        steps.append(top)
        to = lambda c: top.select(F.col("u").alias(c), F.col("l").alias(f"{c}_")).hint("merge")  # noqa: E731, B023
        moved = live.join(to("u"), "u").join(to("v"), "v").where("u_ <> v_").select(F.least("u_", "v_").alias("u"), F.greatest("u_", "v_").alias("v")).distinct()
        before, live = live, stash(moved, "live")
        drop(before)
    if not steps:
        return own.select("node", F.col("node").alias("component"))
    # from the last round back: where a round's ends went later
    found = steps.pop().select(F.col("u").alias("node"), F.col("l").alias("component"))
    while steps:
        later = found.select(F.col("node").alias("l"), "component").hint("merge")
        found = stash(steps.pop().join(later, "l", "left").select(F.col("u").alias("node"), F.coalesce("component", "l").alias("component")), "found")
    return found.unionByName(own.join(found.select("node").hint("merge"), "node", "left_anti").select("node", F.col("node").alias("component")))


def elements(edges: DataFrame, order: str = "strahler") -> DataFrame:
    """Pairs of edges that go on into one another: at every node the two of highest order, where there are exactly two."""
    ends = edges.select("edge_id", order, F.explode(F.array("src", "dst")).alias("node"))
    top = ends.groupBy("node").agg(F.max(order).alias(order))
    best = ends.join(top, ["node", order]).groupBy("node").agg(F.count("*").alias("k"), F.min("edge_id").alias("a"), F.max("edge_id").alias("b"))
    return best.where("k = 2 and a <> b").select("node", "a", "b")
