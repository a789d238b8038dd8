"""Folds from the leaves to the root, in rounds that shorten every chain.

A node whose children are all done is done. A node that waits for one child only becomes a function of that child's value, and such functions are
composed along chains, so a round takes off the leaves and halves every chain: log n rounds, whatever the depth. A round's table holds what is
not yet done; it goes through the shared folder. Nodes that reach no root take no part. A node's children are aggregated, never gathered.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arbora.operators.forest import levels, to_root
from arbora.session import stash


class Fold(NamedTuple):
    """start: a node's state from its own columns. gather: (node, value) of done children to one row (node, got). take: the state with what was got.
    done: the value when no child is missing. way: the function of the one value that is missing, through: that function's value, after: a
    function of a function (outer, inner)."""

    start: Column
    gather: Callable[[DataFrame], DataFrame]
    take: Callable[[Column, Column], Column]
    done: Callable[[Column], Column]
    way: Callable[[Column], Column]
    through: Callable[[Column, Column], Column]
    after: Callable[[Column, Column], Column]


def fold_up(tree: DataFrame, fold: Fold) -> DataFrame:
    """(node, depth, value) of every node that reaches a root."""
    own = levels(tree).select("node", "depth").join(tree.hint("merge"), "node").select("node", "parent", "depth", fold.start.alias("state"))
    none, state, n = F.lit(False), F.col("state"), F.col("n")
    now = own.select("*", F.when(none, F.col("node")).alias("link"), F.when(none, fold.way(state)).alias("way"), none.alias("ready"), F.when(none, fold.done(state)).alias("value"))
    now, found = stash(now, "up"), []
    while not (todo := now.where("not ready")).isEmpty():
        fresh = now.where("ready")
        left = todo.groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("n"), F.min("node").alias("only"))
        came = fold.gather(fresh.where("parent is not null").select(F.col("parent").alias("node"), "value"))
        # by merge, because what is ready takes so little room in files that Spark would broadcast it
        rows = todo.drop("value", "ready").join(came.hint("merge"), "node", "left").join(left.hint("merge"), "node", "left")
        rows = rows.withColumn("state", F.when(F.col("got").isNotNull(), fold.take(state, F.col("got"))).otherwise(state))
        rows = rows.withColumn("way", F.when(F.col("link").isNotNull(), F.col("way")).when(n == 1, fold.way(state))).withColumn("link", F.coalesce("link", F.when(n == 1, F.col("only"))))
        rows = rows.join(fresh.select(F.col("node").alias("link"), F.col("value").alias("below"), F.lit(True).alias("hit")).hint("merge"), "link", "left")
        value = F.when(n.isNull(), fold.done(state)).when(F.col("hit"), fold.through(F.col("way"), F.col("below")))
        rows = rows.select("node", "parent", "depth", "state", "link", "way", (n.isNull() | F.coalesce("hit", F.lit(False))).alias("ready"), value.alias("value"))
        # what is done in this round is looked up in the next, so only functions of nodes that still wait are composed
        inner = rows.where("not ready and link is not null").select(F.col("node").alias("link"), F.col("link").alias("further"), F.col("way").alias("inner"))
        longer = F.when(F.col("further").isNotNull(), fold.after(F.col("way"), F.col("inner"))).otherwise(F.col("way"))
        met = rows.join(inner.hint("merge"), "link", "left")
        now = stash(met.select("node", "parent", "depth", "state", F.coalesce("further", "link").alias("link"), longer.alias("way"), "ready", "value"), "up")
        found.append(now.where("ready").select("node", "depth", "value"))
    return reduce(DataFrame.unionByName, found) if found else now.select("node", "depth", "value")


def _order() -> Fold:
    """States hold the largest order met and how often; functions are lo below p, else the larger of the missing order and hi, where lo and p do not exceed hi."""
    row = lambda lo, p, hi: F.struct(lo.alias("lo"), p.alias("p"), hi.alias("hi"))
    one = F.lit(1).cast("long")
    through = lambda w, x: F.when(x < w["p"], w["lo"]).otherwise(F.greatest(x, w["hi"]))

    def gather(done: DataFrame) -> DataFrame:
        same = done.groupBy("node", "value").agg(F.count("*").alias("k"))
        return same.groupBy("node").agg(F.max(F.struct(F.col("value").alias("top"), "k")).alias("got"))

    def take(s: Column, got: Column) -> Column:
        both = F.struct(s["top"].alias("top"), (s["k"] + got["k"]).alias("k"))
        return F.when(got["top"] > s["top"], got).when(got["top"] == s["top"], both).otherwise(s)

    return Fold(
        start=F.struct(F.lit(0).cast("long").alias("top"), F.lit(0).cast("long").alias("k")),
        gather=gather,
        take=take,
        done=lambda s: F.when(s["k"] == 0, one).when(s["k"] > 1, s["top"] + 1).otherwise(s["top"]),
        way=lambda s: F.when(s["k"] == 0, row(one, one, one)).when(s["k"] == 1, row(s["top"], s["top"], s["top"] + 1)).otherwise(row(s["top"] + 1, one, s["top"] + 1)),
        through=through,
        after=lambda g, f: F.when(f["hi"] >= g["p"], row(through(g, f["lo"]), f["p"], F.greatest(f["hi"], g["hi"]))).otherwise(g),
    )


def strahler(tree: DataFrame) -> DataFrame:
    """(node, depth, strahler) of every reachable node: 1 without children, else the largest of its children's, one more if two share it."""
    return fold_up(tree, _order()).withColumnRenamed("value", "strahler")


def subtree_sums(tree: DataFrame, columns: list[str]) -> DataFrame:
    """(node, n_nodes, columns): sums of whole or real columns over every node's subtree, itself included, and its size. Nulls count as 0."""
    kinds = {c: "long" if t in ("tinyint", "smallint", "int", "bigint") else "double" for c, t in tree.dtypes}
    names = ["n_nodes", *columns]
    both = lambda a, b: F.struct(*((a[c] + b[c]).alias(c) for c in names))
    same = lambda s: s
    start = F.struct(F.lit(1).cast("long").alias("n_nodes"), *(F.coalesce(F.col(c).cast(kinds[c]), F.lit(0).cast(kinds[c])).alias(c) for c in columns))
    total = F.struct(*(F.sum(f"value.{c}").alias(c) for c in names)).alias("got")
    fold = Fold(start, lambda d: d.groupBy("node").agg(total), both, same, same, both, both)
    return fold_up(tree, fold).select("node", "value.*")


def downstream(tree: DataFrame, length: str) -> DataFrame:
    """(node, downstream): the longest way from a node's upper end to a leaf below it, by length. Functions are the larger of a and x + b."""
    low = F.lit(float("-inf"))
    row = lambda a, b: F.struct(a.alias("a"), b.alias("b"))
    fold = Fold(
        start=F.struct(F.coalesce(F.col(length).cast("double"), F.lit(0.0)).alias("own"), low.alias("top")),
        gather=lambda d: d.groupBy("node").agg(F.struct(F.max("value").alias("top")).alias("got")),
        take=lambda s, got: F.struct(s["own"].alias("own"), F.greatest(s["top"], got["top"]).alias("top")),
        done=lambda s: s["own"] + F.when(s["top"] > low, s["top"]).otherwise(0.0),
        way=lambda s: row(s["own"] + s["top"], s["own"]),
        through=lambda w, x: F.greatest(w["a"], x + w["b"]),
        after=lambda g, f: row(F.greatest(g["a"], f["a"] + g["b"]), f["b"] + g["b"]),
    )
    return fold_up(tree, fold).select("node", F.col("value").alias("downstream"))


def holding(tree: DataFrame, flag: str) -> DataFrame:
    """(node, holds): whether flag (SQL over the tree's columns) is true of a node or of one below it."""
    either = lambda a, b: F.struct((a["yes"] | b["yes"]).alias("yes"))
    same = lambda s: s
    fold = Fold(F.struct(F.coalesce(F.expr(flag), F.lit(False)).alias("yes")), lambda d: d.groupBy("node").agg(F.struct(F.bool_or("value.yes").alias("yes")).alias("got")), either, same, same, either, either)
    return fold_up(tree, fold).select("node", F.col("value.yes").alias("holds"))


def _inverse(x: Column) -> Column:
    return F.when(x > 0, 1 / x).otherwise(float("inf"))


def input_resistance(tree: DataFrame, resistance: str, outlet: str) -> DataFrame:
    """(node, total): a node's own resistance in series with all below it in parallel; a leaf's ends in its outlet's.

    Of the one child that is missing the total is (a x + b) / (c x + d), and such functions are composed as matrices, divided by their largest entry.
    """
    names = ("a", "b", "c", "d")
    row = lambda *v: F.struct(*(x.alias(n) for n, x in zip(names, v)))
    zero, one = F.lit(0.0), F.lit(1.0)

    def scaled(*v: Column) -> Column:
        most = F.greatest(*(F.abs(x) for x in v))
        return row(*(x / most for x in v))

    fold = Fold(
        start=F.struct(F.col(resistance).cast("double").alias("r"), F.col(outlet).cast("double").alias("out"), zero.alias("g"), F.lit(False).alias("inner")),
        gather=lambda d: d.groupBy("node").agg(F.struct(F.sum(_inverse(F.col("value"))).alias("g")).alias("got")),
        take=lambda s, got: F.struct(s["r"].alias("r"), s["out"].alias("out"), (s["g"] + got["g"]).alias("g"), F.lit(True).alias("inner")),
        done=lambda s: s["r"] + F.when(s["inner"], _inverse(s["g"])).otherwise(s["out"]),
        way=lambda s: F.when(s["g"] < float("inf"), scaled(s["r"] * s["g"] + 1, s["r"], s["g"], one)).otherwise(scaled(zero, s["r"], zero, one)),
        through=lambda w, x: (w["a"] * x + w["b"]) / (w["c"] * x + w["d"]),
        after=lambda g, f: scaled(g["a"] * f["a"] + g["b"] * f["c"], g["a"] * f["b"] + g["b"] * f["d"], g["c"] * f["a"] + g["d"] * f["c"], g["c"] * f["b"] + g["d"] * f["d"]),
    )
    return fold_up(tree, fold).select("node", F.col("value").alias("total"))


def network(tree: DataFrame, resistance: str, outlet: str, pressure: float) -> DataFrame:
    """(node, total, flow, pressure) of trees whose roots are fed at a pressure and whose leaves drain to zero through their outlets.

    Siblings share their parent's flow by the inverses of their totals; pressure is that at a node's lower end.
    """
    own = stash(input_resistance(tree, resistance, outlet).join(tree.select("node", "parent", F.col(resistance).cast("double").alias("r")), "node"), "totals")
    per = own.where("parent is not null").groupBy("parent").agg(F.sum(_inverse(F.col("total"))).alias("all"))
    share = own.join(per, "parent", "left").select("node", "parent", F.when(F.col("parent").isNull(), pressure * _inverse(F.col("total"))).otherwise(_inverse(F.col("total")) / F.col("all")).alias("share"))
    flow = to_root(share, flow=(F.col("share"), lambda a, b: a * b)).select("node", "flow")
    return own.join(flow, "node").select("node", "total", "flow", (F.col("flow") * (F.col("total") - F.col("r"))).alias("pressure"))


def bifurcation_levels(tree: DataFrame) -> DataFrame:
    """(node, level): nodes with three or more edges on the way from the root, the node itself included."""
    kids = tree.where("parent is not null").groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("k"))
    met = tree.join(kids, "node", "left").select("node", "parent", (F.coalesce("k", F.lit(0)) + F.col("parent").isNotNull().cast("int") >= 3).cast("long").alias("fork"))
    return to_root(met, level=(F.col("fork"), lambda a, b: a + b)).select("node", "level")


def distal_terminals(tree: DataFrame, length: str) -> DataFrame:
    """(root, node, dist): of each root the leaf at the end of the longest way, the smallest id of several."""
    inner = tree.where("parent is not null").select(F.col("parent").alias("node")).distinct()
    ways = to_root(tree, dist=(F.coalesce(F.col(length).cast("double"), F.lit(0.0)), lambda a, b: a + b)).join(inner, "node", "left_anti")
    return ways.groupBy("root").agg(F.max_by(F.struct("node", "dist"), F.struct(F.round("dist", 9), F.negative("node"))).alias("m")).select("root", "m.*")
