"""Nearest, radius and band joins over points in space.

All are equi-joins on grid cells. within: the build side keeps its cell, the query side looks into the 27 around its own; with cells as large as the gate
the search is exact within it, and a cell that holds very many points is split by Spark's skew join, because both sides are joined by key alone. Nearest
joins take cells that hold few places each, whatever the gate.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from arbora.operators.morphometry import distance
from arbora.session import drop, stash

AXES = ("x", "y", "z")


def _cell(size: float, c: str, by: int | Column = 0) -> Column:
    return F.floor(F.col(c) / size) + by


def within(queries: DataFrame, build: DataFrame, gate: float, keep: list[str], q_id: str = "q_id", b_id: str = "b_id") -> DataFrame:
    """(q_id, b_id, d, kept columns of both as q_* and b_*) of all pairs not farther apart than gate."""
    q = queries.select(F.col(q_id).alias("q_id"), *(F.col(c).alias(f"q_{c}") for c in (*AXES, *keep) if c in queries.columns))
    around = F.sequence(F.lit(-1), F.lit(1))
    looks = lambda c: F.transform(around, lambda i: F.floor(F.col(f"q_{c}") / gate) + i)
    for c in AXES:
        q = q.withColumn(f"k{c}", F.explode(looks(c)))
    b = build.select(F.col(b_id).alias("b_id"), *(F.col(c).alias(f"b_{c}") for c in (*AXES, *keep) if c in build.columns), *(_cell(gate, c).alias(f"k{c}") for c in AXES))
    pairs = q.join(b, [f"k{c}" for c in AXES]).drop(*(f"k{c}" for c in AXES))
    return pairs.withColumn("d", distance(*((F.col(f"q_{c}"), F.col(f"b_{c}")) for c in AXES))).where(F.col("d") <= gate)


def nearest(queries: DataFrame, build: DataFrame, gate: float, keep: list[str] | None = None, q_id: str = "q_id", b_id: str = "b_id") -> DataFrame:
    """The nearest build point within gate of every query point that has one; ties to the smaller id."""
    found = nearest_widening(queries, build, gate, q_id, b_id, most=gate).where(F.col("d") <= gate)
    there = build.select(F.col(b_id).alias("b_id"), *(F.col(c).alias(f"b_{c}") for c in (*AXES, *(keep or [])) if c in build.columns))
    return found.join(there, "b_id").select("q_id", "b_id", "d", *(c for c in there.columns if c != "b_id"))


CROWD, CHUNK = 24, 1000  # points that a cell may hold on average, as its points see it; points of a cell in one list


def _uncrowded(places: DataFrame, start: float, most: float, cell: Callable[[str, float], Column]) -> float:
    """A size of cells, at most `most`, at which the mean of a point's company in its cell is at most CROWD but not far below; 2^-40 of start at least."""
    least, size, fits = start * 2.0**-40, start, None
    while True:
        n = places.groupBy(*(cell(c, size) for c in AXES)).agg(F.count("*").alias("n"))
        crowd = n.agg((F.sum(F.col("n") * F.col("n").cast("double")) / F.sum("n")).alias("m")).first().m or 0.0
        steps = max(1, int(abs(math.log(max(crowd, 1.0) / CROWD, 8))))
        if crowd > CROWD:
            if fits is not None or size <= least:
                return fits or size
            size /= 2**steps
        else:
            if crowd > CROWD / 8 or size >= most or fits is not None and size <= fits:
                return size
            fits, size = size, min(size * 2**steps, most)


def nearest_widening(queries: DataFrame, build: DataFrame, start: float, q_id: str = "q_id", b_id: str = "b_id", most: float = float("inf")) -> DataFrame:
    """Nearest without a gate: points look in their own cell, then in those that what they found there leaves open; where a cell is empty, again in cells four times as large.

    The first cells are those of start, halved or doubled until they hold few places each, so work follows the number of points however close they lie. Build points of one place
    count as the one of the smallest id. With most, the search ends once cells reach it: all that is nearer is found, and some of what is farther may be. Points with a null
    or not finite coordinate take no part. What is left after a round goes through the shared folder.
    """
    fine = reduce(Column.__and__, (F.coalesce(F.abs(F.col(c)) < float("inf"), F.lit(False)) for c in AXES))
    rest = stash(queries.where(fine).select(F.col(q_id).alias("q_id"), *(F.col(c).cast("double").alias(c) for c in AXES)), "asked")
    places = stash(build.where(fine).groupBy(*(F.col(c).cast("double").alias(c) for c in AXES)).agg(F.min(b_id).alias("b_id")), "places")
    box = rest.select(*AXES).unionByName(places.select(*AXES)).agg(*(f(c).alias(f"{f.__name__}_{c}") for c in AXES for f in (F.min, F.max))).first()
    low = {c: box[f"min_{c}"] or 0.0 for c in AXES}
    span = max((box[f"max_{c}"] or 0.0) - low[c] for c in AXES)
    cell = lambda c, size: F.floor((F.col(c) - low[c]) / size).alias(f"k{c}")
    first_size = min(start, most) if min(start, most) > 0 else 1.0
    size, keys, found = _uncrowded(places, first_size, max(min(most, 2 * span), first_size), cell), [f"k{c}" for c in AXES], []
    while True:
        last = size > span or size >= most
        held = places.withColumns({f"k{c}": cell(c, size) for c in AXES})
        # a crowded cell is several lists, so that none grows with the table
        n = F.count("*").over(Window.partitionBy(*keys))
        held = held.withColumn("part", F.pmod(F.xxhash64(*AXES), F.ceil(n / CHUNK)))
        lists = stash(held.groupBy(*keys, "part").agg(F.collect_list(F.struct("b_id", *AXES)).alias("there")), "cells")
        own = _best(rest.withColumns({f"k{c}": cell(c, size) for c in AXES}), lists, keys)
        seen = stash(rest.join(own, "q_id", "left") if size <= span else rest.join(own, "q_id"), "seen")
        reach = F.when(F.col("best").isNotNull(), F.least(F.col("best.d"), F.lit(most))).when(F.lit(last and most < float("inf")), F.lit(most)) * (1 + 1e-9) + 2e-9
        out = seen.withColumn("reach", reach).where(F.col("reach").isNotNull())
        first = out.select("q_id", "best").where("best is not null")
        for c in AXES:
            top = math.floor((box[f"max_{c}"] - low[c]) / size) if box[f"max_{c}"] is not None else 0
            at = lambda by: F.floor((F.col(c) - low[c] + by * F.col("reach")) / size)  # noqa: B023, E731
            out = out.withColumn(f"k{c}", F.explode(F.sequence(F.greatest(at(-1), F.lit(0).cast("long")), F.least(at(1), F.lit(top).cast("long")))))
        off = lambda c: F.greatest(F.col(f"k{c}") * size + low[c] - F.col(c), F.col(c) - low[c] - (F.col(f"k{c}") + 1) * size, F.lit(0.0))
        home = reduce(Column.__and__, (F.col(f"k{c}") == F.floor((F.col(c) - low[c]) / size) for c in AXES))
        near = sum((off(c) * off(c) for c in AXES), F.lit(0.0)) <= F.col("reach") * F.col("reach")
        # what is found at home joins what is found beyond before the best is taken, so candidates are dealt by query once
        beyond = _picks(out.where(near & ~home).select("q_id", *AXES, *keys), lists, keys)
        found.append(stash(first.unionByName(beyond).groupBy("q_id").agg(F.min("best").alias("best")).select("q_id", "best.b_id", "best.d"), "near"))
        drop(lists)
        rest = seen.where("best is null").select("q_id", *AXES)
        if last or rest.isEmpty():
            return reduce(DataFrame.unionByName, found)
        size *= 4


def _best(looks: DataFrame, lists: DataFrame, keys: list[str]) -> DataFrame:
    return _picks(looks, lists, keys).groupBy("q_id").agg(F.min("best").alias("best"))


def _picks(looks: DataFrame, lists: DataFrame, keys: list[str]) -> DataFrame:
    """(q_id, best) of each look into a list of a cell: the nearest as (rounded distance, b_id, d)."""
    d = lambda p: distance(*((F.col(c), p[c]) for c in AXES))
    pick = F.array_min(F.transform("there", lambda p: F.struct(F.round(d(p), 9).alias("near"), p["b_id"].alias("b_id"), d(p).alias("d"))))
    return looks.join(lists, keys).select("q_id", pick.alias("best"))


def nearest_accepted(queries: DataFrame, build: DataFrame, gate: float, keep: list[str], accept: Callable[[DataFrame], DataFrame], q_id: str = "q_id", b_id: str = "b_id") -> DataFrame:
    """The nearest build point within gate that accept leaves of a query's pairs (columns as those of within()); ties of rounded distances to the smaller id.

    Cells hold few places each at first and double up to the gate; a query that finds one goes no further, so only those that find none see all pairs within the gate.
    """
    fine = build.where(reduce(Column.__and__, (F.coalesce(F.abs(F.col(c)) < float("inf"), F.lit(False)) for c in AXES)))
    size = _uncrowded(fine, gate, gate, lambda c, size: _cell(size, c).alias(f"k{c}"))
    rest, found = stash(queries, "asked"), []
    while True:
        # a rounded distance may be that of a pair a little beyond, so what is found near the edge waits for the next round
        sure = float("inf") if size >= gate else size - 2e-9
        pairs = accept(within(rest, fine, size, keep, q_id, b_id))
        best = pairs.groupBy("q_id").agg(F.min(F.struct(F.round("d", 9).alias("near"), "b_id", "d")).alias("best"))
        found.append(stash(best.select("q_id", "best.b_id", "best.d").where(F.col("d") <= sure), "near"))
        if size >= gate:
            return reduce(DataFrame.unionByName, found)
        before, rest = rest, stash(rest.join(found[-1].select(F.col("q_id").alias(q_id)), q_id, "left_anti"), "asked")
        drop(before)
        size = min(2 * size, gate)


def in_spheres(nodes: DataFrame, anchors: DataFrame, reach: Column, *keep: str) -> DataFrame:
    """(anchor_id, node_id, anchors' columns, kept columns as node_*, d) of nodes within an anchor's own reach.

    Anchors of one power of two look in cells of that size, so wide ones don't widen the cells of the rest; a node is sent once a size that occurs. Reaches that are
    null, negative or not finite find nothing.
    """
    # reaches below 2^-30 share the smallest cells
    sized = anchors.withColumn("reach", reach).where((F.col("reach") >= 0) & (F.col("reach") < float("inf")))
    sized = sized.withColumn("level", F.greatest(F.ceil(F.log2(F.greatest("reach", F.lit(2.0**-30)))), F.lit(-30)))
    levels = F.lit(sorted(r.level for r in sized.select("level").distinct().collect())).cast("array<bigint>")  # powers of two, at most 1,100
    cell = lambda c, i=0: F.floor(F.col(c) / F.pow(F.lit(2.0), F.col("level"))) + i
    looks = sized
    for c in AXES:
        looks = looks.withColumn(f"k{c}", F.explode(F.array(*(cell(c, i) for i in (-1, 0, 1)))))
    there = nodes.select("node_id", *(F.col(c).alias(f"node_{c}") for c in (*AXES, *keep))).withColumn("level", F.explode(levels)).withColumns({f"k{c}": cell(f"node_{c}") for c in AXES})
    pairs = looks.join(there, ["level", *(f"k{c}" for c in AXES)])
    d = F.sqrt(sum(((F.col(c) - F.col(f"node_{c}")) ** 2 for c in AXES), F.lit(0.0)))
    return pairs.withColumn("d", d).where("d <= reach").drop("level", *(f"k{c}" for c in AXES))


def assign(queries: DataFrame, centres: DataFrame, radius: str, factor: float, gate: float) -> DataFrame:
    """Owner of every query point: the nearest centre, if the point lies within factor times that centre's own radius, else -1."""
    near = nearest(queries, centres, gate, [radius])
    own = near.select("q_id", F.when(F.col("d") <= factor * F.col(f"b_{radius}"), F.col("b_id")).otherwise(-1).alias("owner"), "d")
    return queries.select("q_id").join(own, "q_id", "left").withColumn("owner", F.coalesce("owner", F.lit(-1)))


def surface_distances(a: DataFrame, b: DataFrame) -> DataFrame:
    """Mean, median, 95th percentile and largest of two sets of directed nearest distances."""
    both = a.select("d").unionByName(b.select("d"))
    return both.agg(F.count("*").alias("n"), F.avg("d").alias("mean"), F.percentile("d", F.lit(0.5)).alias("median"), F.percentile("d", F.lit(0.95)).alias("hd95"), F.max("d").alias("hausdorff"))


def overlap(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Sizes of two sets of cells and of their intersection, Dice, Jaccard, precision and recall."""
    both = a.select(*keys, F.lit(1).alias("a"), F.lit(0).alias("b")).unionByName(b.select(*keys, F.lit(0).alias("a"), F.lit(1).alias("b")))
    cells = both.groupBy(*keys).agg(F.max("a").alias("a"), F.max("b").alias("b"))
    n = cells.agg(F.sum("a").alias("n_a"), F.sum("b").alias("n_b"), F.sum(F.col("a") * F.col("b")).alias("n_both"))
    na, nb, nab = F.col("n_a"), F.col("n_b"), F.col("n_both")
    return n.select("*", (2 * nab / (na + nb)).alias("dice"), (nab / (na + nb - nab)).alias("jaccard"), (nab / nb).alias("precision"), (nab / na).alias("recall"))


def voxels(points: DataFrame, size: float, keys: list[str] | None = None) -> DataFrame:
    return points.select(*(keys or []), *(_cell(size, c).alias(f"v{c}") for c in AXES)).distinct()


TASK_CELLS = 1_000_000  # cells of lines in one partition, on average


def rasterise(segments: DataFrame, size: float) -> DataFrame:
    """Cells of the digital lines between (x, y, z) and (x1, y1, z1): as many steps as the longest axis needs, rounded half up.

    Segments are dealt to as many partitions as their cells fill, because a line may pass any number.
    """
    cells = {c: F.floor(F.col(c) / size) for c in (*AXES, "x1", "y1", "z1")}
    rows = segments.select("edge_id", *(v.alias(c) for c, v in cells.items()))
    n = F.greatest(*(F.abs(F.col(f"{c}1") - F.col(c)) for c in AXES))
    n_cells = rows.agg(F.sum(n + 1)).first()[0] or 0
    rows = rows.repartition(max(1, math.ceil(n_cells / TASK_CELLS)), "edge_id")
    t = rows.withColumn("n", n).withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n"))))
    at = lambda c: F.floor(F.col(c) + F.when(F.col("n") > 0, F.col("k") * (F.col(f"{c}1") - F.col(c)) / F.col("n")).otherwise(0.0) + 0.5)
    return t.select("edge_id", *(at(c).alias(f"v{c}") for c in AXES)).distinct()


def majority(votes: DataFrame, key: str, label: str, min_share: float = 0.5) -> DataFrame:
    """The label most of a key's rows have, if its share reaches min_share; ties to the smaller label. Null where none does."""
    n = votes.groupBy(key, label).agg(F.count("*").alias("n"))
    top = n.groupBy(key).agg(F.max_by(F.struct(label, "n"), F.struct("n", F.negative(F.col(label)))).alias("t"), F.sum("n").alias("total"))
    return top.select(key, F.when(F.col("t.n") / F.col("total") >= min_share, F.col(f"t.{label}")).alias(label), F.col("t.n").alias("votes"), "total")


def gate_reason(pairs: DataFrame, max_gap: float, min_cos: float, ratio_max: float) -> DataFrame:
    """Why a pair of ends cannot be bridged: the first gate it fails, or accept."""
    ratio = F.greatest("q_r", "b_r") / F.nullif(F.least("q_r", "b_r"), F.lit(0.0))
    why = F.when(F.col("d") > max_gap, "reach").when(F.coalesce(F.col("cos"), F.lit(-1.0)) < min_cos, "cone").when(F.coalesce(ratio, F.lit(float("inf"))) > ratio_max, "radius").otherwise("accept")
    return pairs.withColumn("verdict", why)


def best_per(pairs: DataFrame, key: str, score: str, tie: str, k: int = 1) -> DataFrame:
    order = Window.partitionBy(key).orderBy(F.round(score, 9), tie)
    return pairs.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= k)
