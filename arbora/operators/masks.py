"""Topology, closing and distances of label masks, on their runs: (keys, z, y, x0, x1), half open, as voxels.encode makes them.

Euler number: a mask is the union of closed unit cubes, so voxels that share a corner are connected (26 neighbours). Counting vertices, edges, faces
and cubes along lines in x leaves one term a line: its number of separate pieces. With P(S) the pieces of the union of the rows in S,

    chi = sum over corner lines P(4 rows) - sum over side lines P(2 rows in z) - sum over side lines P(2 rows in y) + sum over rows P(1 row)

Cavities are components (6 neighbours) of the gaps between a row's runs that never meet the open: a gap meets it where a neighbouring row has no runs or
reaches beyond its first or last run. So only gaps are labelled, never the surroundings.

Dilation and erosion by a ball move runs by each offset (dz, dy) of its disc and shrink or widen them by what is left in x; a sweep along each
row counts how many cover a place. Pieces of lines and moved runs are made block by block from the runs in and round a block, so a run is sent about once. Distances are squared, separable, one axis at a time: along x they follow from the runs, along y and z each
column's consecutive voxels take the lower envelope of parabolas, which a voxel's own value bounds to a few neighbours.

Keys keep masks apart. Empty tables give empty results. Runs of a mask may overlap or touch; where a function needs longest runs it makes them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from arbora.operators.voxels import Window3, count_in_blocks, in_blocks, label
from arbora.session import stash


def covered(spans: DataFrame, weights: Sequence[str], enough: Column, keys: Sequence[str] = ()) -> DataFrame:
    """Longest runs of the places where `enough` holds; in it, each of the named weights is the sum over the spans that cover a place."""
    row = [*keys, "z", "y"]
    step = spans.select(*row, F.explode(F.array(*(F.struct(F.col(x).alias("x"), *((F.col(w) if x == "x0" else -F.col(w)).alias(w) for w in weights)) for x in ("x0", "x1")))).alias("e"))
    events = step.select(*row, "e.*").groupBy(*row, "x").agg(*(F.sum(w).alias(w) for w in weights))
    along = Window.partitionBy(*row).orderBy("x")
    level = events.select(*row, "x", F.lead("x").over(along).alias("x1"), *(F.sum(w).over(along.rowsBetween(Window.unboundedPreceding, 0)).alias(w) for w in weights))
    held = level.where(enough & F.col("x1").isNotNull()).select(*row, F.col("x").alias("x0"), "x1")
    return _joined(held, row)


def _joined(spans: DataFrame, row: list[str]) -> DataFrame:
    """Spans of a row that touch or overlap, as one."""
    along = Window.partitionBy(*row).orderBy("x0", "x1")
    far = F.max("x1").over(along.rowsBetween(Window.unboundedPreceding, -1))
    begins = spans.withColumn("new", F.when(far.isNull() | (F.col("x0") > far), 1).otherwise(0))
    piece = begins.withColumn("piece", F.sum("new").over(along.rowsBetween(Window.unboundedPreceding, 0)))
    return piece.groupBy(*row, "piece").agg(F.min("x0").alias("x0"), F.max("x1").alias("x1")).drop("piece")


def united(runs: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Longest runs."""
    return _joined(runs.select(*keys, "z", "y", "x0", "x1"), [*keys, "z", "y"])


def less(a: DataFrame, b: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Runs of a outside b."""
    side = lambda df, p, q: df.select(*keys, "z", "y", "x0", "x1", F.lit(p).alias("own"), F.lit(q).alias("other"))
    return covered(side(a, 1, 0).unionByName(side(b, 0, 1)), ["own", "other"], (F.col("own") > 0) & (F.col("other") == 0), keys)


def _longest(begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Stretches of places that touch or overlap, as one."""
    if not len(begin):
        return begin, end
    order = np.argsort(begin, kind="stable")
    begin, end = begin[order], np.maximum.accumulate(end[order])
    new = np.concatenate(([True], begin[1:] > end[:-1]))
    return begin[new], end[np.concatenate((new[1:], [True]))]


def _where(enough: Callable[..., np.ndarray], *sides: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Longest stretches of the places where `enough` holds of how many stretches of each side cover them."""
    at, of = np.unique(np.concatenate([v for side in sides for v in side]), return_inverse=True)
    levels, done = [], 0
    for begin, end in sides:
        a, b = of[done : done + len(begin)], of[done + len(begin) : done + len(begin) + len(end)]
        done += len(begin) + len(end)
        levels.append(np.cumsum(np.bincount(a, minlength=len(at)) - np.bincount(b, minlength=len(at))))
    held = np.flatnonzero(enough(*levels))  # no stretch goes on after the last place
    return _longest(at[held], at[held + 1]) if len(held) else (at[:0], at[:0])


def _pieces(w: Window3) -> tuple[np.ndarray, np.ndarray]:
    """Where pieces of lines begin, and how they count."""
    rows = [((0, 0),), ((0, 0), (1, 0)), ((0, 0), (0, 1)), ((0, 0), (0, 1), (1, 0), (1, 1))]
    begins, signs = [], []
    for line, sign in zip(rows, (1, -1, -1, 1)):
        move = np.array([w.step(*d) for d in line])[:, None]
        begin, _ = _longest(*(((w.row + move) * w.far + x).ravel() for x in (w.x0, w.x1)))
        begins.append(begin)
        signs.append(np.full(len(begin), sign))
    return np.concatenate(begins), np.concatenate(signs)


def euler(runs: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, euler): the Euler number of every mask."""
    return count_in_blocks(runs, 1, _pieces, keys).withColumnRenamed("n", "euler")


def cavities(runs: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, cavity, n_voxels): enclosed parts of the background; cavity is the first gap as (z, y, x)."""
    row = [*keys, "z", "y"]
    whole = stash(united(runs, keys), "runs")
    along = Window.partitionBy(*row).orderBy("x0")
    gaps = whole.select(*row, F.col("x1").alias("g0"), F.lead("x0").over(along).alias("g1")).where("g1 is not null").select(*row, F.col("g0").alias("x0"), F.col("g1").alias("x1"))
    # what all four rows beside a row span; where one has no runs, nothing is enclosed
    extent = whole.groupBy(*row).agg(F.min("x0").alias("low"), F.max("x1").alias("high"))
    steps = F.explode(F.array(*(F.struct(F.lit(dz).alias("dz"), F.lit(dy).alias("dy")) for dz, dy in ((0, 1), (1, 0), (0, -1), (-1, 0)))))
    beside = extent.withColumn("s", steps).select(*keys, (F.col("z") + F.col("s.dz")).alias("z"), (F.col("y") + F.col("s.dy")).alias("y"), "low", "high")
    beside = beside.groupBy(*row).agg(F.count("*").alias("n"), F.max("low").alias("low"), F.min("high").alias("high")).where("n = 4").drop("n")
    told = label(gaps, keys, corners=False).join(beside.hint("merge"), row, "left")
    shut = F.count_if(F.col("low").isNull() | (F.col("x0") < F.col("low")) | (F.col("x1") > F.col("high")))
    found = told.groupBy(*keys, "label").agg(F.min(F.struct("z", "y", F.col("x0").alias("x"))).alias("cavity"), F.sum(F.col("x1") - F.col("x0")).alias("n_voxels"), shut.alias("n_open"))
    return found.where("n_open = 0").select(*keys, "cavity", "n_voxels")


def betti(runs: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, b0, b1, b2, euler): parts, tunnels and cavities of every mask."""
    whole = stash(united(runs, keys), "runs")
    parts = stash(label(whole, keys).groupBy(*keys).agg(F.countDistinct("label").alias("b0")), "parts")
    # a mask without keys is one row on each side
    key = [*keys] or ["one"]
    one = lambda df: df if keys else df.withColumn("one", F.lit(1))
    held = one(stash(cavities(whole, keys), "cavities")).groupBy(*key).agg(F.count("*").alias("b2"))
    both = one(parts).join(one(euler(whole, keys)).hint("merge"), key).join(held.hint("merge"), key, "left").withColumn("b2", F.coalesce("b2", F.lit(0)))
    return both.select(*keys, "b0", (F.col("b0") + F.col("b2") - F.col("euler")).alias("b1"), "b2", "euler")


def _disc(radius: int) -> list[tuple[int, int, int]]:
    """(dz, dy, w) of a ball's rows, each reaching w to both sides."""
    return [(dz, dy, int(np.sqrt(radius * radius - dz * dz - dy * dy) + 1e-9)) for dz in range(-radius, radius + 1) for dy in range(-radius, radius + 1) if dz * dz + dy * dy <= radius * radius]


def _own(w: Window3, kinds: Sequence[int]) -> tuple[np.ndarray, np.ndarray]:
    """Longest runs of the kinds, as places."""
    of = np.isin(w.kind, kinds)
    return _longest(*(w.row[of] * w.far + x[of] for x in (w.x0, w.x1)))


def _grown(w: Window3, runs: tuple[np.ndarray, np.ndarray], radius: int) -> tuple[np.ndarray, np.ndarray]:
    begin, end = (np.concatenate([v + w.step(dz, dy) * w.far + s * x for dz, dy, x in _disc(radius)]) for v, s in zip(runs, (-1, 1)))
    return _longest(begin, end)


def _shrunk(w: Window3, runs: tuple[np.ndarray, np.ndarray], radius: int) -> tuple[np.ndarray, np.ndarray]:
    begin, end = runs
    spans = [(begin[fits] - w.step(dz, dy) * w.far + x, end[fits] - w.step(dz, dy) * w.far - x) for dz, dy, x in _disc(radius) for fits in (end - begin > 2 * x,)]
    return _where(lambda n: n == len(spans), (np.concatenate([s[0] for s in spans]), np.concatenate([s[1] for s in spans])))


def dilated(runs: DataFrame, radius: int, keys: Sequence[str] = ()) -> DataFrame:
    """The mask and all voxels within a radius of it."""
    return in_blocks(runs.drop("kind"), radius, lambda w: _grown(w, _own(w, [0]), radius), keys)


def eroded(runs: DataFrame, radius: int, keys: Sequence[str] = ()) -> DataFrame:
    """Voxels of which the whole ball lies in the mask."""
    return in_blocks(runs.drop("kind"), radius, lambda w: _shrunk(w, _own(w, [0]), radius), keys)


def _shut(w: Window3, radius: int) -> tuple[np.ndarray, np.ndarray]:
    return _shrunk(w, _grown(w, _own(w, [0]), radius), radius)


def closed(runs: DataFrame, radius: int, keys: Sequence[str] = ()) -> DataFrame:
    """Dilation, then erosion by the ball of a radius in voxels."""
    return united(runs, keys) if radius < 1 else in_blocks(runs.drop("kind"), 2 * radius, lambda w: _shut(w, radius), keys)


def closing_additions(runs: DataFrame, radius: int, blocked: DataFrame | None = None, keys: Sequence[str] = ()) -> DataFrame:
    """Runs that closing adds to every mask, outside blocked (runs with the same keys)."""
    side = lambda df, kind: df.select(*keys, "z", "y", "x0", "x1", F.lit(kind).alias("kind"))
    both = side(runs, 0) if blocked is None else side(runs, 0).unionByName(side(blocked, 1))
    new = lambda w: _where(lambda a, b: (a > 0) & (b == 0), _shut(w, radius), _own(w, [0, 1]))
    return in_blocks(both.where("kind = 0").limit(0) if radius < 1 else both, 2 * max(radius, 1), new, keys)


def envelope(f: np.ndarray, ends: np.ndarray, step: float) -> np.ndarray:
    """min over j of f[j] + (step (i - j))^2 within each stretch f[ends[k]:ends[k + 1]], beyond both ends of which lies a 0."""
    size = np.diff(ends)
    part = np.repeat(np.arange(len(size)), size)
    at = np.arange(len(f)) - np.repeat(ends[:-1], size)
    edge = np.minimum(at + 1, np.repeat(size, size) - at) * step
    out = np.minimum(f, edge * edge)
    k = 1
    while k < len(f) and (k * step) ** 2 < out.max():
        same, far = part[k:] == part[:-k], (k * step) ** 2
        # f itself, not what was found so far: each voxel sees every other once
        right, left = np.where(same, f[:-k] + far, np.inf), np.where(same, f[k:] + far, np.inf)
        out[k:] = np.minimum(out[k:], right)
        out[:-k] = np.minimum(out[:-k], left)
        k += 1
    return out


def _along(voxels: DataFrame, axis: str, step: float, keys: Sequence[str]) -> DataFrame:
    """d2 after one more axis: each column's consecutive voxels in one row."""
    rest = [*keys, *(c for c in ("vx", "vy", "vz") if c != axis)]
    run = F.col(axis) - F.row_number().over(Window.partitionBy(*rest).orderBy(axis))
    lists = voxels.withColumn("run", run).groupBy(*rest, "run").agg(F.sort_array(F.collect_list(F.struct(axis, "d2"))).alias("s"))
    columns = lists.select(*rest, F.col("s")[0][axis].alias("first"), F.col("s.d2").alias("d2"))

    def run_(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("d2")
            ends = lists.offsets.to_numpy() - lists.offsets[0].as_py()
            new = envelope(lists.flatten().to_numpy(), ends.astype(np.int64), step) if batch.num_rows else np.zeros(0)
            made = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(new))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in (*rest, "first")), made], [*rest, "first", "d2"])

    form = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in columns.schema)
    done = columns.mapInArrow(run_, form).select(*rest, "first", F.posexplode("d2").alias("i", "d2"))
    return done.select(*rest, (F.col("first") + F.col("i")).alias(axis), "d2")


def squared_distances(runs: DataFrame, spacing: tuple[float, float, float] = (1.0, 1.0, 1.0), keys: Sequence[str] = ()) -> DataFrame:
    """(keys, vx, vy, vz, d2): of every voxel of a mask the squared distance to the nearest voxel outside it, centre to centre; spacing in x, y, z."""
    x = united(runs, keys).select(*keys, F.col("y").alias("vy"), F.col("z").alias("vz"), "x0", "x1", F.explode(F.sequence(F.col("x0"), F.col("x1") - 1)).alias("vx"))
    near = F.least(F.col("vx") - F.col("x0") + 1, F.col("x1") - F.col("vx")) * spacing[0]
    flat = x.select(*keys, "vx", "vy", "vz", (near * near).cast("double").alias("d2"))
    return _along(_along(flat, "vy", spacing[1], keys), "vz", spacing[2], keys).select(*keys, "vx", "vy", "vz", "d2")


def radii_at(places: DataFrame, runs: DataFrame, spacing: tuple[float, float, float] = (1.0, 1.0, 1.0), keys: Sequence[str] = ()) -> DataFrame:
    """places (keys, vx, vy, vz, ...) with radius, the distance from their voxel to the background of their mask; 0 outside it."""
    # runs are small on disk and unfold to many voxels, which Spark would gather in the driver as the small side
    at = squared_distances(runs, spacing, keys).hint("merge")
    return places.join(at, [*keys, "vx", "vy", "vz"], "left").withColumn("radius", F.sqrt(F.coalesce("d2", F.lit(0.0)))).drop("d2")
