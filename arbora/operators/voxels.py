"""Label masks as tables of runs along x: (z, y, x0, x1), half open. With keys, a table holds a mask for each of their values, apart from all others.

Components are found block by block: runs are cut at the borders of blocks of space, a block's pieces are labelled together, and only components that reach a
border are joined to those of other blocks. A block holds a bounded number of pieces, however large its mask. in_blocks() does the same for what depends on a
bounded surrounding: a block gets the runs up to a halo round it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from arbora.operators.forest import components
from arbora.session import stash

BLOCK = {"z": 32, "y": 32, "x": 256}  # sizes of a block; borders lie half a block off 0


def encode(voxels: DataFrame, x: str = "vx", y: str = "vy", z: str = "vz", keys: Sequence[str] = ()) -> DataFrame:
    """Longest runs of distinct voxels."""
    row = Window.partitionBy(*keys, z, y).orderBy(x)
    marked = voxels.select(*keys, x, y, z).distinct().withColumn("g", F.col(x) - F.row_number().over(row))
    return marked.groupBy(*keys, F.col(z).alias("z"), F.col(y).alias("y"), "g").agg(F.min(x).alias("x0"), (F.max(x) + 1).alias("x1")).drop("g")


def decode(runs: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    return runs.select(*keys, F.explode(F.sequence(F.col("x0"), F.col("x1") - 1)).alias("vx"), F.col("y").alias("vy"), F.col("z").alias("vz"))


def label(runs: DataFrame, keys: Sequence[str] = (), corners: bool = True) -> DataFrame:
    """Add label: the first run of each 26-connected component, as the number z * 10^12 + y * 10^6 + x0; it is a mask's own. Without corners, of each 6-connected one.

    Where x or y are negative or reach 10^6 the number counts from their smallest values and by their spans instead, so that no two runs share it. Rows with a null are left out.
    """
    runs = stash(runs.dropna(subset=[*keys, "z", "y", "x0", "x1"]), "runs")
    box = runs.agg(F.min("y"), F.max("y"), F.min("x0"), F.max("x0")).first()
    low_y, top_y, low_x, top_x = (v if v is not None else 0 for v in box)
    off_y, off_x = min(low_y, 0), min(low_x, 0)
    span_x, span_y = max(10**6, top_x - off_x + 1), max(10**6, top_y - off_y + 1)
    of = lambda c: (F.col(c("z")) * span_y + (F.col(c("y")) - off_y)) * span_x + F.col(c("x0")) - off_x
    own = runs.withColumn("at", of(str))
    cut = {c: F.floor((F.col(c) + BLOCK[c] // 2) / BLOCK[c]).cast("long") for c in "zy"}
    slab = lambda v: F.floor((v + BLOCK["x"] // 2) / BLOCK["x"]).cast("long")
    low, high = (F.col("bx") + i for i in (0, 1))
    low, high = (v * BLOCK["x"] - BLOCK["x"] // 2 for v in (low, high))
    pieces = own.withColumns({"bz": cut["z"], "by": cut["y"], "bx": F.explode(F.sequence(slab(F.col("x0")), F.greatest(slab(F.col("x0")), slab(F.col("x1") - 1))))})
    pieces = pieces.withColumns({"p0": F.greatest("x0", low), "p1": F.least("x1", high)})
    block = [*keys, "bz", "by", "bx"]
    rows = pieces.repartition(*block).sortWithinPartitions(*block, "z", "y", "p0")
    form = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + ", part long"
    told = stash(rows.mapInArrow(lambda batches: _parts(batches, block, corners), form), "parts")
    # components that reach a border of their block may go on in the next
    edge = reduce(Column.__or__, (F.pmod(F.col(c) + BLOCK[c] // 2, F.lit(BLOCK[c])).isin(0, BLOCK[c] - 1) for c in "zy")) | (F.col("p0") == low) | (F.col("p1") == high)
    at_edge = told.where(edge).select(*block, "z", "y", F.col("p0").alias("x0"), F.col("p1").alias("x1"), "part")
    node = lambda c: F.struct(*keys, F.col(c).alias("at"))
    links = stash(_border_links(at_edge, keys, corners).select(node("part").alias("src"), node("part_").alias("dst")).distinct(), "links")
    first = told.where(slab(F.col("x0")) == F.col("bx"))
    if links.isEmpty():
        return first.select(*runs.columns, F.col("part").alias("label"))
    comp = components(links).select(*(F.col(f"node.{k}").alias(k) for k in keys), F.col("node.at").alias("part"), F.col("component.at").alias("whole"))
    return first.join(comp.hint("merge"), [*keys, "part"], "left").select(*runs.columns, F.coalesce("whole", "part").alias("label"))


def _border_links(pieces: DataFrame, keys: Sequence[str], corners: bool) -> DataFrame:
    """(keys, part, part_) of pieces of different blocks that touch."""
    block = ["bz", "by", "bx"]
    steps = F.array(*(F.struct(F.lit(i).alias("dz"), F.lit(j).alias("dy")) for i in (-1, 0, 1) for j in (-1, 0, 1) if corners or not i * j))
    a = pieces.select(*keys, *block, "part", "x0", "x1", F.col("z").alias("z_"), F.col("y").alias("y_"), F.explode(steps).alias("s")).select(*keys, *block, "part", "x0", "x1", (F.col("s.dz") + F.col("s.dy") != 0).alias("beside"), (F.col("z_") + F.col("s.dz")).alias("z"), (F.col("y_") + F.col("s.dy")).alias("y"))
    b = pieces.select(*keys, "z", "y", *(F.col(c).alias(f"{c}_") for c in (*block, "part", "x0", "x1")))
    met = a.join(b, [*keys, "z", "y"]).where("x1 >= x0_ and x1_ >= x0 and part <> part_" if corners else "part <> part_ and if(beside, x1 > x0_ and x1_ > x0, x1 >= x0_ and x1_ >= x0)")
    return met.where(reduce(Column.__or__, (F.col(c) != F.col(f"{c}_") for c in block))).select(*keys, "part", "part_")


def _parts(batches: Iterator[pa.RecordBatch], block: list[str], corners: bool) -> Iterator[pa.RecordBatch]:
    """Rows in order of block, z, y and p0, with part: the smallest `at` of their component in their block."""
    for t in whole_blocks(batches, block):
        yield from _labelled(t, block, corners)


def whole_blocks(batches: Iterator[pa.RecordBatch], block: list[str]) -> Iterator[pa.Table]:
    """Batches in order of block as tables of whole blocks. A block may go on in the next batch."""
    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        t = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
        new = np.flatnonzero(changes(t, block))
        if len(new) < 2:
            held = t
            continue
        held = t.slice(int(new[-1]))
        yield t.slice(0, int(new[-1]))
    if held is not None and held.num_rows:
        yield held


def changes(t: pa.Table, block: list[str]) -> np.ndarray:
    """Where a row's block is not that of the row before."""
    out = np.zeros(t.num_rows, bool)
    out[:1] = True
    for c in block:
        col = t.column(c)
        a, b = col.slice(0, len(col) - 1), col.slice(1)
        out[1:] |= pc.fill_null(pc.not_equal(a, b), False).to_numpy() | pc.not_equal(pc.is_null(a), pc.is_null(b)).to_numpy()
    return out


def _labelled(t: pa.Table, block: list[str], corners: bool) -> Iterator[pa.RecordBatch]:
    t = t.combine_chunks()
    group = np.cumsum(changes(t, block)) - 1
    z, y, x0, x1, at = (t.column(c).to_numpy() for c in ("z", "y", "p0", "p1", "at"))
    n, (nz, ny) = len(z), ((BLOCK["z"] + 2), (BLOCK["y"] + 2))
    # rows of neighbouring blocks never have neighbouring numbers
    row = (group * nz + (z + BLOCK["z"] // 2) % BLOCK["z"]) * ny + (y + BLOCK["y"] // 2) % BLOCK["y"]
    far = BLOCK["x"] + 2
    left = (x0 + BLOCK["x"] // 2) % BLOCK["x"]
    right = left + x1 - x0
    begins = row * far + left
    # of a row's pieces up to each one the farthest end, so that overlapping ones are found too
    ends = np.maximum.accumulate(row * far + right)
    label = np.arange(n)
    for step in (0, 1, ny - 1, ny, ny + 1) if corners else (0, 1, ny):
        base = (row + step) * far
        a = np.maximum(np.searchsorted(ends, base + left, "left"), np.searchsorted(begins, base, "left"))
        b = np.searchsorted(begins, base + right, "right")
        size = np.maximum(b - a, 0)
        one = np.repeat(np.arange(n), size)
        two = np.repeat(a - (np.cumsum(size) - size), size) + np.arange(size.sum())
        touch = (x1[two] >= x0[one]) & (one != two)
        if step and not corners:
            touch &= (x1[two] > x0[one]) & (x1[one] > x0[two])
        label = _met(label, one[touch], two[touch])
    yield from t.append_column("part", pa.array(at[label], pa.int64())).to_batches()


def _met(label: np.ndarray, one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """Labels (each a smallest place) after the places one and two have met."""
    while len(one):
        a, b = label[one], label[two]
        apart = a != b
        one, two = one[apart], two[apart]
        np.minimum.at(label, np.maximum(a, b)[apart], np.minimum(a, b)[apart])
        while True:
            on = label[label]
            if np.array_equal(on, label):
                break
            label = on
    return label


class Window3(NamedTuple):
    """Runs of whole blocks and what lies round them, as numbers: a place is row * far + x, so that rows follow one another and never touch."""

    row: np.ndarray
    x0: np.ndarray
    x1: np.ndarray
    kind: np.ndarray
    halo: int

    @property
    def side(self) -> dict[str, int]:
        # twice the halo: what is moved out of the window by as much as the halo still has a row of its own
        return {c: n + 4 * self.halo for c, n in BLOCK.items()}

    @property
    def far(self) -> int:
        return self.side["x"] + 2

    def step(self, dz: int, dy: int) -> int:
        """How far another row's number is."""
        return dz * self.side["y"] + dy

    def inner(self, row: np.ndarray) -> np.ndarray:
        """Whether rows are the blocks' own."""
        z, y = row // self.side["y"] % self.side["z"], row % self.side["y"]
        return (z >= 2 * self.halo) & (z < 2 * self.halo + BLOCK["z"]) & (y >= 2 * self.halo) & (y < 2 * self.halo + BLOCK["y"])


def in_blocks(runs: DataFrame, halo: int, each: Callable[[Window3], tuple[np.ndarray, np.ndarray]], keys: Sequence[str] = ()) -> DataFrame:
    """Longest runs (keys, z, y, x0, x1) of a mask that `each` makes, where a voxel depends on nothing farther than halo from it. runs may have kind, a whole number (else 0).

    each gets the runs of some blocks with what lies within the halo, and gives the places at which longest runs begin and end; those outside the blocks are cut off. Runs with
    a null are left out.
    """
    told = stash(_placed(runs, halo, keys).mapInArrow(lambda batches: _made(batches, [*keys, *_AXES], halo, each), _form(runs, keys)), "blocks")
    # only runs that end at a border can go on in the next block
    low = F.pmod(F.col("x0") + BLOCK["x"] // 2, F.lit(BLOCK["x"])) == 0
    high = F.pmod(F.col("x1") + BLOCK["x"] // 2, F.lit(BLOCK["x"])) == 0
    row = [*keys, "z", "y"]
    along = Window.partitionBy(*row).orderBy("x0")
    cut = told.where(low | high).withColumn("g", F.when(F.lag("x1").over(along) == F.col("x0"), 0).otherwise(1))
    cut = cut.withColumn("g", F.sum("g").over(along.rowsBetween(Window.unboundedPreceding, 0))).groupBy(*row, "g").agg(F.min("x0").alias("x0"), F.max("x1").alias("x1")).drop("g")
    return told.where(~(low | high)).unionByName(cut)


def count_in_blocks(runs: DataFrame, halo: int, each: Callable[[Window3], tuple[np.ndarray, np.ndarray]], keys: Sequence[str] = ()) -> DataFrame:
    """(keys, n): of every mask the sum of what `each` counts: places and what each of them counts for; those outside the blocks count nothing."""
    form = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in runs.select(*keys).schema), "n long"])
    return _placed(runs, halo, keys).mapInArrow(lambda batches: _counted(batches, [*keys, *_AXES], halo, each), form).groupBy(*keys).agg(F.sum("n").alias("n"))


_AXES = ("bz", "by", "bx")


def _form(runs: DataFrame, keys: Sequence[str]) -> str:
    return ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in runs.select(*keys).schema), "z long, y long, x0 long, x1 long"])


def _placed(runs: DataFrame, halo: int, keys: Sequence[str]) -> DataFrame:
    rows = runs.dropna(subset=["z", "y", "x0", "x1"]).where("x0 < x1").select(*keys, *(F.col(c).cast("long").alias(c) for c in ("z", "y", "x0", "x1")), (F.col("kind") if "kind" in runs.columns else F.lit(0)).cast("int").alias("kind"))
    slab = lambda v, c: F.floor((v + BLOCK[c] // 2) / BLOCK[c]).cast("long")
    for c, a, b in (("z", "z", "z"), ("y", "y", "y"), ("x", "x0", "x1")):
        last = F.col(b) - 1 if c == "x" else F.col(b)
        rows = rows.withColumn(f"b{c}", F.explode(F.sequence(slab(F.col(a) - halo, c), slab(last + halo, c))))
    block = [*keys, *_AXES]
    return rows.repartition(*block).sortWithinPartitions(*block)


def _window(t: pa.Table, block: list[str], halo: int) -> tuple[Window3, np.ndarray]:
    """The runs of a table of whole blocks, and the first row of each block."""
    new = changes(t, block)
    group = np.cumsum(new) - 1
    z, y, x0, x1, kind, bz, by, bx = (t.column(c).to_numpy() for c in ("z", "y", "x0", "x1", "kind", *_AXES))
    w = Window3(group, x0, x1, kind, halo)
    own = lambda v, b, c: v - (b * BLOCK[c] - BLOCK[c] // 2) + 2 * halo
    row = (group * w.side["z"] + own(z, bz, "z")) * w.side["y"] + own(y, by, "y")
    cut = lambda v: np.clip(own(v, bx, "x"), halo, BLOCK["x"] + 3 * halo)
    return Window3(row, cut(x0), cut(x1), kind, halo), np.flatnonzero(new)


def _made(batches: Iterator[pa.RecordBatch], block: list[str], halo: int, each) -> Iterator[pa.RecordBatch]:
    for t in whole_blocks(batches, block):
        t = t.combine_chunks()
        w, first = _window(t, block, halo)
        begin, end = each(w)
        row = begin // w.far
        x0, x1 = (np.clip(v - row * w.far, 2 * halo, 2 * halo + BLOCK["x"]) for v in (begin, end))
        keep = w.inner(row) & (x0 < x1)
        row, x0, x1 = row[keep], x0[keep], x1[keep]
        at = first[row // (w.side["y"] * w.side["z"])]
        back = lambda v, c: v - 2 * halo + t.column(f"b{c}").to_numpy()[at] * BLOCK[c] - BLOCK[c] // 2  # noqa: E731, B023
        places = {"z": back(row // w.side["y"] % w.side["z"], "z"), "y": back(row % w.side["y"], "y"), "x0": back(x0, "x"), "x1": back(x1, "x")}
        made = pa.table({**{k: t.column(k).take(pa.array(at)) for k in block[:-3]}, **{k: pa.array(v, pa.int64()) for k, v in places.items()}})
        yield from made.to_batches()


def _counted(batches: Iterator[pa.RecordBatch], block: list[str], halo: int, each) -> Iterator[pa.RecordBatch]:
    for t in whole_blocks(batches, block):
        t = t.combine_chunks()
        w, first = _window(t, block, halo)
        at, n = each(w)
        row = at // w.far
        x = at - row * w.far
        keep = w.inner(row) & (x >= 2 * halo) & (x < 2 * halo + BLOCK["x"])
        total = np.zeros(len(first), np.int64)
        np.add.at(total, row[keep] // (w.side["y"] * w.side["z"]), n[keep])
        yield from pa.table({**{k: t.column(k).take(pa.array(first)) for k in block[:-3]}, "n": total}).to_batches()


def sizes(labelled: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Voxels, runs and bounding box of every component."""
    box = [F.min("z").alias("z_low"), F.max("z").alias("z_high"), F.min("y").alias("y_low"), F.max("y").alias("y_high"), F.min("x0").alias("x_low"), (F.max("x1") - 1).alias("x_high")]
    return labelled.groupBy(*keys, "label").agg(F.sum(F.col("x1") - F.col("x0")).alias("n_voxels"), F.count("*").alias("n_runs"), *box)


def cull_small(labelled: DataFrame, min_voxels: int, keys: Sequence[str] = ()) -> DataFrame:
    big = sizes(labelled, keys).where(F.col("n_voxels") >= min_voxels).select(*keys, "label")
    return labelled.join(big, [*keys, "label"], "left_semi")
