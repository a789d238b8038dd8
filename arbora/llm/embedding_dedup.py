"""Near-duplicate embeddings by an epsilon grid order join: all pairs of one label with a cosine of at least a threshold, counted and grouped.

For unit vectors a cosine of c is a distance of eps = sqrt(2 - 2 c), so links are the pairs within eps.

1. Equal vectors of a label are one point with a weight; its smallest id stands for it.
2. Points are projected on the leading principal dimensions and put in grid order: by label, by the cells of side eps in these dimensions, then by
   finer cells. Spark sorts them by ranges; every range is cut into blocks of BLOCK points, each with the box of its coordinates.
   (The coordinates are the projections and the length of what they leave out; distances of coordinates never exceed those of vectors.)
3. Intervals of the sequence join recursively: pairs of intervals of 16^l ranges, then of ranges, then of blocks; a pair whose boxes are farther
   apart than eps goes with all that is in it. Each level is a Spark join of boxes.
4. Each pair of blocks left is one task's tile, where the recursion goes on over halves down to LEAF points: distant halves are skipped, halves
   whose balls lie within eps of each other link as a whole, and the rest is compared in double precision. A tile returns a row a point: how many
   vectors it met, and the smallest id of its part of the tile; so a group of g near copies sends rows in proportion to g, not to its square.
5. Counts are added up, the tiles' parts meet in components.

Exact: the dimensions, fitted on a sample of at most SAMPLE points (chosen by a hash of the id), only say in which order points are looked at. Vectors
that are null, empty, zero or hold a null or non-finite component, and those with a null label, link with nothing but are returned. Rows with a null
id are left out. Of rows that share an id the smallest that can link counts. Vectors of different lengths don't link. Other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arbora.llm.batches import give_back
from arbora.llm.components import components
from arbora.llm.vectors import finite, matrix, one_per_id
from arbora.session import stash, table

SAMPLE, DIMS, FINER = 4096, 6, 8
BLOCK, BLOCKS_A_RANGE, LEAF, FAN = 2048, 4, 256, 16
#: What rounding may add to a distance of coordinates.
ROUND = 1e-6


def units(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def fit(sample: np.ndarray) -> np.ndarray:
    """The leading principal dimensions of unit vectors, as columns."""
    _, _, v = np.linalg.svd(sample - sample.mean(0), full_matrices=False)
    return v[:DIMS].T


class Space:
    """Where points lie: coordinates, and the key of the grid order."""

    def __init__(self, basis: np.ndarray | None, eps: float):
        self.basis, self.eps = basis, eps

    def coordinates(self, u: np.ndarray) -> np.ndarray:
        own = self.basis is not None and len(self.basis) == u.shape[1]
        p = u @ self.basis if own else u[:, :DIMS]
        out = np.zeros((len(u), DIMS + 1))
        out[:, : p.shape[1]], out[:, DIMS] = p, np.sqrt(np.maximum(1 - (p * p).sum(1), 0))
        return out

    def keys(self, u: np.ndarray) -> list[bytes]:
        p = self.coordinates(u)[:, :DIMS]
        cells = np.concatenate([np.floor(p / self.eps), np.floor(p * FINER / self.eps)], axis=1)
        return [x.tobytes() for x in (np.clip(cells, -32768, 32767) + 32768).astype(">u2")]


class Side:
    """A block in a tile: its points, and boxes and balls of intervals of them."""

    def __init__(self, row: dict, dim: int, space: Space):
        self.id, self.weight = np.frombuffer(row["ids"], "<i8"), np.frombuffer(row["weights"], "<i8")
        self.v = np.frombuffer(row["vectors"], "<f8").reshape(len(self.id), dim)
        self.u = units(self.v)
        self.at = space.coordinates(self.u)
        self.seen: dict[tuple[int, int], tuple] = {}

    def bounds(self, a: int, b: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
        """Lower and upper corner, middle and radius of points a to b."""
        if (a, b) not in self.seen:
            u, at = self.u[a:b], self.at[a:b]
            middle = u.mean(0)
            self.seen[a, b] = at.min(0), at.max(0), middle, float(np.sqrt(((u - middle) ** 2).sum(1).max()))
        return self.seen[a, b]


def linked(x: np.ndarray, y: np.ndarray, u: np.ndarray, w: np.ndarray, cosine: float) -> np.ndarray:
    """Which of x and y (unit vectors u and w) have a cosine of at least so much; near the threshold from the vectors as given."""
    s = u @ w.T
    for i, j in zip(*np.nonzero(np.abs(s - cosine) < 1e-9)):
        a, b = x[i] / np.abs(x[i]).max(), y[j] / np.abs(y[j]).max()
        s[i, j] = a @ b / (math.sqrt(a @ a) * math.sqrt(b @ b))
    return s >= cosine


def parts(link: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A number for each row and column of a table of links: equal for those that links connect, -1 without a link."""
    far = sum(link.shape)
    row, col = np.where(link.any(1), np.arange(link.shape[0]), far), np.full(link.shape[1], far)
    while True:
        new = np.minimum(col, np.where(link, row[:, None], far).min(0))
        row = np.minimum(row, np.where(link, new, far).min(1))
        if (new == col).all():
            return np.where(row < far, row, -1), np.where(col < far, col, -1)
        col = new


def tile(a: Side, b: Side, same: bool, cosine: float, eps: float, leaf: int = LEAF) -> list[tuple[int, int, int]]:
    """(id, vectors linked with, smallest id of its part) of the points that have a link here."""
    ids = a.id if same else np.concatenate([a.id, b.id])
    shift = 0 if same else len(a.id)
    count, ends = np.zeros(len(ids), np.int64), []
    todo = [(0, len(a.id), 0, len(b.id))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        (a_low, a_high, a_mid, a_far), (b_low, b_high, b_mid, b_far) = a.bounds(a0, a1), b.bounds(b0, b1)
        gap = np.maximum(np.maximum(b_low - a_high, a_low - b_high), 0)
        if math.sqrt(gap @ gap) > eps + ROUND:
            continue
        here, there = np.arange(a0, a1), np.arange(b0, b1) + shift
        itself = same and a0 == b0
        if math.sqrt(((a_mid - b_mid) ** 2).sum()) + a_far + b_far < eps - ROUND:
            count[here] += b.weight[b0:b1].sum() - (a.weight[a0:a1] if itself else 0)
            if not itself:
                count[there] += a.weight[a0:a1].sum()
            if not itself or a1 - a0 > 1:
                ends += [np.stack([x, np.full(len(x), a0)]) for x in (here, there)]
        elif max(a1 - a0, b1 - b0) <= leaf:
            link = linked(a.v[a0:a1], b.v[b0:b1], a.u[a0:a1], b.u[b0:b1], cosine)
            if itself:
                link = np.triu(link, 1)
            if link.any():
                count[here] += link @ b.weight[b0:b1]
                count[there] += a.weight[a0:a1] @ link
                row, col = parts(link)
                ends += [np.stack([x[p >= 0], a0 + p[p >= 0]]) for x, p in ((here, row), (there, col))]
        else:
            a_half = [(a0, (a0 + a1) // 2), ((a0 + a1) // 2, a1)] if a1 - a0 > leaf else [(a0, a1)]
            b_half = [(b0, (b0 + b1) // 2), ((b0 + b1) // 2, b1)] if b1 - b0 > leaf else [(b0, b1)]
            todo += [(*x, *y) for x in a_half for y in b_half if not itself or x[0] <= y[0]]
    if not ends:
        return []
    x, y = np.concatenate(ends, axis=1)
    root, before = np.arange(len(ids)), None
    while before is None or (root != before).any():
        before = root.copy()
        least = np.minimum(root[x], root[y])
        np.minimum.at(root, x, least)
        np.minimum.at(root, y, least)
        root = root[root]
    smallest = np.full(len(ids), np.iinfo(np.int64).max)
    np.minimum.at(smallest, root, ids)
    some = np.flatnonzero(count)
    return list(zip(ids[some].tolist(), count[some].tolist(), smallest[root[some]].tolist()))


def _blocks(points: DataFrame, space: Space, n: int, block: int) -> DataFrame:
    """The grid order as blocks: label, dim, part and seq (their place), size, box (low0, high0, ...), packed ids, weights and vectors."""
    label = points.schema["label"].dataType.simpleString()

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key = np.empty(batch.num_rows, object)
            dims = batch.column("dim").to_numpy()
            for d in np.unique(dims):
                own = np.flatnonzero(dims == d)
                key[own] = space.keys(units(matrix(batch.column("v").take(pa.array(own)))))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(key.tolist(), pa.binary())], [*batch.schema.names, "key"])

    boxes = [f"{side}{i}" for i in range(DIMS + 1) for side in ("low", "high")]
    form = f"label {label}, dim int, part int, seq int, size int, {', '.join(f'{c} double' for c in boxes)}, ids binary, weights binary, vectors binary"

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq, held, named, kind = TaskContext.get().partitionId(), 0, [], None, None

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal seq, held
            if held:
                t = pa.Table.from_batches(held)
                v = matrix(t["v"])
                at = space.coordinates(units(v))
                box = np.stack([at.min(0), at.max(0)], 1).ravel()
                own = [t[c].to_numpy().astype("<i8").tobytes() for c in ("id", "weight")]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([named[0]], kind), *(pa.array([x], pa.int32()) for x in (named[1], part, seq, len(v))), *(pa.array([x]) for x in box.tolist()), *(pa.array([x], pa.binary()) for x in (*own, v.tobytes()))],
                    ["label", "dim", "part", "seq", "size", *boxes, "ids", "weights", "vectors"],
                )
                seq, held = seq + 1, []
                give_back()

        for batch in batches:
            kind = batch.schema.field("label").type
            keys = list(zip(batch.column("label").to_pylist(), batch.column("dim").to_pylist()))
            at = 0
            while at < len(keys):
                if keys[at] != named:
                    yield from flush()
                    named = keys[at]
                room = block - sum(b.num_rows for b in held)
                end = at
                while end < len(keys) and end - at < room and keys[end] == named:
                    end += 1
                held.append(batch.slice(at, end - at))
                if end - at == room:
                    yield from flush()
                at = end
        yield from flush()

    order = ["label", "dim", "key", "id"]
    placed = points.mapInArrow(place, f"id long, label {label}, dim int, weight long, v array<double>, key binary")
    ranged = placed.repartitionByRange(max(1, math.ceil(n / (block * BLOCKS_A_RANGE))), *order).sortWithinPartitions(*order)
    return ranged.mapInArrow(pack, form)


def _near(eps: float):
    """Whether two boxes, of x and y, are within eps."""
    gaps = [F.greatest(F.col(f"ylow{i}") - F.col(f"xhigh{i}"), F.col(f"xlow{i}") - F.col(f"yhigh{i}"), F.lit(0.0)) for i in range(DIMS + 1)]
    return sum((g * g for g in gaps), F.lit(0.0)) <= (eps + ROUND) ** 2


def block_pairs(blocks: DataFrame, eps: float) -> DataFrame:
    """(label, dim, ip, iq, jp, jq): pairs of blocks, i not after j, whose boxes are within eps; found from the widest intervals down."""
    box = [c for c in blocks.columns if c.startswith(("low", "high"))]
    sides = [F.min(c).alias(c) if c.startswith("low") else F.max(c).alias(c) for c in box]
    last = blocks.agg(F.coalesce(F.max("part"), F.lit(0))).first()[0]
    leaves = blocks.select("label", "dim", "size", F.col("part").alias("up"), F.struct("part", "seq").alias("node"), *box)
    # levels of intervals of parts: FAN ** l parts each; up is the interval of the level above that a node lies in
    levels, width = [leaves], 1
    while True:
        node = F.floor(F.col("part") / width).cast("int")
        levels.append(blocks.groupBy("label", "dim", node.alias("node")).agg(*sides).withColumn("up", F.floor(F.col("node") / FAN).cast("int")))
        if last < width:
            break
        width *= FAN
    pairs = levels.pop().select("label", "dim", F.col("node").alias("i"), F.col("node").alias("j"))
    for level in reversed(levels):
        x, y = (level.withColumnsRenamed({c: side + c for c in level.columns}) for side in "xy")
        left = pairs.join(x, (pairs["label"] == x["xlabel"]) & (pairs["dim"] == x["xdim"]) & (pairs["i"] == x["xup"])).drop("label", "dim", "i")
        both = left.join(y, (left["xlabel"] == y["ylabel"]) & (left["xdim"] == y["ydim"]) & (left["j"] == y["yup"]) & (left["xnode"] <= y["ynode"])).where(_near(eps))
        if level is leaves:
            both = both.where("xnode <> ynode or xsize > 1")
        pairs = both.select(F.col("xlabel").alias("label"), F.col("xdim").alias("dim"), F.col("xnode").alias("i"), F.col("ynode").alias("j"))
    return pairs.select("label", "dim", F.col("i.part").alias("ip"), F.col("i.seq").alias("iq"), F.col("j.part").alias("jp"), F.col("j.seq").alias("jq"))


def _links(blocks: DataFrame, pairs: DataFrame, space: Space, cosine: float) -> DataFrame:
    """(id, n, root) of the points of each pair of blocks."""
    ends, packed = ["ip", "iq", "jp", "jq"], ["dim", "ids", "weights", "vectors"]

    def side(p: str, q: str) -> DataFrame:
        own = blocks.select(F.col("part").alias(p), F.col("seq").alias(q), *packed)
        return pairs.select(ends).join(own, [p, q]).select(*(F.col(c).alias(c) for c in ends + packed))

    eps = space.eps

    def run(key: tuple, i: pa.Table, j: pa.Table) -> pa.Table:
        x, y = i.to_pylist()[0], j.to_pylist()[0]
        a = Side(x, x["dim"], space)
        same = key[0].as_py() == key[2].as_py() and key[1].as_py() == key[3].as_py()
        found = tile(a, a if same else Side(y, y["dim"], space), same, cosine, eps)
        give_back()
        return pa.table([pa.array(c, pa.int64()) for c in (zip(*found) if found else [()] * 3)], names=["id", "n", "root"])

    return side("ip", "iq").groupBy(*ends).cogroup(side("jp", "jq").groupBy(*ends)).applyInArrow(run, "id long, n long, root long")


def near_duplicates(vectors: DataFrame, cosine: float = 0.93, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label", block: int = BLOCK) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row with an id."""
    v = F.col(vector).cast("array<double>")
    named = vectors.select(F.col(vec_id).cast("long").alias("id"), F.col(label).alias("label"), v.alias("v"), (finite(v) & F.exists(v, lambda x: x != 0)).alias("ok")).where("id is not null")
    rows = one_per_id(named.where("ok and label is not null").drop("ok"))
    keys = rows.select("id", F.xxhash64("label", "v").alias("k1"), F.xxhash64(F.lit("second"), "v", "label").alias("k2"))
    copies = keys.groupBy("k1", "k2").agg(F.min("id").alias("rep"), F.count("*").alias("weight")).where("weight > 1")
    members = stash(keys.join(copies, ["k1", "k2"]).select("id", "rep", "weight"), "members")
    points = rows.join(members, "id", "left").where("rep is null or rep = id").select("id", "label", F.size("v").alias("dim"), F.coalesce("weight", F.lit(1)).alias("weight"), "v")

    eps = math.sqrt(max(2 - 2 * cosine, 1e-12))
    sizes = rows.groupBy(F.size("v").alias("dim")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "dim").limit(1).first()
    basis, n = None, sizes.n if sizes else 0
    if n:
        share = min(1 << 30, math.ceil(1.5 * SAMPLE / n * (1 << 30)) + (1 << 14))
        some = rows.where((F.size("v") == sizes.dim) & (F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < share)).orderBy(F.xxhash64("id"), "id").limit(SAMPLE)
        basis = fit(units(np.array([r.v for r in some.select("v").collect()])))
    space = Space(basis, eps)
    blocks = stash(_blocks(points, space, n, block), "sequence")
    pairs = stash(block_pairs(blocks, eps), "pairs")
    met = stash(_links(blocks, pairs, space, cosine), "met")
    counts = met.groupBy("id").agg(F.sum("n").alias("n"))
    joined = components(met.select(F.col("id").alias("a"), F.col("root").alias("b")))
    found = counts.join(joined, "id", "left").select(F.col("id").alias("rep"), "n", "component")
    every = named.select("id").distinct().join(members, "id", "left").withColumn("rep", F.coalesce("rep", "id")).join(found, "rep", "left")
    component = F.coalesce("component", "rep")
    return every.select(F.col("id").alias("vec_id"), (F.coalesce("n", F.lit(0)) + F.coalesce("weight", F.lit(1)) - 1).alias("n_links"), component.alias("component_id"), (F.col("id") == component).alias("kept"))


def op12_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))


_ORACLE = """
WITH RECURSIVE r AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
f AS (SELECT *, sqrt(list_dot_product(v, v)) AS size FROM r WHERE label IS NOT NULL AND v IS NOT NULL AND len(v) > 0 AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND list_dot_product(v, v) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM f a JOIN f b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v) AND list_dot_product(a.v, b.v) / (a.size * b.size) >= 0.93),
reach AS (SELECT a, b FROM l UNION SELECT reach.a, l.b FROM reach JOIN l ON reach.b = l.a),
n AS (SELECT a AS vec_id, count(*) AS n FROM l GROUP BY a),
c AS (SELECT a AS vec_id, least(a, min(b)) AS c FROM reach GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, coalesce(c, vec_id) AS component_id, vec_id = coalesce(c, vec_id) AS kept FROM r LEFT JOIN n USING (vec_id) LEFT JOIN c USING (vec_id)
"""

QUERIES = {"op12_embedding_dedup": op12_embedding_dedup}
ORACLES = {"op12_embedding_dedup": _ORACLE}
