"""Hard negatives of anchors: rows of another label that score almost as high as a positive, found by segment summary filtering.

A vector is cut into segments; of each its mean m and deviation s (the length of what is left without the mean) are stored. For two vectors
the inner product of a segment of L components lies within  L m m' +- s s',  so summaries alone bound a score from both sides. Pairs are looked
at hierarchically: bounds by COARSE segments, then by FINE ones for what is left, then the exact integer score of the rest. A pair
goes as soon as its upper bound is below everything that is still asked for, or its lower bound above.

1. Positives: rows are packed in blocks by label; each block of anchors meets the blocks of its label, tile by tile, and gives the k
   highest scores.
2. Negatives: a positive of score p asks for scores from low % to high % of p. Anchors are packed again with these windows, and meet blocks of
   all rows. Bounds start at the windows' lower ends, so where positives are close copies hardly a pair is scored.

The tiles' best rows are merged by Spark. Nothing is approximate: bounds are widened by more than their rounding. Blocks are of bounded size, by a
hash of the id; a label with a third of all rows has more blocks, not larger ones.

Every component x becomes floor(scale * x). Rows with a null id or label, a null or empty vector, or a null or non-finite component take no part,
nor do those whose scores would not fit 55 bits ((scale * largest component)^2 * components). Zero vectors take part. Vectors of different lengths are
not compared. Of rows that share an id the one with the smallest label, then vector, counts. Ties go to the smaller id. Other columns are not read.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from arbora.llm.batches import give_back
from arbora.llm.vectors import finite, matrix, one_per_id
from arbora.session import stash, table

COARSE, FINE = 4, 16
ANCHOR_BLOCK, VECTOR_BLOCK, STRIP = 4096, 8192, 512
BROADCAST_LABELS = 1 << 16
PACKED = "ids binary, labels binary, ints binary, mean binary, deviation binary, low binary, high binary"
_FAR = 1 << 60


def summaries(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """sqrt(L) * mean and deviation of each of FINE segments of every row."""
    cut, size = _segments(x.shape[1], FINE)
    m = np.add.reduceat(x, cut, axis=1) / np.sqrt(size)
    whole = np.add.reduceat(x * x, cut, axis=1)
    return m.astype(np.float32), np.sqrt(np.maximum(whole - m * m, 0) + 1e-12 * whole).astype(np.float32)


def _segments(n: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Where each of at most so many segments of n begins, and how long it is."""
    ends = np.linspace(0, n, min(n, most) + 1).astype(np.int64)
    return ends[:-1], np.diff(ends)


class Block:
    """Packed rows: ids, labels, integer vectors, summaries by level (coarse first), windows of scores asked for."""

    def __init__(self, rows: list[dict], dim: int):
        part = lambda name, kind: np.frombuffer(b"".join(r[name] for r in rows), kind)
        self.id, self.label = part("ids", "<i8"), part("labels", "<i8")
        self.x = part("ints", "<i4").reshape(len(self.id), dim).astype(np.float64)
        fine = min(dim, FINE)
        m, s = (part(name, "<f4").reshape(len(self.id), fine) for name in ("mean", "deviation"))
        size = _segments(dim, FINE)[1]
        cut, _ = _segments(fine, COARSE)
        whole = np.add.reduceat((m.astype(np.float64) ** 2 + s.astype(np.float64) ** 2), cut, axis=1)
        wide = np.add.reduceat(m * np.sqrt(size), cut, axis=1) / np.sqrt(np.add.reduceat(size, cut))
        self.level = [(wide.astype(np.float32), np.sqrt(np.maximum(whole - wide**2, 0) + 1e-12 * whole).astype(np.float32)), (m, s)]
        self.norm = np.sqrt(whole.sum(1)).astype(np.float32)
        self.low, self.high = (part(name, "<i8").reshape(len(self.id), -1) if len(self.id) else np.zeros((0, 1), np.int64) for name in ("low", "high"))


def scores(a: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact inner products of integers, all with all."""
    if np.abs(a).max(initial=0) * np.abs(c).max(initial=0) * a.shape[1] < 1 << 53:
        return (a @ c.T).astype(np.int64)
    return a.astype(np.int64) @ c.astype(np.int64).T


def pair_scores(a: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact inner products, row by row."""
    return np.einsum("ij,ij->i", a.astype(np.int64), c.astype(np.int64))


def best(a: Block, c: Block, same: bool, k: int) -> list[tuple[int, int, int, int]]:
    """(anchor, window, vector, score): the k highest scores of vectors of c in each window of each anchor of a, among those of its label or of others."""
    heaps: dict[tuple[int, int], list[tuple[int, int]]] = {}
    need, high = np.where(a.low <= a.high, a.low, _FAR), a.high
    starts = [0, *range(64, len(c.id), STRIP)]  # a short strip first: what it finds makes the bounds tell in the next
    for lo, hi in zip(starts, [*starts[1:], len(c.id)]):
        least, most = need.min(1), high.max(1)
        ok = ((a.label[:, None] == c.label[lo:hi]) == same) & (a.id[:, None] != c.id[lo:hi])
        for (am, as_), (cm, cs) in zip(a.level, c.level):
            i, j = np.flatnonzero(ok.any(1)), np.flatnonzero(ok.any(0))
            if not len(i):
                break
            middle, off = am[i] @ cm[lo + j].T, as_[i] @ cs[lo + j].T
            off += 1e-5 * a.norm[i, None] * c.norm[lo + j] + 1
            ok[np.ix_(i, j)] &= (middle + off >= least[i, None]) & (middle - off <= most[i, None])
        i, j = np.nonzero(ok)
        if len(i) * 8 > ok.size:
            score = scores(a.x, c.x[lo:hi])[i, j]
        else:
            score = np.concatenate([np.zeros(0, np.int64), *(pair_scores(a.x[i[s : s + 65536]], c.x[lo + j[s : s + 65536]]) for s in range(0, len(i), 65536))])
        for w in range(need.shape[1]):
            fits = np.flatnonzero((score >= need[i, w]) & (score <= high[i, w]))
            fi, fj, fs = i[fits], j[fits] + lo, score[fits]
            order = np.lexsort((c.id[fj], -fs, fi))
            fi, fj, fs = fi[order], fj[order], fs[order]
            place = np.arange(len(fi)) - np.searchsorted(fi, fi)
            for n, v, s in zip(fi[place < k].tolist(), c.id[fj[place < k]].tolist(), fs[place < k].tolist()):
                heap = heaps.setdefault((n, w), [])
                if len(heap) < k:
                    heapq.heappush(heap, (s, -v))
                elif (s, -v) > heap[0]:
                    heapq.heapreplace(heap, (s, -v))
                if len(heap) == k:
                    need[n, w] = max(need[n, w], heap[0][0])
    return [(n, w, -v, s) for (n, w), heap in heaps.items() for s, v in heap]


def _packer(scale: int):
    def pack(key: tuple, t: pa.Table) -> pa.Table:
        """One row of a group's rows, in order of their ids."""
        t = t.sort_by("id")
        x = np.floor(scale * matrix(t["v"]))
        m, s = summaries(x)
        low, high = (matrix(t[c]).astype("<i8") for c in ("low", "high"))
        own = [t["id"].to_numpy().astype("<i8"), t["label"].to_numpy().astype("<i8"), x.astype("<i4"), m.astype("<f4"), s.astype("<f4"), low, high]
        give_back()
        return pa.table([*(pa.array([k.as_py()], k.type) for k in key), *(pa.array([y.tobytes()], pa.binary()) for y in own)], names=[f"k{i}" for i in range(len(key))] + [c.split()[0] for c in PACKED.split(", ")])

    return pack


def packed(rows: DataFrame, keys: list[str], scale: int) -> DataFrame:
    """keys and one packed row of each group of rows (id, label, v, low, high)."""
    named = ", ".join(f"k{i} {rows.schema[k].dataType.simpleString()}" for i, k in enumerate(keys))
    return rows.select(*keys, "id", "label", "v", "low", "high").groupBy(*keys).applyInArrow(_packer(scale), f"{named}, {PACKED}").withColumnsRenamed({f"k{i}": k for i, k in enumerate(keys)})


def _tiles(asked: DataFrame, given: DataFrame, keys: list[str], same: bool, k: int) -> DataFrame:
    """(anchor_id, slot, vec_id, score) of the k best of each tile's windows. keys start with the vectors' length."""

    def run(key: tuple, a: pa.Table, c: pa.Table) -> pa.Table:
        found = []
        if a.num_rows and c.num_rows:
            dim = key[0].as_py()
            left = Block(a.to_pylist(), dim)
            found = [(left.id[n], w, v, s) for n, w, v, s in best(left, Block(c.to_pylist(), dim), same, k)]
        give_back()
        cols = zip(*found) if found else [()] * 4
        return pa.table([pa.array(x, kind) for x, kind in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.int64()))], names=["anchor_id", "slot", "vec_id", "score"])

    both = asked.groupBy(*keys).cogroup(given.groupBy(*keys)).applyInArrow(run, "anchor_id long, slot int, vec_id long, score long")
    order = Window.partitionBy("anchor_id", "slot").orderBy(F.desc("score"), "vec_id")
    return both.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _upto(n: Column) -> Column:
    return F.explode(F.sequence(F.lit(0), n - 1))


def _part(n: Column) -> Column:
    return F.pmod(F.xxhash64("id"), n).cast("int")


def mine(
    vectors: DataFrame, is_anchor: Column, n_positives: int = 5, n_negatives: int = 5, low: int = 80, high: int = 100, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label",
    scale: int = 256, anchor_block: int = ANCHOR_BLOCK, vector_block: int = VECTOR_BLOCK,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score of every anchor row."""
    v = F.col(vector)
    fits = F.pow(scale * (F.array_max(F.transform(v, lambda x: F.abs(x.cast("double")))) + 1), F.lit(2)) * F.size(v) < float(1 << 55)
    fits = fits & (F.array_max(F.transform(v, lambda x: F.abs(x.cast("double")))) * scale < float((1 << 31) - 1))
    rows = vectors.select(F.col(vec_id).cast("long").alias("id"), F.col(label).cast("long").alias("label"), v.alias("v"), F.coalesce(is_anchor, F.lit(False)).alias("anchor"), F.when(finite(v), fits).alias("ok"))
    rows = one_per_id(rows.where("ok and id is not null and label is not null").drop("ok")).withColumn("dim", F.size("v"))
    sizes = stash(rows.groupBy("dim", "label").agg(F.count("*").alias("n"), F.count_if("anchor").alias("a")), "labels")
    n, a, labels = sizes.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("a"), F.lit(0)), F.count("*")).first()
    any_score = [F.array(F.lit(x).cast("long")).alias(c) for c, x in (("low", -_FAR + 1), ("high", _FAR - 1))]

    blocks = sizes.where("a > 0 and n > 1").select("dim", "label", F.ceil(F.col("n") / vector_block).cast("int").alias("n_c"), F.ceil(F.col("a") / anchor_block).cast("int").alias("n_a"))
    by_label = rows.select("*", *any_score).join(F.broadcast(blocks) if labels <= BROADCAST_LABELS else blocks, ["dim", "label"])
    own = by_label.withColumn("block", F.col("label"))  # the label names the group and is packed with its rows
    given = packed(own.withColumn("c", _part(F.col("n_c"))), ["dim", "block", "c", "n_a"], scale).withColumn("a", _upto(F.col("n_a"))).drop("n_a")
    asked = packed(own.where("anchor").withColumn("a", _part(F.col("n_a"))), ["dim", "block", "a", "n_c"], scale).withColumn("c", _upto(F.col("n_c"))).drop("n_c")
    positives = stash(_tiles(asked, given, ["dim", "block", "a", "c"], True, n_positives).select("anchor_id", "rank", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")

    # slot r - 1 has the window of the positive of rank r; a negative score leaves nothing between its ends
    p = F.col("positive_score")
    ends = F.struct("rank", F.ceil(p * low / F.lit(100).cast("decimal(20,0)")).cast("long").alias("low"), F.floor(p * high / F.lit(100).cast("decimal(20,0)")).cast("long").alias("high"))
    windows = positives.groupBy(F.col("anchor_id").alias("id")).agg(F.array_sort(F.collect_list(ends)).alias("w"))
    padded = lambda c, x: F.concat(F.col("w")[c], F.array_repeat(F.lit(x).cast("long"), n_positives - F.size("w"))).alias(c)
    anchors = rows.where("anchor").join(windows.select("id", padded("low", 1), padded("high", 0)), "id")
    n_c, n_a = F.lit(max(1, math.ceil(n / vector_block))), F.lit(max(1, math.ceil(a / anchor_block)))
    given = packed(rows.select("*", *any_score).withColumn("c", _part(n_c)), ["dim", "c"], scale).withColumn("a", _upto(n_a))
    asked = packed(anchors.withColumn("a", _part(n_a)), ["dim", "a"], scale).withColumn("c", _upto(n_c))
    found = _tiles(asked, given, ["dim", "a", "c"], False, n_negatives)
    named = found.select("anchor_id", (F.col("slot") + 1).alias("place"), F.col("rank"), F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    return named.join(positives.withColumnRenamed("rank", "place"), ["anchor_id", "place"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(table(spark, sf_dir, "embeddings").select("vec_id", "embedding", moved.alias("label")), F.col("vec_id") % 100 == 0)


# All pairs; components are exact in doubles, as are their integer products.
_ORACLE = """
WITH r AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, [CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE) FOR x IN embedding] AS q
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, CAST(list_dot_product(a.q, b.q) AS BIGINT) AS score
  FROM r a JOIN r b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id AND len(a.q) = len(b.q)),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
n AS (SELECT p.anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id AS negative_id, positive_score, score AS negative_score
  FROM p JOIN s ON p.anchor_id = s.anchor_id AND NOT same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score)
SELECT * FROM n WHERE rank <= 5
"""

QUERIES = {"op11_hard_negatives": op11_hard_negatives}
ORACLES = {"op11_hard_negatives": _ORACLE}
