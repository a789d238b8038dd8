"""Nearest neighbours by Euclidean distance, over tiles of a query block and a block of vectors.

A tile is one task: both blocks as int8 with a scale for each vector, one product of integers for all pairs (exact: it fits the
floating type it is computed in), and from it a lower and an upper bound of every distance, because the rounding error of each vector is
known:  |q.c - q'.c'| <= |q| |c - c'| + |q - q'| |c'|.  Pairs whose lower bound is beyond the k-th smallest upper bound, or the k-th best
found, cannot be among the k nearest; the rest are computed in double precision from the given vectors and go through a heap of k for each
query. Spark then merges the tiles' heaps. Nothing is approximated: the result is that of comparing all pairs, ties to the smaller id.

Block sizes bound a tile's memory; only their number grows. Vectors that are null, empty, all zero or hold a null or a number that isn't finite take
no part; vectors of different lengths are not compared. Of rows that share an id the smallest vector counts. Other columns are not read.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from arbora.session import table

QUERY_BLOCK, VECTOR_BLOCK, STRIP = 1024, 4096, 1024


def _matrix(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Ids in order and their vectors; of one id the smallest vector."""
    t = t.combine_chunks()
    ids = t["id"].to_numpy()
    flat = pa.concat_arrays([c.flatten() for c in t["v"].chunks]).to_numpy().reshape(len(ids), -1).astype(np.float64)
    order = np.lexsort((*flat.T[::-1], ids))
    ids, flat = ids[order], flat[order]
    keep = np.ones(len(ids), bool)
    keep[1:] = ids[1:] != ids[:-1]
    return ids[keep], flat[keep]


class Rounded:
    """int8 vectors, their scales, and lengths of the vectors, the rounded vectors and the differences."""

    def __init__(self, x: np.ndarray):
        most = np.abs(x).max(1)
        self.scale = most / 127
        # a scale that is subnormal would divide badly: the bound below then covers the whole vector
        fine = self.scale > 1e-290
        self.q = np.zeros(x.shape)
        self.q[fine] = np.rint(x[fine] / self.scale[fine, None])
        near = self.q * self.scale[:, None]
        grow = 1 + 1e-12 * x.shape[1]
        self.norm, self.near, self.off = (np.sqrt((y * y).sum(1)) * grow for y in (x, near, x - near))
        self.square = (x * x).sum(1)
        self.q = self.q.astype(np.float32 if x.shape[1] * 127 * 127 < 1 << 24 else np.float64)


def bounds(a: Rounded, b: Rounded, at: slice) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds of the squared distances of all of a to a strip of b."""
    dot = (a.q @ b.q[at].T).astype(np.float64) * a.scale[:, None] * b.scale[at]
    size = a.square[:, None] + b.square[at]
    slack = 2 * (a.norm[:, None] * b.off[at] + a.off[:, None] * b.near[at]) + size * 1e-10 + 1e-300
    middle = size - 2 * dot
    return middle - slack, middle + slack


def nearest(qid: np.ndarray, q: np.ndarray, cid: np.ndarray, c: np.ndarray, k: int) -> list[tuple[int, int, float]]:
    """(query, vector, distance) of the k nearest in this tile of each query, without itself."""
    a, b = Rounded(q), Rounded(c)
    heaps: list[list[tuple[float, int]]] = [[] for _ in qid]
    worst = np.full(len(qid), np.inf)
    for lo in range(0, len(cid), STRIP):
        at = slice(lo, lo + STRIP)
        low, high = bounds(a, b, at)
        same = qid[:, None] == cid[at]
        low[same] = high[same] = np.inf
        limit = worst**2 * (1 + 1e-12)
        if high.shape[1] >= k:
            limit = np.minimum(limit, np.partition(high, k - 1, axis=1)[:, k - 1])
        i, j = np.nonzero((low <= limit[:, None]) & ~same)
        for s in range(0, len(i), 1 << 16):
            x, y = i[s : s + (1 << 16)], j[s : s + (1 << 16)] + lo
            d = q[x] - c[y]
            score = np.sqrt((d * d).sum(1))
            ok = score <= worst[x]
            for n, v, m in zip(x[ok].tolist(), score[ok].tolist(), cid[y[ok]].tolist()):
                heap, item = heaps[n], (-v, -m)
                if len(heap) < k:
                    heapq.heappush(heap, item)
                elif item > heap[0]:
                    heapq.heapreplace(heap, item)
            full = [n for n in np.unique(x[ok]).tolist() if len(heaps[n]) == k]
            worst[full] = [-heaps[n][0][0] for n in full]
    return [(n, -m, -v) for n, heap in zip(qid.tolist(), heaps) for v, m in heap]


def knn(vectors: DataFrame, is_query: Column, k: int = 10, vec_id: str = "vec_id", vector: str = "embedding", query_block: int = QUERY_BLOCK, vector_block: int = VECTOR_BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest vectors of every query row."""
    v = F.col(vector).cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = vectors.select(F.col(vec_id).cast("long").alias("id"), v.alias("v"), is_query.alias("query")).where(F.col("id").isNotNull() & F.coalesce(fine, F.lit(False)))
    n = rows.agg(F.count("*").alias("n"), F.count_if("query").alias("q")).first()
    n_q, n_c = max(1, math.ceil(n.q / query_block)), max(1, math.ceil(n.n / vector_block))
    tile = lambda df, own, others, block, blocks: df.select("id", "v", F.size("v").alias("dim"), F.pmod(F.xxhash64("id"), F.lit(block)).cast("int").alias(own), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias(others))
    asked = tile(rows.where("query"), "qb", "cb", n_q, n_c)
    given = tile(rows, "cb", "qb", n_c, n_q)

    def run(queries: pa.Table, others: pa.Table) -> pa.Table:
        found = nearest(*_matrix(queries), *_matrix(others), k) if queries.num_rows and others.num_rows else []
        ids, other, score = zip(*found) if found else ((), (), ())
        return pa.table({"query_id": pa.array(ids, pa.int64()), "vec_id": pa.array(other, pa.int64()), "score": pa.array(score, pa.float64())})

    best = asked.groupBy("qb", "cb", "dim").cogroup(given.groupBy("qb", "cb", "dim")).applyInArrow(run, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op7_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return knn(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


QUERIES = {"op7_neighbours": op7_neighbours}
ORACLES: dict[str, str] = {}
