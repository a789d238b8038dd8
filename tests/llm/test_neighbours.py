"""Nearest neighbours against all pairs in double precision."""

import math

import duckdb
import numpy as np
import pytest

from arbora.llm import neighbours


def brute(rows, queries, k):
    fine = {}
    for i, v in rows:
        if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v):
            fine[i] = min(fine.get(i, v), v)
    out = {}
    for q in queries:
        if q in fine:
            a = np.array(fine[q])
            found = sorted((float(np.sqrt(((a - np.array(v)) ** 2).sum())), i) for i, v in fine.items() if i != q and len(v) == len(a))[:k]
            if found:
                out[q] = found
    return out


def same(got, want):
    have = {}
    for r in sorted(got, key=lambda r: (r.query_id, r.rank)):
        have.setdefault(r.query_id, []).append((r.score, r.vec_id, r.rank))
    assert have.keys() == want.keys()
    for q, found in want.items():
        assert [x[2] for x in have[q]] == list(range(1, len(found) + 1))
        assert [x[1] for x in have[q]] == [i for _, i in found]
        assert [x[0] for x in have[q]] == pytest.approx([s for s, _ in found], rel=1e-12, abs=1e-300)


@pytest.mark.parametrize("scale", [1.0, 1e-200, 1e150])
def test_all_pairs(spark, scale):
    rng = np.random.default_rng(4)
    rows = [(i, (rng.integers(-3, 4, 5) * scale).tolist()) for i in range(300)]
    rows += [(300 + i, (rng.normal(size=5) * scale).tolist()) for i in range(300)] + [(600 + i, [scale] * 5) for i in range(200)]
    rows += [(900, None), (901, []), (902, [0.0] * 5), (903, [1.0, None, 0.0, 0.0, 0.0]), (904, [float("nan")] * 5), (905, [float("inf")] * 5), (906, [scale] * 3), (907, [2 * scale] * 3), (908, [scale]), (None, [scale] * 5), (10, [scale] * 5), (10, [scale] * 5)]
    df = spark.createDataFrame([(*r, "q", 7) for r in rows], "vec_id long, embedding array<double>, id string, query int").repartition(3)
    got = neighbours.knn(df, neighbours.F.col("vec_id") % 10 == 0, 7, query_block=30, vector_block=100).collect()
    got += neighbours.knn(df, neighbours.F.col("vec_id").isin(906, 908), 7).collect()
    same(got, brute(rows, [i for i, _ in rows if i is not None and i % 10 == 0] + [906, 908], 7))


def test_empty(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert neighbours.knn(none, neighbours.F.col("vec_id") >= 0).count() == 0


def test_query(spark):
    d = "/root/testdata/sf0.1"
    rows = duckdb.connect().execute(f"select vec_id, embedding from '{d}/embeddings.parquet'").fetchall()
    same(neighbours.op7_neighbours(spark, d).collect(), brute(rows, range(0, 2000, 100), 10))
