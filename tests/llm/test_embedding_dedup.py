"""Near-duplicate embeddings against all pairs in double precision."""

import math

import duckdb
import numpy as np
import pytest

from arbora.llm import embedding_dedup


def brute(rows, cosine):
    fine, every = {}, set()
    for i, lab, v in rows:
        if i is not None:
            every.add(i)
            if lab is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v):
                fine[i] = min(fine.get(i, (lab, v)), (lab, v))
    up = {i: i for i in every}

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    n = dict.fromkeys(every, 0)
    groups = {}
    for i, (lab, v) in fine.items():
        groups.setdefault((lab, len(v)), []).append(i)
    for ids in groups.values():
        ids.sort()
        x = np.array([fine[i][1] for i in ids])
        u = x / np.abs(x).max(1, keepdims=True)
        u /= np.linalg.norm(u, axis=1, keepdims=True)
        link = u @ u.T >= cosine
        for p, q in zip(*np.nonzero(np.triu(link, 1))):
            a, b = ids[p], ids[q]
            n[a] += 1
            n[b] += 1
            x, y = sorted((top(a), top(b)))
            up[y] = x
    return sorted((i, n[i], top(i), top(i) == i) for i in every)


def found(df):
    return sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in df.collect())


ODD = [(9000, 1, None), (9001, 1, []), (9002, None, [1.0] * 5), (9003, 1, [1.0, None, 0.0, 0.0, 0.0]), (9004, 1, [float("nan")] * 5), (9005, 2, [float("inf")] * 5), (9006, 1, [0.0] * 5), (None, 1, [1.0] * 5)]
ODD += [(9020, 2, [1.0] * 3), (9021, 2, [2.0] * 3), (9022, 3, [0.9] * 3), (9030, 5, [0.5] * 5), (9030, 4, [0.6] * 5), (9031, 4, [7.0] * 5), (9032, 4, None), (9032, 4, [1e-200] * 5), (9033, 4, [1e200] * 5), (9034, 6, [2.0])]


@pytest.mark.parametrize("dim,cosine,block", [(5, 0.93, 64), (40, 0.93, 300), (5, 0.5, 40), (12, 0.999, 64)])
def test_all_pairs(spark, dim, cosine, block):
    rng = np.random.default_rng(dim)
    middle = rng.normal(size=(9, dim))
    rows = [(int(i), int(rng.integers(0, 3)), rng.normal(size=dim).tolist()) for i in rng.permutation(500)]
    rows += [(1000 + i, i % 2, (middle[i % 9] + 0.25 * rng.normal(size=dim)).tolist()) for i in range(500)]
    rows += [(2000 + i, 1, (middle[0] + 0.01 * rng.normal(size=dim)).tolist()) for i in range(700)]  # near copies
    rows += [(3000 + i, i % 3, ((1 + i % 2) * middle[1]).tolist()) for i in range(300)]  # copies, two lengths of one direction
    rows += [(4000 + i, 7, (middle[2] + (middle[3] - middle[2]) * i / 60).tolist()) for i in range(61)]  # a chain
    rows += ODD if dim == 5 else []
    df = spark.createDataFrame([(*r, 1, "x", 0) for r in rows], "vec_id long, label int, embedding array<double>, id int, rep string, n int").repartition(3)
    assert found(embedding_dedup.near_duplicates(df, cosine, block=block)) == brute(rows, cosine)


def test_many_ranges_meet(spark, monkeypatch):
    """Levels of intervals: more ranges than one level holds; labels that are strings."""
    monkeypatch.setattr(embedding_dedup, "FAN", 2)
    monkeypatch.setattr(embedding_dedup, "BLOCKS_A_RANGE", 1)
    rng = np.random.default_rng(3)
    rows = [(i, "ab"[i % 2], rng.normal(size=4).tolist()) for i in range(600)]
    df = spark.createDataFrame(rows, "vec_id long, label string, embedding array<float>")
    assert found(embedding_dedup.near_duplicates(df, block=25)) == brute([(r.vec_id, r.label, r.embedding) for r in df.collect()], 0.93)


def test_blocks_far_apart_are_skipped(spark):
    rows = [(i, 1, [math.cos(i / 200), math.sin(i / 200)]) for i in range(1200)]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")
    points = df.selectExpr("vec_id id", "label", "size(embedding) dim", "1L weight", "embedding v")
    space = embedding_dedup.Space(embedding_dedup.fit(np.array([r[2] for r in rows])), math.sqrt(0.14))
    blocks = embedding_dedup.stash(embedding_dedup._blocks(points, space, 1200, 20), "t")
    n, pairs = blocks.count(), embedding_dedup.block_pairs(blocks, space.eps).count()
    assert n >= 60 and pairs < n * n / 4


def test_whole_halves_link():
    rng = np.random.default_rng(0)
    v = np.ones(8) + 0.001 * rng.normal(size=(1000, 8))
    row = {"ids": np.arange(1000).tobytes(), "weights": np.ones(1000, np.int64).tobytes(), "vectors": v.tobytes()}
    side = embedding_dedup.Side(row, 8, embedding_dedup.Space(None, math.sqrt(0.14)))
    assert sorted(embedding_dedup.tile(side, side, True, 0.93, math.sqrt(0.14))) == [(i, 999, 0) for i in range(1000)]
    assert list(side.seen) == [(0, 1000)]


def test_empty(spark):
    none = spark.createDataFrame([], "vec_id long, label int, embedding array<float>")
    assert embedding_dedup.near_duplicates(none).count() == 0
    odd = spark.createDataFrame([(1, None, [1.0]), (2, 3, None)], "vec_id long, label int, embedding array<float>")
    assert found(embedding_dedup.near_duplicates(odd)) == [(1, 0, 1, True), (2, 0, 2, True)]


def test_query(spark):
    d = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{d}/embeddings.parquet'")
    assert found(embedding_dedup.op12_embedding_dedup(spark, d)) == sorted(con.execute(embedding_dedup.ORACLES["op12_embedding_dedup"]).fetchall())
