"""Hard negatives against all pairs in whole numbers."""

import math

import duckdb
import numpy as np
import pytest

from arbora.llm import hard_negatives
from arbora.llm.hard_negatives import F


def brute(rows, is_anchor, n_positives, n_negatives, low, high):
    fine = {}
    for i, lab, v in rows:
        if i is not None and lab is not None and v and all(x is not None and math.isfinite(x) for x in v):
            key = (lab, [float(x) for x in v])
            fine[i] = min(fine.get(i, key), key)
    q = {i: (lab, [math.floor(256 * x) for x in v]) for i, (lab, v) in fine.items()}
    out = []
    for a, (lab, x) in q.items():
        if is_anchor(a):
            score = {i: sum(s * t for s, t in zip(x, y)) for i, (_, y) in q.items() if i != a and len(y) == len(x)}
            order = sorted(score, key=lambda i: (-score[i], i))
            for p in [i for i in order if q[i][0] == lab][:n_positives]:
                found = [i for i in order if q[i][0] != lab and low * score[p] <= 100 * score[i] <= high * score[p]][:n_negatives]
                out += [(a, p, n + 1, i, score[p], score[i]) for n, i in enumerate(found)]
    return sorted(out)


def rows_of(df):
    return sorted((r.anchor_id, r.positive_id, r.rank, r.negative_id, r.positive_score, r.negative_score) for r in df.collect())


ODD = [(9000, 1, None), (9001, 1, []), (9002, None, [1.0] * 6), (9003, 1, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (9004, 1, [float("nan")] * 6), (9005, 2, [float("inf")] * 6), (None, 1, [1.0] * 6)]
ODD += [(9010, 1, [0.0] * 6), (9020, 2, [1.0] * 3), (9021, 2, [1.0] * 3), (9022, 3, [0.9] * 3), (9030, 5, [0.5] * 6), (9030, 4, [0.6] * 6), (9040, 7, [1.0] * 6)]


@pytest.mark.parametrize("dim,scale", [(6, 1.0), (37, 0.2), (6, 7e4)])
def test_all_pairs(spark, dim, scale):
    rng = np.random.default_rng(dim)
    middle = rng.normal(size=(4, dim))
    rows = [(i, int(rng.integers(0, 4)), (scale * (middle[i % 4] + 0.3 * rng.normal(size=dim))).tolist()) for i in range(400)]
    rows += [(400 + i, i % 3, (scale * middle[0]).tolist()) for i in range(150)]  # ties and copies
    rows += ODD if dim == 6 else []
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "vec_id long, label int, embedding array<double>, id int, anchor string").repartition(3)
    got = hard_negatives.mine(df, F.col("vec_id") % 10 == 0, 3, 4, 70, 100, anchor_block=20, vector_block=130)
    want = brute(rows, lambda a: a % 10 == 0, 3, 4, 70, 100)
    assert want and rows_of(got) == want


def test_bounds_hold():
    rng = np.random.default_rng(1)
    for dim in (1, 3, 16, 65):
        x = np.floor(rng.normal(size=(50, dim)) * 300)
        m, s = (y.astype(np.float64) for y in hard_negatives.summaries(x))
        own, slack = x @ x.T, 1e-5 * np.sqrt(np.outer((x * x).sum(1), (x * x).sum(1))) + 1
        assert (np.abs(own - m @ m.T) <= s @ s.T + slack).all()


def test_empty(spark):
    none = spark.createDataFrame([], "vec_id long, label int, embedding array<float>")
    assert hard_negatives.mine(none, F.col("vec_id") >= 0).count() == 0
    one = spark.createDataFrame([(0, 1, [1.0]), (1, 2, [1.0])], "vec_id long, label int, embedding array<float>")
    assert hard_negatives.mine(one, F.col("vec_id") >= 0).count() == 0


def test_query(spark):
    d = "/root/testdata/sf0.1"
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{d}/embeddings.parquet'")
    want = sorted(con.execute(f"select anchor_id, positive_id, rank, negative_id, positive_score, negative_score from ({hard_negatives.ORACLES['op11_hard_negatives']})").fetchall())
    assert want and rows_of(hard_negatives.op11_hard_negatives(spark, d)) == want
