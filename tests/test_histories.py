"""Histories against real stacks, matchings against all permutations, quantiles against published values."""

from itertools import permutations

import numpy as np
import pytest

from arbora.functions import geometry
from arbora.operators import history, matching
from arbora.operators.matching import F


def stacks(log, limit, upto):
    """State by replaying onto real stacks."""
    out = {}
    for doc in {r[0] for r in log}:
        base, done, undone = [], [], []
        for _, _, op, entity, value in sorted((r for r in log if r[0] == doc and r[1] is not None and r[1] <= upto), key=lambda r: r[1]):
            if op == "edit":
                done.append((entity, value))
                undone.clear()
            elif op == "undo" and done:
                undone.append(done.pop())
            elif op == "redo" and undone:
                done.append(undone.pop())
            if len(done) > limit:
                base.append(done.pop(0))
        for entity, value in base + done:
            if entity is not None:
                out[doc, entity] = value
    return out


@pytest.mark.parametrize("limit", [3, 200])
def test_replays(spark, limit):
    rng = np.random.default_rng(limit)
    log = [(d, i, ["edit", "edit", "undo", "undo", "redo", "other", None][int(rng.integers(7))], int(rng.integers(4)) if rng.random() < 0.9 else None, int(rng.integers(100))) for d in range(6) for i in range(80)]
    log += [(9, None, "edit", 1, 1), (9, 5, "undo", None, None)]
    df = spark.createDataFrame(log, "doc long, seq long, op string, entity long, value long").repartition(3)
    levels = history.with_levels(df, limit).cache()
    for upto in (0, 7, 33, 79):
        assert {(r.doc, r.entity): r.value for r in history.state(levels, upto).collect()} == stacks(log, limit, upto)
    assert history.state(levels.limit(0)).count() == 0


def test_undo_gives_back_what_was(spark):
    log = [(1, k, op, e, v) for k, (op, e, v) in enumerate([("edit", 1, 10), ("edit", 1, 11), ("undo", None, None), ("redo", None, None), ("undo", None, None), ("edit", 2, 5), ("redo", None, None), ("undo", None, None), ("undo", None, None), ("undo", None, None)])]
    levels = history.with_levels(spark.createDataFrame(log, "doc long, seq long, op string, entity long, value long"))
    got = [{r.entity: r.value for r in history.state(levels, k).collect()} for k in range(10)]
    assert got == [{1: 10}, {1: 11}, {1: 10}, {1: 11}, {1: 10}, {1: 10, 2: 5}, {1: 10, 2: 5}, {1: 10}, {}, {}]


def best(pairs):
    """Largest number of pairs, then smallest sum, over all choices."""
    refs = sorted({r for _, r in pairs})
    cands = sorted({c for c, _ in pairs})
    small, large, flip = (refs, cands, False) if len(refs) <= len(cands) else (cands, refs, True)
    found = (0, 0.0)
    for p in permutations(large, len(small)):
        d = [pairs[(s, q) if flip else (q, s)] for s, q in zip(small, p) if ((s, q) if flip else (q, s)) in pairs]
        found = min(found, (-len(d), sum(d)))
    return found


@pytest.mark.parametrize("seed", range(4))
def test_optimal(spark, seed):
    rng = np.random.default_rng(seed)
    n, m = [(6, 4), (4, 6), (5, 5), (7, 3)][seed]
    c, r = rng.uniform(0, 2, (n, 3)), rng.uniform(0, 2, (m, 3))
    tol = rng.uniform(0.3, 1.6, m)
    cands = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(c)] + [(90, float("nan"), 0.0, 0.0), (91, None, 0.0, 0.0)], "id long, x double, y double, z double")
    refs = spark.createDataFrame([(i, *map(float, p), float(t)) for i, (p, t) in enumerate(zip(r, tol))] + [(90, 0.0, 0.0, 0.0, -1.0), (91, 0.0, 0.0, 0.0, None)], "id long, x double, y double, z double, tolerance double")
    pairs = {(i, j): float(np.linalg.norm(c[i] - r[j])) for i in range(n) for j in range(m) if np.linalg.norm(c[i] - r[j]) <= tol[j]}
    allowed = matching.allowed_pairs(cands, refs).cache()
    assert {(x.cand, x.ref) for x in allowed.collect()} == set(pairs)
    got = matching.optimal_matches(allowed).collect()
    assert len({x.cand for x in got}) == len({x.ref for x in got}) == len(got)
    want = best(pairs)
    assert len(got) == -want[0] and sum(x.d for x in got) == pytest.approx(want[1]) and all(pairs[x.cand, x.ref] == pytest.approx(x.d) for x in got)
    row = matching.scores(cands, refs, allowed, matching.optimal_matches(allowed)).first()
    assert row.tp == len(got) and row.fp_duplicate == len({i for i, _ in pairs}) - len(got) and row.fp == n + 2 - row.tp and row.fp_isolated == row.fp - row.fp_duplicate
    free, taken = set(range(m)), {}
    for i in range(n):
        near = min((k for k in free if (i, k) in pairs and pairs[i, k] < tol[k]), key=lambda k: (pairs[i, k], k), default=None)
        if near is not None:
            free.remove(near)
            taken[i] = near
    assert {x.cand: x.ref for x in matching.greedy_matches(matching.allowed_pairs(cands, refs, strict=True)).collect()} == taken
    assert matching.optimal_matches(allowed.limit(0)).count() == 0


def test_assignment_of_larger_tables():
    """Against the dual: a feasible pair of potentials with the same value proves a matching optimal; here by swapping pairs until nothing improves."""
    rng = np.random.default_rng(1)
    cost = rng.uniform(size=(40, 55))
    at = matching.assignment(cost)
    assert len(set(at.tolist())) == 40
    total = cost[np.arange(40), at].sum()
    for _ in range(3000):
        other = rng.permutation(55)[:40]
        assert cost[np.arange(40), other].sum() >= total
    for i in range(40):
        for j in range(55):
            where = np.flatnonzero(at == j)
            if len(where):
                k = where[0]
                assert cost[i, at[i]] + cost[k, at[k]] <= cost[i, j] + cost[k, at[i]] + 1e-12
            else:
                assert cost[i, at[i]] <= cost[i, j] + 1e-12


def test_greedy_matching_over_many_tiles(spark):
    """Crowded points whose choices hang on one another across tiles, with equal distances, against a plain pass."""
    rng = np.random.default_rng(8)
    place = lambda n: np.round(rng.uniform(0, 1, (n, 3)) * (1, 0.3, 0.2), 2)
    c, r, wide = place(1500), place(1400), rng.uniform(0.01, 0.12, 1400)
    at = rng.permutation(5000)[:1500] - 700
    free, want = np.ones(1400, bool), {}
    for i in np.argsort(at):
        d = np.sqrt((c[i, 0] - r[:, 0]) ** 2 + (c[i, 1] - r[:, 1]) ** 2 + (c[i, 2] - r[:, 2]) ** 2)
        open_ = np.flatnonzero(free & (d < wide))
        if len(open_):
            k = open_[np.argmin(d[open_])]
            free[k], want[int(at[i])] = False, int(k)
    cands = spark.createDataFrame([(int(k), *map(float, p)) for k, p in zip(at, c)] + [(9000, float("nan"), 0.0, 0.0)], "id long, x double, y double, z double").repartition(3)
    refs = spark.createDataFrame([(k, *map(float, p), float(w)) for k, (p, w) in enumerate(zip(r, wide))] + [(9000, 0.0, 0.0, 0.0, None), (9001, 0.0, 0.0, 0.0, -1.0)], "id long, x double, y double, z double, tolerance double")
    got = matching.greedy_near(cands, refs).collect()
    assert {x.cand: x.ref for x in got} == want and len(got) == len(want)
    assert matching.greedy_near(cands, refs.limit(0)).count() == 0


def test_student_quantiles(spark):
    # published two-sided 95 % values
    known = {1: 12.7062, 2: 4.3027, 3: 3.1824, 4: 2.7764, 5: 2.5706, 9: 2.2622, 10: 2.2281, 20: 2.0860, 30: 2.0423, 40: 2.0211, 60: 2.0003, 120: 1.9799}
    df = spark.createDataFrame([(n,) for n in known] + [(0,)], "n int")
    got = {r.n: r.t for r in df.select("n", geometry.student_t(0.975, F.col("n")).alias("t")).collect()}
    assert got.pop(0) is None
    assert got == {n: pytest.approx(t, abs=6e-5) for n, t in known.items()}
    assert geometry.t_quantile(0.025, 5) == pytest.approx(-2.5706, abs=6e-5)
    # the expansion takes over without a step
    both = spark.createDataFrame([(40,), (41,)], "n int").select(geometry.student_t(0.975, F.col("n")).alias("t")).collect()
    assert both[1].t == pytest.approx(geometry.t_quantile(0.975, 41), abs=1e-7)
