"""Crop plans against a walk down the tree; take-off radii by hand."""

import numpy as np
import pytest

from arbora.operators import crop
from arbora.session import stash


def walk(rows, vessels, order, radius, ratio, unattributed, dropped, pruned):
    parent = {n: p for n, p, _, _ in rows}
    at = {n: (t, s) for n, _, t, s in rows}
    kids = {}
    for n, p in parent.items():
        kids.setdefault(p, []).append(n)

    def ways(n):
        while n is not None:
            yield n
            n = parent[n]

    def under(n):
        out, todo = [], [n]
        while todo:
            out.append(todo.pop())
            todo += kids.get(out[-1], [])
        return out

    depth = {n: len(list(ways(n))) - 1 for n in parent}
    ostia = {v: min((n for n, w in vessels.items() if w == v and n in parent), key=lambda n: (depth[n], n), default=None) for v in set(vessels.values())}
    protected = {r for n in vessels if n in parent for r in ways(n)} | {n for n, p in parent.items() if p is None}
    of = {n: next((vessels[a] for a in ways(n) if a in vessels), None) for n in parent}

    def verdict(n):
        t, s = at[n]
        v = of[n]
        limit = None if v is None or at[ostia[v]][0] is None or ratio is None else ratio * at[ostia[v]][0]
        if order is not None and s is not None and s < order:
            return "strahler"
        if radius is not None and t is not None and t < radius:
            return "radius"
        if limit is not None and t is not None and t < limit:
            return "ratio"
        return "unattributed" if unattributed and v is None else None

    out = dict.fromkeys(parent, (None, None))
    for n in sorted(parent, key=lambda n: depth[n]):
        if n not in protected and out[n][0] is None and verdict(n):
            out.update({m: (verdict(n), n) for m in under(n)})
    for n in dropped:
        if n in parent and n not in protected and out[n][0] is None:
            out[n] = ("hand", n)
    for n in sorted((n for n in pruned if n in parent), key=lambda n: depth[n]):
        if n not in protected:
            out.update({m: ("hand-subtree", n) for m in under(n) if out[m][0] is None})
    return {n: (*x, n in protected, None if x[1] != n else 1 if x[0] == "hand" else len(under(n))) for n, x in out.items()}


@pytest.mark.parametrize("seed", range(3))
def test_plan(spark, seed):
    rng = np.random.default_rng(seed)
    n = 70
    rows = [(i, None if i in (0, 60) else int(rng.integers(0, i)), None if rng.random() < 0.1 else float(rng.uniform(1, 9)), None if rng.random() < 0.1 else int(rng.integers(2, 5))) for i in range(n)]
    vessels = {3: "a", 11: "a", 20: "b", 999: "c"}
    rules = [(3, 3.0, 0.5, False), (None, None, 0.8, True), (None, None, None, False)][seed]
    dropped, pruned = [5, 40, 3, 998], [33, 12, 20]
    tree = spark.createDataFrame(rows, "node long, parent long, takeoff double, strahler int").repartition(3)
    marks = lambda ids: spark.createDataFrame([(i,) for i in ids], "node long")
    plan = crop.crop_plan(tree, spark.createDataFrame(list(vessels.items()), "node long, vessel string"), *rules, marks(dropped), marks(pruned)).cache()
    want = walk(rows, vessels, *rules, dropped, pruned)
    assert {r.node: (r.rule, r.takeoff_node, r.protected, r.n_subtree) for r in plan.collect()} == want
    counts = crop.crop_counts(plan, tree).first()
    assert counts.n_before == n and counts.n_after == sum(x[0] is None for x in want.values())


def test_without_marks_or_segments(spark):
    tree = spark.createDataFrame([(0, None, 5.0, 2), (1, 0, 1.0, 1)], "node long, parent long, takeoff double, strahler int")
    none = spark.createDataFrame([], "node long, vessel string")
    assert [r.rule for r in crop.crop_plan(tree, none, min_radius=2.0).orderBy("node").collect()] == [None, "radius"]
    assert crop.crop_plan(tree.limit(0), none, min_radius=2.0).count() == 0


def broadcast_rows(spark, since):
    """The most rows that any execution after `since` sent to all tasks, and the last execution."""
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    store, most, last = spark._jsparkSession.sharedState().statusStore(), 0, since
    runs = store.executionsList()
    for k in range(runs.size()):
        i = runs.apply(k).executionId()
        last = max(last, i)
        nodes, values = store.planGraph(i).allNodes(), store.executionMetrics(i)
        for n in (nodes.apply(j) for j in range(nodes.size()) if i > since):
            metrics = n.metrics()
            if n.name() == "BroadcastExchange":
                found = [values.get(m.accumulatorId()) for m in (metrics.apply(j) for j in range(metrics.size())) if m.name() == "number of output rows"]
                most = max([most, *(int(v.get().replace(",", "")) for v in found if v.isDefined())])
    return most, last


def test_segments_are_not_broadcast(spark):
    """Tables of a row a segment take little room in files, but only the vessels' few rows are sent to all tasks."""
    tree = stash(spark.range(20_000, numPartitions=3).selectExpr("id as node", "if(id > 0, (id - 1) div 2, null) as parent", "double(id % 7) as takeoff", "int(id % 5) as strahler"), "tree")
    vessels = spark.createDataFrame([(1, "a"), (2, "b")], "node long, vessel string")
    _, last = broadcast_rows(spark, -1)
    plan = crop.crop_plan(tree, vessels, 2, 1.0, 0.5)
    assert crop.crop_counts(plan, tree).first().n_before == 20_000 and crop.vessel_ostia(tree, vessels).count() == 2
    assert 0 < broadcast_rows(spark, last)[0] < 100


def test_takeoff_radius(spark):
    rows = [(0, k, float(k), 0.0, 0.0, r) for k, r in enumerate([2.0, 1.9, 1.8, 1.7, 1.0, 0.5])] + [(1, 0, 0.0, 0.0, 0.0, 7.0)] + [(2, k, 0.1 * k, 0.0, 0.0, 3.0 - k) for k in range(3)]
    points = spark.createDataFrame([(*r, r[0] == 2) for r in rows], "edge_id long, pos long, x double, y double, z double, r double, back boolean").repartition(3)
    assert {r.edge_id: r.takeoff for r in crop.takeoff_radius(points).collect()} == {0: 1.0, 1: 7.0, 2: 1.0}
    assert {r.edge_id: r.takeoff for r in crop.takeoff_radius(points, 0.15, "back").collect()} == {0: 1.9, 1: 7.0, 2: 3.0}
