"""Spanning forests and chosen links against greedy passes."""

import duckdb
import numpy as np
import pytest

from arbora.operators import spanning
from arbora.operators.spanning import F


class Union(dict):
    def top(self, x):
        while self.setdefault(x, x) != x:
            x = self[x]
        return x

    def join(self, a, b):
        a, b = self.top(a), self.top(b)
        self[b] = a
        return a != b


def kruskal(edges):
    """Removed ids of (id, a, b, radius, length)."""
    up, gone = Union(), set()
    for i, a, b, *_ in sorted(edges, key=lambda e: (-(float("inf") if e[3] is None else e[3]), e[4] or 0.0, -e[0])):
        if a == b or not up.join(a, b):
            gone.add(i)
    return gone


@pytest.mark.parametrize("n,m,ties", [(40, 120, 3), (300, 320, 50), (1, 3, 1)])
def test_loop_breaks(spark, n, m, ties):
    rng = np.random.default_rng(n)
    edges = [(i, int(rng.integers(n)), int(rng.integers(n)), float(rng.integers(ties)) if i % 9 else None, float(rng.integers(3)) if i % 7 else None) for i in range(m)]
    df = spark.createDataFrame(edges, "edge_id long, src long, dst long, radius double, length double").repartition(3)
    assert {r.edge_id for r in spanning.loop_breaks(df).collect()} == kruskal(edges)
    assert spanning.loop_breaks(df.limit(0)).count() == 0


def test_whole_graph(spark):
    """The forest of every line's edges is that of a sorted greedy pass."""
    from arbora.plans import chains as plans

    d = "/root/testdata/sf0.001"
    rows = [(r.edge_id, r.src, r.dst, r.radius, r.length) for r in plans.part_graph(spark, d).collect()]
    assert len(rows) == duckdb.execute(f"select count(*) from (select distinct l_partkey, l_suppkey from '{d}/lineitem.parquet')").fetchone()[0]
    assert {r.edge_id for r in plans.loop_breaks(spark, d).collect()} == kruskal(rows)


def greedy(rows, component):
    up, used, out = Union(), {}, {}
    key = lambda n: ("c", component[n]) if n in component else ("n", n)
    for i, s, t, anchor, conf, status in sorted(rows, key=lambda r: (-r[4], r[0])):
        if status != "accept":
            out[i] = (False, status)
        elif s in used or (t is not None and t in used):
            out[i] = (False, "end in use")
        elif up.top(key(s)) == up.top(key(t if t is not None else anchor)):
            out[i] = (False, "loop")
        else:
            up.join(key(s), key(t if t is not None else anchor))
            used[s] = i
            if t is not None:
                used[t] = i
            out[i] = (True, "accept")
    return out


@pytest.mark.parametrize("seed", range(2))
def test_select_links(spark, seed):
    rng = np.random.default_rng(seed)
    nodes = {n: n // 4 for n in range(60)}
    rows = []
    for i in range(150):
        s, t = (int(x) for x in rng.integers(0, 66, 2))
        side = rng.random() < 0.2
        rows.append((i, s, None if side else t, t, float(rng.integers(0, 12)), ["accept", "accept", "accept", "review"][int(rng.integers(4))]))
    df = spark.createDataFrame(rows, "cand_id long, source long, target long, anchor long, confidence double, status string").repartition(3)
    got = {r.cand_id: (r.chosen, r.reason) for r in spanning.select_links(df, spark.createDataFrame(list(nodes.items()), "node long, component long")).collect()}
    assert got == greedy(rows, nodes)


def test_links_of_one_component_in_one_round(spark, monkeypatch):
    """A component that gets many links does not take a round for each."""
    rows = [(i, i, 1000 + i, 1000 + i, float(i % 7), "accept") for i in range(40)] + [(100 + i, i, 1000 + (i + 1) % 40, 1000 + (i + 1) % 40, -1.0, "accept") for i in range(40)]
    nodes = {1000 + i: 0 for i in range(40)}
    rounds, real = [], spanning.stash
    monkeypatch.setattr(spanning, "stash", lambda df, tag: rounds.append(tag) or real(df, tag))
    df = spark.createDataFrame(rows, "cand_id long, source long, target long, anchor long, confidence double, status string")
    got = {r.cand_id: (r.chosen, r.reason) for r in spanning.select_links(df, spark.createDataFrame(list(nodes.items()), "node long, component long")).collect()}
    assert got == greedy(rows, nodes)
    assert rounds.count("won") == 1


def test_parallel_edges_keep_the_best(spark):
    df = spark.createDataFrame([(0, 1, 2, 5.0), (1, 2, 1, 3.0), (2, 1, 2, 4.0), (3, None, 2, 1.0)], "edge_id long, src long, dst long, w double")
    assert [r.edge_id for r in spanning.spanning_forest(df, F.col("w")).collect()] == [1]
