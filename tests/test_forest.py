"""Orders, levels and components on hand-computed trees and graphs."""

import random
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from arbora import registry
from arbora.operators import forest as T
from arbora.session import stash

BALANCED = [(0, None), (1, 0), (2, 0), (3, 1), (4, 1), (5, 2), (6, 2)]
TWO_OF_THREE = [(0, None), (1, 0), (2, 1), (3, 1), (4, 1), (5, 2), (6, 2), (7, 3), (8, 3)]


def tree(spark, rows):
    return spark.createDataFrame(rows, "node long, parent long")


def orders(spark, rows):
    return {r.node: r.strahler for r in T.strahler(tree(spark, rows)).collect()}


def test_strahler(spark):
    assert orders(spark, BALANCED) == {0: 3, 1: 2, 2: 2, 3: 1, 4: 1, 5: 1, 6: 1}
    assert orders(spark, [(0, None), (1, 0), (2, 0), (3, 0)]) == {0: 2, 1: 1, 2: 1, 3: 1}
    assert orders(spark, TWO_OF_THREE)[1] == 3
    assert orders(spark, [*BALANCED, (10, None), (11, 10), (12, 10), (20, 21), (21, 20)]) == orders(spark, BALANCED) | {10: 2, 11: 1, 12: 1}
    assert orders(spark, []) == {}


def test_levels_of_a_forest(spark):
    got = {r.node: (r.depth, r.root) for r in T.levels(tree(spark, [*BALANCED, (10, None), (11, 10)])).collect()}
    assert got[6] == (2, 0) and got[11] == (1, 10) and got[0] == (0, 0)


def test_flow_sums_to_one_over_leaves(spark):
    df = spark.createDataFrame([(0, None, 5.0), (1, 0, 0.0), (2, 0, 0.0), (3, 1, 1.0), (4, 1, 2.0)], "node long, parent long, radius double")
    flow = {r.node: r.flow for r in T.flow_split(df).collect()}
    assert flow[1] == flow[2] == 0.5 and abs(flow[3] + flow[4] - 0.5) < 1e-12 and abs(flow[4] / flow[3] - 2**2.27) < 1e-9


def test_chains_contract_whatever_their_length(spark):
    rows = [(0, None, 1.0)] + [(i, i - 1, 1.0) for i in range(1, 40)] + [(40, 39, 1.0), (41, 39, 1.0)]
    got = {r.node: (r.parent, r.n_merged, r.length) for r in T.contract_chains(spark.createDataFrame(rows, "node long, parent long, len double"), "len").collect()}
    assert got == {0: (None, 0, 1.0), 39: (0, 38, 39.0), 40: (39, 0, 1.0), 41: (39, 0, 1.0)}


def test_components_of_a_long_path(spark):
    edges = [(i, i + 1) for i in range(64)] + [(100, 100), (201, 200)]
    got = {r.node: r.component for r in T.components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got == {**{i: 0 for i in range(65)}, 100: 100, 200: 200, 201: 200}
    assert {r.node: r.degree for r in T.degrees(spark.createDataFrame(edges, "src long, dst long")).collect()}[100] == 2


def test_pruning_goes_on_until_nothing_is_left_to_drop(spark):
    got = T.prune_terminals(tree(spark, TWO_OF_THREE), "node in (5, 6, 2)")
    assert sorted(r.node for r in got.collect()) == [0, 1, 3, 4, 7, 8]
    assert sorted(r.node for r in T.walk_until(tree(spark, TWO_OF_THREE), "node = 2").where("not rejected").collect()) == [0, 1, 3, 4, 7, 8]


def union_find(edges):
    """(node, smallest node of its component)."""
    up = {}

    def top(x):
        while up.setdefault(x, x) != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in edges:
        a, b = top(a), top(b)
        up[max(a, b)] = min(a, b)
    return {x: top(x) for x in up}


def check_whole_graph(spark, d):
    edges = duckdb.execute(f"select distinct l_partkey * 2, l_suppkey * 2 + 1 from '{d}/lineitem.parquet'").fetchall()
    want = union_find(edges)
    run = lambda name: registry.QUERIES[name](spark, d).collect()
    got = run("whole_graph_components")
    assert len(got) == len(want) and {r.node: r.component for r in got} == want
    n = Counter(want.values())
    assert {r.component: (r.n_nodes, r.share) for r in run("whole_component_sizes")} == {c: (k, round(k / max(n.values()), 6)) for c, k in n.items()}
    assert [tuple(r.asDict()[c] for c in ("n_edges", "n_nodes", "n_components", "cycles")) for r in run("whole_cycle_count")] == [(len(edges), len(want), len(n), len(edges) - len(want) + len(n))]
    assert {r.node: r.degree for r in run("whole_node_degrees")} == Counter(x for e in edges for x in e)
    return n


def test_whole_graph_has_the_edges_of_every_line(spark):
    n = check_whole_graph(spark, "/root/testdata/sf0.01")
    assert max(n.values()) > 2000


def test_whole_graph_of_several_components(spark, tmp_path):
    rows = [(i // 2, (i + 1) // 2) for i in range(40)] + [(100, 100), (101, 100), (101, 101), (100, 101), (200, 300)]
    lines = [(a, b, "OF"[i % 2], "NAR"[i % 3], float(i % 50)) for i, (a, b) in enumerate(rows)]
    spark.createDataFrame(lines, "l_partkey long, l_suppkey long, l_linestatus string, l_returnflag string, l_quantity double").coalesce(1).write.parquet(str(tmp_path / "written"))
    next((tmp_path / "written").glob("*.parquet")).rename(tmp_path / "lineitem.parquet")
    assert sorted(check_whole_graph(spark, str(tmp_path)).values()) == [2, 4, 41]


def test_a_long_chain_is_directed_and_folded_in_few_rounds(spark):
    import time

    from arbora.operators import rooting

    n = 100_000
    chain = spark.range(n - 1).select(F.col("id").alias("edge_id"), F.when(F.col("id") % 2 == 0, F.col("id")).otherwise(F.col("id") + 1).alias("src"), F.when(F.col("id") % 2 == 0, F.col("id") + 1).otherwise(F.col("id")).alias("dst"))
    began = time.time()
    tree = rooting.directed(chain, spark.createDataFrame([(n - 1,)], "node long"))
    assert tree.where("parent = node + 1").count() == n - 1 and tree.where("parent is null").collect()[0].node == n - 1
    found = T.levels(tree)
    assert found.where(f"depth = {n - 1} - node").count() == n and time.time() - began < 120


def test_directed_refuses_cycles_and_leaves_out_what_no_root_reaches(spark):
    from arbora.operators import rooting

    edges = spark.createDataFrame([(0, 1, 2, 5.0), (1, 2, 3, None), (2, 7, 8, 1.0), (3, 4, 4, 1.0), (4, None, 1, 1.0)], "edge_id long, src long, dst long, radius double")
    root = spark.createDataFrame([(3,)], "node long")
    got = {r.edge_id: (r.src, r.dst, r.flipped, r.child, r.strahler) for r in rooting.oriented(edges, root).collect()}
    assert got == {0: (1, 2, False, 0, 1), 1: (2, 3, False, 0, 1), 2: (7, 8, False, -1, 0), 3: (4, 4, False, -1, 0), 4: (None, 1, False, -1, 0)}
    for bad in ([(0, 1, 2), (1, 2, 3), (2, 3, 1)], [(0, 1, 2), (1, 2, 3), (2, 3, 4), (3, 4, 2)]):
        with pytest.raises(ValueError):
            rooting.directed(spark.createDataFrame(bad, "edge_id long, src long, dst long"), spark.createDataFrame([(1,)], "node long"))
    with pytest.raises(ValueError):
        rooting.directed(edges, spark.createDataFrame([(3,), (1,)], "node long"))
    assert rooting.directed(edges.limit(0), root).count() == 1


def test_parents_in_a_circle(spark):
    tree = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (4, None), (5, 4), (6, 99)], "node long, parent long")
    assert {r.node: r.depth for r in T.levels(tree).collect()} == {4: 0, 5: 1}
    with pytest.raises(ValueError):
        T.closure(tree)


def test_nearest_finds_what_is_very_far_away(spark):
    from arbora.operators import proximity

    q = spark.createDataFrame([(1, 0.0, 0.0, 0.0), (2, 5000.0, 0.0, 0.0), (3, None, 0.0, 0.0), (4, float("nan"), 0.0, 0.0)], "q_id long, x double, y double, z double")
    b = spark.createDataFrame([(7, 0.01, 0.0, 0.0), (8, -400.0, 0.0, 0.0)], "b_id long, x double, y double, z double")
    assert sorted((r.q_id, r.b_id) for r in proximity.nearest_widening(q, b, 0.05).collect()) == [(1, 7), (2, 7)]
    assert proximity.nearest_widening(q, b.limit(0), 0.05).count() == 0 and proximity.nearest_widening(q.limit(0), b.limit(0), 0.05).count() == 0


def test_mask_labels_of_negative_and_large_places(spark):
    from arbora.operators import voxels

    runs = spark.createDataFrame([(0, 0, -1, 0), (0, -1, 10**6 - 1, 10**6), (0, 5, 10**6, 10**6 + 2), (0, 6, 0, 1)], "z long, y long, x0 long, x1 long")
    assert voxels.label(runs).select("label").distinct().count() == 4


def test_round_cones_against_sampled_balls(spark):
    import math
    import random

    from arbora.functions import geometry

    rng = random.Random(1)
    rows = [[rng.uniform(-3, 3) for _ in range(9)] + [rng.uniform(0.1, 2), rng.uniform(0.1, 2)] for _ in range(60)]
    names = [*(f"{p}{c}" for p in "pab" for c in "xyz"), "ra", "rb"]
    at = lambda p: tuple(F.col(f"{p}{c}") for c in "xyz")
    got = spark.createDataFrame([tuple(r) for r in rows], ", ".join(f"{n} double" for n in names)).select(*names, geometry.round_cone(at("p"), at("a"), at("b"), F.col("ra"), F.col("rb")).alias("d")).collect()
    for r in got:
        p, a, b = ([r[f"{k}{c}"] for c in "xyz"] for k in "pab")
        want = min(math.dist(p, [u + t / 4000 * (v - u) for u, v in zip(a, b)]) - (r.ra + t / 4000 * (r.rb - r.ra)) for t in range(4001))
        assert abs(r.d - want) < 1e-3


def test_nearest_of_crowds_against_all_pairs(spark):
    import random

    from arbora.operators import proximity

    random.seed(4)
    # one crowd far smaller than the gate, copies in one place, some points apart and on both sides of 0
    spot = lambda k: [round(random.gauss(0, 1e-3 if k % 3 else 2.0), 6) for _ in range(3)]
    b = [(k, *spot(k)) for k in range(600)]
    b += [(k + 1000, *b[k][1:]) for k in range(200)] + [(k + 2000, 0.5, 0.5, 0.5) for k in range(1500)]
    q = [(k, *spot(k)) for k in range(300)] + [(k + 500, 0.5, 0.5, 0.5) for k in range(50)] + [(900, 40.0, -40.0, 0.0)]
    far = lambda p, r: round(sum((x - y) ** 2 for x, y in zip(p[1:], r[1:])) ** 0.5, 9)
    want = {p[0]: min((far(p, r), r[0]) for r in b) for p in q}
    qs, bs = spark.createDataFrame(q, "q_id long, x double, y double, z double"), spark.createDataFrame(b, "b_id long, x double, y double, z double")
    got = {r.q_id: (round(r.d, 9), r.b_id) for r in proximity.nearest_widening(qs, bs, 1.0).collect()}
    assert got == want
    gated = {r.q_id: (round(r.d, 9), r.b_id) for r in proximity.nearest(qs, bs, 0.3).collect()}
    assert gated == {k: v for k, v in want.items() if v[0] <= 0.3}


def test_crowded_cells_are_split(spark):
    from pyspark.sql import functions as F

    from arbora.operators import proximity

    places = spark.range(20000).select(*((F.rand(i) / 100).alias(c) for i, c in enumerate("xyz")))
    cell = lambda c, size: F.floor(F.col(c) / size).alias(f"k{c}")
    size = proximity._uncrowded(places, 1.0, 2.0, cell)
    assert places.groupBy(*(cell(c, size) for c in "xyz")).count().agg(F.max("count")).first()[0] < 200

def test_components_of_random_graphs_and_loops(spark):
    pick = random.Random(5)
    edges = [(pick.randrange(900), pick.randrange(900)) for _ in range(600)] + [(2000, 2000)] + [(3000 + i, 9000) for i in range(20)]
    left = {}

    def top(n):
        while left.setdefault(n, n) != n:
            n = left[n]
        return n

    for a, b in edges:
        a, b = sorted((top(a), top(b)))
        left[b] = a
    got = {r.node: r.component for r in T.components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got == {n: top(n) for n in left}


def test_edges_shrink_from_round_to_round_of_components(spark, monkeypatch):
    # every round read all edges again
    sizes = []
    monkeypatch.setattr(T, "stash", lambda df, tag: (kept := stash(df, tag), tag == "live" and sizes.append(kept.count()))[0])
    T.components(spark.createDataFrame([(i, i + 1) for i in range(200)] + [(i, 400 + i) for i in range(200)], "src long, dst long"))
    assert sizes[0] == 400 and sizes[-1] == 0 and len(sizes) == 2
