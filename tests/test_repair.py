"""Parents, resampling, tapers and claims against plain versions."""

import math

import numpy as np

from arbora.operators import reconnect, repair
from arbora.operators.topology import directed_topology

POINTS = "edge_id long, pos long, x double, y double, z double, r double"


def test_parents_of_a_graph_with_a_loop(spark):
    rows = [(0, 0, 1, 2, 5.0), (1, 1, 2, 1, 3.0), (2, 1, 3, 1, 2.0), (3, 2, 3, 1, 9.0), (4, 3, 4, 1, 1.0), (5, 4, 4, 1, 1.0), (10, 20, 21, 1, 1.0), (11, 21, 22, 1, 7.9), (12, 21, 23, None, None)]
    edges = spark.createDataFrame(rows, "edge_id long, src long, dst long, strahler long, radius double")
    got = {r.edge_id: (r.parent, r.root, r.level, r.n_children, r.n_siblings) for r in directed_topology(edges, edges.where("edge_id = 12")).collect()}
    assert got == {
        0: (None, 0, 0, 2, 0), 1: (0, 0, 1, 1, 1), 2: (0, 0, 1, 1, 1), 3: (1, 0, 2, 0, 0), 4: (2, 0, 2, 1, 0), 5: (4, 0, 3, 0, 0),
        12: (None, 12, 0, 2, 0), 10: (12, 12, 1, 0, 1), 11: (12, 12, 1, 0, 1),
    }


def test_densify_is_linear_interpolation(spark):
    rng = np.random.default_rng(3)
    at = np.cumsum(rng.uniform(0, 3, (6, 3)), axis=0)
    at[3] = at[2]  # a step of no length
    rows = [(1, i, *map(float, at[i]), float(i)) for i in range(6)] + [(2, 0, 0.0, 0.0, 0.0, 1.0), (3, 0, 1.0, 1.0, 1.0, 1.0), (3, 1, 1.0, 1.0, 1.0, 2.0)]
    got = repair.densify(spark.createDataFrame(rows, POINTS), 0.7, 4).orderBy("edge_id", "pos").collect()
    one = [r for r in got if r.edge_id == 1]
    s = np.concatenate([[0], np.cumsum(np.linalg.norm(np.diff(at, axis=0), axis=1))])
    n = math.ceil(s[-1] / 0.7) + 1
    want = np.linspace(0, s[-1], n)
    assert [r.pos for r in one] == list(range(n)) and one[0].raw_n == 6
    assert np.allclose([[r.x, r.y, r.z] for r in one], np.array([np.interp(want, s, at[:, k]) for k in range(3)]).T, atol=1e-7)
    # one point, or no length: as they are
    assert [(r.edge_id, r.pos, r.r) for r in got if r.edge_id > 1] == [(2, 0, 1.0), (3, 0, 1.0), (3, 1, 2.0)]


def test_taper_goes_on_through_a_collapse(spark):
    r = [10 * math.exp(-0.02 * i) for i in range(30)]
    broken = [0.5 if 12 <= i <= 16 or i >= 27 else v for i, v in enumerate(r)]
    rows = [(1, i, float(i), 0.0, 0.0, v, v != r[i]) for i, v in enumerate(broken)] + [(2, i, float(i), 0.0, 0.0, 1.0, None) for i in range(4)]
    points = spark.createDataFrame(rows, POINTS + ", bad boolean")
    spans = spark.createDataFrame([(1, 12, 16), (1, 27, 99), (2, 1, 2), (7, 0, 3), (1, 5, 4)], "edge_id long, i0 long, i1 long")
    filled, told = repair.taper_fill(points, spans, 5, 40, 1.0, exclude="bad")
    got = {(p.edge_id, p.pos): p for p in filled.collect()}
    assert all(abs(got[1, i].r - r[i]) < 1e-9 for i in (*range(12, 17), 27, 28, 29)) and abs(got[1, 11].r - r[11]) < 1e-12
    assert got[1, 28].told and got[2, 1].r == 1.0 and not got[2, 1].told
    assert sorted((t.edge_id, t.i0, t.i1, t.sides) for t in told.collect()) == [(1, 12, 16, "both"), (1, 27, 29, "proximal"), (2, 1, 2, None)]


def test_ends_are_claimed_widest_first(spark):
    rng = np.random.default_rng(5)
    width = {n: float(rng.integers(1, 6)) for n in range(30)}
    pairs = {(int(a), int(b)): float(rng.integers(0, 4)) for a, b in rng.integers(0, 30, (150, 2)) if a != b}
    rows = [(a, b, v, width[a], "accept" if (a + b) % 7 else "cone") for (a, b), v in pairs.items()]
    got = {(p.node, p.to_node) for p in reconnect.claimed_ends(spark.createDataFrame(rows, "node long, to_node long, score double, r double, verdict string")).collect()}
    used, want = set(), set()
    for a in sorted(width, key=lambda n: (-width[n], n)):
        open_ = [(-v, b) for (s, b), v in pairs.items() if s == a and (a + b) % 7 and b not in used]
        if a not in used and open_:
            b = min(open_)[1]
            used |= {a, b}
            want.add((a, b))
    assert got == want and want


def test_links_of_two_broken_vessels(spark):
    """Two halves of a straight vessel, and a branch that ends short of its trunk."""
    line = lambda e, a, b, n, r: [(e, i, *(p + (q - p) * i / (n - 1) for p, q in zip(a, b)), r) for i in range(n)]
    rows = line(1, (0.0, 0.0, 0.0), (10.0, 0.0, 0.0), 11, 1.0) + line(2, (13.0, 0.0, 0.0), (23.0, 0.0, 0.0), 11, 1.0) + line(3, (5.0, 9.0, 0.0), (5.0, 2.0, 0.0), 8, 0.8)
    edges = spark.createDataFrame([(1, 10, 11), (2, 20, 21), (3, 30, 31)], "edge_id long, src long, dst long")
    points = spark.createDataFrame(rows, POINTS)
    tips = reconnect.free_ends(edges, points)
    at = {t.node: t for t in tips.collect()}
    assert sorted(at) == [10, 11, 20, 21, 30, 31] and (at[11].dx, at[31].dy, at[31].r) == (1.0, -1.0, 0.8)
    joined = reconnect.claimed_ends(reconnect.end_candidates(tips, 5.0))
    assert [(j.node, j.to_node, j.d, round(j.tortuosity, 6)) for j in joined.collect()] == [(11, 20, 3.0, 1.0)]
    (side,) = reconnect.best_sides(reconnect.side_candidates(edges, points, tips, 5.0)).collect()
    assert (side.node, side.to_edge, side.to_pos, side.d) == (31, 1, 5, 2.0)
    curve = reconnect.bridges(joined).orderBy("pos").collect()
    assert [(c.edge_id, c.pos) for c in curve] == [(11, i) for i in range(4)] and (curve[0].x, curve[-1].x, curve[1].r) == (10.0, 13.0, 1.0)
    assert reconnect.claimed_ends(reconnect.end_candidates(tips.limit(0))).count() == 0
