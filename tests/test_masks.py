"""Topology, closing and distances of masks against voxel-by-voxel counts."""

from itertools import product

import numpy as np
import pytest

from arbora.operators import masks

CUBE = list(product((-1, 0, 1), repeat=3))
FACES = [d for d in CUBE if sum(map(abs, d)) == 1]


def solid(kind):
    g = np.indices((12, 13, 14))
    z, y, x = g
    if kind == "ball with a cavity":
        r = (z - 5) ** 2 + (y - 6) ** 2 + (x - 6) ** 2
        return (r <= 20) & (r > 3)
    if kind == "torus":
        return ((np.sqrt((y - 6.0) ** 2 + (x - 6.0) ** 2) - 4) ** 2 + (z - 5.0) ** 2) <= 2.5
    if kind == "two corners":
        m = np.zeros((12, 13, 14), bool)
        m[2, 2, 2] = m[3, 3, 3] = m[9, 9, 9] = True
        return m
    return np.random.default_rng(int(kind)).random((12, 13, 14)) < (0.55 if int(kind) % 2 else 0.8)


KINDS = ["ball with a cavity", "torus", "two corners", "1", "2"]


def filled(cells, steps):
    """Components of a set of cells."""
    left, n = set(cells), 0
    while left:
        n += 1
        todo = [left.pop()]
        while todo:
            c = todo.pop()
            for d in steps:
                o = (c[0] + d[0], c[1] + d[1], c[2] + d[2])
                if o in left:
                    left.remove(o)
                    todo.append(o)
    return n


def topology(m):
    cells = [tuple(map(int, c)) for c in np.argwhere(m)]
    faces = set()
    for c in cells:  # doubled coordinates: the parity says what a face of the cube is
        faces |= {(2 * c[0] + d[0], 2 * c[1] + d[1], 2 * c[2] + d[2]) for d in CUBE}
    chi = sum((-1) ** sum(v % 2 == 0 for v in f) for f in faces)
    back = [tuple(map(int, c)) for c in np.argwhere(np.pad(~m, 1, constant_values=True))]
    b0, b2 = filled(cells, CUBE), filled(back, FACES) - 1
    return b0, b0 + b2 - chi, b2, chi


def run_rows(kinds):
    out = []
    for k, kind in enumerate(kinds):
        m = solid(kind)
        for z, y in product(*map(range, m.shape[:2])):
            edge = np.flatnonzero(np.diff(np.pad(m[z, y].astype(int), 1)))
            out += [(k, z - 3, y - 2, int(a) - 5, int(b) - 5) for a, b in zip(edge[::2], edge[1::2])]
    return out


@pytest.fixture(scope="module")
def runs(spark):
    return spark.createDataFrame(run_rows(KINDS), "m int, z long, y long, x0 long, x1 long").repartition(3).cache()


def voxels(df):
    out = {}
    for r in df.collect():
        for x in range(r.x0, r.x1):
            key = (r.z + 3, r.y + 2, x + 5)
            assert key not in out.setdefault(r.m, set())
            out[r.m].add(key)
    return out


def test_topology(spark, runs):
    got = {r.m: (r.b0, r.b1, r.b2, r.euler) for r in masks.betti(runs, ["m"]).collect()}
    assert got == {k: topology(solid(kind)) for k, kind in enumerate(KINDS)}
    assert got[0] == (1, 0, 1, 2) and got[1] == (1, 1, 0, 0) and got[2] == (2, 0, 0, 2)
    one = masks.betti(runs.where("m = 0").drop("m")).collect()
    assert [(r.b0, r.b1, r.b2, r.euler) for r in one] == [(1, 0, 1, 2)]
    sizes = masks.cavities(runs.where("m = 0"), ["m"]).collect()
    assert [r.n_voxels for r in sizes] == [int(((lambda z, y, x: (z - 5) ** 2 + (y - 6) ** 2 + (x - 6) ** 2)(*np.indices((12, 13, 14))) <= 3).sum())]


def test_split_runs_change_nothing(spark, runs):
    cut = runs.selectExpr("m", "z", "y", "x0", "x1 - 1 as x1").where("x0 < x1").unionByName(runs.selectExpr("m", "z", "y", "x1 - 1 as x0", "x1"))
    assert sorted(map(tuple, masks.betti(cut, ["m"]).collect())) == sorted(map(tuple, masks.betti(runs, ["m"]).collect()))


@pytest.mark.parametrize("radius", [1, 2, 3])
def test_closing(runs, radius):
    added = voxels(masks.closing_additions(runs, radius, runs.where("m = 0 and y = 2"), ["m"]))
    ball = [d for d in product(range(-radius, radius + 1), repeat=3) if d[0] ** 2 + d[1] ** 2 + d[2] ** 2 <= radius**2]
    for k, kind in enumerate(KINDS):
        own = {tuple(map(int, c)) for c in np.argwhere(solid(kind))}
        grown = {(c[0] + d[0], c[1] + d[1], c[2] + d[2]) for c in own for d in ball}
        shut = {c for c in grown if all((c[0] + d[0], c[1] + d[1], c[2] + d[2]) in grown for d in ball)}
        assert added.get(k, set()) == shut - own


@pytest.mark.parametrize("spacing", [(1.0, 1.0, 1.0), (0.5, 2.0, 1.25)])
def test_distances(runs, spacing):
    got = {(r.m, r.vz + 3, r.vy + 2, r.vx + 5): r.d2 for r in masks.squared_distances(runs, spacing, ["m"]).collect()}
    size = np.array(spacing[::-1])
    for k, kind in enumerate(KINDS):
        m = np.pad(solid(kind), 1)
        outside = np.argwhere(~m) * size
        for c in np.argwhere(m):
            want = ((outside - c * size) ** 2).sum(1).min()
            assert got.pop((k, *(int(v) - 1 for v in c))) == pytest.approx(want, rel=1e-12)
    assert not got


def test_radii_at(spark, runs):
    at = spark.createDataFrame([(0, 6 - 5, 6 - 2, 5 - 3, "in the cavity"), (1, 6 - 5, 10 - 2, 5 - 3, "in the tube"), (9, 0, 0, 0, "no mask")], "m int, vx long, vy long, vz long, d2 string")
    got = {r.d2: r.radius for r in masks.radii_at(at.withColumnRenamed("d2", "what"), runs, (1.0, 1.0, 1.0), ["m"]).withColumnRenamed("what", "d2").collect()}
    assert got["in the cavity"] == got["no mask"] == 0 and got["in the tube"] > 1


def test_empty(runs):
    none = runs.limit(0)
    assert masks.betti(none, ["m"]).count() == masks.closing_additions(none, 2, None, ["m"]).count() == masks.squared_distances(none, keys=["m"]).count() == 0


def test_voxels_of_runs_are_not_broadcast(spark):
    from arbora.operators import masks
    from arbora.session import stash

    runs = stash(spark.range(50).selectExpr("id as tree", "0L as z", "0L as y", "0L as x0", "400L as x1"), "runs")
    places = spark.range(50).selectExpr("id as tree", "id as vx", "0L as vy", "0L as vz")
    plan = masks.radii_at(places, runs, (1.0, 1.0, 1.0), ["tree"])._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastExchange" not in plan


def test_masks_wider_than_a_block(spark):
    """What crosses the borders of blocks in z, y and x is as in one piece: each mask moved by half a block and stretched along x."""
    rows = [(m, z + 16, y + 16, 40 * a + 100, 40 * b + 100) for m, z, y, a, b in run_rows(KINDS)]
    wide = spark.createDataFrame(rows, "m int, z long, y long, x0 long, x1 long")
    assert {r.m: r.euler for r in masks.euler(wide, ["m"]).collect()} == {k: topology(solid(kind))[3] for k, kind in enumerate(KINDS)}
    got = {r.m: (r.b0, r.b1, r.b2) for r in masks.betti(wide, ["m"]).collect()}
    assert got == {k: topology(solid(kind))[:3] for k, kind in enumerate(KINDS)}
    cells = {}
    for m, z, y, a, b in rows:
        cells.setdefault(m, set()).update((z, y, x) for x in range(a, b))
    ball = [d for d in product((-1, 0, 1), repeat=3) if sum(map(abs, d)) < 2]
    grown = {m: {(c[0] + d[0], c[1] + d[1], c[2] + d[2]) for c in own for d in ball} for m, own in cells.items()}
    inside = lambda own: {c for c in own if all((c[0] + d[0], c[1] + d[1], c[2] + d[2]) in own for d in ball)}
    for df, want in ((masks.dilated(wide, 1, ["m"]), grown), (masks.eroded(wide, 1, ["m"]), {m: inside(c) for m, c in cells.items()}), (masks.closing_additions(wide, 1, None, ["m"]), {m: inside(c) - cells[m] for m, c in grown.items()})):
        found, n = {}, 0
        for r in df.collect():
            found.setdefault(r.m, set()).update((r.z, r.y, x) for x in range(r.x0, r.x1))
            n += r.x1 - r.x0
        assert found == {m: c for m, c in want.items() if c} and n == sum(map(len, found.values()))


def test_closing_sends_a_run_about_once(spark):
    """Not once for every row of the ball, neither there nor for Euler numbers."""
    wide = spark.createDataFrame([(m, 0, 0, 0, 5) for m in range(50)], "m int, z long, y long, x0 long, x1 long")
    for df in (masks.closing_additions(wide, 3, None, ["m"]), masks.euler(wide, ["m"])):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert "dz" not in plan
