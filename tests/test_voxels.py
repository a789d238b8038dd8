"""Masks of several keys are labelled apart, over all points."""

import random
from collections import defaultdict

import duckdb

from arbora import registry
from arbora.operators import voxels as V

D = "/root/testdata/sf0.01"


def test_masks_with_keys_do_not_touch(spark):
    cells = [("a", 0, 0, 0), ("a", 1, 0, 0), ("a", 2, 1, 1), ("b", 3, 1, 1), ("b", 0, 0, 0), ("b", 9, 9, 9)]
    runs = V.encode(spark.createDataFrame(cells, "mask string, vx long, vy long, vz long"), keys=["mask"])
    labelled = V.label(runs, ["mask"])
    got = sorted((r.mask, r.n_voxels, r.n_runs) for r in V.sizes(labelled, ["mask"]).collect())
    assert got == [("a", 3, 2), ("b", 1, 1), ("b", 1, 1), ("b", 1, 1)]
    assert {r.mask for r in V.cull_small(labelled, 2, ["mask"]).collect()} == {"a"}
    assert sorted(map(tuple, V.decode(runs, ["mask"]).collect())) == sorted(cells)


def test_every_point_counts(spark):
    want = duckdb.execute(f"select count(*) from (select distinct o_custkey, floor(l_quantity), floor(100 * l_discount), floor(100 * l_tax) from '{D}/lineitem.parquet' join '{D}/orders.parquet' on l_orderkey = o_orderkey)").fetchone()[0]
    assert registry.QUERIES["tree_mask_component_sizes"](spark, D).selectExpr("sum(n_voxels)").first()[0] == want


def _flood(cells):
    """Components of cells that share a corner."""
    left, found = set(cells), []
    while left:
        todo, part = [left.pop()], set()
        while todo:
            x, y, z = todo.pop()
            part.add((x, y, z))
            near = {(x + i, y + j, z + k) for i in (-1, 0, 1) for j in (-1, 0, 1) for k in (-1, 0, 1)} & left
            left -= near
            todo += near
        found.append(part)
    return found


def test_components_go_on_over_the_borders_of_blocks(spark):
    pick = random.Random(3)
    cells = [(m, *(pick.choice((16, 112, 128, -16)) + pick.randrange(-4, 5) for _ in "xyz")) for m in (1, 2) for _ in range(4000)]
    cells += [(3, x, 7, 7) for x in range(-700, 700)] + [(3, -700, 8, 9)]
    labelled = V.label(V.encode(spark.createDataFrame(cells, "mask long, vx long, vy long, vz long"), keys=["mask"]), ["mask"])
    got = defaultdict(set)
    for r in labelled.collect():
        got[r.mask, r.label] |= {(r.mask, x, r.y, r.z) for x in range(r.x0, r.x1)}
    want = [{(m, *c) for c in part} for m in (1, 2, 3) for part in _flood({c[1:] for c in cells if c[0] == m})]
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want))


def test_masks_within_a_block_take_no_rounds(spark, monkeypatch):
    # each round over links of runs wrote tables of its own, for every mask of the table
    monkeypatch.setattr(V, "components", None)
    runs = V.encode(spark.createDataFrame([(m, x, y, 0) for m in range(50) for x, y in ((0, 0), (1, 1), (5, 5))], "mask long, vx long, vy long, vz long"), keys=["mask"])
    assert V.sizes(V.label(runs, ["mask"]), ["mask"]).groupBy("n_voxels").count().orderBy("n_voxels").collect() == [(1, 50), (2, 50)]
