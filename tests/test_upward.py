"""Folds up a tree against a plain walk, on deep and ragged trees."""

import random

from arbora.operators import upward as U


def plain(parents, own, outlet):
    kids, order = {}, []
    for n, p in parents.items():
        kids.setdefault(p, []).append(n)
    stack = list(kids[None])
    while stack:
        n = stack.pop()
        order.append(n)
        stack += kids.get(n, [])
    orders, total = {}, {}
    for n in reversed(order):
        below = kids.get(n, [])
        o = sorted((orders[c] for c in below), reverse=True)
        orders[n] = 1 if not o else o[0] + (o[1:2] == o[:1])
        total[n] = own[n] + (1 / sum(1 / total[c] for c in below) if below else outlet)
    return orders, total


def test_folds_of_a_deep_tree(spark):
    rng = random.Random(1)
    parents = {0: None} | {i: max(0, i - rng.choice([1, 1, 1, 2, 5])) for i in range(1, 300)}
    own = {n: rng.random() + 0.1 for n in parents}
    rows = [(n, p, own[n], 2.0) for n, p in parents.items()] + [(900, 901, 1.0, 1.0), (901, 900, 1.0, 1.0)]  # a cycle that no root reaches
    df = spark.createDataFrame(rows, "node long, parent long, len double, out double")
    orders, total = plain(parents, own, 2.0)
    assert {r.node: r.strahler for r in U.strahler(df).collect()} == orders
    got = {r.node: r.total for r in U.input_resistance(df, "len", "out").collect()}
    assert got.keys() == total.keys() and all(abs(got[n] - total[n]) < 1e-9 for n in total)


def test_folds_of_an_empty_tree(spark):
    assert U.strahler(spark.createDataFrame([], "node long, parent long")).collect() == []
