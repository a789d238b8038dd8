"""Sums that do not depend on the order of rows, and ids that do not meet."""

from pyspark.sql import functions as F


def test_windows_over_the_same_rows_have_the_same_mean(spark):
    from arbora.operators import spans

    # means that lie halfway between two numbers of nine digits; every window of a key holds all its rows
    rows = [(k, phi, v) for k in range(200) for phi, v in ((10.0, 0.1 + k), (11.0, 0.2), (12.0, 0.3000000015))]
    df = spark.createDataFrame(rows, "k long, phi double, v double").repartition(16, "v", "k")
    got = spans.arc_windows(df, "k", "phi", "v", arc=60.0, step=5).collect()
    full = [r for r in got if r.arc_max is not None]
    assert len(full) == 200
    means = spark.createDataFrame([r for r in rows], "k long, phi double, v double").repartition(16, "v", "k")
    alone = {r.k: r.arc_max for r in spans.arc_windows(means, "k", "phi", "v", arc=360.0, step=5).collect()}
    again = {r.k: (r.arc_min, r.max_at, r.min_at) for r in spans.arc_windows(df, "k", "phi", "v", arc=360.0, step=5).collect()}
    assert all(again[k] == (alone[k], 0, 0) for k in alone)


def test_welded_suppliers_are_not_parts_of_the_same_number(spark, tmp_path):
    from arbora.plans import edits

    d = str(tmp_path)
    lines = [(1000003, 3), (1000003, 4), (2000001, 3), (5, 3), (2000007, 4)]
    spark.createDataFrame(lines, "l_partkey long, l_suppkey long").write.parquet(f"{d}/lineitem.parquet")
    spark.createDataFrame([(3, 7), (4, 7)], "s_suppkey long, s_nationkey int").write.parquet(f"{d}/supplier.parquet")
    got = sorted((r.src, r.dst, r.n_edges) for r in edits.weld_nodes(spark, d).collect())
    assert got == [(5, 2000007, 1), (1000003, 2000007, 2), (2000001, 2000007, 1), (2000007, 2000007, 1)]


def test_runs_of_equal_spans_are_one(spark):
    from arbora.operators import spans

    both = spark.createDataFrame([(k, 0, 0) for k in range(50)] * 2 + [(k, 2, 3) for k in range(50)], "e long, i0 long, i1 long")
    got = spans.merge_runs(both, "e").groupBy("i0", "i1", "n_spans").agg(F.count("*").alias("n")).collect()
    assert sorted(tuple(r) for r in got) == [(0, 0, 2, 50), (2, 3, 1, 50)]


def test_outlets_of_a_tree_without_volume(spark, tmp_path):
    from arbora.plans import morphometry

    d = str(tmp_path)
    lines = [(1, 1, 100.0, 1, 1, 5.0, 0.01, 0.02), (2, 1, 100.0, 1, 1, 5.0, 0.01, 0.02), (2, 2, 100.0, 1, 1, 9.0, 0.01, 0.02)]
    spark.createDataFrame(lines, "l_orderkey long, l_linenumber int, l_extendedprice double, l_partkey long, l_suppkey long, l_quantity double, l_discount double, l_tax double").write.parquet(f"{d}/lineitem.parquet")
    spark.createDataFrame([(1, 7, "O", "1-URGENT"), (2, 8, "F", "2-HIGH")], "o_orderkey long, o_custkey long, o_orderstatus string, o_orderpriority string").write.parquet(f"{d}/orders.parquet")
    got = morphometry.outlet_resistances(spark, d).collect()
    assert [(r.edge_id, r.tree, r.fraction, r.resistance) for r in got] == [(2, 8, 1.0, 60.0)]
