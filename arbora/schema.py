"""The canonical tables of a network, built from the star-schema tables the queries are checked on.

points(edge_id, pos, x, y, z, r): one polyline per order, its lines as points in order.
edges(edge_id, ord, state, tree): an order's priority, status and customer.
tree(node, parent, radius): the binary heap over the parts; node 0 is the root.
cloud(pt_id, x, y, z, value): the first three components of the embeddings.
series(edge_id, pos, s, value): a user's events in order of time.

On the SQL side the same tables are common table expressions; sql() puts those that a query names in front of it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from arbora.session import table

CTES = {
    "points": """SELECT l_orderkey AS edge_id,
    row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_extendedprice, l_partkey, l_suppkey) - 1 AS pos,
    l_quantity AS x, 100 * l_discount AS y, 100 * l_tax AS z, sqrt(l_extendedprice) / 5 AS r FROM lineitem""",
    "edges": "SELECT o_orderkey AS edge_id, CAST(substr(o_orderpriority, 1, 1) AS BIGINT) AS ord, o_orderstatus AS state, o_custkey AS tree FROM orders",
    "tree": "SELECT p_partkey AS node, CASE WHEN p_partkey = 0 THEN NULL ELSE (p_partkey - 1) // 2 END AS parent, p_retailprice / 100 AS radius FROM part",
    "cloud": "SELECT vec_id AS pt_id, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y, CAST(embedding[3] AS DOUBLE) AS z, CAST(embedding[4] AS DOUBLE) AS value FROM embeddings",
    "series": """SELECT user_id AS edge_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS pos,
    epoch_us(ts) / 1000000.0 AS s, CASE WHEN event_id % 17 = 0 THEN NULL ELSE value END AS value FROM events""",
}


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_extendedprice", "l_partkey", "l_suppkey")
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("edge_id"),
        (F.row_number().over(order) - 1).cast("long").alias("pos"),
        F.col("l_quantity").alias("x"),
        (100 * F.col("l_discount")).alias("y"),
        (100 * F.col("l_tax")).alias("z"),
        (F.sqrt("l_extendedprice") / 5).alias("r"),
    )


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("edge_id"), F.substring("o_orderpriority", 1, 1).cast("long").alias("ord"), F.col("o_orderstatus").alias("state"), F.col("o_custkey").alias("tree"))


def tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("node"), F.when(F.col("p_partkey") > 0, F.expr("(p_partkey - 1) div 2")).alias("parent"), (F.col("p_retailprice") / 100).alias("radius"))


def cloud(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = lambda i: F.get("embedding", F.lit(i)).cast("double")
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("pt_id"), part(0).alias("x"), part(1).alias("y"), part(2).alias("z"), part(3).alias("value"))


def series(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("edge_id"),
        (F.row_number().over(order) - 1).cast("long").alias("pos"),
        (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("s"),
        F.when(F.col("event_id") % 17 != 0, F.col("value")).alias("value"),
    )


def sql(body: str, *names: str, more: str = "", recursive: bool = False) -> str:
    """A query with the named canonical tables, and further common table expressions, in front of it."""
    parts = [f"{n} AS ({CTES[n]})" for n in names] + ([more] if more else [])
    return ("WITH RECURSIVE " if recursive else "WITH ") + ",\n".join(parts) + "\n" + body
