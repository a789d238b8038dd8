"""Parents, levels and siblings of segments, found breadth first from the trunk of every component.

A component's root is a preferred segment, else that of the highest order, then one with a free end, then the thickest (radii count whole), then the smallest id.
Segments that share a node are neighbours. A segment's level is its distance to the root over neighbours; its parent is the smallest neighbour one level
above it. Neighbours meet at nodes, never pair by pair: a node knows the smallest segment by which it is reached, so a node where very many segments meet costs a row
for each of them. Graphs may have loops, parallel edges and edges from a node to itself; edges with a null id or end are left out, a missing order is 0.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arbora.operators.breadth import distances
from arbora.operators.chains import ends
from arbora.operators.forest import components
from arbora.session import stash


def trunks(edges: DataFrame, preferred: DataFrame | None = None, order: str = "strahler", radius: str = "radius") -> DataFrame:
    """(component, edge_id, src, dst) of every component's root segment. preferred: a table with edge_id."""
    at = ends(edges).select("edge_id", "node").distinct()
    lone = at.groupBy("node").agg(F.min("edge_id").alias("edge_id"), F.count("*").alias("n")).where("n = 1").select("edge_id").distinct().withColumn("free", F.lit(True))
    liked = (preferred.select("edge_id").distinct() if preferred is not None else edges.select("edge_id").limit(0)).withColumn("liked", F.lit(True))
    clean = edges.where("edge_id is not null and src is not null and dst is not null").select("edge_id", "src", "dst", F.col(order).alias("order_"), F.col(radius).alias("radius_"))
    rows = clean.join(components(clean).select(F.col("node").alias("src"), "component"), "src").join(lone, "edge_id", "left").join(liked, "edge_id", "left")
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    rank = F.struct(yes("liked"), F.coalesce("order_", F.lit(0)), yes("free"), F.coalesce(F.nanvl(F.col("radius_").cast("double"), F.lit(None)).cast("long"), F.lit(0)), F.negative("edge_id"))
    return rows.groupBy("component").agg(F.max_by(F.struct("edge_id", "src", "dst"), rank).alias("t")).select("component", "t.*")


def directed_topology(edges: DataFrame, preferred: DataFrame | None = None, order: str = "strahler", radius: str = "radius") -> DataFrame:
    """(edge_id, parent, root, level, n_children, n_siblings) of every segment; roots have no parent and no siblings."""
    edges = edges.where("edge_id is not null and src is not null and dst is not null")
    top = stash(trunks(edges, preferred, order, radius), "trunks")
    sources = top.select(F.explode(F.array("src", "dst")).alias("node")).distinct()
    far = stash(distances(edges.select("edge_id", "src", "dst"), sources).select("node", "dist"), "far")
    comp = components(edges).select(F.col("node").alias("src"), "component")
    side = lambda c: far.select(F.col("node").alias(c), F.col("dist").alias(f"{c}_dist"))
    rows = edges.select("edge_id", "src", "dst").join(side("src"), "src").join(side("dst"), "dst").join(comp, "src").join(top.select("component", F.col("edge_id").alias("root")), "component")
    rows = stash(rows, "placed")
    one = lambda a, b: F.struct(F.col(b).alias("node"), F.col(f"{b}_dist").alias("far"), F.col(f"{a}_dist").alias("near"))
    ways = rows.select("edge_id", F.explode(F.array(one("src", "dst"), one("dst", "src"))).alias("w")).where("w.far = w.near + 1")
    found = stash(ways.groupBy("w.node").agg(F.min("edge_id").alias("by")), "found")
    low = F.least("src_dist", "dst_dist")
    by = lambda c: found.select(F.col("node").alias(c), F.col("by").alias(f"{c}_by"))
    known = rows.withColumn("low", low).join(by("src"), "src", "left").join(by("dst"), "dst", "left")
    through = F.least(*(F.when(F.col(f"{c}_dist") == F.col("low"), F.col(f"{c}_by")) for c in ("src", "dst")))  # least skips nulls
    is_root = F.col("edge_id") == F.col("root")
    parent = F.when(~is_root, F.when(F.col("low") == 0, F.col("root")).otherwise(through))
    told = stash(known.select("edge_id", parent.alias("parent"), "root", F.when(is_root, 0).otherwise(F.col("low") + 1).cast("long").alias("level")), "parents")
    kids = told.where("parent is not null").groupBy("parent").agg(F.count("*").alias("n"))
    out = told.join(kids.select(F.col("parent").alias("edge_id"), F.col("n").alias("n_children")), "edge_id", "left").join(kids.select("parent", F.col("n").alias("n_same")), "parent", "left")
    n = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    return out.select("edge_id", "parent", "root", "level", n(F.col("n_children")).alias("n_children"), n(F.col("n_same") - 1).alias("n_siblings"))
