"""Connected components of an edge table by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.scratch import Scratch


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """``(node, component)`` for every node of an edge; component is the smallest node reachable.

    Each round points every node at its smallest neighbour, shortens those
    pointers, and contracts the graph; rounds grow with the logarithm of the
    longest path. All joins read written tables on both sides, so adaptive
    execution can split a hot node, and are merge joins, as tables grow with the
    input and their compressed size says little. Self-loops give a component of one;
    null ends are ignored; repeated edges count once; no edges give no rows.
    """
    spark = edges.sparkSession
    scratch = Scratch(spark, "components")
    edge = scratch.put(
        edges.select(F.col(src).alias("a"), F.col(dst).alias("b"))
        .where("a IS NOT NULL AND b IS NOT NULL").distinct(), "edges")
    label = scratch.put(
        edge.select(F.explode(F.array("a", "b")).alias("node")).distinct()
        .withColumn("component", F.col("node")), "labels")
    edge_now = scratch.put(edge.where("a <> b"), "edges")
    while not edge_now.isEmpty():
        both = edge_now.unionByName(edge_now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        parent = scratch.put(
            both.groupBy(F.col("a").alias("v")).agg(F.min("b").alias("m"))
            .select("v", F.least("v", "m").alias("p")), "parents")
        while True:
            up = parent.select(F.col("v").alias("p"), F.col("p").alias("pp"))
            jumped = scratch.put(
                parent.join(up.hint("merge"), "p", "left").select("v", F.coalesce("pp", "p").alias("q"), "p"), "jumps")
            moved = not jumped.where("q <> p").isEmpty()
            scratch.drop(parent)
            parent = scratch.put(jumped.select("v", F.col("q").alias("p")), "parents") if moved else jumped.select("v", "p")
            if not moved:
                break
        new_label = scratch.put(
            label.join(parent.select(F.col("v").alias("component"), F.col("p").alias("to")).hint("merge"), "component", "left")
            .select("node", F.coalesce("to", "component").alias("component")), "labels")
        pa = parent.select(F.col("v").alias("a"), F.col("p").alias("pa"))
        pb = parent.select(F.col("v").alias("b"), F.col("p").alias("pb"))
        new_edge = scratch.put(
            edge_now.join(pa.hint("merge"), "a").join(pb.hint("merge"), "b").where("pa <> pb")
            .select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct(), "edges")
        scratch.drop(label, edge_now)
        label, edge_now = new_label, new_edge
    return label
