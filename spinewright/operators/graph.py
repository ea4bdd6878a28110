"""Connected components over an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spinewright.core import materialize


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")).alias("h")).first()
    return row["n"], row["h"]


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """``(node, root)`` for every node of an undirected edge table, root being the smallest node reachable.

    Alternates large-star and small-star steps, each a grouped minimum and one join, until the edges form
    stars; rounds grow with the logarithm of the longest path. Self-loops keep their node; edges with a null
    end are ignored. No adjacency list is ever collected, so hubs of any degree are fine.
    """
    named = edges.select(F.col(src).alias("a"), F.col(dst).alias("b")).where("a is not null and b is not null")
    everything = materialize(named.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    e = everything.where("u <> v")
    state = _state(e)
    while state[0]:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(low, "u").where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        near = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(near, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = materialize(small.unionByName(near.select("u", F.col("m").alias("v"))).distinct())
        new = _state(e)
        if new == state:
            break
        state = new
    roots = e.groupBy("u").agg(F.min("v").alias("root"))
    nodes = everything.select(F.col("u").alias("node")).unionByName(everything.select(F.col("v").alias("node"))).distinct()
    return nodes.join(roots, nodes["node"] == roots["u"], "left").select("node", F.coalesce("root", "node").alias("root"))
