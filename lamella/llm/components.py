"""Connected components of an edge table by alternating min-hooking and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stage, unstage


def components(edges: DataFrame) -> DataFrame:
    """edges (a long, b long) -> (node, component): each node that has an edge, with the smallest node it reaches.

    Each round gives every node its smallest smaller neighbour's own smallest neighbour as its parent, and links the
    other smaller neighbours to the smallest. Depth halves each round. The two joins are skewed only on one side
    (a hub's children), which Spark splits. Self-loops and nulls are ignored; an empty table gives an empty table.
    """
    e = stage(
        edges.where("a IS NOT NULL AND b IS NOT NULL AND a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("p")).distinct(),
        "edges",
    )
    while True:
        low = stage(e.groupBy("u").agg(F.min("p").alias("m")), "low")
        up = low.select(F.col("u").alias("m"), F.col("m").alias("g"))
        jumped = low.join(up, "m", "left").select("u", F.coalesce("g", "m").alias("p"), F.col("g").isNotNull().alias("moved"))
        other = e.join(low, "u").where("p <> m").select(F.greatest("p", "m").alias("u"), F.least("p", "m").alias("p"), F.lit(True).alias("moved"))
        new = stage(jumped.unionByName(other).groupBy("u", "p").agg(F.max("moved").alias("moved")), "edges")
        moved = new.where("moved").limit(1).count()
        unstage(e)
        unstage(low)
        e = new
        if not moved:
            return e.select(F.col("u").alias("node"), F.col("p").alias("component")).unionByName(e.select(F.col("p").alias("node"), F.col("p").alias("component")).distinct())
