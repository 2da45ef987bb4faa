"""Connected components of a graph of any size, by alternating star operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace, with_summary


def connected_components(edges: DataFrame, ws: Workspace) -> DataFrame:
    """(id, component) of every end of the edges (a, b): component is the smallest id that can be reached.

    Each round hooks every node's larger neighbours to its smallest (large star), then every node and its
    smaller neighbours to the smallest (small star), until nothing changes. A node's neighbours are never gathered:
    their minimum is taken with partial sums and joined back, by broadcast for the few nodes that have very many. Ends
    that are null are linked with nothing; repeated edges and loops don't count; no edges give no rows.
    """
    now = ws.save(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    mark = None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        total = 2 * now.count()
        least = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("u", "m").alias("m"), "n")
        large = with_summary(both, least, ["u"], "n", total).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        small = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        hooked = with_summary(large, small, ["u"], "n", total).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(small.select("u", F.col("m").alias("v"))).distinct()
        following = ws.save(hooked)
        ws.drop(now)
        now = following
        seen = now.agg(F.count("*").alias("n"), F.sum(F.shiftrightunsigned(F.xxhash64("u", "v"), 20)).alias("h")).first()
        if seen == mark:
            return now.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
        mark = seen
