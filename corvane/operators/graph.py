"""Frames saved between steps, and components of a graph of dense points."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def folder(spark: SparkSession) -> str:
    """This session's own folder in that of spark.checkpoint.dir; a temporary one only where all of Spark is this process."""
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        path = sc.getConf().get("spark.checkpoint.dir")
        if not path and (not sc.master.startswith("local") or sc.master.startswith("local-cluster")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(path or tempfile.mkdtemp(prefix="corvane-"))
    return sc.getCheckpointDir()


def saved(df: DataFrame) -> DataFrame:
    """`df` as it is now, in that folder."""
    folder(df.sparkSession)
    return df.checkpoint()


#: Links up to which a graph is solved on the driver; larger ones are solved by joins.
FEW_LINKS = 100_000


def _followed(nodes: DataFrame, links: DataFrame) -> DataFrame:
    parent: dict = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            parent[x] = x = parent[parent[x]]
        return x

    for a, b in links.collect():
        x, y = sorted((root(a), root(b)))
        parent[y] = x
    kind = nodes.schema["id"].dataType.simpleString()
    found = nodes.sparkSession.createDataFrame([(x, root(x)) for x in list(parent)], f"id {kind}, root {kind}")
    return nodes.select("id").join(F.broadcast(found), "id", "left").select("id", F.coalesce("root", "id").alias("root"))


def components(nodes: DataFrame, links: DataFrame, few: int = FEW_LINKS) -> DataFrame:
    """(id, root): the smallest id that each node reaches along links (a, b).

    Labels spread along links and then jump to their root's label, saved in each round. Only where there are at most `few`
    links, which is counted, they are followed on the driver."""
    links = saved(links.select("a", "b"))
    if links.count() <= few:
        return _followed(nodes, links)
    both = saved(links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    now = saved(nodes.select("id", F.col("id").alias("root")))
    while True:
        spread = both.join(now.withColumnRenamed("id", "b"), "b").groupBy(F.col("a").alias("id")).agg(F.min("root").alias("near"))
        low = now.join(spread, "id", "left").select("id", F.least("root", F.coalesce("near", "root")).alias("root"), F.col("root").alias("was"))
        jump = saved(low.alias("l").join(low.select(F.col("id").alias("_i"), F.col("root").alias("_r")).alias("r"), F.col("l.root") == F.col("_i"), "left").select("id", F.least("root", F.coalesce("_r", "root")).alias("root"), "was"))
        changed = not jump.where("root <> was").isEmpty()
        now = jump.select("id", "root")
        if not changed:
            return now


def _led(nodes: DataFrame, links: DataFrame) -> DataFrame:
    after: dict = {}
    for a, b in links.collect():
        after.setdefault(a, []).append(b)
        after.setdefault(b, [])
    root: dict = {}
    for start in sorted(after):
        todo = [] if start in root else [start]
        root.setdefault(start, start)
        while todo:
            for b in after[todo.pop()]:
                if b not in root:
                    root[b] = start
                    todo.append(b)
    kind = nodes.schema["id"].dataType.simpleString()
    found = nodes.sparkSession.createDataFrame(list(root.items()), f"id {kind}, root {kind}")
    return nodes.select("id").join(F.broadcast(found), "id", "left").select("id", F.coalesce("root", "id").alias("root"))


def led_to(nodes: DataFrame, links: DataFrame, few: int = FEW_LINKS) -> DataFrame:
    """(id, root): the smallest id from which links (a to b) lead to each node, its own if there is none smaller.

    Nodes that are linked both ways reach the same, so their components are taken first, and only the links that go one way between components are left.
    Along these the smallest ids are handed on, with jumps to what the found one has found, until nothing changes; at most `few`, which is
    counted, are followed on the driver, smallest ids first."""
    links = saved(links.select("a", "b").where("a <> b").distinct())
    mutual = links.join(links.select(F.col("b").alias("a"), F.col("a").alias("b")), ["a", "b"], "left_semi").where("a < b")
    part = saved(components(nodes, mutual, few))
    ends = links.join(part.select(F.col("id").alias("a"), F.col("root").alias("_a")), "a").join(part.select(F.col("id").alias("b"), F.col("root").alias("_b")), "b")
    links = saved(ends.where("_a <> _b").select(F.col("_a").alias("a"), F.col("_b").alias("b")).distinct())
    parts = part.select(F.col("root").alias("id")).distinct()
    if links.count() <= few:
        now = _led(parts, links)
    else:
        now = saved(parts.select("id", F.col("id").alias("root")))
        while True:
            given = links.join(now.withColumnsRenamed({"id": "a", "root": "_from"}), "a").groupBy(F.col("b").alias("id")).agg(F.min("_from").alias("_from"))
            low = now.join(given, "id", "left").select("id", F.col("root").alias("was"), F.least("root", F.coalesce("_from", "root")).alias("root"))
            jump = saved(low.join(now.select(F.col("id").alias("root"), F.col("root").alias("_far")), "root").select("id", "was", F.least("root", "_far").alias("root")))
            now = jump.select("id", "root")
            if jump.where("root <> was").isEmpty():
                break
    return part.join(now.select(F.col("id").alias("root"), F.col("root").alias("_far")), "root").select("id", F.col("_far").alias("root"))
