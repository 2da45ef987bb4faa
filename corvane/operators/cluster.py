"""Clusters by density and by single linkage, distances between classes, and n-fold validation."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import ship
from .graph import components, led_to, saved
from .neighbours import BLOCK, _candidates, nearest
from .neighbours import _distances as distances
from .order import positions
from .sets import fold_number
from .spanning import tree_by_chunks


def class_nearest(df: DataFrame, block: int = 20_000) -> DataFrame:
    """(id, label, other, d2): each point's least squared distance to another point of each class.

    Up to `block` points meet in one task for all classes; more are searched class by class, by clusters (see neighbours.nearest)."""
    ship(df.sparkSession)
    n = max(1, math.ceil(df.count() / block))
    if n > 1:
        parts = [(c, df.where(F.col("label") == c)) for (c,) in df.select("label").where("label is not null").distinct().collect()]
        searches = [nearest(df.select("id", "x"), part.select("id", "x"), 2, block=block).where("probe <> train").groupBy("probe").agg(F.min("d2").alias("d2")).select("probe", F.lit(c).cast(df.schema["label"].dataType).alias("other"), "d2") for c, part in parts]
        found = searches[0]
        for one in searches[1:]:
            found = found.unionByName(one)
        return found.join(df.select(F.col("id").alias("probe"), "label"), "probe").select(F.col("probe").alias("id"), "label", "other", "d2")
    kind, label = (df.schema[c].dataType.simpleString() for c in ("id", "label"))
    all_ = F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    own = F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    rows = df.select("id", "label", F.col("x").cast("array<double>").alias("x"))

    def least(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame({"id": [], "label": [], "other": [], "d2": []})]
        for other, part in b.groupby("_label") if len(a) else ():
            x, ids = np.stack(part["_x"].to_numpy()), part["_id"].to_numpy()
            for at in range(0, len(a), 256):
                some = a.iloc[at : at + 256]
                d = distances(0, np.stack(some["x"].to_numpy()), x)
                d[some["id"].to_numpy()[:, None] == ids] = np.inf
                out.append(pd.DataFrame({"id": some["id"], "label": some["label"], "other": other, "d2": d.min(axis=1)}))
        return pd.concat(out)

    left, right = rows.select("id", "label", "x", own.alias("_a"), all_.alias("_b")), rows.select(F.col("id").alias("_id"), F.col("label").alias("_label"), F.col("x").alias("_x"), all_.alias("_c"), own.alias("_d"))
    found = left.groupBy("_a", "_b").cogroup(right.groupBy("_c", "_d")).applyInPandas(least, f"id {kind}, label {label}, other {label}, d2 double")
    return found.groupBy("id", "label", "other").agg(F.min("d2").alias("d2"))


def hausdorff(df: DataFrame, block: int = BLOCK, picks: int = BLOCK, drawn: int = 8192, most_classes: int = 64) -> DataFrame:
    """(la, lb, h): for each two classes la <= lb, the larger of both directions' largest least squared distance from a point of one to
    the points of the other; for a class and itself its width, to another point of it.

    Of more than `block` points, most are shown not to be the farthest, and only the others are searched for (see _farthest), unless there are more than `most_classes`."""
    ship(df.sparkSession)
    classes = [c for (c,) in df.select("label").distinct().limit(most_classes + 1).collect()] if df.count() > block else []
    if classes and len(classes) <= most_classes:
        one = _farthest(df, classes, picks, drawn)
    else:
        one = class_nearest(df, block).where("d2 < double('infinity')").groupBy("label", "other").agg(F.max("d2").alias("h"))
    return one.groupBy(F.least("label", "other").alias("la"), F.greatest("label", "other").alias("lb")).agg(F.max("h").alias("h"))


def _farthest(df: DataFrame, classes: list, picks: int, drawn: int) -> DataFrame:
    """(label, other, h): the largest least squared distance from a point of each class to other points of each class that isn't null.

    A point's least distance to some rows of a class, drawn by a hash, is no less than that to the whole class. The points with the largest such bounds, `picks`
    over all pairs of classes, are measured against all rows, and the largest distance among them leaves open only points with a bound above it. If these are no more
    than `picks` they are measured too, else searched for (see neighbours.nearest). What rows are drawn never changes the result. A task holds a
    batch of rows and the drawn or picked ones. Rows without an id or a whole vector are left out.
    """
    spark, kind = df.sparkSession, df.schema["id"].dataType.simpleString()
    names = spark.createDataFrame(list(enumerate(classes)), f"c int, label {df.schema['label'].dataType.simpleString()}")
    n, others = len(classes), [k for k, c in enumerate(classes) if c is not None]
    x = F.col("x").cast("array<double>")
    whole = df.where("id is not null").select("id", F.col("label").alias("_label"), x.alias("x")).where(x.isNotNull() & ~F.exists(x, lambda v: v.isNull() | F.isnan(v)))
    rows = saved(whole.join(F.broadcast(names), F.col("_label").eqNullSafe(F.col("label"))).select("id", "c", "x"))

    def by_class(some: pd.DataFrame, c: str) -> list[tuple]:
        return [(k, part.index.to_numpy(), part["id"].to_numpy(), np.stack(part["x"].to_numpy())) for k, part in some.groupby(c)]

    few = spark.sparkContext.broadcast(by_class(rows.where(F.col("c").isin(others)).orderBy(F.xxhash64("id"), "id").limit(drawn).toPandas(), "c"))

    def bounded(batches):
        for b in batches:
            for at in range(0, len(b), 256):
                part = b.iloc[at : at + 256]
                ids, points, bound = part["id"].to_numpy(), np.stack(part["x"].to_numpy()), np.full((len(part), n), np.inf)
                for k, _, own, there in few.value:
                    i, _, d2 = _candidates(points, there, 1, barred=ids[:, None] == own)
                    np.minimum.at(bound[:, k], i, d2)
                yield part.assign(bounds=list(bound))

    def measured(some: DataFrame) -> DataFrame:
        """(c, k, h): the largest least distance of points (id, c, k, x) of classes c to rows of classes k, over what is there."""
        table = some.toPandas()
        to = spark.sparkContext.broadcast(by_class(table, "k"))

        def least(batches):
            best = np.full(size, np.inf)
            for b in batches:
                for k, at, own, points in to.value:
                    if len(part := b[b["c"].to_numpy() == k]):
                        ids, there = part["id"].to_numpy(), np.stack(part["x"].to_numpy())
                        for begin in range(0, len(at), 256):
                            i, _, d2 = _candidates(points[begin : begin + 256], there, 1, barred=own[begin : begin + 256, None] == ids)
                            np.minimum.at(best, at[begin + i], d2)
            there = np.flatnonzero(best < np.inf)
            yield pd.DataFrame({"n": there, "d2": best[there]})

        size = len(table)
        numbers = spark.createDataFrame(list(zip(range(size), table["c"].tolist(), table["k"].tolist())), "n long, c int, k int")
        return rows.mapInPandas(least, "n long, d2 double").groupBy("n").agg(F.min("d2").alias("d2")).join(F.broadcast(numbers), "n").groupBy("c", "k").agg(F.max("d2").alias("h"))

    bounds = saved(rows.mapInPandas(bounded, f"id {kind}, c int, x array<double>, bounds array<double>"))
    each = bounds.select("id", "c", F.posexplode("bounds").alias("k", "bound")).where(F.col("k").isin(others))
    ranked = each.withColumn("_r", F.row_number().over(Window.partitionBy("c", "k").orderBy(F.desc("bound"), "id"))).where(F.col("_r") <= max(1, picks // n**2))
    first = saved(measured(bounds.select("id", "c", "x").join(F.broadcast(ranked.select("id", "c", "k")), ["id", "c"])))
    floor = np.full((n, n), -np.inf)
    for c, k, h in first.collect():
        floor[c, k] = h
    floor[:, [k for k in range(n) if k not in others]] = np.inf

    def opened(batches):
        for b in batches:
            if len(b):
                i, k = np.nonzero(np.stack(b["bounds"].to_numpy()) > floor[b["c"].to_numpy()])
                yield b.iloc[i][["id", "c", "x"]].assign(k=k)

    left = saved(bounds.mapInPandas(opened, f"id {kind}, c int, x array<double>, k int"))
    if left.count() <= picks:
        found = [measured(left)]
    else:
        found = []
        for k in others:
            near = nearest(left.where(F.col("k") == k).select("id", "x"), rows.where(F.col("c") == k).select("id", "x"), 2).where("probe <> train").groupBy("probe").agg(F.min("d2").alias("d2"))
            own = left.where(F.col("k") == k).select(F.col("id").alias("probe"), "c", "k")
            found.append(near.join(own, "probe").groupBy("c", "k").agg(F.max("d2").alias("h")))
    for one in found:
        first = first.unionByName(one)
    both = first.groupBy("c", "k").agg(F.max("h").alias("h")).join(F.broadcast(names), "c")
    return both.join(F.broadcast(names.select(F.col("c").alias("k"), F.col("label").alias("other"))), "k").select("label", "other", "h")


def flood(df: DataFrame, k: int, threshold: float | None = None) -> DataFrame:
    """(id, cluster, log_pdf): clusters of points (id, x) whose k-NN density is at least the threshold, a log density (by default their mean); others are in cluster 0.

    The density is k over the volume of the ball whose radius lies midway between the k-th and the next distance, a point being the first of its own neighbours,
    and the number of points. Each dense point, in the order of ids, that no cluster has yet starts the next one (from 1), and a cluster takes all dense points that are among its points'
    k + 1 nearest and in no cluster. So a point's cluster is that of the smallest id from which neighbours lead to it (see graph.led_to). A point with a null or NaN in its vector is in cluster 0.
    """
    from .order import running_sums

    dimensions, n = df.select(F.max(F.size("x"))).first()[0] or 1, df.count()
    near = saved(nearest(df, df, k + 1))
    radius = near.where(F.col("rank").isin(k, k + 1)).groupBy("probe").agg(F.avg(F.sqrt("d2")).alias("r"))
    constant = math.log(max(k, 1)) - math.log(max(n, 1)) + math.lgamma(dimensions / 2 + 1) - dimensions / 2 * math.log(math.pi)
    density = saved(radius.select(F.col("probe").alias("id"), (F.lit(constant) - dimensions * F.log("r")).alias("log_pdf")).withColumn("log_pdf", F.coalesce("log_pdf", F.lit(math.inf))))
    if threshold is None:
        threshold = density.where(F.col("log_pdf") < math.inf).agg(F.avg("log_pdf")).first()[0] or 0.0
    dense = saved(density.where(F.col("log_pdf") >= threshold).select("id"))
    links = near.join(dense.withColumnRenamed("id", "probe"), "probe").join(dense.withColumnRenamed("id", "train"), "train")
    now = saved(led_to(dense, links.select(F.col("probe").alias("a"), F.col("train").alias("b"))))
    starts = running_sums(now.where("id = root").select(F.col("root")), ["root"]).select("root", (F.col("position") + 1).alias("cluster"))
    found = now.join(starts, "root").select("id", "cluster")
    return df.select("id").join(density, "id", "left").join(found, "id", "left").select("id", F.coalesce("cluster", F.lit(0).cast("long")).alias("cluster"), "log_pdf")


def spanning_tree(df: DataFrame, block: int = BLOCK, most: int = 2_000_000) -> DataFrame:
    """(a, b, d2): the edges of the minimum spanning tree of points (id, x). Ties go to the smaller ids. Points without a whole vector have no edges.

    Of equal vectors only the smallest id is searched for, and the others are linked to it. Up to `most` different vectors, every two are measured
    once (see spanning.tree_by_chunks); more are joined by rounds (see _tree_by_rounds), as the driver then can't hold a tree.
    """
    ship(df.sparkSession)
    x = F.col("x") if df.schema["x"].dataType.simpleString() == "array<float>" else F.col("x").cast("array<double>")
    rows = df.select("id", x.alias("x")).where(F.col("x").isNotNull() & ~F.exists("x", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == math.inf)))
    firsts = saved(rows.groupBy("x").agg(F.min("id").alias("first"), F.count("*").alias("rows")))
    different, n = firsts.agg(F.count("*"), F.coalesce(F.sum("rows"), F.lit(0))).first()
    one_each = firsts.select(F.col("first").alias("id"), "x")
    tree = tree_by_chunks(one_each, block) if different <= most else _tree_by_rounds(one_each, block)
    if different == n:
        return tree
    large = F.col("rows") > n / 1000  # fewer than 1000 groups are broadcast, so that the rows of one needn't meet in a task
    several, many = (firsts.where((F.col("rows") > 1) & c).select("x", "first") for c in (~large, large))
    copies = rows.join(several, "x").unionByName(rows.join(F.broadcast(many), "x"))
    return tree.unionByName(copies.where("id <> first").select(F.col("first").alias("a"), F.col("id").alias("b"), F.lit(0.0).alias("d2")))


def _tree_by_rounds(df: DataFrame, block: int) -> DataFrame:
    """The same for different vectors, by rounds in which every component takes its shortest edge out.

    Each round is one search in blocks for each point's nearest point of another component, and merges at least
    half of all components; so there are as many rounds as the logarithm of the points. The search is pruned by
    clusters, of which those that have only the point's own component are skipped.
    """
    now = saved(df.select("id", F.col("id").alias("label"), "x"))
    tree = None
    while now.select("label").distinct().limit(2).count() > 1:
        near = _nearest_outside(now, block)
        each = near.withColumns({"a": F.least("id", "to"), "b": F.greatest("id", "to")}).groupBy("label").agg(F.min(F.struct("d2", "a", "b")).alias("e")).select("label", "e.*")
        edges = saved(each.select("a", "b", "d2").distinct())
        if edges.isEmpty():
            break
        tree = edges if tree is None else tree.unionByName(edges)
        labels = now.select("id", "label")
        ends = edges.join(labels.withColumnsRenamed({"id": "a", "label": "la"}), "a").join(labels.withColumnsRenamed({"id": "b", "label": "lb"}), "b").select(F.col("la").alias("a"), F.col("lb").alias("b"))
        roots = components(labels.select(F.col("label").alias("id")).distinct(), ends)
        now = saved(now.join(roots.withColumnsRenamed({"id": "label"}), "label").select("id", F.col("root").alias("label"), "x"))
    return tree if tree is not None else df.select(F.col("id").alias("a"), F.col("id").alias("b"), F.lit(0.0).alias("d2")).where("false")


def _nearest_outside(df: DataFrame, block: int = BLOCK) -> DataFrame:
    """(id, label, to, d2): each point's nearest point with another label, the smallest id among equals: a search that leaves out the label's own rows."""
    rows = df.select("id", "x", F.col("label").alias("fold"))
    near = nearest(rows, rows, 1, block=block)
    return near.join(df.select(F.col("id").alias("probe"), "label"), "probe").select(F.col("probe").alias("id"), "label", F.col("train").alias("to"), "d2")


def dendrogram(df: DataFrame) -> DataFrame:
    """(node, a, b, d2): single linkage, its merges numbered from 0 in the order of distance; a and b are the points that join two clusters.
    Cutting all merges from a distance on leaves the clusters at it (see linkage_clusters)."""
    return positions(spanning_tree(df), ["d2", "a", "b"]).select(F.col("position").alias("node"), "a", "b", "d2")


def linkage_clusters(df: DataFrame, d2: float) -> DataFrame:
    """(id, root): the clusters of single linkage below a squared distance; root is the smallest id of each."""
    return components(df.select("id"), spanning_tree(df).where(F.col("d2") < d2).select("a", "b"))


def fold_neighbours(df: DataFrame, folds: int, k: int) -> tuple[DataFrame, DataFrame]:
    """Rows with their `fold` (see sets.fold_number), and for each the k nearest of the other folds, by one search for all folds."""
    parts = df.withColumn("fold", fold_number(F.col("id"), folds))
    return parts, nearest(parts.select("id", "x", "fold"), parts.select("id", "x", "fold"), k)


def cross_validate(df: DataFrame, folds: int, k: int, weight: float | None = None) -> DataFrame:
    """(fold, n, accuracy) of classification of (id, x, label), each fold predicted from the others: by k-NN, or with a `weight` by adaptive kernels of this total weight
    over the k nearest."""
    from .kernel import classify, weights
    from .neighbours import knn_classify

    parts, near = fold_neighbours(df, folds, k)
    labels = parts.select("id", "label")
    found = knn_classify(near, labels, k, df.agg(F.count_distinct("label")).first()[0]) if weight is None else classify(weights(near, weight), labels)
    met = found.join(parts.select(F.col("id").alias("probe"), "fold", F.col("label").alias("truth")), "probe")
    return met.groupBy("fold").agg(F.count("*").alias("n"), F.avg((F.col("label") == F.col("truth")).cast("double")).alias("accuracy"))


def cross_interpolate(df: DataFrame, folds: int, k: int, weight: float | None = None) -> DataFrame:
    """(fold, n, r, bias, rmse) of regression of (id, x, y) in the same way."""
    from .kernel import regress, weights
    from .neighbours import knn_regress

    parts, near = fold_neighbours(df, folds, k)
    values = parts.select("id", "y")
    found = knn_regress(near, values, k) if weight is None else regress(weights(near, weight), values)
    met = found.select("probe", "y").join(parts.select(F.col("id").alias("probe"), "fold", F.col("y").alias("truth")), "probe")
    away = F.col("y") - F.col("truth")
    return met.groupBy("fold").agg(F.count("*").alias("n"), F.corr("y", "truth").alias("r"), F.avg(away).alias("bias"), F.sqrt(F.avg(away * away)).alias("rmse"))
