"""k nearest neighbours in blocks, and what is estimated from them."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import ship
from .graph import saved

#: Rows of a block; each block of probes meets each block of training rows in one task.
BLOCK = 20_000


def _distances(metric: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    out = np.zeros((len(a), len(b)))
    for k in range(a.shape[1] if len(a) and len(b) else 0):
        d = a[:, k][:, None] - b[:, k]
        if metric == 3:
            np.maximum(out, np.abs(d), out=out)
        else:
            out += d * d if metric == 0 else np.abs(d) if metric in (1, 5) else d**4
    return out * out if metric in (1, 3) else np.sqrt(out) if metric == 2 else out


def squared(a: np.ndarray, b: np.ndarray, tolerance: float) -> np.ndarray:
    """Squared distances of all pairs by one product of matrices, or without it where its rounding could pass `tolerance`."""
    centre = b.mean(axis=0) if len(b) else 0.0  # only differences count; small numbers lose less
    p, q = a - centre, b - centre
    with np.errstate(over="ignore", invalid="ignore"):
        own, other = (p * p).sum(axis=1), (q * q).sum(axis=1)
        error = 4 * (a.shape[1] + 4) * np.finfo(float).eps * (own.max(initial=0) + other.max(initial=0))
        return np.maximum(own[:, None] + other - 2 * (p @ q.T), 0) if error < tolerance else _distances(0, a, b)


def _candidates(a: np.ndarray, x: np.ndarray, k: int, limit: np.ndarray | None = None, barred: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(i, j, d2): the k nearest rows j of `x` to each row i of `a`, and some more; none that are barred, nor farther than `limit`, a squared distance of each row of `a`.

    One product of matrices of single precision gives squared distances that err by `slack` at most. The k-th least of every 16th or 4th row bounds the k-th of all, so the rest is
    only compared with it; of the rows that are within, those within twice the slack of the k-th are measured in full precision.
    """
    centre = x.mean(axis=0)
    with np.errstate(over="ignore", invalid="ignore"):
        p, q = (a - centre).astype(np.float32), (x - centre).astype(np.float32)
        own, other = (p * p).sum(axis=1), (q * q).sum(axis=1)
        rough = p @ (-2 * q.T)
        rough += own[:, None]
        rough += other
        slack = 4 * (a.shape[1] + 4) * np.finfo(np.float32).eps * (own + other.max()) + np.finfo(np.float32).tiny * 1e3
    if not (np.isfinite(rough).all() and np.isfinite(slack).all()):
        rough, slack = _distances(0, a, x), np.zeros(len(a))
    every = 16 if len(x) >= 1024 * k else 4 if len(x) >= 64 * k else 1
    some = rough[:, ::every]
    if barred is not None:
        some = np.where(barred[:, ::every], np.inf, some)
    most = np.partition(some, k - 1, axis=1)[:, k - 1].astype(float) if k < some.shape[1] else np.full(len(a), np.inf)
    most = (most if limit is None else np.minimum(most, limit)) + 2 * slack
    may = rough <= np.nextafter(most.astype(rough.dtype), np.inf)[:, None]
    if barred is not None:
        may &= ~barred
    i, j = np.divmod(np.flatnonzero(may.ravel()), len(x))
    if every > 1 and len(i):
        there = rough[i, j]
        order = np.lexsort((there, i))
        begin, end = (np.searchsorted(i, np.arange(len(a)), side) for side in ("left", "right"))
        least = np.where(end - begin >= k, there[order[np.minimum(begin + k - 1, len(i) - 1)]], np.inf) + 2 * slack
        near = there <= np.nextafter(least.astype(rough.dtype), np.inf)[i]
        i, j = i[near], j[near]
    d2 = np.zeros(len(i))
    for c in range(a.shape[1]):
        d = a[i, c] - x[j, c]
        d2 += d * d
    return i, j, d2


def _least(i: np.ndarray, j: np.ndarray, d2: np.ndarray, k: int) -> np.ndarray:
    """Where the k least d2 of each i are; of equal ones, those of the least j."""
    order = np.lexsort((j, d2, i))
    first = np.searchsorted(i[order], i[order])
    return order[np.arange(len(order)) - first < k]


def _best(metric: int, k: int):
    """The k nearest of a group's training rows to each of its probes, as a function of two frames; with folds, of other folds than its own."""

    def best(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame({"probe": [], "train": [], "d2": []})
        order = np.argsort(b["train"].to_numpy(), kind="stable")
        ids, x = b["train"].to_numpy()[order], np.stack(b["x"].to_numpy())[order]
        out = []
        for at in range(0, len(a), 256):
            part = a.iloc[at : at + 256]
            barred = part["fold"].to_numpy()[:, None] == b["fold"].to_numpy()[order] if "fold" in a else None
            if metric == 0:
                i, j, d2 = _candidates(np.stack(part["x"].to_numpy()), x, k, barred=barred)
                some = _least(i, j, d2, k)
                i, j, d2 = i[some], j[some], d2[some]
            else:
                d = _distances(metric, np.stack(part["x"].to_numpy()), x)
                if barred is not None:
                    d[barred] = np.inf
                near = np.argsort(d, axis=1, kind="stable")[:, :k]
                i, j, d2 = np.repeat(np.arange(len(part)), near.shape[1]), near.ravel(), np.take_along_axis(d, near, 1).ravel()
            found = pd.DataFrame({"probe": part["probe"].to_numpy()[i], "train": ids[j], "d2": d2})
            out.append(found[found["d2"] < np.inf] if "fold" in a else found)
        return pd.concat(out)

    return best


def _best_of_clusters(k: int):
    """The k nearest of a group's training rows to each of its probes, among the clusters that the probe asks for and within its bound."""

    def best(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame({"probe": [], "train": [], "d2": []})
        order = np.argsort(b["train"].to_numpy(), kind="stable")
        ids, x, cluster = b["train"].to_numpy()[order], np.stack(b["x"].to_numpy())[order], b["c"].to_numpy()[order]
        rows = np.argsort(cluster, kind="stable")
        clusters, start = np.unique(cluster[rows], return_index=True)
        number = np.searchsorted(clusters, cluster)
        out = []
        for at in range(0, len(a), 1024):
            part = a.iloc[at : at + 1024]
            probes, limit = np.stack(part["x"].to_numpy()), part["_bound"].to_numpy(dtype=float, na_value=np.inf)
            limit = np.where(np.isnan(limit), np.inf, limit)
            asked = np.zeros((len(part), len(clusters)), dtype=bool)
            asked[np.repeat(np.arange(len(part)), part["cs"].map(len)), np.searchsorted(clusters, np.concatenate(part["cs"].to_numpy()))] = True
            found = []
            parts = np.split(rows, start[1:])
            if together := asked.mean() > 0.25:  # most probes meet most clusters: one product for all rows, of which those asked for count
                parts = [rows]
            for n, there in enumerate(parts):
                who = np.arange(len(part)) if together else np.flatnonzero(asked[:, n])
                for begin in range(0, len(who), 256):
                    some = who[begin : begin + 256]
                    barred = part["fold"].to_numpy()[some][:, None] == b["fold"].to_numpy()[order][there] if "fold" in a else None
                    i, j, d2 = _candidates(probes[some], x[there], k, limit[some], barred)
                    i, j = some[i], there[j]
                    if together:
                        mine = asked[i, number[j]]
                        i, j, d2 = i[mine], j[mine], d2[mine]
                    found.append((i, j, d2))
            i, j, d2 = (np.concatenate(f) for f in zip(*found))
            some = _least(i, j, d2, k)
            found = pd.DataFrame({"probe": part["probe"].to_numpy()[i[some]], "train": ids[j[some]], "d2": d2[some]})
            out.append(found[found["d2"] < np.inf] if "fold" in a else found)
        return pd.concat(out)

    return best


def _own_centre(x: np.ndarray, centres: np.ndarray, opened: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The number of the nearest of those centres that are open, and its distance; rounding may take another that is as near."""
    number = np.empty(len(x), dtype=np.int64)
    for at in range(0, len(x), 1024):
        part = x[at : at + 1024]
        with np.errstate(over="ignore", invalid="ignore"):
            rough = (centres * centres).sum(axis=1) - 2 * (part @ centres.T)
        if not np.isfinite(rough).all():
            rough = _distances(0, part, centres)
        number[at : at + 1024] = (rough if opened is None else np.where(opened[at : at + 1024], rough, np.inf)).argmin(axis=1)
    return number, np.sqrt(((x - centres[number]) ** 2).sum(axis=1))


def _bundles(centres: np.ndarray, rows: np.ndarray, block: int) -> np.ndarray:
    """For each cluster the number of its bundle: neighbouring clusters of at most `block` rows together, or one cluster; by halves along the widest coordinate."""
    out, count, open_ = np.zeros(len(rows), dtype=np.int64), 0, [np.flatnonzero(rows > 0)]
    while open_:
        some = open_.pop()
        if len(some) > 1 and rows[some].sum() > block:
            along = centres[some, np.ptp(centres[some], axis=0).argmax()]
            some = some[np.argsort(along, kind="stable")]
            open_ += [some[: len(some) // 2], some[len(some) // 2 :]]
        else:
            out[some], count = count, count + 1
    return out


def _ranked(found: DataFrame, k: int) -> DataFrame:
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("probe").orderBy("d2", "train")))
    return ranked.where(F.col("rank") <= k).select("probe", "rank", "train", "d2")


def _rows(df: DataFrame, name: str) -> DataFrame:
    """Rows with a whole vector; those without one are near nothing."""
    x = F.col("x").cast("array<double>")
    return df.select(F.col("id").alias(name), x.alias("x"), *("fold" for c in df.columns if c == "fold")).where(x.isNotNull() & ~F.exists(x, lambda v: v.isNull() | F.isnan(v)))


def nearest(probes: DataFrame, train: DataFrame, k: int, metric: int = 0, block: int = BLOCK) -> DataFrame:
    """(probe, rank, train, d2): the k nearest rows of `train` (id, x) to each row of `probes` (id, x), exact.

    Both sides are dealt in blocks of about `block` rows; a task gets one of each, returns its best k of each probe, and the
    best of these are ranked by distance, then id. No side is broadcast, and a task's memory is that of two
    blocks. Up to `block` training rows make one block. More are searched by clusters if the metric is Euclidean (see
    _by_clusters), else every two blocks meet. Rows whose vector is null or has a null or NaN are left out. metric: see functions.vectors.METRICS.
    Where both sides have a column `fold`, a row is near only to rows of other folds: one search serves a whole cross-validation.
    """
    ship(probes.sparkSession)
    probes, train = _rows(probes, "probe"), _rows(train, "train")
    if ("fold" in probes.columns) != ("fold" in train.columns):
        probes, train = (df.drop("fold") for df in (probes, train))
    fold = ["fold"] if "fold" in probes.columns else []
    pb, tb = (max(1, math.ceil(df.count() / block)) for df in (probes, train))
    if metric == 0 and tb > 1:
        return _ranked(_by_clusters(probes, train, k, block, tb), k)
    kind, train_kind = probes.schema["probe"].dataType.simpleString(), train.schema["train"].dataType.simpleString()
    left = probes.select(F.pmod(F.xxhash64("probe"), F.lit(pb)).alias("_p"), F.explode(F.sequence(F.lit(0), F.lit(tb - 1))).alias("_t"), "probe", "x", *fold)
    right = train.select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(pb - 1).cast("long"))).alias("_p"), F.pmod(F.xxhash64("train"), F.lit(tb)).cast("int").alias("_t"), "train", "x", *fold)
    return _ranked(left.groupBy("_p", "_t").cogroup(right.groupBy("_p", "_t")).applyInPandas(_best(metric, k), f"probe {kind}, train {train_kind}, d2 double"), k)


def _by_clusters(probes: DataFrame, train: DataFrame, k: int, block: int, train_blocks: int, most: int = 4096) -> DataFrame:
    """Candidates that hold the k nearest: training rows are dealt to the nearest of some centres, drawn among them. A probe first meets
    the cluster of its own centre (with folds, the nearest that has a row of another fold), which bounds its k-th distance; then only clusters that may have a nearer row, as by the triangle
    inequality none is nearer than the centre's distance less the cluster's radius. What clusters there are never changes the result.

    Clusters that lie together make bundles of up to `block` rows. A probe goes once to each bundle with clusters that it asks for, and probes of one bundle
    make blocks, so that a bundle moves to its own blocks of probes and to those near it. A task has one bundle, or part of a cluster, and one block of probes.
    """
    size = train.count()
    n = min(most, 4 * train_blocks + math.isqrt(size))
    centres = np.array([r["x"] for r in train.orderBy(F.xxhash64("train")).limit(n).collect()])
    shared = train.sparkSession.sparkContext.broadcast(centres)
    kinds = [df.schema[c].dataType.simpleString() for df, c in ((probes, "probe"), (train, "train"))]
    fold = [c for c in ("fold",) if c in probes.columns]
    fold_kind = "".join(f", fold {probes.schema[c].dataType.simpleString()}" for c in fold)

    def dealt(batches):
        for b in batches:
            if len(b):
                b["c"], b["d"] = _own_centre(np.stack(b["x"].to_numpy()), shared.value)
                yield b

    def opened(b: pd.DataFrame) -> np.ndarray:
        """Which clusters have a row that each probe may be near to: with folds, one of another fold."""
        there = np.broadcast_to(rows > 0, (len(b), n))
        if not fold:
            return there
        mine = b["fold"].to_numpy()[:, None]
        return there & ~((low == mine) & (high == mine))

    def begun(batches):
        for b in batches:
            if len(b):
                b["c"], _ = _own_centre(np.stack(b["x"].to_numpy()), shared.value, opened(b))
                yield b

    own = saved(train.mapInPandas(dealt, f"train {kinds[1]}, x array<double>{fold_kind}, c int, d double"))
    found = own.groupBy("c").agg(F.max("d").alias("r"), F.count("*").alias("n"), *(f(c).alias(k) for c in fold for f, k in ((F.min, "low"), (F.max, "high")))).collect()
    radius, rows, low, high = np.full(n, -1.0), np.zeros(n, dtype=np.int64), np.full(n, None), np.full(n, None)
    for row in found:
        radius[row["c"]], rows[row["c"]] = row["r"], row["n"]
        if fold:
            low[row["c"]], high[row["c"]] = row["low"], row["high"]
    bundle = _bundles(centres, rows, block)
    by_bundle = np.argsort(bundle, kind="stable")
    table = train.sparkSession.createDataFrame([(c, int(bundle[c]), max(1, -(-int(rows[c]) // block))) for c in range(n) if rows[c]], "c int, g int, parts int")

    def meet(asked: DataFrame) -> DataFrame:
        """Probes (probe, x, g, cs, _bound, _p) against the clusters cs of the bundles g; a bundle moves only to the blocks of probes that ask for it."""
        left = asked.join(F.broadcast(table.groupBy("g").agg(F.max("parts").alias("parts"))), "g").withColumn("_t", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        right = own.join(F.broadcast(table), "c").join(asked.select("g", F.col("_p").alias("_to")).distinct(), "g").select("train", "x", *fold, "c", "g", F.pmod(F.xxhash64("train"), F.col("parts")).cast("int").alias("_t"), F.col("_to").alias("_p"))
        left = left.select("g", "_t", "_p", "probe", "x", *fold, "cs", "_bound")
        return left.groupBy("g", "_t", "_p").cogroup(right.groupBy("g", "_t", "_p")).applyInPandas(_best_of_clusters(k), f"probe {kinds[0]}, train {kinds[1]}, d2 double")

    first = saved(probes.mapInPandas(begun, f"probe {kinds[0]}, x array<double>{fold_kind}, c int"))
    sizes = np.zeros(bundle.max() + 1, dtype=np.int64)
    for row in first.groupBy("c").count().collect():
        sizes[bundle[row["c"]]] += row["count"]
    blocks = np.maximum(1, -(-sizes // block))
    begins = np.cumsum(blocks) - blocks
    placed = train.sparkSession.createDataFrame([(c, int(bundle[c]), int(begins[bundle[c]]), int(blocks[bundle[c]])) for c in range(n)], "c int, g int, _begin long, _blocks long")
    first = first.join(F.broadcast(placed), "c").withColumn("_p", F.col("_begin") + F.pmod(F.xxhash64("probe"), F.col("_blocks"))).select("probe", "x", *fold, "c", "g", "_p")
    near = saved(meet(first.withColumns({"cs": F.array("c"), "_bound": F.lit(None).cast("double")})))
    bound = near.groupBy("probe").agg(F.when(F.count("*") >= k, F.sort_array(F.collect_list("d2"))[k - 1]).alias("_bound"))

    def others(batches):
        for b in batches:
            for at in range(0, len(b), 1024):
                part = b.iloc[at : at + 1024]
                away = np.sqrt(_distances(0, np.stack(part["x"].to_numpy()), shared.value)) - radius
                limit = np.sqrt(part["_bound"].to_numpy(dtype=float, na_value=np.inf))
                may = (away <= np.where(np.isnan(limit), np.inf, limit)[:, None] * (1 + 1e-9) + 1e-9) & opened(part)
                may[np.arange(len(part)), part["c"]] = False
                i, c = np.nonzero(may[:, by_bundle])
                c = by_bundle[c]
                if len(i):
                    new = np.flatnonzero(np.diff(i) | np.diff(bundle[c])) + 1
                    starts = np.concatenate([[0], new])
                    yield pd.DataFrame({name: part[name].to_numpy()[i[starts]] for name in ("probe", "x", *fold, "_bound", "_p")} | {"g": bundle[c[starts]], "cs": np.split(c, new)})

    asked = saved(first.join(bound, "probe", "left").mapInPandas(others, f"probe {kinds[0]}, x array<double>{fold_kind}, _bound double, _p long, g int, cs array<int>"))
    return near.unionByName(meet(asked))


def confidence(p, classes: int):
    """(n p - 1) / (n - 1): 0 for an even guess, 1 for certainty."""
    return (classes * p - 1) / (classes - 1)


def knn_classify(near: DataFrame, labels: DataFrame, k: int, classes: int) -> DataFrame:
    """Votes of the k nearest; ties go to the lowest label. A neighbour labelled -1 takes its place among the k but has no vote."""
    votes = near.where(F.col("rank") <= k).join(labels.select(F.col("id").alias("train"), "label"), "train").where("label <> -1").groupBy("probe", "label").agg(F.count("*").alias("n"))
    won = votes.groupBy("probe").agg(F.max_by("label", F.struct("n", -F.col("label"))).alias("label"), F.max("n").alias("n"))
    p = F.col("n") / F.lit(k)
    return won.select("probe", "label", p.alias("p"), confidence(p, classes).alias("con"))


def knn_regress(near: DataFrame, values: DataFrame, k: int) -> DataFrame:
    """Mean and standard deviation of the k nearest rows' ordinates."""
    return near.where(F.col("rank") <= k).join(values.select(F.col("id").alias("train"), "y"), "train").groupBy("probe").agg(F.avg("y").alias("y"), F.stddev_samp("y").alias("std"))


def knn_density(near: DataFrame, k: int, dimensions: int, rows: int) -> DataFrame:
    """k points in the ball whose radius lies midway between the k-th and the next; needs k + 1 neighbours."""
    radius = near.where(F.col("rank").isin(k, k + 1)).groupBy("probe").agg(F.avg(F.sqrt("d2")).alias("r"))
    constant = math.gamma(dimensions / 2 + 1) * k / (math.pi ** (dimensions / 2) * rows)
    return radius.select("probe", F.log(F.lit(constant)).alias("_c"), "r").select("probe", "r", (F.col("_c") - dimensions * F.log("r")).alias("log_pdf"))


def knn_joint(near: DataFrame, labels: DataFrame, k: int, dimensions: int, rows: int) -> DataFrame:
    """(probe, label, log_p): log of P(x, label), the k-NN density's share of each class among the k; needs k + 1 neighbours."""
    each = near.where(F.col("rank") <= k).join(labels.select(F.col("id").alias("train"), "label"), "train").where("label <> -1").groupBy("probe", "label").agg(F.count("*").alias("n"))
    density = knn_density(near, k, dimensions, rows)
    return each.join(density, "probe").select("probe", "label", (F.col("log_pdf") + F.log(F.col("n") / k)).alias("log_p"))
