"""Class borders: points where two classes are equally likely, with gradients; they stand in for all training data."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import false_position
from ..functions.vectors import dot
from ..session import ship
from .graph import saved
from .neighbours import _distances, _rows, nearest


def difference(x: np.ndarray, points: np.ndarray, sign: np.ndarray, variance: float) -> tuple[float, np.ndarray]:
    """R = P(1) - P(0) at x and its gradient, by Gaussian weights."""
    d = points - x
    d2 = (d * d).sum(axis=1)
    w = np.exp(-(d2 - d2.min()) / (2 * variance))
    total = w.sum()
    r = float(sign @ w / total)
    slope = ((sign - r) * w) @ d / (total * variance)
    return r, slope


def train(df: DataFrame, pairs: int, variance: float, sample: int = 2000, r0: float = 0.0) -> DataFrame:
    """(k, border, grad) at R = r0 on segments between `pairs` pairs of opposite classes (label 0 and 1).

    The model is fitted on a sample of at most `sample` rows, which the tasks that search the segments share. Pairs are
    drawn by hash without repeats."""
    spark = ship(df.sparkSession)
    rows = df.orderBy(F.xxhash64("id"), "id").limit(sample).collect()
    x, label = np.array([r["x"] for r in rows], dtype=float), np.array([r["label"] for r in rows])
    sign = np.where(label > 0, 1.0, -1.0)
    zero, one = np.flatnonzero(label == 0), np.flatnonzero(label > 0)
    rng = np.random.default_rng(1)
    drawn = rng.choice(len(zero) * len(one), min(pairs, len(zero) * len(one)), replace=False)
    todo = spark.createDataFrame([(k, int(zero[p // len(one)]), int(one[p % len(one)])) for k, p in enumerate(drawn.tolist())], "k int, a int, b int")
    shared = spark.sparkContext.broadcast((x, sign))

    def search(batches):
        x, sign = shared.value
        for batch in batches:
            out = []
            for k, a, b in batch.itertuples(index=False):
                at = lambda t: x[a] + t * (x[b] - x[a])
                f = lambda t: difference(at(t), x, sign, variance)[0] - r0
                if f(0) * f(1) < 0:
                    t = false_position(f, 0.0, 1.0, 1e-10)
                    out.append((k, at(t).tolist(), difference(at(t), x, sign, variance)[1].tolist()))
            yield pd.DataFrame(out, columns=["k", "border", "grad"])

    return todo.repartition(8).mapInPandas(search, "k int, border array<double>, grad array<double>")


def classify(probes: DataFrame, borders: DataFrame) -> DataFrame:
    """(id, k, r, cls): the nearest border point, tanh(grad . (x - border)) and its sign."""
    near = nearest(probes.select("id", "x"), borders.select(F.col("k").alias("id"), F.col("border").alias("x")), 1)
    found = near.select(F.col("probe").alias("id"), F.col("train").alias("k")).join(probes, "id").join(borders, "k")
    away = F.zip_with("x", "border", lambda a, b: a.cast("double") - b.cast("double"))
    return found.select("id", "k", F.tanh(dot(F.col("grad"), away)).alias("r")).withColumn("cls", (F.col("r") > 0).cast("int"))


def weighted_sums(probes: DataFrame, rows: DataFrame, variance: float, block: int = 5_000) -> DataFrame:
    """(probe, w, r, s, g): with Gaussian weights w_i = exp(-d2 / 2 variance) of rows (id, x, c) at probes (id, x), the sums of w_i and c_i w_i, and the vectors of w_i (x_i - x) and
    c_i w_i (x_i - x). Blocks of both sides meet; a task returns one row of partial sums for each of its probes, and Spark adds them."""
    ship(probes.sparkSession)
    left = _rows(probes, "probe")
    right = _rows(rows, "row").join(rows.select(F.col("id").alias("row"), F.col("c").cast("double").alias("c")), "row")
    kind = left.schema["probe"].dataType.simpleString()
    pb, tb = (max(1, math.ceil(df.count() / block)) for df in (left, right))

    def summed(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame({"probe": [], "sums": []})]
        if len(a) and len(b):
            x, c = np.stack(b["x"].to_numpy()), b["c"].to_numpy()
            for at in range(0, len(a), 256):
                some = a.iloc[at : at + 256]
                p = np.stack(some["x"].to_numpy())
                w = np.exp(-_distances(0, p, x) / (2 * variance))
                total, signed = w.sum(axis=1), w @ c
                sums = np.concatenate([total[:, None], signed[:, None], w @ x - total[:, None] * p, (w * c) @ x - signed[:, None] * p], axis=1)
                out.append(pd.DataFrame({"probe": some["probe"].to_numpy(), "sums": sums.tolist()}))
        return pd.concat(out)

    number = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    all_ = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = left.select("probe", "x", number("probe", pb).alias("_p"), all_(tb).alias("_t"))
    right = right.select("x", "c", number("row", tb).alias("_t"), all_(pb).alias("_p"))
    found = left.groupBy("_p", "_t").cogroup(right.groupBy("_p", "_t")).applyInPandas(summed, f"probe {kind}, sums array<double>")
    each = found.select("probe", F.posexplode("sums").alias("k", "v")).groupBy("probe", "k").agg(F.sum("v").alias("v"))
    whole = each.groupBy("probe").agg(F.transform(F.sort_array(F.collect_list(F.struct("k", "v"))), lambda e: e["v"]).alias("_s"))
    size = ((F.size("_s") - 2) / 2).cast("int")
    return whole.select("probe", F.col("_s")[0].alias("w"), F.col("_s")[1].alias("r"), F.slice("_s", F.lit(3), size).alias("s"), F.slice("_s", size + 3, size).alias("g"))


#: A model: (id, r, grad) at places (id, x); classes change where r passes 0.
Model = Callable[[DataFrame], DataFrame]


def class_difference(rows: DataFrame, variance: float) -> Model:
    """R = P(1) - P(0) by Gaussian weights of rows (id, x, label 0 or 1), all of them at every place."""
    signed = saved(rows.select("id", "x", F.when(F.col("label") > 0, 1.0).otherwise(-1.0).alias("c")))

    def model(at: DataFrame) -> DataFrame:
        sums = weighted_sums(at, signed, variance)
        r = F.col("r") / F.col("w")
        slope: Column = F.zip_with("g", "s", lambda g, s: (g - r * s) / (variance * F.col("w")))
        return sums.select(F.col("probe").alias("id"), r.alias("r"), slope.alias("grad"))

    return model


def kernel_machine(support: DataFrame, gamma: float, offset: float) -> Model:
    """A decision function sum(c exp(-gamma d2)) + offset over support vectors (id, x, c)."""
    held = saved(support.select("id", "x", "c"))

    def model(at: DataFrame) -> DataFrame:
        sums = weighted_sums(at, held, 1 / (2 * gamma))
        return sums.select(F.col("probe").alias("id"), (F.col("r") + offset).alias("r"), F.transform("g", lambda g: 2 * gamma * g).alias("grad"))

    return model


def opposite(df: DataFrame, pairs: int) -> DataFrame:
    """(k, a, b): vectors of `pairs` pairs of rows (id, x, label) of both classes, the k-th of either in the order of a hash, over again where a class has fewer."""
    order = lambda seed: [F.xxhash64(F.lit(seed), "id"), F.col("id")]
    first = lambda c, seed: saved(_placed(df.where(c).orderBy(*order(seed)).limit(pairs), order(seed)))
    zero, one = first(F.col("label") == 0, 1), first(F.col("label") > 0, 2)
    n0, n1 = zero.count(), one.count()
    if not n0 or not n1:
        return df.sparkSession.createDataFrame([], "k long, a array<double>, b array<double>")
    ks = df.sparkSession.range(pairs).select(F.col("id").alias("k"), (F.col("id") % n0).alias("_a"), ((F.col("id") + F.floor(F.col("id") / n0)) % n1).alias("_b"))
    pick = lambda rows, key, name: rows.select(F.col("position").alias(key), F.col("x").cast("array<double>").alias(name))
    return ks.join(pick(zero, "_a", "a"), "_a").join(pick(one, "_b", "b"), "_b").select("k", "a", "b")


def _placed(rows: DataFrame, order: list[Column]) -> DataFrame:
    from .order import positions

    keys = [f"_o{k}" for k in range(len(order))]
    return positions(rows.select("id", "x", *(o.alias(k) for o, k in zip(order, keys, strict=True))), keys)


def train_model(model: Model, segments: DataFrame, tolerance: float = 1e-6, most: int = 60) -> DataFrame:
    """(k, border, grad): where a model's r passes 0 on segments (k, a, b), and its gradient there; segments whose ends have one sign are left out.

    All open segments are bracketed together: in each round every one of them tries the place where a line between its ends is 0 (an end that stays twice counts by half), all places
    go through the model at once, by one join in blocks, and a segment is done when |r| is below the tolerance. The state is saved each round.
    """
    at = lambda t: F.zip_with("a", "b", lambda a, b: a + t * (b - a))
    ends = segments.select(F.col("k").alias("id"), F.col("a").alias("x")), segments.select(F.col("k").alias("id"), F.col("b").alias("x"))
    r = [model(e).select(F.col("id").alias("k"), F.col("r").alias(n)) for e, n in zip(ends, ("ra", "rb"), strict=True)]
    state = segments.join(r[0], "k").join(r[1], "k").where("ra * rb < 0").select("k", "a", "b", F.lit(0.0).alias("ta"), F.lit(1.0).alias("tb"), "ra", "rb", F.lit(0).alias("kept"))
    state, done = saved(state), None
    for _ in range(most):
        if state.isEmpty():
            break
        t = F.col("ta") - F.col("ra") * (F.col("tb") - F.col("ta")) / (F.col("rb") - F.col("ra"))
        tried = saved(state.withColumn("t", t).withColumn("x", at(F.col("t"))))
        found = model(tried.select(F.col("k").alias("id"), "x")).select(F.col("id").alias("k"), "r", "grad")
        met = saved(tried.join(found, "k"))
        near = F.abs("r") < tolerance
        got = met.where(near).select("k", F.col("x").alias("border"), "grad")
        done = got if done is None else done.unionByName(got)
        left = F.col("r") * F.col("ra") > 0
        half = lambda value, side: F.when(F.col("kept") == side, F.col(value) / 2).otherwise(F.col(value))
        state = met.where(~near).select(
            "k", "a", "b", F.when(left, F.col("t")).otherwise(F.col("ta")).alias("ta"), F.when(left, F.col("tb")).otherwise(F.col("t")).alias("tb"),
            F.when(left, F.col("r")).otherwise(half("ra", -1)).alias("ra"), F.when(left, half("rb", 1)).otherwise(F.col("r")).alias("rb"), F.when(left, 1).otherwise(-1).alias("kept"),
        )
    empty = segments.sparkSession.createDataFrame([], f"k {segments.schema['k'].dataType.simpleString()}, border array<double>, grad array<double>")
    return empty if done is None else done
