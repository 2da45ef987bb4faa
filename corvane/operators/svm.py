"""Kernel decision functions, their use as several binary models at once, and plug-in classifiers."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import dot
from ..session import ship
from .neighbours import _distances as distances

#: Support vectors that may be broadcast for other kernels; more are joined in blocks of about 1000, by the block's number.
BROADCAST_VECTORS = 20_000
#: Probes and support vectors of a block, and pairs of them that a task takes at once.
PROBES, VECTORS, PAIRS = 8_000, 20_000, 4_000_000


def _radial(x: np.ndarray, v: np.ndarray, gamma: float) -> np.ndarray:
    """exp(-gamma d2) of all pairs; squared distances by one product of matrices unless its rounding could be seen in the ninth place."""
    with np.errstate(over="ignore", invalid="ignore"):
        own, other = (x * x).sum(axis=1), (v * v).sum(axis=1)
        d2 = own[:, None] + other - 2 * (x @ v.T)
        error = abs(gamma) * 4 * (x.shape[1] + 4) * np.finfo(float).eps * (own.max(initial=0) + other.max(initial=0))
    return np.exp(-gamma * (np.maximum(d2, 0) if error < 1e-9 else distances(0, x, v)))


def _summed(probes: DataFrame, vectors: DataFrame, models: list, width: int, sums: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]) -> DataFrame:
    """(id, _0, _1, ...): the `width` numbers that `sums` returns for each probe from a block of support vectors and their alphas by model, added over all blocks.

    Blocks of probes meet blocks of vectors, neither is broadcast, and a task returns one array for each of its probes, whatever the vectors. A vector shared by models has
    its kernel value computed once. Vectors that are null, have a null or another length than the probe's add nothing.
    """
    ship(probes.sparkSession)
    whole = lambda df, c: df.withColumn(c, F.col(c).cast("array<double>")).where(F.col(c).isNotNull() & ~F.exists(c, lambda e: e.isNull()))
    number = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    all_ = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    alphas = F.array(*(F.coalesce(F.sum(F.when(F.col("model") == m, F.col("alpha").cast("double"))), F.lit(0.0)) for m in models))
    left, right = whole(probes.select("id", "x"), "x"), whole(vectors, "v").groupBy("v").agg(alphas.alias("alpha"))
    pb, vb = max(1, -(-left.count() // PROBES)), max(1, -(-vectors.count() // VECTORS))
    left = left.select("id", "x", F.size("x").alias("_n"), number("id", pb).alias("_p"), all_(vb).alias("_v"))
    right = right.select("v", "alpha", F.size("v").alias("_n"), number("v", vb).alias("_v"), all_(pb).alias("_p"))

    def met(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a):
            return pd.DataFrame({"id": [], "f": []})
        if not len(b):
            return pd.DataFrame({"id": a["id"], "f": [None] * len(a)})
        x, v, alpha = (np.stack(c.to_numpy()) for c in (a["x"], b["v"], b["alpha"]))
        centre = v.mean(axis=0)  # only differences count; small numbers lose less
        x, v = x - centre, v - centre
        rows = max(1, PAIRS // len(v))
        return pd.DataFrame({"id": a["id"], "f": np.concatenate([sums(x[k : k + rows], v, alpha) for k in range(0, len(x), rows)]).tolist()})

    keys = ["_p", "_v", "_n"]
    parts = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(met, f"id {probes.schema['id'].dataType.simpleString()}, f array<double>")
    found = parts.groupBy("id").agg(*(F.sum(F.get("f", F.lit(k))).alias(f"_{k}") for k in range(width)))
    return probes.select("id").distinct().join(found, "id", "left")


def decisions(probes: DataFrame, vectors: DataFrame, gamma: float, rho: dict[int, float], kernel: Callable[[Column, Column], Column] | None = None) -> DataFrame:
    """(id, model, f): sum of alpha K(x, v) - rho for each binary model, with a radial kernel or any other of functions.vectors.

    `vectors` (v, model, alpha): a vector shared by models has a row for each, but its kernel value is computed once. Radial kernels are taken by
    products of matrices, block by block (see _summed); others row by row, where more than BROADCAST_VECTORS are joined in blocks.
    """
    shift = F.create_map(*[F.lit(y) for k, v in rho.items() for y in (k, float(v))])
    if kernel is None:
        kind = vectors.schema["model"].dataType
        models = [m for (m,) in vectors.select("model").where("model is not null").distinct().orderBy("model").collect()]
        if not models:
            return probes.select("id", F.lit(None).cast(kind).alias("model"), F.lit(None).cast("double").alias("f")).where("false")
        found = _summed(probes, vectors, models, len(models), lambda x, v, alpha: _radial(x, v, gamma) @ alpha)
        each = F.explode(F.array(*(F.struct(F.lit(m).cast(kind).alias("model"), F.col(f"_{k}").alias("f")) for k, m in enumerate(models))))
        return found.select("id", each.alias("_e")).select("id", "_e.model", (F.col("_e.f") - shift[F.col("_e.model")]).alias("f"))
    each = vectors.groupBy("v").agg(F.collect_list(F.struct("model", "alpha")).alias("_of"))  # as long as there are models
    n = each.count()
    blocks = max(1, n // 1000) if n > BROADCAST_VECTORS else 1
    side = each.withColumn("_b", F.pmod(F.xxhash64("v"), F.lit(blocks)).cast("int"))
    asked = probes.select("id", "x", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("_b"))
    pairs = asked.join(F.broadcast(side) if blocks == 1 else side, "_b").select("id", kernel(F.col("x"), F.col("v")).alias("k"), F.explode("_of").alias("_m"))
    sums = pairs.groupBy("id", F.col("_m.model").alias("model")).agg(F.sum(F.col("k") * F.col("_m.alpha")).alias("f"))
    return sums.select("id", "model", (F.col("f") - shift[F.col("model")]).alias("f"))


def decision_gradients(probes: DataFrame, vectors: DataFrame, gamma: float) -> DataFrame:
    """(id, model, j, slope): the derivative of each radial decision function along each feature j, the sum of -2 gamma alpha (x_j - v_j) K.

    Blocks of probes meet blocks of vectors as in decisions(); a task returns models times features numbers for each of its probes."""
    kind = vectors.schema["model"].dataType
    models = [m for (m,) in vectors.select("model").where("model is not null").distinct().orderBy("model").collect()]
    features = probes.select(F.max(F.size("x"))).first()[0] or 0

    def slopes(x: np.ndarray, v: np.ndarray, alpha: np.ndarray) -> np.ndarray:
        k, out = _radial(x, v, gamma), np.full((len(x), len(models), features), np.nan)
        for m in range(len(models)):
            w = k * alpha[:, m]
            out[:, m, : x.shape[1]] = -2 * gamma * (w.sum(axis=1)[:, None] * x - w @ v)
        return out.reshape(len(x), -1)

    found = _summed(probes, vectors, models, len(models) * features, slopes)
    length = probes.groupBy("id").agg(F.max(F.size("x")).alias("_n"))
    each = lambda m: F.posexplode(F.slice(F.array(*(F.col(f"_{m * features + j}") for j in range(features))), F.lit(1), F.greatest("_n", F.lit(0)))).alias("j", "slope")
    out = [found.join(length, "id").select("id", F.lit(name).cast(kind).alias("model"), each(m)) for m, name in enumerate(models)]
    return reduce(DataFrame.unionByName, out) if out and features else probes.select("id", F.lit(None).cast(kind).alias("model"), F.lit(0).alias("j"), F.lit(0.0).alias("slope")).where("false")


def probability(f, a: float, b: float):
    """1 / (1 + exp(a f + b))."""
    return 1 / (1 + F.exp(a * f + b))


def linear_decision(df: DataFrame, weights: list[float], shift: float) -> DataFrame:
    return df.withColumn("f", dot(F.col("x"), F.array(*map(F.lit, weights))) + shift)


def distinct_vectors(models: list[DataFrame]) -> DataFrame:
    """(number, v) of different support vectors of several models (v)."""
    from .sets import unify

    return unify([m.select("v") for m in models])


def plug_in(df: DataFrame, predict: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """(id, p...) by any Python predictor of a batch of vectors into rows of class probabilities."""
    ship(df.sparkSession)
    kind = df.schema["id"].dataType.simpleString()

    def run(batches):
        for b in batches:
            p = predict(np.stack(b["x"].to_numpy())) if len(b) else np.zeros((0, 1))
            yield pd.DataFrame({"id": b["id"], "p": list(p)})

    return df.select("id", "x").mapInPandas(run, f"id {kind}, p array<double>")


def continuum(r: DataFrame, thresholds: list[float]) -> DataFrame:
    """(id, y): an ordinate from R of classifiers at rising thresholds (id, row, r): the threshold at which the line through the
    points (atanh r, threshold), by least squares, crosses 0."""
    at = F.create_map(*[F.lit(x) for k, t in enumerate(thresholds) for x in (k, float(t))])
    d = r.withColumns({"_t": at[F.col("row")], "_d": F.atanh(F.greatest(F.least("r", F.lit(0.999999)), F.lit(-0.999999)))})
    return d.groupBy("id").agg(F.coalesce(F.regr_intercept("_t", "_d"), F.avg("_t")).alias("y"))
