"""Adaptive Gaussian kernels: a kernel whose width gives a set total weight, over each probe's neighbours."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship
from .graph import saved
from .neighbours import _rows, squared


def bandwidths(d2: np.ndarray, weight: float, tolerance: float = 1e-9, most: int = 200) -> np.ndarray:
    """Variances with sum(exp(-d2 / 2 variance)) = weight in each row, by bisection on the logarithm; no state is kept between rows.

    An infinite d2 counts for nothing. A row with fewer than `weight` neighbours can't reach it: its variance is the upper bracket.
    """
    low = np.maximum(d2.min(axis=1), 1e-300) * 1e-6
    high = np.maximum(np.where(np.isfinite(d2), d2, 0).max(axis=1), 1e-300) * 1e6
    low, high = np.log(low), np.log(high)
    for _ in range(most):
        middle = (low + high) / 2
        more = np.exp(-d2 / (2 * np.exp(middle)[:, None])).sum(axis=1) > weight
        high, low = np.where(more, middle, high), np.where(more, low, middle)
        if np.all(high - low < tolerance):
            break
    return np.exp((low + high) / 2)


def _solved(batch: pa.RecordBatch, weight: float, probes: int = 1024) -> Iterator[pa.RecordBatch]:
    """Rows (probe, train, d2, variance, w) of lists (probe, [(d2, train)]), so many probes at a time; the lists stay Arrow's and no row becomes a Python object."""
    for at in range(0, batch.num_rows, probes):
        part = batch.slice(at, probes)
        sizes = np.diff(part.column(1).offsets.to_numpy())
        flat, train = part.column(1).flatten().flatten()
        flat = flat.to_numpy(zero_copy_only=False)
        d2 = np.full((len(sizes), sizes.max(initial=1)), np.inf)
        d2[np.arange(d2.shape[1]) < sizes[:, None]] = flat
        variance = np.repeat(bandwidths(d2, weight), sizes)
        probe = part.column(0).take(pa.array(np.repeat(np.arange(len(sizes)), sizes)))
        yield pa.RecordBatch.from_arrays([probe, train, pa.array(flat), pa.array(variance), pa.array(np.exp(-flat / (2 * variance)))], names=["probe", "train", "d2", "variance", "w"])


def weights(near: DataFrame, weight: float) -> DataFrame:
    """(probe, train, d2, variance, w) of the neighbours that `nearest` returned: one list for each probe, k long."""
    ship(near.sparkSession)
    lists = near.groupBy("probe").agg(F.sort_array(F.collect_list(F.struct("d2", "train"))).alias("_near"))

    def solve(batches):
        for batch in batches:
            yield from _solved(batch, weight)

    kinds = {f.name: f.dataType.simpleString() for f in near.schema}
    return lists.mapInArrow(solve, f"probe {kinds['probe']}, train {kinds['train']}, d2 double, variance double, w double")


def density(weighted: DataFrame, dimensions: int, rows: int) -> DataFrame:
    """log of sum(w) / ((2 pi variance) ^ (D / 2) n)."""
    volume = dimensions / 2 * F.log(2 * math.pi * F.first("variance"))
    return weighted.groupBy("probe").agg((F.log(F.sum("w")) - volume - math.log(rows)).alias("log_pdf"), F.sum("w").alias("total"))


def regress(weighted: DataFrame, values: DataFrame) -> DataFrame:
    """sum(w y) / sum(w), with the weighted mean square of what is left and its root."""
    joined = weighted.join(values.select(F.col("id").alias("train"), "y"), "train")
    out = joined.groupBy("probe").agg((F.sum(F.col("w") * F.col("y")) / F.sum("w")).alias("y"), (F.sum(F.col("w") * F.col("y") * F.col("y")) / F.sum("w")).alias("_y2"))
    mse = F.greatest(F.col("_y2") - F.col("y") * F.col("y"), F.lit(0.0))
    return out.select("probe", "y", mse.alias("mse"), F.sqrt(mse).alias("rmse"))


def classify(weighted: DataFrame, labels: DataFrame) -> DataFrame:
    """Conditional probability of the likeliest class; ties go to the lowest label."""
    each = weighted.join(labels.select(F.col("id").alias("train"), "label"), "train").where("label <> -1").groupBy("probe", "label").agg(F.sum("w").alias("w"))
    return each.groupBy("probe").agg(F.max_by("label", F.struct("w", -F.col("label"))).alias("label"), (F.max("w") / F.sum("w")).alias("p"))


def two_class_difference(weighted: DataFrame, labels: DataFrame) -> DataFrame:
    """R = P(1) - P(0) at each probe."""
    sign = F.when(F.col("label") > 0, 1.0).otherwise(-1.0)
    return weighted.join(labels.select(F.col("id").alias("train"), "label"), "train").groupBy("probe").agg((F.sum(sign * F.col("w")) / F.sum("w")).alias("r"))


def joint(weighted: DataFrame, labels: DataFrame, dimensions: int, rows: int) -> DataFrame:
    """(probe, label, log_p): log of P(x, label), the density's share of each class that a probe has neighbours of."""
    volume = dimensions / 2 * F.log(2 * math.pi * F.first("variance"))
    each = weighted.join(labels.select(F.col("id").alias("train"), "label"), "train").where("label <> -1")
    return each.groupBy("probe", "label").agg((F.log(F.sum("w")) - volume - math.log(rows)).alias("log_p"))


def gradients(weighted: DataFrame, probes: DataFrame, train: DataFrame) -> DataFrame:
    """(probe, r, grad_r, grad_log_pdf) at each probe (id, x) from the weights of training rows (id, x, label).

    r is the difference of the conditional probabilities of classes above 0 and others. As the total weight W is held, the width v changes with
    the place: sum(dw) = 0 gives dv/dx = -2 v S / Q with S = sum(w (x_i - x)) and Q = sum(w d2). So a weight's derivative is w (x_i - x - d2 S / Q) / v,
    that of r is (sum(s w (x_i - x)) - sum(s w d2) S / Q) / (v W) with the signs s, and that of log of the density D S / Q.
    All are sums over neighbours, by dimension; which rows are neighbours is taken as fixed. A probe whose neighbours all lie on it has null gradients.
    """
    sign = F.when(F.col("label") > 0, 1.0).otherwise(-1.0)
    at = probes.select(F.col("id").alias("probe"), F.col("x").cast("array<double>").alias("_at"))
    met = weighted.join(train.select(F.col("id").alias("train"), F.col("x").cast("array<double>").alias("x"), sign.alias("s")), "train").join(at, "probe")
    away = met.select("probe", "s", "w", "d2", "variance", F.posexplode(F.zip_with("x", "_at", lambda a, b: a - b)).alias("j", "away"))
    total = lambda c: F.sum(F.col("w") * c)
    sums = away.groupBy("probe", "j").agg(
        F.first("variance").alias("v"), F.sum("w").alias("W"), total(F.col("s")).alias("R"), total(F.col("away")).alias("S"), total(F.col("d2")).alias("Q"),
        total(F.col("s") * F.col("away")).alias("A"), total(F.col("s") * F.col("d2")).alias("B"),
    )
    turn = F.try_divide(F.col("S"), F.col("Q"))
    each = sums.select("probe", "j", (F.col("R") / F.col("W")).alias("r"), ((F.col("A") - F.col("B") * turn) / (F.col("v") * F.col("W"))).alias("g"), turn.alias("t"))
    lists = each.groupBy("probe").agg(F.first("r").alias("r"), F.sort_array(F.collect_list(F.struct("j", "g", "t"))).alias("_l"))
    return lists.select("probe", "r", F.transform("_l", lambda e: e["g"]).alias("grad_r"), F.transform("_l", lambda e: e["t"] * F.size("_l")).alias("grad_log_pdf"))


def regress_linear(weighted: DataFrame, probes: DataFrame, train: DataFrame) -> DataFrame:
    """(probe, y, gradient, mse, rmse) at each probe (id, x) from the weights of training rows (id, x, y).

    The estimate is regress's; its gradient is that of the estimate itself, whose width changes with the place as in `gradients`. The error is the weighted mean
    square of what the plane through the estimate with this gradient leaves of the neighbours' ordinates, and its root. Neighbours without an ordinate
    are left out. A probe whose neighbours all lie on it has a null gradient, and the error is that about the estimate alone."""
    at = probes.select(F.col("id").alias("probe"), F.col("x").cast("array<double>").alias("_at"))
    rows = train.where("y IS NOT NULL").select(F.col("id").alias("train"), F.col("x").cast("array<double>").alias("x"), F.col("y").cast("double").alias("y"))
    met = weighted.join(rows, "train").join(at, "probe").select("probe", "w", "d2", "variance", "y", F.zip_with("x", "_at", lambda a, b: a - b).alias("away"))
    total = lambda c: F.sum(F.col("w") * c)
    sums = met.select("probe", "w", "d2", "variance", "y", F.posexplode("away").alias("j", "a")).groupBy("probe", "j").agg(
        F.first("variance").alias("v"), F.sum("w").alias("W"), total(F.col("y")).alias("Y"), total(F.col("a")).alias("S"), total(F.col("d2")).alias("Q"),
        total(F.col("y") * F.col("a")).alias("A"), total(F.col("y") * F.col("d2")).alias("B"),
    )
    slope = (F.col("A") - F.col("B") * F.try_divide(F.col("S"), F.col("Q"))) / (F.col("v") * F.col("W"))
    lists = sums.groupBy("probe").agg(F.first(F.col("Y") / F.col("W")).alias("_f"), F.transform(F.sort_array(F.collect_list(F.struct("j", slope.alias("g")))), lambda e: e["g"]).alias("gradient"))
    plane = F.aggregate(F.zip_with("away", "gradient", lambda a, g: a * F.coalesce(g, F.lit(0.0))), F.lit(0.0), lambda a, b: a + b)
    left = F.col("_f") + plane - F.col("y")
    out = met.join(lists, "probe").groupBy("probe").agg(F.first("_f").alias("y"), F.first("gradient").alias("gradient"), (total(left * left) / F.sum("w")).alias("mse"))
    return out.withColumn("rmse", F.sqrt("mse"))


def kernel_sums(probes: DataFrame, train: DataFrame, block: int = 5_000) -> DataFrame:
    """(probe, sums): sums of Gaussian kernels exp(-d2 / 2 v) over all training rows (id, x) at each probe (id, x, v), for each variance of its array v.

    Blocks of probes meet blocks of training rows; a task returns one array of partial sums for each of its probes, whatever the training rows, and
    Spark adds these. Rows without a whole vector are left out."""
    ship(probes.sparkSession)
    left, right = _rows(probes, "probe").join(probes.select(F.col("id").alias("probe"), "v"), "probe"), _rows(train, "train")
    kind = left.schema["probe"].dataType.simpleString()
    pb, tb = (max(1, math.ceil(df.count() / block)) for df in (left, right))

    def summed(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame({"probe": [], "sums": []})
        x, out = np.stack(b["x"].to_numpy()), []
        for at in range(0, len(a), 256):
            part = a.iloc[at : at + 256]
            v = np.stack(part["v"].to_numpy())
            d = squared(np.stack(part["x"].to_numpy()), x, 1e-9 * v.min())
            out += np.stack([np.exp(-d / (2 * v[:, k : k + 1])).sum(axis=1) for k in range(v.shape[1])], axis=1).tolist()
        return pd.DataFrame({"probe": a["probe"], "sums": out})

    number = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    all_ = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left, right = left.select("probe", "x", "v", number("probe", pb).alias("_p"), all_(tb).alias("_t")), right.select("train", "x", number("train", tb).alias("_t"), all_(pb).alias("_p"))
    found = left.groupBy("_p", "_t").cogroup(right.groupBy("_p", "_t")).applyInPandas(summed, f"probe {kind}, sums array<double>")
    return found.select("probe", F.posexplode("sums").alias("k", "s")).groupBy("probe", "k").agg(F.sum("s").alias("s")).groupBy("probe").agg(F.transform(F.sort_array(F.collect_list(F.struct("k", "s"))), lambda e: e["s"]).alias("sums"))


def optimal_density(probes: DataFrame, train: DataFrame, dimensions: int, low: float, high: float, trials: int = 12) -> DataFrame:
    """(probe, variance, pdf, error, laplacian): the density at the width that makes its expected error least, and that error.

    Sums at `trials` variances, in even ratios from `low` to `high`, are taken in one pass. At variance v an estimate has the mean P + v L / 2 and the variance
    P / (n (4 pi v) ^ (D / 2)), with the density P and its Laplacian L; both are fitted to the trials by least squares with weights
    v ^ (D / 2). The squared error (v L / 2)^2 + P / (n (4 pi v) ^ (D / 2)) is least at v ^ (D / 2 + 2) = D P / (n (4 pi) ^ (D / 2) L ^ 2), kept within low ... high, where a
    second pass takes the estimate. Where the fitted P isn't above 0 the widest trial's estimate stands for it.
    """
    n, half = train.count(), dimensions / 2
    tries = [low * (high / low) ** (k / (trials - 1)) for k in range(trials)]
    some = probes.select("id", "x")
    sums = saved(kernel_sums(some.withColumn("v", F.array(*map(F.lit, tries))), train))
    row = sums.select("probe", F.posexplode("sums").alias("k", "s")).withColumn("v", F.element_at(F.array(*map(F.lit, tries)), F.col("k") + 1))
    row = row.select("probe", "v", (F.col("s") / (n * F.pow(2 * math.pi * F.col("v"), F.lit(half)))).alias("p"), F.pow(F.col("v") / high, F.lit(half)).alias("w"), (F.col("v") / 2).alias("h"))
    w, h, p = F.col("w"), F.col("h"), F.col("p")
    fit = row.groupBy("probe").agg(F.sum(w).alias("w"), F.sum(w * h).alias("wh"), F.sum(w * h * h).alias("whh"), F.sum(w * p).alias("wp"), F.sum(w * h * p).alias("whp"), F.max_by("p", "v").alias("wide"))
    slope = (F.col("w") * F.col("whp") - F.col("wh") * F.col("wp")) / (F.col("w") * F.col("whh") - F.col("wh") * F.col("wh"))
    fit = fit.withColumn("laplacian", slope).withColumn("level", (F.col("wp") - F.col("laplacian") * F.col("wh")) / F.col("w"))
    fit = fit.withColumn("level", F.when(F.col("level") > 0, F.col("level")).otherwise(F.col("wide")))
    best = F.pow(F.try_divide(dimensions * F.col("level"), n * (4 * math.pi) ** half * F.col("laplacian") * F.col("laplacian")), F.lit(1 / (half + 2)))
    fit = saved(fit.select("probe", "laplacian", "level", F.least(F.greatest(F.coalesce(best, F.lit(high)), F.lit(low)), F.lit(high)).alias("variance")))
    at = some.join(fit.select(F.col("probe").alias("id"), F.array("variance").alias("v")), "id")
    pdf = F.element_at("sums", 1) / (n * F.pow(2 * math.pi * F.col("variance"), F.lit(half)))
    bias = F.col("variance") * F.col("laplacian") / 2
    error = F.sqrt(bias * bias + F.col("level") / (n * F.pow(4 * math.pi * F.col("variance"), F.lit(half))))
    return fit.join(kernel_sums(at, train), "probe").select("probe", "variance", pdf.alias("pdf"), error.alias("error"), "laplacian")
