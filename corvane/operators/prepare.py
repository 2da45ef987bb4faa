"""Feature selection, normalisation, relabelling, discretising, filters and splits."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import ship
from .sets import fold_number


def select_features(x: Column, indices: list[int]) -> Column:
    return F.array(*[F.get(x, F.lit(i)) for i in indices])


def feature_stats(df: DataFrame, x: str = "x") -> DataFrame:
    """Mean and standard deviation (n - 1) of each feature."""
    return df.select(F.posexplode(x).alias("j", "v")).groupBy("j").agg(F.avg(F.col("v").cast("double")).alias("ave"), F.stddev_samp(F.col("v").cast("double")).alias("std"))


def _stats_arrays(stats: DataFrame) -> DataFrame:
    """One row of arrays; as long as there are features."""
    s = F.sort_array(F.collect_list(F.struct("j", "ave", "std")))
    return stats.agg(s.alias("_s")).select(F.col("_s.ave").alias("_ave"), F.col("_s.std").alias("_std"))


def normalise(df: DataFrame, stats: DataFrame, x: str = "x") -> DataFrame:
    """(x - mean) / std; the statistics are one row, broadcast."""
    z = F.zip_with(F.zip_with(F.col(x), "_ave", lambda a, b: a.cast("double") - b), F.col("_std"), lambda a, b: a / b)
    return df.crossJoin(F.broadcast(_stats_arrays(stats))).withColumn(x, z).drop("_ave", "_std")


def unnormalise(df: DataFrame, stats: DataFrame, x: str = "x") -> DataFrame:
    z = F.zip_with(F.zip_with(F.col(x), "_std", lambda a, b: a * b), F.col("_ave"), lambda a, b: a + b)
    return df.crossJoin(F.broadcast(_stats_arrays(stats))).withColumn(x, z).drop("_ave", "_std")


def affine(x: Column, shift: list[float], matrix: list[list[float]]) -> Column:
    """(x - shift) M, the matrix given by rows."""
    moved = [F.get(x, F.lit(i)).cast("double") - F.lit(b) for i, b in enumerate(shift)]
    return F.array(*[sum((m * F.lit(row[j]) for m, row in zip(moved, matrix, strict=True)), F.lit(0.0)) for j in range(len(matrix[0]))])


def moments(df: DataFrame, x: str = "x") -> np.ndarray:
    """The sums of products of (1, x) with itself, in one pass: each task returns one small matrix."""
    ship(df.sparkSession)
    size = df.select(F.size(x)).first()[0]

    def run(batches):
        total = np.zeros((size + 1, size + 1))
        for b in batches:
            if len(b):
                rows = np.column_stack([np.ones(len(b)), np.stack(b[x].to_numpy()).astype(float)])
                total += rows.T @ rows
        yield pd.DataFrame({"k": np.arange(total.size), "v": total.ravel()})

    sums = np.zeros((size + 1) ** 2)
    for r in df.select(x).mapInPandas(run, "k long, v double").groupBy("k").agg(F.sum("v").alias("v")).collect():
        sums[r["k"]] = r["v"]
    return sums.reshape(size + 1, size + 1)


def covariance(df: DataFrame, x: str = "x") -> DataFrame:
    """(i, j, cov, corr) of each two features (i <= j), from one pass of moments about the first row's values."""
    first = [float(v) for v in df.select(x).first()[0]]
    sums = moments(df.select(F.zip_with(F.col(x), F.array(*map(F.lit, first)), lambda a, b: a.cast("double") - b).alias(x)), x)
    n = sums[0, 0]
    cov = (sums[1:, 1:] - np.outer(sums[0, 1:], sums[0, 1:]) / n) / (n - 1)
    sd = np.sqrt(np.diag(cov))
    rows = [(i, j, float(cov[i, j]), float(cov[i, j] / (sd[i] * sd[j])) if sd[i] * sd[j] else None) for i in range(len(sd)) for j in range(i, len(sd))]
    return df.sparkSession.createDataFrame(rows, "i int, j int, cov double, corr double")


def partition_labels(label: Column, partition: list[list[int]]) -> Column:
    """New labels by group of old ones; others are -1."""
    out = F.lit(-1)
    for k, group in enumerate(partition):
        out = F.when(label.isin(group), k).otherwise(out)
    return out


def compress_labels(df: DataFrame, label: str = "label") -> DataFrame:
    """Labels as 0, 1, ... in their order; there are as many rows in the lookup as labels."""
    lookup = df.select(label).distinct().withColumn("new_label", (F.row_number().over(Window.orderBy(label)) - 1).cast("int"))
    return df.join(F.broadcast(lookup), label)


def discretise(value: Column, low: float, high: float, classes: int, geometric: bool = False, open_ended: bool = True) -> Column:
    """Class by even (or geometric) thresholds between low and high; outside: the end classes, or -1 unless open-ended."""
    if geometric:
        import math

        at = F.floor((F.log(value) - math.log(low)) / (math.log(high) - math.log(low)) * classes)
        at = F.when(value <= 0, F.lit(-1)).otherwise(at)
    else:
        at = F.floor((value - low) / (high - low) * classes)
    inside = (at >= 0) & (at < classes)
    return (F.least(F.greatest(at, F.lit(0)), F.lit(classes - 1)) if open_ended else F.when(inside, at).otherwise(-1)).cast("int")


def in_latitudes(lat: Column, low: float, high: float) -> Column:
    """Between low and high; with low above high, all but between."""
    return ((lat >= low) | (lat <= high)) if low > high else ((lat >= low) & (lat <= high))


def fold(key: Column, folds: int) -> Column:
    """The fold of a row by its key, the same at every run."""
    return F.pmod(F.xxhash64(key), F.lit(folds)).cast("int")


def remove_duplicates(df: DataFrame, keys: list[str], weight: str) -> DataFrame:
    """One row for each different vector and class, weights averaged."""
    return df.groupBy(*keys).agg(F.avg(weight).alias(weight), F.count("*").alias("n"))


def log_with_error(q: Column, err: Column) -> tuple[Column, Column]:
    """log q and its error."""
    return F.log(q), err / q


def is_sorted(df: DataFrame, key: str, value: str) -> DataFrame:
    """Whether values don't fall in order of the key: compares each with the next within ranges, and ranges by their ends."""
    part = df.repartitionByRange(key).select(F.spark_partition_id().alias("_p"), key, value)
    w = Window.partitionBy("_p").orderBy(key)
    inner = part.withColumn("_d", F.col(value) < F.lag(value).over(w)).groupBy("_p").agg(F.max(F.coalesce("_d", F.lit(False))).alias("bad"), F.min_by(value, key).alias("a"), F.max_by(value, key).alias("b"))
    ends = inner.withColumn("bad", F.col("bad") | F.coalesce(F.col("a") < F.lag("b").over(Window.orderBy("_p")), F.lit(False)))
    return ends.agg((~F.max("bad")).alias("sorted"))


def principal_components(df: DataFrame, k: int, x: str = "x") -> tuple[list[float], list[list[float]]]:
    """Means and a D by k matrix of the leading right singular vectors of the centred data, from one pass of moments."""
    sums = moments(df, x)
    n = sums[0, 0]
    mean = (sums[0, 1:] / n).tolist()
    cov = (sums[1:, 1:] - np.outer(sums[0, 1:], sums[0, 1:]) / n) / (n - 1)
    w, v = np.linalg.eigh(cov)
    lead = v[:, np.argsort(-w)[:k]]
    lead *= np.where(lead[np.argmax(np.abs(lead), axis=0), range(lead.shape[1])] < 0, -1.0, 1.0)
    return mean, lead.tolist()


def stratified(df: DataFrame, label: str, key: str, fraction: float) -> DataFrame:
    """A column `test`: about `fraction` of each class, by the hash of the key (see sets.fold_number), the same at every run."""
    return df.withColumn("test", fold_number(F.concat_ws("/", label, key), 1_000_000) < int(fraction * 1_000_000))


def exp_with_error(q: Column, err: Column) -> tuple[Column, Column]:
    """exp q and its error: undoes log_with_error."""
    return F.exp(q), err * F.exp(q)


def class_to_r(label: Column, confidence: Column) -> Column:
    """R = P(1) - P(0) of a two-class result, from its label and confidence."""
    return (2 * label - 1) * confidence
