"""Sorting, k-selection, positions and other order-dependent operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .graph import saved


def k_least(df: DataFrame, k: int, keys: list) -> DataFrame:
    """The k first rows: a limit under a sort, which keeps k rows of each partition and merges these."""
    return df.orderBy(*keys).limit(k)


def k_per_group(df: DataFrame, k: int, group: list[str], keys: list) -> DataFrame:
    """The k first rows of each group with their rank; Spark limits groups before the shuffle."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*group).orderBy(*keys))).where(F.col("rank") <= k)


def running_sums(df: DataFrame, keys: list[str], columns: list[str] = ()) -> DataFrame:
    """Every row's `position` (from 0) in the order of keys, and `c`_before, the sum of column c over the rows before it.

    Ranges of the keys are sorted apart and saved, and offset by the rows and sums of the ranges before."""
    part = saved(df.repartitionByRange(*keys).withColumn("_part_", F.spark_partition_id()))
    before = Window.orderBy("_part_").rowsBetween(Window.unboundedPreceding, -1)
    counts = part.groupBy("_part_").agg(F.count("*").alias("_rows_"), *(F.sum(c).alias(f"_{c}_") for c in columns))
    offsets = counts.select("_part_", F.coalesce(F.sum("_rows_").over(before), F.lit(0)).alias("_upto_"), *(F.coalesce(F.sum(f"_{c}_").over(before), F.lit(0)).alias(f"_{c}_") for c in columns))
    inside = Window.partitionBy("_part_").orderBy(*keys)
    upto = inside.rowsBetween(Window.unboundedPreceding, -1)
    sums = {f"{c}_before": F.coalesce(F.sum(c).over(upto), F.lit(0)) + F.col(f"_{c}_") for c in columns}
    return part.join(F.broadcast(offsets), "_part_").withColumns({"position": F.row_number().over(inside) - 1 + F.col("_upto_"), **sums}).drop("_part_", "_upto_", *(f"_{c}_" for c in columns))


def positions(df: DataFrame, keys: list[str]) -> DataFrame:
    """Every row's place (from 0) in the order of keys."""
    return running_sums(df, keys)


def split_even(df: DataFrame, keys: list[str], parts: int) -> DataFrame:
    """`part` (from 1): consecutive rows in the order of keys in parts whose sizes differ by one at most, larger ones first."""
    placed, n = positions(df, keys), df.count()
    each, more = divmod(n, parts)
    at = F.col("position")
    part = F.when(at < more * (each + 1), F.floor(at / (each + 1))).otherwise(more + F.floor((at - more * (each + 1)) / max(each, 1)))
    return placed.withColumn("part", (part + 1).cast("int")).drop("position")


def class_offsets(df: DataFrame, label: str) -> DataFrame:
    """Rows of each class and the place of its first when rows are sorted by class."""
    n = running_sums(df.groupBy(label).agg(F.count("*").alias("n")), [label], ["n"])
    return n.select(label, "n", F.col("n_before").alias("first"))


def renormalise(df: DataFrame, step: list[str], value: str) -> DataFrame:
    """Each step's values to -1 ... 1, by a join with the step's range."""
    ends = df.groupBy(*step).agg(F.min(value).alias("_a"), F.max(value).alias("_b"))
    return df.join(ends, step).withColumn(value, (F.col(value) - F.col("_a")) / (F.col("_b") - F.col("_a")) * 2 - 1).drop("_a", "_b")


def shuffled(df: DataFrame, key: str, seed: int = 0) -> DataFrame:
    """Rows in an order that looks random and is the same at every run."""
    return df.orderBy(F.xxhash64(F.lit(seed), key), key)
