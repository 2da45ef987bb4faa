"""Set operations over lists of vectors."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def unify(lists: list[DataFrame]) -> DataFrame:
    """Different vectors of all lists, numbered from 0 in their order."""
    from .order import positions

    union = reduce(DataFrame.unionByName, lists).distinct()
    return positions(union, union.columns).withColumnRenamed("position", "number")


def with_numbers(df: DataFrame, unified: DataFrame, keys: list[str]) -> DataFrame:
    return df.join(unified, keys)


def bits_set(df: DataFrame, key: str) -> DataFrame:
    """How many bits are set in the bit array that has one for each value: bitmaps of 32 768 bits by bucket, then their counts."""
    maps = df.groupBy(F.bitmap_bucket_number(F.col(key)).alias("_b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(F.col(key))).alias("_m"))
    return maps.agg(F.sum(F.bitmap_count("_m")).alias("nonzero"))


def fold_number(key: Column, folds: int) -> Column:
    """A fold that any other system can compute too: the low 64 bits of md5 of the key's text."""
    low = F.conv(F.substring(F.md5(key.cast("string").cast("binary")), 17, 16), 16, 10).cast("decimal(20,0)")
    return (low % folds).cast("long")


def md5_fold(df: DataFrame, key: str, folds: int) -> DataFrame:
    return df.select(key, fold_number(F.col(key), folds).alias("fold"))


def pattern_union(a: DataFrame, b: DataFrame) -> DataFrame:
    """Columns in which either of two sparse rows has an element, for rows (i, cols)."""
    return a.alias("a").join(b.alias("b"), "i", "full_outer").select("i", F.array_sort(F.array_union(F.coalesce("a.cols", F.array()), F.coalesce("b.cols", F.array()))).alias("cols"))
