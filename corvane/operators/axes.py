"""As-of lookup and linear interpolation along one uneven axis without groups, by ranges of the key."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .graph import saved
from .order import positions


def marks(axis: DataFrame, values: list[str]) -> DataFrame:
    """The axis' different keys k with `_m`: their place i, the key after them, and the two neighbouring keys (and their values) that a line goes through.

    Keys are numbered by ranges and joined with the places beside them; equal keys are one, with the mean of their values."""
    by = axis.where("k is not null and not isnan(k)").groupBy(F.col("k").cast("double").alias("k")).agg(F.count("*").alias("_n"), *(F.avg(c).alias(c) for c in values))
    placed = saved(positions(by.drop("_n"), ["k"]))
    point = F.struct("k", F.col("position").alias("i"), *values)
    beside = lambda by, name: placed.select((F.col("position") + by).alias("position"), point.alias(name))
    both = placed.join(beside(-1, "_next"), "position", "left").join(beside(1, "_last"), "position", "left")
    line = F.when(F.col("_next").isNotNull(), F.struct(point.alias("a"), F.col("_next").alias("b"))).otherwise(F.struct(F.col("_last").alias("a"), point.alias("b")))
    return both.select("k", F.struct(F.col("k").alias("k0"), F.col("position").alias("i0"), F.col("_next.k").alias("k1"), line.alias("line")).alias("_m"))


def asof(left: DataFrame, axis: DataFrame, key: str, values: list[str] = (), descending: bool = False) -> DataFrame:
    """Each left row with `k0`, `i0`: the greatest of the axis' keys k that is at most its own, and its place from 0; `k1`: the next key;
    `index`: its fractional place, and each of `values` at this place. Outside the axis the first or last two keys extrapolate.

    Rows and keys are sorted together in ranges, also of equal keys (a third of all rows may have one), and the last key of every
    range is carried to the ranges after it: no task has more than its range, and only one row for each range is broadcast. A row
    before the first key has null k0 and i0. An axis of one key has no index, an empty one nothing. A null or NaN key has nulls. With `descending`
    places are counted from the greatest key down; k0 stays the key below.
    """
    values = list(values)
    m = saved(marks(axis, values))
    kind = m.schema["_m"].dataType
    rows = left.withColumns({"_k": F.col(key).cast("double"), "_left": F.lit(1), "_tie": F.monotonically_increasing_id(), "_m": F.lit(None).cast(kind)})
    both = rows.unionByName(m.select(F.col("k").alias("_k"), F.lit(0).alias("_left"), F.lit(-1).cast("long").alias("_tie"), "_m"), allowMissingColumns=True)
    order = ["_k", "_left", "_tie"]
    part = saved(both.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    ends = part.groupBy("_part").agg(F.max_by("_m", F.when(F.col("_left") == 0, F.col("_k"))).alias("_end"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select("_part", F.last("_end", ignorenulls=True).over(before).alias("_carried"))
    first = m.agg(F.min_by("_m", "k").alias("_first"), F.count("*").alias("_size"))
    upto = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    found = part.join(F.broadcast(carried), "_part").withColumn("_m", F.coalesce(F.last("_m", ignorenulls=True).over(upto), "_carried")).where("_left = 1").crossJoin(F.broadcast(first))  # one row
    a, b = (lambda c: F.col(f"_line.a.{c}")), (lambda c: F.col(f"_line.b.{c}"))
    share = F.try_divide(F.col("_k") - a("k"), b("k") - a("k"))
    whole = F.col("_k").isNotNull() & ~F.isnan("_k")
    place = (lambda c: F.col("_size") - 1 - c) if descending else (lambda c: c)
    found = found.withColumn("_line", F.when(whole, F.coalesce("_m.line", "_first.line"))).withColumn("_m", F.when(whole, F.col("_m")))
    out = {"k0": F.col("_m.k0"), "i0": place(F.col("_m.i0")), "k1": F.when(whole, F.when(F.col("_m").isNull(), F.col("_first.k0")).otherwise(F.col("_m.k1"))), "index": place(a("i") + share)}
    return found.select(*left.columns, *(v.alias(n) for n, v in out.items()), *((a(c) + share * (b(c) - a(c))).alias(c) for c in values))
