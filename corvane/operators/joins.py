"""As-of joins and interpolation along an axis, range joins, prefix matches, binned nearest neighbours."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .graph import saved
from .neighbours import nearest


def asof(left: DataFrame, axis: DataFrame, by: list[str], key: str) -> DataFrame:
    """Each left row with `k0`, `i0`: the greatest axis key (k, i) of its group that is at most its own, and `k1`: the next one.

    A union and two windows for each group: no row pairs are made. A row before the first key has nulls. A group is
    the unit of work: an axis without groups, or with a very large one, should be cut in ranges of time by the caller, as further columns of `by`.
    """
    rows = left.withColumn("_left", F.lit(1))
    marks = axis.select(*by, F.col("k").alias(key), F.col("i").alias("_i"), F.lit(0).alias("_left"))
    both = rows.unionByName(marks, allowMissingColumns=True)
    up = Window.partitionBy(*by).orderBy(key, "_left").rowsBetween(Window.unboundedPreceding, 0)
    mark = F.when(F.col("_left") == 0, F.struct(F.col(key).alias("k"), F.col("_i").alias("i")))
    following = Window.partitionBy(*by).orderBy("k")
    nexts = axis.select(*by, F.col("k").alias("_k"), F.lead("k").over(following.orderBy("k")).alias("k1"))
    found = both.withColumn("_m", F.last(mark, ignorenulls=True).over(up)).where("_left = 1").select(*left.columns, F.col("_m.k").alias("k0"), F.col("_m.i").alias("i0"))
    on = [F.col(f"f.{c}") == F.col(f"n.{c}") for c in by] + [F.col("f.k0") == F.col("n._k")]
    return found.alias("f").join(nexts.alias("n"), on, "left").select("f.*", "n.k1")


def even_axis(left: DataFrame, key: str, start: float, step: float, n: int, extrapolate: bool = True) -> DataFrame:
    """As-of against an even axis, computed without a join: `i0` and the fractional index, which goes on outside unless clamped."""
    at = (F.col(key) - start) / step
    i0 = F.least(F.greatest(F.floor(at), F.lit(0)), F.lit(n - 2))
    index = at if extrapolate else F.least(F.greatest(at, F.lit(0.0)), F.lit(float(n - 1)))
    return left.withColumns({"i0": i0.cast("int"), "index": index})


def window_counts(rows: DataFrame, key: str, start: int, step: int, n: int, half: int) -> DataFrame:
    """Rows within `half` of each grid point of an even grid, by exploding each row to the points it is near."""
    low = F.greatest(F.ceil((F.col(key) - half - start) / step), F.lit(0))
    high = F.least(F.floor((F.col(key) + half - start) / step), F.lit(n - 1))
    near = rows.withColumns({"_a": low, "_b": high}).where("_a <= _b")
    return near.select("*", F.explode(F.sequence("_a", "_b")).alias("grid")).drop("_a", "_b")


def prefix_match(probes: DataFrame, table: DataFrame, columns: list[str], payload: str) -> DataFrame:
    """The payload of the longest prefix of `columns` that the table has: one join for each length, longest first."""
    out = probes
    for n in range(len(columns), 0, -1):
        keys = columns[:n]
        short = table.groupBy(*keys).agg(F.min(payload).alias(f"_m{n}"))
        out = out.join(short, keys, "left")
    found = F.coalesce(*(F.col(f"_m{n}") for n in range(len(columns), 0, -1)))
    length = F.coalesce(*(F.when(F.col(f"_m{n}").isNotNull(), n) for n in range(len(columns), 0, -1)), F.lit(0))
    return out.select(*probes.columns, found.alias("found"), length.alias("prefix"))


def _bins(df: DataFrame, columns: tuple[str, ...], size: float) -> DataFrame:
    return df.withColumns({f"_b_{c}": F.floor(F.col(c) / size) for c in columns})


def _fine(points: DataFrame, columns: tuple[str, ...], size: float, most: int, halves: int = 12) -> float:
    """`size`, halved until a point shares its bin with at most `most` on average, or `halves` times."""
    for _ in range(halves):
        n = _bins(points, columns, size).groupBy(*(f"_b_{c}" for c in columns)).count()
        if (n.agg(F.sum(F.col("count").cast("double") * F.col("count")) / F.sum("count")).first()[0] or 0) <= most:
            break
        size /= 2
    return size


def binned_nearest(probes: DataFrame, points: DataFrame, size: float, columns: tuple[str, ...] = ("a", "b"), most: int = 16) -> DataFrame:
    """(id, near, d2): the nearest point to each probe, exact: bins and those beside them, twice as wide each round, until no nearer one is possible.

    The first bins are `size` wide, or so much less that about `most` points share one, so a probe meets about as many points however many there are. A probe whose best is within
    a bin's width is done. What is open when bins of 4 * `size` are done is searched by blocks (see neighbours.nearest). Points at one place are one point, of the
    smallest id. A bin's points are lists of at most 1000, and a list gives one candidate to a probe, so pairs are never rows. Points are joined by bin, so a round moves only bins
    that are asked for; what is open is saved. A probe with a null or NaN coordinate has no nearest point, nor has any if there are no points.
    """
    whole = lambda df: df.where(" and ".join(f"{c} is not null and not isnan({c})" for c in columns))
    keys, kind = [f"_b_{c}" for c in columns], points.schema["id"].dataType
    pts = saved(whole(points).groupBy(*columns).agg(F.min("id").alias("id")))
    open_, done, last = saved(whole(probes).select("id", *columns)), None, 4 * size
    lost = probes.join(open_.select("id"), "id", "left_anti").select("id", F.lit(None).cast(kind).alias("near"), F.lit(None).cast("double").alias("d2"))
    size = _fine(pts, columns, size, most)
    while size <= last and not open_.isEmpty():
        asked = _bins(open_, columns, size)
        for c in keys:
            asked = asked.withColumn("_by", F.explode(F.sequence(F.lit(-1), F.lit(1)))).withColumn(c, F.col(c) + F.col("_by")).drop("_by")
        placed = _bins(pts, columns, size).withColumn("_l", F.floor((F.row_number().over(Window.partitionBy(*keys).orderBy("id")) - 1) / 1000))
        lists = placed.groupBy(*keys, "_l").agg(F.collect_list(F.struct("id", *columns)).alias("_points"))
        d2 = lambda p: sum((F.col(c) - p[c]) ** 2 for c in columns)
        met = asked.join(lists, keys).select("id", F.array_min(F.transform("_points", lambda p: F.struct(d2(p).alias("d2"), p["id"].alias("near")))).alias("_m"))
        best = met.groupBy("id").agg(F.min("_m").alias("_m"))
        found = saved(open_.join(best, "id", "left").select(*open_.columns, "_m.d2", "_m.near"))
        near = F.coalesce(F.col("d2") <= (size * (1 - 1e-9)) ** 2, F.lit(False))
        got = found.where(near).select("id", "near", "d2")
        done = got if done is None else done.unionByName(got)
        open_, size = found.where(~near).select(*open_.columns), size * 2
    if done is not None and open_.isEmpty():
        return lost.unionByName(done)
    vector = lambda df, *c: df.select(*c, F.array(*columns).alias("x"))
    rest = nearest(vector(open_, "id"), vector(pts, "id"), 1)
    rest = open_.select("id").join(rest, F.col("id") == F.col("probe"), "left").select("id", F.col("train").alias("near"), "d2")
    return lost.unionByName(rest) if done is None else lost.unionByName(rest).unionByName(done)


def nearest_on_globe(probes: DataFrame, points: DataFrame, degrees: float) -> DataFrame:
    """(id, near, km): the nearest point (id, lon, lat) on the sphere, in bins of about `degrees`: unit vectors are as near as their places, at the date line
    and the poles too."""
    from ..functions.geo import RADIUS, unit_vector

    on = lambda df: df.select("id", *(c.alias(n) for c, n in zip(unit_vector(F.col("lon"), F.col("lat")), "xyz", strict=True)))
    found = binned_nearest(on(probes), on(points), math.radians(degrees), ("x", "y", "z"))
    return found.select("id", "near", (2 * RADIUS * F.asin(F.least(F.sqrt("d2") / 2, F.lit(1.0)))).alias("km"))
