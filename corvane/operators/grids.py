"""Grids: interpolation, tracers at measurements, equivalent latitude, contour measures and statistics of agreement."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geo import great_circle
from ..session import ship
from .evaluate import running


def corners(at: DataFrame, columns: list[str], sizes: list[int]) -> DataFrame:
    """Each row's 2^n grid corners (i0, i1, ...) with their weights w; outside the grid the end cells extrapolate."""
    out = at.withColumn("w", F.lit(1.0))
    for k, (c, n) in enumerate(zip(columns, sizes, strict=True)):
        low = F.least(F.greatest(F.floor(c), F.lit(0)), F.lit(n - 2))
        part = F.col(c) - low
        two = F.array(F.struct(low.alias("i"), (1 - part).alias("w")), F.struct((low + 1).alias("i"), part.alias("w")))
        out = out.withColumn("_c", F.explode(two)).withColumns({f"i{k}": F.col("_c.i"), "w": F.col("w") * F.col("_c.w")}).drop("_c")
    return out


def interpolate(at: DataFrame, field: DataFrame, columns: list[str], sizes: list[int]) -> DataFrame:
    """(id, v): n-linear interpolation of `field` (i0, ..., v) at fractional indices; an equi-join on corners and a sum."""
    keys = [f"i{k}" for k in range(len(columns))]
    return corners(at, columns, sizes).join(field, keys).groupBy("id").agg(F.sum(F.col("w") * F.col("v")).alias("v"))


def tracer_at(at: DataFrame, field: DataFrame) -> DataFrame:
    """(id, v) of a tracer (step, cell, q) at rows (id, at: fractional step, cell, w): linear in time, weighted over cells."""
    low = F.floor("at")
    two = F.array(F.struct(low.alias("step"), (1 - (F.col("at") - low)).alias("p")), F.struct((low + 1).alias("step"), (F.col("at") - low).alias("p")))
    rows = at.withColumn("_t", F.explode(two)).select("id", "cell", F.col("_t.step").alias("step"), (F.col("w") * F.col("_t.p")).alias("w"))
    return rows.join(field, ["step", "cell"]).groupBy("id").agg(F.sum(F.col("w") * F.col("q")).alias("v"))


def agreement(df: DataFrame, a: str, b: str) -> DataFrame:
    """Correlation, bias, rms without bias, both over the standard deviation, and the share within a factor of two."""
    d = F.col(b) - F.col(a)
    inside = (F.col(b) > 0) & F.try_divide(b, a).between(0.5, 2)
    s = df.agg(F.corr(a, b).alias("r"), F.avg(d).alias("bias"), F.stddev_samp(d).alias("rms"), F.stddev_samp(a).alias("_sd"), F.avg(F.when(inside, 1.0).otherwise(0.0)).alias("fac2"))
    return s.select(F.round("r", 9).alias("r"), F.round("bias", 9).alias("bias"), F.round("rms", 9).alias("rms"), F.round(F.col("bias") / F.col("_sd"), 9).alias("bias_std"), F.round(F.col("rms") / F.col("_sd"), 9).alias("rms_std"), F.round("fac2", 9).alias("fac2"))


def equivalent_latitude(df: DataFrame, q: str, area: str) -> DataFrame:
    """(q, eq_lat): the latitude that encloses as much area as all smaller values of q."""
    by = df.groupBy(q).agg(F.sum(area).alias("a"))
    x = running(by, q, ["a"])
    return x.select(q, F.degrees(F.asin(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), 2 * F.col("a_upto") / F.col("a_all") - 1)))).alias("eq_lat"))


def contour_length(points: DataFrame, rec: str, order: list[str]) -> DataFrame:
    """Segments and kilometres of each record's line through (lon, lat)."""
    w = Window.partitionBy(rec).orderBy(*order)
    d = great_circle(F.lag("lon").over(w), F.lag("lat").over(w), F.col("lon"), F.col("lat"))
    return points.withColumn("_d", d).groupBy(rec).agg(F.count("_d").alias("segments"), F.coalesce(F.sum("_d"), F.lit(0.0)).alias("km"))


def crossings(points: DataFrame, by: list[str], order: list[str], side) -> DataFrame:
    """How often each line's points change `side`, an expression, in their order."""
    w = Window.partitionBy(*by).orderBy(*order)
    return points.select(*by, F.when(side != F.lag(side).over(w), 1).otherwise(0).alias("_c")).groupBy(*by).agg(F.sum("_c").alias("crossings"))


def ruler_lengths(points: DataFrame, rec: str, order: list[str], steps: list[int]) -> DataFrame:
    """(k, steps, km): the lines' length in steps over k points each, for each k: how it falls with k tells a line's dimension."""
    number = F.row_number().over(Window.partitionBy(rec).orderBy(*order)) - 1
    rows = points.withColumn("_s", number).withColumn("k", F.explode(F.array(*map(F.lit, steps)))).where("_s % k = 0")
    w = Window.partitionBy("k", rec).orderBy("_s")
    d = great_circle(F.lag("lon").over(w), F.lag("lat").over(w), F.col("lon"), F.col("lat"))
    return rows.select("k", d.alias("_d")).groupBy("k").agg(F.count("_d").alias("steps"), F.sum("_d").alias("km"))


def densify(points: DataFrame, rec: str, seq: str, pieces: int) -> DataFrame:
    """Each segment of a line cut in `pieces` even parts."""
    w = Window.partitionBy(rec).orderBy(seq)
    two = points.withColumns({"_x": F.lead("x").over(w), "_y": F.lead("y").over(w)})
    steps = two.withColumn("part", F.explode(F.when(F.col("_x").isNull(), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.lit(pieces - 1)))))
    t = F.col("part") / pieces
    return steps.select(rec, seq, "part", (F.col("x") + t * (F.coalesce("_x", "x") - F.col("x"))).alias("x"), (F.col("y") + t * (F.coalesce("_y", "y") - F.col("y"))).alias("y"))


def box_counts(df: DataFrame, x: str, y: str, sizes: list[float]) -> DataFrame:
    """How many boxes of each size have points."""
    s = F.explode(F.array(*map(F.lit, sizes)))
    boxes = df.select(x, y, s.alias("size")).select("size", F.floor(F.col(x) / F.col("size")).alias("_x"), F.floor(F.col(y) / F.col("size")).alias("_y")).distinct()
    return boxes.groupBy("size").agg(F.count("*").alias("boxes"))


def box_dimension(counts: DataFrame) -> DataFrame:
    return counts.agg((-F.regr_slope(F.log("boxes"), F.log("size"))).alias("dimension"))


def proxy_fit(df: DataFrame, by: list[str], proxy: str, value: str, order: int) -> DataFrame:
    """(by, n, coefficients) of the least-squares polynomial of degree `order` of value on proxy, for each group with more than `order` rows.

    Groups are reduced to sums of powers about their mean proxy, so that a task sees 3 * order + 2 numbers a group, and the normal equations are solved from these;
    coefficients are of powers of the proxy, from 0 up. A group whose proxies are too few different values has null."""
    ship(df.sparkSession)
    middle = df.groupBy(*by).agg(F.avg(proxy).alias("_m"), F.coalesce(F.nullif(F.stddev_pop(proxy), F.lit(0.0)), F.lit(1.0)).alias("_s"))
    x = (F.col(proxy) - F.col("_m")) / F.col("_s")
    powers = [F.sum(F.pow(x, F.lit(k))).alias(f"_x{k}") for k in range(2 * order + 1)] + [F.sum(F.pow(x, F.lit(k)) * F.col(value)).alias(f"_y{k}") for k in range(order + 1)]
    sums = df.join(middle, by).groupBy(*by, "_m", "_s").agg(F.count("*").alias("n"), *powers).where(F.col("n") > order)

    def solve(batches):
        for b in batches:
            out = []
            for _, r in b.iterrows():
                a = np.array([[r[f"_x{i + j}"] for j in range(order + 1)] for i in range(order + 1)], dtype=float)
                if np.linalg.matrix_rank(a) <= order:
                    out.append(None)
                    continue
                c = np.polynomial.Polynomial(np.linalg.solve(a, [r[f"_y{i}"] for i in range(order + 1)]))(np.polynomial.Polynomial([-r["_m"] / r["_s"], 1 / r["_s"]]))
                out.append(np.pad(c.coef, (0, order + 1 - len(c.coef))).tolist())
            yield pd.DataFrame({**{c: b[c] for c in by}, "n": b["n"], "coefficients": out})

    kinds = ", ".join(f"{c} {df.schema[c].dataType.simpleString()}" for c in by)
    return sums.mapInPandas(solve, f"{kinds}, n long, coefficients array<double>")


def level_interpolation(df: DataFrame, column: list[str], level: str, value: str, target: float) -> DataFrame:
    """The value where `level` crosses `target`, linear between neighbouring levels of each column."""
    w = Window.partitionBy(*column).orderBy(level)
    two = df.withColumns({"_l": F.lead(level).over(w), "_v": F.lead(value).over(w)}).where((F.col(level) <= target) & (F.col("_l") > target))
    return two.select(*column, (F.col(value) + (F.col("_v") - F.col(value)) * (target - F.col(level)) / (F.col("_l") - F.col(level))).alias(value))


def flat_index(indices: list, sizes: list[int]):
    """One number for grid subscripts, the first running fastest."""
    out, stride = F.lit(0).cast("long"), 1
    for i, n in zip(indices, sizes, strict=True):
        out = out + (F.col(i) if isinstance(i, str) else i) * stride
        stride *= n
    return out


def subscripts(number, sizes: list[int]) -> list:
    """The subscripts that flat_index puts together."""
    out, stride = [], 1
    for n in sizes:
        out.append(F.floor(number / stride) % n)
        stride *= n
    return out


def pair_index(i, j):
    """The place of a pair i > j in a triangle that is written row by row."""
    return F.floor(i * (i - 1) / 2) + j


def combine(a: DataFrame, b: DataFrame, shared: list[str]) -> DataFrame:
    """Two variables side by side: joined on the axes that they share, crossed on the others."""
    return a.join(b, shared)


def axis_union(*axes: DataFrame) -> DataFrame:
    """The sorted, different values of several axes, numbered from 0."""
    from .sets import unify

    return unify(list(axes))


def levels(low: float, high: float, n: int, geometric: bool = False) -> list[float]:
    """n contour levels from low to high, even or in even ratios."""
    return [low * (high / low) ** (k / (n - 1)) if geometric else low + (high - low) * k / (n - 1) for k in range(n)]
