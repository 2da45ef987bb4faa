"""Velocity fields on grids: interpolation in space and time by joins, and trajectories through them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .graph import saved
from .grids import corners

#: An even axis: its first and last value, and how many values it has.
Axis = tuple[float, float, int]


def index(value: Column, axis: Axis) -> Column:
    """The fractional place of a value on an axis."""
    low, high, n = axis
    return (value - low) * ((n - 1) / (high - low))


def interpolated(at: DataFrame, field: DataFrame, sizes: list[int]) -> DataFrame:
    """(id, u, v) of a field (i0, i1, i2, u, v) at fractional places (id, x0, x1, x2): an equi-join on the eight corners and a sum.
    Outside the grid the end cells extrapolate; a place that is null or NaN has no velocity."""
    whole = at.where("not (isnan(x0) or isnan(x1) or isnan(x2))")
    met = corners(whole, ["x0", "x1", "x2"], sizes).join(field, ["i0", "i1", "i2"])
    return met.groupBy("id").agg(F.sum(F.col("w") * F.col("u")).alias("u"), F.sum(F.col("w") * F.col("v")).alias("v"))


def gridded(spark: SparkSession, flow: Callable[[Column, Column, Column], tuple], x: Axis, y: Axis, t: Axis) -> DataFrame:
    """A flow, as expressions of x, y and time, on the points of a grid."""
    n = F.col("id")
    points = spark.range(x[2] * y[2] * t[2]).select((n % x[2]).alias("i0"), (F.floor(n / x[2]) % y[2]).alias("i1"), F.floor(n / (x[2] * y[2])).alias("i2"))
    value = lambda c, axis: axis[0] + F.col(c) * ((axis[1] - axis[0]) / (axis[2] - 1))
    u, v = flow(value("i0", x), value("i1", y), value("i2", t))
    return points.select("i0", "i1", "i2", u.cast("double").alias("u"), v.cast("double").alias("v"))


def trajectories(start: DataFrame, field: DataFrame, x: Axis, y: Axis, t: Axis, t0: float, dt: float, steps: int) -> DataFrame:
    """(id, step, x, y): points (id, x, y) carried by a gridded field, fourth-order Runge-Kutta steps from t0.

    A step is four interpolations, each a join of all points with the field, so neither has to fit anywhere; each step's places are saved."""
    field = saved(field)
    sizes = [x[2], y[2], t[2]]

    def slope(at: DataFrame, time: float, dx: Column, dy: Column, name: str) -> DataFrame:
        places = at.select("id", index(F.col("x") + dx, x).alias("x0"), index(F.col("y") + dy, y).alias("x1"), index(F.lit(time), t).alias("x2"))
        return at.join(interpolated(places, field, sizes).withColumnsRenamed({"u": f"u{name}", "v": f"v{name}"}), "id")

    now = saved(start.select("id", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")))
    out = now.select("id", F.lit(0).alias("step"), "x", "y")
    for k in range(steps):
        time = t0 + k * dt
        z = slope(now, time, F.lit(0.0), F.lit(0.0), "1")
        z = slope(z, time + dt / 2, dt / 2 * F.col("u1"), dt / 2 * F.col("v1"), "2")
        z = slope(z, time + dt / 2, dt / 2 * F.col("u2"), dt / 2 * F.col("v2"), "3")
        z = slope(z, time + dt, dt * F.col("u3"), dt * F.col("v3"), "4")
        move = lambda c: F.col({"u": "x", "v": "y"}[c]) + dt / 6 * (F.col(f"{c}1") + 2 * F.col(f"{c}2") + 2 * F.col(f"{c}3") + F.col(f"{c}4"))
        now = saved(z.select("id", move("u").alias("x"), move("v").alias("y")))
        out = out.unionByName(now.select("id", F.lit(k + 1).alias("step"), "x", "y"))
    return out
