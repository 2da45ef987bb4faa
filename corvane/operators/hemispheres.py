"""Grids over the globe on two polar planes, one for each hemisphere: packed tracers, winds that cross the equator, and their Jacobian.

Both planes are azimuthal-equidistant about their pole, in km; a plane's grid is a square of `n` times `n` points within `side` of the pole. Domain 0 is the southern plane,
1 the northern.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.geo import RADIUS, from_plane, metric_coefficients
from .graph import saved
from .grids import corners
from .velocity import Axis, index

#: From a pole to the equator, on the plane.
EQUATOR = RADIUS * math.pi / 2


@dataclass(frozen=True)
class Planes:
    """Two square grids of n x n points that reach `side` km from the pole along each axis; the equator lies at EQUATOR km."""

    n: int = 100
    side: float = 10_000.0

    @property
    def step(self) -> float:
        return 2 * self.side / (self.n - 1)

    @property
    def axis(self) -> Axis:
        return -self.side, self.side, self.n

    def rows(self) -> list[tuple[int, int, int, int]]:
        """(j, first, last, before) of each row of cells: those within a cell's diagonal of the equator, and how many cells the rows before have."""
        reach, out, before = EQUATOR + math.hypot(self.step, self.step), [], 0
        for j in range(self.n):
            y = j * self.step - self.side
            kept = [i for i in range(self.n) if math.hypot(i * self.step - self.side, y) <= reach]
            if kept:
                out.append((j, kept[0], kept[-1], before))
                before += len(kept)
        return out

    @property
    def packed(self) -> int:
        """How many cells a plane has."""
        return sum(last - first + 1 for _, first, last, _ in self.rows())

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.rows(), "j int, first int, last int, before int")


def fixed(domain: Column, x: Column, y: Column) -> tuple[Column, Column, Column]:
    """(domain, x, y) on the plane of the nearer pole: a place beyond the equator goes to the other plane, on the same meridian."""
    r = F.sqrt(x * x + y * y)
    beyond = r > EQUATOR
    turn = F.when(beyond, (2 * EQUATOR - r) / r).otherwise(1.0)
    return F.when(beyond, 1 - domain).otherwise(domain), x * turn, y * turn


def on_plane(domain: Column, lon: Column, lat: Column) -> tuple[Column, Column]:
    """x, y of a place on a domain's plane, also beyond the equator."""
    hemi = 2 * domain - 1
    r = RADIUS * (math.pi / 2 - F.radians(hemi * lat))
    return r * F.cos(F.radians(lon)), r * F.sin(F.radians(lon))


def wind_on_plane(domain: Column, lon: Column, lat: Column, u: Column, v: Column) -> tuple[Column, Column]:
    """The velocity on a domain's plane of a wind `u` to the east and `v` to the north, also beyond the equator."""
    hemi = 2 * domain - 1
    r = RADIUS * (math.pi / 2 - F.radians(hemi * lat))
    turn, a = u / (RADIUS * F.cos(F.radians(lat))), F.radians(lon)
    return -hemi * v * F.cos(a) - r * F.sin(a) * turn, -hemi * v * F.sin(a) + r * F.cos(a) * turn


def cells(spark: SparkSession, planes: Planes) -> DataFrame:
    """(cell, domain, i, j, x, y, lon, lat) of the packed vector's places: row by row without the corners, the southern plane first."""
    spread = planes.table(spark).withColumn("i", F.explode(F.sequence("first", "last")))
    x, y = (F.col(c) * planes.step - planes.side for c in "ij")
    both = spread.withColumns({"domain": F.explode(F.array(F.lit(0), F.lit(1))), "x": x, "y": y})
    lon, lat = from_plane(F.col("x"), F.col("y"), 2 * F.col("domain") - 1)
    number = F.col("before") + F.col("i") - F.col("first") + planes.packed * F.col("domain")
    return both.select(number.cast("long").alias("cell"), "domain", "i", "j", "x", "y", lon.alias("lon"), lat.alias("lat"))


def square(spark: SparkSession, planes: Planes) -> DataFrame:
    """(domain, i, j, x, y, lon, lat) of all points of both squares, which winds need also in the corners and beyond the equator."""
    n = F.col("id")
    points = spark.range(2 * planes.n**2).select(F.floor(n / planes.n**2).cast("int").alias("domain"), (n % planes.n).alias("i"), (F.floor(n / planes.n) % planes.n).alias("j"))
    points = points.withColumns({c: F.col(k) * planes.step - planes.side for c, k in zip("xy", "ij", strict=True)})
    lon, lat = from_plane(F.col("x"), F.col("y"), 2 * F.col("domain") - 1)
    return points.withColumns({"lon": lon, "lat": lat})


def weights(places: DataFrame, planes: Planes, move: bool = True) -> DataFrame:
    """(id, cell, w): the four cells of the packed vector, and their weights, at places (id, domain, x, y); with `move` a place beyond the equator goes to the other plane.

    A cell that the packed vector leaves out, in a corner, has no row; no place within the equator has one."""
    domain, x, y = fixed(F.col("domain"), F.col("x"), F.col("y")) if move else (F.col("domain"), F.col("x"), F.col("y"))
    at = places.where("not (isnan(x) or isnan(y))").select("id", domain.alias("domain"), index(x, planes.axis).alias("x0"), index(y, planes.axis).alias("x1"))
    found = corners(at, ["x0", "x1"], [planes.n, planes.n]).withColumnRenamed("i1", "j").join(F.broadcast(planes.table(places.sparkSession)), "j")  # n rows
    number = F.col("before") + F.col("i0") - F.col("first") + planes.packed * F.col("domain")
    return found.where("i0 between first and last").select("id", number.cast("long").alias("cell"), "w")


def to_planes(field: DataFrame, lons: int, lats: int, planes: Planes) -> DataFrame:
    """(cell, q): a field (i, j, q) on even longitudes from 0 (lons of them, which wrap) and even latitudes from -90 to 90, packed on the planes."""
    at = cells(field.sparkSession, planes).select(F.col("cell").alias("id"), (F.col("lon") * lons / 360).alias("x0"), ((F.col("lat") + 90) * (lats - 1) / 180).alias("x1"))
    met = corners(at, ["x0", "x1"], [lons + 1, lats]).select("id", (F.col("i0") % lons).alias("i"), F.col("i1").alias("j"), "w")
    return met.join(field, ["i", "j"]).groupBy(F.col("id").alias("cell")).agg(F.sum(F.col("w") * F.col("q")).alias("q"))


def from_planes(packed: DataFrame, lons: int, lats: int, planes: Planes) -> DataFrame:
    """(i, j, q): a packed field (cell, q) on even longitudes and latitudes; the southern half of the latitudes from the southern plane, the others from the northern."""
    n, domain = F.col("id"), (F.col("j") >= lats // 2).cast("int")
    grid = packed.sparkSession.range(lons * lats).select("id", (n % lons).alias("i"), F.floor(n / lons).alias("j")).withColumn("domain", domain)
    x, y = on_plane(F.col("domain"), F.col("i") * 360 / lons, F.col("j") * 180 / (lats - 1) - 90)
    q = interpolate(packed, grid.select("id", "domain", x.alias("x"), y.alias("y")), planes, move=False)
    return grid.join(q, "id").select("i", "j", "q")


def interpolate(packed: DataFrame, places: DataFrame, planes: Planes, move: bool = True) -> DataFrame:
    """(id, q) of a packed field (cell, q) at places (id, domain, x, y): a join on four cells and a sum."""
    return weights(places, planes, move).join(packed, "cell").groupBy("id").agg(F.sum(F.col("w") * F.col("q")).alias("q"))


def _wind_corners(at: DataFrame, field: DataFrame, planes: Planes, times: int) -> DataFrame:
    met = corners(at.where("not (isnan(x0) or isnan(x1) or isnan(x2))"), ["x0", "x1", "x2"], [planes.n, planes.n, times])
    return met.join(field, ["domain", "i0", "i1", "i2"])


def wind_at(at: DataFrame, field: DataFrame, planes: Planes, times: int) -> DataFrame:
    """(id, u, v) of a wind (domain, i0, i1, i2, u, v), in km a unit of time on the planes, at (id, domain, x0, x1, x2), fractional places and time; the domain stays."""
    return _wind_corners(at, field, planes, times).groupBy("id").agg(F.sum(F.col("w") * F.col("u")).alias("u"), F.sum(F.col("w") * F.col("v")).alias("v"))


def jacobian(places: DataFrame, field: DataFrame, planes: Planes, t: Axis) -> DataFrame:
    """(id, ux, uy, vx, vy): the wind's derivatives along the plane's axes at (id, domain, x, y, t): differences across the cell, linear over it and in time.

    The derivatives are of plane velocities by plane coordinates; `true_gradients` turns these to distances on the globe."""
    at = places.select("id", "domain", index(F.col("x"), planes.axis).alias("x0"), index(F.col("y"), planes.axis).alias("x1"), index(F.col("t"), t).alias("x2"))
    low = lambda c, n: F.least(F.greatest(F.floor(c), F.lit(0)), F.lit(n - 2))
    at = at.withColumns({f"_l{k}": low(f"x{k}", n) for k, n in enumerate((planes.n, planes.n, t[2]))})
    met = _wind_corners(at, field, planes, t[2])
    share = [F.when(F.col(f"i{k}") == F.col(f"_l{k}"), 1 - (F.col(f"x{k}") - F.col(f"_l{k}"))).otherwise(F.col(f"x{k}") - F.col(f"_l{k}")) for k in range(3)]
    sign = [F.when(F.col(f"i{k}") == F.col(f"_l{k}"), -1.0).otherwise(1.0) / planes.step for k in range(2)]
    dx, dy = sign[0] * share[1] * share[2], sign[1] * share[0] * share[2]
    return met.groupBy("id").agg(*(F.sum(d * F.col(c)).alias(c + n) for c in "uv" for n, d in (("x", dx), ("y", dy))))


def true_gradients(x: Column, y: Column, ux: Column, uy: Column, vx: Column, vy: Column) -> tuple[Column, Column, Column, Column]:
    """Derivatives by plane coordinates over the plane's scale along each axis: by km on the globe."""
    g11, _, g22 = metric_coefficients(x, y)
    return ux / F.sqrt(g11), uy / F.sqrt(g22), vx / F.sqrt(g11), vy / F.sqrt(g22)


def trajectories(start: DataFrame, field: DataFrame, planes: Planes, t: Axis, t0: float, dt: float, steps: int, out_every: int = 1) -> DataFrame:
    """(id, step, domain, x, y): points (id, domain, x, y) carried by a wind on both planes, in fourth-order Runge-Kutta steps from t0.

    Within a step a point stays on its plane, whose grid goes on beyond the equator; after it, a point beyond the equator changes planes, coordinates and the
    wind it reads. A step is four joins of all points with the wind; each step's places are saved.
    """
    field = saved(field)

    def slope(at: DataFrame, time: float, dx: Column, dy: Column, name: str) -> DataFrame:
        where = at.select("id", "domain", index(F.col("x") + dx, planes.axis).alias("x0"), index(F.col("y") + dy, planes.axis).alias("x1"), index(F.lit(time), t).alias("x2"))
        return at.join(wind_at(where, field, planes, t[2]).withColumnsRenamed({"u": f"u{name}", "v": f"v{name}"}), "id")

    domain, x, y = fixed(F.col("domain"), F.col("x").cast("double"), F.col("y").cast("double"))
    now = saved(start.select("id", domain.cast("int").alias("domain"), x.alias("x"), y.alias("y")))
    out = now.select("id", F.lit(0).alias("step"), "domain", "x", "y")
    for k in range(steps):
        time = t0 + k * dt
        z = slope(now, time, F.lit(0.0), F.lit(0.0), "1")
        z = slope(z, time + dt / 2, dt / 2 * F.col("u1"), dt / 2 * F.col("v1"), "2")
        z = slope(z, time + dt / 2, dt / 2 * F.col("u2"), dt / 2 * F.col("v2"), "3")
        z = slope(z, time + dt, dt * F.col("u3"), dt * F.col("v3"), "4")
        move = lambda c, w: F.col(c) + dt / 6 * (F.col(f"{w}1") + 2 * F.col(f"{w}2") + 2 * F.col(f"{w}3") + F.col(f"{w}4"))
        domain, x, y = fixed(F.col("domain"), F.col("_x"), F.col("_y"))
        now = saved(z.select("id", "domain", move("x", "u").alias("_x"), move("y", "v").alias("_y")).select("id", domain.cast("int").alias("domain"), x.alias("x"), y.alias("y")))
        if (k + 1) % out_every == 0:
            out = out.unionByName(now.select("id", F.lit(k + 1).alias("step"), "domain", "x", "y"))
    return out


def wind_to_planes(wind: DataFrame, lons: int, lats: int, planes: Planes) -> DataFrame:
    """(domain, i0, i1, i2, u, v): a wind (i, j, i2, u, v) on even longitudes and latitudes, in km a unit of time to the east and north, on the planes.

    Winds are interpolated as vectors on the sphere, which have no jump at the poles, and turned to the planes' axes at their points, also beyond the equator: the
    planes' side has to go on so far that no step within a plane leaves it (a place outside takes the end cells' slope)."""
    a, b = F.radians(F.col("i") * 360 / lons), F.radians(F.col("j") * 180 / (lats - 1) - 90)
    east, north = [-F.sin(a), F.cos(a), F.lit(0.0)], [-F.sin(b) * F.cos(a), -F.sin(b) * F.sin(a), F.cos(b)]
    vector = wind.select("i", "j", "i2", *((F.col("u") * e + F.col("v") * n).alias(f"w{k}") for k, (e, n) in enumerate(zip(east, north, strict=True))))
    at = square(wind.sparkSession, planes).withColumns({"x0": F.col("lon") * lons / 360, "x1": (F.col("lat") + 90) * (lats - 1) / 180})
    met = corners(at, ["x0", "x1"], [lons + 1, lats]).withColumnsRenamed({"i": "ci", "j": "cj"}).withColumns({"i": F.col("i0") % lons, "j": F.col("i1")}).drop("i0", "i1")
    sums = met.join(vector, ["i", "j"]).groupBy("domain", F.col("ci").alias("i0"), F.col("cj").alias("i1"), "i2", "lon", "lat").agg(*(F.sum(F.col("w") * F.col(f"w{k}")).alias(f"w{k}") for k in range(3)))
    a, b = F.radians("lon"), F.radians("lat")
    u = -F.sin(a) * F.col("w0") + F.cos(a) * F.col("w1")
    v = -F.sin(b) * F.cos(a) * F.col("w0") - F.sin(b) * F.sin(a) * F.col("w1") + F.cos(b) * F.col("w2")
    px, py = wind_on_plane(F.col("domain"), F.col("lon"), F.col("lat"), u, v)
    return sums.select("domain", "i0", "i1", "i2", px.alias("u"), py.alias("v"))
