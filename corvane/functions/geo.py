"""Positions on the globe and on azimuthal-equidistant planes."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Kilometres to a degree of latitude, and the Earth's radius that follows.
KM_DEGREE = 10_000.0 / 90
RADIUS = KM_DEGREE * 180 / math.pi


def to_plane(lon: Column, lat: Column) -> tuple[Column, Column, Column]:
    """x, y (km) and hemisphere (1 north, -1 south) of the azimuthal-equidistant projection about the nearer pole."""
    hemi = F.when(lat < 0, -1).otherwise(1)
    r = RADIUS * (math.pi / 2 - F.radians(hemi * lat))
    return r * F.cos(F.radians(lon)), r * F.sin(F.radians(lon)), hemi


def from_plane(x: Column, y: Column, hemi: Column) -> tuple[Column, Column]:
    lat = hemi * F.degrees(math.pi / 2 - F.sqrt(x * x + y * y) / RADIUS)
    lon = F.degrees(F.atan2(y, x))
    return F.when(lon < 0, lon + 360).otherwise(lon), lat


def metric_coefficients(x: Column, y: Column) -> tuple[Column, Column, Column]:
    """(g11, g12, g22) of ds^2 on the plane: radial distances are true, others shrink by R sin(r / R) / r."""
    r2 = x * x + y * y
    s = F.when(r2 == 0, 1.0).otherwise(RADIUS * F.sin(F.sqrt(r2) / RADIUS) / F.sqrt(r2))
    s2 = s * s
    safe = F.when(r2 == 0, 1.0).otherwise(r2)
    return (x * x + s2 * y * y) / safe, x * y * (1 - s2) / safe, (y * y + s2 * x * x) / safe


def great_circle(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Distance in km; null if a coordinate is."""
    dlat, dlon = F.radians(lat2 - lat1) / 2, F.radians(lon2 - lon1) / 2
    h = F.sin(dlat) * F.sin(dlat) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.sin(dlon) * F.sin(dlon)
    return 2 * RADIUS * F.asin(F.sqrt(F.when(h > 1, 1.0).otherwise(h)))


def unit_vector(lon: Column, lat: Column) -> tuple[Column, Column, Column]:
    """The place on a sphere of radius 1."""
    a, b = F.radians(lon), F.radians(lat)
    return F.cos(b) * F.cos(a), F.cos(b) * F.sin(a), F.sin(b)


def to_plane_velocity(lon: Column, lat: Column, u: Column, v: Column) -> tuple[Column, Column]:
    """The velocity on the plane of to_plane of a wind `u` to the east and `v` to the north, in the same unit."""
    hemi = F.when(lat < 0, -1).otherwise(1)
    r = RADIUS * (math.pi / 2 - F.radians(hemi * lat))
    turn = u / (RADIUS * F.cos(F.radians(lat)))
    a = F.radians(lon)
    return -hemi * v * F.cos(a) - r * F.sin(a) * turn, -hemi * v * F.sin(a) + r * F.cos(a) * turn


def potential_temperature(t: Column, p: Column, p0: float = 1000.0, kappa: float = 0.2857) -> Column:
    return t * F.pow(F.lit(p0) / p, F.lit(kappa))
