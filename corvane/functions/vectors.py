"""Distances and kernels between array columns, as expressions that stay in generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _pairs(a: Column, b: Column, f) -> Column:
    return F.zip_with(a, b, lambda x, y: f(x.cast("double"), y.cast("double")))


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + x)


def euclidean2(a: Column, b: Column) -> Column:
    return _sum(_pairs(a, b, lambda x, y: (x - y) * (x - y)))


def manhattan(a: Column, b: Column) -> Column:
    return _sum(_pairs(a, b, lambda x, y: F.abs(x - y)))


def manhattan2(a: Column, b: Column) -> Column:
    return manhattan(a, b) * manhattan(a, b)


def quartic(a: Column, b: Column) -> Column:
    return _sum(_pairs(a, b, lambda x, y: (x - y) * (x - y) * (x - y) * (x - y)))


def quad2(a: Column, b: Column) -> Column:
    return F.sqrt(quartic(a, b))


def chebyshev2(a: Column, b: Column) -> Column:
    return F.pow(F.array_max(_pairs(a, b, lambda x, y: F.abs(x - y))), F.lit(2.0))


#: The six metrics by their usual numbers.
METRICS = (euclidean2, manhattan2, quad2, chebyshev2, quartic, manhattan)


def dot(a: Column, b: Column) -> Column:
    return _sum(_pairs(a, b, lambda x, y: x * y))


def linear_kernel(a: Column, b: Column) -> Column:
    return dot(a, b)


def polynomial_kernel(a: Column, b: Column, gamma: float, shift: float, degree: int) -> Column:
    return F.pow(gamma * dot(a, b) + shift, F.lit(degree))


def radial_kernel(a: Column, b: Column, gamma: float) -> Column:
    return F.exp(-gamma * euclidean2(a, b))


def sigmoid_kernel(a: Column, b: Column, gamma: float, shift: float) -> Column:
    return F.tanh(gamma * dot(a, b) + shift)


def hellinger_kernel(a: Column, b: Column) -> Column:
    """Sum of sqrt(x y), for histograms."""
    return _sum(_pairs(a, b, lambda x, y: F.sqrt(x * y)))


def chi_squared_kernel(a: Column, b: Column) -> Column:
    """Sum of 2 x y / (x + y); a pair of zeros adds nothing."""
    return _sum(_pairs(a, b, lambda x, y: F.when(x + y == 0, 0.0).otherwise(2 * x * y / (x + y))))


def chi_squared_distance(a: Column, b: Column) -> Column:
    return _sum(_pairs(a, b, lambda x, y: F.when(x + y == 0, 0.0).otherwise((x - y) * (x - y) / (x + y))))


def intersection_kernel(a: Column, b: Column) -> Column:
    return _sum(_pairs(a, b, lambda x, y: F.least(x, y)))
