"""Sparse matrices as (i, j, v) rows, and lists of them that are applied but never multiplied out."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def transpose(a: DataFrame) -> DataFrame:
    return a.select(F.col("j").alias("i"), F.col("i").alias("j"), "v")


def times(a: DataFrame, b: DataFrame) -> DataFrame:
    """A B: an equi-join on the inner index and a sum, with partial sums before the shuffle."""
    return a.alias("a").join(b.alias("b"), F.col("a.j") == F.col("b.i")).groupBy(F.col("a.i").alias("i"), F.col("b.j").alias("j")).agg(F.sum(F.col("a.v") * F.col("b.v")).alias("v"))


def times_transposed(a: DataFrame, b: DataFrame) -> DataFrame:
    return times(a, transpose(b))


def apply(a: DataFrame, x: DataFrame) -> DataFrame:
    """A x for x of (i, v)."""
    return a.alias("a").join(x.alias("x"), F.col("a.j") == F.col("x.i")).groupBy(F.col("a.i").alias("i")).agg(F.sum(F.col("a.v") * F.col("x.v")).alias("v"))


def apply_left(x: DataFrame, a: DataFrame) -> DataFrame:
    return apply(transpose(a), x)


def apply_chain(chain: list[DataFrame], x: DataFrame, cumulative: bool = False) -> DataFrame:
    """... S1 S0 x: the first of the list is applied first, always to a vector. Cumulative: all steps, numbered k."""
    out = None
    for k, a in enumerate(chain):
        x = apply(a, x)
        step = x.withColumn("k", F.lit(k))
        out = step if out is None else out.unionByName(step)
    return out if cumulative else x


def add(a: DataFrame, b: DataFrame, scale: float = 1.0) -> DataFrame:
    return a.unionByName(b.withColumn("v", F.col("v") * scale)).groupBy("i", "j").agg(F.sum("v").alias("v"))


def scaled(a: DataFrame, m: float) -> DataFrame:
    return a.withColumn("v", F.col("v") * m)


def identity(spark, n: int) -> DataFrame:
    return spark.range(n).select(F.col("id").alias("i"), F.col("id").alias("j"), F.lit(1.0).alias("v"))


def affine(a: DataFrame, m: float, b: float, n: int) -> DataFrame:
    """m A + b I."""
    return add(scaled(a, m), scaled(identity(a.sparkSession, n), b))


def constant(spark, rows: int, columns: int, c: float = 1.0) -> DataFrame:
    """Every element stored, with the same value."""
    return spark.range(rows * columns).select(F.floor(F.col("id") / columns).alias("i"), (F.col("id") % columns).alias("j"), F.lit(float(c)).alias("v"))


def empty(spark) -> DataFrame:
    return spark.createDataFrame([], "i long, j long, v double")


#: Comparators of elements by their signs in expressions.
COMPARATORS = {"=": lambda a, b: a == b, "!": lambda a, b: a != b, ">": lambda a, b: a > b, "<": lambda a, b: a < b, ">=": lambda a, b: a >= b, "<=": lambda a, b: a <= b}


def compare(a: DataFrame, b: DataFrame | float, sign: str) -> DataFrame:
    """1 where an element of A stands in that relation to B's (or to a number), 0 elsewhere: of elements that either stores; what one
    of them doesn't store is 0."""
    test = COMPARATORS[sign]
    if not isinstance(b, DataFrame):
        return a.withColumn("v", test(F.col("v"), F.lit(float(b))).cast("double"))
    both = a.withColumnRenamed("v", "_a").join(b.withColumnRenamed("v", "_b"), ["i", "j"], "full_outer").fillna(0.0, ["_a", "_b"])
    return both.select("i", "j", test(F.col("_a"), F.col("_b")).cast("double").alias("v"))


def mapped(a: DataFrame, rows: DataFrame | None = None, columns: DataFrame | None = None) -> DataFrame:
    """A with its subscripts renumbered by tables (old, new); elements whose subscript has no new one are left out, and those that meet are added."""
    for name, table in (("i", rows), ("j", columns)):
        if table is not None:
            a = a.join(table.withColumnsRenamed({"old": name}), name).drop(name).withColumnRenamed("new", name)
    return a.groupBy("i", "j").agg(F.sum("v").alias("v"))


def shape(a: DataFrame) -> DataFrame:
    """(rows, columns, stored, share of elements that are stored, longest row)."""
    rows = a.groupBy("i").agg(F.count("*").alias("_n"), F.max("j").alias("_j"))
    s = rows.agg((F.max("i") + 1).alias("rows"), (F.max("_j") + 1).alias("columns"), F.sum("_n").alias("stored"), F.max("_n").alias("longest"))
    return s.select("rows", "columns", "stored", (F.col("stored") / (F.col("rows") * F.col("columns"))).alias("share"), "longest")


def add_diagonal(a: DataFrame, x: DataFrame) -> DataFrame:
    return add(a, x.select("i", F.col("i").alias("j"), "v"))


def add_scalar(a: DataFrame, rows: int, columns: int, c: float) -> DataFrame:
    """A + c in every element, stored or not."""
    spark = a.sparkSession
    grid = spark.range(rows * columns).select(F.floor(F.col("id") / columns).alias("i"), (F.col("id") % columns).alias("j"), F.lit(float(c)).alias("v"))
    return add(grid, a)


def norm(a: DataFrame) -> DataFrame:
    return a.agg(F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("norm"))


def dimensions(a: DataFrame) -> DataFrame:
    return a.agg((F.max("i") + 1).alias("m"), (F.max("j") + 1).alias("n"), F.count("*").alias("nel"))


def drop_small(a: DataFrame, eps: float = 0.0) -> DataFrame:
    return a.where(F.abs("v") > eps)


def upsert(a: DataFrame, updates: DataFrame) -> DataFrame:
    """The last write to an element wins: rows of `updates` (i, j, v, seq) over those of `a`."""
    return a.withColumn("seq", F.lit(-1).cast("long")).unionByName(updates.withColumn("seq", F.col("seq").cast("long"))).groupBy("i", "j").agg(F.max_by("v", "seq").alias("v"))


def gather(a: DataFrame, index: DataFrame) -> DataFrame:
    """Rows of A by an index table (at, i)."""
    return index.join(a, "i").select(F.col("at").alias("i"), "j", "v")


def normal(a: DataFrame) -> DataFrame:
    return times(transpose(a), a)


def _vector(df: DataFrame, n: int) -> np.ndarray:
    out = np.zeros(n)
    for r in df.collect():
        out[r["i"]] += r["v"]
    return out


def conjugate_gradient(a: DataFrame, b: np.ndarray, tolerance: float = 1e-10, most: int = 500, precondition: DataFrame | None = None) -> tuple[np.ndarray, int]:
    """Solves A x = b for a symmetric positive definite A (i, j, v). The matrix stays distributed and cached; vectors are on the driver.

    `precondition`: the inverse of a diagonal preconditioner as (i, v)."""
    spark, n = a.sparkSession, len(b)
    a = a.cache()
    m = _vector(precondition, n) if precondition is not None else np.ones(n)
    product = lambda p: _vector(apply(a, spark.createDataFrame([(int(i), float(v)) for i, v in enumerate(p) if v], "i long, v double")), n)
    x, r = np.zeros(n), b.astype(float).copy()
    z = m * r
    p, old, steps = z.copy(), float(r @ z), 0
    while steps < most and np.linalg.norm(r) > tolerance * max(1e-300, np.linalg.norm(b)):
        ap = product(p)
        step = old / float(p @ ap)
        x, r = x + step * p, r - step * ap
        z = m * r
        new = float(r @ z)
        p, old, steps = z + new / old * p, new, steps + 1
    a.unpersist()
    return x, steps


def solve_normal(a: DataFrame, b: np.ndarray, columns: int, **options) -> tuple[np.ndarray, int]:
    """Least squares by conjugate gradients on A'A."""
    spark = a.sparkSession
    rhs = _vector(apply(transpose(a), spark.createDataFrame([(int(i), float(v)) for i, v in enumerate(b)], "i long, v double")), columns)
    return conjugate_gradient(normal(a), rhs, **options)


def dense(a: DataFrame, rows: int, columns: int, most: int = 4_000_000) -> np.ndarray:
    """A small matrix on the driver; larger ones are refused."""
    if rows * columns > most:
        raise ValueError(f"{rows} by {columns} is too large for the driver")
    out = np.zeros((rows, columns))
    for r in a.collect():
        out[r["i"], r["j"]] += r["v"]
    return out


def eigen(a: DataFrame, n: int, k: int, which: str = "LM") -> tuple[np.ndarray, np.ndarray]:
    """k eigenvalues and vectors of a symmetric matrix: LM, SM (magnitude), LA, SA (algebraic) or BE (both ends)."""
    w, v = np.linalg.eigh(dense(a, n, n))
    order = {"LM": np.argsort(-np.abs(w)), "SM": np.argsort(np.abs(w)), "LA": np.argsort(-w), "SA": np.argsort(w), "BE": np.array([x for p in zip(range(n), range(n - 1, -1, -1), strict=True) for x in p])[:n]}[which][:k]
    return w[order], v[:, order]


def singular(a: DataFrame, rows: int, columns: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    u, s, vt = np.linalg.svd(dense(a, rows, columns), full_matrices=False)
    return u[:, :k], s[:k], vt[:k]


def invert(a: DataFrame, n: int, condition: float = 1e-12) -> DataFrame:
    """The (pseudo-)inverse of a small matrix."""
    x = np.linalg.pinv(dense(a, n, n), rcond=condition)
    return a.sparkSession.createDataFrame([(int(i), int(j), float(x[i, j])) for i, j in zip(*np.nonzero(x), strict=True)], "i long, j long, v double")
