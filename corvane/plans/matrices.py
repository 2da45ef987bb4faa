"""Queries of sparse-matrix algebra, over lineitem as a matrix of orders by parts."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..operators import matrix as m
from .language import Session
from .registry import Registry

REGISTRY = query = Registry()

N = 40
A = f"a AS (SELECT l_orderkey % {N} AS i, l_partkey % {N} AS j, sum(l_quantity) AS v FROM lineitem GROUP BY ALL)"
B = f"b AS (SELECT l_partkey % {N} AS i, l_suppkey % {N} AS j, sum(l_quantity) AS v FROM lineitem GROUP BY ALL)"
X = f"x AS (SELECT s_suppkey % {N} AS i, round(sum(s_acctbal), 2) AS v FROM supplier GROUP BY 1)"


def a(read):
    return read("lineitem").groupBy((F.col("l_orderkey") % N).alias("i"), (F.col("l_partkey") % N).alias("j")).agg(F.sum("l_quantity").alias("v"))


def b(read):
    return read("lineitem").groupBy((F.col("l_partkey") % N).alias("i"), (F.col("l_suppkey") % N).alias("j")).agg(F.sum("l_quantity").alias("v"))


def x(read):
    return read("supplier").groupBy((F.col("s_suppkey") % N).alias("i")).agg(F.round(F.sum("s_acctbal"), 2).alias("v"))


def rounded(df, digits=3):
    return df.withColumn("v", F.round("v", digits))


@query(f"WITH {A}, {X} SELECT a.i, round(sum(a.v * x.v), 3) AS v FROM a JOIN x ON a.j = x.i GROUP BY a.i")
def coo_matvec(read, spark):
    return rounded(m.apply(a(read), x(read)))


@query(f"WITH {A}, {X} SELECT a.j AS i, round(sum(a.v * x.v), 3) AS v FROM a JOIN x ON a.i = x.i GROUP BY a.j")
def coo_left_matvec(read, spark):
    return rounded(m.apply_left(x(read), a(read)))


@query(f"WITH {A}, {B} SELECT a.i, b.j, round(sum(a.v * b.v), 3) AS v FROM a JOIN b ON a.j = b.i GROUP BY a.i, b.j")
def coo_matmul(read, spark):
    return rounded(m.times(a(read), b(read)))


@query(f"WITH {A}, {B} SELECT a.i, b.i AS j, round(sum(a.v * b.v), 3) AS v FROM a JOIN b ON a.j = b.j GROUP BY a.i, b.i")
def coo_matmul_transposed(read, spark):
    return rounded(m.times_transposed(a(read), b(read)))


@query(f"WITH {A}, {B} SELECT i, j, round(coalesce(a.v, 0) + coalesce(b.v, 0), 3) AS v FROM a FULL JOIN b USING (i, j)")
def coo_add(read, spark):
    return rounded(m.add(a(read), b(read)))


@query(f"WITH {A} SELECT j AS i, i AS j, v FROM a")
def coo_transpose(read, spark):
    return m.transpose(a(read))


@query(f"WITH {A} SELECT round(sqrt(sum(v * v)), 6) AS norm FROM a")
def coo_norm(read, spark):
    return m.norm(a(read)).select(F.round("norm", 6).alias("norm"))


@query(f"WITH {A}, d AS (SELECT r AS i, r AS j, 3.0 AS v FROM range({N}) t(r)) SELECT i, j, round(sum(v), 3)::DOUBLE AS v FROM (SELECT i, j, v * 2 AS v FROM a UNION ALL SELECT * FROM d) GROUP BY i, j")
def coo_affine(read, spark):
    return rounded(m.affine(a(read), 2.0, 3.0, N))


@query(f"WITH {A}, g AS (SELECT p AS i, q AS j FROM range({N}) s(p), range({N}) t(q)) SELECT g.i, g.j, round(coalesce(v, 0) + 1.5, 3)::DOUBLE AS v FROM g LEFT JOIN a ON a.i = g.i AND a.j = g.j")
def coo_add_scalar(read, spark):
    return rounded(m.add_scalar(a(read), N, N, 1.5))


@query(f"WITH {A}, {X} SELECT i, j, round(sum(v), 3) AS v FROM (SELECT * FROM a UNION ALL SELECT i, i, v FROM x) GROUP BY i, j")
def coo_add_diagonal(read, spark):
    return rounded(m.add_diagonal(a(read), x(read)))


@query(f"WITH {A} SELECT max(i) + 1 AS m, max(j) + 1 AS n, count(*) AS nel FROM a")
def coo_dimensions(read, spark):
    return m.dimensions(a(read))


@query(f"WITH {A} SELECT i, j, v FROM a WHERE abs(v) > 300")
def coo_remove_small(read, spark):
    return m.drop_small(a(read), 300)


@query(f"WITH {A} SELECT i, j, CASE WHEN i = j THEN 7.0::DOUBLE ELSE v END AS v FROM (SELECT * FROM a UNION ALL SELECT r, r, 7.0 FROM range({N}) t(r) WHERE NOT EXISTS (SELECT 1 FROM a WHERE i = r AND j = r))")
def coo_update(read, spark):
    new = spark.range(N).select(F.col("id").alias("i"), F.col("id").alias("j"), F.lit(7.0).alias("v"), F.col("id").alias("seq"))
    return m.upsert(a(read), new)


@query(f"WITH {A} SELECT t.r AS i, j, v FROM range(5) t(r) JOIN a ON a.i = t.r * 3")
def coo_subscript(read, spark):
    index = spark.range(5).select(F.col("id").alias("at"), (F.col("id") * 3).alias("i"))
    return m.gather(a(read), index)


@query(f"WITH {A}, {B}, {X}, s0 AS (SELECT b.i, sum(b.v * x.v) AS v FROM b JOIN x ON b.j = x.i GROUP BY b.i), s1 AS (SELECT a.i, sum(a.v * s0.v) AS v FROM a JOIN s0 ON a.j = s0.i GROUP BY a.i) SELECT 0 AS k, i, round(v, 2) AS v FROM s0 UNION ALL SELECT 1, i, round(v, 2) FROM s1")
def coo_chain_cumulative(read, spark):
    return rounded(m.apply_chain([b(read), a(read)], x(read), cumulative=True), 2)


@query(f"WITH {A}, {X} SELECT round(sum(a.v), 3) AS total, (SELECT round(sum(v * v), 3) FROM x) AS dot, (SELECT round(sqrt(sum(v * v)), 6) FROM x) AS length FROM a")
def vector_reductions(read, spark):
    v = x(read).agg(F.round(F.sum(F.col("v") * F.col("v")), 3).alias("dot"), F.round(F.sqrt(F.sum(F.col("v") * F.col("v"))), 6).alias("length"))
    return a(read).agg(F.round(F.sum("v"), 3).alias("total")).crossJoin(F.broadcast(v))


@query("SELECT unnest(range(9, 2, -1)) AS v")
def descending_range(read, spark):
    return spark.range(1).select(F.explode(F.sequence(F.lit(9).cast("long"), F.lit(3).cast("long"), F.lit(-1).cast("long"))).alias("v"))


@query(f"WITH {A}, {X}, s AS (SELECT a.i, sum(a.v * x.v) AS v FROM a JOIN x ON a.j = x.i GROUP BY a.i) SELECT i, round(2 * v, 2) AS v FROM s")
def calculator_language(read, spark):
    s = Session(spark, {"A": ("sparse", a(read)), "x": ("vector", x(read))})
    return rounded(s.run("y = A * x * 2")[1], 2)


def definite(read):
    """A'A + 500 I."""
    return m.affine(m.normal(m.scaled(a(read), 0.01)), 1.0, 500.0, N)


@query()
def conjugate_gradient(read, spark):
    s = definite(read)
    found, _ = m.conjugate_gradient(s, np.ones(N))
    return spark.createDataFrame([(i, float(v)) for i, v in enumerate(found)], "i int, v double")


@query()
def least_squares_normal(read, spark):
    found, _ = m.solve_normal(m.affine(m.scaled(a(read), 0.01), 1.0, 20.0, N), np.ones(N), N)
    return spark.createDataFrame([(i, float(v)) for i, v in enumerate(found)], "i int, v double")


@query()
def eigenvalues(read, spark):
    s = definite(read)
    return spark.createDataFrame([(w, k, float(v)) for w in ("LM", "SM", "LA", "SA", "BE") for k, v in enumerate(m.eigen(s, N, 4, w)[0])], "which string, k int, v double")


@query()
def singular_values(read, spark):
    return spark.createDataFrame([(k, float(v)) for k, v in enumerate(m.singular(a(read), N, N, 6)[1])], "k int, v double")


@query()
def inverse_matrix(read, spark):
    return m.invert(definite(read), N)


@query(f"WITH {A}, {B} SELECT coalesce(a.i, b.i) AS i, coalesce(a.j, b.j) AS j, CASE WHEN coalesce(a.v, 0) > coalesce(b.v, 0) THEN 1.0 ELSE 0.0 END::DOUBLE AS v FROM a FULL JOIN b ON a.i = b.i AND a.j = b.j")
def coo_compare(read, spark):
    return m.compare(a(read), b(read), ">")


@query(f"WITH {A} SELECT i, j, CASE WHEN v <= 200 THEN 1.0 ELSE 0.0 END::DOUBLE AS v FROM a")
def coo_compare_number(read, spark):
    return m.compare(a(read), 200, "<=")


@query(f"WITH {A} SELECT i // 2 AS i, j % 7 AS j, round(sum(v), 3) AS v FROM a WHERE i < 30 GROUP BY 1, 2")
def coo_map(read, spark):
    rows = spark.range(30).select(F.col("id").alias("old"), F.floor(F.col("id") / 2).alias("new"))
    columns = spark.range(N).select(F.col("id").alias("old"), (F.col("id") % 7).alias("new"))
    return rounded(m.mapped(a(read), rows, columns))


@query(f"WITH {A}, r AS (SELECT i, count(*) AS n, max(j) AS j FROM a GROUP BY i) SELECT max(i) + 1 AS rows, max(j) + 1 AS columns, sum(n)::BIGINT AS stored, sum(n) / ((max(i) + 1) * (max(j) + 1))::DOUBLE AS share, max(n) AS longest FROM r")
def coo_shape(read, spark):
    return m.shape(a(read))


@query(f"WITH {A}, o AS (SELECT i, j, 1.0 AS v FROM range({N}) p(i), range({N}) q(j)) SELECT o.i, o.j, round(o.v + coalesce(a.v, 0), 3)::DOUBLE AS v FROM o LEFT JOIN a ON a.i = o.i AND a.j = o.j")
def coo_ones(read, spark):
    return rounded(m.add(m.add(m.constant(spark, N, N), m.empty(spark)), a(read)))
