"""Queries of estimation and evaluation: neighbours, kernels, contingency, calibration, coding matrices."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..functions import vectors
from ..operators import cluster, evaluate, kernel, multiclass, neighbours, prepare
from .registry import Registry

REGISTRY = query = Registry()

#: Searches take every row whose id is divisible by 20 as queries, against all rows.
K, PROBES = 11, "vec_id % 20 = 0"
D2 = "list_sum(list_transform(range(1, len(p.embedding) + 1), lambda i: (p.embedding[i]::DOUBLE - t.embedding[i]::DOUBLE) ** 2))"
NEAR = f"""near AS (
    SELECT * FROM (
        SELECT p.vec_id AS probe, t.vec_id AS train, t.label AS label, {D2} AS d2, row_number() OVER (PARTITION BY p.vec_id ORDER BY {D2}, t.vec_id) AS rank
        FROM embeddings p JOIN embeddings t ON p.vec_id % 20 = 0
    ) WHERE rank <= 12)"""


def sides(read):
    e = read("embeddings")
    return tuple(e.where(c).select(F.col("vec_id").alias("id"), F.col("embedding").alias("x"), "label") for c in (PROBES, "true"))


def near(read, k=K, metric=0):
    probes, train = sides(read)
    return neighbours.nearest(probes.select("id", "x"), train.select("id", "x"), k, metric)


@query(f"""
    WITH {NEAR}, c AS (SELECT count(DISTINCT label) AS nc FROM embeddings), v AS (SELECT probe, label, count(*) AS n FROM near WHERE rank <= {K} GROUP BY ALL),
    w AS (SELECT *, row_number() OVER (PARTITION BY probe ORDER BY n DESC, label) AS r FROM v)
    SELECT probe, label, round(n / {K}, 9) AS p, round((nc * (n / {K}) - 1) / (nc - 1), 9) AS con FROM w, c WHERE r = 1""")
def knn_classify(read, spark):
    _, train = sides(read)
    classes = read("embeddings").agg(F.count_distinct("label")).first()[0]
    out = neighbours.knn_classify(near(read), train, K, classes)
    return out.select("probe", "label", F.round("p", 9).alias("p"), F.round("con", 9).alias("con"))


@query(f"WITH {NEAR} SELECT probe, train, CAST(rank AS INTEGER) AS rank, round(d2, 6) AS d2 FROM near WHERE rank <= 5")
def knn_pairs(read, spark):
    return near(read, 5).select("probe", "train", "rank", F.round("d2", 6).alias("d2"))


@query(f"WITH {NEAR} SELECT probe, round(avg(label), 6) AS y, round(stddev_samp(label), 6) AS std FROM near WHERE rank <= {K} GROUP BY probe")
def knn_regress(read, spark):
    _, train = sides(read)
    out = neighbours.knn_regress(near(read), train.select("id", F.col("label").cast("double").alias("y")), K)
    return out.select("probe", F.round("y", 6).alias("y"), F.round("std", 6).alias("std"))


@query(f"""
    WITH {NEAR}, s AS (SELECT len(any_value(embedding)) AS d, count(*) AS n FROM embeddings),
    r AS (SELECT probe, avg(sqrt(d2)) AS r FROM near WHERE rank IN ({K}, {K + 1}) GROUP BY probe)
    SELECT probe, round(r, 6) AS r, round(lgamma(d / 2 + 1) + ln({K}) - d / 2 * ln(pi()) - ln(n) - d * ln(r), 5) AS log_pdf FROM r, s""")
def knn_pdf(read, spark):
    _, train = sides(read)
    size, rows = train.select(F.size("x")).first()[0], train.count()
    out = neighbours.knn_density(near(read, K + 1), K, size, rows)
    return out.select("probe", F.round("r", 6).alias("r"), F.round("log_pdf", 5).alias("log_pdf"))


@query("""
    WITH e AS (SELECT a.vec_id AS a, b.vec_id AS b, list_transform(range(1, len(a.embedding) + 1), lambda i: a.embedding[i]::DOUBLE - b.embedding[i]::DOUBLE) AS d
        FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1)
    SELECT a, b, round(list_sum(list_transform(d, lambda x: x * x)), 6) AS m0, round(list_sum(list_transform(d, lambda x: abs(x))) ** 2, 6) AS m1, round(sqrt(list_sum(list_transform(d, lambda x: x ** 4))), 6) AS m2,
        round(list_max(list_transform(d, lambda x: abs(x))) ** 2, 6) AS m3, round(list_sum(list_transform(d, lambda x: x ** 4)), 6) AS m4, round(list_sum(list_transform(d, lambda x: abs(x))), 6) AS m5 FROM e""")
def metric_six(read, spark):
    e = read("embeddings")
    a, b = e.select(F.col("vec_id").alias("a"), F.col("embedding").alias("x")), e.select(F.col("vec_id").alias("b"), F.col("embedding").alias("y"))
    return a.join(b, F.col("b") == F.col("a") + 1).select("a", "b", *(F.round(m(F.col("x"), F.col("y")), 6).alias(f"m{i}") for i, m in enumerate(vectors.METRICS)))


@query("""
    WITH e AS (SELECT a.vec_id AS a, list_transform(range(1, len(a.embedding) + 1), lambda i: [a.embedding[i]::DOUBLE, b.embedding[i]::DOUBLE]) AS z
        FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1),
    s AS (SELECT a, list_sum(list_transform(z, lambda p: p[1] * p[2])) AS d, list_sum(list_transform(z, lambda p: (p[1] - p[2]) ** 2)) AS d2,
        list_sum(list_transform(z, lambda p: sqrt(p[1] ** 2 * p[2] ** 2))) AS h, list_sum(list_transform(z, lambda p: least(p[1] ** 2, p[2] ** 2))) AS m, list_sum(list_transform(z, lambda p: CASE WHEN p[1] ** 2 + p[2] ** 2 = 0 THEN 0 ELSE 2 * p[1] ** 2 * p[2] ** 2 / (p[1] ** 2 + p[2] ** 2) END)) AS c FROM e)
    SELECT a, round(d, 6) AS linear, round((0.5 * d + 1) ** 3, 6) AS polynomial, round(exp(-0.1 * d2), 6) AS radial, round(tanh(0.01 * d + 0.1), 6) AS sigmoid, round(h, 6) AS hellinger, round(m, 6) AS intersection, round(c, 6) AS chi_squared FROM s""")
def kernel_functions(read, spark):
    e = read("embeddings")
    a, b = e.select(F.col("vec_id").alias("a"), F.col("embedding").alias("x")), e.select(F.col("vec_id").alias("b"), F.col("embedding").alias("y"))
    x, y = F.col("x"), F.col("y")
    square = lambda c: F.transform(c, lambda v: v.cast("double") * v.cast("double"))
    kernels = {"linear": vectors.linear_kernel(x, y), "polynomial": vectors.polynomial_kernel(x, y, 0.5, 1, 3), "radial": vectors.radial_kernel(x, y, 0.1), "sigmoid": vectors.sigmoid_kernel(x, y, 0.01, 0.1), "hellinger": vectors.hellinger_kernel(square(x), square(y)), "intersection": vectors.intersection_kernel(square(x), square(y)), "chi_squared": vectors.chi_squared_kernel(square(x), square(y))}
    return a.join(b, F.col("b") == F.col("a") + 1).select("a", *(F.round(k, 6).alias(n) for n, k in kernels.items()))


@query("SELECT j, round(ave, 6) AS ave, round(std, 6) AS std FROM (SELECT CAST(i - 1 AS INTEGER) AS j, avg(embedding[i]::DOUBLE) AS ave, stddev_samp(embedding[i]::DOUBLE) AS std FROM embeddings, range(1, (SELECT len(any_value(embedding)) + 1 FROM embeddings)) r(i) GROUP BY i)")
def feature_norm_stats(read, spark):
    s = prepare.feature_stats(read("embeddings"), "embedding")
    return s.select("j", F.round("ave", 6).alias("ave"), F.round("std", 6).alias("std"))


@query("""
    WITH s AS (SELECT i, avg(embedding[i]::DOUBLE) AS ave, stddev_samp(embedding[i]::DOUBLE) AS std FROM embeddings, range(1, (SELECT len(any_value(embedding)) + 1 FROM embeddings)) r(i) GROUP BY i)
    SELECT vec_id, CAST(i - 1 AS INTEGER) AS j, round((embedding[i]::DOUBLE - ave) / std, 6) AS v FROM embeddings, s""")
def feature_normalize(read, spark):
    e = read("embeddings").select("vec_id", F.col("embedding").alias("x"))
    out = prepare.normalise(e, prepare.feature_stats(e))
    return out.select("vec_id", F.posexplode("x").alias("j", "v")).select("vec_id", "j", F.round("v", 6).alias("v"))


@query("SELECT CAST(i - 1 AS INTEGER) AS i, CAST(j - 1 AS INTEGER) AS j, round(covar_samp(embedding[i]::DOUBLE, embedding[j]::DOUBLE), 6) AS cov, round(corr(embedding[i]::DOUBLE, embedding[j]::DOUBLE), 6) AS corr FROM embeddings, range(1, (SELECT len(any_value(embedding)) + 1 FROM embeddings)) a(i), range(1, (SELECT len(any_value(embedding)) + 1 FROM embeddings)) b(j) WHERE i <= j GROUP BY i, j")
def feature_covariance(read, spark):
    c = prepare.covariance(read("embeddings"), "embedding")
    return c.select("i", "j", F.round("cov", 6).alias("cov"), F.round("corr", 6).alias("corr"))


@query("SELECT vec_id, round((embedding[1]::DOUBLE - 0.5) * 2 + (embedding[2]::DOUBLE + 1) * 3, 6) AS u, round((embedding[1]::DOUBLE - 0.5) - (embedding[2]::DOUBLE + 1), 6) AS v FROM embeddings")
def affine_transform(read, spark):
    x = prepare.affine(F.col("embedding"), [0.5, -1.0], [[2.0, 1.0], [3.0, -1.0]])
    return read("embeddings").select("vec_id", F.round(x[0], 6).alias("u"), F.round(x[1], 6).alias("v"))


LABELS = "FROM labels WHERE quality IS NOT NULL AND toxic IS NOT NULL"


def judged(read):
    return read("labels").where("quality is not null and toxic is not null").select("doc_id", F.col("quality").alias("truth"), F.col("toxic").alias("ret"))


@query(f"SELECT quality AS truth, toxic AS ret, count(*) AS n {LABELS} GROUP BY CUBE (quality, toxic)")
def contingency_cube(read, spark):
    return evaluate.contingency(judged(read))


@query(f"""
    WITH c AS (SELECT quality AS t, toxic AS r, count(*) AS n {LABELS} GROUP BY ALL),
    h AS (SELECT -sum(n * ln(n)) AS hrt, sum(n) AS s FROM c), t AS (SELECT -sum(m * ln(m)) AS ht FROM (SELECT sum(n) AS m FROM c GROUP BY t)), r AS (SELECT -sum(m * ln(m)) AS hr FROM (SELECT sum(n) AS m FROM c GROUP BY r)),
    u AS (SELECT ht - hrt + hr + s * ln(s) AS uc, * FROM h, t, r)
    SELECT round(uc / (ht + s * ln(s)), 9) AS uc, round(uc / (hr + s * ln(s)), 9) AS ucr, round(2 * uc / (hr + ht + 2 * s * ln(s)), 9) AS ucs FROM u""")
def uncertainty_coefficient(read, spark):
    return evaluate.uncertainty(judged(read)).select(*(F.round(c, 9).alias(c) for c in ("uc", "ucr", "ucs")))


@query(f"SELECT round(avg(CAST(quality = toxic AS DOUBLE)), 9) AS accuracy, count(*) AS n {LABELS}")
def class_accuracy(read, spark):
    return evaluate.accuracy(judged(read)).select(F.round("accuracy", 9).alias("accuracy"), "n")


@query(f"""
    WITH s AS (SELECT sum(quality)::DOUBLE AS nt, (count(*) - sum(quality))::DOUBLE AS nf, sum(quality * toxic)::DOUBLE AS ht, sum((1 - quality) * toxic)::DOUBLE AS hf {LABELS})
    SELECT round((ht + nf - hf) / (nt + nf), 9) AS acc, round(((nt + nf) * ht - nt * (ht + hf)) / sqrt(nt * nf * (ht + hf) * (nt + nf - ht - hf)), 9) AS corr FROM s""")
def binary_skill(read, spark):
    t, r = F.col("truth"), F.col("ret")
    s = judged(read).agg(F.sum(t).cast("double").alias("nt"), F.sum(1 - t).cast("double").alias("nf"), F.sum(t * r).cast("double").alias("ht"), F.sum((1 - t) * r).cast("double").alias("hf"))
    k = evaluate.skills(*(F.col(c) for c in ("nt", "nf", "ht", "hf")))
    return s.select(F.round(k["acc"], 9).alias("acc"), F.round(k["corr"], 9).alias("corr"))


@query("""
    WITH d AS (SELECT least(n_chars / 10000.0, 1)::DOUBLE AS con, toxic AS hit FROM documents JOIN labels USING (doc_id))
    SELECT CAST(least(greatest(floor(con * 8), 0), 7) AS INTEGER) AS bin, round(avg(con), 9) AS con, round(avg(hit), 9) AS acc, count(*) AS n FROM d GROUP BY 1""")
def reliability_bins(read, spark):
    r = evaluate.reliability(scored(read), 8, "con", "hit")
    return r.select("bin", F.round("con", 9).alias("con"), F.round("acc", 9).alias("acc"), "n")


UC = lambda nt, nf, ht, hf: f"""(XL({nt} + {nf}) - XL({nt}) - XL({nf}) + XL({ht}) + XL({hf}) + XL({nt} - {ht}) + XL({nf} - {hf}) - XL({ht} + {hf}) - XL({nt} + {nf} - {ht} - {hf})) / (XL({nt} + {nf}) - XL({nt}) - XL({nf}))"""


def with_logs(sql):
    """SQL in which XL(x) is x log x, 0 at 0."""
    out, at = "", 0
    while (k := sql.find("XL(", at)) >= 0:
        depth, end = 1, k + 3
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[end], 0)
            end += 1
        x = sql[k + 3 : end - 1]
        out, at = out + sql[at:k] + f"CASE WHEN {x} > 0 THEN ({x}) * ln({x}) ELSE 0 END", end
    return out + sql[at:]


@query(with_logs(f"""
    WITH s AS (SELECT sum(quality)::DOUBLE AS nt, (count(*) - sum(quality))::DOUBLE AS nf, sum(quality * toxic)::DOUBLE AS ht, sum((1 - quality) * toxic)::DOUBLE AS hf {LABELS})
    SELECT round({UC("nt", "nf", "ht", "hf")}, 9) AS uc FROM s"""))
def binary_uncertainty(read, spark):
    t, r = F.col("truth"), F.col("ret")
    s = judged(read).agg(F.sum(t).cast("double").alias("nt"), F.sum(1 - t).cast("double").alias("nf"), F.sum(t * r).cast("double").alias("ht"), F.sum((1 - t) * r).cast("double").alias("hf"))
    return s.select(F.round(evaluate.skills(*(F.col(c) for c in ("nt", "nf", "ht", "hf")))["uc"], 9).alias("uc"))


@query(with_logs(f"""
    WITH d AS (SELECT n_chars::DOUBLE AS s, toxic AS t FROM documents JOIN labels USING (doc_id)), g AS (SELECT s, sum(t)::DOUBLE AS n1, count(*)::DOUBLE AS n FROM d GROUP BY s),
    u AS (SELECT s, sum(n1) OVER () AS nt, sum(n - n1) OVER () AS nf, sum(n1) OVER () - sum(n1) OVER (ORDER BY s) AS ht, sum(n - n1) OVER () - sum(n - n1) OVER (ORDER BY s) AS hf FROM g)
    SELECT s, round((ht + nf - hf) / (nt + nf), 9) AS acc, round({UC("nt", "nf", "ht", "hf")}, 8) + 0.0 AS uc FROM u"""))
def threshold_skills(read, spark):
    return evaluate.threshold_skills(scored(read), "score", "hit").select("s", F.round("acc", 9).alias("acc"), (F.round("uc", 8) + 0.0).alias("uc"))


@query("""
    WITH d AS (SELECT 2 * least(n_chars / 10000.0, 1)::DOUBLE - 1 AS r, toxic AS t FROM documents JOIN labels USING (doc_id)), b AS (SELECT *, CAST(least(greatest(floor((r + 1) * 5), 0), 9) AS INTEGER) AS bin FROM d)
    SELECT bin, round(avg(r), 9) AS r, round((2 * avg(((CASE WHEN r < 0 THEN 0 ELSE 1 END) = t)::INTEGER) - 1) * CASE WHEN bin < 5 THEN -1 ELSE 1 END, 9) + 0.0 AS acc, count(*) AS n FROM b GROUP BY bin""")
def signed_reliability(read, spark):
    d = scored(read).withColumn("r", 2 * F.col("con") - 1)
    return evaluate.signed_reliability(d, 5, "r", "hit").select("bin", F.round("r", 9).alias("r"), (F.round("acc", 9) + 0.0).alias("acc"), "n")


def scored(read):
    d = read("documents").select("doc_id", "n_chars").join(read("labels").select("doc_id", "toxic", "quality"), "doc_id")
    return d.select("doc_id", F.col("n_chars").cast("double").alias("score"), F.least(F.col("n_chars") / 10000, F.lit(1.0)).alias("con"), F.col("toxic").alias("hit"))


@query("""
    WITH d AS (SELECT least(n_chars / 10000.0, 1)::DOUBLE AS p, toxic::DOUBLE AS t FROM documents JOIN labels USING (doc_id)),
    o AS (SELECT p, t, row_number() OVER (ORDER BY p, t) - 1 AS i FROM d), m AS (SELECT greatest(count(*) FILTER (p <= 0.25) - 1, 0) AS mid, count(*) AS n FROM d),
    low AS (SELECT i, sum(p - 1) OVER w AS sp, sum(t - 1) OVER w AS st FROM o, m WHERE i < mid WINDOW w AS (ORDER BY i DESC ROWS UNBOUNDED PRECEDING)),
    high AS (SELECT i + 1 AS i, sum(p) OVER w AS sp, sum(t) OVER w AS st FROM o, m WHERE i >= mid WINDOW w AS (ORDER BY i ROWS UNBOUNDED PRECEDING)),
    c AS (SELECT sp, st FROM low UNION ALL SELECT sp, st FROM high UNION ALL SELECT 0, 0)
    SELECT round(corr(st, sp), 6) AS r, round(sum(st * sp) / sum(st * st), 6) AS slope, (SELECT round(sqrt(avg((p - t) ** 2)), 6) FROM d) AS brier FROM c""")
def probability_validation(read, spark):
    return evaluate.probability_scores(scored(read), "con", "hit", 0.25).select(*(F.round(c, 6).alias(c) for c in ("r", "slope", "brier")))


ROC = """WITH d AS (SELECT n_chars::DOUBLE AS s, toxic AS t FROM documents JOIN labels USING (doc_id)),
    c AS (SELECT s, sum(t) AS n1, count(*) - sum(t) AS n0 FROM d GROUP BY s),
    u AS (SELECT *, sum(n1) OVER (ORDER BY s) AS u1, sum(n0) OVER (ORDER BY s) AS u0, sum(n1) OVER () AS a1, sum(n0) OVER () AS a0 FROM c)"""


@query(f"{ROC} SELECT s, round(1 - u1 / a1, 9) AS hit, round(1 - u0 / a0, 9) AS false_alarm FROM u")
def roc_curve(read, spark):
    return evaluate.roc(scored(read), "score", "hit").select("s", F.round("hit", 9).alias("hit"), F.round("false_alarm", 9).alias("false_alarm"))


@query(f"{ROC} SELECT round(sum(n1 * (u0 - n0 + n0 / 2)) / max(a1 * a0), 9) AS auc FROM u")
def roc_auc(read, spark):
    return evaluate.auc(scored(read), "score", "hit").select(F.round("auc", 9).alias("auc"))


@query(f"""{ROC}, k AS (SELECT s, a1::DOUBLE AS nt, a0::DOUBLE AS nf, (a1 - u1)::DOUBLE AS ht, (a0 - u0)::DOUBLE AS hf FROM u),
    r AS (SELECT s, round(((nt + nf) * ht - nt * (ht + hf)) / nullif(sqrt(nt * nf * (ht + hf) * (nt + nf - ht - hf)), 0), 9) AS corr FROM k)
    SELECT s AS threshold, corr FROM r WHERE corr IS NOT NULL ORDER BY corr DESC, s LIMIT 1""")
def best_threshold(read, spark):
    return evaluate.best_threshold(scored(read), "score", "hit")


@query("""
    WITH d AS (SELECT doc_id, 2 * least(n_chars / 10000.0, 0.99)::DOUBLE - 1 AS r, toxic FROM documents JOIN labels USING (doc_id)),
    w AS (SELECT doc_id, avg(atanh(r)) OVER o AS x, avg(toxic) OVER o AS acc, count(*) OVER o AS n FROM d WINDOW o AS (ORDER BY r, doc_id ROWS BETWEEN CURRENT ROW AND 24 FOLLOWING))
    SELECT doc_id, round(x, 6) AS x, round(acc, 6) AS acc FROM w WHERE n = 25""")
def moving_accuracy(read, spark):
    d = scored(read).withColumn("r", 2 * F.least(F.col("con"), F.lit(0.99)) - 1)
    return evaluate.moving_accuracy(d, "r", "hit", 25, "doc_id").select("doc_id", F.round("x", 6).alias("x"), F.round("acc", 6).alias("acc"))


@query("""
    WITH e AS (SELECT (label % 3)::INTEGER AS c, list_transform(range(1, 4), lambda i: exp(embedding[i]::DOUBLE) / 10) AS p FROM embeddings), n AS (SELECT c, count(*)::DOUBLE AS n FROM e GROUP BY c), t AS (SELECT count(*)::DOUBLE AS n FROM e)
    SELECT (SELECT -sum(n.n * log2(p[n.c + 1])) / any_value(t.n) / any_value(t.n) FROM e, n, t)::DECIMAL(18, 6)::DOUBLE AS h_joint, (SELECT -sum(n.n * log2(p[n.c + 1] / list_sum(p))) / any_value(t.n) / any_value(t.n) FROM e, n, t)::DECIMAL(18, 6)::DOUBLE AS h_cond,
        (SELECT -avg(log2(list_sum(p))) FROM e)::DECIMAL(18, 6)::DOUBLE AS h_total, (SELECT -sum(n.n * log2(n.n / t.n)) / any_value(t.n) FROM n, t)::DECIMAL(18, 6)::DOUBLE AS h_class""")
def joint_entropy(read, spark):
    d = read("embeddings").select((F.col("label") % 3).alias("c"), F.transform(F.slice("embedding", 1, 3), lambda x: F.exp(x.cast("double")) / 10).alias("p"))
    return evaluate.joint_entropy(d, "c", "p", 3).select(*(F.round(c, 6).alias(c) for c in ("h_joint", "h_cond", "h_total", "h_class")))


@query("""
    WITH q AS (SELECT a.label AS la, b.label AS lb, a.vec_id AS a, min(list_sum(list_transform(range(1, len(a.embedding) + 1), lambda i: (a.embedding[i]::DOUBLE - b.embedding[i]::DOUBLE) ** 2))) AS d FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id GROUP BY ALL)
    SELECT least(la, lb) AS la, greatest(la, lb) AS lb, round(max(d), 6) AS h FROM q GROUP BY 1, 2""")
def class_hausdorff(read, spark):
    e = read("embeddings").select(F.col("vec_id").alias("id"), "label", F.col("embedding").alias("x"))
    return cluster.hausdorff(e).select("la", "lb", F.round("h", 6).alias("h"))


@query("""
    WITH b AS (SELECT vec_id AS k, list_transform(embedding, lambda v: v::DOUBLE * 0.9) AS border, list_transform(embedding, lambda v: v::DOUBLE * 0.5 + 0.1) AS grad FROM embeddings),
    n AS (SELECT p.vec_id AS id, k, border, grad, p.embedding AS x, row_number() OVER (PARTITION BY p.vec_id ORDER BY list_sum(list_transform(range(1, len(border) + 1), lambda i: (p.embedding[i]::DOUBLE - border[i]::DOUBLE) ** 2)), k) AS r FROM embeddings p, b WHERE p.vec_id % 20 = 0),
    d AS (SELECT id, k, tanh(list_sum(list_transform(range(1, len(border) + 1), lambda i: grad[i] * (x[i]::DOUBLE - border[i]::DOUBLE)))) AS r FROM n WHERE r = 1)
    SELECT id, k, round(r, 6) AS r, CAST(r > 0 AS INTEGER) AS cls FROM d""")
def border_classify(read, spark):
    from ..operators.borders import classify

    e = read("embeddings")
    borders = e.select(F.col("vec_id").alias("k"), F.transform("embedding", lambda v: v.cast("double") * 0.9).alias("border"), F.transform("embedding", lambda v: v.cast("double") * 0.5 + 0.1).alias("grad"))
    return classify(e.where(PROBES).select(F.col("vec_id").alias("id"), F.col("embedding").alias("x")), borders).select("id", "k", F.round("r", 6).alias("r"), "cls")


@query("""
    WITH r AS (SELECT vec_id AS id, i AS row, embedding[i + 1]::DOUBLE AS r FROM embeddings, range(6) t(i)),
    c(row, cls, code) AS (VALUES (0, 0, -1), (0, 1, 1), (1, 0, -1), (1, 2, 1), (2, 0, -1), (2, 3, 1), (3, 1, -1), (3, 2, 1), (4, 1, -1), (4, 3, 1), (5, 2, -1), (5, 3, 1)),
    s AS (SELECT id, cls, sum(code * sign(r)) AS s FROM r JOIN c USING (row) GROUP BY id, cls)
    SELECT id, CAST(cls AS INTEGER) AS cls, s::DOUBLE AS s FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY s DESC, cls) AS k FROM s) WHERE k = 1""")
def vote_decode(read, spark):
    return multiclass.vote(binary_values(read, 6), multiclass.codes(spark, multiclass.one_against_one(4)))


def binary_values(read, n):
    return read("embeddings").select(F.col("vec_id").alias("id"), F.posexplode(F.slice("embedding", 1, n)).alias("row", "r")).withColumn("r", F.col("r").cast("double"))


@query("""
    WITH r AS (SELECT vec_id AS id, greatest(least(embedding[1]::DOUBLE, 1), -1) AS a, greatest(least(embedding[2]::DOUBLE, 1), -1) AS b FROM embeddings)
    SELECT id, CAST(CASE WHEN a <= 0 THEN 0 WHEN b <= 0 THEN 1 ELSE 2 END AS INTEGER) AS cls, round(CASE WHEN a <= 0 THEN (1 + abs(a)) / 2 ELSE (1 + abs(a)) / 2 * (1 + abs(b)) / 2 END, 9) AS p FROM r""")
def hier_route(read, spark):
    tree = multiclass.edges(spark, multiclass.parse_control('"top" { 0 "low" { 1 2 } }'))
    r = binary_values(read, 2).select("id", F.col("row").alias("node"), F.greatest(F.least("r", F.lit(1.0)), F.lit(-1.0)).alias("r"))
    return multiclass.route(r, tree, 2).select("id", "cls", F.round("p", 9).alias("p"))


TREE = '"top" { 0 "middle" { 1 2 "low" { 3 4 } } 5 }'
BRANCHES = """
    r AS (SELECT vec_id AS id, [exp(5 * embedding[1]::DOUBLE), exp(5 * embedding[2]::DOUBLE), exp(5 * embedding[3]::DOUBLE)] AS a, [exp(5 * embedding[4]::DOUBLE), exp(5 * embedding[5]::DOUBLE), exp(5 * embedding[6]::DOUBLE)] AS b,
        [exp(5 * embedding[7]::DOUBLE), exp(5 * embedding[8]::DOUBLE)] AS c FROM embeddings),
    q AS (SELECT id, list_transform(a, lambda x: x / list_sum(a)) AS a, list_transform(b, lambda x: x / list_sum(b)) AS b, list_transform(c, lambda x: x / list_sum(c)) AS c FROM r)"""


def branches(read):
    """Probabilities (id, node, branch, p) of models of three, three and two branches: soft maxima of the vectors' numbers."""
    nodes = ((0, 1, 3), (1, 4, 3), (2, 7, 2))
    each = F.array(*(F.struct(F.lit(n).alias("node"), F.slice("embedding", a, k).alias("x")) for n, a, k in nodes))
    rows = read("embeddings").select(F.col("vec_id").alias("id"), F.inline(each))
    odds = rows.withColumn("x", F.transform("x", lambda v: F.exp(5 * v.cast("double"))))
    share = F.transform("x", lambda v: v / F.aggregate("x", F.lit(0.0), lambda a, b: a + b))
    return odds.select("id", "node", F.posexplode(share).alias("branch", "p"))


@query(f"""
    WITH {BRANCHES}
    SELECT id, CAST(unnest([0, 1, 2, 3, 4, 5]) AS INTEGER) AS cls, round(unnest([a[1], a[2] * b[1], a[2] * b[2], a[2] * b[3] * c[1], a[2] * b[3] * c[2], a[3]]), 9) AS p FROM q""")
def hier_probabilities(read, spark):
    found = multiclass.class_probabilities(branches(read), multiclass.paths(spark, multiclass.parse_control(TREE)))
    return found.withColumn("p", F.round("p", 9))


@query(f"""
    WITH {BRANCHES}, w AS (SELECT *, list_position(a, list_max(a)) AS i, list_position(b, list_max(b)) AS j, list_position(c, list_max(c)) AS k FROM q)
    SELECT id, CAST(CASE i WHEN 1 THEN 0 WHEN 3 THEN 5 ELSE CASE j WHEN 3 THEN 2 + k ELSE j END END AS INTEGER) AS cls,
        round(a[i] * CASE WHEN i = 2 THEN b[j] * CASE WHEN j = 3 THEN c[k] ELSE 1 END ELSE 1 END, 9) AS p FROM w""")
def hier_route_branches(read, spark):
    return multiclass.route_branches(branches(read), multiclass.paths(spark, multiclass.parse_control(TREE))).withColumn("p", F.round("p", 9))


@query()
def adaptive_linear_error(read, spark):
    probes, train = sides(read)
    return kernel.regress_linear(kernel.weights(near(read, 60), 20.0), probes, train.select("id", "x", F.col("label").cast("double").alias("y")))


@query()
def adaptive_density(read, spark):
    _, train = sides(read)
    return kernel.density(kernel.weights(near(read, 60), 20.0), train.select(F.size("x")).first()[0], train.count())


@query()
def adaptive_regress(read, spark):
    _, train = sides(read)
    return kernel.regress(kernel.weights(near(read, 60), 20.0), train.select("id", F.col("label").cast("double").alias("y")))


@query()
def adaptive_classify(read, spark):
    _, train = sides(read)
    return kernel.classify(kernel.weights(near(read, 60), 20.0), train)


@query()
def adaptive_two_class(read, spark):
    _, train = sides(read)
    return kernel.two_class_difference(kernel.weights(near(read, 60), 20.0), train)


@query()
def lsq_decode(read, spark):
    return multiclass.probabilities(binary_values(read, 3).withColumn("r", F.tanh("r")), multiclass.adjacent(4), "lsq")


@query()
def nnls_decode(read, spark):
    return multiclass.probabilities(binary_values(read, 6).withColumn("r", F.tanh("r")), multiclass.one_against_one(4), "nnls")


@query()
def pair_coupling(read, spark):
    return multiclass.probabilities(binary_values(read, 6).withColumn("r", F.tanh("r")), multiclass.one_against_one(4), "pairs")


@query()
def coding_matrices(read, spark):
    makers = {"rest": multiclass.one_against_rest(6), "pairs": multiclass.one_against_one(6), "adjacent": multiclass.adjacent(6), "exhaustive": multiclass.exhaustive(5), "random": multiclass.random_codes(6, 8), "orthogonal": multiclass.orthogonal(8)}
    return spark.createDataFrame([(n, int(i), int(j), int(v)) for n, m in makers.items() for i, row in enumerate(np.atleast_2d(m)) for j, v in enumerate(row)], "design string, row int, cls int, code int")


@query(f"""
    WITH RECURSIVE n AS (
        SELECT * FROM (SELECT p.vec_id AS a, t.vec_id AS b, {D2} AS d2, row_number() OVER (PARTITION BY p.vec_id ORDER BY {D2}, t.vec_id) AS rank FROM embeddings p, embeddings t) WHERE rank <= 6
    ), r AS (SELECT a, avg(sqrt(d2)) AS r FROM n WHERE rank IN (5, 6) GROUP BY a), s AS (SELECT count(*) AS rows, max(len(embedding)) AS d FROM embeddings),
    l AS (SELECT a, CASE WHEN r = 0 THEN 'infinity'::DOUBLE ELSE ln(5) - ln(rows) + lgamma(d / 2 + 1) - d / 2 * ln(pi()) - d * ln(r) END AS log_pdf FROM r, s),
    dense AS (SELECT a FROM l WHERE log_pdf >= (SELECT avg(log_pdf) FROM l WHERE log_pdf < 'infinity'::DOUBLE)),
    e AS (SELECT n.a, n.b FROM n JOIN dense x ON x.a = n.a JOIN dense y ON y.a = n.b WHERE n.a <> n.b),
    reach AS (SELECT a, a AS b FROM dense UNION SELECT reach.a, e.b FROM reach JOIN e ON e.a = reach.b), root AS (SELECT b, min(a) AS root FROM reach GROUP BY b),
    number AS (SELECT root, row_number() OVER (ORDER BY root) AS cluster FROM (SELECT DISTINCT root FROM root))
    SELECT l.a AS id, coalesce(cluster, 0) AS cluster, round(log_pdf, 6) AS log_pdf FROM l LEFT JOIN root ON root.b = l.a LEFT JOIN number USING (root)""")
def density_clusters(read, spark):
    e = read("embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("x"))
    return cluster.flood(e, 5).withColumn("log_pdf", F.round("log_pdf", 6))


@query()
def single_linkage(read, spark):
    return cluster.dendrogram(read("embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("x")))


FOLD = lambda key, n: f"CAST(CAST('0x' || substr(md5(CAST({key} AS VARCHAR)), 17, 16) AS UBIGINT) % {n} AS BIGINT)"


@query(f"""
    WITH e AS (SELECT vec_id, embedding, label, {FOLD("vec_id", 4)} AS fold FROM embeddings),
    n AS (SELECT p.vec_id AS probe, p.fold, p.label AS truth, t.label, row_number() OVER (PARTITION BY p.vec_id ORDER BY {D2}, t.vec_id) AS rank FROM e p JOIN e t ON p.fold <> t.fold),
    v AS (SELECT probe, fold, truth, label, count(*) AS n FROM n WHERE rank <= 7 GROUP BY ALL), w AS (SELECT *, row_number() OVER (PARTITION BY probe ORDER BY n DESC, label) AS r FROM v)
    SELECT fold, count(*) AS n, round(avg(CAST(label = truth AS DOUBLE)), 9) AS accuracy FROM w WHERE r = 1 GROUP BY fold""")
def cross_validation(read, spark):
    e = read("embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("x"), "label")
    return cluster.cross_validate(e, 4, 7).withColumn("accuracy", F.round("accuracy", 9))


@query(f"""
    WITH e AS (SELECT vec_id, embedding, embedding[1]::DOUBLE AS y, {FOLD("vec_id", 4)} AS fold FROM embeddings),
    n AS (SELECT p.vec_id AS probe, p.fold, p.y AS truth, t.y, row_number() OVER (PARTITION BY p.vec_id ORDER BY {D2}, t.vec_id) AS rank FROM e p JOIN e t ON p.fold <> t.fold),
    v AS (SELECT probe, fold, truth, avg(y) AS y FROM n WHERE rank <= 7 GROUP BY ALL)
    SELECT fold, count(*) AS n, round(corr(y, truth), 8) AS r, round(avg(y - truth), 8) AS bias, round(sqrt(avg((y - truth) ** 2)), 8) AS rmse FROM v GROUP BY fold""")
def cross_interpolation(read, spark):
    e = read("embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("x"), F.col("embedding")[0].cast("double").alias("y"))
    found = cluster.cross_interpolate(e, 4, 7)
    return found.select("fold", "n", *(F.round(c, 8).alias(c) for c in ("r", "bias", "rmse")))


@query()
def cross_validation_kernel(read, spark):
    e = read("embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("x"), "label")
    return cluster.cross_validate(e, 4, 30, weight=5.0)


@query(f"""
    WITH {NEAR}, s AS (SELECT count(*) AS rows, max(len(embedding)) AS d FROM embeddings), r AS (SELECT probe, avg(sqrt(d2)) AS r FROM near WHERE rank IN ({K}, {K} + 1) GROUP BY probe),
    v AS (SELECT probe, label, count(*) AS n FROM near WHERE rank <= {K} GROUP BY ALL)
    SELECT probe, label, round(ln(n) - ln(rows) + lgamma(d / 2 + 1) - d / 2 * ln(pi()) - d * ln(r), 6) AS log_p FROM v JOIN r USING (probe), s""")
def knn_joint(read, spark):
    _, train = sides(read)
    rows, d = read("embeddings").agg(F.count("*"), F.max(F.size("embedding"))).first()
    return neighbours.knn_joint(near(read, K + 1), train, K, d, rows).withColumn("log_p", F.round("log_p", 6))


@query()
def kernel_joint(read, spark):
    _, train = sides(read)
    rows, d = read("embeddings").agg(F.count("*"), F.max(F.size("embedding"))).first()
    return kernel.joint(kernel.weights(near(read, 50), 10.0), train, d, rows)


@query()
def kernel_gradients(read, spark):
    probes, train = sides(read)
    two = train.withColumn("label", F.col("label") % 2)
    return kernel.gradients(kernel.weights(near(read, 50), 10.0), probes, two)


@query()
def optimal_density(read, spark):
    probes, train = sides(read)
    spread = train.select("id", F.posexplode("x").alias("j", "v")).groupBy("j").agg(F.var_samp("v").alias("v")).agg(F.sum("v"), F.count("*")).first()
    return kernel.optimal_density(probes, train, spread[1], spread[0] / spread[1] / 20, spread[0])


@query()
def border_training(read, spark):
    from ..operators.borders import train

    e = read("embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("x"), (F.col("label") % 2).alias("label"))
    return train(e, 40, 0.5)


@query()
def borders_in_batches(read, spark):
    from ..operators import borders

    e = read("embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("x"), (F.col("label") % 2).alias("label"))
    return borders.train_model(borders.class_difference(e, 0.5), borders.opposite(e, 100))


@query()
def calibrated_probability(read, spark):
    from ..operators.calibrate import calibrate

    d = scored(read).withColumn("r", 2 * F.least(F.col("con"), F.lit(0.99)) - 1)
    return calibrate(d, "r", "hit", "doc_id", 25, 2)


@query("""
    WITH v AS (SELECT vec_id, embedding AS v, (label % 3)::INTEGER AS model, CASE WHEN label % 2 = 0 THEN 1.0 ELSE -1.0 END AS alpha FROM embeddings)
    SELECT id, model, round(f - 0.1 * model, 6)::DOUBLE AS f FROM (SELECT p.vec_id AS id, model, sum(alpha * exp(-0.05 * list_sum(list_transform(range(1, len(v) + 1), lambda i: (p.embedding[i]::DOUBLE - v[i]::DOUBLE) ** 2)))) AS f
    FROM embeddings p, v WHERE p.vec_id % 20 = 0 GROUP BY ALL)""")
def svm_decision(read, spark):
    from ..operators.svm import decisions

    e = read("embeddings")
    alpha = F.when(F.col("label") % 2 == 0, 1.0).otherwise(-1.0)
    vectors = e.select(F.col("embedding").alias("v"), (F.col("label") % 3).cast("int").alias("model"), alpha.alias("alpha"))
    out = decisions(e.where(PROBES).select(F.col("vec_id").alias("id"), F.col("embedding").alias("x")), vectors, 0.05, {0: 0.0, 1: 0.1, 2: 0.2})
    return out.select("id", "model", F.round("f", 6).alias("f"))


@query("SELECT label, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 9) AS share FROM embeddings GROUP BY label")
def class_histogram(read, spark):
    n = read("embeddings").groupBy("label").agg(F.count("*").alias("n"))
    total = n.agg(F.sum("n").alias("_t"))
    return n.crossJoin(F.broadcast(total)).select("label", "n", F.round(F.col("n") / F.col("_t"), 9).alias("share"))


@query("SELECT vec_id, round(1 / (1 + exp(-1.5 * (0.3 * embedding[1]::DOUBLE - 0.2 * embedding[2]::DOUBLE + 0.05) + 0.1)), 9) AS p FROM embeddings")
def linear_classifier(read, spark):
    from ..operators.svm import linear_decision, probability

    d = linear_decision(read("embeddings").select("vec_id", F.slice("embedding", 1, 2).alias("x")), [0.3, -0.2], 0.05)
    return d.select("vec_id", F.round(probability(F.col("f"), -1.5, 0.1), 9).alias("p"))


@query()
def pca_projection(read, spark):
    e = read("embeddings")
    mean, lead = prepare.principal_components(e, 3, "embedding")
    return e.select("vec_id", prepare.affine(F.col("embedding"), mean, lead).alias("x"))


@query(f"SELECT vec_id, label, {FOLD("label || '/' || vec_id", 1_000_000)} < 250000 AS test FROM embeddings")
def stratified_split(read, spark):
    return prepare.stratified(read("embeddings").select("vec_id", "label"), "label", "vec_id", 0.25)


@query("""
    WITH r AS (SELECT vec_id AS id, i::DOUBLE AS t, atanh(greatest(least(tanh(embedding[i + 1]::DOUBLE), 0.999999), -0.999999)) AS d FROM embeddings, range(4) q(i))
    SELECT id, round(coalesce(regr_intercept(t, d), avg(t)), 6) AS y FROM r GROUP BY id""")
def continuum_regression(read, spark):
    from ..operators.svm import continuum

    return continuum(binary_values(read, 4).withColumn("r", F.tanh("r")), [0.0, 1.0, 2.0, 3.0]).withColumn("y", F.round("y", 6))


@query("SELECT vec_id AS id, CAST(i - 1 AS INTEGER) AS cls, round(exp(embedding[i]::DOUBLE) / (exp(embedding[1]::DOUBLE) + exp(embedding[2]::DOUBLE) + exp(embedding[3]::DOUBLE)), 6) AS p FROM embeddings, range(1, 4) r(i)")
def plug_in_classifier(read, spark):
    from ..operators.svm import plug_in

    e = read("embeddings").select(F.col("vec_id").alias("id"), F.transform(F.slice("embedding", 1, 3), lambda v: v.cast("double")).alias("x"))
    out = plug_in(e, lambda x: np.exp(x) / np.exp(x).sum(axis=1, keepdims=True))
    return out.select("id", F.posexplode("p").alias("cls", "p")).withColumn("p", F.round("p", 6))


@query(f"""
    WITH v AS (SELECT vec_id AS k, embedding AS v, CASE WHEN label % 2 = 0 THEN 1.0 ELSE -1.0 END AS alpha FROM embeddings),
    k AS (SELECT p.vec_id AS id, p.embedding AS x, v, alpha * exp(-0.05 * list_sum(list_transform(range(1, len(v) + 1), lambda i: (p.embedding[i]::DOUBLE - v[i]::DOUBLE) ** 2))) AS w FROM embeddings p, v WHERE p.vec_id % 20 = 0)
    SELECT id, CAST(i - 1 AS INTEGER) AS j, round(sum(-0.1 * w * (x[i]::DOUBLE - v[i]::DOUBLE)), 6) + 0.0 AS slope FROM (SELECT *, unnest(range(1, len(v) + 1)) AS i FROM k) GROUP BY ALL""")
def svm_gradient(read, spark):
    from ..operators.svm import decision_gradients

    e = read("embeddings")
    vectors = e.select(F.col("embedding").alias("v"), F.lit(0).alias("model"), F.when(F.col("label") % 2 == 0, 1.0).otherwise(-1.0).alias("alpha"))
    out = decision_gradients(e.where(PROBES).select(F.col("vec_id").alias("id"), F.col("embedding").alias("x")), vectors, 0.05)
    return out.select("id", "j", (F.round("slope", 6) + 0.0).alias("slope"))


@query("SELECT doc_id, round((2 * toxic - 1) * least(n_chars / 10000.0, 1)::DOUBLE, 9) AS r FROM documents JOIN labels USING (doc_id)")
def class_to_r(read, spark):
    return scored(read).select("doc_id", F.round(prepare.class_to_r(F.col("hit"), F.col("con")), 9).alias("r"))


@query("""
    WITH r AS (SELECT vec_id AS id, i AS row, tanh(embedding[i + 1]::DOUBLE) AS r FROM embeddings, range(6) t(i)),
    c(row, cls, code) AS (VALUES (0, 0, -1), (0, 1, 1), (1, 0, -1), (1, 2, 1), (2, 0, -1), (2, 3, 1), (3, 1, -1), (3, 2, 1), (4, 1, -1), (4, 3, 1), (5, 2, -1), (5, 3, 1)),
    s AS (SELECT id, cls, sum(code * r) AS s FROM r JOIN c USING (row) GROUP BY id, cls)
    SELECT id, CAST(cls AS INTEGER) AS cls, CASE WHEN row_number() OVER (PARTITION BY id ORDER BY s DESC, cls) = 1 THEN 1.0 ELSE 0.0 END::DOUBLE AS p FROM s""")
def peaked_decode(read, spark):
    return multiclass.probabilities(binary_values(read, 6).withColumn("r", F.tanh("r")), multiclass.one_against_one(4), "peaked")


@query("""
    WITH r AS (SELECT vec_id AS id, i AS cls, greatest((1 + tanh(embedding[i + 1]::DOUBLE)) / 2, 0) AS q FROM embeddings, range(4) t(i))
    SELECT id, CAST(cls AS INTEGER) AS cls, round(q / sum(q) OVER (PARTITION BY id), 9) AS p FROM r""")
def rest_decode(read, spark):
    return multiclass.probabilities(binary_values(read, 4).withColumn("r", F.tanh("r")), multiclass.one_against_rest(4), "rest").withColumn("p", F.round("p", 9))


@query()
def iterated_decode(read, spark):
    return multiclass.probabilities(binary_values(read, 6).withColumn("r", F.tanh("r")), multiclass.one_against_one(4), "iterated")
