import math
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from corvane.functions import dates, numeric
from corvane.operators import cluster, grids, joins, kernel, matrix, multiclass, neighbours, simulate
from corvane.plans.language import Session


def test_erfinv():
    y = np.array([-0.999, -0.5, 0.0, 0.3, 0.99999])
    assert [math.erf(x) for x in numeric.erfinv(y)] == pytest.approx(y.tolist(), abs=1e-12)


def test_roots_minima_and_equations():
    assert numeric.false_position(lambda x: x**3 - 2, 0, 2) == pytest.approx(2 ** (1 / 3))
    assert numeric.golden(lambda x: (x - 0.3) ** 2, -1, 1) == pytest.approx(0.3, abs=1e-6)
    a = np.array([[0.0, 1.0], [-1.0, 0.0]])
    path = numeric.runge_kutta(lambda t, x: a @ x, 0, np.array([1.0, 0.0]), 0.01, 100)
    assert path[-1] == pytest.approx([math.cos(1), -math.sin(1)], abs=1e-8)
    assert numeric.linear_ode(a, np.array([1.0, 0.0]), np.array([1.0]))[0] == pytest.approx(path[-1], abs=1e-8)


@pytest.mark.parametrize("seed", range(5))
def test_constrained_least_squares(seed):
    rng = np.random.default_rng(seed)
    a, b = rng.normal(size=(20, 5)), rng.normal(size=20)
    x = numeric.nnls(a, b)
    slope = a.T @ (a @ x - b)
    assert (x >= 0).all() and (slope >= -1e-8).all() and abs(slope @ x) < 1e-8
    assert numeric.constrained_least_squares(a, b, np.eye(5), np.zeros(5)) == pytest.approx(x, abs=1e-7)


def test_date_calculator():
    c = dates.Calculator()
    assert c("2020/2/28 + 0/0/2") == datetime(2020, 3, 1)
    assert c("(2020/1/2-12 _ 2020/1/1) | 0/0/1") == 1.5
    assert c("2020/14/1") == datetime(2021, 2, 1)
    assert c("0/0/1-12 * 2") == timedelta(days=3)
    with pytest.raises(ValueError):
        c("2020/1/1 +")


def test_date_text(spark):
    d = spark.createDataFrame([("2020/3/1",), ("2019/14/2-5",), ("2021/12/31-23:59:30.5",)], "s string")
    assert [r[0] for r in d.select(dates.parse(F.col("s"))).collect()] == [datetime(2020, 3, 1), datetime(2020, 2, 2, 5), datetime(2021, 12, 31, 23, 59, 30, 500000)]
    assert [r[0] for r in d.select(dates.write(dates.parse(F.col("s")))).collect()][:2] == ["2020/03/01", "2020/02/02-05"]



def test_written_seconds_round_as_in_c(spark):
    """Every half hundredth of a minute, exact and inexact in binary, and their neighbours."""
    parts = [p + by for p in range(5000, 60_000_000, 10_000) for by in (-1, 0, 1)]
    rows = spark.createDataFrame([(p,) for p in parts], "p long").select("p", dates.write(F.timestamp_micros(F.col("p") + 1_704_067_200_000_000).cast("timestamp_ntz")).alias("text"))
    assert [(r["p"], r["text"]) for r in rows.collect() if r["text"] != "2024/01/01-00:00:%5.2f" % (r["p"] / 1_000_000)] == []


def points(spark, n, d, seed):
    x = np.random.default_rng(seed).normal(size=(n, d))
    return x, spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, x array<double>")


@pytest.mark.parametrize("metric", range(6))
def test_nearest_in_blocks(spark, metric):
    x, df = points(spark, 60, 3, metric)
    probes = df.where("id < 20")
    got = {(r["probe"], r["rank"]): r["train"] for r in neighbours.nearest(probes, df.where("id >= 20"), 4, metric, block=7).collect()}
    d = neighbours._distances(metric, x[:20], x[20:])
    assert got == {(i, k + 1): int(j) + 20 for i in range(20) for k, j in enumerate(np.argsort(d[i], kind="stable")[:4])}


def test_bandwidth_gives_the_weight(spark):
    d2 = np.sort(np.random.default_rng(0).exponential(size=(10, 50)), axis=1)
    v = kernel.bandwidths(d2, 12.0)
    assert np.exp(-d2 / (2 * v[:, None])).sum(axis=1) == pytest.approx(np.full(10, 12.0), abs=1e-5)
    _, df = points(spark, 40, 2, 3)
    w = kernel.weights(neighbours.nearest(df.where("id < 5"), df.where("id >= 5"), 20), 6.0)
    assert [r[0] for r in w.groupBy("probe").agg(F.sum("w")).select("sum(w)").collect()] == pytest.approx([6.0] * 5, abs=1e-5)


def test_decoders():
    p = np.array([0.5, 0.3, 0.2])
    for design, methods in ((multiclass.one_against_rest(3), ("lsq", "nnls", "rest")), (multiclass.adjacent(3), ("lsq", "nnls")), (multiclass.one_against_one(3), ("lsq", "nnls", "pairs"))):
        r = (design @ p) / (np.abs(design) @ p)
        for m in methods:
            assert multiclass.decode(design, r, m) == pytest.approx(p, abs=1e-5)
    assert multiclass.repaired(np.array([0.9, 0.4, -0.3])).sum() == pytest.approx(1)


def test_coding_matrices():
    assert (multiclass.exhaustive(4).shape, multiclass.one_against_one(5).shape) == ((7, 4), (10, 5))
    o = multiclass.orthogonal(8)
    assert (o @ o.T == 8 * np.eye(len(o))).all()
    root = multiclass.parse_control('"a" { 0 "b" { 1 2 } }')
    assert root.classes() == [0, 1, 2] and multiclass.parse_control(root.text()).text() == root.text()


def coo(spark, a):
    return spark.createDataFrame([(int(i), int(j), float(a[i, j])) for i, j in zip(*np.nonzero(a), strict=True)], "i long, j long, v double")


def test_solvers_and_language(spark):
    rng = np.random.default_rng(1)
    a = np.where(rng.random((8, 8)) < 0.4, rng.normal(size=(8, 8)), 0.0)
    s = a.T @ a + 3 * np.eye(8)
    x, _ = matrix.conjugate_gradient(coo(spark, s), np.ones(8))
    assert s @ x == pytest.approx(np.ones(8), abs=1e-7)
    assert matrix.dense(matrix.invert(coo(spark, s), 8), 8, 8) @ s == pytest.approx(np.eye(8), abs=1e-8)
    assert matrix.dense(matrix.transpose(matrix.transpose(coo(spark, a))), 8, 8) == pytest.approx(a)
    assert sorted(matrix.eigen(coo(spark, s), 8, 2, "BE")[0]) == pytest.approx([np.linalg.eigvalsh(s)[0], np.linalg.eigvalsh(s)[-1]])
    v = spark.createDataFrame([(i, float(i)) for i in range(8)], "i long, v double")
    session = Session(spark, {"A": ("sparse", coo(spark, a)), "x": ("vector", v)})
    y = {r["i"]: r["v"] for r in session.run("B = A * A; y = B * x - 2 * x")[1].collect()}
    assert [y.get(i, 0.0) for i in range(8)] == pytest.approx(a @ a @ np.arange(8.0) - 2 * np.arange(8.0))
    assert session.run("|x|")[1] == pytest.approx(np.linalg.norm(np.arange(8)))
    assert [r["v"] for r in session.run("3:1")[1].orderBy("i").collect()] == [3, 2, 1]
    with pytest.raises(ValueError):
        session.run("A +")


def test_clusters(spark):
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.normal(0, 0.1, (30, 2)), rng.normal(5, 0.1, (30, 2))])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, x array<double>")
    found = {r["id"]: r["cluster"] for r in cluster.flood(df, 5).collect()}
    groups = [{found[i] for i in part} - {0} for part in (range(30), range(30, 60))]
    assert all(groups) and not groups[0] & groups[1]
    tree = cluster.dendrogram(df).orderBy("node").collect()
    assert len(tree) == 59 and [r["d2"] for r in tree] == sorted(r["d2"] for r in tree) and tree[-1]["d2"] > 20


def test_simulation(spark):
    start = spark.range(4).select("id", (F.col("id") / 4).alias("x"), F.lit(0.2).alias("y"))
    path = simulate.trajectories(start, simulate.rotation, 0, 0.05, 20)
    spread = path.withColumn("r", F.sqrt(F.col("x") ** 2 + F.col("y") ** 2)).groupBy("id").agg((F.max("r") - F.min("r")).alias("d")).collect()
    assert max(r["d"] for r in spread) < 1e-6
    sums = simulate.transport_map(spark, simulate.rotation, 8, 0.05, 2).groupBy("k", "i").agg(F.sum("w").alias("w")).collect()
    assert len(sums) == 128 and [r["w"] for r in sums] == pytest.approx([1.0] * 128)


def test_dimension_of_a_line(spark):
    line = spark.range(4000).select((F.col("id") / 4000).alias("x"), (F.col("id") / 8000).alias("y"))
    d = grids.box_dimension(grids.box_counts(line, "x", "y", [0.1, 0.05, 0.025, 0.0125])).first()[0]
    assert d == pytest.approx(1, abs=0.1)


def test_asof_before_the_axis(spark):
    left = spark.createDataFrame([(1, 0.5), (1, 2.0), (1, 9.0)], "g int, t double")
    axis = spark.createDataFrame([(1, 1.0, 0), (1, 2.0, 1), (1, 3.0, 2)], "g int, k double, i int")
    out = [(r["t"], r["k0"], r["i0"], r["k1"]) for r in joins.asof(left, axis, ["g"], "t").orderBy("t").collect()]
    assert out == [(0.5, None, None, None), (2.0, 2.0, 1, 3.0), (9.0, 3.0, 2, None)]


def test_principal_components(spark):
    from corvane.operators import prepare

    x, df = points(spark, 80, 5, 9)
    mean, lead = prepare.principal_components(df, 2)
    _, _, vt = np.linalg.svd(x - x.mean(axis=0), full_matrices=False)
    assert mean == pytest.approx(x.mean(axis=0).tolist())
    assert np.abs(np.array(lead).T @ vt[:2].T) == pytest.approx(np.eye(2), abs=1e-8)


def test_plug_in_and_continuum(spark):
    from corvane.operators import svm

    _, df = points(spark, 10, 3, 1)
    out = svm.plug_in(df, lambda x: np.abs(x) / np.abs(x).sum(axis=1, keepdims=True)).collect()
    assert [sum(r["p"]) for r in out] == pytest.approx([1.0] * 10)
    r = spark.createDataFrame([(1, k, float(np.tanh(2.5 - t))) for k, t in enumerate((1.0, 2.0, 3.0))], "id int, row int, r double")
    assert svm.continuum(r, [1.0, 2.0, 3.0]).first()["y"] == pytest.approx(2.5)


def test_patterns():
    from corvane.operators import patterns

    rng = np.random.default_rng(3)
    for _ in range(10):
        a = np.where(rng.random((6, 6)) < 0.3, rng.normal(size=(6, 6)), 0.0) + np.diag(rng.uniform(5, 6, 6))
        fill = patterns.elimination_fill({i: set(np.flatnonzero(a[i]).tolist()) for i in range(6)}, 6)
        u = a.copy()
        for k in range(6):
            for i in range(k + 1, 6):
                u[i, k + 1 :] -= u[i, k] / u[k, k] * u[k, k + 1 :]
        assert all(j in fill[i] for i, j in zip(*np.nonzero(np.abs(u) > 1e-12), strict=True))
    for _ in range(20):
        there = rng.random((5, 5)) < 0.35
        rank = patterns.structural_rank({i: set(np.flatnonzero(there[i]).tolist()) for i in range(5)})
        assert rank == max(np.linalg.matrix_rank(np.where(there, rng.normal(size=(5, 5)), 0)) for _ in range(3))


def test_grammar():
    from corvane.plans.grammar import Grammar

    g = Grammar("sum = sum '+' product | sum '-' product | product\nproduct = product '*' atom | atom\natom = /\\d+(\\.\\d+)?/ | '(' sum ')'")

    def value(t):
        if t[0] == "atom":
            return float(t[1]) if len(t) == 2 else value(t[2])
        if len(t) == 2:
            return value(t[1])
        a, b = value(t[1]), value(t[3])
        return {"+": a + b, "-": a - b, "*": a * b}[t[2]]

    assert value(g.parse("10 - 2 - 3 * (1 + 1)")) == 2
    with pytest.raises(ValueError):
        g.parse("1 + ")
    with pytest.raises(ValueError):
        Grammar("a = b")


@pytest.mark.parametrize("away", [0.0, 1e7, 1e200])
def test_products_of_matrices_lose_no_neighbour(away):
    rng = np.random.default_rng(8)
    x = np.repeat(rng.normal(size=(60, 5)), 3, axis=0) + away
    a, barred = np.vstack([x[::7], rng.normal(size=(4, 5)) + away]), rng.random((30, 180)) < 0.2
    exact = np.where(barred, np.inf, neighbours._distances(0, a, x))
    for k, limit in ((4, None), (400, None), (9, np.sort(exact, axis=1)[:, 5])):
        i, j, d2 = neighbours._candidates(a, x, k, limit, barred)
        some = neighbours._least(i, j, d2, k)
        got = {(p, q) for p, q in zip(i[some], j[some]) if limit is None or exact[p, q] <= limit[p]}
        nearest = np.argsort(exact, axis=1, kind="stable")[:, :k]
        assert got == {(p, q) for p in range(30) for q in nearest[p] if not barred[p, q] and (limit is None or exact[p, q] <= limit[p])}
        assert (d2 == exact[i, j]).all()


def test_search_of_vectors_that_nothing_prunes(spark):
    x = np.random.default_rng(9).normal(size=(700, 24))
    x[300:500] = x[0]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, x array<double>")
    d = neighbours._distances(0, x[::9], x)
    got = {(r["probe"], r["rank"]): r["train"] for r in neighbours.nearest(df.where("id % 9 = 0"), df, 6, block=90).collect()}
    assert got == {(9 * i, n + 1): j for i, row in enumerate(np.argsort(d, axis=1, kind="stable")[:, :6]) for n, j in enumerate(row)}


def test_search_by_clusters_equals_brute_force(spark):
    rng = np.random.default_rng(21)
    x = np.concatenate([rng.normal(c, 0.3, (150, 3)) for c in rng.uniform(-9, 9, (8, 3))] + [np.zeros((30, 3))])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(9000, None), (9001, [1.0, None, 2.0])], "id long, x array<double>")
    out = neighbours.nearest(df.where("id % 9 = 0"), df, 6, block=200)
    got = {(r["probe"], r["rank"]): r["train"] for r in out.collect()}
    d = ((x[::9, None] - x) ** 2).sum(axis=2)
    for k, near in enumerate(np.argsort(d, axis=1, kind="stable")[:, :6]):
        assert [got[(9 * k, r + 1)] for r in range(6)] == near.tolist()


def test_hausdorff_is_symmetric(spark):
    rng = np.random.default_rng(22)
    x, label = rng.normal(0, 1, (60, 2)), rng.integers(0, 3, 60)
    df = spark.createDataFrame([(i, int(c), v.tolist()) for i, (c, v) in enumerate(zip(label, x))], "id long, label int, x array<double>")
    d = ((x[:, None] - x) ** 2).sum(axis=2)
    np.fill_diagonal(d, np.inf)
    def rows(found):
        return {(r["id"], r["label"], r["other"]): r["d2"] for r in found.where("d2 < double('infinity')").collect()}

    assert rows(cluster.class_nearest(df, block=17)) == pytest.approx(rows(cluster.class_nearest(df)))
    for r in cluster.hausdorff(df).collect():
        part = d[np.ix_(label == r["la"], label == r["lb"])]
        assert r["h"] == pytest.approx(max(part.min(axis=1).max(), part.min(axis=0).max()))


def test_spanning_tree_by_joins_and_on_the_driver(spark, monkeypatch):
    from corvane.operators import graph

    rng = np.random.default_rng(23)
    x = rng.normal(0, 1, (25, 2))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, x array<double>")
    d = ((x[:, None] - x) ** 2).sum(axis=2)
    inside, total = {0}, 0.0
    while len(inside) < 25:
        step, to = min((d[a, b], b) for a in inside for b in range(25) if b not in inside)
        total, inside = total + step, inside | {to}
    lost = spark.createDataFrame([(99, [math.nan, 1.0])], "id long, x array<double>")
    for block in (20_000, 6):
        assert sum(r["d2"] for r in cluster.spanning_tree(df.union(lost), block).collect()) == pytest.approx(total)
    nodes, links = spark.range(30), spark.createDataFrame([(k, k + 3) for k in range(0, 24, 2)], "a long, b long")
    assert {tuple(r) for r in graph.components(nodes, links).collect()} == {tuple(r) for r in graph.components(nodes, links, few=0).collect()}


def test_spanning_tree_measures_pairs_once_instead_of_by_rounds_of_searches(spark, monkeypatch):
    from corvane.operators import spanning

    def lightest(ids, x):
        out, root = set(), {i: i for i in ids}
        find = lambda i: i if root[i] == i else find(root[i])
        with np.errstate(over="ignore"):
            edges = sorted((float(((x[i] - x[j]) ** 2).sum()), ids[i], ids[j]) for i in range(len(x)) for j in range(i + 1, len(x)))
        for d2, a, b in edges:
            if d2 < math.inf and find(a) != find(b):
                root[find(b)] = find(a)
                out.add((a, b))
        return out

    rng = np.random.default_rng(31)
    cases = [
        np.array([[i, j] for i in range(9) for j in range(8)], dtype=float),  # ties
        rng.integers(0, 3, (90, 3)).astype(float),  # copies
        np.concatenate([rng.normal(0, 1e-5, (30, 4)), rng.normal(3, 1e-5, (30, 4))]),  # nearer than single precision tells
        np.concatenate([rng.normal(0, 1, (30, 3)), rng.normal(0, 1e200, (5, 3)), [[math.inf, 0, 0]]]),  # infinite distances
    ]
    frames = [(x, ids := sorted(rng.permutation(500)[: len(x)].tolist()), spark.createDataFrame([(i, v.tolist()) for i, v in zip(ids, x)], "id long, x array<double>")) for x in cases]
    monkeypatch.setattr(spanning.tree_by_chunks, "__defaults__", (6, 4_000_000))
    with monkeypatch.context() as no_rounds:
        no_rounds.setattr(cluster, "_nearest_outside", None)
        for x, ids, df in frames:
            found = cluster.spanning_tree(df, 16).collect()
            assert {(r["a"], r["b"]) for r in found} == lightest(ids, x) and len(found) == len(lightest(ids, x))
            assert [r["d2"] for r in found] == pytest.approx([float(((x[ids.index(r["a"])] - x[ids.index(r["b"])]) ** 2).sum()) for r in found], rel=1e-12)
    x, ids, df = frames[1]
    assert {(r["a"], r["b"]) for r in cluster.spanning_tree(df, most=5).collect()} == lightest(ids, x)


def test_polynomial_fit(spark):
    rng = np.random.default_rng(24)
    x, g = rng.uniform(100, 120, 60), rng.integers(0, 3, 60)
    y = 3 - 2 * x + 0.5 * x * x + rng.normal(0, 0.1, 60)
    df = spark.createDataFrame([(int(a), float(b), float(c)) for a, b, c in zip(g, x, y)] + [(9, 1.0, 1.0)], "g int, x double, y double")
    out = {r["g"]: r["coefficients"] for r in grids.proxy_fit(df, ["g"], "x", "y", 2).collect()}
    assert set(out) == {0, 1, 2}
    for k in out:
        at = np.linspace(100, 120, 5)
        assert np.polynomial.Polynomial(out[k])(at) == pytest.approx(np.polynomial.Polynomial.fit(x[g == k], y[g == k], 2)(at), abs=1e-3)


def test_gridded_trajectories_turn(spark):
    from corvane.operators import velocity

    axis, t = (-2.0, 2.0, 41), (0.0, 1.0, 2)
    field = velocity.gridded(spark, lambda x, y, t: (-y, x), axis, axis, t)
    start = spark.createDataFrame([(0, 1.0, 0.0), (1, 0.0, -0.5)], "id long, x double, y double")
    for r in velocity.trajectories(start, field, axis, axis, t, 0.0, 0.1, 3).where("step = 3").collect():
        a = {0: 0.0, 1: -np.pi / 2}[r["id"]] + 0.3
        size = {0: 1.0, 1: 0.5}[r["id"]]
        assert (r["x"], r["y"]) == pytest.approx((size * np.cos(a), size * np.sin(a)), abs=1e-3)


def test_globe_search_wraps(spark):
    from corvane.operators import joins

    points = spark.createDataFrame([(1, 1.0, 0.0), (2, 340.0, 0.0), (3, 100.0, 89.0)], "id long, lon double, lat double")
    probes = spark.createDataFrame([(1, 359.0, 0.0), (2, 280.0, 89.5), (3, None, 1.0), (4, 160.0, -80.0)], "id long, lon double, lat double")
    out = {r["id"]: r["near"] for r in joins.nearest_on_globe(probes, points, 1.0).collect()}
    assert out == {1: 1, 2: 3, 3: None, 4: 1} or out == {1: 1, 2: 3, 3: None, 4: 2}
    assert joins.nearest_on_globe(probes, points.where("false"), 1.0).where("near is not null").count() == 0


@pytest.mark.parametrize("seed", range(4))
def test_decoders_return_what_made_the_differences(seed):
    rng = np.random.default_rng(seed)
    p = rng.dirichlet(np.ones(4))
    for code, methods in ((multiclass.one_against_one(4), ("lsq", "nnls", "pairs", "iterated")), (multiclass.exhaustive(4), ("lsq", "nnls", "iterated")), (multiclass.orthogonal(4), ("projected",))):
        up, down = (code > 0) @ p, (code < 0) @ p
        for method in methods:
            assert multiclass.decode(code, (up - down) / (up + down), method) == pytest.approx(p, abs=1e-3), method
    q = rng.normal(0, 1, 5)
    near = multiclass.simplex(q)
    assert near.min() >= 0 and near.sum() == pytest.approx(1)
    assert all(((q - near) ** 2).sum() <= ((q - x) ** 2).sum() + 1e-12 for x in rng.dirichlet(np.ones(5), 300))


def test_lsq_of_all_rows_together(spark):
    rng = np.random.default_rng(5)
    code, r = multiclass.exhaustive(4), rng.uniform(-1, 1, (20, 7))
    df = spark.createDataFrame([(i, k, float(v)) for i, row in enumerate(r) for k, v in enumerate(row)], "id long, row int, r double")
    out = {(x["id"], x["cls"]): x["p"] for x in multiclass.probabilities(df, code, "lsq").collect()}
    for i, row in enumerate(r):
        assert [out[(i, c)] for c in range(4)] == pytest.approx(multiclass.decode(code, row, "lsq").tolist())


def test_radial_decisions_by_blocks_equal_sums_over_pairs(spark, monkeypatch):
    """Several blocks on both sides, vectors that models share, far vectors, and rows with a null; no pair is a row of Spark."""
    from corvane.operators import svm

    rng = np.random.default_rng(4)
    monkeypatch.setattr(svm, "PROBES", 10), monkeypatch.setattr(svm, "VECTORS", 40)
    for far in (0.0, 1e6):
        x, v = rng.normal(far, 1, (25, 3)), rng.normal(far, 1, (130, 3))
        alpha = rng.normal(size=(130, 2))
        probes = spark.createDataFrame([(k, a.tolist()) for k, a in enumerate(x)] + [(99, [None, 1.0, 2.0])], "id long, x array<double>")
        vectors = spark.createDataFrame([(b.tolist(), m, float(alpha[k, m])) for k, b in enumerate(v) for m in (0, 1)] + [([None, 0.0, 0.0], 1, 5.0)], "v array<double>, model int, alpha double")
        kernel = np.exp(-0.3 * ((x[:, None] - v[None]) ** 2).sum(axis=2))
        found = svm.decisions(probes, vectors, 0.3, {0: 0.5, 1: -1.0})
        assert "Generate explode(_of" not in found._jdf.queryExecution().toString()
        got = {(r["id"], r["model"]): r["f"] for r in found.collect()}
        assert [got.pop((99, m)) for m in (0, 1)] == [None, None]
        assert got == {(k, m): pytest.approx((kernel @ alpha)[k, m] - (0.5, -1.0)[m], rel=1e-9, abs=1e-9) for k in range(25) for m in (0, 1)}
        want = {(k, m, j): pytest.approx(-0.6 * (kernel[k] * alpha[:, m] * (x[k, j] - v[:, j])).sum(), rel=1e-8, abs=1e-8 * (1 + far)) for k in range(25) for m in (0, 1) for j in range(3)}
        assert {(r["id"], r["model"], r["j"]): r["slope"] for r in svm.decision_gradients(probes, vectors, 0.3).collect() if r["id"] != 99} == want


def test_binned_nearest_meets_as_many_points_however_dense(spark):
    """Many points in one bin, some at one place: a probe meets a bounded number, and the nearest is that of all pairs, the smallest id among equals."""
    rng = np.random.default_rng(6)
    some = np.r_[rng.random((1500, 2)), rng.random((3, 2)) * 60, np.repeat(rng.random((2, 2)), 40, axis=0)].round(3)
    points = spark.createDataFrame([(len(some) - k, float(a), float(b)) for k, (a, b) in enumerate(some)], "id long, a double, b double")
    asked = np.r_[rng.random((150, 2)), rng.random((40, 2)) * 90 - 20, some[-50:-30]]
    probes = spark.createDataFrame([(k, float(a), float(b)) for k, (a, b) in enumerate(asked)], "id long, a double, b double")
    assert joins._fine(points, ("a", "b"), 2.0, 16) <= 0.25
    for size in (2.0, 0.05):
        got = {r["id"]: (r["near"], r["d2"]) for r in joins.binned_nearest(probes, points, size).collect()}
        d2 = ((asked[:, None] - some[None]) ** 2).sum(axis=2)
        assert got == {k: (len(some) - max(np.flatnonzero(row <= row.min() + 1e-15)), pytest.approx(row.min(), abs=1e-12)) for k, row in enumerate(d2)}


def test_candidates_are_few_and_exact_where_single_precision_is_not(spark):
    """The k nearest of many rows by a bound from some of them: far from the origin, at tiny and huge scales, at equal places, with barred rows."""
    rng = np.random.default_rng(8)
    for scale, off, d, n in ((1, 0, 3, 5000), (1e-3, 1e3, 2, 3000), (1, 1e8, 2, 2000), (1e30, 0, 3, 900), (0, 1, 2, 1500), (1e-25, 0, 2, 1200)):
        x = np.round(rng.normal(size=(n, d)), 2) * scale + off
        fold = rng.integers(0, 3, n)
        for k in (1, 3, 20):
            for barred in (None, fold[:100, None] == fold):
                all_ = neighbours.squared(x[:100], x, 0.0)
                all_[np.zeros((100, n), bool) if barred is None else barred] = np.inf
                i, j, d2 = neighbours._candidates(x[:100], x, k, None, barred)
                some = neighbours._least(i, j, d2, k)
                assert (j[some].reshape(100, k) == np.argsort(all_, axis=1, kind="stable")[:, :k]).all()


def test_hausdorff_of_many_points_measures_only_what_may_be_farthest(spark, monkeypatch):
    rng = np.random.default_rng(31)
    x, label = rng.normal(0, 1, (400, 8)), rng.integers(0, 3, 400)
    x[7] = x[8]
    df = spark.createDataFrame([(i, int(c), v.tolist()) for i, (c, v) in enumerate(zip(label, x))] + [(900, 1, None), (901, 2, [0.5] * 7 + [None]), (902, None, [9.0] * 8)], "id long, label int, x array<double>")
    d = ((x[:, None] - x) ** 2).sum(axis=2)
    np.fill_diagonal(d, np.inf)
    want = {(a, b): max(d[np.ix_(label == a, label == b)].min(axis=1).max(), d[np.ix_(label == a, label == b)].min(axis=0).max()) for a in range(3) for b in range(a, 3)}
    far = ((9 - x) ** 2).sum(axis=1)
    for b in range(3):  # a point without a class is far from all others, and least() and greatest() skip the null
        want[b, b] = max(want[b, b], far[label == b].min())
    few = cluster.hausdorff(df, block=100, picks=1000, drawn=60)
    assert {(r["la"], r["lb"]): r["h"] for r in few.collect()} == pytest.approx(want)
    many = cluster.hausdorff(df, block=100, picks=9, drawn=4)  # more are open than are measured together
    assert {(r["la"], r["lb"]): r["h"] for r in many.collect()} == pytest.approx(want)

    asked = []
    monkeypatch.setattr(cluster, "nearest", lambda *a, **k: asked.append(a))
    monkeypatch.setattr(cluster, "class_nearest", lambda *a, **k: asked.append(a))
    cluster.hausdorff(df, block=100, picks=1000, drawn=60).collect()
    assert not asked


def test_weights_of_many_probes_stay_in_arrow():
    import tracemalloc

    import pyarrow as pa

    from corvane.operators import kernel

    d2 = np.sort(np.random.default_rng(32).chisquare(8, (6000, 60)), axis=1)
    d2[:, 59] = d2[:, 58]
    near = pa.StructArray.from_arrays([pa.array(d2.ravel()), pa.array(np.arange(d2.size))], names=["d2", "train"])
    ends = np.minimum(np.arange(0, d2.size + 60, 60), d2.size - 5)  # the last list is shorter
    batch = pa.RecordBatch.from_arrays([pa.array([f"p{k}" for k in range(6000)]), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), near)], names=["probe", "_near"])
    tracemalloc.start()
    last = None
    for last in kernel._solved(batch, 20.0):
        w = last.to_pandas().groupby("probe")["w"].sum()
        assert w.to_numpy() == pytest.approx(20.0, abs=1e-6)
    assert tracemalloc.get_traced_memory()[1] < 12e6
    tracemalloc.stop()
    assert last.column(1)[-1].as_py() == d2.size - 6 and last.column(0)[-1].as_py() == "p5999"
