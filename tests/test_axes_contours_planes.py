"""As-of lookup by ranges, contour crossings and walks, packed fields and winds on two planes, gradients, widths and folds against brute force."""

import bisect
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from corvane.operators import axes, borders, cluster, contours, graph, hemispheres, kernel, multiclass, neighbours
from corvane.operators.sets import fold_number

R = 10_000.0 / 90 * 180 / math.pi


@pytest.mark.parametrize("rows", [0, 1, 2, 40])
def test_asof_by_ranges(spark, rows):
    rng = np.random.default_rng(rows)
    axis = sorted({round(float(v), 2) for v in rng.exponential(1, rows).cumsum()})
    worth = rng.normal(size=len(axis))
    keys = [*rng.uniform(-2, 45, 60).round(2).tolist(), *axis, *[7.0] * 200, None, math.nan]
    a = spark.createDataFrame([(k, float(v)) for k, v in zip(axis, worth)] + [(None, 1.0)], "k double, q double").repartition(3)
    df = spark.createDataFrame(list(enumerate(keys)), "id long, t double").repartition(7)
    got = {r["id"]: r for r in axes.asof(df, a, "t", ["q"]).collect()}
    back = {r["id"]: r["index"] for r in axes.asof(df, a, "t", descending=True).collect()}
    assert len(got) == len(keys)
    for n, t in enumerate(keys):
        r = got[n]
        if t is None or math.isnan(t) or not axis:
            assert (r["k0"], r["i0"], r["k1"], r["index"], r["q"]) == (None,) * 5
            continue
        i = bisect.bisect_right(axis, t) - 1
        assert (r["k0"], r["i0"], r["k1"]) == (axis[i] if i >= 0 else None, i if i >= 0 else None, axis[i + 1] if i + 1 < len(axis) else None)
        if len(axis) == 1:
            assert r["index"] is None
            continue
        j = min(max(i, 0), len(axis) - 2)
        share = (t - axis[j]) / (axis[j + 1] - axis[j])
        assert r["index"] == pytest.approx(j + share) and r["q"] == pytest.approx(worth[j] + share * (worth[j + 1] - worth[j]))
        assert back[n] == pytest.approx(len(axis) - 1 - r["index"])


def lines(rng, n, reach):
    lon, lat = rng.uniform(0, 360, n), rng.uniform(-80, 80, n)
    return [(i, float(a), float(b), float(a + da), float(np.clip(b + db, -90, 90))) for i, (a, b, da, db) in enumerate(zip(lon, lat, rng.uniform(-reach, reach, n), rng.uniform(-reach, reach, n)))]


def cross(p, q):
    side = lambda a, b, c: np.sign((b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0]))
    for turn in (-720, -360, 0, 360, 720):
        a, b, c, d = (p[1] + turn, p[2]), (p[3] + turn, p[4]), (q[1], q[2]), (q[3], q[4])
        if side(a, b, c) * side(a, b, d) < 0 and side(c, d, a) * side(c, d, b) < 0:
            return True
    return False


@pytest.mark.parametrize("size", [5.0, 30.0])
def test_crossings_match_brute_force(spark, size):
    rng = np.random.default_rng(3)
    tests, pieces = lines(rng, 60, 20), [*lines(rng, 60, 150), (60, 10.0, -50.0, 10.0, 50.0), (61, 350.0, 3.0, 371.0, 3.0)]
    a = spark.createDataFrame([*tests, (99, None, 1.0, 2.0, 3.0)], "id long, lon1 double, lat1 double, lon2 double, lat2 double")
    b = spark.createDataFrame([(0, *p) for p in pieces], "rec long, segment long, lon1 double, lat1 double, lon2 double, lat2 double")
    want = {(p[0], q[0]) for p in tests for q in pieces if cross(p, q)}
    assert {(r["id"], r["segment"]) for r in contours.crossed(a, b, size).collect()} == want and len(want) > 30
    counts = {r["id"]: r["crossings"] for r in contours.crossings(a, b, size).collect()}
    assert counts == {i: sum(x == i for x, _ in want) for i in [*range(60), 99]}


def test_segments_close_and_wrap(spark):
    points = spark.createDataFrame([("a", 0, 350.0, 0.0), ("a", 1, 10.0, 5.0), ("a", 2, 5.0, 50.0), ("b", 0, 1.0, 1.0), (None, 0, 1.0, 1.0), ("b", 1, None, 2.0)], "rec string, seq int, lon double, lat double")
    got = sorted((r["rec"], r["lon1"], r["lat1"], r["lon2"], r["lat2"]) for r in contours.segments(points, "rec", ["seq"], closed=True).collect())
    assert got == [("a", 5.0, 50.0, -10.0, 0.0), ("a", 10.0, 5.0, 5.0, 50.0), ("a", 350.0, 0.0, 370.0, 5.0)]
    assert contours.segments(points, "rec", ["seq"]).count() == 2


def test_uncertainty_fraction_of_a_parallel(spark):
    """About the equator a fraction e / (pi R) of places, one with another e km away, is on different sides: the boundary's dimension is 1."""
    ring = spark.createDataFrame([(0, k, k * 3.0, 0.0) for k in range(120)], "rec int, seq int, lon double, lat double")
    edge = contours.segments(ring, "rec", ["seq"], closed=True)
    found = contours.uncertainty_fraction(edge, [200.0, 400.0, 800.0], 10**6, 20_000)
    rows = {r["error"]: r for r in found.collect()}
    for e, r in rows.items():
        assert r["total"] == 20_001 and r["fraction"] == pytest.approx(2 * e / math.pi / (2 * R), rel=0.2)
    assert contours.dimension(found, "error", "fraction").first()["slope"] == pytest.approx(1, abs=0.15)
    few = {r["error"]: r for r in contours.uncertainty_fraction(edge, [800.0], 30, 20_000).collect()}[800.0]
    hits = sorted(r["draw"] for r in contours.crossed(contours.probes(spark, [800.0], 20_001), edge).select("id.draw").distinct().collect())
    assert (few["uncertain"], few["total"]) == (31, hits[30] + 1)


def walked(points, ruler, closed):
    """The walk point by point."""
    vec = lambda lon, lat: np.array([math.cos(math.radians(lat)) * math.cos(math.radians(lon)), math.cos(math.radians(lat)) * math.sin(math.radians(lon)), math.sin(math.radians(lat))])
    far = lambda a, b: 2 * R * math.asin(min(1, math.dist(a, b) / 2))
    x = [vec(*p) for p in points]
    at, d1, steps = x[0], 0.0, 0
    for i in range(1, len(x)):
        d2 = far(at, x[i])
        if d2 >= ruler:
            ds, share = far(x[i - 1], x[i]), (ruler - d1) / (d2 - d1)
            more = int(ds * (1 - share) / ruler)
            share += ruler * more / ds
            at = x[i - 1] + share * (x[i] - x[i - 1])
            at, d1, steps = at / np.linalg.norm(at), ds * (1 - share), steps + more + 1
        else:
            d1 = d2
    for i in range(len(x)) if closed else ():
        d2 = far(at, x[i])
        if d2 >= ruler:
            ds, share = far(x[i - 1], x[i]), (ruler - d1) / (d2 - d1)
            return steps + int(ds * (1 - share) / ruler) + 1 + (i == 0)
        d1 = d2
    return steps


@pytest.mark.parametrize("rows,closed", [(7, False), (7, True), (1000, True)])
def test_ruler_walk(spark, rows, closed):
    rng = np.random.default_rng(4)
    shapes = {"a": np.cumsum(rng.normal(size=(80, 2)), axis=0) + [180, 0], "b": np.cumsum(rng.normal(size=(9, 2)) * 8, axis=0) + [100, 10], "c": np.array([[5.0, 5.0]]), "d": np.array([[0.0, 0.0], [0.1, 0.1]])}
    rows_ = [(rec, k, float(lon), float(lat)) for rec, pts in shapes.items() for k, (lon, lat) in enumerate(pts)]
    df = spark.createDataFrame(rows_, "line string, seq int, lon double, lat double").repartition(5)
    got = {(r["rec"], r["ruler"]): r["steps"] for r in contours.ruler_walk(df, "line", ["seq"], [50.0, 300.0, 1500.0], closed, rows).collect()}
    assert got == {(rec, ruler): walked(pts.tolist(), ruler, closed) for rec, pts in shapes.items() for ruler in (50.0, 300.0, 1500.0)}


PLANES = hemispheres.Planes(25, 10_000.0)


def test_cells_are_numbered_row_by_row(spark):
    kept, k = {}, 0
    for j in range(25):
        for i in range(25):
            x, y = i * PLANES.step - 10_000, j * PLANES.step - 10_000
            if math.hypot(x, y) <= R * math.pi / 2 + math.hypot(PLANES.step, PLANES.step):
                kept[i, j], k = k, k + 1
    assert k == PLANES.packed < 625
    got = {(r["domain"], r["i"], r["j"]): r["cell"] for r in hemispheres.cells(spark, PLANES).collect()}
    assert got == {(d, i, j): n + d * k for (i, j), n in kept.items() for d in (0, 1)}


def globe(lon, lat):
    a, b = math.radians(lon), math.radians(lat)
    return 10 + 3 * math.sin(b) + math.cos(b) * math.cos(a - 1)


def test_packed_fields_come_back(spark):
    planes = hemispheres.Planes(101, 10_000.0)
    field = spark.createDataFrame([(i, j, globe(i * 5, j * 5 - 90)) for i in range(72) for j in range(37)], "i long, j long, q double")
    packed = hemispheres.to_planes(field, 72, 37, planes)
    assert packed.count() == 2 * planes.packed
    where = {r["cell"]: (r["lon"], r["lat"]) for r in hemispheres.cells(spark, planes).collect()}
    assert max(abs(r["q"] - globe(*where[r["cell"]])) for r in packed.collect()) < 0.01
    back = hemispheres.from_planes(packed, 24, 13, planes).collect()
    assert len(back) == 24 * 13 and max(abs(r["q"] - globe(r["i"] * 15, r["j"] * 15 - 90)) for r in back) < 0.02
    # A place beyond the equator of one plane is the same place on the other.
    places = [(k, lon, lat) for k, (lon, lat) in enumerate([(0.0, 90.0), (10.0, -90.0), (33.0, 4.0), (200.0, -7.0), (359.9, 0.0)])]
    for domain in (0, 1):
        x, y = hemispheres.on_plane(F.lit(domain), F.col("lon"), F.col("lat"))
        at = spark.createDataFrame(places, "id long, lon double, lat double").where(f"lat * (2 * {domain} - 1) > -89").select("id", F.lit(domain).alias("domain"), x.alias("x"), y.alias("y"))
        assert all(abs(r["q"] - globe(*places[r["id"]][1:])) < 0.02 for r in hemispheres.interpolate(packed, at, planes).collect())


def test_wind_across_the_equator(spark):
    """Solid rotation about a tilted axis carries points over the equator and back; a quarter turn is known exactly."""
    planes, tilt, lons, lats = hemispheres.Planes(121, 11_000.0), 0.9, 90, 61
    axis = np.array([math.sin(tilt), 0, math.cos(tilt)])

    def wind(lon, lat):
        a, b = math.radians(lon), math.radians(lat)
        p = np.array([math.cos(b) * math.cos(a), math.cos(b) * math.sin(a), math.sin(b)])
        w = R * np.cross(axis, p)
        return float(w @ [-math.sin(a), math.cos(a), 0]), float(w @ [-math.sin(b) * math.cos(a), -math.sin(b) * math.sin(a), math.cos(b)])

    rows = [(i, j, k, *wind(i * 360 / lons, j * 180 / (lats - 1) - 90)) for i in range(lons) for j in range(lats) for k in (0, 1)]
    field = hemispheres.wind_to_planes(spark.createDataFrame(rows, "i long, j long, i2 long, u double, v double"), lons, lats, planes)
    starts = [(k, lon, lat) for k, (lon, lat) in enumerate([(10.0, 30.0), (100.0, -20.0), (200.0, 5.0), (300.0, -60.0), (45.0, 88.0)])]
    df = spark.createDataFrame(starts, "id long, lon double, lat double").withColumn("domain", (F.col("lat") > 0).cast("int"))
    x, y = hemispheres.on_plane(F.col("domain"), F.col("lon"), F.col("lat"))
    steps, angle = 12, math.pi / 2
    found = hemispheres.trajectories(df.select("id", "domain", x.alias("x"), y.alias("y")), field, planes, (0.0, 2.0, 2), 0.0, angle / steps, steps, out_every=steps)
    last, changed = {r["id"]: r for r in found.where(f"step = {steps}").collect()}, 0
    for k, lon, lat in starts:
        a, b = math.radians(lon), math.radians(lat)
        p = np.array([math.cos(b) * math.cos(a), math.cos(b) * math.sin(a), math.sin(b)])
        want = p * math.cos(angle) + np.cross(axis, p) * math.sin(angle) + axis * (axis @ p) * (1 - math.cos(angle))
        r = last[k]
        far = math.hypot(r["x"], r["y"]) / R
        assert far <= math.pi / 2 + 1e-9
        got = np.array([math.sin(far) * r["x"] / (far * R), math.sin(far) * r["y"] / (far * R), (2 * r["domain"] - 1) * math.cos(far)])
        assert R * np.linalg.norm(got - want) < 30
        changed += r["domain"] != (lat > 0)
    assert changed >= 2


def test_jacobian_matches_differences(spark):
    planes = hemispheres.Planes(11, 10_000.0)
    n, d = 11, planes.step
    u = lambda x, y, t: 3 * x - 2 * y + x * y / 1e4 + t * x
    v = lambda x, y, t: y / 2 - x * y / 3e4 + t
    rows = [(dom, i, j, k, u(i * d - 10_000, j * d - 10_000, k), v(i * d - 10_000, j * d - 10_000, k)) for dom in (0, 1) for i in range(n) for j in range(n) for k in (0, 1)]
    field = spark.createDataFrame(rows, "domain int, i0 long, i1 long, i2 long, u double, v double")
    at = spark.createDataFrame([(0, 1, 123.0, -4567.0, 0.25), (1, 0, -3000.0, 10.0, 0.9)], "id long, domain int, x double, y double, t double")
    for r in hemispheres.jacobian(at, field, planes, (0.0, 1.0, 2)).collect():
        _, x, y, t = at.where(F.col("id") == r["id"]).select("id", "x", "y", "t").first()
        assert [r["ux"], r["uy"], r["vx"], r["vy"]] == pytest.approx([3 + y / 1e4 + t, -2 + x / 1e4, -y / 3e4, 0.5 - x / 3e4], rel=1e-6)


def cloud(n, d, seed):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, d))
    return x, (x[:, 0] + 0.3 * rng.normal(size=n) > 0).astype(int)


def adaptive(x, label, at, weight):
    d2 = ((x - at) ** 2).sum(axis=1)
    v = kernel.bandwidths(d2[None], weight, tolerance=1e-13)[0]
    w = np.exp(-d2 / (2 * v))
    s = np.where(label > 0, 1.0, -1.0)
    return (s * w).sum() / w.sum(), math.log(w.sum()) - x.shape[1] / 2 * math.log(2 * math.pi * v) - math.log(len(x)), w, v


def test_gradients_match_differences(spark):
    x, label = cloud(80, 3, 5)
    train = spark.createDataFrame([(i, v.tolist(), int(c)) for i, (v, c) in enumerate(zip(x, label))], "id long, x array<double>, label int")
    at = np.random.default_rng(6).normal(size=(5, 3))
    probes = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(at)], "id long, x array<double>")
    weighted = kernel.weights(neighbours.nearest(probes, train, len(x)), 9.0)
    for r in kernel.gradients(weighted, probes, train).collect():
        p, h = at[r["probe"]], 1e-4
        assert r["r"] == pytest.approx(adaptive(x, label, p, 9.0)[0], abs=1e-6)
        for name, k in (("grad_r", 0), ("grad_log_pdf", 1)):
            want = [(adaptive(x, label, p + h * e, 9.0)[k] - adaptive(x, label, p - h * e, 9.0)[k]) / (2 * h) for e in np.eye(3)]
            assert r[name] == pytest.approx(want, rel=1e-3, abs=1e-5)
    values = spark.createDataFrame([(i, float(v[0])) for i, v in enumerate(x)], "id long, y double")
    got = [{r["probe"]: r for r in f.collect()} for f in (kernel.density(weighted, 3, 80), kernel.regress(weighted, values), kernel.classify(weighted, train), kernel.two_class_difference(weighted, train))]
    joint = {(r["probe"], r["label"]): r["log_p"] for r in kernel.joint(weighted, train, 3, 80).collect()}
    for k, p in enumerate(at):
        r, log_pdf, w, v = adaptive(x, label, p, 9.0)
        assert got[0][k]["log_pdf"] == pytest.approx(log_pdf, abs=1e-6) and got[3][k]["r"] == pytest.approx(r, abs=1e-6)
        y = (w * x[:, 0]).sum() / w.sum()
        assert (got[1][k]["y"], got[1][k]["mse"]) == pytest.approx((y, (w * (x[:, 0] - y) ** 2).sum() / w.sum()), abs=1e-6)
        assert (got[2][k]["label"], got[2][k]["p"]) == (int(r > 0), pytest.approx((1 + abs(r)) / 2, abs=1e-6))
        for c in (0, 1):
            assert joint[k, c] == pytest.approx(math.log(w[label == c].sum()) - 1.5 * math.log(2 * math.pi * v) - math.log(80), abs=1e-5)


def test_linear_error_matches_brute_force(spark):
    x, _ = cloud(70, 3, 11)
    rng = np.random.default_rng(12)
    y = 2 * x[:, 0] - x[:, 1] + 0.1 * rng.normal(size=len(x))
    train = spark.createDataFrame([(i, v.tolist(), float(t)) for i, (v, t) in enumerate(zip(x, y))] + [(99, [0.0] * 3, None)], "id long, x array<double>, y double")
    at = [*rng.normal(size=(5, 3)), x[3]]
    probes = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(at)], "id long, x array<double>").repartition(3)
    weighted = kernel.weights(neighbours.nearest(probes, train.where("y IS NOT NULL"), len(x)), 9.0)
    got = {r["probe"]: r for r in kernel.regress_linear(weighted, probes, train).collect()}
    assert sorted(got) == list(range(6))

    def estimate(p):
        w = adaptive(x, np.zeros(len(x), dtype=int), p, 9.0)[2]
        return (w * y).sum() / w.sum(), w

    for k, p in enumerate(at):
        (f, w), h = estimate(p), 1e-4
        slope = np.array([(estimate(p + h * e)[0] - estimate(p - h * e)[0]) / (2 * h) for e in np.eye(3)])
        mse = (w * (f + (x - p) @ slope - y) ** 2).sum() / w.sum()
        assert got[k]["y"] == pytest.approx(f, abs=1e-6) and got[k]["gradient"] == pytest.approx(slope, rel=1e-3, abs=1e-4)
        assert (got[k]["mse"], got[k]["rmse"]) == pytest.approx((mse, mse**0.5), rel=1e-3)
    same = spark.createDataFrame([(i, [1.0, 2.0], float(i)) for i in range(4)], "id long, x array<double>, y double")
    flat = spark.createDataFrame([(0, i, 0.0, 1.0, 1.0) for i in range(4)], "probe long, train long, d2 double, variance double, w double")
    (r,) = kernel.regress_linear(flat, same.where("id = 0"), same).collect()
    assert (r["y"], r["gradient"], r["mse"]) == (1.5, [None, None], 1.25)
    assert kernel.regress_linear(weighted.limit(0), probes, train).collect() == []


def test_hierarchies_of_many_branches(spark):
    root = multiclass.parse_control('"a" { 4 "b" { 0 1 "c" { 2 3 } } "d" { 5 6 } }')
    sizes, rng = {0: 3, 1: 3, 2: 2, 3: 2}, np.random.default_rng(3)
    tree = {0: [4, -1, -2], 1: [0, 1, -3], 2: [5, 6], 3: [2, 3]}  # less than 0: the node of that number
    rows, want, greedy = [], {}, {}
    for i in range(40):
        p = {n: rng.dirichlet(np.ones(k)).round(3 if i else 0) for n, k in sizes.items()}
        rows += [(i, n, b, float(q)) for n, qs in p.items() for b, q in enumerate(qs)]

        def walk(n, q, p=p, i=i):
            for b, child in enumerate(tree[n]):
                if child < 0:
                    walk(-child, q * p[n][b])
                else:
                    want[i, child] = q * p[n][b]

        walk(0, 1.0)
        n, q = 0, 1.0
        while True:
            b = int(np.argmax(p[n]))
            q, child = q * p[n][b], tree[n][b]
            if child >= 0:
                break
            n = -child
        greedy[i] = (child, q)
    df = spark.createDataFrame(rows, "id long, node int, branch int, p double").repartition(5)
    way = multiclass.paths(spark, root)
    got = {(r["id"], r["cls"]): r["p"] for r in multiclass.class_probabilities(df, way).collect()}
    assert got == pytest.approx(want) and len(got) == 40 * 7
    assert {r["id"]: (r["cls"], pytest.approx(r["p"])) for r in multiclass.route_branches(df, way).collect()} == greedy
    part = multiclass.class_probabilities(df.where("id = 1 AND node <> 3"), way).collect()
    assert sorted(r["cls"] for r in part) == [0, 1, 4, 5, 6]
    assert multiclass.class_probabilities(df.limit(0), way).collect() == []


def test_optimal_width_matches_brute_force(spark):
    x, _ = cloud(900, 2, 7)
    train = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, x array<double>")
    at = np.random.default_rng(8).normal(size=(200, 2))
    probes = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(at)], "id long, x array<double>")
    low, high, n = 0.02, 0.5, len(x)
    got = {r["probe"]: r for r in kernel.optimal_density(probes, train, 2, low, high, 10).collect()}
    tries = low * (high / low) ** (np.arange(10) / 9)
    estimate = lambda p, v: np.exp(-((x - p) ** 2).sum(axis=1) / (2 * v)).sum() / (n * 2 * math.pi * v)
    errors = []
    for k, p in enumerate(at):
        values = np.array([estimate(p, v) for v in tries])
        level, slope = np.linalg.lstsq(np.stack([np.ones(10), tries / 2], 1) * np.sqrt(tries)[:, None], values * np.sqrt(tries), rcond=None)[0]
        level = level if level > 0 else values[-1]
        grid = np.geomspace(low, high, 20_001)
        best = grid[np.argmin((grid * slope / 2) ** 2 + level / (n * 4 * math.pi * grid))]
        assert got[k]["variance"] == pytest.approx(best, rel=2e-3) and got[k]["laplacian"] == pytest.approx(slope, rel=1e-6)
        assert got[k]["pdf"] == pytest.approx(estimate(p, got[k]["variance"]), rel=1e-9)
        errors.append((got[k]["pdf"] - math.exp(-(p @ p) / 2) / (2 * math.pi), got[k]["error"]))
    real, expected = np.sqrt(np.mean(np.square(errors), axis=0))
    assert 0.5 < real / expected < 2


@pytest.mark.parametrize("block", [20_000, 50])
def test_folds_in_one_search(spark, block):
    x, label = cloud(240, 3, 9)
    df = spark.createDataFrame([(i, v.tolist(), int(c), float(v[1])) for i, (v, c) in enumerate(zip(x, label))], "id long, x array<double>, label int, y double")
    parts = {r["id"]: r["fold"] for r in df.select("id", fold_number(F.col("id"), 4).alias("fold")).collect()}
    fold = np.array([parts[i] for i in range(240)])
    rows = df.withColumn("fold", fold_number(F.col("id"), 4)).select("id", "x", "fold")
    got = {(r["probe"], r["rank"]): r["train"] for r in neighbours.nearest(rows, rows, 7, block=block).collect()}
    d2 = ((x[:, None] - x) ** 2).sum(axis=2)
    d2[fold[:, None] == fold] = np.inf
    assert got == {(i, k + 1): int(j) for i in range(240) for k, j in enumerate(np.argsort(d2[i], kind="stable")[:7])}
    if block == 50:
        return
    for weight in (None, 3.0):
        found = {r["fold"]: r for r in cluster.cross_validate(df, 4, 7, weight).collect()}
        fits = {r["fold"]: r for r in cluster.cross_interpolate(df, 4, 7, weight).collect()}
        for f in range(4):
            right, away, mine = [], [], np.flatnonzero(fold == f)
            for i in mine:
                near = np.argsort(d2[i], kind="stable")[:7]
                w = np.ones(7) if weight is None else adaptive(x[near], label[near], x[i], weight)[2]
                one = w[label[near] == 1].sum()
                right.append((one > w.sum() - one) == bool(label[i]))
                away.append((w * x[near, 1]).sum() / w.sum() - x[i, 1])
            assert (found[f]["n"], found[f]["accuracy"]) == (len(mine), pytest.approx(np.mean(right)))
            assert (fits[f]["bias"], fits[f]["rmse"]) == pytest.approx((np.mean(away), np.sqrt(np.mean(np.square(away)))), abs=1e-6)


def test_density_clusters_match_the_flood(spark):
    rng = np.random.default_rng(10)
    x = np.concatenate([rng.normal(size=(60, 2)), rng.normal(size=(60, 2)) * 0.5 + 4, rng.uniform(-6, 8, (60, 2))])[rng.permutation(180)]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(180, [math.nan, 1.0])], "id long, x array<double>")
    d2 = ((x[:, None] - x) ** 2).sum(axis=2)
    near = np.argsort(d2, axis=1, kind="stable")
    for k, threshold in ((4, math.log(0.02)), (8, math.log(0.05))):
        r = (np.sqrt(np.take_along_axis(d2, near, 1)[:, k - 1]) + np.sqrt(np.take_along_axis(d2, near, 1)[:, k])) / 2
        dense = math.log(k / 181 / math.pi) - 2 * np.log(r) >= threshold
        want, number = np.zeros(181, dtype=int), 0
        for i in range(180):
            if dense[i] and not want[i]:
                number += 1
                todo = [i]
                while todo:
                    j = todo.pop()
                    if dense[j] and not want[j]:
                        want[j] = number
                        todo += near[j, : k + 1].tolist()
        found = {r["id"]: r["cluster"] for r in cluster.flood(df, k, threshold).collect()}
        assert [found[i] for i in range(181)] == want.tolist() and number > 1


def test_crossings_move_no_cells_of_lines(spark):
    """Long lines pass many cells; a boundary of few pieces goes to them."""
    rng = np.random.default_rng(8)
    lines = contours.short_way(spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(rng.uniform([0, -89, 0, -89], [360, 89, 360, 89], (200, 4)))], "id long, lon1 double, lat1 double, lon2 double, lat2 double"))
    ring = spark.createDataFrame([(0, k, k + 0.03, 20.0 * math.sin(k)) for k in range(360)], "rec int, k int, lon double, lat double")
    boundary = contours.segments(ring, "rec", ["k"], closed=True)
    found = {few: contours.crossed(lines, boundary, few=few) for few in (0, contours.FEW_PIECES)}
    rows = {few: sorted(map(tuple, f.collect())) for few, f in found.items()}
    assert rows[0] == rows[contours.FEW_PIECES] and len(rows[0]) > 100
    plan = found[contours.FEW_PIECES]._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("strategy=broadcast") == 1


def test_strides_are_those_of_rulers_walked_one_by_one():
    rng = np.random.default_rng(6)
    size = np.array([0, 1, 2, 40, 300, *rng.integers(1, 200, 30)])
    end, ruler = np.cumsum(size), rng.choice([50.0, 900.0, 4000.0], len(size))
    x = contours._vectors(rng.uniform(0, 360, size.sum()), rng.uniform(-89, 89, size.sum()))
    x[41:200] = contours._vectors(np.linspace(0, 20, 159), np.linspace(0, 9, 159))
    state = {"at": np.full((len(size), 3), np.nan), "before": np.full((len(size), 3), np.nan), "d": np.zeros(len(size)), "steps": np.zeros(len(size), dtype=np.int64)}
    cut = end - size // 3
    contours.strides(x, end - size, cut, state, ruler, 4)
    contours.strides(x, cut, end, state, ruler, 4)
    for k in range(len(size)):
        one = {"at": None, "before": None, "d": 0.0, "steps": 0}
        contours.stride(x[end[k] - size[k] : cut[k]], one, ruler[k])
        contours.stride(x[cut[k] : end[k]], one, ruler[k])
        assert one["steps"] == state["steps"][k] and one["d"] == state["d"][k]


@pytest.mark.parametrize("few", [0, 1000])
def test_smallest_ids_that_lead_to_nodes(spark, few):
    rng = np.random.default_rng(3)
    pairs = [tuple(map(int, p)) for p in rng.integers(0, 60, (55, 2))]
    pairs += [(b, a) for a, b in pairs[:20]] + [(90, 70), (71, 90), (72, 71)]
    want = {i: i for i in range(100)}
    for start in range(100):
        todo, seen = [start], {start}
        while todo:
            at = todo.pop()
            want[at] = min(want[at], start)
            new = {b for a, b in pairs if a == at} - seen
            seen |= new
            todo += new
    nodes, links = spark.range(100), spark.createDataFrame(pairs, "a long, b long")
    assert {r["id"]: r["root"] for r in graph.led_to(nodes, links, few).collect()} == want


def test_density_clusters_of_a_line_take_few_jobs(spark):
    """Ids that fall along the line hand the smallest on by one neighbour a round."""
    df = spark.createDataFrame([((120 - i) % 120, [i + 0.001 * (i % 7)]) for i in range(120)], "id long, x array<double>")
    spark.sparkContext.setJobGroup("line", "line")
    found = cluster.flood(df, 3, -100.0).collect()
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("line"))
    spark.sparkContext.setJobGroup("", "")
    assert {r["cluster"] for r in found} == {1} and jobs < 100


@pytest.mark.parametrize("kind", ["classes", "machine"])
def test_borders_of_a_model_in_batches(spark, kind):
    x, label = cloud(150, 3, 11)
    df = spark.createDataFrame([(i, v.tolist(), int(c)) for i, (v, c) in enumerate(zip(x, label))], "id long, x array<double>, label int").repartition(3)
    s, v = np.where(label > 0, 1.0, -1.0), 0.4
    if kind == "classes":
        model = borders.class_difference(df, v)
        value = lambda p: (s * np.exp(-((x - p) ** 2).sum(axis=1) / (2 * v))).sum() / np.exp(-((x - p) ** 2).sum(axis=1) / (2 * v)).sum()
    else:
        model = borders.kernel_machine(df.select("id", "x", F.when(F.col("label") > 0, 0.5).otherwise(-0.5).alias("c")), 1.25, 0.2)
        value = lambda p: (s / 2 * np.exp(-1.25 * ((x - p) ** 2).sum(axis=1))).sum() + 0.2
    pairs = borders.opposite(df, 120)
    assert pairs.count() == 120 and pairs.select("a", "b").distinct().count() == 120
    found = borders.train_model(model, pairs, 1e-6).collect()
    want = sum(value(np.array(r["a"])) * value(np.array(r["b"])) < 0 for r in pairs.collect())
    assert len(found) == want > 60
    for r in found:
        p = np.array(r["border"])
        assert abs(value(p)) < 1e-4
        assert r["grad"] == pytest.approx([(value(p + 1e-5 * e) - value(p - 1e-5 * e)) / 2e-5 for e in np.eye(3)], rel=1e-3, abs=1e-4)
    table = spark.createDataFrame([(r["k"], r["border"], r["grad"]) for r in found], "k long, border array<double>, grad array<double>")
    cls = {r["id"]: r["cls"] for r in borders.classify(df.select("id", "x"), table).collect()}
    own = {r["id"]: r["r"] for r in model(df.select("id", "x")).collect()}
    assert all(own[i] == pytest.approx(value(p), abs=1e-9) for i, p in enumerate(x))
    assert np.mean([cls[i] == (own[i] > 0) for i in own]) > 0.9
