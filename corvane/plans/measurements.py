"""Queries of time series, grids, geometry, tracers and contours."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import geo
from ..operators import grids, joins, simulate, velocity
from ..operators.neighbours import nearest
from ..operators.prepare import in_latitudes
from .registry import Registry

REGISTRY = query = Registry()

#: Events as measurements: seconds since the first day, a longitude and a latitude from their numbers.
M = "m AS (SELECT event_id AS id, user_id, (epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) / 1000000.0::DOUBLE AS t, ((event_id * 37) % 3600) / 10.0::DOUBLE AS lon, ((event_id * 53) % 1780) / 10.0 - 89.0::DOUBLE AS lat, value AS q FROM events)"


def measured(read):
    e, start = read("events"), F.unix_micros(F.lit("2024-01-01").cast("timestamp"))
    return e.select(F.col("event_id").alias("id"), "user_id", ((F.unix_micros(F.col("ts").cast("timestamp")) - start) / 1e6).alias("t"), ((F.col("event_id") * 37 % 3600) / 10.0).alias("lon"), ((F.col("event_id") * 53 % 1780) / 10.0 - 89.0).alias("lat"), F.col("value").alias("q"))


@query(f"WITH {M}, a AS (SELECT user_id, t AS k, row_number() OVER (PARTITION BY user_id ORDER BY t, id) - 1 AS i FROM m WHERE q > 50) SELECT m.id, max(a.k) AS k0, count(a.k) - 1 AS i0 FROM m LEFT JOIN a ON a.user_id = m.user_id AND a.k <= m.t GROUP BY m.id")
def asof_lookup(read, spark):
    m = measured(read)
    number = F.row_number().over(Window.partitionBy("user_id").orderBy("t", "id")) - 1
    axis = m.where("q > 50").withColumn("i", number.cast("long")).select("user_id", F.col("t").alias("k"), "i")
    return joins.asof(m.select("id", "user_id", "t"), axis, ["user_id"], "t").select("id", "k0", F.coalesce("i0", F.lit(-1)).alias("i0"))


@query(f"WITH {M} SELECT id, CAST(least(greatest(floor(t / 3600), 0), 98) AS INTEGER) AS i0, round(t / 3600, 9) AS \"index\" FROM m")
def asof_interpolate(read, spark):
    return joins.even_axis(measured(read).select("id", "t"), "t", 0.0, 3600.0, 100).select("id", "i0", F.round("index", 9).alias("index"))


@query(f"WITH {M}, g AS (SELECT i AS grid, i * 21600.0::DOUBLE AS t FROM range(120) r(i)) SELECT grid, count(*) AS n, round(sum(q), 3) AS q FROM g JOIN m ON m.t BETWEEN g.t - 43200 AND g.t + 43200 GROUP BY grid")
def window_measurements(read, spark):
    w = joins.window_counts(measured(read), "t", 0, 21600, 120, 43200)
    return w.groupBy("grid").agg(F.count("*").alias("n"), F.round(F.sum("q"), 3).alias("q"))


@query(f"WITH {M} SELECT id, t, lat FROM m WHERE t BETWEEN 86400 AND 259200 AND lat >= 0")
def select_meas(read, spark):
    return measured(read).where("t between 86400 and 259200 and lat >= 0").select("id", "t", "lat")


@query(f"WITH {M} SELECT count(*) AS inside, (SELECT count(*) FROM m WHERE lat >= 60 OR lat <= -60) AS outside FROM m WHERE lat >= -30 AND lat <= 30")
def select_lat_range(read, spark):
    lat = F.col("lat")
    return measured(read).agg(F.count_if(in_latitudes(lat, -30, 30)).alias("inside"), F.count_if(in_latitudes(lat, 60, -60)).alias("outside"))


@query(f"WITH {M} SELECT id, round(ln(q), 9) AS q, round(0.1 / q, 9) AS err FROM m WHERE q > 1")
def log_measurements(read, spark):
    from ..operators.prepare import log_with_error

    q, err = log_with_error(F.col("q"), F.lit(0.1))
    return measured(read).where("q > 1").select("id", F.round(q, 9).alias("q"), F.round(err, 9).alias("err"))


@query("""
    WITH d AS (SELECT l_quantity AS a, l_quantity + l_linenumber - 3 AS b FROM lineitem), s AS (SELECT avg(b - a) AS bias, stddev_samp(a) AS sd FROM d)
    SELECT round(corr(a, b), 9) AS r, round(any_value(bias), 9) AS bias, round(stddev_samp(b - a), 9) AS rms, round(any_value(bias / sd), 9) AS bias_std, round(any_value(stddev_samp_all / sd), 9) AS rms_std, round(avg(CASE WHEN b > 0 AND b / a BETWEEN 0.5 AND 2 THEN 1.0 ELSE 0.0 END), 9) AS fac2
    FROM d, s, (SELECT stddev_samp(b - a) AS stddev_samp_all FROM d)""")
def fac2_stats(read, spark):
    d = read("lineitem").select(F.col("l_quantity").alias("a"), (F.col("l_quantity") + F.col("l_linenumber") - 3).alias("b"))
    return grids.agreement(d, "a", "b")


@query(f"WITH {M}, c AS (SELECT q, sum(cos(radians(lat))) AS a FROM m GROUP BY q), u AS (SELECT q, sum(a) OVER (ORDER BY q) AS upto, sum(a) OVER () AS total FROM c) SELECT q, round(degrees(asin(greatest(-1, least(1, 2 * upto / total - 1)))), 4) AS eq_lat FROM u")
def equivalent_area(read, spark):
    m = measured(read).select("q", F.cos(F.radians("lat")).alias("area"))
    return grids.equivalent_latitude(m, "q", "area").select("q", F.round("eq_lat", 4).alias("eq_lat"))


R = "6366.197723675813"


@query(f"WITH {M} SELECT id, round({R} * (pi() / 2 - radians(abs(lat))) * cos(radians(lon)), 6) AS x, round({R} * (pi() / 2 - radians(abs(lat))) * sin(radians(lon)), 6) AS y, CASE WHEN lat < 0 THEN -1 ELSE 1 END AS hemi FROM m")
def aeq_projection(read, spark):
    x, y, hemi = geo.to_plane(F.col("lon"), F.col("lat"))
    return measured(read).select("id", F.round(x, 6).alias("x"), F.round(y, 6).alias("y"), hemi.alias("hemi"))


@query(f"WITH {M} SELECT id, round(lon, 6) AS lon, round(lat, 6) AS lat FROM m")
def aeq_inverse(read, spark):
    x, y, hemi = geo.to_plane(F.col("lon"), F.col("lat"))
    lon, lat = geo.from_plane(F.col("x"), F.col("y"), F.col("hemi"))
    return measured(read).select("id", x.alias("x"), y.alias("y"), hemi.alias("hemi")).select("id", F.round(lon, 6).alias("lon"), F.round(lat, 6).alias("lat"))


@query(f"""WITH {M}, p AS (SELECT user_id, id, lon, lat, lag(lon) OVER w AS lon0, lag(lat) OVER w AS lat0 FROM m WINDOW w AS (PARTITION BY user_id ORDER BY t, id)),
    s AS (SELECT user_id, 2 * {R} * asin(sqrt(least(1, sin(radians(lat - lat0) / 2) ** 2 + cos(radians(lat0)) * cos(radians(lat)) * sin(radians(lon - lon0) / 2) ** 2))) + 0 * lon0 AS d FROM p)
    SELECT user_id, count(d) AS segments, round(coalesce(sum(d), 0), 4) AS km FROM s GROUP BY user_id""")
def great_circle_segments(read, spark):
    p = measured(read).withColumn("rec", F.col("user_id"))
    return grids.contour_length(p, "rec", ["t", "id"]).select(F.col("rec").alias("user_id"), "segments", F.round("km", 4).alias("km"))


@query(f"WITH {M} SELECT e AS size, count(DISTINCT (floor(lon / e), floor(lat / e))) AS boxes FROM m, (VALUES (1.0::DOUBLE), (2.0), (4.0), (8.0), (16.0), (32.0)) v(e) GROUP BY e")
def box_count(read, spark):
    return grids.box_counts(measured(read), "lon", "lat", [1.0, 2.0, 4.0, 8.0, 16.0, 32.0])


@query(f"WITH {M} SELECT id, round((250 + lat / 3) * pow(1000.0 / (100 + lon), 0.2857), 6) AS theta FROM m")
def potential_temperature(read, spark):
    t = geo.potential_temperature(250 + F.col("lat") / 3, 100 + F.col("lon"))
    return measured(read).select("id", F.round(t, 6).alias("theta"))


GRID = "g AS (SELECT i, j, sin(i * 10 * pi() / 180) + j / 10.0 AS v FROM range(37) a(i), range(19) b(j))"


@query(f"""WITH {M}, {GRID}, c AS (SELECT id, lon / 10 AS x, (lat + 90) / 10 AS y FROM m),
    f AS (SELECT id, least(floor(x), 35)::BIGINT AS i, least(floor(y), 17)::BIGINT AS j, x - least(floor(x), 35) AS u, y - least(floor(y), 17) AS w FROM c)
    SELECT id, round(sum(g.v * CASE WHEN g.i = f.i THEN 1 - u ELSE u END * CASE WHEN g.j = f.j THEN 1 - w ELSE w END), 6) AS v FROM f JOIN g ON g.i IN (f.i, f.i + 1) AND g.j IN (f.j, f.j + 1) GROUP BY id""")
def grid_interpolation(read, spark):
    field = spark.range(37).select(F.col("id").alias("i0")).crossJoin(F.broadcast(spark.range(19).select(F.col("id").alias("i1")))).select("i0", "i1", (F.sin(F.col("i0") * 10 * F.pi() / 180) + F.col("i1") / 10).alias("v"))
    at = measured(read).select("id", (F.col("lon") / 10).alias("x0"), ((F.col("lat") + 90) / 10).alias("x1"))
    return grids.interpolate(at, field, ["x0", "x1"], [37, 19]).select("id", F.round("v", 6).alias("v"))


@query(f"""WITH {M}, g AS (SELECT k, c, 100 * k + c AS v FROM range(401) a(k), range(36) b(c)), f AS (SELECT id, floor(t / 86400)::BIGINT AS k, t / 86400 - floor(t / 86400) AS w, floor(lon / 10)::BIGINT AS c FROM m)
    SELECT f.id, round(sum(g.v * CASE WHEN g.k = f.k THEN 1 - w ELSE w END), 4) AS v FROM f JOIN g ON g.c = f.c AND g.k IN (f.k, f.k + 1) GROUP BY f.id""")
def tracer_interpolate(read, spark):
    field = spark.range(401 * 36).select(F.floor(F.col("id") / 36).alias("step"), (F.col("id") % 36).alias("cell")).withColumn("q", 100.0 * F.col("step") + F.col("cell"))
    at = measured(read).select("id", (F.col("t") / 86400).alias("at"), F.floor(F.col("lon") / 10).alias("cell"), F.lit(1.0).alias("w"))
    return grids.tracer_at(at, field).select("id", F.round("v", 4).alias("v"))


XYZ = "cos(radians(lat)) * cos(radians(lon)) AS x, cos(radians(lat)) * sin(radians(lon)) AS y, sin(radians(lat)) AS z"
CHORD = "(p.x - c.x) ** 2 + (p.y - c.y) ** 2 + (p.z - c.z) ** 2"


@query(f"WITH {M}, c AS (SELECT id, q, {XYZ} FROM m) SELECT id, near, round(2 * {R} * asin(least(1, sqrt(d2) / 2)), 3) AS km FROM (SELECT p.id, c.id AS near, {CHORD} AS d2, row_number() OVER (PARTITION BY p.id ORDER BY {CHORD}, c.id) AS r FROM c p JOIN c ON p.id % 20 = 0 AND c.q > 20) WHERE r = 1")
def binned_nearest(read, spark):
    m = measured(read)
    out = joins.nearest_on_globe(m.where("id % 20 = 0").select("id", "lon", "lat"), m.where("q > 20").select("id", "lon", "lat"), 2.0)
    return out.select("id", "near", F.round("km", 3).alias("km"))


@query(f"WITH {M}, b AS (SELECT floor(t / 86400)::BIGINT AS day, q, lat FROM m) SELECT day, count(*) AS n, round(regr_intercept(q, lat), 6) AS intercept, round(regr_slope(q, lat), 6) AS slope FROM b GROUP BY day HAVING count(*) > 1 AND count(DISTINCT lat) > 1")
def proxy_regression(read, spark):
    m = measured(read).withColumn("day", F.floor(F.col("t") / 86400))
    out = grids.proxy_fit(m, ["day"], "lat", "q", 1).where("coefficients is not null")
    return out.select("day", "n", F.round(F.col("coefficients")[0], 6).alias("intercept"), F.round(F.col("coefficients")[1], 6).alias("slope"))


@query()
def proxy_quadratic(read, spark):
    m = measured(read).withColumn("day", F.floor(F.col("t") / 86400))
    return grids.proxy_fit(m, ["day"], "lat", "q", 2)


@query(f"WITH {M}, c AS (SELECT id, {XYZ} FROM m) SELECT probe, train, CAST(rank AS INTEGER) AS rank, round(d2, 9) AS d2 FROM (SELECT p.id AS probe, c.id AS train, {CHORD} AS d2, row_number() OVER (PARTITION BY p.id ORDER BY {CHORD}, c.id) AS rank FROM c p JOIN c ON p.id % 20 = 0) WHERE rank <= 3")
def knn_on_globe(read, spark):
    m = measured(read).select("id", F.array(*geo.unit_vector(F.col("lon"), F.col("lat"))).alias("x"))
    return nearest(m.where("id % 20 = 0"), m, 3).select("probe", "train", "rank", F.round("d2", 9).alias("d2"))


@query(f"WITH {M} SELECT id, round(-h * v * cos(a) - r * sin(a) * w, 6) AS vx, round(-h * v * sin(a) + r * cos(a) * w, 6) AS vy FROM (SELECT id, CASE WHEN lat < 0 THEN -1 ELSE 1 END AS h, radians(lon) AS a, {R} * (pi() / 2 - radians(abs(lat))) AS r, q / 10 AS v, q / 5 / ({R} * cos(radians(lat))) AS w FROM m)")
def plane_velocity(read, spark):
    vx, vy = geo.to_plane_velocity(F.col("lon"), F.col("lat"), F.col("q") / 5, F.col("q") / 10)
    return measured(read).select("id", F.round(vx, 6).alias("vx"), F.round(vy, 6).alias("vy"))


@query(f"WITH {M}, a AS (SELECT user_id, {XYZ}, row_number() OVER (PARTITION BY user_id ORDER BY t, id) - 1 AS s FROM m), e(k) AS (VALUES (1), (2), (4), (8)), p AS (SELECT k, user_id, x, y, z, lag(x) OVER w AS x0, lag(y) OVER w AS y0, lag(z) OVER w AS z0 FROM a, e WHERE s % k = 0 WINDOW w AS (PARTITION BY k, user_id ORDER BY s)) SELECT k::INTEGER AS k, count(x0) AS steps, round(sum(2 * {R} * asin(least(1, sqrt((x - x0) ** 2 + (y - y0) ** 2 + (z - z0) ** 2) / 2))) FILTER (x0 IS NOT NULL), 1) AS km FROM p GROUP BY k")
def ruler_lengths(read, spark):
    return grids.ruler_lengths(measured(read), "user_id", ["t", "id"], [1, 2, 4, 8]).withColumn("km", F.round("km", 1))


@query(f"""WITH {M}, f AS (SELECT i, j, k, sin(i / 3.0) + j * k / 50.0 AS u, cos(j / 4.0) - i * k / 100.0 AS v FROM range(19) a(i), range(10) b(j), range(5) c(k)),
    c AS (SELECT id, lon / 20 AS x, (lat + 90) / 20 AS y, least(t / 864000, 4) AS s FROM m),
    w AS (SELECT *, least(floor(x), 17)::BIGINT AS i, least(floor(y), 8)::BIGINT AS j, least(floor(s), 3)::BIGINT AS k FROM c),
    g AS (SELECT w.id, (CASE WHEN f.i = w.i THEN 1 - (x - w.i) ELSE x - w.i END) * (CASE WHEN f.j = w.j THEN 1 - (y - w.j) ELSE y - w.j END) * (CASE WHEN f.k = w.k THEN 1 - (s - w.k) ELSE s - w.k END) AS p, u, v FROM w JOIN f ON f.i IN (w.i, w.i + 1) AND f.j IN (w.j, w.j + 1) AND f.k IN (w.k, w.k + 1))
    SELECT id, round(sum(p * u), 6) AS u, round(sum(p * v), 6) AS v FROM g GROUP BY id""")
def gridded_velocity(read, spark):
    n = F.col("id")
    field = spark.range(19 * 10 * 5).select((n % 19).alias("i0"), (F.floor(n / 19) % 10).alias("i1"), F.floor(n / 190).alias("i2"))
    i, j, k = (F.col(c) for c in ("i0", "i1", "i2"))
    field = field.select("i0", "i1", "i2", (F.sin(i / 3) + j * k / 50).alias("u"), (F.cos(j / 4) - i * k / 100).alias("v"))
    at = measured(read).select("id", (F.col("lon") / 20).alias("x0"), ((F.col("lat") + 90) / 20).alias("x1"), F.least(F.col("t") / 864000, F.lit(4.0)).alias("x2"))
    return velocity.interpolated(at, field, [19, 10, 5]).select("id", F.round("u", 6).alias("u"), F.round("v", 6).alias("v"))


@query()
def gridded_trajectories(read, spark):
    field = velocity.gridded(spark, lambda x, y, t: (-y, x), (-2.0, 2.0, 81), (-2.0, 2.0, 81), (0.0, 1.0, 2))
    start = measured(read).groupBy("user_id").agg(F.avg("lon").alias("a"), F.avg("lat").alias("b")).select(F.col("user_id").alias("id"), (F.col("a") / 360).alias("x"), (F.col("b") / 90).alias("y"))
    return velocity.trajectories(start, field, (-2.0, 2.0, 81), (-2.0, 2.0, 81), (0.0, 1.0, 2), 0.0, 0.05, 4)


@query()
def trajectories(read, spark):
    start = spark.range(20).select("id", (F.col("id") / 10).alias("x"), F.lit(0.5).alias("y"))
    return simulate.trajectories(start, simulate.rotation, 0.0, 0.05, 40)


@query()
def transport_and_multiply(read, spark):
    maps = simulate.transport_map(spark, simulate.rotation, 12, 0.05, 4)
    q = spark.range(144).select(F.col("id").alias("i"), F.sin(F.col("id") / 20).alias("v"))
    return simulate.advance(maps, q, 4)


@query()
def contour_advection(read, spark):
    circle = spark.range(40).select(F.lit(0).alias("rec"), F.col("id").alias("seq"), (0.3 * F.cos(F.col("id") * F.pi() / 20)).alias("x"), (0.3 * F.sin(F.col("id") * F.pi() / 20) + 0.2).alias("y"))
    return simulate.advect_contours(circle, simulate.rotation, 0.0, 0.05, 20, 0.02, 0.2)


@query()
def metropolis_chain(read, spark):
    return simulate.metropolis(spark, chains=4, length=200, seed=3)


@query(f"WITH {M}, l AS (SELECT user_id AS c, lat AS level, q, id FROM m), two AS (SELECT c, level, q, lead(level) OVER w AS l1, lead(q) OVER w AS q1 FROM (SELECT c, level, avg(q) AS q FROM l GROUP BY ALL) WINDOW w AS (PARTITION BY c ORDER BY level)) SELECT c, round(q + (q1 - q) * (10 - level) / (l1 - level), 6) AS q FROM two WHERE level <= 10 AND l1 > 10")
def level_interpolation(read, spark):
    m = measured(read).select(F.col("user_id").alias("c"), F.col("lat").alias("level"), "q").groupBy("c", "level").agg(F.avg("q").alias("q"))
    return grids.level_interpolation(m, ["c"], "level", "q", 10.0).select("c", F.round("q", 6).alias("q"))


@query(f"WITH {M} SELECT user_id, id, round(CASE WHEN abs(lat) >= 87.5 THEN 1 ELSE 0 END, 1)::INTEGER AS polar, round(10000.0 / 90 * abs(lat), 6) AS km FROM m")
def polar_flag(read, spark):
    return measured(read).select("user_id", "id", (F.abs("lat") >= 87.5).cast("int").alias("polar"), F.round(geo.KM_DEGREE * F.abs("lat"), 6).alias("km"))


@query("SELECT event_type, start, n, total FROM (SELECT event_type, date_trunc('hour', ts) AS start, count(*) AS n, round(sum(value), 3) AS total FROM events GROUP BY ALL)")
def tumbling_windows(read, spark):
    w = read("events").groupBy("event_type", F.window(F.col("ts").cast("timestamp"), "1 hour").alias("w")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 3).alias("total"))
    return w.select("event_type", F.col("w.start").cast("timestamp_ntz").alias("start"), "n", "total")


@query()
def strain_along_paths(read, spark):
    start = spark.range(20).select("id", (F.col("id") / 10).alias("x"), F.lit(0.5).alias("y"))
    return simulate.strain(start, simulate.rotation, 0.0, 0.05, 40)


@query("WITH g AS (SELECT i, j, k, i + 4 * j + 20 * k AS n FROM range(4) a(i), range(5) b(j), range(3) c(k)) SELECT n, n % 4 AS i, (n // 4) % 5 AS j, n // 20 AS k FROM g")
def grid_subscripts(read, spark):
    i, j, k = grids.subscripts(F.col("n"), [4, 5, 3])
    back = spark.range(60).select(F.col("id").alias("n")).select("n", i.alias("i"), j.alias("j"), k.alias("k"))
    return back.select(grids.flat_index(["i", "j", "k"], [4, 5, 3]).alias("n"), "i", "j", "k")


@query("SELECT i, j, i * (i - 1) // 2 + j AS n FROM range(12) a(i), range(12) b(j) WHERE j < i")
def triangle_index(read, spark):
    rows = spark.range(144).select(F.floor(F.col("id") / 12).alias("i"), (F.col("id") % 12).alias("j")).where("j < i")
    return rows.select("i", "j", grids.pair_index(F.col("i"), F.col("j")).alias("n"))


@query(f"WITH {M}, a AS (SELECT user_id AS x, floor(t / 86400)::BIGINT AS day, sum(q) AS q FROM m GROUP BY ALL), b AS (SELECT floor(t / 86400)::BIGINT AS day, count(*) AS n FROM m GROUP BY 1) SELECT x, day, round(q * n, 3) AS v FROM a JOIN b USING (day)")
def combine_variables(read, spark):
    m = measured(read).withColumn("day", F.floor(F.col("t") / 86400))
    a = m.groupBy(F.col("user_id").alias("x"), "day").agg(F.sum("q").alias("q"))
    return grids.combine(a, m.groupBy("day").agg(F.count("*").alias("n")), ["day"]).select("x", "day", F.round(F.col("q") * F.col("n"), 3).alias("v"))


@query("SELECT v, row_number() OVER (ORDER BY v) - 1 AS number FROM (SELECT s_nationkey AS v FROM supplier UNION SELECT p_size FROM part)")
def axis_union(read, spark):
    return grids.axis_union(read("supplier").select(F.col("s_nationkey").alias("v")), read("part").select(F.col("p_size").alias("v")))


@query("SELECT event_id, strftime(ts, '%Y/%m/%d') || CASE WHEN epoch_us(ts) % 60000000 <> 0 THEN strftime(ts, '-%H:%M:') || printf('%5.2f', (epoch_us(ts) % 60000000) / 1000000.0) WHEN hour(ts) = 0 AND minute(ts) = 0 THEN '' WHEN minute(ts) <> 0 THEN strftime(ts, '-%H:%M') ELSE strftime(ts, '-%H') END AS text FROM events")
def date_shortest_text(read, spark):
    from ..functions import dates

    return read("events").select("event_id", dates.write(F.col("ts")).alias("text"))


@query(f"WITH {M} SELECT id, round(q - 7.5 * trunc(q / 7.5), 9) + 0.0 AS rest, round(sqrt(abs(q)), 9) AS root, round(-q, 9) AS negated, round(pow(abs(q), 0.3), 9) AS power FROM m")
def scalar_arithmetic(read, spark):
    q = F.col("q")
    return measured(read).select("id", (F.round(q - 7.5 * (q / 7.5).cast("long"), 9) + 0.0).alias("rest"), F.round(F.sqrt(F.abs(q)), 9).alias("root"), F.round(-q, 9).alias("negated"), F.round(F.pow(F.abs(q), F.lit(0.3)), 9).alias("power"))


@query("SELECT k, round(1.0 * pow(1000.0, k / 9.0), 6) AS geometric, round(1 + 999.0 * k / 9, 6)::DOUBLE AS even FROM range(10) r(k)")
def contour_levels(read, spark):
    g, e = grids.levels(1, 1000, 10, geometric=True), grids.levels(1, 1000, 10)
    return spark.createDataFrame([(k, round(g[k], 6), round(e[k], 6)) for k in range(10)], "k long, geometric double, even double")
