"""Queries along uneven axes, of contours and their crossings, and of fields and winds on two polar planes."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import axes, contours, hemispheres
from ..operators.hemispheres import Planes
from .measurements import M, R, measured
from .registry import Registry

REGISTRY = query = Registry()

#: Users' first events: an uneven axis that grows with the data, with the values that came first.
AXIS = "a AS (SELECT k, avg(v) AS v FROM (SELECT min(t) AS k, min_by(q, (t, id)) AS v FROM m GROUP BY user_id) GROUP BY k)"


def first_events(read):
    return measured(read).groupBy("user_id").agg(F.min("t").alias("k"), F.min_by("q", F.struct("t", "id")).alias("v"))


@query(f"""
    WITH {M}, {AXIS}, p AS (SELECT k, v, row_number() OVER w - 1 AS i, lead(k) OVER w AS kn, lead(v) OVER w AS vn, lag(k) OVER w AS kp, lag(v) OVER w AS vp FROM a WINDOW w AS (ORDER BY k)),
    l AS (SELECT k, i, kn, CASE WHEN kn IS NULL THEN i - 1 ELSE i END AS bi, CASE WHEN kn IS NULL THEN kp ELSE k END AS bk, CASE WHEN kn IS NULL THEN k ELSE kn END AS bn,
        CASE WHEN kn IS NULL THEN vp ELSE v END AS bv, CASE WHEN kn IS NULL THEN v ELSE vn END AS bw FROM p),
    f AS (SELECT * FROM l WHERE i = 0), d AS (SELECT id, t FROM m),
    j AS (SELECT d.id, d.t, l.k AS k0, l.i AS i0, CASE WHEN l.k IS NULL THEN f.k ELSE l.kn END AS k1, coalesce(l.bi, f.bi) AS bi, coalesce(l.bk, f.bk) AS bk, coalesce(l.bn, f.bn) AS bn, coalesce(l.bv, f.bv) AS bv, coalesce(l.bw, f.bw) AS bw
        FROM d ASOF LEFT JOIN l ON d.t >= l.k CROSS JOIN f)
    SELECT id, k0, i0, k1, round(bi + (t - bk) / (bn - bk), 6) AS "index", round(bv + (t - bk) / (bn - bk) * (bw - bv), 5) AS v FROM j""")
def asof_uneven(read, spark):
    found = axes.asof(measured(read).select("id", "t"), first_events(read), "t", ["v"])
    return found.select("id", "k0", "i0", "k1", F.round("index", 6).alias("index"), F.round("v", 5).alias("v"))


#: A closed contour round the globe: the mean latitude of each degree of longitude; and the users' tracks, each piece the short way round.
RING = "ring AS (SELECT floor(lon)::BIGINT AS k, floor(lon) + 0.03 AS lon, avg(lat) AS lat FROM m GROUP BY ALL)"
SHORT = lambda a, b: f"{a} + ((({b} - {a} + 180) % 360 + 360) % 360) - 180"
EDGE = f"""two AS (SELECT k, lon AS x1, lat AS y1, coalesce(lead(lon) OVER w, first_value(lon) OVER w) AS lon2, coalesce(lead(lat) OVER w, first_value(lat) OVER w) AS y2 FROM ring WINDOW w AS (ORDER BY k)),
    edge AS (SELECT k, x1 + turn AS x1, y1, {SHORT("x1", "lon2")} + turn AS x2, y2 FROM two, (VALUES (-720), (-360), (0), (360), (720)) v(turn))"""
TURN = lambda ax, ay, bx, by, px, py: f"sign(({bx} - {ax}) * ({py} - {ay}) - ({by} - {ay}) * ({px} - {ax}))"
APART = f"""{TURN("e.x1", "e.y1", "e.x2", "e.y2", "s.x1", "s.y1")} * {TURN("e.x1", "e.y1", "e.x2", "e.y2", "s.x2", "s.y2")} < 0
    AND {TURN("s.x1", "s.y1", "s.x2", "s.y2", "e.x1", "e.y1")} * {TURN("s.x1", "s.y1", "s.x2", "s.y2", "e.x2", "e.y2")} < 0"""


def ring(read):
    lon = F.floor("lon")
    points = measured(read).groupBy(lon.alias("k")).agg(F.avg("lat").alias("lat")).select(F.lit(0).alias("rec"), "k", (F.col("k") + 0.03).alias("lon"), "lat")
    return contours.segments(points, "rec", ["k"], closed=True)


@query(f"""
    WITH {M}, {RING}, {EDGE}, p AS (SELECT user_id, lon AS x1, lat AS y1, lead(lon) OVER w AS lon2, lead(lat) OVER w AS y2 FROM m WINDOW w AS (PARTITION BY user_id ORDER BY t, id)),
    s AS (SELECT user_id, row_number() OVER () AS n, x1, y1, {SHORT("x1", "lon2")} AS x2, y2 FROM p WHERE lon2 IS NOT NULL)
    SELECT s.user_id, count(DISTINCT (s.n, e.k)) AS crossings FROM s JOIN edge e ON {APART} GROUP BY s.user_id""")
def boundary_crossings(read, spark):
    tracks = contours.segments(measured(read), "user_id", ["t", "id"])
    lines = tracks.withColumn("id", F.struct("rec", "segment"))
    found = contours.crossed(lines, ring(read))
    return found.groupBy(F.col("id.rec").alias("user_id")).agg(F.count("*").alias("crossings"))


CHANCE = lambda name: f"CAST('0x' || substr(md5('1:' || draw || ':{name}'), 1, 12) AS BIGINT)::DOUBLE / 281474976710656"


@query(f"""
    WITH {M}, {RING}, {EDGE}, d AS (SELECT draw, error, 360 * ({CHANCE("lon")}) AS x1, degrees(asin(2 * ({CHANCE("lat")}) - 1)) AS y1, 2 * pi() * ({CHANCE("angle")}) AS a FROM range(3001) r(draw), (VALUES (250.0::DOUBLE), (1000.0)) v(error)),
    d2 AS (SELECT *, y1 + error * sin(a) / (10000.0::DOUBLE / 90) AS y2 FROM d), s AS (SELECT *, x1 + error * cos(a) / (10000.0::DOUBLE / 90) / cos(pi() * (y1 + y2) / 360) AS x2 FROM d2),
    hit AS (SELECT DISTINCT error, draw FROM s JOIN edge e ON {APART}), r AS (SELECT error, draw, row_number() OVER (PARTITION BY error ORDER BY draw) AS n FROM hit),
    c AS (SELECT error, count(*) AS uncertain, max(draw) AS last FROM r WHERE n <= 301 GROUP BY error), t AS (SELECT v.error, coalesce(uncertain, 0) AS uncertain, CASE WHEN uncertain > 300 THEN last + 1 ELSE 3001 END AS total FROM (VALUES (250.0::DOUBLE), (1000.0)) v(error) LEFT JOIN c USING (error))
    SELECT error, uncertain, total, uncertain / total AS fraction FROM t""")
def uncertainty_fraction(read, spark):
    return contours.uncertainty_fraction(ring(read), [250.0, 1000.0], 300, 3000)


@query()
def ruler_walk(read, spark):
    """Users' tracks; tests/test_axes_contours_planes.py walks point by point."""
    return contours.ruler_walk(measured(read), "user_id", ["t", "id"], [250.0, 1000.0, 4000.0])


#: A tracer on even longitudes and latitudes: the mean value of the events in each box of ten degrees about a point, 0 where there are none.
TRACER = """g AS (SELECT i, j, coalesce(avg(q), 0) AS g FROM range(36) a(i) CROSS JOIN range(19) b(j) LEFT JOIN m ON floor(lon / 10) = i AND floor((lat + 90) / 10 + 0.5) = j GROUP BY i, j)"""
PLANES = Planes(25, 10_000.0)
STEP = "(20000.0::DOUBLE / 24)"
CELLS = f"""c0 AS (SELECT d, i, j, i * {STEP} - 10000 AS x, j * {STEP} - 10000 AS y FROM range(2) a(d), range(25) b(i), range(25) c(j)),
    c1 AS (SELECT *, row_number() OVER (ORDER BY d, j, i) - 1 AS cell, sqrt(x * x + y * y) AS r FROM c0 WHERE sqrt(x * x + y * y) <= {R} * pi() / 2 + {STEP} * sqrt(2)),
    c2 AS (SELECT cell, d, i, j, (CASE WHEN atan2(y, x) < 0 THEN degrees(atan2(y, x)) + 360 ELSE degrees(atan2(y, x)) END) / 10 AS u, ((2 * d - 1) * degrees(pi() / 2 - r / {R}) + 90) / 10 AS v FROM c1),
    c3 AS (SELECT *, least(floor(u), 35)::BIGINT AS lu, least(greatest(floor(v), 0), 17)::BIGINT AS lv FROM c2),
    packed AS (SELECT cell, d, c3.i, c3.j, sum(g * CASE WHEN a = 0 THEN 1 - (u - lu) ELSE u - lu END * CASE WHEN b = 0 THEN 1 - (v - lv) ELSE v - lv END) AS q
        FROM c3, (VALUES (0), (1)) x(a), (VALUES (0), (1)) y(b), g WHERE g.i = (lu + a) % 36 AND g.j = lv + b GROUP BY ALL)"""
AT = lambda places: f"""f AS (SELECT *, least(floor((x + 10000) / {STEP}), 23)::BIGINT AS lx, least(floor((y + 10000) / {STEP}), 23)::BIGINT AS ly FROM ({places})),
    h AS (SELECT *, (x + 10000) / {STEP} - lx AS fx, (y + 10000) / {STEP} - ly AS fy FROM f),
    o AS (SELECT h.id, sum(q * CASE WHEN a = 0 THEN 1 - fx ELSE fx END * CASE WHEN b = 0 THEN 1 - fy ELSE fy END) AS q FROM h, (VALUES (0), (1)) v(a), (VALUES (0), (1)) w(b), packed p WHERE p.d = h.d AND p.i = lx + a AND p.j = ly + b GROUP BY h.id)"""  # noqa: E731
PLACE = f"{R} * (pi() / 2 - radians((2 * d - 1) * la))"


def tracer(read, spark):
    m = measured(read).groupBy(F.floor(F.col("lon") / 10).alias("i"), F.floor((F.col("lat") + 90) / 10 + 0.5).alias("j")).agg(F.avg("q").alias("q"))
    grid = spark.range(36 * 19).select((F.col("id") % 36).alias("i"), F.floor(F.col("id") / 36).alias("j"))
    return grid.join(m, ["i", "j"], "left").select("i", "j", F.coalesce("q", F.lit(0.0)).alias("q"))


@query(f"WITH {M}, {TRACER} SELECT i AS i0, j AS i1, round(g, 9) AS v FROM g")
def grid_container(read, spark):
    """The tracer's grid written to a container in the session's shared folder, and read back by pages."""
    from ..operators.graph import saved
    from ..sources import container

    grid = saved(tracer(read, spark).select(F.col("i").alias("i0"), F.col("j").alias("i1"), F.col("q").alias("v")))
    path = f"{container.mounted(spark.sparkContext.getCheckpointDir())}/grid-{uuid.uuid4().hex}"
    container.write_container(spark, path, {"lon": [i * 10.0 for i in range(36)], "lat": [j * 10.0 - 90 for j in range(19)]}, {"q": (["lon", "lat"], grid)})
    return container.read_variable(spark, path, "q", page=4096).withColumn("v", F.round("v", 9))


@query(f"WITH {M}, {TRACER}, {CELLS} SELECT cell, round(q, 9) AS q FROM packed")
def packed_tracer(read, spark):
    return hemispheres.to_planes(tracer(read, spark), 36, 19, PLANES).withColumn("q", F.round("q", 9))


@query(f"""
    WITH {M}, {TRACER}, {CELLS}, {AT(f"SELECT id, d, {PLACE} * cos(radians(lon)) AS x, {PLACE} * sin(radians(lon)) AS y FROM (SELECT id, lon, lat + 0.05 AS la, (lat >= 0)::INTEGER AS d FROM m)")}
    SELECT id, round(q, 9) AS q FROM o""")
def packed_interpolation(read, spark):
    packed = hemispheres.to_planes(tracer(read, spark), 36, 19, PLANES)
    other = (F.col("id") % 2).cast("int")
    x, y = hemispheres.on_plane(other, F.col("lon"), F.col("lat") + 0.05)
    at = measured(read).select("id", other.alias("domain"), x.alias("x"), y.alias("y"))
    return hemispheres.interpolate(packed, at, PLANES).withColumn("q", F.round("q", 9))


@query(f"""
    WITH {M}, {TRACER}, {CELLS}, {AT(f"SELECT id, d, {PLACE} * cos(radians(lo)) AS x, {PLACE} * sin(radians(lo)) AS y FROM (SELECT n AS id, (n % 24) * 15 AS lo, (n // 24) * 15 - 90 AS la, (n // 24 >= 6)::INTEGER AS d FROM range(312) r(n))")}
    SELECT id % 24 AS i, id // 24 AS j, round(q, 9) AS q FROM o""")
def lonlat_from_packed(read, spark):
    packed = hemispheres.to_planes(tracer(read, spark), 36, 19, PLANES)
    return hemispheres.from_planes(packed, 24, 13, PLANES).withColumn("q", F.round("q", 9))


def wind(read, spark):
    """Mean values of the events by box and half of the time, as winds in km a day."""
    m = measured(read)
    half = m.agg(F.max("t").alias("_end"))
    box = m.crossJoin(F.broadcast(half)).groupBy(F.floor(F.col("lon") / 10).alias("i"), F.floor((F.col("lat") + 90) / 10 + 0.5).alias("j"), F.least(F.floor(2 * F.col("t") / F.col("_end")), F.lit(1)).alias("i2"))  # one row
    box = box.agg((F.avg("q") * 10).alias("u"), (F.avg(F.col("q") * F.sin(F.radians("lat"))) * 10).alias("v"))
    n = F.col("id")
    grid = spark.range(36 * 19 * 2).select((n % 36).alias("i"), (F.floor(n / 36) % 19).alias("j"), F.floor(n / (36 * 19)).alias("i2"))
    filled = grid.join(box, ["i", "j", "i2"], "left").select("i", "j", "i2", F.coalesce("u", F.lit(0.0)).alias("u"), F.coalesce("v", F.lit(0.0)).alias("v"))
    return hemispheres.wind_to_planes(filled, 36, 19, Planes(41, 11_000.0))


def users(read):
    places = measured(read).groupBy(F.col("user_id").alias("id")).agg(F.avg("lon").alias("lon"), F.avg("lat").alias("lat")).withColumn("domain", (F.col("lat") >= 0).cast("int"))
    x, y = hemispheres.on_plane(F.col("domain"), F.col("lon"), F.col("lat"))
    return places.select("id", "domain", x.alias("x"), y.alias("y"))


@query()
def wind_trajectories(read, spark):
    """Users' mean places, carried over both planes for two days; tests/test_axes_contours_planes.py has the rotation that is known exactly."""
    return hemispheres.trajectories(users(read), wind(read, spark), Planes(41, 11_000.0), (0.0, 2.0, 2), 0.0, 0.5, 4)


@query()
def wind_jacobian(read, spark):
    at = users(read).withColumn("t", F.lit(0.75))
    return hemispheres.jacobian(at, wind(read, spark), Planes(41, 11_000.0), (0.0, 2.0, 2))
