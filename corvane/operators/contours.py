"""Contours on the globe: their segments, crossings with other lines, the uncertainty fraction, and ruler walks."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.geo import KM_DEGREE, RADIUS
from ..session import ship
from .graph import saved
from .order import positions


def numbered(points: DataFrame, rec: str, order: list[str]) -> DataFrame:
    """Points (rec, lon, lat) with their `position` over all contours in the order of rec, then of `order`; those without a contour or place are left out."""
    whole = points.where(F.col(rec).isNotNull()).where("lon is not null and lat is not null and not isnan(lon) and not isnan(lat)")
    return saved(positions(whole.select(F.col(rec).alias("rec"), *order, F.col("lon").cast("double").alias("lon"), F.col("lat").cast("double").alias("lat")), ["rec", *order]).select("rec", "position", "lon", "lat"))


def segments(points: DataFrame, rec: str, order: list[str], closed: bool = False) -> DataFrame:
    """(rec, segment, lon1, lat1, lon2, lat2): the lines' pieces from each point to the next, and with `closed` from the last to the first.

    Points are numbered by ranges and joined with the point one place on, so a contour of any length is spread over all tasks. A piece goes the
    short way round: lon1 is in 0 ... 360 and lon2 within 180 of it.
    """
    p = numbered(points, rec, order)
    after = p.select(F.col("rec").alias("_rec"), (F.col("position") - 1).alias("position"), F.col("lon").alias("lon2"), F.col("lat").alias("lat2"))
    out = p.join(after, "position").where(F.col("rec").eqNullSafe(F.col("_rec"))).select("rec", F.col("position").alias("segment"), F.col("lon").alias("lon1"), F.col("lat").alias("lat1"), "lon2", "lat2")
    if closed:
        place = F.struct("position", "lon", "lat")
        ends = p.groupBy("rec").agg(F.min(place).alias("a"), F.max(place).alias("b")).where("a.position < b.position")
        out = out.unionByName(ends.select("rec", F.col("b.position").alias("segment"), F.col("b.lon").alias("lon1"), F.col("b.lat").alias("lat1"), F.col("a.lon").alias("lon2"), F.col("a.lat").alias("lat2")))
    return short_way(out)


def short_way(lines: DataFrame) -> DataFrame:
    """Lines (lon1, lat1, lon2, lat2) with lon1 in 0 ... 360 and lon2 at most 180 from it."""
    start = F.pmod("lon1", F.lit(360.0))
    return lines.withColumn("_by", F.pmod(F.col("lon2") - F.col("lon1") + 180, F.lit(360.0)) - 180).withColumn("lon1", start).withColumn("lon2", F.col("lon1") + F.col("_by")).drop("_by")


def in_cells(lines: DataFrame, size: float) -> DataFrame:
    """Each line (lon1, lat1, lon2, lat2) once for every cell (cx, cy) of `size` degrees that it passes or touches: columns of longitude first, then the
    latitudes that it has within the column. Columns are counted round the globe; `shift` is what a turn adds."""
    a, b = F.least("lon1", "lon2"), F.greatest("lon1", "lon2")
    columns = F.explode(F.sequence(F.floor(a / size), F.floor(b / size)))
    out = lines.withColumn("_cx", columns)
    slope = F.coalesce(F.try_divide(F.col("lat2") - F.col("lat1"), F.col("lon2") - F.col("lon1")), F.lit(0.0))
    at = lambda lon: F.col("lat1") + slope * (F.least(F.greatest(lon, a), b) - F.col("lon1"))
    left, right = at(F.col("_cx") * size), at((F.col("_cx") + 1) * size)
    upright = F.col("lon1") == F.col("lon2")
    low = F.when(upright, F.least("lat1", "lat2")).otherwise(F.least(left, right)) - 1e-9
    high = F.when(upright, F.greatest("lat1", "lat2")).otherwise(F.greatest(left, right)) + 1e-9
    out = out.withColumn("cy", F.explode(F.sequence(F.floor(low / size), F.floor(high / size))))
    turn = round(360 / size)
    return out.withColumns({"cx": F.pmod("_cx", F.lit(turn)), "shift": F.floor(F.col("_cx") / turn) * 360.0}).drop("_cx")


def _side(ax: Column, ay: Column, bx: Column, by: Column, px: Column, py: Column) -> Column:
    return F.sign((bx - ax) * (py - ay) - (by - ay) * (px - ax))


#: Cells of a boundary's pieces up to which they are broadcast to the lines.
FEW_PIECES = 100_000


def crossed(lines: DataFrame, boundary: DataFrame, size: float = 5.0, few: int = FEW_PIECES) -> DataFrame:
    """(id, rec, segment): the pieces of `boundary` (rec, segment, lon1, ...) that lines (id, lon1, lat1, lon2, lat2) cross, each pair once.

    Both are dealt to the cells of a grid of `size` degrees (a whole number of them round the globe) along their course, and meet by cell; lines that only touch, or lie along
    a piece, don't cross it. Where the boundary's pieces have at most `few` cells, which are counted, they go to the lines, and only crossings are shuffled; else the
    lines are shuffled in the cells that the boundary has, whose number the grid bounds. Longitudes wrap at 360: both are moved to the same turn, and a line that doesn't go the short way round has to be cut before. A line with a null or NaN
    crosses nothing.
    """
    whole = " and ".join(f"{c} is not null and not isnan({c})" for c in ("lon1", "lat1", "lon2", "lat2"))
    a = in_cells(lines.where(whole).select("id", "lon1", "lat1", "lon2", "lat2"), size)
    b = in_cells(boundary.where(whole).select("rec", "segment", *(F.col(c).alias(f"b_{c}") for c in ("lon1", "lat1", "lon2", "lat2"))).withColumnsRenamed({f"b_{c}": c for c in ("lon1", "lat1", "lon2", "lat2")}), size)
    b = b.withColumnsRenamed({c: f"b_{c}" for c in ("lon1", "lat1", "lon2", "lat2", "shift")})
    if b.count() <= few:
        met = a.join(F.broadcast(b), ["cx", "cy"])
    else:
        met = a.join(F.broadcast(b.select("cx", "cy").distinct()), ["cx", "cy"], "left_semi").join(b, ["cx", "cy"])
    p = [F.col("lon1") - F.col("shift"), F.col("lat1"), F.col("lon2") - F.col("shift"), F.col("lat2")]
    q = [F.col("b_lon1") - F.col("b_shift"), F.col("b_lat1"), F.col("b_lon2") - F.col("b_shift"), F.col("b_lat2")]
    apart = (_side(*p, q[0], q[1]) * _side(*p, q[2], q[3]) < 0) & (_side(*q, p[0], p[1]) * _side(*q, p[2], p[3]) < 0)
    return met.where(apart).select("id", "rec", "segment").distinct()


def crossings(lines: DataFrame, boundary: DataFrame, size: float = 5.0) -> DataFrame:
    """(id, crossings) of all lines, zeros included."""
    n = crossed(lines, boundary, size).groupBy("id").agg(F.count("*").alias("crossings"))
    return lines.select("id").join(n, "id", "left").select("id", F.coalesce("crossings", F.lit(0).cast("long")).alias("crossings"))


def uniform(seed: int, *parts: Column) -> Column:
    """A number in 0 ... 1 that follows from its parts: 48 bits of their MD5."""
    text = F.concat_ws(":", F.lit(str(seed)), *(p.cast("string") for p in parts))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 12), 16, 10).cast("double") / float(1 << 48)


def probes(spark: SparkSession, errors: list[float], n: int, hemi: int = 0, seed: int = 1) -> DataFrame:
    """(id, error, draw, lon1, lat1, lon2, lat2): for each error n lines of so many km, from even places on the globe or a hemisphere (1, -1) in even directions."""
    rows = spark.range(n).select(F.col("id").alias("draw"), F.explode(F.array(*map(F.lit, map(float, errors)))).alias("error"))
    u = uniform(seed, F.col("draw"), F.lit("lat"))
    lat = F.degrees(F.asin(2 * u - 1 if hemi == 0 else hemi * u))
    rows = rows.withColumns({"lon1": 360 * uniform(seed, F.col("draw"), F.lit("lon")), "lat1": lat, "_a": 2 * math.pi * uniform(seed, F.col("draw"), F.lit("angle"))})
    rows = rows.withColumn("lat2", F.col("lat1") + F.col("error") * F.sin("_a") / KM_DEGREE)
    lon2 = F.col("lon1") + F.col("error") * F.cos("_a") / KM_DEGREE / F.cos(math.pi * (F.col("lat1") + F.col("lat2")) / 360)
    return rows.withColumn("lon2", lon2).select(F.struct("error", "draw").alias("id"), "error", "draw", "lon1", "lat1", "lon2", "lat2")


def uncertainty_fraction(boundary: DataFrame, errors: list[float], min_uncertain: int, max_total: int, hemi: int = 0, seed: int = 1, size: float = 5.0) -> DataFrame:
    """(error, uncertain, total, fraction): how often a place and another `error` km away lie on different sides of a piece of the boundary.

    Places are drawn until more than `min_uncertain` are uncertain or more than `max_total` drawn. All max_total + 1 draws are tried at once, and
    those after the last one needed don't count.
    """
    lines = saved(probes(boundary.sparkSession, errors, max_total + 1, hemi, seed))
    found = saved(crossed(lines, boundary, size).select("id").distinct().select("id.error", "id.draw"))
    from .order import k_per_group

    last = k_per_group(found, min_uncertain + 1, ["error"], ["draw"]).groupBy("error").agg(F.max("draw").alias("last"), F.count("*").alias("uncertain"))
    total = F.when(F.col("uncertain") > min_uncertain, F.col("last") + 1).otherwise(F.lit(max_total + 1))
    each = boundary.sparkSession.createDataFrame([(float(e),) for e in errors], "error double").join(last, "error", "left").withColumn("uncertain", F.coalesce("uncertain", F.lit(0).cast("long")))
    return each.select("error", "uncertain", total.cast("long").alias("total")).withColumn("fraction", F.col("uncertain") / F.col("total"))


def dimension(sizes: DataFrame, x: str, y: str) -> DataFrame:
    """(slope): the slope of log y on log x over the rows where both are above 0; a boundary's dimension is 2 less the uncertainty fraction's, or minus that of ruler steps."""
    return sizes.where(f"{x} > 0 and {y} > 0").agg(F.regr_slope(F.log(F.col(y).cast("double")), F.log(F.col(x).cast("double"))).alias("slope"))


def _vectors(lon: np.ndarray, lat: np.ndarray) -> np.ndarray:
    a, b = np.radians(lon), np.radians(lat)
    return np.stack([np.cos(b) * np.cos(a), np.cos(b) * np.sin(a), np.sin(b)], axis=-1)


def _km(u: np.ndarray, v: np.ndarray) -> np.ndarray:
    return 2 * RADIUS * np.arcsin(np.minimum(np.sqrt(((u - v) ** 2).sum(axis=-1)) / 2, 1))


def stride(x: np.ndarray, state: dict, ruler: float, once: bool = False, start: bool = False, look: int = 64) -> None:
    """Walks a ruler on over the points x, unit vectors, that follow those walked before.

    The state has `at`, where the ruler stands; `before`, the last point seen; `d`, its distance from there; and `steps`. Where a point is a ruler's
    length or more away, the ruler is put down between it and the point before, by proportion of distances, and as often again as it fits in
    the rest of that piece. With `once` the walk is done at the first such point, and has one step more if that is the contour's first (`start`).
    """
    i = 0
    if state["at"] is None and len(x):
        state["at"], state["before"], state["d"], i = x[0], x[0], 0.0, 1
    while i < len(x):
        near = _km(state["at"], x[i : i + look])
        far = np.flatnonzero(near >= ruler)
        if not len(far):
            i += len(near)
            state["before"], state["d"] = x[i - 1], float(near[-1])
            continue
        j = int(far[0])
        if j:
            state["before"], state["d"] = x[i + j - 1], float(near[j - 1])
        i += j
        piece = float(_km(state["before"], x[i]))
        share = (ruler - state["d"]) / (float(near[j]) - state["d"])
        more = int(piece * (1 - share) / ruler)
        share += ruler * more / piece
        state["steps"] += more + 1
        if once:
            state["done"], state["steps"] = True, state["steps"] + int(start and i == 0)
            return
        at = state["before"] + share * (x[i] - state["before"])
        state["at"], state["before"], state["d"] = at / np.sqrt((at * at).sum()), x[i], piece * (1 - share)
        i += 1


def strides(x: np.ndarray, i: np.ndarray, end: np.ndarray, state: dict[str, np.ndarray], ruler: np.ndarray, few: int = 8) -> None:
    """Walks many rulers on at once, each over the points x[i:end] as stride() does, point by point; where at most `few` are not at their end, these go on one by one.

    The state has an array of each of stride()'s entries, a row for each ruler; NaN in `at` where none has been put down."""
    at, before, d, steps = (state[c] for c in ("at", "before", "d", "steps"))
    new = np.flatnonzero(np.isnan(at[:, 0]) & (i < end))
    at[new] = before[new] = x[i[new]]
    i = i.copy()
    i[new] += 1
    on = np.flatnonzero(i < end)
    while len(on) > few:
        here = x[i[on]]
        near = _km(at[on], here)
        far = near >= ruler[on]
        go, there = on[far], here[far]
        piece = _km(before[go], there)
        share = (ruler[go] - d[go]) / (near[far] - d[go])
        more = (piece * (1 - share) / ruler[go]).astype(np.int64)
        share += ruler[go] * more / piece
        steps[go] += more + 1
        to = before[go] + share[:, None] * (there - before[go])
        at[go] = to / np.sqrt((to * to).sum(axis=1))[:, None]
        before[on], d[on] = here, near
        d[go] = piece * (1 - share)
        i[on] += 1
        on = on[i[on] < end[on]]
    for k in on:
        s = {"at": at[k].copy(), "before": before[k].copy(), "d": d[k], "steps": int(steps[k])}
        stride(x[i[k] : end[k]], s, ruler[k])
        at[k], before[k], d[k], steps[k] = s["at"], s["before"], s["d"], s["steps"]


STATE = "at array<double>, before array<double>, d double, steps long, done boolean"


def ruler_walk(points: DataFrame, rec: str, order: list[str], rulers: list[float], closed: bool = False, rows: int = 100_000) -> DataFrame:
    """(rec, ruler, steps): how many steps a ruler of so many km makes along each contour, which doesn't depend on how densely its points lie.

    A walk's next step depends on the one before, so a contour is cut in ranges of `rows` points, and each round walks one range of every contour
    for all rulers, from the state that the round before left. Contours that begin within the same `rows` points of all are walked together (see strides): no task has
    more than two ranges' points, and there are as many rounds as the longest
    contour has ranges. With `closed` the walk goes on from the first point until one more step is made. The state is saved between rounds.
    A contour of one point has no steps; points without a contour or place are left out.
    """
    spark = ship(points.sparkSession)
    p = numbered(points, rec, order)
    first = p.groupBy("rec").agg(F.min("position").alias("first"), F.count("*").alias("n"))
    together = F.floor(F.col("first") / rows).alias("part")
    chunks = saved(_with_first(p, first).select("rec", "position", F.floor((F.col("position") - F.col("first")) / rows).alias("chunk"), together, "lon", "lat"))
    states = first.select("rec", "n", together, F.explode(F.array(*map(F.lit, map(float, rulers)))).alias("ruler"))
    kind = p.schema["rec"].dataType.simpleString()
    schema = f"rec {kind}, n long, part long, ruler double, {STATE}"
    state = saved(states.selectExpr("rec", "n", "part", "ruler", "cast(null AS array<double>) AS at", "cast(null AS array<double>) AS before", "0D AS d", "0L AS steps", "false AS done"))

    def walk(once: bool, start: bool):
        def over(some: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
            some = some.sort_values("position")
            x = _vectors(some["lon"].to_numpy(), some["lat"].to_numpy())
            # a contour's points have places one after the other
            number, names = pd.factorize(some["rec"])
            own = pd.Index(names).get_indexer(held["rec"])
            i, end = (np.searchsorted(number, own, side) for side in ("left", "right"))
            nowhere = [math.nan] * 3
            s = {c: np.array([nowhere if v is None else v for v in held[c]], dtype=float).reshape(-1, 3) for c in ("at", "before")}
            s |= {c: held[c].to_numpy().copy() for c in ("d", "steps", "done")}
            if not once:
                strides(x, i, end, s, held["ruler"].to_numpy())
            for k, ruler in enumerate(held["ruler"]) if once else ():
                one = {"at": s["at"][k], "before": s["before"][k], "d": s["d"][k], "steps": int(s["steps"][k]), "done": False}
                stride(x[i[k] : end[k]], one, ruler, once, start)
                for c in s:
                    s[c][k] = one[c]
            return held[["rec", "n", "part", "ruler"]].assign(**{c: pd.Series(list(v), index=held.index, dtype=object if v.ndim > 1 else v.dtype) for c, v in s.items()})

        return over

    longest = first.agg(F.max("n")).first()[0] or 0
    for once in (False, True) if closed else (False,):
        for k in range(-(-longest // rows)):
            going = (F.col("n") > k * rows) & ~F.col("done")
            now = chunks.where(F.col("chunk") == k).groupBy("part").cogroup(state.where(going).groupBy("part")).applyInPandas(walk(once, k == 0), schema)
            state = saved(state.where(~going).unionByName(now))
            if once and state.where("not done").isEmpty():
                break
    return state.select("rec", "ruler", "steps")


def _with_first(p: DataFrame, first: DataFrame, large: int = 1_000_000, most: int = 10_000) -> DataFrame:
    """Points with their contour's first position: contours of over `large` points, of which the points allow `most` at most without more rows to each, by broadcast, others by shuffle."""
    limit = max(large, p.count() // most)
    big, small = first.where(F.col("n") > limit), first.where(F.col("n") <= limit)
    met = p.join(F.broadcast(big.select("rec", "first")), "rec", "left")
    return met.where("first is not null").unionByName(met.where("first is null").drop("first").join(small.select("rec", "first"), "rec").select(*met.columns))
