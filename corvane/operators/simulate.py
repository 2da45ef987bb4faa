"""Trajectories, transport maps, contour advection and random walks, with velocity fields given as Python functions."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numeric import runge_kutta
from ..session import ship
from .matrix import apply

Field = Callable[[float, np.ndarray], np.ndarray]


def rotation(t: float, x: np.ndarray) -> np.ndarray:
    """A vortex about the origin that weakens outwards; x is (2, n)."""
    return np.stack([-x[1], x[0]]) / (1 + (x * x).sum(axis=0))


def trajectories(start: DataFrame, field: Field, t: float, step: float, n: int) -> DataFrame:
    """(id, step, x, y) of particles (id, x, y); all particles of a batch move together."""
    ship(start.sparkSession)
    kind = start.schema["id"].dataType.simpleString()

    def run(batches):
        for b in batches:
            path = runge_kutta(field, t, np.stack([b["x"], b["y"]]).astype(float), step, n)
            yield pd.DataFrame({"id": np.tile(b["id"], n + 1), "step": np.repeat(np.arange(n + 1), len(b)), "x": path[:, 0].ravel(), "y": path[:, 1].ravel()})

    return start.mapInPandas(run, f"id {kind}, step int, x double, y double")


def transport_map(spark: SparkSession, field: Field, n: int, step: float, steps: int, substeps: int = 4) -> DataFrame:
    """(k, i, j, w): for each step, the cells and weights at which each cell of an n by n grid over [-1, 1] was a step before.

    Steps are independent: each cell and step is traced back on its own, then steps are applied in order (advance).
    """
    ship(spark)
    size = 2 / (n - 1)

    def run(batches):
        for b in batches:
            i, k = b["id"].to_numpy() % (n * n), b["id"].to_numpy() // (n * n)
            out = []
            for s in np.unique(k):
                cell = i[k == s]
                x = np.stack([cell % n, cell // n]) * size - 1
                back = runge_kutta(field, float((s + 1) * step), x, -step / substeps, substeps)[-1]
                at = np.clip((back + 1) / size, 0, n - 1)
                low = np.minimum(at.astype(int), n - 2)
                part = at - low
                for dx in (0, 1):
                    for dy in (0, 1):
                        w = np.where(dx, part[0], 1 - part[0]) * np.where(dy, part[1], 1 - part[1])
                        out.append(pd.DataFrame({"k": s, "i": cell, "j": low[0] + dx + n * (low[1] + dy), "w": w}))
            yield pd.concat(out) if out else pd.DataFrame({c: [] for c in "kijw"})

    return spark.range(n * n * steps).mapInPandas(run, "k long, i long, j long, w double").where("w <> 0")


def advance(maps: DataFrame, q: DataFrame, steps: int) -> DataFrame:
    """(k, i, v): a tracer (i, v) after each step's map."""
    maps, out = maps.persist(), None
    for k in range(steps):
        q = apply(maps.where(F.col("k") == k).select("i", "j", F.col("w").alias("v")), q)
        one = q.withColumn("k", F.lit(k))
        out = one if out is None else out.unionByName(one)
    return out


def advect_contours(points: DataFrame, field: Field, t: float, step: float, n: int, least: float, most: float) -> DataFrame:
    """(rec, seq, x, y) of closed contours after n steps, each contour in one task: points are added where neighbours
    are more than `most` apart and taken out where they are nearer than `least`."""
    ship(points.sparkSession)

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("seq")
        x = np.stack([frame["x"], frame["y"]]).astype(float)
        for k in range(n):
            x = runge_kutta(field, t + k * step, x, step, 1)[-1]
            gap = np.hypot(*(np.roll(x, -1, axis=1) - x))
            keep = gap >= least
            if keep.sum() > 3:
                x = x[:, keep]
            gap = np.hypot(*(np.roll(x, -1, axis=1) - x))
            wide = np.flatnonzero(gap > most)
            middle = (x[:, wide] + np.roll(x, -1, axis=1)[:, wide]) / 2
            x = np.insert(x, wide + 1, middle, axis=1)
        return pd.DataFrame({"rec": frame["rec"].iloc[0], "seq": np.arange(x.shape[1]), "x": x[0], "y": x[1]})

    return points.groupBy("rec").applyInPandas(run, "rec int, seq long, x double, y double")


def metropolis(spark: SparkSession, chains: int, length: int, seed: int, density: Callable | None = None, scale: float = 1.0) -> DataFrame:
    """(chain, step, x): random walks whose steps are taken if a uniform number is at most p_new / p_old; one chain a row."""
    ship(spark)
    density = density or (lambda x: np.exp(-x * x / 2))

    def run(batches):
        for b in batches:
            out = []
            for chain in b["id"]:
                rng, x, path = np.random.default_rng([seed, int(chain)]), 0.0, []
                for _ in range(length):
                    y = x + rng.normal(0, scale)
                    x = y if rng.random() * density(x) <= density(y) else x
                    path.append(x)
                out.append(pd.DataFrame({"chain": chain, "step": np.arange(length), "x": path}))
            yield pd.concat(out) if out else pd.DataFrame({"chain": [], "step": [], "x": []})

    return spark.range(chains).mapInPandas(run, "chain long, step int, x double")


def strain(start: DataFrame, field: Field, t: float, step: float, n: int, eps: float = 1e-6) -> DataFrame:
    """(id, h11, h12, h21, h22, growth): the displacement gradient along each path and its largest singular value."""
    ship(start.sparkSession)
    kind = start.schema["id"].dataType.simpleString()

    def run(batches):
        for b in batches:
            x = np.stack([b["x"], b["y"]]).astype(float)
            ends = [runge_kutta(field, t, x + eps * np.array(d)[:, None], step, n)[-1] for d in ((1, 0), (-1, 0), (0, 1), (0, -1))]
            h = np.stack([(ends[0] - ends[1]) / (2 * eps), (ends[2] - ends[3]) / (2 * eps)], axis=1)
            growth = np.linalg.svd(h.transpose(2, 0, 1), compute_uv=False)[:, 0]
            yield pd.DataFrame({"id": b["id"], "h11": h[0, 0], "h12": h[0, 1], "h21": h[1, 0], "h22": h[1, 1], "growth": growth})

    return start.mapInPandas(run, f"id {kind}, h11 double, h12 double, h21 double, h22 double, growth double")


def component_proxy(maps: DataFrame, n: int, k: int, samples: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """A field rebuilt from samples (i, q) as a mix of the k leading singular vectors of a transport matrix (i, j, v), for small grids."""
    from .matrix import singular

    u, _, _ = singular(maps, n, n, k)
    rows = samples.groupBy("i").agg(F.avg("q").alias("q")).collect()
    at, q = [r["i"] for r in rows], np.array([r["q"] for r in rows])
    c = np.linalg.lstsq(u[at], q, rcond=None)[0]
    return u @ c, c
