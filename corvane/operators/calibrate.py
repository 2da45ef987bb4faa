"""Calibration of decision values: a polynomial of atanh(accuracy) in atanh(r), and logistic fits."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .evaluate import moving_accuracy


def polynomial_fit(df: DataFrame, x: str, y: str, order: int) -> np.ndarray:
    """Coefficients from the constant up; only sums of powers leave the executors."""
    powers = [F.sum(F.pow(F.col(x), F.lit(float(k)))).alias(f"s{k}") for k in range(2 * order + 1)]
    cross = [F.sum(F.col(y) * F.pow(F.col(x), F.lit(float(k)))).alias(f"t{k}") for k in range(order + 1)]
    s = df.agg(*powers, *cross).first()
    a = np.array([[s[f"s{i + j}"] for j in range(order + 1)] for i in range(order + 1)], dtype=float)
    return np.linalg.lstsq(a, np.array([s[f"t{k}"] for k in range(order + 1)], dtype=float), rcond=None)[0]


def calibrate(df: DataFrame, r: str, truth: str, key: str, width: int, order: int) -> DataFrame:
    """(key, r, calibrated): r through tanh of the polynomial that fits moving accuracies of `width` rows."""
    table = moving_accuracy(df, r, truth, width, key)
    inner = table.select("x", F.atanh(F.greatest(F.least(2 * F.col("acc") - 1, F.lit(0.999)), F.lit(-0.999))).alias("y"))
    c = polynomial_fit(inner, "x", "y", order)
    t = F.atanh(r)
    return df.select(key, r, F.tanh(sum((F.lit(float(v)) * F.pow(t, F.lit(float(k))) for k, v in enumerate(c)), F.lit(0.0))).alias("calibrated"))


def logistic_fit(df: DataFrame, x: str, truth: str, rounds: int = 25) -> tuple[float, float]:
    """(a, b) of P(1) = 1 / (1 + exp(-(a + b x))) by Newton steps, one aggregate each."""
    a = b = 0.0
    y = F.col(truth).cast("double")
    for _ in range(rounds):
        p = 1 / (1 + F.exp(-(a + b * F.col(x))))
        w = p * (1 - p)
        s = df.agg(F.sum(y - p), F.sum((y - p) * F.col(x)), F.sum(w), F.sum(w * F.col(x)), F.sum(w * F.col(x) * F.col(x))).first()
        step = np.linalg.lstsq(np.array([[s[2], s[3]], [s[3], s[4]]], dtype=float), np.array([s[0], s[1]], dtype=float), rcond=None)[0]
        a, b = a + float(step[0]), b + float(step[1])
        if np.abs(step).max() < 1e-9:
            break
    return a, b
