"""Small numeric solvers in numpy, for use inside Arrow functions and on the driver."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np


def erfinv(y: np.ndarray) -> np.ndarray:
    """The inverse of erf: a start from its asymptote, then Newton steps."""
    y = np.asarray(y, dtype=float)
    a = 8 * (math.pi - 3) / (3 * math.pi * (4 - math.pi))
    log = np.log1p(-np.clip(y * y, 0, 1 - 1e-16))
    b = 2 / (math.pi * a) + log / 2
    x = np.sign(y) * np.sqrt(np.sqrt(b * b - log / a) - b)
    erf = np.vectorize(math.erf)
    for _ in range(4):
        x = x - (erf(x) - y) * math.sqrt(math.pi) / 2 * np.exp(np.minimum(x * x, 700))
    return np.where(np.abs(y) == 1, np.sign(y) * np.inf, x)


def false_position(f: Callable[[float], float], a: float, b: float, tolerance: float = 1e-12, most: int = 200) -> float:
    """A root between a and b, where f has different signs; the end that stays is halved (Illinois)."""
    fa, fb = f(a), f(b)
    if fa * fb > 0:
        raise ValueError("no root is bracketed")
    for _ in range(most):
        c = b - fb * (b - a) / (fb - fa) if fb != fa else (a + b) / 2
        fc = f(c)
        if fc * fb < 0:
            a, fa = b, fb
        else:
            fa /= 2
        b, fb = c, fc
        if abs(fb) < tolerance or abs(b - a) < tolerance:
            break
    return b


def golden(f: Callable[[float], float], a: float, b: float, tolerance: float = 1e-10) -> float:
    """The minimum of f between a and b by golden section."""
    g = (math.sqrt(5) - 1) / 2
    c, d = b - g * (b - a), a + g * (b - a)
    fc, fd = f(c), f(d)
    while b - a > tolerance:
        if fc < fd:
            b, d, fd = d, c, fc
            c = b - g * (b - a)
            fc = f(c)
        else:
            a, c, fc = c, d, fd
            d = a + g * (b - a)
            fd = f(d)
    return (a + b) / 2


def runge_kutta(f: Callable[[float, np.ndarray], np.ndarray], t: float, x: np.ndarray, step: float, n: int) -> np.ndarray:
    """n steps of the fourth-order method; returns all n + 1 states."""
    out = [np.asarray(x, dtype=float)]
    for _ in range(n):
        x = out[-1]
        a = f(t, x)
        b = f(t + step / 2, x + step / 2 * a)
        c = f(t + step / 2, x + step / 2 * b)
        d = f(t + step, x + step * c)
        out.append(x + step / 6 * (a + 2 * b + 2 * c + d))
        t += step
    return np.array(out)


def linear_ode(a: np.ndarray, x: np.ndarray, times: np.ndarray) -> np.ndarray:
    """Solutions of x' = A x from the eigenvalues of A."""
    w, v = np.linalg.eig(a)
    c = np.linalg.solve(v, x.astype(complex))
    return (v @ (np.exp(np.outer(w, times)) * c[:, None])).real.T


def nnls(a: np.ndarray, b: np.ndarray, most: int | None = None) -> np.ndarray:
    """Least squares with x >= 0: variables enter one by one by gradient, and leave where they would turn negative."""
    n = a.shape[1]
    x, free = np.zeros(n), np.zeros(n, dtype=bool)
    for _ in range(most or 3 * n + 10):
        w = a.T @ (b - a @ x)
        if free.all() or w[~free].max(initial=-np.inf) <= 1e-10:
            break
        free[np.flatnonzero(~free)[np.argmax(w[~free])]] = True
        while True:
            s = np.zeros(n)
            s[free] = np.linalg.lstsq(a[:, free], b, rcond=None)[0]
            if s[free].min(initial=1) > 0:
                break
            down = free & (s <= 0)
            step = np.min(x[down] / np.maximum(x[down] - s[down], 1e-300))
            x += step * (s - x)
            free &= x > 1e-14
            x[~free] = 0
        x = s
    return x


def constrained_least_squares(a: np.ndarray, b: np.ndarray, g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Least squares under G x >= h, for A of full column rank, as a least-distance problem solved by nnls."""
    q, r = np.linalg.qr(a)
    inverse = np.linalg.inv(r)
    center = q.T @ b
    g2 = g @ inverse
    h2 = h - g2 @ center
    e = np.vstack([g2.T, h2])
    f = np.zeros(len(e))
    f[-1] = 1
    u = nnls(e, f)
    rest = e @ u - f
    if abs(rest[-1]) < 1e-12:
        raise ValueError("the constraints leave nothing")
    return inverse @ (-rest[:-1] / rest[-1] + center)
