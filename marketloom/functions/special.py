"""Distribution functions without scipy: normal, Student t, chi square."""

from __future__ import annotations

import math

import numpy as np

_erf = np.vectorize(math.erf, otypes=[float])
_lgamma = np.vectorize(math.lgamma, otypes=[float])


def normal_cdf(x):
    return 0.5 * (1 + _erf(np.asarray(x, float) / math.sqrt(2)))


def incomplete_beta(a: float, b: float, x: np.ndarray, steps: int = 300) -> np.ndarray:
    """Regularised incomplete beta function by its continued fraction (Lentz)."""
    x = np.asarray(x, float)
    swap = x > (a + 1) / (a + b + 2)
    p, q, z = np.where(swap, b, a), np.where(swap, a, b), np.where(swap, 1 - x, x)
    with np.errstate(all="ignore"):
        front = np.exp(_lgamma(p + q) - _lgamma(p) - _lgamma(q) + p * np.log(z) + q * np.log1p(-z)) / p
        tiny = 1e-300
        c, d = np.ones_like(z), 1 - (p + q) * z / (p + 1)
        d = 1 / np.where(np.abs(d) < tiny, tiny, d)
        f = d.copy()
        for m in range(1, steps):
            for num in (m * (q - m) * z / ((p + 2 * m - 1) * (p + 2 * m)), -(p + m) * (p + q + m) * z / ((p + 2 * m) * (p + 2 * m + 1))):
                d = 1 + num * d
                d = 1 / np.where(np.abs(d) < tiny, tiny, d)
                c = 1 + num / c
                c = np.where(np.abs(c) < tiny, tiny, c)
                f = f * c * d
    out = np.where(z <= 0, 0.0, front * f)
    return np.clip(np.where(swap, 1 - out, out), 0, 1)


def t_cdf(x, nu: float):
    x = np.asarray(x, float)
    tail = 0.5 * incomplete_beta(nu / 2, 0.5, nu / (nu + x * x))
    return np.where(x > 0, 1 - tail, tail)


def t_quantile(p: float, nu: float) -> float:
    low, high = -1e3, 1e3
    for _ in range(200):
        mid = (low + high) / 2
        if float(t_cdf(mid, nu)) < p:
            low = mid
        else:
            high = mid
    return (low + high) / 2


def t_pdf(x, nu: float):
    c = math.lgamma((nu + 1) / 2) - math.lgamma(nu / 2) - 0.5 * math.log(nu * math.pi)
    return np.exp(c - (nu + 1) / 2 * np.log1p(np.asarray(x, float) ** 2 / nu))


def chi2_tail(x, k: int):
    """P(X > x) for an integer number of degrees of freedom."""
    x = np.asarray(x, float)
    if k % 2 == 0:
        term, total = np.ones_like(x), np.ones_like(x)
        for i in range(1, k // 2):
            term = term * (x / 2) / i
            total = total + term
        return np.exp(-x / 2) * total
    out = 1 - _erf(np.sqrt(x / 2))
    term = np.sqrt(2 * x / math.pi) * np.exp(-x / 2)
    for i in range(1, (k + 1) // 2):
        out = out + term
        term = term * x / (2 * i + 1)
    return out
