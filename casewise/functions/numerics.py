"""Special functions on numpy arrays, for the few values that SQL has no function for."""

from __future__ import annotations

import math

import numpy as np


def gamma_cdf(shape: float, x: float) -> float:
    """Regularised lower incomplete gamma: series below the mean, continued fraction above."""
    if x <= 0:
        return 0.0
    front = math.exp(shape * math.log(x) - x - math.lgamma(shape))
    if x < shape + 1:
        term = total = 1.0 / shape
        n = shape
        while term > total * 1e-16:
            n += 1
            term *= x / n
            total += term
        return min(1.0, front * total)
    b, c = x + 1 - shape, 1e300
    d = 1 / b
    h = d
    for i in range(1, 10_000):
        a = -i * (i - shape)
        b += 2
        d = 1 / (a * d + b or 1e-300)
        c = b + a / c or 1e-300
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return max(0.0, 1 - front * h)


def gamma_ppf(p: float, shape: float, rate: float = 1.0) -> float:
    """Quantile of Gamma(shape, rate) by bisection on the logarithm."""
    low, high = -745.0, math.log(shape + 40 * math.sqrt(shape) + 40)
    for _ in range(200):
        mid = (low + high) / 2
        if gamma_cdf(shape, math.exp(mid)) < p:
            low = mid
        else:
            high = mid
        if high - low < 1e-14 * max(1.0, abs(mid)):
            break
    return math.exp((low + high) / 2) / rate


def gamma_ppf_array(p, shape, rate) -> np.ndarray:
    p, shape, rate = np.broadcast_arrays(p, shape, rate)
    flat = [
        gamma_ppf(a, s, r) if s is not None and r is not None and s > 0 and r > 0 else float("nan")
        for a, s, r in zip(p.ravel(), shape.ravel(), rate.ravel())
    ]
    return np.array(flat).reshape(p.shape)


def normal_sf(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2))


def student_sf(t: float, df: float) -> float:
    """Upper tail of Student's t by the incomplete beta continued fraction."""
    if t < 0:
        return 1 - student_sf(-t, df)
    x = df / (df + t * t)
    return 0.5 * _beta_cdf(df / 2, 0.5, x)


def _beta_cdf(a: float, b: float, x: float) -> float:
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - _beta_cdf(b, a, 1 - x)
    front = math.exp(a * math.log(x) + b * math.log(1 - x) + math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)) / a
    c, d = 1.0, 1 / (1 - (a + b) * x / (a + 1) or 1e-300)
    h = d
    for m in range(1, 5_000):
        for up in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / (1 + up * d or 1e-300)
            c = 1 + up / c or 1e-300
            h *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return front * h
