"""Distribution functions in NumPy, and as pandas UDFs where a column needs them."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_lgamma = np.vectorize(math.lgamma, otypes=[float])
_erfc = np.vectorize(math.erfc, otypes=[float])


def normal_cdf(x: np.ndarray) -> np.ndarray:
    return 0.5 * _erfc(-np.asarray(x, dtype=float) / math.sqrt(2.0))


def normal_pdf(x: np.ndarray) -> np.ndarray:
    return np.exp(-0.5 * np.asarray(x, dtype=float) ** 2) / math.sqrt(2 * math.pi)


def beta_inc(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Regularised incomplete beta function, by its continued fraction (modified Lentz)."""
    a, b, x = np.broadcast_arrays(*(np.asarray(v, dtype=float) for v in (a, b, x)))
    out = np.full(x.shape, np.nan)
    fine = (a > 0) & (b > 0) & (x >= 0) & (x <= 1)
    out[fine & (x == 0)], out[fine & (x == 1)] = 0.0, 1.0
    inner = fine & (x > 0) & (x < 1)
    if not inner.any():
        return out
    a, b, x = a[inner], b[inner], x[inner]
    swap = x > (a + 1) / (a + b + 2)
    p, q, y = np.where(swap, b, a), np.where(swap, a, b), np.where(swap, 1 - x, x)
    front = np.exp(_lgamma(p + q) - _lgamma(p) - _lgamma(q) + p * np.log(y) + q * np.log1p(-y)) / p
    tiny = 1e-300
    c, d = np.ones_like(y), 1 - (p + q) * y / (p + 1)
    d = 1 / np.where(np.abs(d) < tiny, tiny, d)
    h = d.copy()
    for m in range(1, 500):
        for top in (m * (q - m) * y / ((p + 2 * m - 1) * (p + 2 * m)), -(p + m) * (p + q + m) * y / ((p + 2 * m) * (p + 2 * m + 1))):
            d = 1 + top * d
            d = 1 / np.where(np.abs(d) < tiny, tiny, d)
            c = 1 + top / c
            c = np.where(np.abs(c) < tiny, tiny, c)
            h = h * d * c
        if np.all(np.abs(d * c - 1) < 1e-14):
            break
    value = front * h
    out[inner] = np.where(swap, 1 - value, value)
    return out


def gamma_inc(a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Regularised lower incomplete gamma function."""
    a, x = np.broadcast_arrays(np.asarray(a, dtype=float), np.asarray(x, dtype=float))
    out = np.full(x.shape, np.nan)
    out[(a > 0) & (x == 0)] = 0.0
    ok = (a > 0) & (x > 0) & np.isfinite(x)
    out[(a > 0) & np.isposinf(x)] = 1.0
    series = ok & (x < a + 1)
    if series.any():
        p, y = a[series], x[series]
        term = total = 1 / p
        for n in range(1, 2000):
            term = term * y / (p + n)
            total = total + term
            if np.all(term < total * 1e-16):
                break
        out[series] = total * np.exp(-y + p * np.log(y) - _lgamma(p))
    rest = ok & ~series
    if rest.any():
        p, y = a[rest], x[rest]
        b = y + 1 - p
        c, d = np.full_like(y, 1e300), 1 / b
        h = d.copy()
        for n in range(1, 2000):
            top = -n * (n - p)
            b = b + 2
            d = 1 / (top * d + b)
            c = b + top / c
            h = h * d * c
            if np.all(np.abs(d * c - 1) < 1e-15):
                break
        out[rest] = 1 - np.exp(-y + p * np.log(y) - _lgamma(p)) * h
    return out


def t_cdf(t: np.ndarray, dof: np.ndarray) -> np.ndarray:
    t, dof = np.asarray(t, dtype=float), np.asarray(dof, dtype=float)
    tail = 0.5 * beta_inc(dof / 2, 0.5, dof / (dof + t * t))
    return np.where(t > 0, 1 - tail, tail)


def f_sf(f: np.ndarray, d1: np.ndarray, d2: np.ndarray) -> np.ndarray:
    f, d1, d2 = (np.asarray(v, dtype=float) for v in (f, d1, d2))
    return np.where(f > 0, beta_inc(d2 / 2, d1 / 2, d2 / (d2 + d1 * np.maximum(f, 0))), 1.0)


def chi2_sf(x: np.ndarray, dof: np.ndarray) -> np.ndarray:
    return 1 - gamma_inc(np.asarray(dof, dtype=float) / 2, np.maximum(np.asarray(x, dtype=float), 0) / 2)


def gamma_sf(x: np.ndarray, shape: np.ndarray, scale: np.ndarray) -> np.ndarray:
    return 1 - gamma_inc(shape, np.asarray(x, dtype=float) / scale)


def _inverse(cdf: Callable[[float], float], p: float, lo: float, hi: float) -> float:
    while cdf(lo) > p:
        lo *= 2
    while cdf(hi) < p:
        hi *= 2
    for _ in range(200):
        mid = 0.5 * (lo + hi)
        if cdf(mid) < p:
            lo = mid
        else:
            hi = mid
        if hi - lo <= 1e-13 * max(1.0, abs(mid)):
            break
    return 0.5 * (lo + hi)


def t_ppf(p: float, dof: float) -> float:
    return 0.0 if p == 0.5 else _inverse(lambda x: float(t_cdf(np.array([x]), np.array([dof]))[0]), p, -1.0, 1.0)


def normal_ppf(p: float) -> float:
    return 0.0 if p == 0.5 else _inverse(lambda x: float(normal_cdf(np.array([x]))[0]), p, -1.0, 1.0)


def digamma(x: float) -> float:
    out = 0.0
    while x < 12:
        out -= 1 / x
        x += 1
    y = 1 / (x * x)
    return out + math.log(x) - 0.5 / x - y * (1 / 12 - y * (1 / 120 - y * (1 / 252 - y * (1 / 240 - y / 132))))


def trigamma(x: float) -> float:
    out = 0.0
    while x < 12:
        out += 1 / (x * x)
        x += 1
    y = 1 / (x * x)
    return out + 1 / x + y / 2 + y / x * (1 / 6 - y * (1 / 30 - y * (1 / 42 - y / 30)))


def gamma_shape(mean: float, mean_log: float) -> float:
    """Maximum-likelihood shape of a gamma distribution from its two sufficient means."""
    s = math.log(mean) - mean_log
    if s <= 0:
        return math.inf
    k = (3 - s + math.sqrt((s - 3) ** 2 + 24 * s)) / (12 * s)
    for _ in range(50):
        step = (math.log(k) - digamma(k) - s) / (1 / k - trigamma(k))
        k = max(k - step, k / 10)
        if abs(step) < 1e-12 * k:
            break
    return k


def _column(f: Callable[..., np.ndarray], *args: Column) -> Column:
    @F.pandas_udf("double")
    def run(*columns: pd.Series) -> pd.Series:
        return pd.Series(f(*[c.to_numpy(dtype=float, na_value=np.nan) for c in columns])).replace([np.inf, -np.inf], np.nan)

    out = run(*[a.cast("double") for a in args])
    return F.when(F.isnan(out), None).otherwise(out)


def t_two_sided(t: Column, dof: Column) -> Column:
    return _column(lambda x, d: 2 * t_cdf(-np.abs(x), d), t, dof)


def normal_two_sided(z: Column) -> Column:
    return _column(lambda x: 2 * normal_cdf(-np.abs(x)), z)


def f_tail(f: Column, d1: Column, d2: Column) -> Column:
    return _column(f_sf, f, d1, d2)


def chi2_tail(x: Column, dof: Column) -> Column:
    return _column(chi2_sf, x, dof)


def gamma_tail(x: Column, shape: Column, scale: Column) -> Column:
    return _column(gamma_sf, x, shape, scale)
