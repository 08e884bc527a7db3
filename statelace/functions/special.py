"""Distribution functions as NumPy code, and as Arrow functions for columns."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _log_beta(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    g = np.vectorize(math.lgamma, otypes=[float])
    return g(a) + g(b) - g(a + b)


def betainc(a, b, x, terms: int = 300) -> np.ndarray:
    """Regularised incomplete beta function, by its continued fraction (modified Lentz steps)."""
    a, b, x = np.broadcast_arrays(np.asarray(a, float), np.asarray(b, float), np.asarray(x, float))
    swap = x > (a + 1) / (a + b + 2)
    p, q, y = np.where(swap, b, a), np.where(swap, a, b), np.clip(np.where(swap, 1 - x, x), 0.0, 1.0)
    tiny = 1e-300
    with np.errstate(all="ignore"):
        front = np.exp(p * np.log(y) + q * np.log1p(-y) - _log_beta(np.where(p > 0, p, 1.0), np.where(q > 0, q, 1.0))) / p
        c, d = np.ones_like(y), 1 - (p + q) * y / (p + 1)
        d = 1 / np.where(np.abs(d) < tiny, tiny, d)
        h = d.copy()
        for m in range(1, terms):
            for num in (m * (q - m) * y / ((p + 2 * m - 1) * (p + 2 * m)), -(p + m) * (p + q + m) * y / ((p + 2 * m) * (p + 2 * m + 1))):
                d = 1 + num * d
                d = 1 / np.where(np.abs(d) < tiny, tiny, d)
                c = 1 + num / c
                c = np.where(np.abs(c) < tiny, tiny, c)
                h = h * d * c
        out = np.where(y <= 0, 0.0, front * h)
    return np.where(swap, 1 - out, out)


def t_sf2(t, df) -> np.ndarray:
    """Two-sided p of Student's t."""
    t, df = np.asarray(t, float), np.asarray(df, float)
    return betainc(df / 2, 0.5, df / (df + t * t))


def f_sf(f, d1, d2) -> np.ndarray:
    f = np.maximum(np.asarray(f, float), 0)
    return betainc(np.asarray(d2, float) / 2, np.asarray(d1, float) / 2, d2 / (d2 + d1 * f))


def normal_sf2(z) -> np.ndarray:
    return np.vectorize(lambda v: math.erfc(abs(v) / math.sqrt(2)), otypes=[float])(np.asarray(z, float))


def _gamma_tail(a: float, x: float) -> float:
    """Regularised upper incomplete gamma function: a series below a + 1, a continued fraction above."""
    if x <= 0 or a <= 0:
        return 1.0
    front = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        n = a
        while abs(term) > 1e-17 * abs(total):
            n += 1
            term *= x / n
            total += term
        return max(0.0, 1 - front * total)
    b = x + 1 - a
    c, d = 1e300, 1 / b
    h = d
    for i in range(1, 10_000):
        num = -i * (i - a)
        b += 2
        d = 1 / (num * d + b)
        c = b + num / c
        h *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return front * h


def chi2_sf(x, df) -> np.ndarray:
    return np.vectorize(lambda v, d: _gamma_tail(d / 2, v / 2), otypes=[float])(np.asarray(x, float), np.asarray(df, float))


def _root(f, low: float, high: float) -> float:
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if f(mid) > 0 else (low, mid)
    return (low + high) / 2


def t_quantile(p: float, df: float) -> float:
    """Upper quantile: P(T <= t) = p for p >= 0.5."""
    return _root(lambda t: float(t_sf2(t, df)) / 2 - (1 - p), 0.0, 1e6)


def f_quantile(p: float, d1: float, d2: float) -> float:
    return _root(lambda f: float(f_sf(f, d1, d2)) - (1 - p), 0.0, 1e7)


@F.pandas_udf(T.DoubleType())
def t_p(t: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series(np.where(t.isna() | df.isna() | (df <= 0), np.nan, t_sf2(t.fillna(0), df.fillna(1).clip(lower=1e-9))))


@F.pandas_udf(T.DoubleType())
def f_p(f: pd.Series, d1: pd.Series, d2: pd.Series) -> pd.Series:
    return pd.Series(np.where(f.isna(), np.nan, f_sf(f.fillna(0), d1.fillna(1), d2.fillna(1))))


@F.pandas_udf(T.DoubleType())
def chi2_p(x: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series(np.where(x.isna() | df.isna() | (df <= 0), np.nan, chi2_sf(x.fillna(0), df.fillna(1))))


def signed_rank_p(w: float, n: int) -> float:
    """Exact two-sided p of the smaller signed-rank sum of n values without ties or zeros: subsets of 1..n by their sum."""
    ways = np.zeros(n * (n + 1) // 2 + 1)
    ways[0] = 1.0
    for i in range(1, n + 1):
        ways[i:] = ways[i:] + ways[: len(ways) - i]
        ways /= 2
    return float(min(1.0, 2 * ways[: int(w) + 1].sum()))


@F.pandas_udf(T.DoubleType())
def normal_p(z: pd.Series) -> pd.Series:
    return pd.Series(np.where(z.isna(), np.nan, normal_sf2(z.fillna(0))))


@F.pandas_udf(T.DoubleType())
def t_upper(p: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series([t_quantile(a, b) if b and b > 0 else np.nan for a, b in zip(p, df)])
