"""Special functions as Arrow-vectorised column functions."""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

_NORMAL = NormalDist()


@F.pandas_udf(DoubleType())
def norm_ppf(p: pd.Series) -> pd.Series:
    """The normal quantile; null outside of (0, 1)."""
    return p.map(lambda x: _NORMAL.inv_cdf(x) if 0 < x < 1 else None)


@F.pandas_udf(DoubleType())
def norm_cdf(x: pd.Series) -> pd.Series:
    return x.map(lambda v: None if pd.isna(v) else 0.5 * math.erfc(-v / math.sqrt(2)))


def _lgamma(x: np.ndarray) -> np.ndarray:
    """ln gamma; degrees of freedom and counts repeat, so each different value is taken once."""
    values, at = np.unique(x, return_inverse=True)
    return np.array([math.lgamma(v) for v in values])[at].reshape(x.shape)


_TINY = 1e-300


def _apart(x: np.ndarray) -> np.ndarray:
    return np.where(x == 0, _TINY, x)


def gamma_tail(a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The upper regularised incomplete gamma function, a > 0: a series below a + 1, a continued fraction above."""
    a, x = np.broadcast_arrays(np.asarray(a, float), np.asarray(x, float))
    out = np.where(np.isnan(a) | np.isnan(x), np.nan, np.where(x <= 0, 1.0, 0.0))
    for low in (True, False):
        at = np.flatnonzero((x > 0) & np.isfinite(x) & ((x < a + 1) == low))
        if not len(at):
            continue
        k, v = a[at], x[at]
        front = np.exp(-v + k * np.log(v) - _lgamma(k))
        if low:
            term = total = 1 / k
            step = k.copy()
            while True:
                step = step + 1
                term = term * v / step
                total = total + term
                if (np.abs(term) <= np.abs(total) * 1e-16).all():
                    break
            out[at] = 1 - total * front
        else:
            b = v + 1 - k
            c, d = np.full(len(at), 1 / _TINY), 1 / b
            h = d.copy()
            for i in range(1, 1000):
                an = -i * (i - k)
                b = b + 2
                d = 1 / _apart(an * d + b)
                c = _apart(b + an / c)
                h = h * d * c
                if (np.abs(d * c - 1) < 1e-15).all():
                    break
            out[at] = front * h
    return out


@F.pandas_udf(DoubleType())
def chi2_sf(x: pd.Series, df: pd.Series) -> pd.Series:
    """The chi-square distribution's upper tail; 1 without degrees of freedom."""
    v, k = x.to_numpy(float), df.to_numpy(float)
    with np.errstate(invalid="ignore"):
        found = gamma_tail(np.where(k > 0, k / 2, 1.0), v / 2)
    return pd.Series(np.where(np.isnan(v) | np.isnan(k), np.nan, np.where(k > 0, found, 1.0)))


def beta_part(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The regularised incomplete beta function, by its continued fraction on the side where that converges fast."""
    a, b, x = (np.array(v, float) for v in np.broadcast_arrays(a, b, x))
    out = np.where(x >= 1, 1.0, np.where(x <= 0, 0.0, np.nan))
    at = np.flatnonzero((x > 0) & (x < 1) & (a > 0) & (b > 0))
    if not len(at):
        return out
    other = x[at] > (a[at] + 1) / (a[at] + b[at] + 2)
    p, q, v = np.where(other, b[at], a[at]), np.where(other, a[at], b[at]), np.where(other, 1 - x[at], x[at])
    front = np.exp(_lgamma(p + q) - _lgamma(p) - _lgamma(q) + p * np.log(v) + q * np.log1p(-v)) / p
    c, d = np.ones(len(at)), 1 / _apart(1 - (p + q) * v / (p + 1))
    h = d.copy()
    for m in range(1, 1000):
        for e in (m * (q - m) * v / ((p + 2 * m - 1) * (p + 2 * m)), -(p + m) * (p + q + m) * v / ((p + 2 * m) * (p + 2 * m + 1))):
            d = 1 / _apart(1 + e * d)
            c = _apart(1 + e / c)
            h = h * d * c
        if (np.abs(d * c - 1) < 1e-15).all():
            break
    out[at] = np.where(other, 1 - front * h, front * h)
    return out


def t_tails(t: np.ndarray, df: np.ndarray) -> np.ndarray:
    """Both tails of Student's t distribution, nan where either is unknown or df isn't above 0."""
    t, df = np.asarray(t, float), np.asarray(df, float)
    with np.errstate(invalid="ignore", divide="ignore"):
        x = np.where(np.isinf(t), 0.0, df / (df + t * t))
        return np.where(df > 0, beta_part(df / 2, 0.5, np.where(np.isnan(x), -1.0, x)) + np.where(np.isnan(t), np.nan, 0.0), np.nan)


@F.pandas_udf(DoubleType())
def t_two_sided(t: pd.Series, df: pd.Series) -> pd.Series:
    """Both tails of Student's t distribution."""
    return pd.Series(t_tails(t.to_numpy(float), df.to_numpy(float)))


def _log_choose(n: float, k: float) -> float:
    return math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)


@F.pandas_udf(DoubleType())
def fisher_two_sided(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.Series:
    """Fisher's exact test: all tables with the same margins that are no likelier."""

    def one(a: float, b: float, c: float, d: float) -> float | None:
        if any(map(pd.isna, (a, b, c, d))):
            return None
        row, col, n = a + b, a + c, a + b + c + d
        log = lambda x: _log_choose(row, x) + _log_choose(n - row, col - x) - _log_choose(n, col)
        own = log(a) + 1e-7
        tables = range(int(max(0, col - (n - row))), int(min(row, col)) + 1)
        return min(1.0, sum(math.exp(v) for v in map(log, tables) if v <= own))

    return pd.Series([one(*x) for x in zip(a, b, c, d)], dtype="float64")


@F.pandas_udf(DoubleType())
def hwe_exact(n0: pd.Series, n1: pd.Series, n2: pd.Series) -> pd.Series:
    """Exact Hardy-Weinberg p-value of counts of 0, 1 and 2 alleles: all counts of heterozygotes that are no likelier."""

    def one(hom1: int, het: int, hom2: int) -> float | None:
        n = hom1 + het + hom2
        if not n:
            return None
        rare = 2 * min(hom1, hom2) + het
        log = lambda h: h * math.log(2) - math.lgamma((rare - h) / 2 + 1) - math.lgamma(h + 1) - math.lgamma((2 * n - rare - h) / 2 + 1)
        logs = {h: log(h) for h in range(rare % 2, rare + 1, 2)}
        top = max(logs.values())
        weights = {h: math.exp(v - top) for h, v in logs.items()}
        return min(1.0, sum(w for w in weights.values() if w <= weights[het] * (1 + 1e-9)) / sum(weights.values()))

    return pd.Series([one(*x) for x in zip(n0, n1, n2)], dtype="float64")
