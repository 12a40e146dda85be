"""Tail probabilities of Student's t and Fisher's F as vectorised column functions.

They are meant for rows of aggregates, a few for each group."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def _fraction(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The continued fraction of the incomplete beta function, by Lentz's method."""
    tiny = 1e-300
    keep = lambda v: np.where(np.abs(v) < tiny, tiny, v)
    c, d = np.ones_like(x), 1 / keep(1 - (a + b) * x / (a + 1))
    out = d.copy()
    for m in range(1, 400):
        for step in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / keep(1 + step * d)
            c = keep(1 + step / c)
            out = out * d * c
        if np.all(np.abs(d * c - 1) < 1e-14):
            break
    return out


_lgamma = np.vectorize(math.lgamma, otypes=[float])


def beta_share(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The regularised incomplete beta function I_x(a, b)."""
    a, b, x = (np.asarray(v, float) for v in np.broadcast_arrays(a, b, x))
    x = np.clip(x, 0, 1)
    inner = np.clip(x, 1e-300, 1 - 1e-16)
    front = np.exp(_lgamma(a + b) - _lgamma(a) - _lgamma(b) + a * np.log(inner) + b * np.log1p(-inner))
    low = x < (a + 1) / (a + b + 2)
    value = np.where(low, front * _fraction(a, b, inner) / a, 1 - front * _fraction(b, a, 1 - inner) / b)
    return np.where(x <= 0, 0.0, np.where(x >= 1, 1.0, value))


def _defined(*columns: pd.Series) -> np.ndarray:
    return np.logical_and.reduce([c.notna().to_numpy() for c in columns])


def _t_two_sided(t: pd.Series, df: pd.Series) -> pd.Series:
    """P(|T| >= |t|); null where an argument is null or df < 1."""
    ok = _defined(t, df) & (df.fillna(0).to_numpy(float) >= 1)
    out = np.full(len(t), np.nan)
    if ok.any():
        v, x = df[ok].to_numpy(float), t[ok].to_numpy(float)
        out[ok] = beta_share(v / 2, np.full(len(v), 0.5), v / (v + x * x))
    return pd.Series(out).where(ok, None)


def _t_quantile(p: pd.Series, df: pd.Series) -> pd.Series:
    """The t with P(T <= t) = p, by bisection."""
    q, v = p.to_numpy(float), df.to_numpy(float)
    low, high = np.full(len(q), -1e4), np.full(len(q), 1e4)
    for _ in range(120):
        mid = (low + high) / 2
        tail = beta_share(v / 2, np.full(len(v), 0.5), v / (v + mid * mid)) / 2
        below = np.where(mid > 0, 1 - tail, tail) < q
        low, high = np.where(below, mid, low), np.where(below, high, mid)
    return pd.Series((low + high) / 2)


def _f_upper(f: pd.Series, df1: pd.Series, df2: pd.Series) -> pd.Series:
    """P(F >= f)."""
    ok = _defined(f, df1, df2)
    out = np.full(len(f), np.nan)
    if ok.any():
        x, a, b = (c[ok].to_numpy(float) for c in (f, df1, df2))
        out[ok] = beta_share(b / 2, a / 2, b / (b + a * x))
    return pd.Series(out).where(ok, None)


def t_two_sided(t: Column | str, df: Column | str) -> Column:
    """P(|T| >= |t|); null where an argument is null or df < 1."""
    return F.pandas_udf(_t_two_sided, "double")(t, df)


def t_quantile(p: Column | str, df: Column | str) -> Column:
    """The t with P(T <= t) = p."""
    return F.pandas_udf(_t_quantile, "double")(p, df)


def f_upper(f: Column | str, df1: Column | str, df2: Column | str) -> Column:
    """P(F >= f)."""
    return F.pandas_udf(_f_upper, "double")(f, df1, df2)
