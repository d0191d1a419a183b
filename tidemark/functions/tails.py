"""Tail probabilities for already aggregated rows.

The statistics are computed by Spark aggregates; these small vectorised functions only turn a
statistic into a p-value. The incomplete beta integral is evaluated by the modified Lentz
continued fraction.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.columns import to_column

_TINY = 1e-300


def _beta_fraction(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    guard = lambda v: np.where(np.abs(v) < _TINY, _TINY, v)
    c = np.ones_like(x)
    d = 1.0 / guard(1.0 - (a + b) * x / (a + 1.0))
    result = d.copy()
    for m in range(1, 400):
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        d = 1.0 / guard(1.0 + even * d)
        c = guard(1.0 + even / c)
        result = result * d * c
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1.0 / guard(1.0 + odd * d)
        c = guard(1.0 + odd / c)
        step = d * c
        result = result * step
        if np.all(np.abs(step - 1.0) < 1e-15):
            break
    return result


def incomplete_beta(a, b, x) -> np.ndarray:
    """Regularised incomplete beta function, elementwise."""
    a, b, x = (np.atleast_1d(np.asarray(v, dtype=float)) for v in (a, b, x))
    a, b, x = np.broadcast_arrays(a, b, x)
    out = np.full(x.shape, np.nan)
    ok = np.isfinite(a) & np.isfinite(b) & np.isfinite(x) & (a > 0) & (b > 0)
    out[ok & (x <= 0)] = 0.0
    out[ok & (x >= 1)] = 1.0
    todo = ok & (x > 0) & (x < 1)
    if todo.any():
        p, q, v = a[todo], b[todo], x[todo]
        swap = v > (p + 1.0) / (p + q + 2.0)
        p, q, v = np.where(swap, q, p), np.where(swap, p, q), np.where(swap, 1.0 - v, v)
        log_beta = np.array(
            [math.lgamma(i) + math.lgamma(j) - math.lgamma(i + j) for i, j in zip(p, q)]
        )
        front = np.exp(p * np.log(v) + q * np.log1p(-v) - log_beta) / p
        value = front * _beta_fraction(p, q, v)
        out[todo] = np.where(swap, 1.0 - value, value)
    return out


def normal_cdf(z: float) -> float:
    return 0.5 * math.erfc(-z / math.sqrt(2.0))


@F.pandas_udf(T.DoubleType())
def _f_tail(f: pd.Series, d1: pd.Series, d2: pd.Series) -> pd.Series:
    f, d1, d2 = (s.astype(float).to_numpy() for s in (f, d1, d2))
    with np.errstate(invalid="ignore", divide="ignore"):
        x = d2 / (d2 + d1 * np.maximum(f, 0.0))
    return pd.Series(incomplete_beta(d2 / 2.0, d1 / 2.0, x)).replace({np.nan: None})


@F.pandas_udf(T.DoubleType())
def _t_tail(t: pd.Series, df: pd.Series) -> pd.Series:
    t, df = (s.astype(float).to_numpy() for s in (t, df))
    with np.errstate(invalid="ignore", divide="ignore"):
        x = df / (df + t * t)
    return pd.Series(incomplete_beta(df / 2.0, 0.5, x)).replace({np.nan: None})


@F.pandas_udf(T.DoubleType())
def _normal_tail(z: pd.Series) -> pd.Series:
    return z.map(lambda v: None if pd.isna(v) else math.erfc(abs(v) / math.sqrt(2.0)))


def f_tail(f: Column | str, d1: Column | str, d2: Column | str) -> Column:
    """P(F > f)."""
    return _f_tail(*[to_column(c).cast("double") for c in (f, d1, d2)])


def f_tail_two(f: Column | str, d2: Column | str) -> Column:
    """P(F > f) for two numerator degrees of freedom: a closed form, no Python."""
    f, d2 = to_column(f), to_column(d2)
    return F.pow(1 + 2 * F.greatest(f, F.lit(0.0)) / d2, -d2 / 2)


def f_critical_two(alpha: float, d2: Column | str) -> Column:
    """Critical F value for two numerator degrees of freedom."""
    d2 = to_column(d2)
    return d2 / 2 * (F.pow(F.lit(alpha), -2 / d2) - 1)


def t_tail(t: Column | str, df: Column | str) -> Column:
    """Two-sided P(|T| > |t|)."""
    return _t_tail(to_column(t).cast("double"), to_column(df).cast("double"))


def normal_tail(z: Column | str) -> Column:
    """Two-sided P(|Z| > |z|)."""
    return _normal_tail(to_column(z).cast("double"))


def chi2_one_tail(chi2: Column | str) -> Column:
    """P(X > chi2) for one degree of freedom."""
    return normal_tail(F.sqrt(to_column(chi2).cast("double")))
