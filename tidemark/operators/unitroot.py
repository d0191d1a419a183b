"""Augmented Dickey-Fuller test per series.

The lag choice needs a handful of small regressions per series, which Spark aggregates cannot
express, so each series (one row per calendar step) is one grouped pandas call.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from tidemark.functions.tails import normal_cdf

# MacKinnon's response surface for one series with a constant.
TAU_STAR = -1.61
TAU_MIN = -18.83
TAU_MAX = 2.74
SMALL_P = (2.1659, 1.4412, 0.038269)
LARGE_P = (1.7339, 0.93202, -0.12745, -0.010368)
CRITICAL = {
    "1%": (-3.43035, -6.5393, -16.786, -79.433),
    "5%": (-2.86154, -2.8903, -4.234, -40.040),
}

_SCHEMA = (
    "label string, adf_stat double, p_value double, critical_1 double, critical_5 double, "
    "is_stationary boolean, used_lag int, n_obs int"
)


def _mackinnon_p(tau: float) -> float:
    if tau > TAU_MAX:
        return 1.0
    if tau < TAU_MIN:
        return 0.0
    weights = SMALL_P if tau <= TAU_STAR else LARGE_P
    return normal_cdf(sum(w * tau**i for i, w in enumerate(weights)))


def _regression(change: np.ndarray, level: np.ndarray, lag: int, start: int):
    """Regress the change on level, ``lag`` earlier changes and a constant from row ``start``."""
    rows = np.arange(start, len(change))
    columns = [level[rows]] + [change[rows - i] for i in range(1, lag + 1)]
    x = np.column_stack([*columns, np.ones(len(rows))])
    y = change[rows]
    inverse = np.linalg.pinv(x.T @ x)
    beta = inverse @ (x.T @ y)
    rss = float(np.sum((y - x @ beta) ** 2))
    return beta, inverse, rss, len(rows), x.shape[1]


def adf(values: np.ndarray) -> tuple[float, float, float, float, int, int]:
    """Statistic, p-value, two critical values, lag and number of observations used."""
    y = np.asarray(values, dtype=float)
    change, level = np.diff(y), y[:-1]
    limit = min(math.ceil(12.0 * (len(y) / 100.0) ** 0.25), len(y) // 2 - 2)
    best_lag, best_aic = 0, math.inf
    for lag in range(limit + 1):
        _, _, rss, n, k = _regression(change, level, lag, limit)
        likelihood = -n / 2.0 * (math.log(2 * math.pi) + math.log(max(rss, 1e-300) / n) + 1)
        aic = -2 * likelihood + 2 * k
        if aic < best_aic:
            best_lag, best_aic = lag, aic
    beta, inverse, rss, n, k = _regression(change, level, best_lag, best_lag)
    error = math.sqrt(max(rss / (n - k) * inverse[0, 0], 0.0))
    tau = beta[0] / error if error > 0 else math.nan
    critical = [sum(b / n**i for i, b in enumerate(CRITICAL[c])) for c in ("1%", "5%")]
    p = _mackinnon_p(tau) if math.isfinite(tau) else math.nan
    return tau, p, critical[0], critical[1], best_lag, n


def stationarity_tests(
    df: DataFrame, series: str, order: str, value: str, minimum: int = 10
) -> DataFrame:
    """One row per series; shorter series than ``minimum`` get a null statistic."""

    def test(frame: pd.DataFrame) -> pd.DataFrame:
        label = str(frame[series].iloc[0])
        values = frame.sort_values(order)[value].astype(float).to_numpy()
        if len(values) < minimum:
            row = [label, None, None, None, None, False, None, len(values)]
        else:
            tau, p, c1, c5, lag, n = adf(values)
            row = [label, tau, p, c1, c5, bool(p < 0.05), lag, n]
        names = [part.split()[0] for part in _SCHEMA.split(", ")]
        return pd.DataFrame([row], columns=names)

    rows = df.select(series, order, value).na.drop()
    return rows.groupBy(series).applyInPandas(test, _SCHEMA)
