"""Forecast backtests of many daily series: boosted lag trees against ARIMA(1,1,1)."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.columns import ratio
from tidemark.operators.order import positions
from tidemark.operators.regression import FEATURES, PREDICTION, metric_columns
from tidemark.operators.series import hold_out, lag_features
from tidemark.runtime import cut_lineage

LAGS = (1, 2, 3, 7, 14)
_STEPS_PER_CUT = 10


def representative_series(df: DataFrame, series: str, value: str) -> DataFrame:
    """The largest, middle and smallest series by mean value (one row per series is ranked)."""
    sizes = df.groupBy(series).agg(F.avg(value).alias("mean_value"))
    ranked = positions(sizes, [], [F.desc("mean_value"), F.asc(series)], "rank", total="_all")
    wanted = F.array(F.lit(0).cast("long"), F.floor(F.col("_all") / 2), F.col("_all") - 1)
    return ranked.where(F.array_contains(wanted, F.col("rank"))).drop("_all")


def _train_scale(train: DataFrame, series: str, value: str) -> DataFrame:
    return train.groupBy(series).agg(F.avg(value).alias("_mean"), F.count("*").alias("_n"))


def fit_lag_trees(
    train: DataFrame,
    series: str,
    order: str,
    value: str,
    lags: Sequence[int] = LAGS,
    trees: int = 100,
    depth: int = 4,
    rate: float = 0.1,
    seed: int = 42,
):
    """One boosted model over the lag rows of all series, each divided by its training mean."""
    scale = _train_scale(train, series, value).where(F.col("_mean") != 0)
    scaled = train.join(scale, series).withColumn("_y", F.col(value) / F.col("_mean"))
    rows = lag_features(scaled, [series], order, "_y", lags)
    vectors = rows.select(
        array_to_vector(F.array(*[F.col(f"lag_{k}") for k in lags])).alias(FEATURES), "_y"
    )
    return GBTRegressor(
        featuresCol=FEATURES, labelCol="_y", predictionCol=PREDICTION, maxIter=trees,
        maxDepth=depth, stepSize=rate, seed=seed,
    ).fit(vectors)


def forecast_lag_trees(
    train: DataFrame,
    series: str,
    order: str,
    value: str,
    horizon: int,
    model,
    lags: Sequence[int] = LAGS,
    minimum_rows: int = 20,
) -> DataFrame:
    """``(series, step, prediction)`` for steps 1..horizon, feeding predictions back as lags.

    The state of a series is its last ``max(lags)`` values in as many columns, so a step scores all
    series at once and shifts the columns by renaming; the lineage is cut every few steps. A series with fewer than ``minimum_rows`` lag rows
    gets its training mean.
    """
    depth = max(lags)
    scale = _train_scale(train, series, value)
    backwards = Window.partitionBy(series).orderBy(F.desc(order))
    recent = (
        train.withColumn("_back", F.row_number().over(backwards))
        .where(F.col("_back") <= depth)
        .groupBy(series)
        .agg(F.sort_array(F.collect_list(F.struct("_back", F.col(value).cast("double").alias("v")))).alias("_h"))
    )
    usable = (F.col("_n") - depth >= minimum_rows) & (F.col("_mean") != 0)
    history = [f"_h{i}" for i in range(depth)]
    state = scale.join(recent, series).select(
        series,
        "_mean",
        usable.alias("_usable"),
        F.array().cast("array<double>").alias("_out"),
        *[
            F.when(usable, F.get("_h", F.lit(i))["v"] / F.col("_mean")).otherwise(1.0).alias(name)
            for i, name in enumerate(history)
        ],
    )
    features = VectorAssembler(inputCols=[history[k - 1] for k in lags], outputCol=FEATURES)
    for step in range(1, horizon + 1):
        scored = model.transform(features.transform(state))
        shifted = [F.col(a).alias(b) for a, b in zip([PREDICTION, *history], history)]
        state = scored.select(
            series,
            "_mean",
            "_usable",
            F.concat("_out", F.array(F.col(PREDICTION))).alias("_out"),
            *shifted,
        )
        if step % _STEPS_PER_CUT == 0 and step < horizon:
            state = cut_lineage(state)
    return state.select(
        series, "_mean", "_usable", F.posexplode("_out").alias("_pos", "_p")
    ).select(
        series,
        (F.col("_pos") + 1).alias("step"),
        F.when(F.col("_usable"), F.col("_p") * F.col("_mean"))
        .otherwise(F.col("_mean"))
        .alias(PREDICTION),
    )


def arima_path(values: np.ndarray, horizon: int) -> tuple[np.ndarray, tuple[float, float, float]]:
    """Forecast of an ARIMA(1,1,1) with constant by conditional least squares.

    For a fixed moving-average weight the errors are linear in the constant and the autoregressive
    weight, so only one number is searched, on a grid that is narrowed four times.
    """
    w = np.diff(np.asarray(values, dtype=float))
    inputs = np.stack([w[1:], np.ones(len(w) - 1), w[:-1]], axis=1)
    low, high, best = -0.98, 0.98, None
    for _ in range(5):
        grid = np.linspace(low, high, 41)
        filtered = np.empty((len(inputs), 3, len(grid)))
        last = np.zeros((3, len(grid)))
        for t, row in enumerate(inputs):
            last = row[:, None] - grid * last
            filtered[t] = last
        for g, theta in enumerate(grid):
            y, x = filtered[:, 0, g], filtered[:, 1:, g]
            beta = np.linalg.lstsq(x, y, rcond=None)[0]
            errors = y - x @ beta
            sse = float(errors @ errors)
            if best is None or sse < best[0]:
                best = (sse, theta, beta[0], beta[1], errors[-1])
        width = (high - low) / 40
        low, high = max(-0.98, best[1] - width), min(0.98, best[1] + width)
    _, theta, constant, phi, error = best
    steps = np.empty(horizon)
    previous, shock = w[-1], error
    for i in range(horizon):
        previous = constant + phi * previous + theta * shock
        shock = 0.0
        steps[i] = previous
    return values[-1] + np.cumsum(steps), (constant, phi, theta)


def forecast_arima(
    train: DataFrame, series: str, order: str, value: str, horizon: int
) -> DataFrame:
    """``(series, step, prediction)``; one grouped call per series of one row per day. A series
    that cannot be fitted gets its training mean."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        values = frame.sort_values(order)[value].astype(float).to_numpy()
        path = None
        if len(values) >= 10:
            path, _ = arima_path(values, horizon)
        if path is None or not np.all(np.isfinite(path)):
            path = np.full(horizon, values.mean())
        return pd.DataFrame(
            {
                series: frame[series].iloc[0],
                "step": np.arange(1, horizon + 1, dtype="int32"),
                PREDICTION: path,
            }
        )

    schema = T.StructType(
        [
            train.schema[series],
            T.StructField("step", T.IntegerType()),
            T.StructField(PREDICTION, T.DoubleType()),
        ]
    )
    return train.select(series, order, value).groupBy(series).applyInPandas(run, schema)


def backtest(
    df: DataFrame,
    series: str,
    order: str,
    value: str,
    horizon: int = 60,
    lags: Sequence[int] = LAGS,
    trees: int = 100,
) -> DataFrame:
    """Error of both forecasters on the last ``horizon`` days of every series and their ratio."""
    split = cut_lineage(
        hold_out(df.select(series, order, value), [series], order, horizon)
    )
    train = split.where(~F.col("is_test"))
    actual = split.where("is_test").select(
        series, (F.lit(horizon + 1) - F.col("from_end")).alias("step"), F.col(value).alias("actual")
    )
    model = fit_lag_trees(train, series, order, value, lags, trees)
    scored = {
        "boosted": forecast_lag_trees(train, series, order, value, horizon, model, lags),
        "arima": forecast_arima(train, series, order, value, horizon),
    }
    errors = []
    for name, table in scored.items():
        rows = actual.join(table, [series, "step"])
        errors.append(
            rows.groupBy(series)
            .agg(*metric_columns("actual"))
            .select(
                series,
                F.col("n").alias(f"{name}_n"),
                F.col("rmse").alias(f"{name}_rmse"),
                F.col("mae").alias(f"{name}_mae"),
            )
        )
    sizes = train.groupBy(series).agg(F.count("*").alias("train_size"))
    return (
        errors[0]
        .join(errors[1], series)
        .join(sizes, series)
        .withColumn("rmse_ratio", ratio("boosted_rmse", "arima_rmse"))
        .select(
            series, "train_size", F.col("boosted_n").alias("test_size"), "boosted_rmse",
            "boosted_mae", "arima_rmse", "arima_mae", "rmse_ratio",
        )
    )
