"""Operators over ordered series.

Input rows are already rolled up to one row per series and calendar step, so a window partition
is no longer than the calendar.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.columns import ratio, to_column
from tidemark.operators.order import positions


def ordered(keys: Sequence[str], order: str):
    return Window.partitionBy(*keys).orderBy(order)


def time_index(df: DataFrame, keys: Sequence[str], order: str, name: str = "t") -> DataFrame:
    """Ordinal position from zero within a series (or a segment, when it is one of the keys)."""
    return df.withColumn(name, F.row_number().over(ordered(keys, order)) - 1)


def lag_features(
    df: DataFrame, keys: Sequence[str], order: str, value: str, lags: Sequence[int]
) -> DataFrame:
    """One column per lag; rows without a full history are dropped."""
    w = ordered(keys, order)
    names = {f"lag_{k}": F.lag(value, k).over(w) for k in lags}
    return (
        df.withColumns({**names, "_row": F.row_number().over(w)})
        .where(F.col("_row") > max(lags))
        .drop("_row")
    )


def lagged_change(df: DataFrame, keys: Sequence[str], order: str, value: str) -> DataFrame:
    """Relative change against the previous row of the series."""
    before = F.lag(value).over(ordered(keys, order))
    return df.withColumn("change", ratio(F.col(value) - before, before))


def month_spine(centre: Column | str, months: int) -> Column:
    """Array of the month starts from ``months`` before to ``months`` after the centre."""
    centre = to_column(centre)
    return F.sequence(
        F.add_months(centre, -months), F.add_months(centre, months), F.expr("interval 1 month")
    )


def era_of(when: Column | str, eras: Mapping[str, tuple[date, date]]) -> Column:
    """Array of the eras a date falls in; both ends are inclusive."""
    when = to_column(when)
    spans = F.array(
        *[
            F.struct(
                F.lit(name).alias("era"),
                F.lit(first).cast("date").alias("first"),
                F.lit(last).cast("date").alias("last"),
            )
            for name, (first, last) in eras.items()
        ]
    )
    return F.transform(
        F.filter(spans, lambda s: when.between(s["first"], s["last"])), lambda s: s["era"]
    )


def with_eras(df: DataFrame, when: str, eras: Mapping[str, tuple[date, date]]) -> DataFrame:
    """One row per row and era it falls in."""
    return df.withColumn("era", F.explode(era_of(when, eras)))


def era_means(
    df: DataFrame, when: str, value: str, eras: Mapping[str, tuple[date, date]]
) -> DataFrame:
    return (
        with_eras(df, when, eras)
        .groupBy("era")
        .agg(F.avg(value).alias("mean_value"), F.count(value).alias("n"))
    )


def seasonal_decompose(
    df: DataFrame, keys: Sequence[str], order: str, value: str, period: int = 12
) -> DataFrame:
    """Additive decomposition: centred moving mean, mean detrended value per position, rest.

    Series shorter than two periods are left out. For an even period the two outermost values of
    the moving mean count half.
    """
    half = period // 2
    w = ordered(keys, order)
    whole = Window.partitionBy(*keys)
    frame = w.rowsBetween(-half, half)
    full = F.count(value).over(frame) == 2 * half + 1
    total = F.sum(value).over(frame)
    if period % 2 == 0:
        ends = F.lag(value, half).over(w) + F.lead(value, half).over(w)
        total = total - ends / 2
    base = (
        df.withColumn("_n", F.count(value).over(whole))
        .where(F.col("_n") >= 2 * period)
        .withColumn("position", F.pmod(F.row_number().over(w) - 1, F.lit(period)))
        .withColumn("trend", F.when(full, total / period))
    )
    slot = Window.partitionBy(*keys, "position")
    effect = F.avg(F.col(value) - F.col("trend")).over(slot)
    shaped = base.withColumn("_effect", effect).withColumn(
        "_first", F.row_number().over(slot.orderBy(order)) == 1
    )
    level = F.avg(F.when(F.col("_first"), F.col("_effect"))).over(whole)
    return (
        shaped.withColumn("seasonal", F.col("_effect") - level)
        .withColumn("resid", F.col(value) - F.col("trend") - F.col("seasonal"))
        .drop("_n", "_effect", "_first")
    )


def hold_out(
    df: DataFrame, keys: Sequence[str], order: str, points: int, slack: int = 30
) -> DataFrame:
    """Mark the last ``points`` rows of each series as test rows (``is_test``) with their
    distance from the end (``from_end``, 1 = last); series without ``points + slack`` rows are
    left out."""
    backwards = Window.partitionBy(*keys).orderBy(F.desc(order))
    return (
        df.withColumn("from_end", F.row_number().over(backwards))
        .withColumn("_n", F.count("*").over(Window.partitionBy(*keys)))
        .where(F.col("_n") >= points + slack)
        .withColumn("is_test", F.col("from_end") <= points)
        .drop("_n")
    )


def training_tail(split: DataFrame, keys: Sequence[str], points: int, days: int) -> DataFrame:
    """The last ``days`` training rows of a :func:`hold_out` result."""
    return split.where(
        ~F.col("is_test") & (F.col("from_end") <= points + days)
    )


def first_and_last(
    df: DataFrame, keys: Sequence[str], order: str, value: str, tail: int = 6
) -> DataFrame:
    """First value, last value and the mean of the last ``tail`` values."""
    present = df.where(F.col(value).isNotNull())
    backwards = Window.partitionBy(*keys).orderBy(F.desc(order))
    recent = F.when(F.col("_back") <= tail, F.col(value))
    return (
        present.withColumn("_back", F.row_number().over(backwards))
        .groupBy(*keys)
        .agg(
            F.min_by(value, order).alias("first_value"),
            F.max_by(value, order).alias("last_value"),
            F.avg(recent).alias("tail_mean"),
        )
    )


def deviation_band(df: DataFrame, mean: str, std: str) -> DataFrame:
    return df.withColumns(
        {"band_low": F.col(mean) - F.col(std), "band_high": F.col(mean) + F.col(std)}
    )


def position_in_group(df: DataFrame, group: str, order: str, name: str = "position") -> DataFrame:
    """Zero-based position of a member inside its group, for one row per member."""
    return positions(df, [group], [order], name)
