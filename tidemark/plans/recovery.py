"""Recovery of daily activity against a baseline, shocks and divergence between series.

Daily tables have columns ``date``, ``mode`` and ``value``; every date, window and list is a
parameter.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.columns import month_start, ratio, same_text, year_month
from tidemark.operators.rollup import dispersion_by, spread_by, without_null_keys
from tidemark.operators.series import era_means


def daily_rollup(raw: DataFrame, day: Column, mode: Column, value: Column) -> DataFrame:
    """Sum per day and mode."""
    return (
        raw.select(day.cast("date").alias("date"), mode.alias("mode"), value.alias("value"))
        .groupBy("date", "mode")
        .agg(F.sum("value").alias("value"))
    )


def monthly_recovery(
    daily: DataFrame, baseline_windows: Sequence[tuple[date, date]]
) -> DataFrame:
    """Mean per month and mode, divided by the mode's baseline.

    The baseline is the mean over the first window in which the mode has data. Months, baselines
    and all windows come from one scan and one shuffle: daily sums and counts per month are
    combined per mode afterwards.
    """
    inside = [F.col("date").between(F.lit(a), F.lit(b)) for a, b in baseline_windows]
    measures = [F.avg("value").alias("value")]
    for i, hit in enumerate(inside):
        kept = F.when(hit, F.col("value"))
        measures += [F.sum(kept).alias(f"_s{i}"), F.count(kept).alias(f"_c{i}")]
    monthly = (
        without_null_keys(daily, ["date", "mode"])
        .groupBy(F.year("date").alias("year"), F.month("date").alias("month"), "mode")
        .agg(*measures)
    )
    per_mode = Window.partitionBy("mode")
    means = [
        F.try_divide(F.sum(f"_s{i}").over(per_mode), F.sum(f"_c{i}").over(per_mode))
        for i in range(len(inside))
    ]
    return (
        monthly.withColumn("baseline", F.coalesce(*means))
        .withColumn("recovery_rate", ratio("value", "baseline"))
        .withColumn("date", month_start("year", "month"))
        .select("year", "month", "mode", "date", "value", "baseline", "recovery_rate")
    )


def yearly_recovery(monthly: DataFrame) -> DataFrame:
    return spread_by(monthly, ["year", "mode"], "recovery_rate")


def mode_curve(monthly: DataFrame, mode: str) -> DataFrame:
    """One mode's months in order, matched without regard to case."""
    return (
        monthly.where(same_text("mode", mode))
        .withColumn("year_month", year_month("year", "month"))
        .orderBy("year", "month")
    )


def shock_recovery(
    monthly: DataFrame,
    shock: tuple[date, date],
    recent: tuple[date, date],
    threshold: float = 0.8,
    minimum: int = 6,
) -> DataFrame:
    """Trough, current level and days/30 from the trough to the threshold, per mode.

    Without rows in the shock window the overall minimum counts; without recent rows the mean of
    the last six months. Modes with fewer than ``minimum`` months are left out.
    """
    rows = monthly.where(F.col("recovery_rate").isNotNull())
    w = Window.partitionBy("mode")
    point = F.struct("recovery_rate", "date")
    in_shock = F.col("date").between(F.lit(shock[0]), F.lit(shock[1]))
    in_recent = F.col("date").between(F.lit(recent[0]), F.lit(recent[1]))
    trough = F.coalesce(F.min(F.when(in_shock, point)).over(w), F.min(point).over(w))
    marked = rows.withColumn("_trough", trough).withColumn(
        "_back", F.row_number().over(w.orderBy(F.desc("date")))
    )
    recovered = (F.col("date") >= F.col("_trough.date")) & (F.col("recovery_rate") >= threshold)
    rate = F.col("recovery_rate")
    return (
        marked.groupBy("mode", "_trough")
        .agg(
            F.count("*").alias("n_months"),
            F.avg(F.when(in_recent, rate)).alias("_recent"),
            F.avg(F.when(F.col("_back") <= 6, rate)).alias("_tail"),
            F.min(F.when(recovered, F.col("date"))).alias("recovered_at"),
        )
        .where(F.col("n_months") >= minimum)
        .select(
            "mode",
            F.col("_trough.recovery_rate").alias("shock_depth"),
            F.date_format("_trough.date", "yyyy-MM").alias("shock_month"),
            F.coalesce("_recent", "_tail").alias("current_level"),
            (F.date_diff("recovered_at", F.col("_trough.date")) / 30).alias("months_to_80pct"),
            (F.coalesce("_recent", "_tail") >= 1.0).alias("fully_recovered"),
        )
    )


def structural_divergence(monthly: DataFrame, excluded: Sequence[str] = ()) -> DataFrame:
    """Spread of the recovery rates between modes, per month."""
    core = monthly.where(~F.col("mode").isin(list(excluded))) if excluded else monthly
    return dispersion_by(core, ["year", "month", "date"], "recovery_rate").withColumnsRenamed(
        {"mean_value": "mean_recovery", "n": "n_modes"}
    )


def divergence_by_era(
    divergence: DataFrame, eras: Mapping[str, tuple[date, date]]
) -> DataFrame:
    return era_means(divergence, "date", "dispersion_std", eras)
