"""Grouped summaries. Every one is a partial-then-final aggregation, so a hot key costs
one buffer per task and nothing more."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.columns import masked_mean, ratio, share, to_column


def without_null_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Group-bys of the data model skip rows with a null key."""
    return df.na.drop(subset=list(keys))


def sum_by(df: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(*[F.sum(v).alias(v) for v in values])


def mean_by(df: DataFrame, keys: Sequence[str], value: str, name: str | None = None) -> DataFrame:
    return without_null_keys(df, keys).groupBy(*keys).agg(F.avg(value).alias(name or value))


def spread_by(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Mean, minimum and maximum."""
    return (
        without_null_keys(df, keys)
        .groupBy(*keys)
        .agg(
            F.avg(value).alias(f"avg_{value}"),
            F.min(value).alias(f"min_{value}"),
            F.max(value).alias(f"max_{value}"),
        )
    )


def variation_by(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Mean, sample deviation and their ratio."""
    return (
        without_null_keys(df, keys)
        .groupBy(*keys)
        .agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"))
        .withColumn("cv", ratio("std", "mean"))
    )


def dispersion_by(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Spread of a few members per key (for example transport modes within a month).

    The quartiles keep a group's distinct values in one buffer, so the group must be as small as
    a dimension; use :func:`tidemark.operators.quantiles.exact_quantiles` on raw rows.
    """
    return (
        without_null_keys(df, keys)
        .groupBy(*keys)
        .agg(
            F.stddev_samp(value).alias("dispersion_std"),
            (F.max(value) - F.min(value)).alias("dispersion_range"),
            (F.percentile(value, 0.75) - F.percentile(value, 0.25)).alias("dispersion_iqr"),
            F.avg(value).alias("mean_value"),
            F.count(value).alias("n"),
        )
        .withColumn("dispersion_cv", ratio("dispersion_std", "mean_value"))
    )


def masked_means_by(
    df: DataFrame, keys: Sequence[str], value: str, masks: Mapping[str, Column]
) -> DataFrame:
    """One pass for several row masks."""
    return (
        without_null_keys(df, keys)
        .groupBy(*keys)
        .agg(*[masked_mean(mask, value).alias(name) for name, mask in masks.items()])
    )


def distinct_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.agg(*[F.count_distinct(c).alias(f"n_{c}") for c in columns])


def date_coverage(df: DataFrame, date: str) -> DataFrame:
    return df.agg(F.min(date).alias("first_date"), F.max(date).alias("last_date"))


def frequency(df: DataFrame, column: str) -> DataFrame:
    """Non-null values with their counts."""
    return df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n"))


def shares(df: DataFrame, conditions: Mapping[str, Column]) -> DataFrame:
    return df.agg(*[share(c).alias(name) for name, c in conditions.items()])


def contingency(df: DataFrame, rows: str, columns: str, levels: Sequence) -> DataFrame:
    """Counts of two codes with the column code spread over known levels; absent cells are 0."""
    spread = df.groupBy(rows).pivot(columns, list(levels)).agg(F.count(F.lit(1)))
    return spread.na.fill(0, subset=[str(v) for v in levels])


def at_least(df: DataFrame, count: Column | str, minimum: int) -> DataFrame:
    return df.where(to_column(count) >= minimum)


def first_by(df: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """One row per key: one with the smallest ``order`` value (null if the key has no other); null
    keys are equal, and of rows that tie any one is kept.

    The minimum is a partial aggregation over the key columns only, and the wide rows move once in
    the semi-join, so a key that owns a third of all rows stays spread out; only rows that tie for
    the first place are compared again.
    """
    firsts = df.groupBy(*[F.col(k).alias(f"_{k}") for k in keys]).agg(F.min(order).alias("_first"))
    same = F.col(order).eqNullSafe(F.col("_first"))
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    return df.join(firsts, same, "left_semi").dropDuplicates(list(keys))


def profile_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row per column: missing count, mean and sample deviation."""
    measures = []
    for c in columns:
        value = F.col(c).cast("double")
        measures += [
            F.count_if(F.col(c).isNull()).alias(f"missing_{c}"),
            F.avg(value).alias(f"mean_{c}"),
            F.stddev_samp(value).alias(f"std_{c}"),
        ]
    wide = df.agg(*measures)
    rows = F.array(
        *[
            F.struct(
                F.lit(c).alias("feature"),
                F.col(f"missing_{c}").alias("missing"),
                F.col(f"mean_{c}").alias("mean"),
                F.col(f"std_{c}").alias("std"),
            )
            for c in columns
        ]
    )
    return wide.select(F.inline(rows))


def extremes_by(df: DataFrame, keys: Sequence[str], value: str, order: str) -> DataFrame:
    """Smallest and largest value with their position; a tie takes the earliest position."""
    low = F.min(F.struct(F.col(value), F.col(order)))
    high = F.min(F.struct((-F.col(value)).alias("minus"), F.col(order).alias("o"), F.col(value).alias("v")))
    return (
        without_null_keys(df, [*keys, value])
        .groupBy(*keys)
        .agg(low.alias("low"), high.alias("high"))
        .select(
            *keys,
            F.col(f"low.{value}").alias("min_value"),
            F.col(f"low.{order}").alias("min_at"),
            F.col("high.v").alias("max_value"),
            F.col("high.o").alias("max_at"),
        )
    )
