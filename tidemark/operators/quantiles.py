"""Exact quantiles that never gather or order a whole group.

Equal values are counted, the distinct values are written in ranges, and the sizes of the ranges tell
which of them hold a wanted rank; only those are ordered, each by itself.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.order import PART, offsets, range_parts, with_keys
from tidemark.runtime import cut_lineage


def _quantiles(
    rows: DataFrame, keys: list[str], probabilities: Sequence[float], names: Sequence[str], partitions: int | None
) -> DataFrame:
    """Quantiles of ``_v`` per key; null keys are one key."""
    counts = rows.groupBy(*keys, "_v").agg(F.count("*").alias("_c"))
    parts = range_parts(counts, [*keys, "_v"], partitions)
    at = [F.lit(float(p)) * (F.col("_n") - 1) for p in probabilities]
    ranks = [
        F.struct(F.lit(i).alias("i"), a.alias("at"), F.floor(a).alias("lo"), F.ceil(a).alias("hi"))
        for i, a in enumerate(at)
    ]
    end = F.col("_below") + F.col("_t") - 1
    held = lambda r: r["lo"].between(F.col("_below"), end) | r["hi"].between(F.col("_below"), end)
    wanted = (
        offsets(parts, keys, F.col("_c"))
        .withColumn("_ranks", F.filter(F.array(*ranks), held))
        .where(F.size("_ranks") > 0)
    )
    upto = F.sum("_c").over(Window.partitionBy(*keys, PART).orderBy("_v"))
    placed = (
        with_keys(parts, wanted, [*keys, PART])
        .withColumn("_last", F.col("_below") + upto - 1)
        .withColumn("_first", F.col("_last") - F.col("_c") + 1)
        .select(*keys, "_n", "_v", "_first", "_last", F.explode("_ranks").alias("r"))
    )
    lo, hi = (F.col(f"r.{side}").between(F.col("_first"), F.col("_last")) for side in ("lo", "hi"))
    picked = (
        placed.where(lo | hi)
        .groupBy(*keys, "_n", F.col("r.i").alias("i"), F.col("r.at").alias("at"))
        .agg(F.max(F.when(lo, F.col("_v"))).alias("lo"), F.max(F.when(hi, F.col("_v"))).alias("hi"))
        .withColumn("q", F.col("lo") + (F.col("at") - F.floor("at")) * (F.col("hi") - F.col("lo")))
    )
    wide = [F.max(F.when(F.col("i") == i, F.col("q"))).alias(n) for i, n in enumerate(names)]
    return picked.groupBy(*keys).agg(F.max("_n").alias("n"), *wide)


def exact_quantiles(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    probabilities: Sequence[float],
    names: Sequence[str],
    partitions: int | None = None,
) -> DataFrame:
    """Linearly interpolated quantiles per key, plus the number of values ``n``.

    Rows with a null key or value are left out. The distinct values are written when this is called.
    """
    keys = list(keys)
    rows = df.na.drop(subset=[*keys, value]).select(*keys, F.col(value).cast("double").alias("_v"))
    return _quantiles(rows, keys, probabilities, names, partitions)


def exact_median(
    df: DataFrame, keys: Sequence[str], value: str, name: str, partitions: int | None = None
) -> DataFrame:
    return exact_quantiles(df, keys, value, [0.5], [name], partitions)


def exact_medians(
    df: DataFrame, keys: Sequence[str], values: Mapping[str, Column], partitions: int | None = None
) -> DataFrame:
    """Medians of several expressions per key in one pass; null keys are one key.

    Nulls of an expression are left out; its median is null in a key that has no value of it, and a
    key without any value has no row. Without keys there is always one row.
    """
    keys = list(keys)
    fields = [F.struct(F.lit(n).alias("_name"), v.cast("double").alias("_v")) for n, v in values.items()]
    rows = df.select(*keys, F.inline(F.array(*fields))).na.drop(subset=["_v"])
    found = _quantiles(rows, [*keys, "_name"], [0.5], ["_q"], partitions)
    return found.groupBy(*keys).agg(*[F.max(F.when(F.col("_name") == n, F.col("_q"))).alias(n) for n in values])


def winsor_bounds(
    df: DataFrame, value: str, low: float = 0.01, high: float = 0.99, partitions: int | None = None
) -> DataFrame:
    """One row with the lower and upper clipping bound."""
    return exact_quantiles(df, [], value, [low, high], ["lower", "upper"], partitions)


def winsorize(
    df: DataFrame, value: str, low: float = 0.01, high: float = 0.99, partitions: int | None = None
) -> DataFrame:
    """Clip a column to its own quantiles; the bounds are one scalar subquery."""
    bounds = winsor_bounds(df, value, low, high, partitions).select(F.struct("lower", "upper")).scalar()
    clipped = F.least(
        F.greatest(F.col(value).cast("double"), bounds.getField("lower")),
        bounds.getField("upper"),
    )
    return df.withColumn(value, F.when(F.col(value).isNotNull(), clipped))


def box_summary(df: DataFrame, key: str, value: str, partitions: int | None = None) -> DataFrame:
    """Quartiles, and whiskers at the outermost values within 1.5 IQR."""
    box = exact_quantiles(df, [key], value, [0.25, 0.5, 0.75], ["q1", "median", "q3"], partitions)
    reach = 1.5 * (F.col("q3") - F.col("q1"))
    v = F.col(value).cast("double")
    near = v.between(F.col("q1") - reach, F.col("q3") + reach)
    return (
        df.na.drop(subset=[key, value])
        .join(cut_lineage(box), key)
        .groupBy(key, "n", "q1", "median", "q3")
        .agg(
            F.min(F.when(near, v)).alias("whisker_low"),
            F.max(F.when(near, v)).alias("whisker_high"),
        )
    )
