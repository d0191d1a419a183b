"""Positions in a total order, found without ordering a whole table or group in one task.

Rows are range-partitioned by key and value and written with the number of their partition. The sizes
of the partitions, a few numbers per partition, give how many rows lie in the partitions before; only
inside a partition are rows ordered. More partitions mean smaller tasks, also for a key that holds
most rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.runtime import cut_lineage

PART = "_part"


def range_parts(df: DataFrame, by: Sequence[str | Column], partitions: int | None = None) -> DataFrame:
    """``df`` written in ranges of ``by``, with the number of its range in ``_part``.

    Without ``partitions`` the session's number is used, joined by measured size where that is adaptive.
    """
    sized = [] if partitions is None else [partitions]
    return cut_lineage(df.repartitionByRange(*sized, *by).withColumn(PART, F.spark_partition_id()))


def offsets(parts: DataFrame, keys: Sequence[str], weight: Column) -> DataFrame:
    """Per key and range the sum ``_t`` of ``weight``, the sum ``_below`` of the key's ranges before
    it, and the key's whole sum ``_n``. A key has at most as many rows as there are ranges."""
    key = Window.partitionBy(*keys)
    before = key.orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    return (
        parts.groupBy(*keys, PART)
        .agg(F.sum(weight).alias("_t"))
        .withColumn("_below", F.coalesce(F.sum("_t").over(before), F.lit(0).cast("long")))
        .withColumn("_n", F.sum("_t").over(key))
    )


def with_keys(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on ``keys``, where nulls are equal; the columns of ``left``, then the others of ``right``."""
    renamed = right.withColumnsRenamed({k: f"_of_{k}" for k in keys})
    alike = [F.col(f"`{k}`").eqNullSafe(F.col(f"`_of_{k}`")) for k in keys]
    return left.join(renamed, reduce(lambda a, b: a & b, alike, F.lit(True)), how).drop(*[f"_of_{k}" for k in keys])


def positions(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str | Column],
    name: str,
    total: str | None = None,
    partitions: int | None = None,
) -> DataFrame:
    """Zero-based position of each row among the rows of its key, and their number as ``total``."""
    keys = list(keys)
    parts = range_parts(df, [*keys, *order], partitions)
    inside = F.row_number().over(Window.partitionBy(*keys, PART).orderBy(*order)) - 1
    ranked = with_keys(parts.withColumn("_inside", inside), offsets(parts, keys, F.lit(1)), [*keys, PART])
    found = {name: F.col("_below") + F.col("_inside"), **({total: F.col("_n")} if total else {})}
    kept = [c for c in df.columns if c not in found]
    return ranked.select(*[F.col(f"`{c}`") for c in kept], *[c.alias(n) for n, c in found.items()])
