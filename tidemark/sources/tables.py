"""Parquet sink, compute-once tables and output projections."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.sources.readers import path_exists


def write_parquet(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)


def materialize(
    spark: SparkSession,
    path: str,
    builder: Callable[[], DataFrame],
    partition_by: Sequence[str] = (),
) -> DataFrame:
    """Read ``path`` if a finished write is there, otherwise build, write and read it back.

    Only a directory with ``_SUCCESS`` counts, so a broken write is redone.
    """
    if not path_exists(spark, f"{path}/_SUCCESS"):
        write_parquet(builder(), path, partition_by)
    return spark.read.parquet(path)


def keep_columns(df: DataFrame, wanted: Sequence[str], prefixes: Sequence[str] = ()) -> DataFrame:
    """The wanted columns that exist, in the wanted order, then all columns with a given prefix."""
    present = set(df.columns)
    chosen = [c for c in wanted if c in present]
    chosen += [c for c in df.columns if c.startswith(tuple(prefixes)) and c not in chosen]
    return df.select(*chosen)


def drop_columns(df: DataFrame, unwanted: Sequence[str]) -> DataFrame:
    return df.drop(*unwanted)


def ensure_columns(df: DataFrame, columns: Sequence[str], data_type: str = "double") -> DataFrame:
    """Add each missing column as nulls."""
    missing = [c for c in columns if c not in df.columns]
    return df.withColumns({c: F.lit(None).cast(data_type) for c in missing}) if missing else df
