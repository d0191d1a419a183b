"""CSV and Parquet scans."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.runtime import spread
from tidemark.sources import schemas


def read_typed_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Header CSV with a declared schema; unparsable cells become null."""
    return spark.read.schema(schema).csv(path, header=True, quote='"', escape='"')


def read_daily_csv(spark: SparkSession, path: str) -> DataFrame:
    raw = read_typed_csv(spark, path, schemas.DAILY_CSV)
    return raw.select(
        F.col("Date").try_cast("date").alias("date"),
        F.col("Mode").alias("mode"),
        F.col("Count").alias("value"),
    )


def read_text_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """All-text CSV; rows whose field count differs from the header are dropped.

    Parser-level column pruning is off so that the field count is always checked.
    """
    return (
        spark.read.schema(schema)
        .option("header", True)
        .option("mode", "DROPMALFORMED")
        .option("quote", '"')
        .option("escape", '"')
        .option("columnPruning", False)
        .csv(path)
    )


def read_hourly_csv(spark: SparkSession, path: str) -> DataFrame:
    return read_text_csv(spark, path, schemas.HOURLY_CSV)


def read_skills_csv(spark: SparkSession, path: str) -> DataFrame:
    return read_typed_csv(spark, path, schemas.SKILLS_CSV)


def read_postings_csv(spark: SparkSession, path: str) -> DataFrame:
    """Quoted CSV with line breaks inside cells, reduced to the known posting columns.

    A multi-line file cannot be split: supply many files and write the result to Parquet once.
    Few large files are spread over the cores after reading.
    """
    raw = (
        spark.read.option("header", True)
        .option("multiLine", True)
        .option("quote", '"')
        .option("escape", '"')
        .csv(path)
    )
    kept = raw.select([F.col(c) for c in schemas.POSTING_COLUMNS if c in raw.columns])
    return spread(kept, "job_id")


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def path_exists(spark: SparkSession, path: str) -> bool:
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop_path)


def read_or_fallback(
    spark: SparkSession, path: str | None, fallback: Callable[[], DataFrame | None]
) -> DataFrame | None:
    """Optional input: the table at ``path`` when it exists, otherwise what ``fallback`` builds."""
    if path is not None and path_exists(spark, path):
        return spark.read.parquet(path)
    return fallback()
