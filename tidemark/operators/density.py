"""Gaussian kernel density curves per group."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.runtime import cut_lineage


def density_curves(
    df: DataFrame,
    key: str,
    value: str,
    grid_size: int = 200,
    cut: float = 3.0,
    more_than: int = 5,
) -> DataFrame:
    """Density on an even grid reaching ``cut`` bandwidths beyond the data, Scott's bandwidth.

    Equal values are counted first; each distinct value then adds to all grid points inside its
    own task, and only ``groups x grid_size`` partial sums are shuffled.
    """
    counts = (
        df.na.drop(subset=[key, value])
        .groupBy(key, F.col(value).cast("double").alias("v"))
        .agg(F.count("*").alias("c"))
    )
    shape = (
        df.na.drop(subset=[key, value])
        .groupBy(key)
        .agg(
            F.count("*").alias("n"),
            F.stddev_samp(F.col(value).cast("double")).alias("s"),
            F.min(F.col(value).cast("double")).alias("low"),
            F.max(F.col(value).cast("double")).alias("high"),
        )
        .where((F.col("n") > more_than) & (F.col("s") > 0))
        .withColumn("h", F.col("s") * F.pow(F.col("n"), F.lit(-0.2)))
        .withColumn("start", F.col("low") - cut * F.col("h"))
        .withColumn(
            "step",
            (F.col("high") - F.col("low") + 2 * cut * F.col("h")) / (grid_size - 1),
        )
        .select(key, "n", "h", "start", "step")
    )
    z = (F.col("x") - F.col("v")) / F.col("h")
    kernel = F.col("c") * F.exp(-z * z / 2)
    return (
        counts.join(cut_lineage(shape), key)
        .withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(grid_size - 1))))
        .withColumn("x", F.col("start") + F.col("i") * F.col("step"))
        .groupBy(key, "i", "x", "n", "h")
        .agg(F.sum(kernel).alias("k"))
        .select(
            key,
            F.col("i").alias("grid_index"),
            "x",
            (F.col("k") / (F.col("n") * F.col("h") * F.sqrt(2 * F.pi()))).alias("density"),
        )
    )
