"""Average ranks over a whole table without ordering it in one task."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.order import PART, offsets, range_parts, with_keys
from tidemark.runtime import cut_lineage


def value_ranks(
    df: DataFrame,
    value: str,
    extra_counts: Mapping[str, Column] | None = None,
    weight: str | None = None,
    keys: Sequence[str] = (),
    partitions: int | None = None,
) -> DataFrame:
    """Distinct values per key with their count ``c`` and average rank (1-based).

    A row stands for ``weight`` equal rows when that column is given. Equal values are counted first;
    the distinct values are ordered inside ranges and shifted by the counts of the ranges before.
    """
    extra, keys = dict(extra_counts or {}), list(keys)
    counts = (
        df.where(F.col(value).isNotNull())
        .groupBy(*keys, F.col(value).cast("double").alias("v"))
        .agg(
            (F.count("*") if weight is None else F.sum(weight)).alias("c"),
            *[c.alias(name) for name, c in extra.items()],
        )
    )
    parts = range_parts(counts, [*keys, "v"], partitions)
    inside = F.sum("c").over(Window.partitionBy(*keys, PART).orderBy("v")) - F.col("c")
    placed = with_keys(parts.withColumn("_inside", inside), offsets(parts, keys, F.col("c")), [*keys, PART])
    rank = F.col("_below") + F.col("_inside") + (F.col("c") + 1) / 2
    return placed.select(*keys, "v", "c", rank.alias("rank"), *extra)


def spearman(df: DataFrame, x: str, y: str) -> DataFrame:
    """Rank correlation of two columns over the rows where both are present.

    Equal pairs are counted and written first, and both columns are ranked from them in one pass. A
    value shared by many different pairs makes a skewed join key, which adaptive execution splits;
    the rank side has one row per distinct value.
    """
    rows = df.select(
        F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")
    ).na.drop()
    pairs = cut_lineage(rows.groupBy("x", "y").agg(F.count("*").alias("c")))
    sides = [F.struct(F.lit(side).alias("side"), F.col(side).alias("v")) for side in ("x", "y")]
    ranks = value_ranks(pairs.select("c", F.inline(F.array(*sides))), "v", weight="c", keys=["side"])
    ranked = pairs
    for column in ("x", "y"):
        mine = ranks.where(F.col("side") == column)
        ranked = ranked.join(mine.select(F.col("v").alias(column), F.col("rank").alias(f"r{column}")), column)
    c, rx, ry = F.col("c"), F.col("rx"), F.col("ry")
    n = F.col("n").cast("double")  # its cube leaves the range of a long from 2.1 million rows on
    centre = n * (n + 1) * (n + 1) / 4.0
    return (
        ranked.agg(
            F.sum("c").alias("n"),
            F.sum(c * rx * ry).alias("xy"),
            F.sum(c * rx * rx).alias("xx"),
            F.sum(c * ry * ry).alias("yy"),
        )
        .select(
            "n",
            F.try_divide(
                F.col("xy") - centre,
                F.sqrt((F.col("xx") - centre) * (F.col("yy") - centre)),
            ).alias("rho"),
        )
    )


def mann_whitney(df: DataFrame, group: Column, value: str) -> DataFrame:
    """U of the first group (``group`` true) with the tie-corrected normal approximation and
    continuity correction; works on distinct values, never on gathered groups."""
    flagged = df.withColumn("_g", group).where(F.col("_g").isNotNull())
    ranks = value_ranks(flagged, value, {"a": F.count_if("_g")})
    c = F.col("c").cast("double")
    sums = ranks.agg(
        F.sum("a").alias("n1"),
        (F.sum("c") - F.sum("a")).alias("n2"),
        F.sum(F.col("a") * F.col("rank")).alias("r1"),
        F.sum(c * c * c - c).alias("ties"),
    )
    n1, n2 = F.col("n1").cast("double"), F.col("n2").cast("double")
    n = n1 + n2
    u = F.col("r1") - n1 * (n1 + 1) / 2
    sigma = F.sqrt(
        n1 * n2 / 12 * ((n + 1) - F.try_divide(F.col("ties"), n * (n - 1)))
    )
    gap = F.greatest(F.abs(F.col("u") - n1 * n2 / 2) - 0.5, F.lit(0.0))
    return sums.withColumn("u", u).select(
        "n1", "n2", "u", F.try_divide(F.signum(F.col("u") - n1 * n2 / 2) * gap, sigma).alias("z")
    )
