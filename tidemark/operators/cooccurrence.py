"""Co-occurrence of the most frequent list items."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.text import run_counts, run_starts


def top_values(df: DataFrame, items: str, top_n: int) -> DataFrame:
    """Most frequent non-blank array items, ties in item order."""
    return (
        df.select(F.explode(items).alias("item"))
        .select(F.trim("item").alias("item"))
        .where(F.col("item") != "")
        .groupBy("item")
        .agg(F.count("*").alias("n"))
        .orderBy(F.desc("n"), "item")
        .limit(top_n)
    )


def top_item_counts(df: DataFrame, items: str, top_n: int | None) -> DataFrame:
    """Per row the sorted ``(term, tf)`` list of its items that are among the top ``top_n``.

    The top set is one array of at most ``top_n`` strings used as a scalar, so rows are filtered
    in place and never regrouped.
    """
    trimmed = F.transform(items, lambda s: F.trim(s))
    if top_n is None:
        kept = df.select(F.sort_array(F.filter(trimmed, lambda s: s != "")).alias("_sorted"))
    else:
        top = top_values(df, items, top_n).agg(F.collect_set("item").alias("s")).scalar()
        kept = df.withColumn("_top", top).select(
            F.sort_array(
                F.filter(trimmed, lambda s: F.array_contains(F.col("_top"), s))
            ).alias("_sorted")
        )
    return (
        kept.where(F.size("_sorted") >= 2)
        .withColumn("_starts", run_starts(F.col("_sorted")))
        .select(run_counts(F.col("_sorted"), F.col("_starts")).alias("counts"))
    )


def item_pairs(
    df: DataFrame, items: str, top_n: int | None = 100, max_pairs: int | None = 5000
) -> DataFrame:
    """Unordered pairs of top items in the same row, weighted by how many position pairs they form.

    A row's repeated items are reduced to counts first: two items occurring ``a`` and ``b`` times
    form ``a*b`` position pairs, one occurring ``a`` times forms ``a*(a-1)/2`` with itself. A row
    therefore yields at most ``top_n*(top_n+1)/2`` partial sums however long its list is, and the
    partial aggregation keeps no more keys than that per task. ``None`` keeps all items or pairs.
    """
    counts = top_item_counts(df, items, top_n)
    # One array per row and a single explode: columns carried across an explode are computed anew
    # for every exploded element.
    c = F.col("counts")

    def from_position(a, i):
        return F.transform(
            F.slice(c, i + 1, F.size(c)),
            lambda b: F.struct(
                a["term"].alias("skill_a"),
                b["term"].alias("skill_b"),
                F.when(a["term"] == b["term"], (a["tf"] * (a["tf"] - 1) / 2).cast("long"))
                .otherwise(a["tf"].cast("long") * b["tf"])
                .alias("w"),
            ),
        )

    pairs = (
        counts.select(F.inline(F.flatten(F.transform(c, from_position))))
        .where(F.col("w") > 0)
        .groupBy("skill_a", "skill_b")
        .agg(F.sum("w").alias("weight"))
    )
    if max_pairs is None:
        return pairs
    return pairs.orderBy(F.desc("weight"), "skill_a", "skill_b").limit(max_pairs)
