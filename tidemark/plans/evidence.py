"""Three layers of evidence and the overall verdict."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import date
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.columns import map_code, recovery_tier, rule_label
from tidemark.operators.breaks import break_list, break_tests


def break_evidence(monthly: DataFrame, modes: Sequence[str], when: date) -> DataFrame:
    """Quadratic break tests of the core modes at one date."""
    core = monthly.where(F.col("mode").isin(list(modes)))
    return break_tests(
        core, "mode", "date", "recovery_rate", F.array(*break_list([when], "quadratic"))
    )


def break_verdict(tests: DataFrame) -> DataFrame:
    """Two breaks pass, one is weak."""
    return (
        tests.agg(F.count("*").alias("n_modes"), F.count_if("is_break").alias("n_breaks"))
        .withColumn(
            "verdict",
            rule_label([(F.col("n_breaks") >= 2, "PASS"), (F.col("n_breaks") == 1, "WEAK")], "FAIL"),
        )
    )


def recent_ranking(
    monthly: DataFrame, since: date, labels: Mapping[str, str] | None = None
) -> DataFrame:
    """Mean recent recovery per mode with rank and tier (one row per mode is ranked)."""
    means = (
        monthly.where(F.col("date") >= F.lit(since))
        .groupBy("mode")
        .agg(F.avg("recovery_rate").alias("rate"))
        .where(F.col("rate").isNotNull())
    )
    ranked = means.withColumn(
        "rank", F.rank().over(Window.orderBy(F.desc("rate")))
    ).withColumn("tier", recovery_tier("rate"))
    return ranked.withColumn("label", map_code("mode", labels)) if labels else ranked


def order_verdict(
    ranking: DataFrame, rail: Sequence[str], subway: str, bus: str
) -> DataFrame:
    """Mean rail recovery above subway above bus; a missing mode counts as 0."""
    rate_of = lambda mode: F.coalesce(
        F.max(F.when(F.col("mode") == mode, F.col("rate"))), F.lit(0.0)
    )
    rail_mean = reduce(lambda a, b: a + b, [rate_of(m) for m in rail]) / len(rail)
    above = F.col("rail_rate") > F.col("subway_rate")
    return (
        ranking.agg(
            rail_mean.alias("rail_rate"),
            rate_of(subway).alias("subway_rate"),
            rate_of(bus).alias("bus_rate"),
        )
        .withColumn("tiers_ok", above & (F.col("subway_rate") > F.col("bus_rate")))
        .withColumn("verdict", rule_label([(F.col("tiers_ok"), "PASS"), (above, "WEAK")], "FAIL"))
    )


def overall_verdict(layers: Mapping[str, DataFrame]) -> DataFrame:
    """Number of passed layers (each a one-row table with ``verdict``) and the support label."""
    rows = reduce(
        DataFrame.unionByName,
        [t.select(F.lit(name).alias("layer"), "verdict") for name, t in layers.items()],
    )
    passed = F.col("passed")
    return (
        rows.agg(
            F.count("*").alias("layers"),
            F.count_if(F.col("verdict") == "PASS").alias("passed"),
            F.concat_ws(
                "; ", F.array_sort(F.collect_list(F.concat_ws("=", "layer", "verdict")))
            ).alias("detail"),
        )
        .withColumn(
            "support",
            rule_label([(passed == 3, "strong"), (passed == 2, "medium"), (passed == 1, "weak")], "none"),
        )
    )
