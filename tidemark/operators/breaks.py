"""Structural break tests of many series at many dates in one job.

A segment's residual sum of squares under a linear or quadratic trend depends only on its count
and on the sums of y, y^2, t*y and t^2*y, so the whole test is one grouped aggregation. Time is
centred on the series and y on its mean first, which keeps the sums small.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.columns import ratio, rule_label
from tidemark.functions.tails import f_critical_two, f_tail, f_tail_two
from tidemark.operators.series import month_spine


def _segment_rss(
    n: Column, centre: Column, y: Column, yy: Column, ty: Column, tty: Column, quadratic: Column
) -> Column:
    """Residual sum of squares; ``centre`` is the mean time of the segment."""
    linear = ty - centre * y
    spread = (n * n - 1) / 12
    curved = tty - 2 * centre * ty + centre * centre * y - spread * y
    rss = yy - y * y / n - linear * linear / (n * spread)
    bend = curved * curved / (n * spread * (n * n - 4) / 15)
    return F.greatest(rss - F.when(quadratic, bend).otherwise(F.lit(0.0)), F.lit(0.0))


def break_tests(
    df: DataFrame,
    series: str,
    order: str,
    value: str,
    breaks: Column,
    minimum: int = 12,
    alpha: float = 0.05,
) -> DataFrame:
    """Test every series at every break of ``breaks``, an array of
    ``struct(break_date date, trend string)`` with trend ``linear`` or ``quadratic``.

    Too few points on a side, or a split that fits perfectly, gives a null statistic and no
    break. Input is one row per series and calendar step.
    """
    whole = Window.partitionBy(series)
    rows = df.na.drop(subset=[series, value]).select(
        series, F.col(order).alias("_d"), F.col(value).cast("double").alias("_y")
    )
    centred = rows.withColumn(
        "_t",
        F.row_number().over(whole.orderBy("_d")) - (F.count("*").over(whole) + 1) / 2,
    ).withColumn("_y", F.col("_y") - F.avg("_y").over(whole))
    tested = centred.withColumn("_b", F.explode(breaks)).select(
        "*", F.col("_b.break_date").alias("break_date"), F.col("_b.trend").alias("trend")
    )
    post = F.col("_d") >= F.col("break_date")
    t, y = F.col("_t"), F.col("_y")
    moments = {"y": y, "yy": y * y, "ty": t * y, "tty": t * t * y}
    measures = [F.count_if(~post).alias("n_pre"), F.count_if(post).alias("n_post")]
    for name, term in moments.items():
        measures.append(F.sum(F.when(~post, term).otherwise(0.0)).alias(f"{name}_pre"))
        measures.append(F.sum(F.when(post, term).otherwise(0.0)).alias(f"{name}_post"))
    sums = tested.groupBy(series, "break_date", "trend").agg(*measures)

    n_pre, n_post = F.col("n_pre").cast("double"), F.col("n_post").cast("double")
    n = n_pre + n_post
    quadratic = F.col("trend") == "quadratic"
    k = F.when(quadratic, 3.0).otherwise(2.0)

    def rss(count: Column, centre: Column, side: str) -> Column:
        names = ("y", "yy", "ty", "tty")
        if side == "full":
            parts = [F.col(f"{m}_pre") + F.col(f"{m}_post") for m in names]
        else:
            parts = [F.col(f"{m}_{side}") for m in names]
        return _segment_rss(count, centre, *parts, quadratic)

    enough = (F.col("n_pre") >= minimum) & (F.col("n_post") >= minimum)
    fitted = (
        sums.withColumn("rss_full", F.when(enough, rss(n, F.lit(0.0), "full")))
        .withColumn(
            "rss_split",
            F.when(enough, rss(n_pre, -n_post / 2, "pre") + rss(n_post, n_pre / 2, "post")),
        )
        .withColumn("df1", k)
        .withColumn("df2", n - 2 * k)
        .withColumn("_den", F.col("rss_split") / F.when(F.col("df2") > 0, F.col("df2")))
        .withColumn(
            "f_stat",
            F.when(
                F.col("_den") >= 1e-12,
                (F.col("rss_full") - F.col("rss_split")) / F.col("df1") / F.col("_den"),
            ),
        )
    )
    closed = f_tail_two("f_stat", "df2")
    return (
        fitted.withColumn("_p3", f_tail(F.when(quadratic, F.col("f_stat")), "df1", "df2"))
        .withColumn(
            "p_value",
            F.when(F.col("f_stat").isNull(), None)
            .when(quadratic, F.col("_p3"))
            .otherwise(closed),
        )
        .withColumn("is_break", F.coalesce(F.col("p_value") < alpha, F.lit(False)))
        .withColumn(
            "note",
            F.when(~enough, F.lit("too few points")).when(
                F.col("f_stat").isNull(), F.lit("denominator near zero")
            ),
        )
        .select(
            series, "break_date", "trend", "n_pre", "n_post", "rss_full", "rss_split", "df2",
            "f_stat", "p_value", "is_break", "note",
        )
    )


def break_list(dates: Sequence[date], trend: str) -> list[Column]:
    return [
        F.struct(F.lit(d).cast("date").alias("break_date"), F.lit(trend).alias("trend"))
        for d in dates
    ]


def hypothesis_and_placebo_tests(
    df: DataFrame,
    series: str,
    order: str,
    value: str,
    hypotheses: Sequence[date],
    placebos: Sequence[date],
) -> DataFrame:
    """Hypothesis dates with a quadratic trend, placebo dates with a linear one."""
    breaks = F.array(*break_list(hypotheses, "quadratic"), *break_list(placebos, "linear"))
    tests = break_tests(df, series, order, value, breaks)
    verdict = rule_label(
        [
            (F.col("f_stat").isNull(), "too little data"),
            (F.col("is_break"), "break"),
            (F.col("p_value") < 0.1, "weak"),
        ],
        "none",
    )
    return tests.withColumn("verdict", verdict)


def sensitivity_scan(
    df: DataFrame,
    series: str,
    order: str,
    value: str,
    centre: date,
    months: int = 12,
    trend: str = "linear",
) -> DataFrame:
    """The break test at every month start within ``months`` of the centre."""
    breaks = F.transform(
        month_spine(F.lit(centre).cast("date"), months),
        lambda d: F.struct(d.alias("break_date"), F.lit(trend).alias("trend")),
    )
    return break_tests(df, series, order, value, breaks).withColumn(
        "f_critical", f_critical_two(0.05, F.col("df2"))
    )


def scan_summary(scan: DataFrame, series: str, centre: date) -> DataFrame:
    """Range and peak of a scan, the value at the centre, and how sharp the peak is."""
    valid = scan.where(F.col("f_stat").isNotNull())
    days = F.unix_date(F.col("break_date"))
    peak = F.max(F.struct("f_stat", (-days).alias("d"), F.col("break_date").alias("at")))
    return (
        valid.groupBy(series)
        .agg(
            F.count("*").alias("n_points"),
            F.min("f_stat").alias("f_min"),
            F.max("f_stat").alias("f_max"),
            F.stddev_samp("f_stat").alias("f_std"),
            F.max(F.when(F.col("break_date") == F.lit(centre).cast("date"), F.col("f_stat"))).alias(
                "f_at_centre"
            ),
            peak.alias("peak"),
        )
        .withColumn("peak_date", F.col("peak.at"))
        .withColumn("peak_offset_days", F.date_diff("peak_date", F.lit(centre).cast("date")))
        .withColumn("f_range", F.col("f_max") - F.col("f_min"))
        .withColumn(
            "is_sharp",
            (F.col("n_points") > 3)
            & F.coalesce(F.col("f_range") > 1.5 * F.col("f_std"), F.lit(False)),
        )
        .withColumn("shape", rule_label([(F.col("f_range") < 10, "gradual")], "abrupt"))
        .withColumn("peak_ratio", ratio("f_max", "f_at_centre"))
        .drop("peak")
    )
