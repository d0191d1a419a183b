"""Station level features from an hourly table with columns ``timestamp``, ``station_id``,
``station_name``, ``borough``, ``entries`` (and ``transfers``)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.columns import (
    inside,
    masked_mean,
    parse_wall_clock,
    ratio,
    rule_label,
    share,
    to_int,
)
from tidemark.operators.inference import line_fit
from tidemark.operators.order import with_keys
from tidemark.operators.quantiles import exact_medians
from tidemark.operators.regression import impute_medians, one_hot
from tidemark.operators.rollup import without_null_keys
from tidemark.runtime import cut_lineage

MORNING_HOURS = (7, 8, 9)
EVENING_HOURS = (17, 18, 19)
STATION = ("station_id", "station_name", "borough")
TIMESTAMP_FORMAT = "M/d/yyyy h:m:s a"  # one or two digits each
NUMERIC_FEATURES = (
    "commute_ratio",
    "entries_cv",
    "peak_morning",
    "peak_evening",
    "avg_daily_entries",
)


def hourly_rollup(raw: DataFrame) -> DataFrame:
    """Typed sums per hour and station from the all-text table; unreadable numbers add nothing."""
    return (
        raw.select(
            parse_wall_clock("transit_timestamp", TIMESTAMP_FORMAT).alias("timestamp"),
            F.col("station_complex_id").alias("station_id"),
            F.col("station_complex").alias("station_name"),
            "borough",
            to_int("ridership").alias("entries"),
            to_int("transfers").alias("transfers"),
        )
        .groupBy("timestamp", *STATION)
        .agg(F.sum("entries").alias("entries"), F.sum("transfers").alias("transfers"))
    )


def _peaks() -> dict[str, Column]:
    hour = F.hour("timestamp")
    return {
        "peak_morning": masked_mean(hour.isin(*MORNING_HOURS), "entries"),
        "peak_evening": masked_mean(hour.isin(*EVENING_HOURS), "entries"),
    }


def station_features(hourly: DataFrame, later: int, earlier: int, period: Column | None = None) -> DataFrame:
    """Peaks, commute ratio, recovery ``later`` / ``earlier``, variation and mean per station.

    One scan and one wide shuffle by the full station key; the per-id figures (a renamed station
    keeps one row per name) are combined from counts, means and squared deviations in a window
    over those few rows. ``avg_daily_entries`` is the mean of hourly rows. Only stations with at
    least one peak-hour row are returned. ``period`` defaults to the calendar year.
    """
    period = F.year("timestamp") if period is None else period
    hour = F.hour("timestamp")
    value = F.col("entries").cast("double")
    old, new = F.when(period == earlier, value), F.when(period == later, value)
    in_peak = hour.isin(*MORNING_HOURS, *EVENING_HOURS)
    grouped = (
        without_null_keys(hourly, ["station_id"])
        .groupBy(*STATION)
        .agg(
            *[c.alias(name) for name, c in _peaks().items()],
            F.count_if(in_peak).alias("_peak_rows"),
            F.avg(value).alias("avg_daily_entries"),
            F.count(value).alias("_n"),
            F.var_pop(value).alias("_v"),
            F.sum(old).alias("_so"),
            F.count(old).alias("_co"),
            F.sum(new).alias("_sn"),
            F.count(new).alias("_cn"),
        )
    )
    by_id = Window.partitionBy("station_id")
    n = F.sum("_n").over(by_id)
    combined = grouped.withColumn(
        "_mean", F.try_divide(F.sum(F.col("avg_daily_entries") * F.col("_n")).over(by_id), n)
    )
    gap = F.col("avg_daily_entries") - F.col("_mean")
    squares = F.sum(F.col("_n") * (F.col("_v") + gap * gap)).over(by_id)
    total = lambda c: F.sum(c).over(by_id)
    return (
        combined.withColumn("_std", F.sqrt(F.try_divide(squares, n - 1)))
        .withColumn(
            "recovery",
            ratio(
                F.try_divide(total("_sn"), total("_cn")), F.try_divide(total("_so"), total("_co"))
            ),
        )
        .where(F.col("_peak_rows") > 0)
        .na.drop(subset=list(STATION))
        .select(
            *STATION,
            "peak_morning",
            "peak_evening",
            ratio("peak_morning", "peak_evening").alias("commute_ratio"),
            "recovery",
            ratio("_std", "_mean").alias("entries_cv"),
            "avg_daily_entries",
        )
    )


def commute_ratio_by_period(hourly: DataFrame, period: Column, name: str = "year") -> DataFrame:
    """Peak means and their ratio per station and period; ratios outside (0.1, 10) are dropped."""
    return (
        hourly.withColumn(name, period)
        .groupBy(name, *STATION)
        .agg(*[c.alias(n) for n, c in _peaks().items()])
        .na.drop(subset=list(STATION))
        .withColumn("commute_ratio", ratio("peak_morning", "peak_evening"))
        .where(inside("commute_ratio", 0.1, 10))
    )


def commute_trend(ratios: DataFrame, period: str = "year") -> DataFrame:
    """Distribution of the ratio and share of commuter stations (0.7 to 1.3) per period."""
    r = F.col("commute_ratio")
    ratios = cut_lineage(ratios.select(period, r))
    means = ratios.groupBy(period).agg(
        F.avg(r).alias("mean"),
        F.stddev_samp(r).alias("std"),
        share(r.between(0.7, 1.3)).alias("commute_pct"),
        F.count(r).alias("n_stations"),
    )
    return with_keys(means, exact_medians(ratios, [period], {"median": r}), [period], "left").select(
        period, "median", "mean", "std", "commute_pct", "n_stations"
    )


def commute_verdict(trend: DataFrame, period: str = "year") -> DataFrame:
    """Change and slope of the commuter share over the periods, with a rule verdict."""
    rows = trend.select(F.col(period).cast("double").alias("x"), "commute_pct")
    ends = [
        F.min_by("commute_pct", "x").alias("first_share"),
        F.max_by("commute_pct", "x").alias("last_share"),
    ]
    fit = line_fit(rows, [], "x", "commute_pct", ends)
    falling = F.col("slope") < 0
    return (
        fit.withColumn("delta", F.col("last_share") - F.col("first_share"))
        .withColumn(
            "verdict",
            rule_label(
                [
                    (F.col("n") < 2, "NO DATA"),
                    (falling & (F.col("p_value") < 0.05), "PASS"),
                    (falling, "WEAK"),
                ],
                "FAIL",
            ),
        )
        .select("n", "first_share", "last_share", "delta", "slope", "p_value", "verdict")
    )


def borough_medians(ratios: DataFrame, period: str = "year") -> DataFrame:
    return exact_medians(ratios, ["borough", period], {"median_ratio": F.col("commute_ratio")})


def scatter_table(
    stations: DataFrame,
    ratio_range: tuple[float, float] = (0.1, 3.0),
    recovery_range: tuple[float, float] = (0.5, 2.0),
) -> DataFrame:
    return stations.na.drop(subset=["commute_ratio", "recovery"]).where(
        F.col("commute_ratio").between(*ratio_range) & F.col("recovery").between(*recovery_range)
    )


def daily_entries(hourly: DataFrame) -> DataFrame:
    """Sum per station and day."""
    return hourly.groupBy("station_id", F.to_date("timestamp").alias("date")).agg(
        F.sum("entries").alias("entries")
    )


def yearly_means(
    activity: DataFrame, year: Column, years: Sequence[int], value: str = "entries"
) -> DataFrame:
    """Mean value per station with one column ``y<year>`` per known year."""
    return activity.groupBy("station_id").agg(
        *[F.avg(F.when(year == y, F.col(value))).alias(f"y{y}") for y in years]
    )


def yearly_change(activity: DataFrame, year: Column, years: Sequence[int], value: str = "entries"):
    """Relative change between neighbouring years, one column per pair."""
    means = yearly_means(activity, year, years, value)
    changes = [
        ratio(F.col(f"y{b}") - F.col(f"y{a}"), F.col(f"y{a}")).alias(f"yoy_{b}_vs_{a}")
        for a, b in zip(years, years[1:])
    ]
    return means.select("station_id", *changes)


def feature_matrix(
    stations: DataFrame,
    boroughs: Sequence[str],
    changes: DataFrame | None = None,
    label: str = "recovery",
    numeric: Sequence[str] = NUMERIC_FEATURES,
) -> tuple[DataFrame, list[str]]:
    """Numeric features, optional yearly changes and borough indicators; medians fill the gaps and
    rows without a label are dropped. Returns the table and its feature columns.

    The yearly changes can reproduce a label built from the same years exactly; leave ``changes``
    out to avoid that leak.
    """
    columns = list(numeric)
    missing = [c for c in columns if c not in stations.columns]
    rows = stations.withColumns({c: F.lit(None).cast("double") for c in missing}) if missing else stations
    if changes is not None:
        rows = rows.join(changes, "station_id", "left")
        columns += [c for c in changes.columns if c != "station_id"]
    rows = rows.withColumn("borough", F.coalesce("borough", F.lit("Unknown")))
    rows = one_hot(rows, "borough", boroughs)
    indicators = [f"borough_{b}" for b in sorted(boroughs)[1:]]
    filled = impute_medians(rows, columns)
    columns += indicators
    return (
        filled.select("station_id", *columns, label).na.drop(subset=[*columns, label]),
        columns,
    )


def borough_recovery_gap(stations: DataFrame, centre: str) -> DataFrame:
    """Median recovery of the centre borough against the others."""
    is_centre = F.col("borough") == F.lit(centre)
    sides = {
        "centre_median": F.when(is_centre, F.col("recovery")),
        "outer_median": F.when(~is_centre, F.col("recovery")),
    }
    return exact_medians(stations, [], sides).withColumn("centre_stronger", F.col("centre_median") > F.col("outer_median"))

