"""Station features and peaks."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import regression as G
from tidemark.plans import stations as S
from tidemark.registry.core import query, shaped
from tidemark.registry.recovery import COMMUTE_TREND_SQL, COMMUTE_VERDICT_SQL, commute_verdict
from tidemark.registry.views import BOROUGHS, YEARS, v_hourly, v_yearly, week

FEATURES_SQL = """p AS (SELECT station_id, station_name, borough,
         avg(entries) FILTER (WHERE hour(timestamp) IN (7, 8, 9)) AS peak_morning,
         avg(entries) FILTER (WHERE hour(timestamp) IN (17, 18, 19)) AS peak_evening,
         avg(entries) AS avg_daily_entries,
         count(*) FILTER (WHERE hour(timestamp) IN (7, 8, 9, 17, 18, 19)) AS peak_rows
       FROM v_hourly GROUP BY 1, 2, 3),
       i AS (SELECT station_id, stddev_samp(entries) / nullif(avg(entries), 0) AS entries_cv,
         avg(entries) FILTER (WHERE week(timestamp) = 4)
           / nullif(avg(entries) FILTER (WHERE week(timestamp) = 1), 0) AS recovery
       FROM v_hourly GROUP BY 1),
       sf AS (SELECT p.*, peak_morning / nullif(peak_evening, 0) AS commute_ratio, recovery,
         entries_cv FROM p JOIN i ON p.station_id = i.station_id WHERE peak_rows > 0)"""


def station_features(spark, d):
    return S.station_features(v_hourly(spark, d), later=4, earlier=1, period=week())


_FEATURE_COLUMNS = [
    "peak_morning",
    "peak_evening",
    "commute_ratio",
    "recovery",
    "entries_cv",
    "avg_daily_entries",
]


@query(
    "h4_station_features",
    f"WITH {FEATURES_SQL} SELECT station_id, station_name, borough, "
    + ", ".join(f"round({c}, 8) AS {c}" for c in _FEATURE_COLUMNS)
    + " FROM sf",
    "v_hourly",
)
def h4(spark, d):
    keys = {"station_id": None, "station_name": None, "borough": None}
    return shaped(station_features(spark, d), {**keys, **{c: 8 for c in _FEATURE_COLUMNS}})


@query(
    "h7_commute_ratio_by_period",
    """SELECT period AS week, station_id, station_name, borough, round(peak_morning, 8)
         AS peak_morning, round(peak_evening, 8) AS peak_evening,
       round(commute_ratio, 8) AS commute_ratio FROM weekly_ratios""",
    "weekly_ratios",
)
def h7(spark, d):
    out = S.commute_ratio_by_period(v_hourly(spark, d), week(), "week")
    return shaped(
        out,
        {
            "week": "long",
            "station_id": None,
            "station_name": None,
            "borough": None,
            "peak_morning": 8,
            "peak_evening": 8,
            "commute_ratio": 8,
        },
    )


@query(
    "h8_commute_trend",
    f"""SELECT period AS week, round(median, 8) AS median, round(mean, 8) AS mean,
        round(std, 8) AS std, round(commute_pct, 8) AS commute_pct, n_stations
        FROM ({COMMUTE_TREND_SQL})""",
    "weekly_ratios",
)
def h8(spark, d):
    ratios = S.commute_ratio_by_period(v_hourly(spark, d), week(), "week")
    return shaped(
        S.commute_trend(ratios, "week"),
        {"week": "long", "median": 8, "mean": 8, "std": 8, "commute_pct": 8, "n_stations": None},
    )


@query(
    "h8_commute_verdict",
    f"""WITH {COMMUTE_VERDICT_SQL} SELECT n, round(first_share, 8) AS first_share,
        round(last_share, 8) AS last_share, round(delta, 8) AS delta, round(slope, 8) AS slope,
        round(p_value, 7) AS p_value, verdict FROM cw""",
    "weekly_ratios",
)
def h8_verdict(spark, d):
    shares = {c: 8 for c in ("first_share", "last_share", "delta", "slope")}
    return shaped(commute_verdict(spark, d), {"n": None, **shares, "p_value": 7, "verdict": None})


@query(
    "h9_borough_medians",
    """SELECT borough, period AS week, round(median(commute_ratio), 8) AS median_ratio
       FROM weekly_ratios GROUP BY 1, 2""",
    "weekly_ratios",
)
def h9(spark, d):
    ratios = S.commute_ratio_by_period(v_hourly(spark, d), week(), "week")
    out = S.borough_medians(ratios, "week")
    return shaped(out, {"borough": None, "week": "long", "median_ratio": 8})


@query(
    "h13_scatter_table",
    f"""WITH {FEATURES_SQL} SELECT station_id, borough, round(commute_ratio, 8) AS commute_ratio,
        round(recovery, 8) AS recovery FROM sf
        WHERE commute_ratio BETWEEN 0.1 AND 3 AND recovery BETWEEN 0.5 AND 2""",
    "v_hourly",
)
def h13(spark, d):
    out = S.scatter_table(station_features(spark, d))
    return shaped(
        out, {"station_id": None, "borough": None, "commute_ratio": 8, "recovery": 8}
    )


_YEARLY_MEANS = (
    "ym AS (SELECT station_id, any_value(borough) AS borough, "
    "stddev_samp(entries) / nullif(avg(entries), 0) AS entries_cv, "
    "avg(entries) AS avg_daily_entries, "
    + ", ".join(f"avg(entries) FILTER (WHERE year = {y}) AS y{y}" for y in YEARS)
    + " FROM v_yearly GROUP BY 1)"
)


def yearly_stations(spark, d):
    """Station table from the yearly view: variation, mean and recovery 2000 over 1998."""
    at = lambda y: F.avg(F.when(F.col("year") == y, F.col("entries")))
    return (
        v_yearly(spark, d)
        .groupBy("station_id", "borough")
        .agg(
            F.try_divide(F.stddev_samp("entries"), F.avg("entries")).alias("entries_cv"),
            F.avg("entries").alias("avg_daily_entries"),
            F.try_divide(at(2000), at(1998)).alias("recovery"),
        )
    )


def yearly_features(spark, d, include_changes: bool = True):
    changes = (
        S.yearly_change(v_yearly(spark, d), F.col("year"), [1998, 1999, 2000])
        if include_changes
        else None
    )
    return S.feature_matrix(
        yearly_stations(spark, d),
        BOROUGHS,
        changes,
        numeric=["entries_cv", "avg_daily_entries"],
    )


@query(
    "h25_feature_matrix",
    f"""WITH {_YEARLY_MEANS}, f AS (SELECT station_id, entries_cv, avg_daily_entries,
          (y1999 - y1998) / nullif(y1998, 0) AS yoy_1999_vs_1998,
          (y2000 - y1999) / nullif(y1999, 0) AS yoy_2000_vs_1999,
          """
    + ", ".join(f"CAST(borough = '{b}' AS DOUBLE) AS \"borough_{b}\"" for b in BOROUGHS[1:])
    + """, y2000 / nullif(y1998, 0) AS recovery FROM ym)
        SELECT station_id, round(entries_cv, 8) AS entries_cv,
          round(avg_daily_entries, 8) AS avg_daily_entries,
          round(coalesce(yoy_1999_vs_1998, (SELECT median(yoy_1999_vs_1998) FROM f)), 8)
            AS yoy_1999_vs_1998,
          round(coalesce(yoy_2000_vs_1999, (SELECT median(yoy_2000_vs_1999) FROM f)), 8)
            AS yoy_2000_vs_1999, """
    + ", ".join(f'"borough_{b}"' for b in BOROUGHS[1:])
    + ", round(recovery, 8) AS recovery FROM f WHERE recovery IS NOT NULL",
    "v_yearly",
)
def h25(spark, d):
    matrix, columns = yearly_features(spark, d)
    return shaped(matrix, {"station_id": None, **{c: 8 for c in columns}, "recovery": 8})


@query(
    "h26_daily_station_series",
    """SELECT station_id, CAST(CAST(timestamp AS DATE) AS VARCHAR) AS date,
       round(sum(entries), 4) AS entries FROM v_hourly GROUP BY 1, 2""",
    "v_hourly",
)
def h26(spark, d):
    out = S.daily_entries(v_hourly(spark, d))
    return shaped(out, {"station_id": None, "date": "string", "entries": 4})


@query(
    "h27_period_means",
    """SELECT station_id, round(avg(entries) FILTER (WHERE week(timestamp) = 1), 8) AS y1,
       round(avg(entries) FILTER (WHERE week(timestamp) = 2), 8) AS y2,
       round(avg(entries) FILTER (WHERE week(timestamp) = 3), 8) AS y3,
       round(avg(entries) FILTER (WHERE week(timestamp) = 4), 8) AS y4,
       round(avg(entries) FILTER (WHERE week(timestamp) = 5), 8) AS y5
       FROM v_hourly GROUP BY 1""",
    "v_hourly",
)
def h27(spark, d):
    out = S.yearly_means(v_hourly(spark, d), week(), [1, 2, 3, 4, 5])
    return shaped(out, {"station_id": None, **{f"y{i}": 8 for i in range(1, 6)}})


@query(
    "j9_median_imputation",
    f"""WITH {FEATURES_SQL} SELECT station_id,
        round(coalesce(commute_ratio, (SELECT median(commute_ratio) FROM sf)), 8) AS commute_ratio,
        round(coalesce(recovery, (SELECT median(recovery) FROM sf)), 8) AS recovery FROM sf""",
    "v_hourly",
)
def j9(spark, d):
    rows = station_features(spark, d).select("station_id", "commute_ratio", "recovery")
    out = G.impute_medians(rows, ["commute_ratio", "recovery"])
    return shaped(out, {"station_id": None, "commute_ratio": 8, "recovery": 8})
