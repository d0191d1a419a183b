"""Ordered series."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import series as S
from tidemark.plans.recovery import shock_recovery, structural_divergence
from tidemark.plans.stations import daily_entries, yearly_change
from tidemark.registry.core import query, shaped
from tidemark.registry.views import (
    BREAK,
    RECENT,
    SHOCK,
    YEARS,
    monthly,
    v_hourly,
    v_series,
    v_yearly,
)


@query(
    "f1_time_index",
    f"""SELECT mode, CAST(date AS VARCHAR) AS date, date >= DATE '{BREAK}' AS post,
        row_number() OVER (PARTITION BY mode, date >= DATE '{BREAK}' ORDER BY date) - 1 AS t
        FROM monthly""",
    "monthly",
)
def f1(spark, d):
    rows = monthly(spark, d).withColumn("post", F.col("date") >= F.lit(BREAK))
    out = S.time_index(rows, ["mode", "post"], "date")
    return shaped(out, {"mode": None, "date": "string", "post": None, "t": "long"})


@query(
    "f2_lag_features",
    """SELECT * FROM (SELECT station_id, CAST(date AS VARCHAR) AS date, value,
       lag(value, 1) OVER w AS lag_1, lag(value, 2) OVER w AS lag_2, lag(value, 3) OVER w AS lag_3,
       lag(value, 7) OVER w AS lag_7, lag(value, 14) OVER w AS lag_14 FROM v_series
       WINDOW w AS (PARTITION BY station_id ORDER BY date)) WHERE lag_14 IS NOT NULL""",
    "v_series",
)
def f2(spark, d):
    out = S.lag_features(v_series(spark, d), ["station_id"], "date", "value", [1, 2, 3, 7, 14])
    lags = {f"lag_{k}": None for k in (1, 2, 3, 7, 14)}
    return shaped(out, {"station_id": None, "date": "string", "value": None, **lags})


@query(
    "f3_time_to_threshold",
    """WITH low AS (SELECT mode, arg_min(date, recovery_rate) AS at FROM monthly
         WHERE date BETWEEN DATE '1995-03-01' AND DATE '1995-06-30' GROUP BY 1)
       SELECT l.mode, CAST(l.at AS VARCHAR) AS trough,
         round((min(m.date) FILTER (WHERE m.date >= l.at AND m.recovery_rate >= 1.2) - l.at)
           / 30.0, 8) AS months FROM low l JOIN monthly m ON m.mode = l.mode GROUP BY l.mode, l.at""",
    "monthly",
)
def f3(spark, d):
    """Same step as the shock table, with another threshold."""
    rows = monthly(spark, d)
    shock = shock_recovery(rows, SHOCK, RECENT, threshold=1.2)
    return shock.select(
        "mode",
        F.concat("shock_month", F.lit("-01")).alias("trough"),
        F.round("months_to_80pct", 8).alias("months"),
    )


@query(
    "f4_yearly_change",
    "SELECT station_id, "
    + ", ".join(
        f"round((y{b} - y{a}) / nullif(y{a}, 0), 8) AS yoy_{b}_vs_{a}"
        for a, b in zip(YEARS, YEARS[1:])
    )
    + " FROM (SELECT station_id, "
    + ", ".join(f"avg(CASE WHEN year = {y} THEN entries END) AS y{y}" for y in YEARS)
    + " FROM v_yearly GROUP BY 1)",
    "v_yearly",
)
def f4(spark, d):
    out = yearly_change(v_yearly(spark, d), F.col("year"), YEARS)
    return shaped(out, {c: None if c == "station_id" else 8 for c in out.columns})


_EDGE = "(lag(recovery_rate, 6) OVER w + lead(recovery_rate, 6) OVER w) / 2"


@query(
    "f5_seasonal_decomposition",
    f"""WITH a AS (SELECT mode, date, recovery_rate,
            (row_number() OVER w - 1) % 12 AS position, count(*) OVER (PARTITION BY mode) AS n,
            CASE WHEN lag(recovery_rate, 6) OVER w IS NOT NULL AND lead(recovery_rate, 6) OVER w IS NOT NULL THEN
              ({_EDGE} + {' + '.join(f'lag(recovery_rate, {k}) OVER w + lead(recovery_rate, {k}) OVER w' for k in range(1, 6))}
               + recovery_rate) / 12 END AS trend
            FROM monthly WINDOW w AS (PARTITION BY mode ORDER BY date)),
          b AS (SELECT mode, position, avg(recovery_rate - trend) AS effect FROM a GROUP BY 1, 2),
          c AS (SELECT mode, avg(effect) AS level FROM b GROUP BY 1)
        SELECT a.mode, CAST(a.date AS VARCHAR) AS date, position AS position,
          round(trend, 8) AS trend, round(effect - level, 8) AS seasonal,
          round(recovery_rate - trend - (effect - level), 8) AS resid
        FROM a JOIN b USING (mode, position) JOIN c USING (mode) WHERE n >= 24""",
    "monthly",
)
def f5(spark, d):
    out = S.seasonal_decompose(monthly(spark, d), ["mode"], "date", "recovery_rate")
    return shaped(
        out,
        {
            "mode": None,
            "date": "string",
            "position": "long",
            "trend": 8,
            "seasonal": 8,
            "resid": 8,
        },
    )


@query(
    "f6_position_in_group",
    """SELECT borough, station_id, row_number() OVER (PARTITION BY borough ORDER BY station_id) - 1
       AS position FROM (SELECT DISTINCT borough, station_id FROM v_hourly)""",
    "v_hourly",
)
def f6(spark, d):
    members = v_hourly(spark, d).select("borough", "station_id").distinct()
    out = S.position_in_group(members, "borough", "station_id")
    return shaped(out, {"borough": None, "station_id": None, "position": "long"})


@query(
    "f7_hold_out",
    """SELECT station_id, CAST(date AS VARCHAR) AS date, from_end, from_end <= 60 AS is_test FROM
       (SELECT *, row_number() OVER (PARTITION BY station_id ORDER BY date DESC) AS from_end,
               count(*) OVER (PARTITION BY station_id) AS n FROM v_series) WHERE n >= 90""",
    "v_series",
)
def f7(spark, d):
    out = S.hold_out(v_series(spark, d), ["station_id"], "date", 60)
    return shaped(
        out, {"station_id": None, "date": "string", "from_end": "long", "is_test": None}
    )


@query(
    "f8_training_tail",
    """SELECT station_id, CAST(date AS VARCHAR) AS date, entries FROM (
         SELECT station_id, date, entries,
           row_number() OVER (PARTITION BY station_id ORDER BY date DESC) AS r,
           count(*) OVER (PARTITION BY station_id) AS n
         FROM (SELECT station_id, CAST(timestamp AS DATE) AS date,
                      CAST(sum(CAST(entries AS DECIMAL(18, 2))) AS DOUBLE) AS entries
               FROM v_hourly GROUP BY 1, 2)) WHERE n >= 15 AND r > 5 AND r <= 12""",
    "v_hourly",
)
def f8(spark, d):
    daily = daily_entries(v_hourly(spark, d).withColumn("entries", F.col("entries").cast("decimal(18,2)")))
    split = S.hold_out(daily, ["station_id"], "date", 5, slack=10)
    out = S.training_tail(split, ["station_id"], 5, 7)
    return shaped(out, {"station_id": None, "date": "string", "entries": "double"})


@query(
    "f9_deviation_band",
    """SELECT CAST(date AS VARCHAR) AS date, round(m - s, 8) AS band_low, round(m + s, 8) AS band_high
       FROM (SELECT date, avg(recovery_rate) AS m, stddev_samp(recovery_rate) AS s
             FROM monthly GROUP BY 1)""",
    "monthly",
)
def f9(spark, d):
    spread = structural_divergence(monthly(spark, d))
    out = S.deviation_band(spread, "mean_recovery", "dispersion_std")
    return shaped(out, {"date": "string", "band_low": 8, "band_high": 8})


@query(
    "c21_first_last_tail",
    """SELECT mode, round(arg_min(recovery_rate, date), 8) AS first_value,
       round(arg_max(recovery_rate, date), 8) AS last_value,
       round(avg(recovery_rate) FILTER (WHERE r <= 6), 8) AS tail_mean FROM
       (SELECT *, row_number() OVER (PARTITION BY mode ORDER BY date DESC) AS r FROM monthly)
       GROUP BY 1""",
    "monthly",
)
def c21(spark, d):
    out = S.first_and_last(monthly(spark, d), ["mode"], "date", "recovery_rate")
    return shaped(out, {"mode": None, "first_value": 8, "last_value": 8, "tail_mean": 8})
