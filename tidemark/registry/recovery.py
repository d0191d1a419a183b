"""Recovery, shock, divergence and evidence tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.plans import evidence as E
from tidemark.plans import recovery as P
from tidemark.plans import stations as S
from tidemark.registry.core import query, shaped
from tidemark.registry.aggregates import _DISPERSION, _DISPERSION_COLUMNS
from tidemark.registry.tests import break_sql, sql_t_tail
from tidemark.registry.views import (
    BASELINE_WITH_FALLBACK,
    BREAK,
    CORE_MODES,
    ERAS,
    RECENT,
    SHOCK,
    monthly,
    v_daily,
    v_hourly,
    week,
)
from tidemark.runtime import cut_lineage

_MONTHLY_SHAPE = {
    "year": "long",
    "month": "long",
    "mode": None,
    "date": "string",
    "value": 6,
    "baseline": 6,
    "recovery_rate": 8,
}


@query(
    "h1_monthly_recovery",
    """SELECT year, month, mode, CAST(date AS VARCHAR) AS date, round(value, 6) AS value,
       round(baseline, 6) AS baseline, round(recovery_rate, 8) AS recovery_rate FROM monthly""",
    "monthly",
)
def h1(spark, d):
    return shaped(monthly(spark, d), _MONTHLY_SHAPE)


@query(
    "h1_yearly_summary",
    """SELECT year, mode, round(avg(recovery_rate), 8) AS avg_recovery_rate,
       round(min(recovery_rate), 8) AS min_recovery_rate,
       round(max(recovery_rate), 8) AS max_recovery_rate FROM monthly GROUP BY 1, 2""",
    "monthly",
)
def h1_yearly(spark, d):
    rates = {f"{m}_recovery_rate": 8 for m in ("avg", "min", "max")}
    return shaped(P.yearly_recovery(monthly(spark, d)), {"year": "long", "mode": None, **rates})


@query(
    "h2_recovery_with_fallback",
    """WITH a AS (SELECT mode, avg(value) AS v FROM v_daily WHERE date = DATE '1995-01-01' GROUP BY 1),
       b AS (SELECT mode, avg(value) AS v FROM v_daily WHERE year(date) = 1998 GROUP BY 1),
       m AS (SELECT year(date) AS year, month(date) AS month, mode, avg(value) AS value
             FROM v_daily GROUP BY 1, 2, 3)
       SELECT m.year, m.month, m.mode, CAST(make_date(m.year, m.month, 1) AS VARCHAR) AS date,
         round(m.value, 6) AS value, round(coalesce(a.v, b.v), 6) AS baseline,
         round(m.value / coalesce(a.v, b.v), 8) AS recovery_rate
       FROM m LEFT JOIN a ON m.mode = a.mode LEFT JOIN b ON m.mode = b.mode""",
    "v_daily",
)
def h2(spark, d):
    return shaped(P.monthly_recovery(v_daily(spark, d), BASELINE_WITH_FALLBACK), _MONTHLY_SHAPE)


@query(
    "h3_mode_curve",
    """SELECT strftime(date, '%Y-%m') AS year_month, mode, round(recovery_rate, 8) AS recovery_rate
       FROM monthly WHERE lower(mode) = lower('2-High') ORDER BY 1""",
    "monthly",
)
def h3(spark, d):
    curve = P.mode_curve(monthly(spark, d), "2-High")
    return shaped(curve, {"year_month": None, "mode": None, "recovery_rate": 8})


@query(
    "h5_shock_recovery",
    """WITH l AS (SELECT mode, min(recovery_rate) AS depth, arg_min(date, recovery_rate) AS low
         FROM monthly WHERE date BETWEEN DATE '1995-03-01' AND DATE '1995-06-30' GROUP BY 1),
       c AS (SELECT mode, avg(recovery_rate) AS now FROM monthly
         WHERE date BETWEEN DATE '2001-01-01' AND DATE '2001-07-31' GROUP BY 1)
       SELECT l.mode, round(depth, 8) AS shock_depth, strftime(low, '%Y-%m') AS shock_month,
         round(now, 8) AS current_level,
         round((min(m.date) FILTER (WHERE m.date >= low AND m.recovery_rate >= 0.8) - low) / 30.0, 8)
           AS months_to_80pct, now >= 1.0 AS fully_recovered
       FROM l JOIN c ON l.mode = c.mode JOIN monthly m ON m.mode = l.mode
       GROUP BY l.mode, depth, low, now""",
    "monthly",
)
def h5(spark, d):
    out = P.shock_recovery(monthly(spark, d), SHOCK, RECENT)
    return shaped(
        out,
        {
            "mode": None,
            "shock_depth": 8,
            "shock_month": None,
            "current_level": 8,
            "months_to_80pct": 8,
            "fully_recovered": None,
        },
    )


@query(
    "h6_divergence_without_modes",
    _DISPERSION.format(where="WHERE mode NOT IN ('5-LOW')"),
    "monthly",
)
def h6(spark, d):
    return shaped(P.structural_divergence(monthly(spark, d), ["5-LOW"]), _DISPERSION_COLUMNS)


@query(
    "h6_divergence_by_era",
    """SELECT era, round(avg(s), 8) AS mean_value, count(s) AS n FROM
       (SELECT date, stddev_samp(recovery_rate) AS s FROM monthly WHERE mode <> '5-LOW' GROUP BY 1) x
       JOIN ("""
    + " UNION ALL ".join(
        f"SELECT '{n}' AS era, DATE '{a}' AS a, DATE '{b}' AS b" for n, (a, b) in ERAS.items()
    )
    + ") e ON x.date BETWEEN e.a AND e.b GROUP BY 1",
    "monthly",
)
def h6_eras(spark, d):
    spread = P.structural_divergence(monthly(spark, d), ["5-LOW"])
    return shaped(P.divergence_by_era(spread, ERAS), {"era": None, "mean_value": 8, "n": None})


_BREAK_SQL = break_sql([(str(BREAK), "quadratic")], CORE_MODES)
_BREAK_VERDICT = """SELECT count(*) AS n_modes, count(*) FILTER (WHERE p_value < 0.05) AS n_breaks,
       CASE WHEN count(*) FILTER (WHERE p_value < 0.05) >= 2 THEN 'PASS'
            WHEN count(*) FILTER (WHERE p_value < 0.05) = 1 THEN 'WEAK' ELSE 'FAIL' END AS verdict
       FROM q"""


@query("h10_break_evidence", f"WITH {_BREAK_SQL} {_BREAK_VERDICT}", "monthly")
def h10(spark, d):
    return E.break_verdict(E.break_evidence(monthly(spark, d), CORE_MODES, BREAK))


_ORDER = """rr AS (SELECT mode, avg(recovery_rate) AS rate FROM monthly
         WHERE date >= DATE '2001-01-01' GROUP BY 1),
       o AS (SELECT (coalesce(max(rate) FILTER (WHERE mode = '1-URGENT'), 0)
                    + coalesce(max(rate) FILTER (WHERE mode = '2-HIGH'), 0)) / 2 AS rail_rate,
               coalesce(max(rate) FILTER (WHERE mode = '3-MEDIUM'), 0) AS subway_rate,
               coalesce(max(rate) FILTER (WHERE mode = '4-NOT SPECIFIED'), 0) AS bus_rate FROM rr),
       ov AS (SELECT *, rail_rate > subway_rate AND subway_rate > bus_rate AS tiers_ok,
               CASE WHEN rail_rate > subway_rate AND subway_rate > bus_rate THEN 'PASS'
                    WHEN rail_rate > subway_rate THEN 'WEAK' ELSE 'FAIL' END AS verdict FROM o)"""


def _order(months):
    ranking = E.recent_ranking(months, RECENT[0])
    return E.order_verdict(ranking, ["1-URGENT", "2-HIGH"], "3-MEDIUM", "4-NOT SPECIFIED")


@query(
    "h11_mode_order",
    f"""WITH {_ORDER} SELECT round(rail_rate, 8) AS rail_rate, round(subway_rate, 8) AS subway_rate,
        round(bus_rate, 8) AS bus_rate, tiers_ok, verdict FROM ov""",
    "monthly",
)
def h11(spark, d):
    return shaped(
        _order(monthly(spark, d)),
        {"rail_rate": 8, "subway_rate": 8, "bus_rate": 8, "tiers_ok": None, "verdict": None},
    )


@query(
    "h11_centre_against_outer",
    """WITH r AS (SELECT station_id, borough, avg(entries) FILTER (WHERE w = 4)
               / nullif(avg(entries) FILTER (WHERE w = 1), 0) AS rec,
               count(*) FILTER (WHERE h) AS peak FROM (SELECT x.*, hour(timestamp)
                 IN (7, 8, 9, 17, 18, 19) AS h, week(timestamp) AS w FROM v_hourly x)
             GROUP BY 1, 2)
       SELECT round(median(rec) FILTER (WHERE borough = 'B0'), 8) AS centre_median,
         round(median(rec) FILTER (WHERE borough <> 'B0'), 8) AS outer_median,
         median(rec) FILTER (WHERE borough = 'B0') > median(rec) FILTER (WHERE borough <> 'B0')
           AS centre_stronger FROM r WHERE peak > 0""",
    "v_hourly",
)
def h11_centre(spark, d):
    features = S.station_features(v_hourly(spark, d), later=4, earlier=1, period=week())
    out = S.borough_recovery_gap(features, "B0")
    return shaped(out, {"centre_median": 8, "outer_median": 8, "centre_stronger": None})


COMMUTE_TREND_SQL = """SELECT period, median(commute_ratio) AS median, avg(commute_ratio) AS mean,
       stddev_samp(commute_ratio) AS std,
       avg(CAST(commute_ratio BETWEEN 0.7 AND 1.3 AS DOUBLE)) AS commute_pct,
       count(commute_ratio) AS n_stations FROM weekly_ratios GROUP BY 1"""

COMMUTE_VERDICT_SQL = f"""ct AS ({COMMUTE_TREND_SQL}),
       cf AS (SELECT count(*) AS n, arg_min(commute_pct, period) AS first_share,
                arg_max(commute_pct, period) AS last_share, regr_slope(commute_pct, period) AS slope,
                regr_r2(commute_pct, period) AS r2 FROM ct),
       cp AS (SELECT *, sign(slope) * sqrt(r2 * (n - 2) / (1 - r2)) AS t FROM cf),
       cv AS (SELECT n, first_share, last_share, last_share - first_share AS delta, slope,
                {sql_t_tail('t', '(n - 2)')} AS p_value FROM cp),
       cw AS (SELECT *, CASE WHEN n < 2 THEN 'NO DATA' WHEN slope < 0 AND p_value < 0.05 THEN 'PASS'
                WHEN slope < 0 THEN 'WEAK' ELSE 'FAIL' END AS verdict FROM cv)"""


def commute_verdict(spark, d):
    ratios = S.commute_ratio_by_period(v_hourly(spark, d), week(), "week")
    return S.commute_verdict(S.commute_trend(ratios, "week"), "week")


@query(
    "h12_overall_verdict",
    f"""WITH {_BREAK_SQL}, bv AS ({_BREAK_VERDICT}), {COMMUTE_VERDICT_SQL}, {_ORDER},
        v AS (SELECT 'L1' AS layer, verdict FROM bv UNION ALL SELECT 'L2', verdict FROM cw
              UNION ALL SELECT 'L3', verdict FROM ov)
        SELECT count(*) AS layers, count(*) FILTER (WHERE verdict = 'PASS') AS passed,
          string_agg(layer || '=' || verdict, '; ' ORDER BY layer) AS detail,
          CASE count(*) FILTER (WHERE verdict = 'PASS') WHEN 3 THEN 'strong' WHEN 2 THEN 'medium'
               WHEN 1 THEN 'weak' ELSE 'none' END AS support FROM v""",
    "monthly weekly_ratios",
)
def h12(spark, d):
    months = cut_lineage(monthly(spark, d))  # read by two layers
    return E.overall_verdict(
        {
            "L1": E.break_verdict(E.break_evidence(months, CORE_MODES, BREAK)),
            "L2": commute_verdict(spark, d),
            "L3": _order(months),
        }
    )
