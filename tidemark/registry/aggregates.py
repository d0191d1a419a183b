"""Grouped summaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import columns as C
from tidemark.functions.text import clean_text
from tidemark.operators import quantiles as Q
from tidemark.operators import rollup as R
from tidemark.operators.series import era_means
from tidemark.plans.recovery import structural_divergence
from tidemark.plans.stations import EVENING_HOURS, MORNING_HOURS, hourly_rollup
from tidemark.registry.core import query, shaped
from tidemark.registry.views import (
    CLEAN,
    ERAS,
    monthly,
    table,
    v_daily,
    v_hourly,
    v_postings,
    v_raw_text,
    v_yearly,
)


@query(
    "c1_daily_rollup",
    "SELECT CAST(date AS VARCHAR) AS date, mode, value FROM v_daily",
    "v_daily",
)
def c1(spark, d):
    return shaped(v_daily(spark, d), {"date": "string", "mode": None, "value": None})


@query(
    "c2_hourly_rollup",
    """SELECT strftime(date_trunc('hour', try_strptime(transit_timestamp,
         '%m/%d/%Y %I:%M:%S %p')), '%Y-%m-%d %H') AS hour, station_complex_id AS station_id,
       CAST(sum(TRY_CAST(ridership AS INTEGER)) AS DOUBLE) AS entries,
       CAST(sum(TRY_CAST(transfers AS INTEGER)) AS DOUBLE) AS transfers
       FROM v_raw_text GROUP BY 1, 2""",
    "v_raw_text",
)
def c2(spark, d):
    rolled = hourly_rollup(v_raw_text(spark, d)).withColumn(
        "hour", F.date_format("timestamp", "yyyy-MM-dd HH")
    )
    return shaped(
        R.sum_by(rolled, ["hour", "station_id"], ["entries", "transfers"]),
        {"hour": None, "station_id": None, "entries": "double", "transfers": "double"},
    )


@query(
    "c3_monthly_means",
    """SELECT year(date) AS year, month(date) AS month, mode, round(avg(value), 6) AS value
       FROM v_daily GROUP BY 1, 2, 3""",
    "v_daily",
)
def c3(spark, d):
    daily = v_daily(spark, d).withColumns({"year": F.year("date"), "month": F.month("date")})
    return shaped(
        R.mean_by(daily, ["year", "month", "mode"], "value"),
        {"year": "long", "month": "long", "mode": None, "value": 6},
    )


@query(
    "c4_yearly_spread",
    """SELECT year, mode, round(avg(recovery_rate), 8) AS avg_recovery_rate,
       round(min(recovery_rate), 8) AS min_recovery_rate,
       round(max(recovery_rate), 8) AS max_recovery_rate FROM monthly GROUP BY 1, 2""",
    "monthly",
)
def c4(spark, d):
    spread = R.spread_by(monthly(spark, d), ["year", "mode"], "recovery_rate")
    rates = {f"{m}_recovery_rate": 8 for m in ("avg", "min", "max")}
    return shaped(spread, {"year": "long", "mode": None, **rates})


@query(
    "c5_variation",
    """SELECT station_id, round(avg(entries), 8) AS mean, round(stddev_samp(entries), 8) AS std,
       round(stddev_samp(entries) / nullif(avg(entries), 0), 8) AS cv FROM v_hourly GROUP BY 1""",
    "v_hourly",
)
def c5(spark, d):
    table_ = R.variation_by(v_hourly(spark, d), ["station_id"], "entries")
    return shaped(table_, {"station_id": None, "mean": 8, "std": 8, "cv": 8})


_DISPERSION = """SELECT year, month, CAST(date AS VARCHAR) AS date,
       round(stddev_samp(recovery_rate), 8) AS dispersion_std,
       round(max(recovery_rate) - min(recovery_rate), 8) AS dispersion_range,
       round(quantile_cont(recovery_rate, 0.75) - quantile_cont(recovery_rate, 0.25), 8)
         AS dispersion_iqr,
       round(avg(recovery_rate), 8) AS mean_recovery, count(recovery_rate) AS n_modes,
       round(stddev_samp(recovery_rate) / nullif(avg(recovery_rate), 0), 8) AS dispersion_cv
       FROM monthly {where} GROUP BY 1, 2, 3"""

_DISPERSION_COLUMNS = {
    "year": "long",
    "month": "long",
    "date": "string",
    "dispersion_std": 8,
    "dispersion_range": 8,
    "dispersion_iqr": 8,
    "mean_recovery": 8,
    "n_modes": None,
    "dispersion_cv": 8,
}


@query("c6_dispersion", _DISPERSION.format(where=""), "monthly")
def c6(spark, d):
    return shaped(structural_divergence(monthly(spark, d)), _DISPERSION_COLUMNS)


@query(
    "c7_masked_means",
    """SELECT station_id, round(avg(CASE WHEN hour(timestamp) IN (7, 8, 9) THEN entries END), 8)
         AS peak_morning,
       round(avg(CASE WHEN hour(timestamp) IN (17, 18, 19) THEN entries END), 8) AS peak_evening
       FROM v_hourly GROUP BY 1""",
    "v_hourly",
)
def c7(spark, d):
    hour = F.hour("timestamp")
    masks = {
        "peak_morning": hour.isin(*MORNING_HOURS),
        "peak_evening": hour.isin(*EVENING_HOURS),
    }
    means = R.masked_means_by(v_hourly(spark, d), ["station_id"], "entries", masks)
    return shaped(means, {"station_id": None, "peak_morning": 8, "peak_evening": 8})


@query(
    "c8_c9_counts_and_coverage",
    """SELECT count(DISTINCT mode) AS n_mode, count(DISTINCT date) AS n_date,
       CAST(min(date) AS VARCHAR) AS first_date, CAST(max(date) AS VARCHAR) AS last_date
       FROM v_daily""",
    "v_daily",
)
def c8_c9(spark, d):
    daily = v_daily(spark, d)
    counts = R.distinct_counts(daily, ["mode", "date"]).withColumn("one", F.lit(1))
    dates = R.date_coverage(daily, "date").withColumn("one", F.lit(1))
    return shaped(
        counts.join(dates, "one"),
        {"n_mode": None, "n_date": None, "first_date": "string", "last_date": "string"},
    )


@query(
    "c10_frequency",
    "SELECT work_type, count(*) AS n FROM v_postings WHERE work_type IS NOT NULL GROUP BY 1",
    "v_postings",
)
def c10(spark, d):
    return R.frequency(v_postings(spark, d), "work_type")


@query(
    "c11_shares",
    """SELECT round(avg(CAST(remote_allowed = 1 AS DOUBLE)), 8) AS remote,
       round(avg(CAST(length(description) > 1000 AS DOUBLE)), 8) AS long_text FROM v_postings""",
    "v_postings",
)
def c11(spark, d):
    out = R.shares(
        v_postings(spark, d),
        {"remote": F.col("remote_allowed") == 1, "long_text": F.length("description") > 1000},
    )
    return shaped(out, {"remote": 8, "long_text": 8})


@query(
    "c12_medians",
    """SELECT o_orderpriority AS mode, count(*) AS n, round(median(o_totalprice), 4) AS median
       FROM orders GROUP BY 1
       UNION ALL SELECT 'all', count(*), round(median(o_totalprice), 4) FROM orders""",
)
def c12(spark, d):
    orders = table(spark, d, "orders").withColumnRenamed("o_orderpriority", "mode")
    grouped = Q.exact_median(orders, ["mode"], "o_totalprice", "median")
    overall = Q.exact_median(orders, [], "o_totalprice", "median").withColumn("mode", F.lit("all"))
    both = grouped.unionByName(overall)
    return shaped(both, {"mode": None, "n": None, "median": 4})


@query(
    "c13_grouped_quantiles",
    """SELECT l_returnflag, l_linestatus, count(*) AS n,
       round(quantile_cont(l_extendedprice, 0.25), 4) AS q25,
       round(quantile_cont(l_extendedprice, 0.5), 4) AS q50,
       round(quantile_cont(l_extendedprice, 0.75), 4) AS q75 FROM lineitem GROUP BY 1, 2""",
)
def c13(spark, d):
    out = Q.exact_quantiles(
        table(spark, d, "lineitem"),
        ["l_returnflag", "l_linestatus"],
        "l_extendedprice",
        [0.25, 0.5, 0.75],
        ["q25", "q50", "q75"],
    )
    keys = {"l_returnflag": None, "l_linestatus": None, "n": None}
    return shaped(out, {**keys, "q25": 4, "q50": 4, "q75": 4})


@query(
    "c14_winsor_bounds",
    """SELECT o_orderkey, round(least(greatest(o_totalprice, b.lower), b.upper), 4) AS o_totalprice
       FROM orders, (SELECT quantile_cont(o_totalprice, 0.01) AS lower,
                            quantile_cont(o_totalprice, 0.99) AS upper FROM orders) b""",
)
def c14(spark, d):
    orders = table(spark, d, "orders").select("o_orderkey", "o_totalprice")
    return shaped(Q.winsorize(orders, "o_totalprice"), {"o_orderkey": None, "o_totalprice": 4})


@query(
    "c15_masked_group_mean",
    """SELECT location, round(avg(CASE WHEN remote_allowed = 1 THEN CAST(normalized_salary AS DOUBLE)
         END), 6) AS remote_salary FROM v_postings GROUP BY 1""",
    "v_postings",
)
def c15(spark, d):
    postings = v_postings(spark, d)
    mean = C.masked_mean(F.col("remote_allowed") == 1, C.to_double("normalized_salary"))
    return shaped(
        postings.groupBy("location").agg(mean.alias("remote_salary")),
        {"location": None, "remote_salary": 6},
    )


@query(
    "c16_contingency",
    """SELECT l_returnflag, count(*) FILTER (WHERE l_linestatus = 'F') AS "F",
       count(*) FILTER (WHERE l_linestatus = 'O') AS "O" FROM lineitem GROUP BY 1""",
)
def c16(spark, d):
    return R.contingency(table(spark, d, "lineitem"), "l_returnflag", "l_linestatus", ["F", "O"])


@query(
    "c17_c18_group_summary",
    """SELECT location, count(*) AS n, round(avg(remote_allowed), 8) AS remote_pct,
       round(avg(CAST(normalized_salary AS DOUBLE)), 6) AS avg_salary
       FROM v_postings GROUP BY 1 HAVING count(*) >= 110""",
    "v_postings",
)
def c17_c18(spark, d):
    summary = (
        v_postings(spark, d)
        .groupBy("location")
        .agg(
            F.count("*").alias("n"),
            F.avg("remote_allowed").alias("remote_pct"),
            F.avg(C.to_double("normalized_salary")).alias("avg_salary"),
        )
    )
    return shaped(
        R.at_least(summary, "n", 110),
        {"location": None, "n": None, "remote_pct": 8, "avg_salary": 6},
    )


@query(
    "c19_distinct_rows",
    "SELECT DISTINCT station_id, borough, year FROM v_yearly",
    "v_yearly",
)
def c19(spark, d):
    return v_yearly(spark, d).select("station_id", "borough", "year").distinct()


@query(
    "c20_extremes",
    """SELECT mode, round(min(recovery_rate), 8) AS min_value,
       CAST(arg_min(date, recovery_rate) AS VARCHAR) AS min_at,
       round(max(recovery_rate), 8) AS max_value,
       CAST(arg_max(date, recovery_rate) AS VARCHAR) AS max_at FROM monthly
       WHERE recovery_rate IS NOT NULL GROUP BY 1""",
    "monthly",
)
def c20(spark, d):
    out = R.extremes_by(monthly(spark, d), ["mode"], "recovery_rate", "date")
    return shaped(
        out,
        {"mode": None, "min_value": 8, "min_at": "string", "max_value": 8, "max_at": "string"},
    )


@query(
    "c22_row_sums",
    f"""SELECT doc_id, len(regexp_extract_all(t, 'tion')) + len(regexp_extract_all(t, 'ing'))
         + len(regexp_extract_all(t, 'ble')) AS total,
       CAST(len(regexp_extract_all(t, 'tion')) > 0 AS INTEGER)
         + CAST(len(regexp_extract_all(t, 'ing')) > 0 AS INTEGER)
         + CAST(len(regexp_extract_all(t, 'ble')) > 0 AS INTEGER) AS kinds
       FROM (SELECT doc_id, {CLEAN.format('text')} AS t FROM documents)""",
)
def c22(spark, d):
    rows = table(spark, d, "documents").select("doc_id", clean_text("text").alias("t"))
    marks = {m: F.regexp_count("t", F.lit(m)) for m in ("tion", "ing", "ble")}
    counted = rows.withColumns(marks)
    return counted.select(
        "doc_id",
        C.row_sum(list(marks)).cast("long").alias("total"),
        C.positive_count(list(marks)).cast("long").alias("kinds"),
    )


@query(
    "c23_column_profile",
    """SELECT 'remote_allowed' AS feature, count(*) - count(remote_allowed) AS missing,
       round(avg(remote_allowed), 8) AS mean, round(stddev_samp(remote_allowed), 8) AS std
       FROM v_postings
       UNION ALL SELECT 'salary', count(*) - count(CAST(normalized_salary AS DOUBLE)),
       round(avg(CAST(normalized_salary AS DOUBLE)), 8),
       round(stddev_samp(CAST(normalized_salary AS DOUBLE)), 8) FROM v_postings""",
    "v_postings",
)
def c23(spark, d):
    rows = v_postings(spark, d).withColumn("salary", C.to_double("normalized_salary"))
    out = R.profile_columns(rows, ["remote_allowed", "salary"])
    return shaped(out, {"feature": None, "missing": None, "mean": 8, "std": 8})


_ERA_SQL = " UNION ALL ".join(
    f"SELECT '{name}' AS era, DATE '{a}' AS a, DATE '{b}' AS b" for name, (a, b) in ERAS.items()
)


@query(
    "c24_era_means",
    f"""SELECT era, round(avg(s), 8) AS mean_value, count(s) AS n FROM
        (SELECT date, stddev_samp(recovery_rate) AS s FROM monthly GROUP BY 1) x
        JOIN ({_ERA_SQL}) e ON x.date BETWEEN e.a AND e.b GROUP BY 1""",
    "monthly",
)
def c24(spark, d):
    spread = structural_divergence(monthly(spark, d))
    out = era_means(spread, "date", "dispersion_std", ERAS)
    return shaped(out, {"era": None, "mean_value": 8, "n": None})
