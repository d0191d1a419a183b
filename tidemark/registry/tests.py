"""Statistical tests. The SQL twins integrate the tail densities numerically (Simpson's rule on a
trigonometric substitution), independently of the continued fraction used by the library."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from tidemark.functions import columns as C
from tidemark.functions.tails import f_critical_two, normal_tail
from tidemark.operators import breaks as B
from tidemark.operators import inference as I
from tidemark.operators.correlation import correlation_matrix, series_correlations
from tidemark.operators.density import density_curves
from tidemark.operators.quantiles import box_summary
from tidemark.operators.ranks import mann_whitney, spearman
from tidemark.operators.unitroot import stationarity_tests
from tidemark.registry.core import query, shaped
from tidemark.registry.views import (
    BREAK,
    CORE_MODES,
    ERAS,
    MODES,
    PLACEBOS,
    monthly,
    table,
    v_postings,
)

_STEPS = 2000


def _simpson(low: str, high: str, body: str) -> str:
    """Integral of ``body`` (an expression in x) from ``low`` to ``high`` as a scalar SQL list sum."""
    h = f"(({high}) - ({low})) / {_STEPS}.0"
    weight = f"CASE WHEN i = 0 OR i = {_STEPS} THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END"
    inner = body.replace("{x}", f"(({low}) + i * {h})")
    return f"({h}) / 3.0 * list_sum(list_transform(range(0, {_STEPS + 1}), lambda i: {weight} * ({inner})))"


def sql_t_tail(t: str, df: str) -> str:
    """Two-sided tail: with t = sqrt(df) tan(x) the density becomes cos(x)^(df - 1)."""
    scale = f"exp(lgamma(({df} + 1) / 2.0) - lgamma(({df}) / 2.0)) / sqrt(pi())"
    area = _simpson("0.0", f"atan(abs({t}) / sqrt({df}))", f"pow(cos({{x}}), ({df}) - 1)")
    return f"(1 - 2 * {scale} * {area})"


def sql_normal_tail(z: str) -> str:
    area = _simpson("0.0", f"abs({z})", "exp(-{x} * {x} / 2)")
    return f"(1 - sqrt(2 / pi()) * {area})"


def sql_f3_tail(f: str, d2: str) -> str:
    """Tail of F(3, d2): I_x(d2/2, 3/2) with x = d2/(d2 + 3f) = sin(u)^2."""
    scale = f"2 * exp(lgamma(({d2} + 3) / 2.0) - lgamma(({d2}) / 2.0) - lgamma(1.5))"
    area = _simpson(
        "0.0",
        f"asin(sqrt({d2} / ({d2} + 3 * {f})))",
        f"pow(sin({{x}}), ({d2}) - 1) * cos({{x}}) * cos({{x}})",
    )
    return f"({scale} * {area})"


@query("i1_unit_root_tests")
def i1(spark, d):
    tests = stationarity_tests(monthly(spark, d), "mode", "date", "recovery_rate")
    return tests.orderBy("label")


def break_sql(breaks: list[tuple[str, str]], modes: list[str] | None = None) -> str:
    """Break tests from orthogonal time terms inside each segment."""
    rows = " UNION ALL ".join(
        f"SELECT DATE '{b}' AS break_date, '{trend}' AS trend" for b, trend in breaks
    )
    where = f"WHERE mode IN ({', '.join(repr(m) for m in modes)})" if modes else ""
    return f"""
    s AS (SELECT mode, date, recovery_rate AS y FROM monthly {where}),
    b AS ({rows}),
    x AS (SELECT s.mode, b.break_date, b.trend, seg.side, s.date, s.y FROM s, b,
          (SELECT unnest(['full', 'part']) AS side) seg),
    seg AS (SELECT mode, break_date, trend,
              CASE WHEN side = 'full' THEN 'full' WHEN date < break_date THEN 'pre' ELSE 'post' END
                AS side, date, y FROM x),
    t AS (SELECT *, row_number() OVER w - 1 AS t, count(*) OVER v AS n, avg(y) OVER v AS my
          FROM seg WINDOW v AS (PARTITION BY mode, break_date, trend, side),
                          w AS (PARTITION BY mode, break_date, trend, side ORDER BY date)),
    c AS (SELECT *, t - (n - 1) / 2.0 AS c,
            power(t - (n - 1) / 2.0, 2) - (n * n - 1) / 12.0 AS z, y - my AS yc FROM t),
    r AS (SELECT mode, break_date, trend, side, count(*) AS n,
            sum(yc * yc) - power(sum(c * yc), 2) / nullif(sum(c * c), 0)
              - CASE WHEN trend = 'quadratic'
                     THEN coalesce(power(sum(z * yc), 2) / nullif(sum(z * z), 0), 0) ELSE 0 END AS rss
          FROM c GROUP BY 1, 2, 3, 4),
    p AS (SELECT mode, break_date, trend, CASE WHEN trend = 'quadratic' THEN 3 ELSE 2 END AS k,
            coalesce(max(n) FILTER (WHERE side = 'pre'), 0) AS n_pre,
            coalesce(max(n) FILTER (WHERE side = 'post'), 0) AS n_post,
            max(rss) FILTER (WHERE side = 'full') AS rss_full,
            coalesce(max(rss) FILTER (WHERE side = 'pre'), 0)
              + coalesce(max(rss) FILTER (WHERE side = 'post'), 0) AS rss_split
          FROM r GROUP BY 1, 2, 3),
    f AS (SELECT *, n_pre + n_post - 2 * k AS df2,
            CASE WHEN n_pre >= 12 AND n_post >= 12 THEN
              (rss_full - rss_split) / k / (rss_split / (n_pre + n_post - 2 * k)) END AS f_stat
          FROM p),
    q AS (SELECT *, CASE WHEN f_stat IS NULL THEN NULL WHEN k = 2
              THEN power(1 + 2 * f_stat / df2, -df2 / 2.0)
              ELSE {sql_f3_tail('f_stat', 'df2')} END AS p_value FROM f)"""


_TEST_COLUMNS = """mode, CAST(break_date AS VARCHAR) AS break_date, trend, n_pre, n_post,
    round(f_stat, 6) AS f_stat, round(p_value, 8) AS p_value,
    coalesce(p_value < 0.05, false) AS is_break"""

_TEST_SHAPE = {
    "mode": None,
    "break_date": "string",
    "trend": None,
    "n_pre": None,
    "n_post": None,
    "f_stat": 6,
    "p_value": 8,
    "is_break": None,
}


@query(
    "i2_break_tests",
    f"""WITH {break_sql([(str(BREAK), 'linear'), (str(BREAK), 'quadratic'),
                         ('1995-06-01', 'linear')])}
        SELECT {_TEST_COLUMNS} FROM q""",
    "monthly",
)
def i2(spark, d):
    breaks = F.array(
        *B.break_list([BREAK], "linear"),
        *B.break_list([BREAK], "quadratic"),
        *B.break_list([date(1995, 6, 1)], "linear"),
    )
    tests = B.break_tests(monthly(spark, d), "mode", "date", "recovery_rate", breaks)
    return shaped(tests, _TEST_SHAPE)


@query(
    "i3_break_batch",
    f"""WITH {break_sql([(str(BREAK), 'quadratic'), *[(str(p), 'linear') for p in PLACEBOS]],
                        CORE_MODES)}
        SELECT {_TEST_COLUMNS}, CASE WHEN f_stat IS NULL THEN 'too little data'
          WHEN p_value < 0.05 THEN 'break' WHEN p_value < 0.1 THEN 'weak' ELSE 'none' END AS verdict
        FROM q""",
    "monthly",
)
def i3(spark, d):
    core = monthly(spark, d).where(F.col("mode").isin(CORE_MODES))
    tests = B.hypothesis_and_placebo_tests(
        core, "mode", "date", "recovery_rate", [BREAK], PLACEBOS
    )
    return shaped(tests, {**_TEST_SHAPE, "verdict": None})


def _scan_breaks() -> list[tuple[str, str]]:
    months = [(1996 + (11 + i) // 12, (11 + i) % 12 + 1) for i in range(25)]
    return [(f"{y}-{m:02d}-01", "linear") for y, m in months]


@query(
    "i4_sensitivity_scan",
    f"""WITH {break_sql(_scan_breaks())}
        SELECT {_TEST_COLUMNS} FROM q""",
    "monthly",
)
def i4(spark, d):
    scan = B.sensitivity_scan(monthly(spark, d), "mode", "date", "recovery_rate", BREAK)
    return shaped(scan, _TEST_SHAPE)


@query(
    "i4_scan_summary",
    f"""WITH {break_sql(_scan_breaks())}
        SELECT mode, count(*) AS n_points, round(min(f_stat), 6) AS f_min,
          round(max(f_stat), 6) AS f_max, round(stddev_samp(f_stat), 6) AS f_std,
          CAST(arg_max(break_date, f_stat) AS VARCHAR) AS peak_date,
          CAST(arg_max(break_date, f_stat) - DATE '{BREAK}' AS BIGINT) AS peak_offset_days,
          round(max(f_stat) FILTER (WHERE break_date = DATE '{BREAK}'), 6) AS f_at_centre,
          max(f_stat) - min(f_stat) > 1.5 * stddev_samp(f_stat) AS is_sharp,
          CASE WHEN max(f_stat) - min(f_stat) < 10 THEN 'gradual' ELSE 'abrupt' END AS shape
        FROM q WHERE f_stat IS NOT NULL GROUP BY 1""",
    "monthly",
)
def i4_summary(spark, d):
    scan = B.sensitivity_scan(monthly(spark, d), "mode", "date", "recovery_rate", BREAK)
    out = B.scan_summary(scan, "mode", BREAK)
    return shaped(
        out,
        {
            "mode": None,
            "n_points": None,
            "f_min": 6,
            "f_max": 6,
            "f_std": 6,
            "peak_date": "string",
            "peak_offset_days": "long",
            "f_at_centre": 6,
            "is_sharp": None,
            "shape": None,
        },
    )


@query(
    "i5_critical_f",
    """SELECT mode, n, round((n - 4) / 2.0 * (power(0.05, -2.0 / (n - 4)) - 1), 8) AS f_critical
       FROM (SELECT mode, count(*) AS n FROM monthly GROUP BY 1)""",
    "monthly",
)
def i5(spark, d):
    sizes = monthly(spark, d).groupBy("mode").agg(F.count("*").alias("n"))
    out = sizes.withColumn("f_critical", f_critical_two(0.05, F.col("n") - 4))
    return shaped(out, {"mode": None, "n": None, "f_critical": 8})


_WELCH = """(SELECT count(v) FILTER (WHERE g) AS n_a, count(v) FILTER (WHERE NOT g) AS n_b,
       avg(v) FILTER (WHERE g) AS mean_a, avg(v) FILTER (WHERE NOT g) AS mean_b,
       var_samp(v) FILTER (WHERE g) AS var_a, var_samp(v) FILTER (WHERE NOT g) AS var_b FROM {src})"""


@query(
    "i6_welch_test",
    f"""WITH src AS (SELECT quality = 1 AS g, CAST(n_chars AS DOUBLE) AS v FROM documents d
                     JOIN labels l ON d.doc_id = l.doc_id),
        m AS (SELECT *, (mean_a - mean_b) / sqrt(var_a / n_a + var_b / n_b) AS t,
                power(var_a / n_a + var_b / n_b, 2) / (power(var_a / n_a, 2) / (n_a - 1)
                  + power(var_b / n_b, 2) / (n_b - 1)) AS df FROM {_WELCH.format(src='src')})
        SELECT n_a, n_b, round(mean_a, 6) AS mean_a, round(mean_b, 6) AS mean_b,
          round(t, 8) AS t_stat, round(df, 6) AS df, round({sql_t_tail('t', 'df')}, 8) AS p_value
        FROM m""",
)
def i6(spark, d):
    rows = table(spark, d, "documents").select("doc_id", "n_chars").join(
        table(spark, d, "labels"), "doc_id"
    )
    out = I.welch_test(rows, F.col("quality") == 1, "n_chars")
    return shaped(
        out,
        {"n_a": None, "n_b": None, "mean_a": 6, "mean_b": 6, "t_stat": 8, "df": 6, "p_value": 8},
    )


@query(
    "i7_yates_test",
    f"""WITH n AS (SELECT count(*) FILTER (WHERE quality <> 1 AND toxic <> 1) AS n11,
            count(*) FILTER (WHERE quality <> 1 AND toxic = 1) AS n12,
            count(*) FILTER (WHERE quality = 1 AND toxic <> 1) AS n21,
            count(*) FILTER (WHERE quality = 1 AND toxic = 1) AS n22 FROM labels),
        e AS (SELECT *, unnest([[n11, (n11 + n12) * (n11 + n21)], [n12, (n11 + n12) * (n12 + n22)],
            [n21, (n21 + n22) * (n11 + n21)], [n22, (n21 + n22) * (n12 + n22)]]) AS c,
            (n11 + n12 + n21 + n22) AS total FROM n),
        x AS (SELECT n11, n12, n21, n22,
            sum(power(greatest(abs(c[1] - c[2] / total) - 0.5, 0), 2) / (c[2] / total)) AS chi2
          FROM e GROUP BY 1, 2, 3, 4)
        SELECT n11, n12, n21, n22, round(chi2, 8) AS chi2,
          round({sql_normal_tail('sqrt(chi2)')}, 8) AS p_value FROM x""",
)
def i7(spark, d):
    out = I.yates_test(table(spark, d, "labels"), F.col("quality") == 1, F.col("toxic") == 1)
    cells = {c: None for c in ("n11", "n12", "n21", "n22")}
    return shaped(out, {**cells, "chi2": 8, "p_value": 8})


@query(
    "i8_pearson_test",
    f"""WITH r AS (SELECT l_returnflag, count(*) AS n, corr(l_quantity, l_extendedprice) AS r
                   FROM lineitem GROUP BY 1),
        t AS (SELECT *, r * sqrt(n - 2) / sqrt(1 - r * r) AS t FROM r)
        SELECT l_returnflag, n, round(r, 8) AS r, round(t, 4) AS t_stat,
          round(abs({sql_t_tail('t', '(n - 2)')}), 6) AS p_value FROM t""",
)
def i8(spark, d):
    out = I.pearson_test(table(spark, d, "lineitem"), ["l_returnflag"], "l_quantity", "l_extendedprice")
    return shaped(
        out, {"l_returnflag": None, "n": None, "r": 8, "t_stat": 4, "p_value": 6}
    )


@query(
    "i9_i10_line_fit",
    f"""WITH x AS (SELECT mode, year(date) + (month(date) - 1) / 12.0 AS x, recovery_rate AS y
                   FROM monthly),
        f AS (SELECT mode, count(*) AS n, regr_slope(y, x) AS slope,
                regr_intercept(y, x) AS intercept, regr_r2(y, x) AS r2 FROM x GROUP BY 1),
        t AS (SELECT *, sign(slope) * sqrt(r2 * (n - 2) / (1 - r2)) AS t FROM f)
        SELECT mode, n, round(slope, 8) AS slope, round(intercept, 4) AS intercept,
          round(r2, 8) AS r2, round({sql_t_tail('t', '(n - 2)')}, 7) AS p_value FROM t""",
    "monthly",
)
def i9_i10(spark, d):
    rows = monthly(spark, d).withColumn("x", F.col("year") + (F.col("month") - 1) / 12.0)
    out = I.line_fit(rows, ["mode"], "x", "recovery_rate")
    return shaped(
        out, {"mode": None, "n": None, "slope": 8, "intercept": 4, "r2": 8, "p_value": 7}
    )


_ERA_ROWS = " UNION ALL ".join(
    f"SELECT '{name}' AS era, DATE '{a}' AS a, DATE '{b}' AS b" for name, (a, b) in ERAS.items()
)


@query(
    "i11_correlations_by_era",
    f"""WITH e AS ({_ERA_ROWS}),
        m AS (SELECT era, date, mode, recovery_rate AS r FROM monthly JOIN e
              ON date BETWEEN a AND b),
        k AS (SELECT era FROM m GROUP BY 1 HAVING count(DISTINCT date) > 3)
        SELECT x.era, x.mode AS a, y.mode AS b, count(*) AS n, round(corr(x.r, y.r), 8) AS corr
        FROM m x JOIN m y ON x.era = y.era AND x.date = y.date
        WHERE x.era IN (SELECT era FROM k) GROUP BY 1, 2, 3""",
    "monthly",
)
def i11(spark, d):
    out = series_correlations(monthly(spark, d), "date", "mode", "recovery_rate", MODES, ERAS)
    return shaped(out, {"era": None, "a": None, "b": None, "n": None, "corr": 8})


_LINE_COLUMNS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query(
    "i12_feature_correlations",
    " UNION ALL ".join(
        f"SELECT '{a}' AS a, '{b}' AS b, count(*) AS n, round(corr({a}, {b}), 8) AS corr FROM lineitem"
        for a in _LINE_COLUMNS
        for b in _LINE_COLUMNS
    ),
)
def i12(spark, d):
    out = correlation_matrix(table(spark, d, "lineitem"), [], _LINE_COLUMNS)
    return shaped(out, {"a": None, "b": None, "n": None, "corr": 8})


@query(
    "i13_stars",
    """SELECT doc_id, CASE WHEN n_chars / 100000.0 < 0.001 THEN '***'
       WHEN n_chars / 100000.0 < 0.01 THEN '**' WHEN n_chars / 100000.0 < 0.05 THEN '*'
       ELSE 'ns' END AS stars FROM documents""",
)
def i13(spark, d):
    p = F.col("n_chars") / 100000.0
    return table(spark, d, "documents").select("doc_id", C.significance_stars(p).alias("stars"))


@query(
    "i14_density_curves",
    """WITH x AS (SELECT location, CAST(normalized_salary AS DOUBLE) AS v FROM v_postings),
       s AS (SELECT location, count(*) AS n, stddev_samp(v) * power(count(*), -0.2) AS h,
           min(v) AS low, max(v) AS high FROM x GROUP BY 1),
       g AS (SELECT *, low - 3 * h + i * ((high - low + 6 * h) / 40) AS at
             FROM s, (SELECT unnest(range(0, 41)) AS i))
       SELECT g.location, g.i AS grid_index, round(g.at, 6) AS x,
         round(sum(exp(-power((g.at - x.v) / g.h, 2) / 2)) / (g.n * g.h * sqrt(2 * pi())), 10)
           AS density
       FROM g JOIN x ON g.location = x.location GROUP BY g.location, g.i, g.at, g.n, g.h""",
    "v_postings",
)
def i14(spark, d):
    rows = v_postings(spark, d).select("location", C.to_double("normalized_salary").alias("v"))
    out = density_curves(rows, "location", "v", grid_size=41)
    return shaped(out, {"location": None, "grid_index": "long", "x": 6, "density": 10})


@query(
    "i15_box_summary",
    """WITH x AS (SELECT l_linenumber AS line, l_extendedprice AS v FROM lineitem),
       q AS (SELECT line, count(*) AS n, quantile_cont(v, 0.25) AS q1, median(v) AS m,
           quantile_cont(v, 0.75) AS q3 FROM x GROUP BY 1)
       SELECT q.line AS l_linenumber, q.n, round(q1, 4) AS q1, round(m, 4) AS median,
         round(q3, 4) AS q3,
         min(v) FILTER (WHERE v BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)) AS whisker_low,
         max(v) FILTER (WHERE v BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)) AS whisker_high
       FROM q JOIN x ON q.line = x.line GROUP BY q.line, q.n, q1, m, q3""",
)
def i15(spark, d):
    out = box_summary(table(spark, d, "lineitem"), "l_linenumber", "l_extendedprice")
    keys = {"l_linenumber": None, "n": None, "q1": 4, "median": 4, "q3": 4}
    return shaped(out, {**keys, "whisker_low": None, "whisker_high": None})


@query(
    "u1_spearman",
    """SELECT count(*) AS n, round(corr(rx, ry), 8) AS rho FROM (
         SELECT rank() OVER (ORDER BY l_quantity)
                  + (count(*) OVER (PARTITION BY l_quantity) - 1) / 2.0 AS rx,
                rank() OVER (ORDER BY l_extendedprice)
                  + (count(*) OVER (PARTITION BY l_extendedprice) - 1) / 2.0 AS ry FROM lineitem)""",
)
def u1(spark, d):
    return shaped(
        spearman(table(spark, d, "lineitem"), "l_quantity", "l_extendedprice"),
        {"n": None, "rho": 8},
    )


@query(
    "u2_mann_whitney",
    f"""WITH x AS (SELECT quality = 1 AS g, n_chars AS v FROM documents d
                   JOIN labels l ON d.doc_id = l.doc_id),
        r AS (SELECT *, rank() OVER (ORDER BY v) + (count(*) OVER (PARTITION BY v) - 1) / 2.0 AS r
              FROM x),
        t AS (SELECT sum(c * c * c - c) AS ties FROM (SELECT count(*) AS c FROM x GROUP BY v)),
        s AS (SELECT CAST(count(*) FILTER (WHERE g) AS DOUBLE) AS n1,
                CAST(count(*) FILTER (WHERE NOT g) AS DOUBLE) AS n2,
                sum(r) FILTER (WHERE g) AS r1 FROM r),
        u AS (SELECT *, r1 - n1 * (n1 + 1) / 2 AS u,
                sqrt(n1 * n2 / 12 * ((n1 + n2 + 1) - ties / ((n1 + n2) * (n1 + n2 - 1)))) AS sd
              FROM s, t),
        z AS (SELECT n1, n2, u, sign(u - n1 * n2 / 2) * greatest(abs(u - n1 * n2 / 2) - 0.5, 0) / sd
                AS z FROM u)
        SELECT CAST(n1 AS BIGINT) AS n1, CAST(n2 AS BIGINT) AS n2, round(u, 2) AS u,
          round(z, 8) AS z, round({sql_normal_tail('z')}, 8) AS p_value FROM z""",
)
def u2(spark, d):
    rows = table(spark, d, "documents").select("doc_id", "n_chars").join(
        table(spark, d, "labels"), "doc_id"
    )
    out = mann_whitney(rows, F.col("quality") == 1, "n_chars")
    return shaped(
        out.withColumn("p_value", normal_tail("z")),
        {"n1": None, "n2": None, "u": 2, "z": 8, "p_value": 8},
    )
