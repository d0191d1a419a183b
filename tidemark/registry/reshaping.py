"""Joins, reshaping, ordering, top-k and deduplication."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.functions import columns as C
from tidemark.operators import cooccurrence as K
from tidemark.operators.forecast import representative_series
from tidemark.operators.quantiles import exact_median
from tidemark.operators.regression import one_hot
from tidemark.operators.rollup import first_by
from tidemark.operators.series import month_spine
from tidemark.plans.evidence import recent_ranking
from tidemark.plans.skills import prepare_skills
from tidemark.plans.stations import MORNING_HOURS
from tidemark.registry.core import query, shaped
from tidemark.registry.views import (
    BOROUGHS,
    BREAK,
    PLACEBOS,
    RECENT,
    YEARS,
    monthly,
    table,
    v_daily,
    v_hourly,
    v_points,
    v_postings,
    v_skills,
    v_yearly,
)


@query(
    "d1_lookup_join",
    """SELECT CAST(x.date AS VARCHAR) AS date, x.mode, round(x.value / b.baseline, 8) AS rate
       FROM v_daily x LEFT JOIN (SELECT mode, avg(value) AS baseline FROM v_daily
         WHERE date BETWEEN DATE '1995-01-01' AND DATE '1995-02-28' GROUP BY 1) b
       ON x.mode = b.mode""",
    "v_daily",
)
def d1(spark, d):
    daily = v_daily(spark, d)
    base = (
        daily.where(F.col("date").between("1995-01-01", "1995-02-28"))
        .groupBy("mode")
        .agg(F.avg("value").alias("baseline"))
    )
    out = daily.join(base, "mode", "left").withColumn("rate", C.ratio("value", "baseline"))
    return shaped(out, {"date": "string", "mode": None, "rate": 8})


@query(
    "d2_full_outer_join",
    """SELECT coalesce(m.station_id, e.station_id) AS station_id, coalesce(m.w, e.w) AS w,
       round(m.v, 8) AS peak_morning, round(e.v, 8) AS peak_evening FROM
       (SELECT station_id, week(timestamp) AS w, avg(entries) AS v FROM v_hourly
        WHERE hour(timestamp) IN (7, 8, 9) GROUP BY 1, 2) m FULL JOIN
       (SELECT station_id, week(timestamp) AS w, avg(entries) AS v FROM v_hourly
        WHERE hour(timestamp) IN (17, 18, 19) GROUP BY 1, 2) e
       ON m.station_id = e.station_id AND m.w = e.w""",
    "v_hourly",
)
def d2(spark, d):
    hourly = v_hourly(spark, d).withColumn("w", F.weekofyear("timestamp").cast("long"))
    hour = F.hour("timestamp")
    morning, evening = (
        hourly.where(hour.isin(*hours)).groupBy("station_id", "w").agg(F.avg("entries").alias(name))
        for hours, name in ((MORNING_HOURS, "peak_morning"), ((17, 18, 19), "peak_evening"))
    )
    out = morning.join(evening, ["station_id", "w"], "full")
    return shaped(out, {"station_id": None, "w": None, "peak_morning": 8, "peak_evening": 8})


@query(
    "d3_left_join",
    """SELECT d.doc_id, source, CAST(quality AS DOUBLE) AS quality FROM documents d
       LEFT JOIN labels l ON d.doc_id = l.doc_id""",
)
def d3(spark, d):
    documents = table(spark, d, "documents").select("doc_id", "source")
    out = documents.join(table(spark, d, "labels"), "doc_id", "left")
    return shaped(out, {"doc_id": None, "source": None, "quality": "double"})


@query(
    "d4_first_non_null",
    """SELECT coalesce(a.mode, b.mode) AS mode, round(coalesce(a.v, b.v), 6) AS baseline FROM
       (SELECT mode, avg(value) AS v FROM v_daily WHERE date = DATE '1995-01-01' GROUP BY 1) a
       FULL JOIN (SELECT mode, avg(value) AS v FROM v_daily WHERE year(date) = 1998 GROUP BY 1) b
       ON a.mode = b.mode""",
    "v_daily",
)
def d4(spark, d):
    daily = v_daily(spark, d)
    first = daily.where(F.col("date") == "1995-01-01").groupBy("mode").agg(F.avg("value").alias("a"))
    later = daily.where(F.year("date") == 1998).groupBy("mode").agg(F.avg("value").alias("b"))
    out = first.join(later, "mode", "full").withColumn("baseline", F.coalesce("a", "b"))
    return shaped(out, {"mode": None, "baseline": 6})


@query(
    "d5_semi_join_top",
    """SELECT p_brand, count(*) AS n FROM lineitem JOIN part ON l_partkey = p_partkey
       WHERE p_brand IN (SELECT p_brand FROM part GROUP BY 1 ORDER BY count(*) DESC, p_brand LIMIT 10)
       GROUP BY 1""",
)
def d5(spark, d):
    part = table(spark, d, "part").select("p_partkey", "p_brand")
    top = (
        part.groupBy("p_brand").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "p_brand").limit(10)
    )
    # limit(10) bounds the broadcast.
    kept = part.join(F.broadcast(top), "p_brand", "left_semi")
    rows = table(spark, d, "lineitem").select(F.col("l_partkey").alias("p_partkey"))
    return rows.join(kept, "p_partkey").groupBy("p_brand").agg(F.count("*").alias("n"))


@query(
    "d6_join_on_id",
    """SELECT d.doc_id, n_chars, toxic FROM documents d JOIN labels l ON d.doc_id = l.doc_id""",
)
def d6(spark, d):
    left = table(spark, d, "documents").select("doc_id", "n_chars")
    return left.join(table(spark, d, "labels").select("doc_id", "toxic"), "doc_id")


@query(
    "d7_append_rows",
    """SELECT kind, count(*) AS n, round(sum(amount), 2) AS amount FROM (
         SELECT 'supplier' AS kind, s_acctbal AS amount FROM supplier
         UNION ALL SELECT 'customer', c_acctbal FROM customer) GROUP BY 1""",
)
def d7(spark, d):
    parts = [
        table(spark, d, name).select(
            F.lit(name).alias("kind"), F.col(column).cast("decimal(18,2)").alias("amount")
        )
        for name, column in (("supplier", "s_acctbal"), ("customer", "c_acctbal"))
    ]
    out = parts[0].unionByName(parts[1]).groupBy("kind").agg(
        F.count("*").alias("n"), F.sum("amount").alias("amount")
    )
    return shaped(out, {"kind": None, "n": None, "amount": 2})


@query(
    "d8_pivot",
    "SELECT station_id, "
    + ", ".join(f"round(avg(CASE WHEN year = {y} THEN entries END), 8) AS y{y}" for y in YEARS)
    + " FROM v_yearly GROUP BY 1",
    "v_yearly",
)
def d8(spark, d):
    wide = v_yearly(spark, d).groupBy("station_id").pivot("year", YEARS).agg(F.avg("entries"))
    named = wide.withColumnsRenamed({str(y): f"y{y}" for y in YEARS})
    return shaped(named, {"station_id": None, **{f"y{y}": 8 for y in YEARS}})


_BREAKS = [BREAK, *PLACEBOS]


@query(
    "d9_break_product",
    f"""SELECT mode, CAST(b.break_date AS VARCHAR) AS break_date,
        count(*) FILTER (WHERE date < b.break_date) AS n_pre,
        count(*) FILTER (WHERE date >= b.break_date) AS n_post
        FROM monthly, ({' UNION ALL '.join(f"SELECT DATE '{b}' AS break_date" for b in _BREAKS)}) b
        GROUP BY 1, 2""",
    "monthly",
)
def d9(spark, d):
    dates = F.array(*[F.lit(b) for b in _BREAKS])
    rows = monthly(spark, d).withColumn("break_date", F.explode(dates))
    out = rows.groupBy("mode", "break_date").agg(
        F.count_if(F.col("date") < F.col("break_date")).alias("n_pre"),
        F.count_if(F.col("date") >= F.col("break_date")).alias("n_post"),
    )
    return shaped(out, {"mode": None, "break_date": "string", "n_pre": None, "n_post": None})


@query(
    "d10_month_spine",
    """SELECT CAST(s.month AS VARCHAR) AS month, count(o_orderkey) AS n FROM
       (SELECT CAST(unnest(generate_series(DATE '1996-12-01', DATE '1998-12-01', INTERVAL 1 MONTH))
          AS DATE) AS month) s
       LEFT JOIN orders ON CAST(date_trunc('month', o_orderdate) AS DATE) = s.month GROUP BY 1""",
)
def d10(spark, d):
    spine = spark.range(1).select(F.explode(month_spine(F.lit(BREAK), 12)).alias("month"))
    months = (
        table(spark, d, "orders")
        .groupBy(F.trunc("o_orderdate", "month").alias("month"))
        .agg(F.count("o_orderkey").alias("n"))
    )
    out = spine.join(months, "month", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return shaped(out, {"month": "string", "n": "long"})


@query(
    "d11_explode_items",
    "SELECT item, count(*) AS n FROM skills_items GROUP BY 1",
    "skills_items",
)
def d11(spark, d):
    skills = prepare_skills(v_skills(spark, d), "skills", None)
    items = skills.select(F.explode("skills_list").alias("item"))
    return items.select(F.trim("item").alias("item")).groupBy("item").agg(F.count("*").alias("n"))


_PAIRS = """SELECT least(a.item, b.item) AS skill_a, greatest(a.item, b.item) AS skill_b,
       count(*) AS weight FROM skills_items a JOIN skills_items b
       ON a.row_id = b.row_id AND a.pos < b.pos {where} GROUP BY 1, 2"""


@query("d12_item_pairs", _PAIRS.format(where=""), "skills_items")
def d12(spark, d):
    skills = prepare_skills(v_skills(spark, d), "skills", None)
    return K.item_pairs(skills, "skills_list", top_n=None, max_pairs=None)


@query(
    "d13_one_hot",
    "SELECT station_id, year, "
    + ", ".join(f"max(CAST(borough = '{b}' AS DOUBLE)) AS \"borough_{b}\"" for b in BOROUGHS[1:])
    + " FROM v_yearly GROUP BY 1, 2",
    "v_yearly",
)
def d13(spark, d):
    rows = v_yearly(spark, d).select("station_id", "year", "borough").distinct()
    return one_hot(rows, "borough", BOROUGHS).drop("borough")


@query(
    "d14_complete_rows",
    """SELECT job_id, remote_allowed, work_type FROM v_postings
       WHERE remote_allowed IS NOT NULL AND work_type IS NOT NULL""",
    "v_postings",
)
def d14(spark, d):
    rows = v_postings(spark, d).select("job_id", "remote_allowed", "work_type")
    return rows.na.drop(subset=["remote_allowed", "work_type"])


@query(
    "e1_total_order",
    """SELECT CAST(date AS VARCHAR) AS date, mode, value,
       row_number() OVER (PARTITION BY mode ORDER BY date) AS rn FROM v_daily ORDER BY date, mode""",
    "v_daily",
)
def e1(spark, d):
    numbered = v_daily(spark, d).withColumn(
        "rn", F.row_number().over(Window.partitionBy("mode").orderBy("date")).cast("long")
    )
    return shaped(
        numbered, {"date": "string", "mode": None, "value": None, "rn": None}
    ).orderBy("date", "mode")


@query(
    "e2_rank_modes",
    """SELECT mode, round(r, 8) AS rate, rank() OVER (ORDER BY r DESC) AS rank,
       CASE WHEN r >= 0.9 THEN 'HIGH' WHEN r >= 0.75 THEN 'MID' ELSE 'LOW' END AS tier
       FROM (SELECT mode, avg(recovery_rate) AS r FROM monthly
             WHERE date >= DATE '2001-01-01' GROUP BY 1)""",
    "monthly",
)
def e2(spark, d):
    ranking = recent_ranking(monthly(spark, d), RECENT[0])
    return shaped(ranking, {"mode": None, "rate": 8, "rank": "long", "tier": None})


@query(
    "e3_top_terms_per_group",
    """SELECT label, vec_id AS id, round(w, 6) AS w FROM (
         SELECT label, vec_id, CAST(embedding[1] AS DOUBLE) AS w,
           row_number() OVER (PARTITION BY label ORDER BY embedding[1] DESC, vec_id) AS r
         FROM embeddings) WHERE r <= 5""",
)
def e3(spark, d):
    """Top five per group. Spark keeps five rows per group and task before the shuffle."""
    points = v_points(spark, d).select(
        "label", "id", F.get("features", F.lit(0)).cast("double").alias("w")
    )
    order = Window.partitionBy("label").orderBy(F.desc("w"), "id")
    top = points.withColumn("r", F.row_number().over(order)).where(F.col("r") <= 5)
    return shaped(top, {"label": None, "id": None, "w": 6})


@query(
    "e4_top_values",
    """SELECT item, count(*) AS n FROM skills_items WHERE item <> '' GROUP BY 1
       ORDER BY 2 DESC, 1 LIMIT 20""",
    "skills_items",
)
def e4(spark, d):
    skills = prepare_skills(v_skills(spark, d), "skills", None)
    return K.top_values(skills, "skills_list", 20)


_TOP = """AND a.item IN (SELECT item FROM skills_items WHERE item <> '' GROUP BY 1
            ORDER BY count(*) DESC, item LIMIT 20)
          AND b.item IN (SELECT item FROM skills_items WHERE item <> '' GROUP BY 1
            ORDER BY count(*) DESC, item LIMIT 20)"""


@query(
    "e5_top_pairs",
    _PAIRS.format(where=_TOP) + " ORDER BY weight DESC, skill_a, skill_b LIMIT 50",
    "skills_items",
)
def e5(spark, d):
    skills = prepare_skills(v_skills(spark, d), "skills", None)
    return K.item_pairs(skills, "skills_list", top_n=20, max_pairs=50)


@query(
    "e6_arg_max",
    """SELECT vec_id AS id, list_position(embedding, list_max(embedding)) - 1 AS best,
       round(CAST(list_max(embedding) AS DOUBLE), 6) AS top FROM embeddings""",
)
def e6(spark, d):
    best = F.array_max("features")
    out = v_points(spark, d).select(
        "id", (F.array_position("features", best) - 1).alias("best"), best.alias("top")
    )
    return shaped(out, {"id": None, "best": "long", "top": 6})


@query(
    "e7_keep_first",
    """SELECT company_name, title, min(job_id) AS job_id FROM v_postings GROUP BY 1, 2""",
    "v_postings",
)
def e7(spark, d):
    firsts = first_by(v_postings(spark, d), ["company_name", "title"], "job_id")
    return firsts.select("company_name", "title", "job_id")


@query(
    "e8_representative_series",
    """SELECT station_id, r AS rank, round(m, 6) AS mean_value FROM (
         SELECT station_id, m, row_number() OVER (ORDER BY m DESC, station_id) - 1 AS r,
                count(*) OVER () AS n
         FROM (SELECT station_id, avg(entries) AS m FROM v_hourly GROUP BY 1))
       WHERE r IN (0, n // 2, n - 1)""",
    "v_hourly",
)
def e8(spark, d):
    picks = representative_series(v_hourly(spark, d), "station_id", "entries")
    return shaped(picks, {"station_id": None, "rank": "long", "mean_value": 6})


@query(
    "e9_best_and_worst",
    """SELECT arg_min(mode, r) AS worst, arg_max(mode, r) AS best FROM
       (SELECT mode, avg(recovery_rate) AS r FROM monthly GROUP BY 1)""",
    "monthly",
)
def e9(spark, d):
    means = monthly(spark, d).groupBy("mode").agg(F.avg("recovery_rate").alias("r"))
    return means.agg(F.min_by("mode", "r").alias("worst"), F.max_by("mode", "r").alias("best"))


@query(
    "e10_order_by_median",
    """SELECT borough, round(median(entries), 6) AS median FROM v_yearly GROUP BY 1
       ORDER BY 2, 1""",
    "v_yearly",
)
def e10(spark, d):
    medians = exact_median(v_yearly(spark, d), ["borough"], "entries", "median")
    return shaped(medians, {"borough": None, "median": 6}).orderBy("median", "borough")
