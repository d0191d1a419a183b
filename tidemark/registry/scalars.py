"""Casts, predicates, text and array functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import columns as C
from tidemark.functions import text as X
from tidemark.functions.seeds import merge_seed_tables
from tidemark.plans.stations import TIMESTAMP_FORMAT
from tidemark.registry.core import query, shaped
from tidemark.registry.views import (
    CLEAN,
    CLEAN_COMMAS,
    SEEDS,
    monthly,
    sql_hits,
    table,
    v_links,
    v_postings,
    v_raw_text,
    v_skills,
)
from tidemark.sources.tables import ensure_columns


@query(
    "b1_b5_casts",
    """SELECT strftime(try_strptime(transit_timestamp, '%m/%d/%Y %I:%M:%S %p'),
                       '%Y-%m-%d %H:%M:%S') AS at,
       CAST(CAST(try_strptime(transit_timestamp, '%m/%d/%Y %I:%M:%S %p') AS DATE) AS VARCHAR)
         AS day,
       station_complex_id AS station_id, CAST(TRY_CAST(ridership AS INTEGER) AS DOUBLE) AS entries,
       TRY_CAST(ridership AS DOUBLE) AS entries_number, count(*) AS n
       FROM v_raw_text GROUP BY ALL""",
    "v_raw_text",
)
def b1_b5(spark, d):
    at = C.parse_wall_clock("transit_timestamp", TIMESTAMP_FORMAT)
    return (
        v_raw_text(spark, d)
        .select(
            F.date_format(at, "yyyy-MM-dd HH:mm:ss").alias("at"),
            F.to_date(at).cast("string").alias("day"),
            F.col("station_complex_id").alias("station_id"),
            C.to_int("ridership").cast("double").alias("entries"),
            C.to_double("ridership").alias("entries_number"),
        )
        .groupBy("at", "day", "station_id", "entries", "entries_number")
        .agg(F.count("*").alias("n"))
    )


@query(
    "b6_calendar_parts",
    """SELECT event_id, year(ts) AS year, month(ts) AS month, day(ts) AS day,
       isodow(ts) - 1 AS dayofweek, hour(ts) AS hour, isodow(ts) >= 6 AS is_weekend,
       CAST(CAST(ts AS DATE) AS VARCHAR) AS date FROM events""",
)
def b6(spark, d):
    parts = C.with_calendar(table(spark, d, "events"), "ts")
    number = {c: "long" for c in ("year", "month", "day", "dayofweek", "hour")}
    return shaped(parts, {"event_id": None, **number, "is_weekend": None, "date": "string"})


@query(
    "b7_b8_month_labels",
    """SELECT year(o_orderdate) AS year, month(o_orderdate) AS month,
       CAST(make_date(year(o_orderdate), month(o_orderdate), 1) AS VARCHAR) AS month_start,
       strftime(o_orderdate, '%Y-%m') AS year_month, count(*) AS n FROM orders GROUP BY 1, 2, 3, 4""",
)
def b7_b8(spark, d):
    orders = table(spark, d, "orders").select(
        F.year("o_orderdate").cast("long").alias("year"),
        F.month("o_orderdate").cast("long").alias("month"),
    )
    return orders.groupBy("year", "month").agg(F.count("*").alias("n")).select(
        "year",
        "month",
        C.month_start(F.col("year").cast("int"), F.col("month").cast("int"))
        .cast("string")
        .alias("month_start"),
        C.year_month("year", "month").alias("year_month"),
        "n",
    )


@query(
    "b9_b15_predicates",
    """SELECT count(*) FILTER (WHERE o_orderpriority IN ('1-URGENT', '2-HIGH')) AS members,
       count(*) FILTER (WHERE o_orderpriority NOT IN ('1-URGENT', '2-HIGH')) AS others,
       count(*) FILTER (WHERE CAST(o_orderdate AS DATE)
         BETWEEN DATE '1996-01-01' AND DATE '1996-06-30') AS in_range,
       count(*) FILTER (WHERE lower(o_orderpriority) = '5-low') AS same_text,
       count(*) FILTER (WHERE o_totalprice / 100000 > 0.1 AND o_totalprice / 100000 < 3) AS inside,
       count(*) FILTER (WHERE length(o_orderpriority) > 6) AS long_text,
       count(*) FILTER (WHERE o_totalprice IS NOT NULL AND o_totalprice > 0) AS positive
       FROM orders""",
)
def b9_b15(spark, d):
    priority, price = F.col("o_orderpriority"), F.col("o_totalprice")
    top = priority.isin("1-URGENT", "2-HIGH")
    first_half = F.to_date("o_orderdate").between("1996-01-01", "1996-06-30")
    return table(spark, d, "orders").agg(
        F.count_if(top).alias("members"),
        F.count_if(~top).alias("others"),
        F.count_if(first_half).alias("in_range"),
        F.count_if(C.same_text(priority, "5-Low")).alias("same_text"),
        F.count_if(C.inside(price / 100000, 0.1, 3)).alias("inside"),
        F.count_if(F.length(priority) > 6).alias("long_text"),
        F.count_if(C.positive(price)).alias("positive"),
    )


@query(
    "b16_b21_null_rules",
    """SELECT job_id, coalesce(remote_allowed, 0) AS remote_filled,
       round(remote_allowed / nullif(CAST(normalized_salary AS DOUBLE), 0), 8) AS guarded,
       CASE WHEN coalesce(remote_allowed, 0) = 0 THEN 1 ELSE remote_allowed END AS denominator,
       least(greatest(CAST(normalized_salary AS DOUBLE), 500), 3000) AS clipped,
       round(ln(1 + CAST(normalized_salary AS DOUBLE)), 8) AS logged,
       remote_allowed IS NOT NULL AS complete FROM v_postings""",
    "v_postings",
)
def b16_b21(spark, d):
    postings = v_postings(spark, d)
    complete = postings.na.drop(subset=["remote_allowed"]).select(
        "job_id", F.lit(True).alias("complete")
    )
    filled = F.coalesce("remote_allowed", F.lit(0)).cast("long")
    salary = C.to_double("normalized_salary")
    return postings.join(complete, "job_id", "left").select(
        "job_id",
        filled.alias("remote_filled"),
        F.round(C.ratio("remote_allowed", salary), 8).alias("guarded"),
        C.zero_to_one(filled).cast("long").alias("denominator"),
        C.clip(salary, 500.0, 3000.0).alias("clipped"),
        F.round(F.log1p(salary), 8).alias("logged"),
        F.coalesce("complete", F.lit(False)).alias("complete"),
    )


@query(
    "b22_b23_rule_labels",
    """SELECT year, month, mode,
       CASE WHEN recovery_rate >= 0.9 THEN 'HIGH' WHEN recovery_rate >= 0.75 THEN 'MID'
            ELSE 'LOW' END AS tier,
       CASE WHEN recovery_rate / 20 < 0.001 THEN '***' WHEN recovery_rate / 20 < 0.01 THEN '**'
            WHEN recovery_rate / 20 < 0.05 THEN '*' ELSE 'ns' END AS stars,
       CASE mode WHEN '1-URGENT' THEN 'urgent' WHEN '5-LOW' THEN 'low' ELSE mode END AS label
       FROM monthly""",
    "monthly",
)
def b22_b23(spark, d):
    labels = {"1-URGENT": "urgent", "5-LOW": "low"}
    return monthly(spark, d).select(
        F.col("year").cast("long").alias("year"),
        F.col("month").cast("long").alias("month"),
        "mode",
        C.recovery_tier("recovery_rate").alias("tier"),
        C.significance_stars(F.col("recovery_rate") / 20).alias("stars"),
        C.map_code("mode", labels).alias("label"),
    )


@query(
    "b24_missing_columns",
    """SELECT s_suppkey, round(s_acctbal, 2) AS s_acctbal, CAST(NULL AS DOUBLE) AS commute_ratio
       FROM supplier""",
)
def b24(spark, d):
    wide = ensure_columns(table(spark, d, "supplier"), ["s_acctbal", "commute_ratio"])
    return shaped(wide, {"s_suppkey": None, "s_acctbal": 2, "commute_ratio": None})


@query(
    "g1_g3_clean_split_count",
    f"""SELECT row_id, {CLEAN_COMMAS.format('skills')} AS with_commas,
        {CLEAN.format('skills')} AS without_commas,
        len(regexp_split_to_array({CLEAN_COMMAS.format('skills')}, '\\s*,\\s*')) AS pieces,
        len(list_filter(regexp_split_to_array({CLEAN_COMMAS.format('skills')}, '\\s*,\\s*'),
                        lambda x: trim(x) <> '')) AS non_blank FROM v_skills""",
    "v_skills",
)
def g1_g3(spark, d):
    rows = v_skills(spark, d).withColumn("c", X.clean_text("skills", keep_commas=True))
    items = X.split_commas("c")
    return rows.select(
        "row_id",
        F.col("c").alias("with_commas"),
        X.clean_text("skills").alias("without_commas"),
        F.size(items).cast("long").alias("pieces"),
        X.count_non_blank(items).cast("long").alias("non_blank"),
    )


@query(
    "g1_clean_documents",
    f"SELECT doc_id, md5({CLEAN.format('text')}) AS clean_hash FROM documents",
)
def g1(spark, d):
    return table(spark, d, "documents").select(
        "doc_id", F.md5(X.clean_text("text")).alias("clean_hash")
    )


@query(
    "g4_g5_title_from_link",
    """SELECT page_id, nullif(regexp_extract(url, '//[^/]+/(.+?)/[0-9]', 1), '') AS title,
       trim(lower(replace(coalesce(regexp_extract(url, '//([^/]+)/', 1), ''), '-', ' '))) AS host
       FROM v_links""",
    "v_links",
)
def g4_g5(spark, d):
    return v_links(spark, d).select(
        "page_id",
        X.capture("url", "//[^/]+/(.+?)/[0-9]").alias("title"),
        X.spaced_title(X.capture("url", "//([^/]+)/")).alias("host"),
    )


_ALL_SEEDS = [p for group in SEEDS.values() for p in group]


@query(
    "g6_g8_text_matches",
    f"""SELECT job_id, md5(trim(coalesce(title, '') || ' ' || coalesce(description, ''))) AS joined,
        regexp_matches({CLEAN.format('description')}, 'thtion|ering') AS has_any,
        {sql_hits(CLEAN.format('description'), _ALL_SEEDS)} AS hits FROM v_postings""",
    "v_postings",
)
def g6_g8(spark, d):
    clean = X.clean_text("description")
    return v_postings(spark, d).select(
        "job_id",
        F.md5(X.join_text("title", "description")).alias("joined"),
        X.contains_any(clean, ["thtion", "ering"]).alias("has_any"),
        X.count_phrases(clean, _ALL_SEEDS).cast("long").alias("hits"),
    )


@query(
    "g9_g10_seed_words",
    f"""SELECT doc_id, len(list_intersect(w, ['ering', 'eriner', 'thtion'])) AS hits,
        CASE WHEN a OR b THEN concat_ws('+', CASE WHEN a THEN 'c1' END, CASE WHEN b THEN 'c5' END)
             ELSE 'traditional' END AS tag
        FROM (SELECT doc_id, w, len(list_intersect(w, ['thtion', 'thanea'])) > 0 AS a,
                     len(list_intersect(w, ['eriner', 'ering'])) > 0 AS b
              FROM (SELECT doc_id, string_split({CLEAN.format('text')}, ' ') AS w FROM documents))""",
)
def g9_g10(spark, d):
    rows = table(spark, d, "documents").select(
        "doc_id", F.split(X.clean_text("text"), " ").alias("w")
    )
    found = [
        F.when(F.size(X.words_in("w", SEEDS[c])) > 0, F.lit(c)) for c in ("c1", "c5")
    ]
    return rows.select(
        "doc_id",
        F.size(X.words_in("w", ["ering", "eriner", "thtion"])).cast("long").alias("hits"),
        X.category_tag(F.array_compact(F.array(*found)), "traditional").alias("tag"),
    )


@query(
    "g11_g12_codes_and_length",
    """SELECT job_id, trim(upper(coalesce(work_type, 'UNKNOWN'))) AS work_type_clean,
       trim(upper(coalesce(work_type, 'UNKNOWN'))) IN ('FULL_TIME', 'FULL-TIME', 'FULLTIME')
         AS is_fulltime, length(description) AS text_len FROM v_postings""",
    "v_postings",
)
def g11_g12(spark, d):
    code = X.normal_code("work_type")
    return v_postings(spark, d).select(
        "job_id",
        code.alias("work_type_clean"),
        code.isin("FULL_TIME", "FULL-TIME", "FULLTIME").alias("is_fulltime"),
        F.length("description").cast("long").alias("text_len"),
    )


@query(
    "g13_seed_merge",
    """SELECT DISTINCT category, phrase FROM (
         SELECT p_brand AS category, split_part(p_name, ' ', 1) AS phrase FROM part
           WHERE lower(split_part(p_name, ' ', 1)) NOT IN ('red', 'hot')
         UNION ALL
         SELECT p_brand AS category, split_part(p_name, ' ', 2) AS phrase FROM part)
       WHERE length(phrase) >= 4""",
)
def g13(spark, d):
    part = table(spark, d, "part")
    words = F.split("p_name", " ")
    base = part.select(F.col("p_brand").alias("category"), words[0].alias("phrase"))
    boost = part.select(F.col("p_brand").alias("category"), words[1].alias("phrase"))
    return merge_seed_tables(base, boost, min_length=4, blocked=["red", "hot"])


