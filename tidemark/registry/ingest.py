"""Sources, sinks and compute-once tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.plans.recovery import daily_rollup
from tidemark.plans.stations import hourly_rollup
from tidemark.registry.core import query, shaped
from tidemark.registry.views import (
    money,
    table,
    v_daily,
    v_hourly,
    v_postings,
    v_raw_text,
    v_skills,
)
from tidemark.runtime import scratch_path
from tidemark.sources import readers, tables


def _csv_copy(df, label: str) -> str:
    path = scratch_path(df.sparkSession, label)
    df.write.option("header", True).option("quote", '"').option("escape", '"').csv(path)
    return path


@query(
    "a1_typed_csv_scan",
    """SELECT CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS date, o_orderpriority AS mode,
       CAST(sum(CAST(o_totalprice AS DECIMAL(18, 2))) AS DOUBLE) AS value
       FROM orders GROUP BY 1, 2""",
)
def a1(spark, d):
    orders = table(spark, d, "orders").select(
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("Date"),
        F.col("o_orderpriority").alias("Mode"),
        F.col("o_totalprice").alias("Count"),
    )
    daily = readers.read_daily_csv(spark, _csv_copy(orders, "daily"))
    rolled = daily_rollup(daily, F.col("date"), F.col("mode"), money("value"))
    return shaped(rolled, {"date": "string", "mode": None, "value": "double"})


@query(
    "a2_text_csv_scan",
    """SELECT strftime(try_strptime(transit_timestamp, '%m/%d/%Y %I:%M:%S %p'),
                       '%Y-%m-%d %H:%M:%S') AS timestamp,
       station_complex_id AS station_id, station_complex AS station_name, borough,
       CAST(sum(TRY_CAST(ridership AS INTEGER)) AS DOUBLE) AS entries,
       CAST(sum(TRY_CAST(transfers AS INTEGER)) AS DOUBLE) AS transfers
       FROM v_raw_text GROUP BY 1, 2, 3, 4""",
    "v_raw_text",
)
def a2(spark, d):
    """All-text scan with broken lines mixed in: they have fewer fields and must vanish."""
    path = _csv_copy(v_raw_text(spark, d), "hourly")
    broken = table(spark, d, "events").select(F.concat_ws(",", "event_type", "user_id").alias("l"))
    broken.write.mode("append").text(path)
    rolled = hourly_rollup(readers.read_hourly_csv(spark, path))
    return rolled.select(
        F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss").alias("timestamp"),
        "station_id",
        "station_name",
        "borough",
        F.col("entries").cast("double").alias("entries"),
        F.col("transfers").cast("double").alias("transfers"),
    )


@query(
    "a3_skills_csv_scan",
    "SELECT row_id AS job_link, skills AS job_skills FROM v_skills",
    "v_skills",
)
def a3(spark, d):
    source = v_skills(spark, d).select(
        F.col("row_id").alias("job_link"), F.col("skills").alias("job_skills")
    )
    back = readers.read_skills_csv(spark, _csv_copy(source, "skills"))
    return back.select(F.col("job_link").cast("long").alias("job_link"), "job_skills")


@query(
    "a4_multiline_csv_scan",
    """SELECT CAST(job_id AS VARCHAR) AS job_id, company_name, md5(title) AS title_hash,
       md5(description) AS description_hash, length(description) AS description_length
       FROM v_postings""",
    "v_postings",
)
def a4(spark, d):
    source = v_postings(spark, d).withColumn("unused", F.lit("x"))
    back = readers.read_postings_csv(spark, _csv_copy(source, "postings"))
    return back.select(
        "job_id",
        "company_name",
        F.md5(F.col("title")).alias("title_hash"),
        F.md5(F.col("description")).alias("description_hash"),
        F.length("description").cast("long").alias("description_length"),
    )


@query(
    "a5_parquet_scan",
    """SELECT l_orderkey, l_quantity FROM lineitem
       WHERE l_shipdate >= DATE '1998-01-01' AND l_quantity > 30""",
)
def a5(spark, d):
    scan = readers.read_parquet(spark, f"{d}/lineitem.parquet")
    since = F.lit("1998-01-01 00:00:00").cast("timestamp_ntz")
    return scan.where((F.col("l_shipdate") >= since) & (F.col("l_quantity") > 30)).select(
        "l_orderkey", "l_quantity"
    )


@query(
    "a6_parquet_sink",
    """SELECT year(timestamp) AS year, count(*) AS n, round(sum(entries), 2) AS entries
       FROM v_hourly GROUP BY 1""",
    "v_hourly",
)
def a6(spark, d):
    path = scratch_path(spark, "hourly-by-year")
    hourly = v_hourly(spark, d).withColumn("year", F.year("timestamp"))
    tables.write_parquet(hourly, path, ["year"])
    return (
        spark.read.parquet(path)
        .groupBy(F.col("year").cast("long").alias("year"))
        .agg(F.count("*").alias("n"), F.round(F.sum("entries"), 2).alias("entries"))
    )


@query(
    "a7_compute_once",
    "SELECT CAST(date AS VARCHAR) AS date, mode, value FROM v_daily",
    "v_daily",
)
def a7(spark, d):
    path = scratch_path(spark, "daily-once")
    tables.materialize(spark, path, lambda: v_daily(spark, d))

    def never():
        raise AssertionError("the finished table must be read back")

    return shaped(
        tables.materialize(spark, path, never), {"date": "string", "mode": None, "value": None}
    )


@query(
    "a8_output_columns",
    "SELECT c_custkey, c_mktsegment, round(c_acctbal, 2) AS c_acctbal FROM customer",
)
def a8(spark, d):
    kept = tables.keep_columns(
        table(spark, d, "customer"), ["c_custkey", "not_there", "c_mktsegment", "c_name"], ["c_a"]
    )
    return shaped(
        tables.drop_columns(kept, ["c_name", "also_missing"]),
        {"c_custkey": None, "c_mktsegment": None, "c_acctbal": 2},
    )


@query("a9_optional_input", "SELECT n_nationkey, n_name FROM nation")
def a9(spark, d):
    found = readers.read_or_fallback(spark, f"{d}/nation.parquet", lambda: None)
    again = readers.read_or_fallback(spark, f"{d}/not_there.parquet", lambda: found)
    return again.select("n_nationkey", "n_name")
