"""Views that bind the fixture tables to the data model, once as DataFrames and once as SQL."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.text import join_text
from tidemark.plans.recovery import daily_rollup, monthly_recovery
from tidemark.plans.stations import STATION, TIMESTAMP_FORMAT
from tidemark.runtime import spread

BASELINE = [(date(1995, 1, 1), date(1995, 2, 28))]
BASELINE_WITH_FALLBACK = [
    (date(1995, 1, 1), date(1995, 1, 1)),
    (date(1998, 1, 1), date(1998, 12, 31)),
]
SHOCK = (date(1995, 3, 1), date(1995, 6, 30))
RECENT = (date(2001, 1, 1), date(2001, 7, 31))
BREAK = date(1997, 12, 1)
PLACEBOS = [date(1996, 6, 1), date(1998, 6, 1)]
MODES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
CORE_MODES = MODES[:4]
ERAS = {
    "E1": (date(1995, 3, 1), date(1995, 6, 30)),
    "E2": (date(1995, 7, 1), date(1996, 12, 31)),
    "E3": (date(1997, 1, 1), date(1998, 12, 31)),
    "E4": (date(1999, 1, 1), date(2001, 7, 31)),
}
YEARS = [1995, 1996, 1997, 1998, 1999, 2000, 2001]
BOROUGHS = ["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"]

# Frozen seed phrases over the invented words of the documents.
SEEDS = {
    "c1": ["thtion", "thanea"],
    "c2": ["erble", "ertion"],
    "c3": ["attion", "antion"],
    "c4": ["thanedble", "thble"],
    "c5": ["eriner", "ering"],
    "c6": ["ontion", "onen"],
    "c7": ["retion", "oning"],
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def money(name: str):
    """Two-decimal amounts add up exactly as decimals."""
    return F.col(name).cast("decimal(18,2)")


def v_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    daily = daily_rollup(
        orders, F.col("o_orderdate"), F.col("o_orderpriority"), money("o_totalprice")
    )
    return daily.withColumn("value", F.col("value").cast("double"))


def monthly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return monthly_recovery(v_daily(spark, sf_dir), BASELINE)


def v_hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    return (
        events.select(
            F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("timestamp"),
            F.col("user_id").alias("station_id"),
            F.concat(F.lit("U"), F.col("user_id")).alias("station_name"),
            F.concat(F.lit("B"), F.col("user_id") % 5).alias("borough"),
            money("value").alias("entries"),
        )
        .groupBy("timestamp", *STATION)
        .agg(F.sum("entries").cast("double").alias("entries"), F.count("*").alias("transfers"))
    )


def week():
    return F.weekofyear("timestamp")


def v_activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items with the station, region and day of their supplier."""
    lineitem = table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("station_id"),
        F.to_date("l_shipdate").alias("date"),
        F.year("l_shipdate").alias("year"),
        F.col("l_quantity").alias("entries"),
    )
    supplier = table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("station_id"), F.col("s_nationkey").alias("nation")
    )
    nation = table(spark, sf_dir, "nation")
    region = table(spark, sf_dir, "region")
    places = nation.join(region, nation.n_regionkey == region.r_regionkey).select(
        F.col("n_nationkey").alias("nation"), F.col("r_name").alias("borough")
    )
    # Suppliers grow with the data, so their join is left to adaptive execution.
    return lineitem.join(supplier, "station_id").join(places, "nation")


def v_yearly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return v_activity(spark, sf_dir).select("station_id", "borough", "year", "entries")


def v_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily quantity per nation on a complete calendar."""
    activity = v_activity(spark, sf_dir)
    sums = activity.groupBy(F.col("nation").alias("station_id"), "date").agg(
        F.sum("entries").alias("value")
    )
    span = activity.agg(F.min("date").alias("a"), F.max("date").alias("b"))
    days = span.select(F.explode(F.sequence("a", "b")).alias("date")).agg(
        F.collect_list("date").alias("d")
    )
    grid = (
        sums.select("station_id")
        .distinct()
        .withColumn("date", F.explode(days.scalar()))
    )
    return grid.join(sums, ["station_id", "date"], "left").select(
        "station_id", "date", F.coalesce("value", F.lit(0.0)).alias("value")
    )


def v_raw_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as an all-text table with unreadable numbers on error events."""
    return table(spark, sf_dir, "events").select(
        F.date_format("ts", TIMESTAMP_FORMAT).alias("transit_timestamp"),
        F.col("user_id").cast("string").alias("station_complex_id"),
        F.concat(F.lit("Stop, "), F.col("user_id")).alias("station_complex"),
        F.concat(F.lit("B"), F.col("user_id") % 5).alias("borough"),
        F.when(F.col("event_type") == "error", "n/a")
        .otherwise(F.floor("value").cast("string"))
        .alias("ridership"),
        F.length("props").cast("string").alias("transfers"),
    )


def v_skills(spark: SparkSession, sf_dir: str) -> DataFrame:
    lineitem = table(spark, sf_dir, "lineitem")
    part = table(spark, sf_dir, "part").select("p_partkey", "p_name")
    entry = F.struct(
        "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice", "p_name"
    )
    return (
        lineitem.join(part, lineitem.l_partkey == part.p_partkey)
        .groupBy(F.col("l_orderkey").alias("row_id"))
        .agg(F.sort_array(F.collect_list(entry)).alias("e"))
        .select(
            "row_id",
            F.concat_ws(", ", F.transform("e", lambda x: x["p_name"])).alias("skills"),
        )
    )


def v_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", "url")


def v_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = spread(table(spark, sf_dir, "documents"), "doc_id")
    labels = table(spark, sf_dir, "labels")
    return documents.join(labels, "doc_id", "left").select(
        F.col("doc_id").alias("job_id"),
        F.col("source").alias("company_name"),
        F.substring_index("text", "\n", 1).alias("title"),
        F.col("text").alias("description"),
        F.col("toxic").alias("remote_allowed"),
        F.when(F.col("quality") == 1, " full_time")
        .when(F.col("quality") == 0, "Part_time")
        .alias("work_type"),
        F.col("n_chars").cast("string").alias("normalized_salary"),
        F.col("lang").alias("location"),
    )


def v_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("id"), F.col("embedding").alias("features"), "label"
    )


def posting_text(title: str = "title", description: str = "description"):
    return join_text(title, description)


CLEAN = (
    "trim(regexp_replace(regexp_replace(lower({0}), '[^a-z0-9+#\\s]', ' ', 'g'), '\\s+', ' ', 'g'))"
)
CLEAN_COMMAS = (
    "trim(regexp_replace(regexp_replace(lower({0}), '[^a-z0-9+#,\\s]', ' ', 'g'), '\\s+', ' ', 'g'))"
)


def sql_hits(column: str, phrases: list[str]) -> str:
    ordered = sorted(set(phrases), key=lambda p: (-len(p), p))
    return f"len(regexp_extract_all({column}, '(?i){'|'.join(ordered)}'))"


_MONTHLY = """
SELECT m.year, m.month, m.mode, make_date(m.year, m.month, 1) AS date, m.value, b.baseline,
       m.value / nullif(b.baseline, 0) AS recovery_rate
FROM (SELECT CAST(year(date) AS INTEGER) AS year, CAST(month(date) AS INTEGER) AS month, mode,
             avg(value) AS value FROM v_daily GROUP BY 1, 2, 3) m
LEFT JOIN (SELECT mode, avg(value) AS baseline FROM v_daily
           WHERE date BETWEEN DATE '1995-01-01' AND DATE '1995-02-28' GROUP BY mode) b
ON m.mode = b.mode"""

_PEAKS = """
SELECT {period} AS period, station_id, station_name, borough,
       avg(CASE WHEN hour(timestamp) IN (7, 8, 9) THEN entries END) AS peak_morning,
       avg(CASE WHEN hour(timestamp) IN (17, 18, 19) THEN entries END) AS peak_evening
FROM v_hourly GROUP BY 1, 2, 3, 4"""

VIEWS: dict[str, tuple[str, str]] = {
    "v_daily": (
        "",
        """SELECT CAST(o_orderdate AS DATE) AS date, o_orderpriority AS mode,
           CAST(sum(CAST(o_totalprice AS DECIMAL(18, 2))) AS DOUBLE) AS value
           FROM orders GROUP BY 1, 2""",
    ),
    "monthly": ("v_daily", _MONTHLY),
    "v_hourly": (
        "",
        """SELECT date_trunc('hour', ts) AS timestamp, user_id AS station_id,
           'U' || user_id AS station_name, 'B' || (user_id % 5) AS borough,
           CAST(sum(CAST(value AS DECIMAL(18, 2))) AS DOUBLE) AS entries,
           count(*) AS transfers FROM events GROUP BY 1, 2, 3, 4""",
    ),
    "weekly_peaks": ("v_hourly", _PEAKS.format(period="week(timestamp)")),
    "weekly_ratios": (
        "weekly_peaks",
        """SELECT *, peak_morning / nullif(peak_evening, 0) AS commute_ratio FROM weekly_peaks
           WHERE peak_morning / nullif(peak_evening, 0) > 0.1
             AND peak_morning / nullif(peak_evening, 0) < 10""",
    ),
    "v_activity": (
        "",
        """SELECT l_suppkey AS station_id, CAST(l_shipdate AS DATE) AS date,
           CAST(year(l_shipdate) AS INTEGER) AS year, l_quantity AS entries,
           s_nationkey AS nation, r_name AS borough
           FROM lineitem JOIN supplier ON l_suppkey = s_suppkey
           JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""",
    ),
    "v_yearly": ("v_activity", "SELECT station_id, borough, year, entries FROM v_activity"),
    "v_series": (
        "v_activity",
        """SELECT g.station_id, g.date, coalesce(s.value, 0.0) AS value FROM (
             SELECT n.nation AS station_id, CAST(d.day AS DATE) AS date
             FROM (SELECT DISTINCT nation FROM v_activity) n,
                  (SELECT unnest(generate_series(min(date), max(date), INTERVAL 1 DAY)) AS day
                   FROM v_activity) d) g
           LEFT JOIN (SELECT nation, date, sum(entries) AS value FROM v_activity GROUP BY 1, 2) s
           ON g.station_id = s.nation AND g.date = s.date""",
    ),
    "v_raw_text": (
        "",
        """SELECT strftime(ts, '%m/%d/%Y %I:%M:%S %p') AS transit_timestamp,
           CAST(user_id AS VARCHAR) AS station_complex_id,
           'Stop, ' || user_id AS station_complex, 'B' || (user_id % 5) AS borough,
           CASE WHEN event_type = 'error' THEN 'n/a'
                ELSE CAST(CAST(floor(value) AS BIGINT) AS VARCHAR) END AS ridership,
           CAST(length(props) AS VARCHAR) AS transfers FROM events""",
    ),
    "v_skills": (
        "",
        """SELECT l_orderkey AS row_id,
           string_agg(p_name, ', ' ORDER BY l_linenumber, l_partkey, l_quantity, l_extendedprice)
             AS skills
           FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1""",
    ),
    "skills_clean": (
        "v_skills",
        f"""SELECT row_id, {CLEAN_COMMAS.format('skills')} AS text_clean FROM v_skills
            WHERE length({CLEAN_COMMAS.format('skills')}) > 5""",
    ),
    "skills_items": (
        "skills_clean",
        """SELECT row_id, pos, trim(items[pos]) AS item FROM (
             SELECT row_id, items, unnest(range(1, len(items) + 1)) AS pos FROM (
               SELECT row_id, regexp_split_to_array(text_clean, '\\s*,\\s*') AS items
               FROM skills_clean))""",
    ),
    "v_links": ("", "SELECT page_id, url FROM pages"),
    "v_postings": (
        "",
        """SELECT d.doc_id AS job_id, source AS company_name, split_part(text, chr(10), 1) AS title,
           text AS description, toxic AS remote_allowed,
           CASE WHEN quality = 1 THEN ' full_time' WHEN quality = 0 THEN 'Part_time' END
             AS work_type,
           CAST(n_chars AS VARCHAR) AS normalized_salary, lang AS location
           FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""",
    ),
    "first_postings": (
        "v_postings",
        """SELECT * FROM v_postings QUALIFY
           row_number() OVER (PARTITION BY company_name, title ORDER BY job_id) = 1""",
    ),
    "prepared": (
        "first_postings",
        f"""SELECT * FROM (
              SELECT job_id, company_name, title, location,
                     {CLEAN.format("title || ' ' || description")} AS nlp_text_clean,
                     coalesce(remote_allowed, 0) AS remote_allowed,
                     TRY_CAST(normalized_salary AS DOUBLE) AS normalized_salary,
                     trim(upper(coalesce(work_type, 'UNKNOWN'))) AS work_type_clean,
                     trim(upper(coalesce(work_type, 'UNKNOWN')))
                       IN ('FULL_TIME', 'FULL-TIME', 'FULLTIME') AS is_fulltime,
                     length({CLEAN.format("title || ' ' || description")}) AS text_len
              FROM first_postings) WHERE text_len > 20""",
    ),
    "hits": (
        "prepared",
        "SELECT *, "
        + ", ".join(f"{sql_hits('nlp_text_clean', p)} AS hits_{c}" for c, p in SEEDS.items())
        + " FROM prepared",
    ),
    "scored": (
        "hits",
        "SELECT *, "
        + " + ".join(f"hits_{c}" for c in SEEDS)
        + " AS hits_total, least(("
        + " + ".join(f"hits_{c}" for c in SEEDS)
        + ") / (text_len / 1000.0), 10.0) AS seed_density, "
        + " + ".join(f"CAST(hits_{c} > 0 AS INTEGER)" for c in SEEDS)
        + " AS diversity, ("
        + " + ".join(f"CAST(hits_{c} > 0 AS INTEGER)" for c in SEEDS)
        + ") >= 2 AS is_new_quality_seed FROM hits",
    ),
}


def with_views(names: list[str], sql: str) -> str:
    """Prefix ``sql`` with the named sub-queries and everything they read."""
    ordered: list[str] = []

    def visit(name: str) -> None:
        needs, _ = VIEWS[name]
        for other in needs.split():
            visit(other)
        if name not in ordered:
            ordered.append(name)

    for name in names:
        visit(name)
    if not ordered:
        return sql
    body = ",\n".join(f"{n} AS ({VIEWS[n][1]})" for n in ordered)
    head = f"WITH {body}"
    stripped = sql.strip()
    if stripped.upper().startswith("WITH "):
        return f"{head},\n{stripped[5:]}"
    return f"{head}\n{stripped}"
