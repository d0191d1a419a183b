"""Skill lists and postings: cleaning, seeds, term weights, topics, classes."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import nmf as N
from tidemark.operators import tfidf as W
from tidemark.plans import postings as P
from tidemark.plans import skills as K
from tidemark.plans.topics import run_topic_model
from tidemark.registry.core import query, shaped
from tidemark.registry.tests import sql_normal_tail, sql_t_tail
from tidemark.registry.views import SEEDS, v_points, v_postings, v_skills
from tidemark.runtime import cut_lineage

_REMOTE = ["small ring", "red"]
_TECH = {"a": ["ring", "gear"], "b": ["hot", "blue bolt"]}


def skills(spark, d):
    return K.prepare_skills(v_skills(spark, d), "skills", None)


def prepared(spark, d):
    return P.prepare_postings(v_postings(spark, d))


def scored(spark, d):
    return P.seed_scores(prepared(spark, d), SEEDS)


def written_scores(spark, d):
    """The scores as a written table, for queries that read them more than once."""
    return cut_lineage(scored(spark, d))


@query(
    "h14_skills_preparation",
    """SELECT row_id, text_clean, array_to_string(regexp_split_to_array(text_clean, '\\s*,\\s*'), '|')
         AS items, len(list_filter(regexp_split_to_array(text_clean, '\\s*,\\s*'),
         lambda x: trim(x) <> '')) AS skill_count FROM skills_clean""",
    "skills_clean",
)
def h14(spark, d):
    return skills(spark, d).select(
        "row_id",
        "text_clean",
        F.concat_ws("|", "skills_list").alias("items"),
        F.col("skill_count").cast("long").alias("skill_count"),
    )


@query(
    "h15_remote_flag",
    "SELECT row_id, regexp_matches(text_clean, 'small ring|red') AS is_remote FROM skills_clean",
    "skills_clean",
)
def h15(spark, d):
    return skills(spark, d).select(
        "row_id", K.remote_flag("text_clean", _REMOTE).alias("is_remote")
    )


@query(
    "h16_tech_density",
    """SELECT row_id, round(least(CAST(len(regexp_extract_all(text_clean, 'blue bolt|gear|ring|hot'))
         AS DOUBLE) / CASE WHEN n = 0 THEN 1 ELSE n END, 1.0), 8) AS density
       FROM (SELECT *, len(list_filter(regexp_split_to_array(text_clean, '\\s*,\\s*'),
               lambda x: trim(x) <> '')) AS n FROM skills_clean)""",
    "skills_clean",
)
def h16(spark, d):
    density = K.tech_density("text_clean", "skill_count", _TECH)
    return shaped(
        skills(spark, d).withColumn("density", density), {"row_id": None, "density": 8}
    )


@query(
    "h17_skill_pairs",
    """WITH top AS (SELECT item FROM skills_items WHERE item <> '' GROUP BY 1
                    ORDER BY count(*) DESC, item LIMIT 100),
       k AS (SELECT * FROM skills_items WHERE item IN (SELECT item FROM top))
       SELECT least(a.item, b.item) AS skill_a, greatest(a.item, b.item) AS skill_b,
         count(*) AS weight FROM k a JOIN k b ON a.row_id = b.row_id AND a.pos < b.pos
       GROUP BY 1, 2 ORDER BY 3 DESC, 1, 2 LIMIT 5000""",
    "skills_items",
)
def h17(spark, d):
    return K.skill_pairs(skills(spark, d), top_n=100)


@query(
    "h18_postings_preparation",
    """SELECT job_id, company_name, location, md5(nlp_text_clean) AS text_hash, text_len,
       remote_allowed, normalized_salary, work_type_clean, is_fulltime FROM prepared""",
    "prepared",
)
def h18(spark, d):
    return prepared(spark, d).select(
        "job_id",
        "company_name",
        "location",
        F.md5("nlp_text_clean").alias("text_hash"),
        F.col("text_len").cast("long").alias("text_len"),
        F.col("remote_allowed").cast("long").alias("remote_allowed"),
        "normalized_salary",
        "work_type_clean",
        "is_fulltime",
    )


@query(
    "h19_structured_summary",
    """SELECT count(*) AS total, CAST(sum(remote_allowed) AS BIGINT) AS remote_count,
       round(avg(CAST(remote_allowed = 1 AS DOUBLE)), 8) AS remote_pct,
       round(avg(CAST(normalized_salary > 0 AS DOUBLE)), 8) AS has_salary_pct,
       round(avg(normalized_salary) FILTER (WHERE normalized_salary > 0), 6) AS salary_mean,
       round(median(normalized_salary) FILTER (WHERE normalized_salary > 0), 6) AS salary_median,
       round(avg(CAST(is_fulltime AS DOUBLE)), 8) AS fulltime_pct FROM prepared""",
    "prepared",
)
def h19(spark, d):
    out = P.structured_summary(cut_lineage(prepared(spark, d)))
    return shaped(
        out,
        {
            "total": None,
            "remote_count": None,
            "remote_pct": 8,
            "has_salary_pct": 8,
            "salary_mean": 6,
            "salary_median": 6,
            "fulltime_pct": 8,
        },
    )


_HITS = [f"hits_{c}" for c in SEEDS]


@query(
    "h20_seed_scores",
    f"""SELECT job_id, {', '.join(_HITS)}, hits_total, round(seed_density, 8) AS seed_density,
        is_new_quality_seed FROM scored""",
    "scored",
)
def h20(spark, d):
    columns = {**{h: "long" for h in _HITS}, "hits_total": "long", "seed_density": 8}
    return shaped(scored(spark, d), {"job_id": None, **columns, "is_new_quality_seed": None})


@query(
    "u3_seed_or_density",
    """SELECT job_id, is_new_quality_seed OR seed_density >
         (SELECT quantile_cont(seed_density, 0.75) FROM scored) AS is_new_quality_seed FROM scored""",
    "scored",
)
def u3(spark, d):
    rows = P.seed_scores(prepared(spark, d), SEEDS, density_quantile=0.75)
    return rows.select("job_id", "is_new_quality_seed")


_STOPS = ", ".join("'" + w.replace("'", "''") + "'" for w in [
    # A short stop list for the check; the library default is Spark's English list.
    "the", "and", "of", "in", "is", "to", "on", "as", "at", "by",
])
_STOP_LIST = [w.strip("'") for w in _STOPS.split(", ")]

TERM_SQL = f"""tok AS (SELECT job_id, location, list_filter(
         regexp_split_to_array(nlp_text_clean, '[^a-z0-9_]+'),
         lambda x: length(x) >= 2 AND NOT list_contains([{_STOPS}], x)) AS w FROM prepared),
       trm AS (SELECT job_id, unnest(list_concat(w, list_transform(range(1, len(w)),
         lambda i: w[i] || ' ' || w[i + 1]))) AS term FROM tok),
       tf AS (SELECT job_id, term, count(*) AS tf FROM trm GROUP BY 1, 2),
       nd AS (SELECT CAST(count(*) AS DOUBLE) AS n FROM prepared),
       voc AS (SELECT term, count(*) AS df, sum(tf) AS cf FROM tf GROUP BY 1
         HAVING count(*) >= 5 AND count(*) <= 0.7 * (SELECT n FROM nd)
         ORDER BY sum(tf) DESC, term LIMIT 5000),
       raw AS (SELECT job_id, tf.term, (1 + ln(tf)) * (ln((1 + n) / (1 + df)) + 1) AS raw
         FROM tf JOIN voc ON tf.term = voc.term, nd),
       wts AS (SELECT job_id, term, raw / sqrt(sum(raw * raw) OVER (PARTITION BY job_id)) AS w
         FROM raw)"""


def weights(spark, d, features: int = 5000):
    return W.fit_transform(prepared(spark, d), "job_id", "nlp_text_clean", _STOP_LIST, features)


@query(
    "j1_term_weights",
    f"WITH {TERM_SQL} SELECT job_id, term, round(w, 8) AS w FROM wts",
    "prepared",
)
def j1(spark, d):
    return shaped(weights(spark, d), {"job_id": None, "term": None, "w": 8})


@query(
    "j1_vocabulary",
    f"""WITH {TERM_SQL} SELECT term, df, CAST(cf AS BIGINT) AS cf,
        round(ln((1 + n) / (1 + df)) + 1, 8) AS idf FROM voc, nd""",
    "prepared",
)
def j1_vocabulary(spark, d):
    words = W.document_words(prepared(spark, d), "job_id", "nlp_text_clean")
    return shaped(W.vocabulary(words, _STOP_LIST, 5000), {"term": None, "df": None, "cf": None, "idf": 8})


@query("j2_fit_sample")
def j2(spark, d):
    """A sampling operator: the rows a caller may fit on; nothing else uses it."""
    return W.fit_sample(prepared(spark, d), "job_id", 0.5).select("job_id")


def _topic_model(spark, d):
    return run_topic_model(
        prepared(spark, d),
        "job_id",
        "nlp_text_clean",
        topics=20,
        max_features=5000,
        max_iter=400,
        stop_words=_STOP_LIST,
    )


@query("j4_topic_factorisation")
def j4(spark, d):
    """Topic weights of every posting."""
    document_topics, _ = _topic_model(spark, d)
    return document_topics


@query("h21_topic_model_labels")
def h21_model(spark, d):
    _, model = _topic_model(spark, d)
    labels = P.topic_labels(N.topic_terms(spark, model, 15), SEEDS)
    return labels.select(
        "topic",
        F.concat_ws(" ", "top_words").alias("top_words"),
        F.concat_ws("+", "categories").alias("categories"),
        "label",
    )


_LANGS = ["de", "en", "es", "fr"]


@query(
    "h21_topic_labels",
    f"""WITH {TERM_SQL},
        tt AS (SELECT list_position({_LANGS}, location) - 1 AS topic, term, round(sum(w), 6) AS w
               FROM wts JOIN prepared p ON wts.job_id = p.job_id GROUP BY 1, 2),
        top AS (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY w DESC, term) AS r FROM tt
                QUALIFY r <= 15),
        lab AS (SELECT topic, string_agg(term, '|' ORDER BY r) AS top_words,
                  list(term) AS words FROM top GROUP BY 1)
        SELECT topic, top_words, CASE WHEN tag = '' THEN 'traditional' ELSE tag END AS label FROM (
          SELECT topic, top_words, concat_ws('+', """
    + ", ".join(
        f"CASE WHEN len(list_intersect(words, {sorted(p)})) > 0 THEN '{c}' END"
        for c, p in SEEDS.items()
    )
    + ") AS tag FROM lab)",
    "prepared",
)
def h21(spark, d):
    """Labels of given topics: each language is a topic with its summed term weights."""
    topic = F.array_position(F.array(*[F.lit(v) for v in _LANGS]), F.col("location")) - 1
    places = v_postings(spark, d).select("job_id", topic.alias("topic"))
    sums = (
        weights(spark, d)
        .join(places, "job_id")
        .groupBy("topic", "term")
        .agg(F.round(F.sum("w"), 6).alias("w"))
    )
    labels = P.topic_labels(sums, SEEDS, 15)
    return labels.select(
        F.col("topic").cast("long").alias("topic"),
        F.concat_ws("|", "top_words").alias("top_words"),
        "label",
    )


def _given_topics(spark, d):
    """Weights of 64 given topics per document, and topics counted as new by their first weights."""
    points = v_points(spark, d).select(
        F.col("id").alias("job_id"),
        F.transform("features", lambda x: F.abs(x).cast("double")).alias("weights"),
    )
    labels = (
        points.select(F.posexplode("weights").alias("topic", "w"))
        .groupBy("topic")
        .agg((F.avg("w") > 0.1).alias("is_new_quality"))
    )
    return points, labels


_GIVEN_SQL = """gw AS (SELECT vec_id AS job_id, list_transform(embedding,
         lambda x: abs(CAST(x AS DOUBLE))) AS w FROM embeddings),
       gl AS (SELECT i - 1 AS topic, avg(w[i]) > 0.1 AS is_new FROM
         (SELECT w, unnest(range(1, 65)) AS i FROM gw) GROUP BY 1),
       gt AS (SELECT job_id, list_position(w, list_max(w)) - 1 AS primary_topic,
         list_max(w) AS topic_confidence FROM gw),
       gc AS (SELECT gt.*, coalesce(gl.is_new, false) AS is_new_quality_nmf
         FROM gt LEFT JOIN gl ON gt.primary_topic = gl.topic)"""


@query(
    "h22_topic_classes",
    f"""WITH {_GIVEN_SQL} SELECT job_id, primary_topic, round(topic_confidence, 6)
        AS topic_confidence, is_new_quality_nmf FROM gc""",
)
def h22(spark, d):
    points, labels = _given_topics(spark, d)
    out = P.classify_by_topic(points, labels, "job_id")
    return shaped(
        out,
        {
            "job_id": None,
            "primary_topic": "long",
            "topic_confidence": 6,
            "is_new_quality_nmf": None,
        },
    )


def classified(spark, d, scores=None):
    points, labels = _given_topics(spark, d)
    scores = scored(spark, d) if scores is None else scores
    return P.classify_postings(P.classify_by_topic(points, labels, "job_id"), scores, "job_id")


@query(
    "h23_dual_classes",
    f"""WITH {_GIVEN_SQL} SELECT s.job_id, primary_topic, is_new_quality_nmf,
        is_new_quality_seed, is_new_quality_nmf OR is_new_quality_seed AS is_new_quality,
        round(seed_density, 8) AS seed_density FROM gc JOIN scored s ON gc.job_id = s.job_id""",
    "scored",
)
def h23(spark, d):
    return shaped(
        classified(spark, d),
        {
            "job_id": None,
            "primary_topic": "long",
            "is_new_quality_nmf": None,
            "is_new_quality_seed": None,
            "is_new_quality": None,
            "seed_density": 8,
        },
    )


@query(
    "h23_strategy_overlap",
    f"""WITH {_GIVEN_SQL}, x AS (SELECT is_new_quality_nmf AS a, is_new_quality_seed AS b
          FROM gc JOIN scored s ON gc.job_id = s.job_id)
        SELECT count(*) AS n, count(*) FILTER (WHERE a) AS n_topic,
          count(*) FILTER (WHERE b) AS n_seed, count(*) FILTER (WHERE a OR b) AS n_either,
          count(*) FILTER (WHERE a AND NOT b) AS n_only_topic,
          count(*) FILTER (WHERE b AND NOT a) AS n_only_seed,
          count(*) FILTER (WHERE a AND b) AS n_both FROM x""",
    "scored",
)
def h23_overlap(spark, d):
    return P.strategy_overlap(classified(spark, d))


def _t_row(name: str, value: str) -> str:
    return f"""SELECT '{name}' AS dimension, 't-test' AS test, ma AS a, mb AS b,
        (ma - mb) / sqrt(va / na + vb / nb) AS stat,
        power(va / na + vb / nb, 2) / (power(va / na, 2) / (na - 1) + power(vb / nb, 2) / (nb - 1))
          AS df FROM (SELECT avg(v) FILTER (WHERE g) AS ma, avg(v) FILTER (WHERE NOT g) AS mb,
          var_samp(v) FILTER (WHERE g) AS va, var_samp(v) FILTER (WHERE NOT g) AS vb,
          count(v) FILTER (WHERE g) AS na, count(v) FILTER (WHERE NOT g) AS nb
          FROM (SELECT is_new_quality_seed AS g, CAST({value} AS DOUBLE) AS v FROM scored))"""


def _chi_row(name: str, mark: str) -> str:
    return f"""SELECT '{name}' AS dimension, 'chi2' AS test,
        CAST(n22 AS DOUBLE) / (n21 + n22) AS a, CAST(n12 AS DOUBLE) / (n11 + n12) AS b,
        power(greatest(abs(n11 * n22 - n12 * n21) - n / 2, 0), 2) * n
          / ((n11 + n12) * (n21 + n22) * (n11 + n21) * (n12 + n22)) AS stat, 1.0 AS df
        FROM (SELECT CAST(count(*) FILTER (WHERE NOT g AND NOT m) AS DOUBLE) AS n11,
          count(*) FILTER (WHERE NOT g AND m) AS n12, count(*) FILTER (WHERE g AND NOT m) AS n21,
          count(*) FILTER (WHERE g AND m) AS n22, CAST(count(*) AS DOUBLE) AS n
          FROM (SELECT is_new_quality_seed AS g, {mark} AS m FROM scored))"""


_COMPARISON_SQL = " UNION ALL ".join(
    [
        _chi_row("remote", "remote_allowed = 1"),
        _t_row("salary", "CASE WHEN normalized_salary > 0 THEN normalized_salary END"),
        _chi_row("fulltime", "is_fulltime"),
        _t_row("diversity", "diversity"),
        _t_row("text_len", "text_len"),
    ]
)


@query(
    "h24_group_comparison",
    f"""WITH c AS ({_COMPARISON_SQL}), p AS (SELECT *, CASE WHEN test = 'chi2'
          THEN {sql_normal_tail('sqrt(stat)')} ELSE {sql_t_tail('stat', 'df')} END AS p FROM c)
        SELECT dimension, test, round(a, 6) AS new_value, round(b, 6) AS traditional_value,
          round(a - b, 6) AS difference, round(stat, 6) AS statistic, round(abs(p), 7) AS p_value,
          CASE WHEN p < 0.001 THEN '***' WHEN p < 0.01 THEN '**' WHEN p < 0.05 THEN '*'
               ELSE 'ns' END AS stars FROM p""",
    "scored",
)
def h24(spark, d):
    rows = written_scores(spark, d).withColumnRenamed("is_new_quality_seed", "is_new_quality")
    values = {c: 6 for c in ("new_value", "traditional_value", "difference", "statistic")}
    return shaped(
        P.compare_groups(rows, "is_new_quality", _HITS),
        {"dimension": None, "test": None, **values, "p_value": 7, "stars": None},
    )


@query(
    "h24_salary_medians",
    """SELECT is_new_quality_seed, count(*) AS n, round(median(normalized_salary), 6)
         AS median_salary FROM scored WHERE normalized_salary > 0 GROUP BY 1""",
    "scored",
)
def h24_medians(spark, d):
    out = P.salary_medians(written_scores(spark, d), "is_new_quality_seed")
    return shaped(out, {"is_new_quality_seed": None, "n": None, "median_salary": 6})


@query(
    "c17_topic_summary",
    f"""WITH {_GIVEN_SQL}, x AS (SELECT primary_topic, s.*, is_new_quality_nmf OR is_new_quality_seed
          AS q FROM gc JOIN scored s ON gc.job_id = s.job_id)
        SELECT primary_topic, count(*) AS n_jobs, round(avg(remote_allowed), 8) AS remote_pct,
          round(avg(normalized_salary) FILTER (WHERE normalized_salary > 0), 6) AS avg_salary,
          round(avg(CAST(q AS DOUBLE)), 8) AS new_share,
          round(avg(CAST(is_fulltime AS DOUBLE)), 8) AS fulltime_pct,
          avg(CAST(q AS DOUBLE)) > 0.5 AS is_new_topic FROM x GROUP BY 1 HAVING count(*) >= 5""",
    "scored",
)
def c17(spark, d):
    scores = written_scores(spark, d)
    rows = classified(spark, d, scores).join(
        scores.select("job_id", "remote_allowed", "normalized_salary", "is_fulltime"), "job_id"
    )
    shape = {"primary_topic": "long", "n_jobs": None, "remote_pct": 8, "avg_salary": 6}
    return shaped(
        P.topic_summary(rows, minimum=5),
        {**shape, "new_share": 8, "fulltime_pct": 8, "is_new_topic": None},
    )


