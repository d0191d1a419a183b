"""Job-posting corpus: preparation, seed scores, topic classes and group comparison."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.columns import (
    clip,
    masked_mean,
    positive,
    positive_count,
    row_sum,
    share,
    significance_stars,
    to_double,
)
from tidemark.functions.seeds import ENRICHED_SEEDS
from tidemark.functions.tails import chi2_one_tail, t_tail
from tidemark.functions.text import (
    category_tag,
    clean_text,
    computed_once,
    count_phrases,
    join_text,
    normal_code,
    words_in,
)
from tidemark.operators.inference import welch_columns, yates_columns
from tidemark.operators.quantiles import exact_median, exact_quantiles
from tidemark.operators.rollup import first_by
from tidemark.runtime import cut_lineage

# Spellings of the full-time code.
FULL_TIME_CODES = ("FULL_TIME", "FULL-TIME", "FULLTIME")
TOPIC_MINIMUM = 50

ENRICHED_COLUMNS = (
    "job_id", "company_name", "title", "location", "remote_allowed", "normalized_salary",
    "work_type_clean", "is_fulltime", "formatted_experience_level", "text_len", "primary_topic",
    "topic_confidence", "is_new_quality_nmf", "is_new_quality_seed", "is_new_quality",
    "seed_density",
)


def prepare_postings(df: DataFrame, key: str = "job_id", min_length: int = 20) -> DataFrame:
    """First posting per company and title, joined and cleaned text, typed fields.

    Missing titles, descriptions and locations get a constant; texts of ``min_length`` characters
    or fewer are dropped.
    """
    firsts = first_by(df, ["company_name", "title"], key)
    empty = lambda c: F.coalesce(F.col(c), F.lit(""))
    texts = firsts.withColumns({"title": empty("title"), "description": empty("description")})
    cleaned = clean_text(join_text("title", "description"))
    rows = (
        computed_once(texts, "nlp_text_clean", cleaned)
        .withColumn("text_len", F.length("nlp_text_clean"))
        .where(F.col("text_len") > min_length)
        .withColumns(
            {
                "remote_allowed": F.coalesce(to_double("remote_allowed"), F.lit(0.0)).cast("int"),
                "normalized_salary": to_double("normalized_salary"),
            }
        )
    )
    if "work_type" in df.columns:
        rows = rows.withColumn("work_type_clean", normal_code("work_type")).withColumn(
            "is_fulltime", F.col("work_type_clean").isin(*FULL_TIME_CODES)
        )
    if "location" in df.columns:
        rows = rows.withColumn("location", F.coalesce("location", F.lit("Unknown")))
    return rows


def structured_summary(df: DataFrame) -> DataFrame:
    """One row: totals, remote and full-time share, salary coverage, mean and exact median."""
    salary = F.col("normalized_salary")
    paid = positive(salary)
    totals = df.agg(
        F.count("*").alias("total"),
        F.sum("remote_allowed").cast("long").alias("remote_count"),
        share(F.col("remote_allowed") == 1).alias("remote_pct"),
        share(paid).alias("has_salary_pct"),
        masked_mean(paid, salary).alias("salary_mean"),
        share(F.col("is_fulltime")).alias("fulltime_pct"),
    )
    median = exact_median(df.where(paid), [], "normalized_salary", "salary_median")
    return totals.withColumn("salary_median", median.select("salary_median").scalar())


def seed_scores(
    df: DataFrame,
    seeds: Mapping[str, Iterable[str]] = ENRICHED_SEEDS,
    text: str = "nlp_text_clean",
    length: str = "text_len",
    min_categories: int = 2,
    density_quantile: float | None = None,
    word_boundary: bool = False,
) -> DataFrame:
    """Hits in the cleaned text per category, total, density per 1000 characters (at most 10) and the seed flag.

    All categories are counted in one projection over one scan. With ``density_quantile`` a
    density above that exact quantile sets the flag as well; the counts are then written once,
    since the quantile and the flag both read them.
    """
    hits = {
        f"hits_{name}": count_phrases(text, phrases, word_boundary, lowered=True)
        for name, phrases in seeds.items()
    }
    names = list(hits)
    rows = (
        df.withColumns(hits)
        .withColumn("hits_total", row_sum(names))
        .withColumn(
            "seed_density",
            clip(F.try_divide(F.col("hits_total"), F.col(length) / 1000.0), high=10.0),
        )
    )
    flag = positive_count(names) >= min_categories
    if density_quantile is not None:
        rows = cut_lineage(rows)
        limit = exact_quantiles(rows, [], "seed_density", [density_quantile], ["q"])
        flag = flag | (F.col("seed_density") > limit.select("q").scalar())
    return rows.withColumn("is_new_quality_seed", flag)


def topic_labels(
    topic_terms: DataFrame, seeds: Mapping[str, Iterable[str]] = ENRICHED_SEEDS, top_n: int = 15
) -> DataFrame:
    """Top words and scores per topic, the seed categories they belong to, and a label.

    A topic has at most as many rows as the bounded vocabulary.
    """
    order = Window.partitionBy("topic").orderBy(F.desc("w"), "term")
    top = (
        topic_terms.withColumn("r", F.row_number().over(order))
        .where(F.col("r") <= top_n)
        .groupBy("topic")
        .agg(F.sort_array(F.collect_list(F.struct("r", "term", "w"))).alias("t"))
        .select(
            "topic",
            F.transform("t", lambda t: t["term"]).alias("top_words"),
            F.transform("t", lambda t: F.round(t["w"], 4)).alias("top_scores"),
        )
    )
    found = [
        F.when(F.size(words_in("top_words", phrases)) > 0, F.lit(name))
        for name, phrases in seeds.items()
    ]
    return (
        top.withColumn("categories", F.array_compact(F.array(*found)))
        .withColumn("label", category_tag("categories", "traditional"))
        .withColumn("is_new_quality", F.size("categories") > 0)
    )


def classify_by_topic(document_topics: DataFrame, labels: DataFrame, key: str) -> DataFrame:
    """Primary topic (first of equal weights), its weight, and whether its label is a seed one.

    ``labels`` has one row per topic, a number fixed by the model.
    """
    best = F.array_max("weights")
    return (
        document_topics.select(
            key,
            (F.array_position("weights", best) - 1).cast("int").alias("primary_topic"),
            best.alias("topic_confidence"),
        )
        .join(
            F.broadcast(
                labels.select(
                    F.col("topic").alias("primary_topic"),
                    F.col("is_new_quality").alias("is_new_quality_nmf"),
                )
            ),
            "primary_topic",
            "left",
        )
        .withColumn("is_new_quality_nmf", F.coalesce("is_new_quality_nmf", F.lit(False)))
    )


def classify_postings(topics: DataFrame, scores: DataFrame, key: str) -> DataFrame:
    """Either strategy is enough: topic label or seed flag."""
    hits = [c for c in scores.columns if c.startswith("hits_")]
    return topics.join(
        scores.select(key, "is_new_quality_seed", "seed_density", *hits), key
    ).withColumn("is_new_quality", F.col("is_new_quality_nmf") | F.col("is_new_quality_seed"))


def strategy_overlap(classified: DataFrame) -> DataFrame:
    a, b = F.col("is_new_quality_nmf"), F.col("is_new_quality_seed")
    return classified.agg(
        F.count("*").alias("n"),
        F.count_if(a).alias("n_topic"),
        F.count_if(b).alias("n_seed"),
        F.count_if(a | b).alias("n_either"),
        F.count_if(a & ~b).alias("n_only_topic"),
        F.count_if(b & ~a).alias("n_only_seed"),
        F.count_if(a & b).alias("n_both"),
    )


def topic_summary(df: DataFrame, topic: str = "primary_topic", minimum: int = TOPIC_MINIMUM) -> DataFrame:
    """Size, remote, salary, class and full-time figures of every topic with enough postings."""
    salary = F.col("normalized_salary")
    return (
        df.groupBy(topic)
        .agg(
            F.count("*").alias("n_jobs"),
            F.avg("remote_allowed").alias("remote_pct"),
            masked_mean(positive(salary), salary).alias("avg_salary"),
            share(F.col("is_new_quality")).alias("new_share"),
            share(F.col("is_fulltime")).alias("fulltime_pct"),
        )
        .where(F.col("n_jobs") >= minimum)
        .withColumn("is_new_topic", F.col("new_share") > 0.5)
    )


def _measured(dimension: str, flag: Column, value: Column) -> tuple[list[Column], Column]:
    aggregates = []
    for side, group in (("a", flag), ("b", ~flag)):
        v = F.when(group, value.cast("double"))
        aggregates += [
            F.count(v).alias(f"{dimension}_n_{side}"),
            F.avg(v).alias(f"{dimension}_mean_{side}"),
            F.var_samp(v).alias(f"{dimension}_var_{side}"),
        ]
    return aggregates, _comparison_row(dimension, "t-test", has_cells=False)


def _counted(dimension: str, flag: Column, mark: Column) -> tuple[list[Column], Column]:
    aggregates = []
    for side, group in (("a", flag), ("b", ~flag)):
        v = F.when(group, mark.cast("double"))
        aggregates += [
            F.count(v).alias(f"{dimension}_n_{side}"),
            F.avg(v).alias(f"{dimension}_mean_{side}"),
            F.var_samp(v).alias(f"{dimension}_var_{side}"),
        ]
    for i, group in ((1, ~flag), (2, flag)):
        for j, hit in ((1, ~mark), (2, mark)):
            aggregates.append(F.count_if(group & hit).alias(f"{dimension}_n{i}{j}"))
    return aggregates, _comparison_row(dimension, "chi2", has_cells=True)


def _comparison_row(dimension: str, test: str, has_cells: bool) -> Column:
    fields = [F.lit(dimension).alias("dimension"), F.lit(test).alias("test")]
    for side in ("a", "b"):
        fields += [
            F.col(f"{dimension}_{m}_{side}").alias(f"{m}_{side}") for m in ("n", "mean", "var")
        ]
    for cell in ("n11", "n12", "n21", "n22"):
        source = F.col(f"{dimension}_{cell}") if has_cells else F.lit(None).cast("long")
        fields.append(source.alias(cell))
    return F.struct(*fields)


def compare_groups(
    df: DataFrame,
    flag: str = "is_new_quality",
    hits: Sequence[str] = (),
) -> DataFrame:
    """Five dimensions of the flagged postings against the others with a test each.

    All sums come from one aggregation; tests run on its five result rows.
    """
    group = F.col(flag)
    salary = F.when(positive("normalized_salary"), F.col("normalized_salary"))
    parts = [
        _counted("remote", group, F.col("remote_allowed") == 1),
        _measured("salary", group, salary),
        _counted("fulltime", group, F.col("is_fulltime")),
    ]
    if hits:
        parts.append(_measured("diversity", group, positive_count(list(hits))))
    parts.append(_measured("text_len", group, F.col("text_len")))
    sums = df.where(group.isNotNull()).agg(*[a for aggregates, _ in parts for a in aggregates])
    is_t = F.col("test") == "t-test"
    return (
        sums.select(F.inline(F.array(*[row for _, row in parts])))
        .withColumns({**welch_columns(), "chi2": yates_columns()})
        .withColumn("statistic", F.when(is_t, F.col("t_stat")).otherwise(F.col("chi2")))
        .withColumn("_pt", t_tail(F.when(is_t, F.col("t_stat")), "df"))
        .withColumn("_pc", chi2_one_tail("chi2"))
        .withColumn("p_value", F.when(is_t, F.col("_pt")).otherwise(F.col("_pc")))
        .withColumn("stars", significance_stars("p_value"))
        .select(
            "dimension", "test", F.col("mean_a").alias("new_value"),
            F.col("mean_b").alias("traditional_value"),
            (F.col("mean_a") - F.col("mean_b")).alias("difference"),
            "statistic", "p_value", "stars",
        )
    )


def salary_medians(df: DataFrame, flag: str = "is_new_quality") -> DataFrame:
    """Exact median salary per class."""
    paid = df.where(positive("normalized_salary"))
    return exact_median(paid, [flag], "normalized_salary", "median_salary")
