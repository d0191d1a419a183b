"""Skill-list corpus: cleaning, remote flag, density and co-occurrence."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.columns import clip, zero_to_one
from tidemark.functions.seeds import BASE_SEEDS, REMOTE_KEYWORDS
from tidemark.functions.text import (
    capture,
    clean_text,
    computed_once,
    contains_any,
    count_non_blank,
    count_phrases,
    spaced_title,
    split_commas,
)
from tidemark.operators.cooccurrence import item_pairs

TITLE_PATTERN = "jobs/view/(.+?)-at-"


def prepare_skills(
    df: DataFrame,
    skills: str = "job_skills",
    link: str | None = "job_link",
    title_pattern: str = TITLE_PATTERN,
    min_length: int = 5,
) -> DataFrame:
    """Cleaned text, skill list, skill count and title from the link; short texts are dropped.

    Commas survive the cleaning, because they separate the skills.
    """
    rows = computed_once(
        df, "text_clean", clean_text(F.coalesce(F.col(skills), F.lit("")), keep_commas=True)
    )
    if link is not None:
        rows = rows.withColumn("job_title_raw", capture(link, title_pattern)).withColumn(
            "job_title_clean", spaced_title("job_title_raw")
        )
    return (
        rows.where(F.length("text_clean") > min_length)
        .withColumn("skills_list", split_commas("text_clean"))
        .withColumn("skill_count", count_non_blank("skills_list"))
    )


def remote_flag(text: Column | str, keywords: Iterable[str] = REMOTE_KEYWORDS) -> Column:
    return contains_any(text, keywords)


def tech_density(
    text: Column | str, count: Column | str, seeds: Mapping[str, Iterable[str]] = BASE_SEEDS
) -> Column:
    """Seed hits in a cleaned text per skill, at most 1."""
    phrases = [p for group in seeds.values() for p in group]
    return clip(count_phrases(text, phrases, lowered=True) / zero_to_one(count), high=1.0)


def skill_pairs(df: DataFrame, top_n: int = 100, max_pairs: int = 5000) -> DataFrame:
    return item_pairs(df, "skills_list", top_n, max_pairs)
