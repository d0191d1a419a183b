"""Seed dictionaries of the job-text pipelines and how they are merged."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.text import clean_text

# Base phrases per category.
BASE_SEEDS = {
    "ai_ml": [
        "artificial intelligence", "machine learning", "deep learning", "neural network", "nlp",
        "computer vision", "data science", "data engineering", "mlops", "predictive modeling",
    ],
    "cloud_devops": [
        "aws", "azure", "gcp", "cloud", "docker", "kubernetes", "devops", "ci/cd", "terraform",
        "microservices",
    ],
    "data_analytics": [
        "data analysis", "data mining", "big data", "sql", "etl", "data warehouse",
        "business intelligence", "tableau", "power bi", "looker",
    ],
    "renewable_energy": [
        "solar", "wind energy", "renewable energy", "energy storage", "electric vehicle", "ev",
        "battery", "sustainability", "carbon", "clean energy",
    ],
    "biotech_health": [
        "biotechnology", "bioinformatics", "genomics", "clinical research", "drug discovery",
        "molecular biology", "crispr", "precision medicine", "immunology", "pharmaceutical",
    ],
    "semiconductor": [
        "semiconductor", "chip design", "vlsi", "asic", "fpga", "embedded systems", "verilog",
        "rtl", "pcb design", "systemverilog",
    ],
    "fintech": [
        "blockchain", "cryptocurrency", "defi", "fintech", "quantitative finance",
        "algorithmic trading", "risk modeling", "payment systems", "digital banking",
    ],
}

# Extra phrases for long descriptions.
DESCRIPTION_SEEDS = {
    "ai_ml": [
        "large language model", "llm", "generative ai", "transformer", "prompt engineering", "rag",
        "langchain", "hugging face", "stable diffusion", "chatbot", "ai engineer",
        "machine learning engineer",
    ],
    "cloud_devops": [
        "ci/cd pipeline", "infrastructure as code", "serverless", "cloud native",
        "containerization", "orchestration", "helm", "istio", "prometheus", "grafana",
    ],
    "data_analytics": [
        "data pipeline", "data lake", "snowflake", "databricks", "dbt", "airflow", "spark",
        "feature engineering", "a/b testing", "experimentation",
    ],
    "renewable_energy": [
        "carbon neutral", "net zero", "esg reporting", "green building", "smart grid",
        "solar panel", "wind turbine", "circular economy", "climate tech", "cleantech",
        "renewable energy system", "energy storage system", "carbon capture",
        "decarbonization strategy",
    ],
    "biotech_health": [
        "clinical trial", "fda regulation", "therapeutic area", "medical device", "healthcare ai",
        "telemedicine", "ehr system", "hipaa compliance", "regulatory affairs",
    ],
    "semiconductor": [
        "silicon design", "wafer fabrication", "semiconductor manufacturing", "cmos technology",
        "pcb layout", "rf design", "signal integrity", "power electronics", "electromagnetics",
        "vlsi design",
    ],
    "fintech": [
        "regtech", "insurtech", "open banking", "embedded finance", "kyc", "aml",
        "fraud detection", "payment gateway", "trading system", "market data",
    ],
}

# Remote-work keywords.
REMOTE_KEYWORDS = [
    "remote", "work from home", "wfh", "hybrid", "hybrid work", "flexible schedule",
    "flexible hours", "telecommute", "virtual", "distributed team", "remote-first", "remote first",
]

# Short base words that hit too many unrelated texts, and the shortest seed kept.
SHORT_SEEDS = ["ev", "ai", "ml", "gcp", "kyc", "aml", "r", "c", "go", "aws"]
MIN_SEED_LENGTH = 3


def merge_seeds(
    base: Mapping[str, Iterable[str]],
    boost: Mapping[str, Iterable[str]],
    min_length: int = MIN_SEED_LENGTH,
    blocked: Iterable[str] = SHORT_SEEDS,
) -> dict[str, list[str]]:
    """Base phrases without short and blocked ones, plus the long enough boost phrases."""
    stop = set(blocked)
    merged = {}
    for category, phrases in base.items():
        kept = {p for p in phrases if len(p) >= min_length and p.lower() not in stop}
        kept |= {p for p in boost.get(category, ()) if len(p) >= min_length}
        merged[category] = sorted(kept)
    return merged


ENRICHED_SEEDS = merge_seeds(BASE_SEEDS, DESCRIPTION_SEEDS)


def merge_seed_tables(
    base: DataFrame, boost: DataFrame, min_length: int = MIN_SEED_LENGTH, blocked: Iterable[str] = SHORT_SEEDS
) -> DataFrame:
    """The same merge on ``(category, phrase)`` tables; boost categories must exist in the base."""
    kept = base.where(~F.lower("phrase").isin(list(blocked)))
    known = boost.join(base.select("category").distinct(), "category", "left_semi")
    return (
        kept.unionByName(known)
        .where(F.length("phrase") >= min_length)
        .select("category", "phrase")
        .distinct()
    )


def clean_seed_table(seeds: DataFrame) -> DataFrame:
    """Option: pass the phrases through the text cleaner, so ones with symbols can match."""
    return seeds.withColumn("phrase", clean_text("phrase")).where(F.col("phrase") != "").distinct()
