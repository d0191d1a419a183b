"""Quality rules whose cutoffs are chosen under a bound on false rejections.

Every rule has a fixed ladder of cutoffs from lenient to strict. Labelled good documents are the
hold-out (nothing is fitted on them but the step of a ladder): for each stratum and rule the number
of good documents that a step rejects is binomial, and a step is certified if the exact
Clopper-Pearson upper bound of its rate is at most ``alpha / rules``. A ladder is walked in fixed
sequence and stops at the first step that fails, and the error level is divided by strata times
rules, so with probability ``1 - delta`` all chosen cutoffs together reject at most a share ``alpha``
of the good documents of every stratum. Where no step can be certified the rule is off.

``joint`` certifies the rejections of all rules together instead, which needs far fewer labels (217
good documents without a rejection in each of four strata, where the rules apart need 1495): one fixed
sequence of cutoff sets, which tightens the ladders side by side (set ``i`` of ``SETS`` has the first
``i * length // SETS`` steps of each), is walked at rate ``alpha`` and level ``delta / strata``, counts
the good documents that any rule of the set rejects, and stops at the first set that fails.

Defined results: null text counts as empty; a null or unlabelled stratum has no cutoffs; documents
that fail the base rules are not in the hold-out; null labels are ignored and repeated labels count
each; rows are judged by themselves, also those that share a doc_id or have none; extra columns are
ignored; empty tables give an empty result or no cutoffs.
"""

from __future__ import annotations

from math import exp, lgamma, log, log1p

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.arrays import Texts, gram_hash, letters, mix, prefix, slices, span_hash, window_owner
from tidemark.llm.exchange import Batches
from tidemark.runtime import cut_lineage

ALPHA, DELTA, REPEAT, BROADCAST_STRATA, SETS = 0.02, 0.05, 5, 10_000, 60

# Ladders from lenient to strict. A document is rejected from the step on at which its
# value reaches the cutoff. All values are bad when high; short words count by minus their mean length.
LADDERS: dict[str, list[float]] = {
    "symbols_per_word": [1, 0.7, 0.5, 0.4, 0.3, 0.25, 0.2, 0.15, 0.1, 0.08, 0.06, 0.05, 0.04, 0.03, 0.02],
    "repeated_lines": [0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.25, 0.2, 0.15, 0.1],
    "repeated_words": [0.2, 0.18, 0.16, 0.14, 0.12, 0.1, 0.08, 0.06, 0.05],
    "long_words": [30, 25, 20, 16, 14, 13, 12, 11, 10, 9.5, 9],
    "short_words": [-1, -1.5, -2, -2.5, -3, -3.5, -4],
}
_COUNTS = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")
_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True


def _sums(flags: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    return np.diff(np.concatenate(([0], np.cumsum(flags)))[bounds])


def text_counts(texts: Texts, repeat: int = REPEAT) -> list[np.ndarray]:
    """The counts named in ``_COUNTS`` for every text."""
    n = len(texts)
    if not len(texts.data):
        return [np.zeros(n, np.int64)] * len(_COUNTS)
    starts, ends, first = texts.words()
    points = np.concatenate(([0], np.cumsum((texts.data & 0xC0) != 0x80)))
    chars = np.diff(np.concatenate(([0], np.cumsum(points[ends] - points[starts])))[first])
    symbols = _sums(_SYMBOL[texts.data], texts.bounds)
    # lines with a word; those beyond the distinct ones repeat an earlier line
    sums = prefix(letters(0)[texts.data], 0)
    breaks = texts.data == 10
    head = np.zeros(len(texts.data) + 1, bool)
    head[1:] = breaks
    head[texts.bounds[:-1]] = True
    line = np.flatnonzero(head[:-1])
    stop = np.append(line[1:], len(texts.data))
    stop = stop - breaks[stop - 1]
    full = np.searchsorted(starts, stop) > np.searchsorted(starts, line)
    line, stop = line[full], stop[full]
    of = np.searchsorted(texts.bounds, line, side="right") - 1
    tag = mix(np.arange(1, n + 1, dtype=np.uint64))
    name = mix(span_hash(sums, line, stop, 0) ^ tag[of])
    lines = np.bincount(of, minlength=n)
    distinct = np.bincount(of[np.unique(name, return_index=True)[1]], minlength=n)
    # words in windows that occur again in the same text
    words = span_hash(sums, starts, ends, 0)
    at, owner = window_owner(np.diff(first), repeat)
    again = np.zeros(len(words) + 1, np.int64)
    if len(at):
        _, inverse, times = np.unique(
            mix(gram_hash(words, repeat, 1)[at] ^ tag[owner]), return_inverse=True, return_counts=True
        )
        twice = at[times[inverse] > 1]
        np.add.at(again, twice, 1)
        np.add.at(again, twice + repeat, -1)
    return [np.diff(first), chars, symbols, lines, lines - distinct, _sums(np.cumsum(again[:-1]) > 0, first)]


def with_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` without its text, and the counts of each row."""

    def count(batches: Batches) -> Batches:
        for batch in batches:
            parts = [text_counts(texts) for texts in slices(batch.column(text))]
            columns = [np.concatenate(c) for c in zip(*parts)] if parts else [np.zeros(0)] * len(_COUNTS)
            kept = [i for i, name in enumerate(batch.schema.names) if name != text]
            yield pa.RecordBatch.from_arrays(
                [batch.column(i) for i in kept] + [pa.array(c.astype(np.int64)) for c in columns],
                names=[batch.schema.names[i] for i in kept] + list(_COUNTS),
            )

    docs = docs.withColumn(text, F.col(text).cast("string"))
    shape = docs.drop(text).withColumns({c: F.lit(None).cast("bigint") for c in _COUNTS}).schema
    return docs.mapInArrow(count, shape)


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def rule_values() -> dict[str, Column]:
    """Value of every rule, higher is worse; no words or lines give the most lenient value."""
    words, lines = F.nullif(F.col("n_words"), F.lit(0)), F.nullif(F.col("n_lines"), F.lit(0))
    mean = F.col("word_chars") / words
    return {
        "symbols_per_word": F.coalesce(F.col("n_symbols") / words, F.lit(0.0)),
        "repeated_lines": F.coalesce(F.col("n_dup_lines") / lines, F.lit(0.0)),
        "repeated_words": F.coalesce(F.col("n_repeat_words") / words, F.lit(0.0)),
        "long_words": F.coalesce(mean, F.lit(0.0)),
        "short_words": F.coalesce(-mean, F.lit(-1e9)),
    }


def first_step(rule: str, value: Column) -> Column:
    """The first step of the rule's ladder that rejects, or the ladder's length."""
    cuts = [float(c) for c in LADDERS[rule]]
    out = F.lit(len(cuts))
    for i in range(len(cuts) - 1, -1, -1):
        out = F.when(value >= cuts[i], i).otherwise(out)
    return out


def certified(rejected: int, n: int, rate: float, level: float) -> bool:
    """Whether the exact upper confidence bound of a binomial rate is at most ``rate``: seeing so
    few rejections would be improbable (at most ``level``) at any higher rate."""
    if not n or rejected >= n:
        return False
    terms = [
        lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1) + k * log(rate) + (n - k) * log1p(-rate)
        for k in range(rejected + 1)
    ]
    top = max(terms)
    return top + log(sum(exp(t - top) for t in terms)) <= log(level)


def choose_steps(counts: list[list[int]], n: int, rate: float, level: float) -> list[int]:
    """For each rule the number of certified steps, given its good documents per first step."""
    out = []
    for by_step in counts:
        steps, rejected = 0, 0
        for k in by_step:
            rejected += k
            if not certified(rejected, n, rate, level):
                break
            steps += 1
        out.append(steps)
    return out


def set_steps(i: int) -> list[int]:
    """For each rule the number of steps in the ``i``-th set of the joint sequence."""
    return [i * len(ladder) // SETS for ladder in LADDERS.values()]


def first_set() -> Column:
    """The first set of the joint sequence with a rule that rejects, given the rules' first steps in
    columns of their names; ``SETS + 1`` if none does."""
    return F.least(*[F.floor(((F.col(r) + 1) * SETS + len(x) - 1) / len(x)) for r, x in LADDERS.items()], F.lit(SETS + 1).cast("bigint"))


def cutoffs(
    counted: DataFrame, labels: DataFrame, stratum: str, alpha: float = ALPHA, delta: float = DELTA, joint: bool = False
) -> tuple[DataFrame, int]:
    """Certified steps of each rule per stratum (one column per rule), and how many strata there are."""
    good = counted.join(labels.where("quality = 1").select("doc_id"), "doc_id")
    good = good.where(~base_failed() & F.col(stratum).isNotNull())
    values = rule_values()
    steps = good.select(F.col(stratum).alias("stratum"), *[first_step(r, v).alias(r) for r, v in values.items()])
    hits = [
        F.count_if(F.col(rule) == i).alias(f"{rule}_{i}") for rule in LADDERS for i in range(len(LADDERS[rule]))
    ]
    if joint:
        steps = steps.withColumn("set", first_set())
        hits = [F.count_if(F.col("set") == i).alias(f"set_{i}") for i in range(1, SETS + 1)]
    table = cut_lineage(steps.groupBy("stratum").agg(F.count("*").alias("n"), *hits))
    strata = table.count()
    tests = 1 if joint else len(LADDERS)
    rate, level = alpha / tests, delta / max(1, strata * tests)

    def choose(frames):
        for frame in frames:
            rows = []
            for row in frame.to_dict("records"):
                if joint:
                    by_set = [int(row[f"set_{i}"]) for i in range(1, SETS + 1)]
                    rows.append([row["stratum"], *set_steps(choose_steps([by_set], int(row["n"]), rate, level)[0])])
                    continue
                by_rule = [[int(row[f"{r}_{i}"]) for i in range(len(LADDERS[r]))] for r in LADDERS]
                rows.append([row["stratum"], *choose_steps(by_rule, int(row["n"]), rate, level)])
            yield pd.DataFrame(rows, columns=["stratum", *(f"steps_{r}" for r in LADDERS)])

    kind = dict(counted.dtypes)[stratum]
    return table.mapInPandas(choose, f"stratum {kind}, " + ", ".join(f"steps_{r} int" for r in LADDERS)), strata


def judge(docs: DataFrame, labels: DataFrame, stratum: str = "lang", joint: bool = False, **risk: float) -> DataFrame:
    """Counts, base_failed, failed_rules and kept for every row of ``docs`` (doc_id, text, stratum)."""
    counted = cut_lineage(with_counts(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", stratum)))
    chosen, strata = cutoffs(counted, labels.select("doc_id", "quality"), stratum, joint=joint, **risk)
    if strata <= BROADCAST_STRATA:
        chosen = F.broadcast(chosen)
    judged = counted.join(chosen, counted[stratum] == F.col("stratum"), "left")
    broken = [
        F.when(first_step(rule, value) < F.coalesce(F.col(f"steps_{rule}"), F.lit(0)), F.lit(rule))
        for rule, value in rule_values().items()
    ]
    return judged.select(
        "doc_id", stratum, *_COUNTS, base_failed().alias("base_failed"), F.array_compact(F.array(*broken)).alias("failed_rules")
    ).withColumn("kept", ~F.col("base_failed") & (F.size("failed_rules") == 0))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of every document, and whether base rules and certified cutoffs keep it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return judge(docs, labels, joint=True).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        F.array_join("failed_rules", ",").alias("failed_rules"),
    )
