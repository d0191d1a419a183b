"""Benchmark decontamination by spaced seeds, in DataFrame functions only.

A mask keeps some positions of a window of tokens and ignores the others, so a substituted token that
falls on an ignored position does not hide a match. The kept tokens of every window of documents and
benchmark items are hashed per mask; where hashes meet, both texts are laid over each other at that
place and compared token by token, up to ``reach`` tokens to either side of the window (as far as both
texts go). An overlap counts if it has at least ``least`` tokens (or the whole item) and at least
``share`` percent of them agree. First the widest one is judged; where that fails, text around a quote
may dilute it, so of all narrower ones (any number of tokens to the left and to the right) the one
with the most agreement above ``share`` is judged. Narrower overlaps are reported only for pairs of
document and item without a wide one that holds. Items with fewer tokens than a mask are looked up
whole: every run of as many tokens is hashed, and compared where hashes meet.

The windows of a document are made inside its row and probe the benchmark's distinct seeds in the same
stage. A window that meets one goes on with the tokens around it, never with its document, and is dealt
out by document and place, so that a task holds a few tokens per hit whatever the length of a document
and the number of its hits. Seeds are broadcast as bare hashes, at most ``BROADCAST_SEEDS`` in a pass
over the documents (more take more passes); the tokens around the benchmark's seeds are broadcast up to
``BROADCAST_BYTES`` and joined by shuffle beyond.

Tokens are runs of letters and digits, lower-cased. Defined results: null and empty texts match
nothing; items with fewer tokens than a mask match only runs that equal them; rows sharing a doc_id are one
document, also those without one; repeated items are matched each; extra columns are ignored; an empty table gives an empty result. The SQL twin states the wide overlaps only; results are
equal where every narrower quote and short item has none.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MASKS = ("1110110101", "1101011011", "1011101101")
REACH, LEAST, SHARE = 10, 13, 80
BROADCAST_SEEDS, BROADCAST_BYTES = 2_000_000, 32 << 20


def tokens(text: Column) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def _seeds(frame: DataFrame, position: str, masks: tuple[str, ...]) -> DataFrame:
    """One row per window of ``h`` and mask: its start and the hash of the kept tokens."""
    span = len(masks[0])
    starts = F.when(F.size("h") >= span, F.sequence(F.lit(0), F.size("h") - span))
    hashes = [
        F.xxhash64(F.lit(m), *[F.get("h", F.col(position) + i) for i, keep in enumerate(mask) if keep == "1"])
        for m, mask in enumerate(masks)
    ]
    return frame.withColumn(position, F.explode(starts)).withColumn("seed", F.explode(F.array(*hashes)))


def _agreeing(start: Column | int, length: Column | int) -> Column:
    """How many tokens agree among ``length`` from the offset ``start`` of the overlap."""
    return F.size(F.filter(F.slice("same", start + F.lit(1), length), lambda same: same))


def _best_span(span: int, least: int, share: int) -> Column:
    """Of all overlaps of the seed window and any tokens beside it the one that has the most agreement
    above ``share``, then the longest: struct of excess, n, skipped tokens, alike; null if all are too short."""
    spans = F.flatten(
        F.transform(
            "left",
            lambda some, l: F.transform(
                "right",
                lambda more, r: F.struct(
                    (100 * (some + more + F.col("core")) - share * (l + r + span)).alias("excess"),
                    (l + r + span).alias("n"),
                    (F.col("back") - l).alias("skip"),
                    (some + more + F.col("core")).alias("alike"),
                ),
            ),
        )
    )
    return F.array_max(F.filter(spans, lambda s: s["n"] >= F.least(F.lit(least), F.col("size"))))


def _around(words: str, at: str, span: int, reach: int) -> tuple[Column, Column]:
    """The tokens of the window at ``at`` and up to ``reach`` to either side, and how many are before it."""
    back = F.least(F.lit(reach), F.col(at))
    return F.slice(words, F.col(at) - back + 1, back + span + reach), back


def _near(frame: DataFrame, words: str) -> DataFrame:
    """``frame`` for the small side of a join: broadcast unless the tokens in it are too many."""
    room = F.sum(F.octet_length(F.array_join(words, "")) + 16 * F.size(words) + 64)
    return F.broadcast(frame) if (frame.select(room).first()[0] or 0) <= BROADCAST_BYTES else frame


def _meeting(windows: DataFrame, seeds: DataFrame) -> DataFrame:
    """The windows that have one of the seeds."""
    passes = 1 + seeds.count() // BROADCAST_SEEDS
    share = lambda frame, i: frame.where(F.pmod(F.col("seed"), F.lit(passes)) == i) if passes > 1 else frame
    found = [share(windows, i).join(F.broadcast(share(seeds, i)), "seed", "left_semi") for i in range(passes)]
    return reduce(DataFrame.unionByName, found)


def _short_runs(texts: DataFrame, items: DataFrame, span: int) -> DataFrame | None:
    """Runs of a document's tokens that equal an item of fewer tokens than a mask."""
    short = items.where(F.size("item_words").between(1, span - 1))
    sizes = sorted(r[0] for r in short.select(F.size("item_words")).distinct().collect())
    if not sizes:
        return None
    short = short.select("item_id", "item_words", F.xxhash64("item_words").alias("seed"))
    starts = F.when(F.size("words") > 0, F.sequence(F.lit(0), F.size("words") - 1))
    runs = [F.struct(F.slice("words", F.col("at") + 1, k).alias("mine"), F.lit(k).alias("n")) for k in sizes]
    found = texts.select("doc_id", "words", F.explode(starts).alias("at"))
    found = found.select("doc_id", "at", F.inline(F.array(*runs))).where(F.size("mine") == F.col("n"))
    found = found.withColumn("seed", F.xxhash64("mine")).join(_near(short, "item_words"), "seed")
    return found.where(F.col("mine") == F.col("item_words")).select(
        "doc_id", "item_id", F.lit(True).alias("wide"), F.col("at").alias("first"), "n", F.col("n").alias("alike")
    )


def contaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    masks: tuple[str, ...] = MASKS,
    reach: int = REACH,
    least: int = LEAST,
    share: int = SHARE,
) -> DataFrame:
    """doc_id, item_id, first_token, last_token, best_percent of every overlap that holds."""
    span = len(masks[0])
    hashed = F.transform("words", lambda w: F.xxhash64(w))
    every = benchmark.select("item_id", tokens(F.col("text")).alias("item_words"))
    items = every.where(F.size("item_words") >= span)
    seeds = _seeds(
        items.withColumn("h", F.transform("item_words", lambda w: F.xxhash64(w))), "at_item", masks
    )
    theirs, before = _around("item_words", "at_item", span, reach)
    theirs = seeds.select(
        "seed", "item_id", F.size("item_words").alias("size"), before.alias("their_back"), theirs.alias("theirs")
    )
    texts = docs.select("doc_id", tokens(F.col("text")).alias("words")).withColumn("h", hashed)
    mine, before = _around("words", "at", span, reach)
    hits = (
        _meeting(_seeds(texts, "at", masks), seeds.select("seed").distinct())
        .select("seed", "doc_id", "at", before.alias("my_back"), mine.alias("mine"))
        .repartition("doc_id", "at")
        .join(_near(theirs, "theirs"), "seed")
    )
    # the overlap: how far both texts go to the left, and how many tokens are compared
    back = F.least("my_back", "their_back")
    ahead = F.least(F.size("mine") - F.col("my_back"), F.size("theirs") - F.col("their_back"))
    laid = hits.select(
        "doc_id", "item_id", (F.col("at") - back).alias("first"), back.alias("back"), (back + ahead).alias("n"), "size",
        F.zip_with(
            F.slice("mine", F.col("my_back") - back + 1, back + ahead),
            F.slice("theirs", F.col("their_back") - back + 1, back + ahead),
            lambda a, b: a == b,
        ).alias("same"),
    )
    counted = laid.withColumns(
        {
            "alike": _agreeing(F.lit(0), F.col("n")),
            "core": _agreeing(F.col("back"), F.lit(span)),
            "left": F.transform(F.sequence(F.lit(0), "back"), lambda l: _agreeing(F.col("back") - l, l)),
            "right": F.transform(
                F.sequence(F.lit(0), F.col("n") - F.col("back") - span), lambda r: _agreeing(F.col("back") + span, r)
            ),
        }
    )
    enough = (F.col("n") >= F.least(F.lit(least), F.col("size"))) & (100 * F.col("alike") >= share * F.col("n"))
    judged = counted.withColumn("wide", enough).withColumn("best", F.when(~enough, _best_span(span, least, share)))
    overlaps = judged.where(F.col("wide") | (F.col("best.excess") >= 0)).select(
        "doc_id", "item_id", "wide",
        F.when(F.col("wide"), F.col("first")).otherwise(F.col("first") + F.col("best.skip")).alias("first"),
        F.when(F.col("wide"), F.col("n")).otherwise(F.col("best.n")).alias("n"),
        F.when(F.col("wide"), F.col("alike")).otherwise(F.col("best.alike")).alias("alike"),
    )
    runs = _short_runs(texts, every, span)
    if runs is not None:
        overlaps = overlaps.unionByName(runs)
    last, percent = F.col("first") + F.col("n") - 1, F.floor(100 * F.col("alike") / F.col("n"))
    widest = lambda value: F.when(F.col("wide"), value)
    return overlaps.groupBy("doc_id", "item_id").agg(
        F.coalesce(F.min(widest(F.col("first"))), F.min("first")).cast("bigint").alias("first_token"),
        F.coalesce(F.max(widest(last)), F.max(last)).cast("bigint").alias("last_token"),
        F.coalesce(F.max(widest(percent)), F.max(percent)).cast("bigint").alias("best_percent"),
    )


def op10_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document that overlaps a benchmark item, and where."""
    return contaminated(
        spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    )


def _window_sql(table: str, key: str, mask: str) -> str:
    kept = " || ' ' || ".join(f"w[p + {i + 1}]" for i, keep in enumerate(mask) if keep == "1")
    return f"SELECT {key}, w, p, '{mask}' AS mask, {kept} AS seed FROM {table}_at"


def _tokens_sql(table: str, key: str) -> str:
    return f"""{table}_words AS (
  SELECT {key}, list_filter(string_split_regex(lower(coalesce(text, '')), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '') AS w
  FROM {table}),
{table}_at AS (
  SELECT {key}, w, unnest(range(0, len(w) - {len(MASKS[0]) - 1})) AS p FROM {table}_words WHERE len(w) >= {len(MASKS[0])}),
{table}_seeds AS ({' UNION ALL '.join(_window_sql(table, key, m) for m in MASKS)})"""


ORACLE = f"""WITH {_tokens_sql('documents', 'doc_id')},
{_tokens_sql('benchmark', 'item_id')},
hits AS (
  SELECT DISTINCT d.doc_id, b.item_id, d.w AS mine, b.w AS theirs, d.p AS here, b.p AS there
  FROM documents_seeds d JOIN benchmark_seeds b USING (mask, seed)),
laid AS (
  SELECT *, least({REACH}, here, there) AS back,
    least({len(MASKS[0]) + REACH}, len(mine) - here, len(theirs) - there) AS ahead FROM hits),
counted AS (
  SELECT doc_id, item_id, here - back AS first, back + ahead AS n, len(theirs) AS size,
    len(list_filter(range(1, back + ahead + 1), lambda i: mine[here - back + i] = theirs[there - back + i])) AS alike FROM laid)
SELECT doc_id, item_id, min(first)::BIGINT AS first_token, max(first + n - 1)::BIGINT AS last_token,
  max(floor(100 * alike / n))::BIGINT AS best_percent
FROM counted WHERE n >= least({LEAST}, size) AND 100 * alike >= {SHARE} * n
GROUP BY doc_id, item_id"""
