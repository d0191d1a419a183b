"""Token counts without token ids: pieces are counted once per distinct pre-token.

Each partition states its distinct pre-tokens with their frequencies; the merged table is tokenised
once per pre-token. Documents are then read again as pre-token frequencies. The most frequent
pre-tokens, at most ``common`` of them by a cutoff from a histogram of their counts, are a table of
bounded size that is sent to every task and joined there; the frequencies of all others are joined by
shuffle, and each document's products are summed.

Defined results: a null text is an empty one; texts that hold a special string are tokenised whole
by the library; every row is counted by itself, also rows that share a doc_id or have none; extra
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.arrays import Texts, slices
from tidemark.llm.exchange import Batches
from tidemark.llm.pretokens import Points, with_specials
from tidemark.runtime import cut_lineage

COMMON, LIMIT = 1 << 18, 512


def vocabulary_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@cache
def library(path: str):
    """The tokenizer of a file, single-threaded as tasks already use all cores."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def special_strings(path: str) -> tuple[bytes, ...]:
    return tuple(t.content.encode() for t in library(path).get_added_tokens_decoder().values())


def piece_counts(path: str, strings: list[str]) -> np.ndarray:
    encoded = library(path).encode_batch_fast(strings, add_special_tokens=False)
    return np.fromiter((len(e) for e in encoded), np.int64, len(strings))


def _distinct(points: Points, skip: np.ndarray) -> tuple[np.ndarray, ...]:
    """Starts, ends, hashes and text of every pre-token of the texts that are not skipped."""
    starts, ends = points.spaced_tokens()
    owner = np.searchsorted(points.bounds, starts, side="right") - 1
    if len(skip):
        keep = ~np.isin(owner, skip)
        starts, ends, owner = starts[keep], ends[keep], owner[keep]
    return starts, ends, *points.hashes(starts, ends), owner


def _whole(texts: Texts, i: int) -> str:
    return texts.data[texts.bounds[i] : texts.bounds[i + 1]].tobytes().decode()


def _least_common(table: DataFrame, common: int) -> int:
    """The least count that at most ``common`` pre-tokens reach, to an eighth of a power of two.

    The histogram has at most eight rows for each of 63 powers, whatever the table's size.
    """
    level = F.floor(8 * F.log2("n")).alias("level")
    least, held = (1 << 63) - 1, 0
    for row in table.groupBy(level).agg(F.count("*").alias("size"), F.min("n").alias("n")).orderBy(F.desc("level")).collect():
        held += row["size"]
        if held > common:
            break
        least = row["n"]
    return least


def count_tokens(docs: DataFrame, path: str, common: int = COMMON) -> DataFrame:
    """row, doc_id, n_bytes, n_tokens for every row of ``docs`` (doc_id, text)."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def vocabulary(batches: Batches) -> Batches:
        """Distinct pre-tokens of a partition and how often it has each."""
        specials = special_strings(path)
        h1 = np.zeros(0, np.uint64)
        h2 = np.zeros(0, np.uint32)
        count = np.zeros(0, np.int64)
        words = np.zeros(0, object)
        for batch in batches:
            for texts in slices(batch.column("text")):
                points = Points.of(texts)
                starts, ends, a, b, _ = _distinct(points, with_specials(texts, specials))
                one, first, times = np.unique(a, return_index=True, return_counts=True)
                at = np.minimum(np.searchsorted(h1, one), max(len(h1) - 1, 0))
                known = (h1[at] == one) if len(h1) else np.zeros(len(one), bool)
                np.add.at(count, at[known], times[known])
                new = first[~known]
                place = np.searchsorted(h1, one[~known])
                h1 = np.insert(h1, place, one[~known])
                h2 = np.insert(h2, place, b[new])
                count = np.insert(count, place, times[~known])
                fresh = np.empty(len(new), object)
                fresh[:] = points.strings(starts[new], ends[new])
                words = np.insert(words, place, fresh)
        for lo in range(0, len(h1), 50_000):
            part = slice(lo, lo + 50_000)
            yield pa.RecordBatch.from_arrays(
                [pa.array(h1[part].view(np.int64)), pa.array(h2[part].view(np.int32)),
                 pa.array(words[part], pa.string()), pa.array(count[part])],
                names=["h1", "h2", "word", "n"],
            )

    def pieces(batches: Batches) -> Batches:
        for batch in batches:
            counts = piece_counts(path, batch.column("word").to_pylist())
            yield pa.RecordBatch.from_arrays(
                [batch.column("h1"), batch.column("h2"), batch.column("n"), pa.array(counts)],
                names=["h1", "h2", "n", "pieces"],
            )

    table = cut_lineage(
        docs.mapInArrow(vocabulary, "h1 bigint, h2 int, word string, n bigint")
        .groupBy("h1", "h2")
        .agg(F.min("word").alias("word"), F.sum("n").alias("n"))
        .mapInArrow(pieces, "h1 bigint, h2 int, n bigint, pieces bigint")
    )
    top = table.where(F.col("n") >= _least_common(table, common)).select("h1", "h2", F.col("pieces").cast("int")).toArrow()
    one, two = np.asarray(top["h1"]).view(np.uint64), np.asarray(top["h2"]).view(np.uint32)
    order = np.argsort(one)
    shared = spark.sparkContext.broadcast((one[order], two[order], np.asarray(top["pieces"])[order]))

    def frequencies(batches: Batches) -> Batches:
        """Per document the pieces of common pre-tokens, and its other pre-tokens with frequencies."""
        specials = special_strings(path)
        high, low, size = shared.value
        for batch in batches:
            row = np.asarray(batch.column("row"))
            ids = batch.column("doc_id")
            for texts in slices(batch.column("text")):
                skip = with_specials(texts, specials)
                points = Points.of(texts)
                _, _, a, b, owner = _distinct(points, skip)
                at = np.minimum(np.searchsorted(high, a), max(len(high) - 1, 0))
                known = ((high[at] == a) & (low[at] == b)) if len(high) else np.zeros(len(a), bool)
                total = np.bincount(owner[known], size[at[known]], minlength=len(texts)).astype(np.int64)
                for i in skip.tolist():
                    total[i] += piece_counts(path, [_whole(texts, i)])[0]
                mine = slice(texts.first, texts.first + len(texts))
                none = np.full(len(texts), -1, np.int32)
                yield _frequency_rows(row[mine], ids[mine], np.diff(texts.bounds), row[mine].view(np.uint64), none, total)
                a, b, owner = a[~known], b[~known], owner[~known]
                if len(a):
                    order = np.lexsort((b, a, owner))
                    a, b, owner = a[order], b[order], owner[order]
                    new = np.ones(len(a), bool)
                    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1]) | (owner[1:] != owner[:-1])
                    first = np.flatnonzero(new)
                    times = np.diff(np.append(first, len(a)))
                    empty = pa.nulls(len(first), pa.int64())
                    yield _frequency_rows(row[mine][owner[first]], empty, None, a[first], b[first].view(np.int32), times)

    schema = "row bigint, doc_id bigint, n_bytes bigint, h1 bigint, h2 int, f bigint"
    parts = docs.withColumn("row", F.monotonically_increasing_id()).mapInArrow(frequencies, schema)
    known = table.select(F.col("h1").alias("v1"), F.col("h2").alias("v2"), "pieces")
    # a document's own row has its row number and -1 for a hash, so that these rows spread evenly
    found = parts.join(known, (F.col("h1") == F.col("v1")) & (F.col("h2") == F.col("v2")) & F.col("n_bytes").isNull(), "left")
    return (
        found.groupBy("row")
        .agg(
            F.max("doc_id").alias("doc_id"),
            F.max("n_bytes").alias("n_bytes"),
            F.sum(F.when(F.col("n_bytes").isNull(), F.col("f") * F.col("pieces")).otherwise(F.col("f"))).alias("n_tokens"),
        )
    )


def _frequency_rows(row, ids, sizes, h1, h2, f) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [
            pa.array(row, pa.int64()),
            ids,
            pa.nulls(len(row), pa.int64()) if sizes is None else pa.array(sizes, pa.int64()),
            pa.array(np.ascontiguousarray(h1).view(np.int64)),
            pa.array(h2, pa.int32()),
            pa.array(f, pa.int64()),
        ],
        names=["row", "doc_id", "n_bytes", "h1", "h2", "f"],
    )


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes and tokens of every document, and whether it has more than 512 tokens."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    counted = count_tokens(docs, vocabulary_path("byte_bpe_50k.json"))
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > LIMIT).alias("over_limit"))
