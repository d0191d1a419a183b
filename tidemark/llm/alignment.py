"""Alignment of the tokens of two tokenizers over the bytes of the same text.

Both tokenizations tile the bytes of a space and the text. All tokens of a slice of documents are
sorted by their first byte (A before B), the running maximum of their ends is taken, and a group breaks
where a start reaches it: there a token of A and one of B end together. Within groups every token of A
is expanded to the tokens of B it overlaps, which stand next to each other.

How many documents hold a pair of ids linked is counted over all documents; with it, each document
learns how many of its links are the best of their A id, and the sum of the counts. Documents carry
their distinct pairs with frequencies; the most common pairs, of a bounded number chosen by a histogram
of the counts, are sent to every task, all others are joined by shuffle.

Defined results: null and empty texts, and texts that either tokenizer does not give back byte by byte
(a text with U+2581, for example), have no tokens: zeros and an empty digest; every row is a document
by itself, also rows that share a doc_id or have none; extra columns are ignored; an empty table gives
an empty result.
"""

from __future__ import annotations

import hashlib
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.arrays import Texts, gather, slices
from tidemark.llm.exchange import Batches
from tidemark.llm.pretokens import Points
from tidemark.llm.token_counts import vocabulary_path
from tidemark.runtime import cut_lineage, discard

COMMON, REMEMBERED = 1 << 19, 1 << 19
SLICE, STEP = 1 << 18, 1 << 20
_PLAIN = "doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string"


def _byte_of() -> dict[str, int]:
    """Byte of each letter of a byte-level vocabulary: printable ones stand for themselves, the others
    for the letters from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(0x100 + i): b for i, b in enumerate(other)}


class Sides:
    """Both tokenizers of a worker with the bytes of every token."""

    def __init__(self, path_a: str, path_b: str) -> None:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.a.no_truncation()
        self.a.no_padding()
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        letter = _byte_of()
        size = self.a.get_vocab_size()
        said = [self.a.id_to_token(i) or "" for i in range(size)]
        self.bytes_a = self._table([bytes(letter[c] for c in s) if all(c in letter for c in s) else s.encode() for s in said])
        self.bytes_b = self._table([self._piece(i) for i in range(self.b.get_piece_size())])
        self.size_b = self.b.get_piece_size()
        self.digits = self._table([str(i).encode() for i in range(max(size, self.size_b))])
        self._forget()

    def _piece(self, i: int) -> bytes:
        piece = self.b.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if self.b.is_byte(i) else piece.replace("▁", " ").encode()

    @staticmethod
    def _table(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        size = np.fromiter(map(len, parts), np.int64, len(parts))
        return np.frombuffer(b"".join(parts), np.uint8), np.cumsum(size) - size, size

    def encode(self, texts: Texts, strings: list[str]) -> tuple[tuple[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]:
        """Ids of all texts end to end and their number, by A and by B."""
        two = self.b.encode(strings, num_threads=1)
        count = np.fromiter(map(len, two), np.int64, len(two))
        return self._words(texts), (np.fromiter((i for row in two for i in row), np.int64, int(count.sum())), count)

    def _forget(self) -> None:
        self.h1, self.h2 = np.zeros(0, np.uint64), np.zeros(0, np.uint32)
        self.begin, self.size, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _spelled(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        rows = [e.ids for e in self.a.encode_batch_fast(words, add_special_tokens=False)]
        size = np.fromiter(map(len, rows), np.int64, len(rows))
        return np.fromiter((i for row in rows for i in row), np.int64, int(size.sum())), size

    def _words(self, texts: Texts) -> tuple[np.ndarray, np.ndarray]:
        """Ids by A of a space and each text: the library encodes every distinct pre-token once and they
        are remembered, up to about ``REMEMBERED``."""
        raw, n = Points.of(texts), len(texts)
        points, bounds = np.insert(raw.points, raw.bounds[:-1], 0x20), raw.bounds + np.arange(n + 1)
        cut = Points(points, bounds)
        starts, ends = cut.spaced_tokens()
        h1, h2 = cut.hashes(starts, ends)
        one, first, inverse = np.unique(h1, return_index=True, return_inverse=True)
        at = np.minimum(np.searchsorted(self.h1, one), max(len(self.h1) - 1, 0))
        new = first[self.h1[at] != one] if len(self.h1) else first
        if len(self.h1) + len(new) > REMEMBERED:
            self._forget()
            new = first
        if len(new):
            ids, size = self._spelled(cut.strings(starts[new], ends[new]))
            place = np.searchsorted(self.h1, h1[new])
            self.begin = np.insert(self.begin, place, len(self.ids) + np.cumsum(size) - size)
            self.size, self.ids = np.insert(self.size, place, size), np.concatenate((self.ids, ids))
            self.h1, self.h2 = np.insert(self.h1, place, h1[new]), np.insert(self.h2, place, h2[new])
        at = np.searchsorted(self.h1, one)[inverse]
        size, source, where = self.size[at], self.ids, self.begin[at]
        other = np.flatnonzero(self.h2[at] != h2)  # two pre-tokens under one 64-bit hash
        if len(other):
            ids, size[other] = self._spelled(cut.strings(starts[other], ends[other]))
            where[other] = len(source) + np.cumsum(size[other]) - size[other]
            source = np.concatenate((source, ids))
        to = np.cumsum(size)
        total = int(to[-1]) if len(to) else 0
        owner = np.searchsorted(bounds, starts, side="right") - 1
        return source[np.arange(total) + np.repeat(where - (to - size), size)], np.bincount(owner, size, minlength=n).astype(np.int64)


@cache
def sides(path_a: str, path_b: str) -> Sides:
    return Sides(path_a, path_b)


def groups(start: np.ndarray, end: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order of intervals by start, and the group of each in that order: a group breaks where a
    start reaches the running maximum of the ends."""
    order = np.lexsort((kind, start))
    reach = np.maximum.accumulate(end[order]) if len(order) else end
    new = np.ones(len(order), bool)
    new[1:] = start[order][1:] >= reach[:-1]
    return order, np.cumsum(new) - 1


def links(start_a: np.ndarray, end_a: np.ndarray, start_b: np.ndarray, end_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All overlapping pairs of two sorted tilings: numbers of the A and of the B token."""
    first = np.searchsorted(end_b, start_a, side="right")
    count = np.maximum(np.searchsorted(start_b, end_a, side="left") - first, 0)
    a = np.repeat(np.arange(len(start_a)), count)
    return a, np.arange(len(a)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(first, count)


def _digest(tool: Sides, ids: np.ndarray, kind: np.ndarray, group: np.ndarray, owner: np.ndarray, n: int) -> list[str]:
    """Per document the digest of its groups, from tokens sorted by group and kind."""
    if not len(ids):
        return [""] * n
    mark = np.full(len(ids), ord(","), np.uint8)
    mark[:-1][kind[1:] != kind[:-1]] = ord("|")
    mark[:-1][group[1:] != group[:-1]] = ord(";")
    data, at, size = tool.digits
    out = gather(data, at[ids], size[ids], gap=1)
    ends = np.cumsum(size[ids] + 1)
    out[ends - 1] = mark
    body, bounds = memoryview(out), np.concatenate(([0], ends))[np.searchsorted(owner, np.arange(n + 1))].tolist()
    return [hashlib.sha256(body[x : y - 1]).hexdigest() if y > x else "" for x, y in zip(bounds, bounds[1:])]


def _aligned(tool: Sides, slice_: Texts, texts: list[str | None]) -> tuple[list[np.ndarray], list[str], np.ndarray, np.ndarray, np.ndarray]:
    """Per document n_a, n_b, n_groups and n_links, and the digest; distinct pairs of all documents end
    to end, how often each stands, and how many a document has."""
    n = len(texts)
    (ids_a, count_a), (ids_b, count_b) = tool.encode(slice_, [t or "" for t in texts])
    whole = [(" " + t).encode() if t else b"" for t in texts]
    tiles = []
    keep = np.fromiter(map(bool, whole), bool, n)
    for (data, at, size), ids, count in ((tool.bytes_a, ids_a, count_a), (tool.bytes_b, ids_b, count_b)):
        body = gather(data, at[ids], size[ids]).tobytes()
        bounds = np.concatenate(([0], np.cumsum(size[ids])))[np.concatenate(([0], np.cumsum(count)))].tolist()
        keep &= np.fromiter((body[x:y] == w for x, y, w in zip(bounds, bounds[1:], whole)), bool, n)
    for (_, _, size), ids, count in ((tool.bytes_a, ids_a, count_a), (tool.bytes_b, ids_b, count_b)):
        owner = np.repeat(np.arange(n), count)
        use = keep[owner]
        ids, owner = ids[use], owner[use]
        end = np.cumsum(size[ids])  # documents of which both sides are kept are equally long in bytes
        tiles.append((ids, owner, end - size[ids], end))
    (a, of_a, start_a, end_a), (b, of_b, start_b, end_b) = tiles
    kind = np.repeat([0, 1], [len(a), len(b)])
    order, group = groups(np.concatenate((start_a, start_b)), np.concatenate((end_a, end_b)), kind)
    ids, owner = np.concatenate((a, b))[order], np.concatenate((of_a, of_b))[order]
    kind = kind[order]
    heads = owner[np.flatnonzero(np.diff(group, prepend=-1))]
    by = np.lexsort((kind, group))
    digest = _digest(tool, ids[by], kind[by], group[by], owner[by], n)
    x, y = links(start_a, end_a, start_b, end_b)
    whose = of_a[x]
    span = np.int64(len(tool.bytes_a[1])) * tool.size_b
    pair, times = np.unique(whose * span + a[x] * tool.size_b + b[y], return_counts=True)
    numbers = [np.bincount(v, minlength=n).astype(np.int64) for v in (of_a, of_b, heads, whose)]
    return numbers, digest, pair % span, times.astype(np.int32), np.bincount(pair // span, minlength=n)


def _lists(values: np.ndarray, count: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(count))).astype(np.int32)), pa.array(values))


def aligned(docs: DataFrame, path_a: str, path_b: str, common: int = COMMON) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 for every row of ``docs``
    (doc_id, text)."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def align(batches: Batches) -> Batches:
        tool = sides(path_a, path_b)
        for batch in batches:
            for texts in slices(batch.column("text"), SLICE):
                mine = slice(texts.first, texts.first + len(texts))
                numbers, digest, pairs, times, count = _aligned(tool, texts, batch.column("text")[mine].to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [batch.column("row")[mine], batch.column("doc_id")[mine], *map(pa.array, numbers), pa.array(digest, pa.string()),
                     _lists(pairs, count), _lists(times, count)],
                    names=["row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times"],
                )

    told = cut_lineage(
        docs.withColumn("row", F.monotonically_increasing_id()).mapInArrow(
            align, f"row bigint, {_PLAIN}, pairs array<bigint>, times array<int>"
        )
    )
    size_b = sides(path_a, path_b).size_b
    counts = cut_lineage(told.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count("*").alias("c")))
    side = F.floor(F.col("pair") / size_b)
    best = counts.groupBy(side.alias("a")).agg(F.max("c").alias("most"))
    table = cut_lineage(
        counts.withColumn("a", side).join(best, "a").select("pair", "c", (F.col("c") == F.col("most")).alias("best"))
    )
    discard(counts)
    # the counts from which on at most ``common`` pairs are common, in steps of a sixteenth of a doubling
    step = F.floor(F.log2("c") * 16).cast("int")
    heights = sorted(((r["h"], r["k"]) for r in table.groupBy(step.alias("h")).agg(F.count("*").alias("k")).collect()), reverse=True)
    held, least = 0, None
    for height, k in heights:
        held += k
        if held > common:
            break
        least = height
    is_common = F.lit(False) if least is None else step >= least
    top = table.where(is_common).toArrow()
    key, count, good = (np.asarray(top[c].combine_chunks()) if c != "best" else np.asarray(top[c].combine_chunks().cast(pa.int8())) for c in ("pair", "c", "best"))
    order = np.argsort(key)
    shared = spark.sparkContext.broadcast((key[order], count[order], good[order].astype(np.int64)))

    def summed(batches: Batches) -> Batches:
        """Per document what its common pairs add up to, and its other pairs."""
        key, count, good = shared.value
        for whole in batches:
            ends = np.cumsum(np.asarray(whole.column("pairs").value_lengths()).astype(np.int64))
            lo = 0
            while lo < whole.num_rows:
                limit = (ends[lo - 1] if lo else 0) + STEP
                hi = max(lo + 1, int(np.searchsorted(ends, limit, side="right")))
                batch, lo = whole.slice(lo, hi - lo), hi
                pairs, times = np.asarray(batch.column("pairs").flatten()), np.asarray(batch.column("times").flatten()).astype(np.int64)
                n = np.asarray(batch.column("pairs").value_lengths())
                owner = np.repeat(np.arange(batch.num_rows), n)
                at = np.minimum(np.searchsorted(key, pairs), max(len(key) - 1, 0))
                known = key[at] == pairs if len(key) else np.zeros(len(pairs), bool)
                sums = [np.zeros(batch.num_rows, np.int64) for _ in range(2)]
                np.add.at(sums[0], owner[known], times[known] * good[at[known]])
                np.add.at(sums[1], owner[known], times[known] * count[at[known]])
                rest = np.bincount(owner[~known], minlength=batch.num_rows)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("row"), *map(pa.array, sums), _lists(pairs[~known], rest), _lists(times[~known], rest)],
                    names=["row", "n_best", "count_sum", "pairs", "times"],
                )

    sums = cut_lineage(
        told.select("row", "pairs", "times").mapInArrow(
            summed, "row bigint, n_best bigint, count_sum bigint, pairs array<bigint>, times array<bigint>"
        )
    )
    rare = (
        sums.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("x"))
        .select("row", F.col("x.pairs").alias("pair"), F.col("x.times").alias("t"))
        .join(table.where(~is_common), "pair")
        .select("row", F.when(F.col("best"), F.col("t")).otherwise(0).alias("n_best"), (F.col("t") * F.col("c")).alias("count_sum"))
    )
    total = sums.select("row", "n_best", "count_sum").union(rare).groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    return told.join(total, "row").select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups and links between byte-level and SentencePiece tokens of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return aligned(docs, vocabulary_path("byte_bpe_50k.json"), vocabulary_path("piece_bpe_32k.model"))
