"""Shuffles of packed arrays: hashes are dealt to shards as binary blocks, each shard is resolved in
one pass over sorted arrays, and what a partition can decide alone is never sent.

A partition sends a hash at most once (or as often as it stands in one document), so a hash held by
a third of all rows reaches its shard once per map task, not once per row.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.arrays import Texts, slices

Batches = Iterator[pa.RecordBatch]
MOST_SHARDS = 1 << 22  # where Spark does not know a size
HELD_KEYS = 1 << 21
CACHED = 1 << 18  # bytes of text whose hashes stay in a core's cache
_BLOCK = "shard int, flag int, a binary, b binary, c binary, d binary"
_BLOCK_ARROW = pa.schema(
    [("shard", pa.int32()), ("flag", pa.int32())] + [(x, pa.binary()) for x in "abcd"]
)


def shard_count(docs: DataFrame) -> int:
    """At least four shards to each shuffle partition, and one for every 32 MB that Spark expects of
    ``docs``, so that a shard stays small whatever number of partitions the session has."""
    expected = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    partitions = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(1024, 4 * partitions, min(expected >> 25, MOST_SHARDS))


def blocks(shard: np.ndarray, flag: int, *columns: np.ndarray) -> Batches:
    """Record batches with one row per shard; ``columns`` are cut alike."""
    if not len(shard):
        return
    order = np.argsort(shard, kind="stable")
    shard, columns = shard[order], [np.ascontiguousarray(c[order]) for c in columns]
    cuts = np.concatenate(([0], np.flatnonzero(np.diff(shard)) + 1, [len(shard)]))
    rows = [[c[lo:hi].tobytes() for lo, hi in zip(cuts, cuts[1:])] for c in columns]
    rows += [[None] * (len(cuts) - 1)] * (4 - len(columns))
    yield pa.RecordBatch.from_arrays(
        [
            pa.array(shard[cuts[:-1]], pa.int32()),
            pa.array(np.full(len(cuts) - 1, flag), pa.int32()),
            *(pa.array(r, pa.binary()) for r in rows),
        ],
        schema=_BLOCK_ARROW,
    )


def by_shard(batches: Batches) -> Iterator[tuple[int, list[dict]]]:
    """Rows of each shard of a partition that is sorted by shard."""

    def rows() -> Iterator[dict]:
        for batch in batches:
            columns = [batch.column(c) for c in "abcd"]
            for at, (shard, flag) in enumerate(zip(batch.column("shard").to_pylist(), batch.column("flag").to_pylist())):
                yield {"shard": shard, "flag": flag} | {c: x[at].as_buffer() for c, x in zip("abcd", columns)}

    for shard, group in groupby(rows(), key=lambda r: r["shard"]):
        yield shard, list(group)


def joined(rows: list[dict], name: str, kind: type) -> np.ndarray:
    return np.frombuffer(b"".join(r[name] for r in rows), kind)


def dealt(blocks_df: DataFrame) -> DataFrame:
    """Blocks of a shard together and next to each other."""
    return blocks_df.repartition(F.col("shard")).sortWithinPartitions("shard")


def repeated_keys(
    docs: DataFrame,
    keys_of: Callable[[Texts, np.ndarray], tuple[np.ndarray, np.ndarray]],
    hot: int | None = None,
) -> DataFrame:
    """For each doc_id, the keys of its texts that occur at least twice in all of ``docs``.

    ``keys_of(texts, doc ids)`` gives the keys of a slice of texts and the document of each; how often
    it states a key is how often that key counts. Each partition sums its own keys (its sketch); the
    sketches meet by shard, where sums of two or more decide. Result: doc_id, keys array<bigint>, and
    with ``hot`` a second list of those keys that count more often than that.
    """
    shards = shard_count(docs)

    def emit(batches: Batches) -> Batches:
        keys, owners, held = [], [], 0
        for batch in batches:
            ids = np.asarray(batch.column("doc_id"))
            for texts in slices(batch.column("text"), CACHED):
                k, d = keys_of(texts, ids[texts.first : texts.first + len(texts)])
                keys.append(k)
                owners.append(d)
                held += len(k)
                if held >= HELD_KEYS:
                    yield from sketch(np.concatenate(keys), np.concatenate(owners))
                    keys, owners, held = [], [], 0
        if keys:
            yield from sketch(np.concatenate(keys), np.concatenate(owners))

    def sketch(key: np.ndarray, doc: np.ndarray) -> Batches:
        order = np.argsort(key)
        key, doc = key[order], doc[order]
        first = np.concatenate(([True], key[1:] != key[:-1])) if len(key) else np.zeros(0, bool)
        at = np.flatnonzero(first)
        count = np.diff(np.append(at, len(key)))
        many = np.repeat(count > 1, count)
        yield from blocks((doc[many] % shards).astype(np.int32), 1, key[many], doc[many])
        yield from blocks(
            (key[at] % np.uint64(shards)).astype(np.int32), 0, key[at], doc[at], count.astype(np.uint32)
        )

    def merge(batches: Batches) -> Batches:
        for _, rows in by_shard(batches):
            known, rest = [r for r in rows if r["flag"]], [r for r in rows if not r["flag"]]
            if known:
                yield _keyed(joined(known, "b", np.int64), joined(known, "a", np.uint64))
            if rest:
                key, doc = joined(rest, "a", np.uint64), joined(rest, "b", np.int64)
                alone = joined(rest, "c", np.uint32) == 1
                order = np.argsort(key)
                key, doc, alone = key[order], doc[order], alone[order]
                same = key[1:] == key[:-1]
                twice = np.append(same, False) | np.insert(same, 0, False)
                yield _keyed(doc[twice & alone], key[twice & alone])

    def crowded(batches: Batches) -> Batches:
        """Keys whose counts over all partitions exceed ``hot``."""
        for _, rows in by_shard(batches):
            rest = [r for r in rows if not r["flag"]]
            if rest:
                key, inverse = np.unique(joined(rest, "a", np.uint64), return_inverse=True)
                over = np.bincount(inverse, joined(rest, "c", np.uint32)) > hot
                if over.any():
                    yield pa.RecordBatch.from_arrays([pa.array(key[over].view(np.int64))], names=["key"])

    sketches = dealt(docs.select("doc_id", "text").mapInArrow(emit, _BLOCK))
    hits = sketches.mapInArrow(merge, "doc_id bigint, key bigint")
    if hot is None:
        return hits.groupBy("doc_id").agg(F.collect_set("key").alias("keys"))
    crowds = sketches.mapInArrow(crowded, "key bigint").withColumn("hot", F.lit(True))
    return (
        hits.join(crowds, "key", "left")
        .groupBy("doc_id")
        .agg(F.collect_set("key").alias("keys"), F.collect_set(F.when(F.col("hot"), F.col("key"))).alias("hot"))
    )


def _keyed(doc: np.ndarray, key: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(doc, pa.int64()), pa.array(key.view(np.int64), pa.int64())], names=["doc_id", "key"]
    )


def by_document(places: DataFrame) -> DataFrame:
    """Blocks of (a: doc_id, b: first, c: size) to one row per document: doc_id, firsts, sizes.

    ``first`` and the places after it are numbers of windows; neighbouring runs are joined.
    """

    def gather_runs(batches: Batches) -> Batches:
        for _, rows in by_shard(batches):
            doc, first, size = (joined(rows, c, np.int64) for c in "abc")
            order = np.lexsort((first, doc))
            doc, first, end = doc[order], first[order], (first + size)[order]
            # ranks of the places, offset per document: a running maximum never reaches into the next one
            values, rank = np.unique(np.concatenate((first, end)), return_inverse=True)
            offset = np.cumsum(np.concatenate(([0], doc[1:] != doc[:-1])))[: len(doc)] * len(values)
            begins, reach = rank[: len(doc)] + offset, np.maximum.accumulate(rank[len(doc) :] + offset)
            new = np.ones(len(doc), bool)
            new[1:] = begins[1:] > reach[:-1]
            at = np.flatnonzero(new)
            end = np.maximum.reduceat(end, at)
            doc, first = doc[at], first[at]
            heads = np.flatnonzero(np.concatenate(([True], doc[1:] != doc[:-1])))
            offsets = pa.array(np.append(heads, len(doc)).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [pa.array(doc[heads])]
                + [pa.ListArray.from_arrays(offsets, pa.array(x)) for x in (first, end - first)],
                names=["doc_id", "firsts", "sizes"],
            )

    return dealt(places).mapInArrow(gather_runs, "doc_id bigint, firsts array<bigint>, sizes array<bigint>")


def flat_keys(column: pa.Array) -> np.ndarray:
    """All values of a list<int64> column, as sorted distinct uint64."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return np.unique(np.asarray(column.flatten()).view(np.uint64))


def contains(sorted_keys: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Which values are among the sorted keys."""
    if not len(sorted_keys):
        return np.zeros(len(values), bool)
    at = np.minimum(np.searchsorted(sorted_keys, values), len(sorted_keys) - 1)
    return sorted_keys[at] == values


def identified(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """doc_id, text and a struct ``rest`` of any other columns: the rows with an id, the same dealt by
    doc_id, and the rows without one.

    Both joins of a text with results per document start from the second, so that Spark writes one
    shuffle of the texts and reads it twice.
    """
    kinds = dict(docs.dtypes)
    rest = [c for c in docs.columns if c not in ("doc_id", "text")]
    docs = docs.select(
        *(
            name if kinds[name] == kind else F.col(name).cast(kind).alias(name)
            for name, kind in (("doc_id", "bigint"), ("text", "string"))
        ),
        *([F.struct(*(F.col(f"`{c}`") for c in rest)).alias("rest")] if rest else []),
    )
    known = docs.where(F.col("doc_id").isNotNull())
    return known, known.repartition(F.col("doc_id")), docs.where(F.col("doc_id").isNull())
