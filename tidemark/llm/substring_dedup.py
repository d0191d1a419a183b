"""Substring deduplication: count-min prefilter, then exact grouping of the windows left.

A window is ``width`` consecutive words of one document. Every window is represented by its
minimiser, the smallest hash among the ``gram``-word runs in it, so equal windows have equal
representatives and neighbouring windows mostly share one: a twentieth of the hashes stands for all
windows. Each partition counts representatives per document in a count-min sketch (``depth`` rows of
2**``bits`` cells, held sparsely); merged sketches can only overestimate, so a window whose estimate
is below two in any row occurs in one document only. The second pass groups all other windows by a
96-bit fingerprint and finds the smallest doc_id of each.

Defined results: null text counts as no words; a row without doc_id is returned unchanged and is no
earlier document; rows sharing a doc_id never remove each other's words; exact repeats of a row get
the same result; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.arrays import (
    Texts, cover, gram_hash, joined_words, letters, mix, prefix, sliding_min, slices, span_hash, window_owner,
)
from tidemark.llm.exchange import (
    _BLOCK, Batches, blocks, by_document, by_shard, contains, dealt, flat_keys, identified, joined, repeated_keys, shard_count,
)

WIDTH, GRAM, DEPTH, BITS, HELD = 50, 8, 2, 40, 1 << 20


def _word_hashes(texts: Texts, seed: int) -> tuple[np.ndarray, np.ndarray]:
    starts, ends, first = texts.words()
    return span_hash(prefix(letters(seed)[texts.data], seed), starts, ends, seed), first


def _windows(texts: Texts, width: int, gram: int) -> tuple[np.ndarray, ...]:
    """Word hashes, first word per text, and start, text and representative of every window."""
    words, first = _word_hashes(texts, 0)
    at, owner = window_owner(np.diff(first), width)
    least = sliding_min(gram_hash(words, gram, 1), width - gram + 1)
    return words, first, at, owner, least[at]


def cells(keys: np.ndarray, row: int, bits: int) -> np.ndarray:
    """Sketch cell of each key in one row; the row is kept in the top bits."""
    cell = mix(keys * np.uint64(2 * row + 3)) >> np.uint64(64 - bits)
    return cell | np.uint64(row << 60)


def _changes(keys: np.ndarray, owner: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.concatenate(([True], (keys[1:] != keys[:-1]) | (owner[1:] != owner[:-1]))))


def _text_tag(texts: Texts, i: int) -> int:
    """27 bits of a text's hash: tells apart different texts under one doc_id."""
    part = texts.data[texts.bounds[i] : texts.bounds[i + 1]].tobytes()
    return int.from_bytes(hashlib.blake2b(part, digest_size=4).digest(), "little") >> 5


def tags(texts: Texts) -> np.ndarray:
    return np.fromiter((_text_tag(texts, i) for i in range(len(texts))), np.int64, len(texts))


def covered_windows(
    docs: DataFrame, dealt_docs: DataFrame, width: int = WIDTH, gram: int = GRAM, depth: int = DEPTH, bits: int = BITS
) -> DataFrame:
    """doc_id, firsts, sizes: per document the runs of windows that a smaller doc_id has too.

    ``docs`` and the same rows dealt by doc_id come from ``identified``. A window's place is
    ``text tag << 36 | first word``.
    """
    shards = shard_count(docs)

    def sketched(texts: Texts, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        _, _, _, owner, least = _windows(texts, width, gram)
        if not len(least):
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        at = _changes(least, owner)
        key, doc = least[at], owner[at]
        order = np.lexsort((key, doc))
        key, doc = key[order], doc[order]
        at = _changes(key, doc)  # a document counts once
        key, doc = key[at], ids[doc[at]]
        return np.concatenate([cells(key, r, bits) for r in range(depth)]), np.tile(doc, depth)

    def suspects(batches: Batches) -> Batches:
        """Windows estimated repeated; of ``HELD`` windows those that are alike are sent once."""
        found: list[tuple[np.ndarray, ...]] = []
        held = 0
        for batch in batches:
            ids = np.asarray(batch.column("doc_id"))
            hits = flat_keys(batch.column("keys"))
            for texts in slices(batch.column("text")):
                words, _, at, owner, least = _windows(texts, width, gram)
                keep = np.ones(len(least), bool)
                for r in range(depth):
                    keep &= contains(hits, cells(least, r, bits))
                if not keep.any():
                    continue
                at, owner = at[keep], owner[keep]
                first = texts.words()[2]
                place = (tags(texts)[owner] << 36) | (at - first[owner])
                other, _ = _word_hashes(texts, 3)
                found.append((
                    gram_hash(words, width, 2)[at],
                    (gram_hash(other, width, 3)[at] >> np.uint64(32)).astype(np.uint32),
                    ids[texts.first + owner],
                    place,
                ))
                held += len(at)
                if held >= HELD:
                    yield from sent(*(np.concatenate(c) for c in zip(*found)))
                    found, held = [], 0
        if found:
            yield from sent(*(np.concatenate(c) for c in zip(*found)))

    def sent(high: np.ndarray, low: np.ndarray, doc: np.ndarray, place: np.ndarray) -> Batches:
        order = np.lexsort((doc, low, high))
        high, low, doc, place = high[order], low[order], doc[order], place[order]
        least_doc = _least(high, low, doc)
        lost = doc > least_doc
        yield from blocks((doc[lost] % shards).astype(np.int32), 1, doc[lost], place[lost])
        high, low, doc, place = high[~lost], low[~lost], doc[~lost], place[~lost]
        yield from blocks((high % np.uint64(shards)).astype(np.int32), 0, high, low, doc, place)

    def resolve(batches: Batches) -> Batches:
        lost_doc, lost_place = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for _, rows in by_shard(batches):
            known, rest = [r for r in rows if r["flag"]], [r for r in rows if not r["flag"]]
            lost_doc.append(joined(known, "a", np.int64))
            lost_place.append(joined(known, "b", np.int64))
            high, low = joined(rest, "a", np.uint64), joined(rest, "b", np.uint32)
            doc, place = joined(rest, "c", np.int64), joined(rest, "d", np.int64)
            order = np.lexsort((doc, low, high))
            high, low, doc, place = high[order], low[order], doc[order], place[order]
            lost = doc > _least(high, low, doc)
            lost_doc.append(doc[lost])
            lost_place.append(place[lost])
        yield from place_blocks(*places_to_runs(np.concatenate(lost_doc), np.concatenate(lost_place)), shards)

    marked = dealt_docs.join(repeated_keys(docs, sketched), "doc_id")  # all columns, so that the texts' shuffle is the one read at the end
    return by_document(dealt(marked.mapInArrow(suspects, _BLOCK)).mapInArrow(resolve, _BLOCK))


def _least(high: np.ndarray, low: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Of entries sorted by fingerprint and document, the first document of each fingerprint."""
    if not len(high):
        return doc
    new = np.concatenate(([True], (high[1:] != high[:-1]) | (low[1:] != low[:-1])))
    return doc[np.flatnonzero(new)][np.cumsum(new) - 1]


def places_to_runs(doc: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document, first place and size of the runs of neighbouring places."""
    order = np.lexsort((place, doc))
    doc, place = doc[order], place[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (place[1:] > place[:-1] + 1)
    at = np.flatnonzero(new)
    return doc[at], place[at], place[np.append(at, len(doc))[1:] - 1] - place[at] + 1


def place_blocks(doc: np.ndarray, first: np.ndarray, size: np.ndarray, shards: int) -> Batches:
    """Runs dealt by document: a task states each of few shards once."""
    yield from blocks((doc % max(1, shards // 4)).astype(np.int32), 0, doc, first, size)


def run_places(firsts: pa.Scalar, sizes: pa.Scalar, tag: int) -> np.ndarray:
    """Starts in the text with this tag, from a document's runs."""
    first, size = np.asarray(firsts.values), np.asarray(sizes.values)
    own = first >> 36 == tag
    first, size = first[own] & ((1 << 36) - 1), size[own]
    return np.repeat(first - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))


def remove_repeated(docs: DataFrame, width: int = WIDTH, **sizes: int) -> DataFrame:
    """doc_id, text, kept_text, n_words, n_removed for every row of ``docs`` (doc_id, text), and a
    struct ``rest`` of its other columns, if any. ``kept_text`` is the kept words joined by one space.
    """
    def cut(batches: Batches) -> Batches:
        for batch in batches:
            firsts, sizes = batch.column("firsts"), batch.column("sizes")
            kept, total, gone = [], [], []
            for texts in slices(batch.column("text")):
                first = texts.words()[2]
                keep = np.ones(first[-1], bool)
                for i in range(len(texts)):
                    row = firsts[texts.first + i]
                    if row.is_valid:
                        lo, hi = int(first[i]), int(first[i + 1])
                        at = run_places(row, sizes[texts.first + i], _text_tag(texts, i))
                        keep[lo:hi] = ~cover(at, width, hi - lo)
                counts = np.diff(first)
                left = np.diff(np.concatenate(([0], np.cumsum(keep)))[first])
                total += counts.tolist()
                gone += (counts - left).tolist()
                kept += joined_words(texts, keep)
            told = [pa.array(kept, pa.binary()).cast(pa.string()), pa.array(total, pa.int64()), pa.array(gone, pa.int64())]
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in names] + told, names=[*names, "kept_text", "n_words", "n_removed"]
            )

    known, dealt_docs, loose = identified(docs)
    found = dealt_docs.join(covered_windows(known, dealt_docs, width, **sizes), "doc_id", "left")
    loose = loose.withColumns({c: F.lit(None).cast("array<bigint>") for c in ("firsts", "sizes")})
    names = known.columns
    shape = known.withColumns(
        {"kept_text": F.lit(None).cast("string"), "n_words": F.lit(None).cast("bigint"), "n_removed": F.lit(None).cast("bigint")}
    ).schema
    return found.select(*names, "firsts", "sizes").unionByName(loose).mapInArrow(cut, shape)


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of 50-word windows that a smaller doc_id has too, removed from every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return remove_repeated(docs.select("doc_id", "text")).select(
        "doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text"), 256).alias("kept_sha256")
    )
