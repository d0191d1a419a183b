"""TF-IDF over word uni- and bigrams.

Tasks number the words of a slice of texts and count by these numbers. Single words are counted
first: the ``max_features``-th largest count among those within the document limits bounds the counts
of the vocabulary from below. A pair of words is counted only if all pairs that share its bucket of a
hash reach that bound together, so the many rare pairs are neither spelled out nor shuffled. With
fewer words than that the bound is ``min_documents``, and the result is the same.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.feature import StopWordsRemover
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.columns import to_column
from tidemark.runtime import cut_lineage

MAX_FEATURES = 5000
MIN_DOCUMENTS = 5
MAX_SHARE = 0.7
_BITS = 20  # buckets of pairs, as a power of two
_SLICE = 1 << 23  # bytes of text whose words are numbered at once
_HELD = 1 << 20  # distinct terms that a task holds
_PARTIAL = "bucket int, term string, df bigint, cf bigint"

Batches = Iterator[pa.RecordBatch]


def english_stop_words() -> list[str]:
    return StopWordsRemover.loadDefaultStopWords("english")


def blank_separated(clean: Column | str) -> Column:
    """Cleaned text with a blank for every character that separates words."""
    return F.translate(to_column(clean), "+#,", "   ")


def document_words(df: DataFrame, key: str, clean: str) -> DataFrame:
    """``(key, words)`` as a written table, since several passes read the blank-separated texts."""
    return cut_lineage(df.select(key, blank_separated(clean).alias("words")))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Words:
    """The kept words of some texts: ``names`` and, word by word, ``ids`` into them and ``docs``."""

    def __init__(self, texts: pa.Array, stops: pa.Array) -> None:
        lists = pc.split_pattern(texts, " ")
        length = np.asarray(pc.list_value_length(lists).fill_null(0))
        coded = lists.flatten().dictionary_encode()
        names, ids = coded.dictionary, np.asarray(coded.indices)
        kept = pc.and_(pc.greater_equal(pc.utf8_length(names), 2), pc.invert(pc.is_in(names, stops)))
        good = np.asarray(kept).astype(bool)
        use = good[ids]
        self.names = names.filter(kept)
        self.ids = (np.cumsum(good) - 1)[ids[use]]
        self.docs = np.repeat(np.arange(len(texts)), length)[use]

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Document, first and second word of every two words in a row."""
        at = np.flatnonzero(self.docs[1:] == self.docs[:-1])
        return self.docs[at], self.ids[at], self.ids[at + 1]

    def hashes(self) -> np.ndarray:
        """64 bits of every name."""
        wide = self.names.cast(pa.large_binary())
        length = np.asarray(pc.binary_length(wide)).astype(np.int64)
        if not len(length):
            return np.zeros(0, np.uint64)
        offsets = np.frombuffer(wide.buffers()[1], np.int64)[wide.offset : wide.offset + len(wide) + 1]
        data = np.frombuffer(wide.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
        starts = offsets[:-1] - offsets[0]
        place = np.arange(len(data)) - np.repeat(starts, length)
        return np.add.reduceat(_mix(((place << 8) + data + 1).astype(np.uint64)), starts)


def _buckets(hashes: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Bucket of each pair of words."""
    return (_mix(hashes[a] * np.uint64(0x9E3779B97F4A7C15) + hashes[b]) >> np.uint64(64 - _BITS)).astype(np.int64)


def _cuts(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Slices of a batch of about ``_SLICE`` bytes; a longer text is one slice."""
    ends = np.cumsum(np.asarray(pc.binary_length(texts).fill_null(0)).astype(np.int64))
    start = 0
    while start < len(ends):
        before = ends[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(ends, before + _SLICE, "right")))
        yield start, end
        start = end


def _counted(docs: np.ndarray, terms: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Documents and terms (numbers below ``span``) that occur together, and how often."""
    both, tf = np.unique(docs * span + terms, return_counts=True)
    return both // span, both % span, tf


def _summed(tables: list[pa.Table]) -> pa.Table:
    sums = pa.concat_tables(tables).group_by("term").aggregate([("df", "sum"), ("cf", "sum")])
    return pa.table({"term": sums["term"], "df": sums["df_sum"], "cf": sums["cf_sum"]})


class _Totals:
    """Document and corpus counts per term, summed over the slices of a task."""

    def __init__(self) -> None:
        self.tables: list[pa.Table] = []

    def add(self, terms: pa.Array, df: np.ndarray, cf: np.ndarray) -> Batches:
        """Give the sums out where they become many."""
        columns = {"term": terms.cast(pa.string()), "df": pa.array(df, pa.int64()), "cf": pa.array(cf, pa.int64())}
        self.tables.append(pa.table(columns))
        if sum(map(len, self.tables)) > _HELD:
            self.tables = [_summed(self.tables)]
            if len(self.tables[0]) > _HELD // 2:
                yield from self.rest()

    def rest(self) -> Batches:
        if self.tables:
            table, self.tables = _summed(self.tables), []
            none = pa.nulls(len(table), pa.int32())
            yield from pa.table({"bucket": none, **dict(zip(table.column_names, table.columns))}).to_batches()


def _first_pass(words: DataFrame, stops: list[str], bigrams: bool) -> DataFrame:
    """Partial counts: single words, an empty term that counts the documents, buckets of pairs."""

    def count(batches: Batches) -> Batches:
        totals, buckets, documents = _Totals(), np.zeros(1 << _BITS, np.int64), 0
        for batch in batches:
            texts = batch.column("words")
            documents += len(texts) - texts.null_count
            for start, end in _cuts(texts):
                part = _Words(texts[start:end], pa.array(stops, texts.type))
                _, term, tf = _counted(part.docs, part.ids, max(1, len(part.names)))
                df = np.bincount(term, minlength=len(part.names))
                cf = np.bincount(part.ids, minlength=len(part.names))
                yield from totals.add(part.names, df, cf)
                if bigrams:
                    _, a, b = part.pairs()
                    buckets += np.bincount(_buckets(part.hashes(), a, b), minlength=1 << _BITS)
        yield from totals.add(pa.array([""]), np.array([documents]), np.array([documents]))
        yield from totals.rest()
        some = np.flatnonzero(buckets)
        yield pa.RecordBatch.from_arrays(
            [pa.array(some, pa.int32()), pa.nulls(len(some), pa.string()), pa.nulls(len(some), pa.int64()), pa.array(buckets[some])],
            names=["bucket", "term", "df", "cf"],
        )

    return words.select("words").mapInArrow(count, _PARTIAL)


def _pair_pass(words: DataFrame, stops: list[str], hot: np.ndarray) -> DataFrame:
    """Partial counts of the pairs in hot buckets."""
    shared = words.sparkSession.sparkContext.broadcast(np.packbits(hot))

    def count(batches: Batches) -> Batches:
        hot, totals = np.unpackbits(shared.value).astype(bool), _Totals()
        for batch in batches:
            texts = batch.column("words")
            for start, end in _cuts(texts):
                part = _Words(texts[start:end], pa.array(stops, texts.type))
                docs, a, b = part.pairs()
                keep = hot[_buckets(part.hashes(), a, b)]
                n = max(1, len(part.names))
                pairs, term = np.unique(a[keep] * n + b[keep], return_inverse=True)
                _, found, tf = _counted(docs[keep], term, max(1, len(pairs)))
                spelled = pc.binary_join_element_wise(
                    part.names.take(pa.array(pairs // n)), part.names.take(pa.array(pairs % n)), " "
                )
                yield from totals.add(
                    spelled, np.bincount(found, minlength=len(pairs)), np.bincount(term, minlength=len(pairs))
                )
        yield from totals.rest()

    return words.select("words").mapInArrow(count, _PARTIAL)


def vocabulary(
    words: DataFrame,
    stop_words: Sequence[str] | None = None,
    max_features: int = MAX_FEATURES,
    min_documents: int = MIN_DOCUMENTS,
    max_share: float = MAX_SHARE,
    bigrams: bool = True,
) -> DataFrame:
    """At most ``max_features`` terms with ``df``, ``cf`` and ``idf``: document-frequency limits
    first, then the largest corpus counts, ties in term order.

    ``words`` comes from :func:`document_words`. Per-term totals are written once, because the limits
    need the number of documents first. The driver gets the numbers of the hot buckets.
    """
    stops = list(stop_words) if stop_words is not None else english_stop_words()
    sums = (F.sum("df").alias("df"), F.sum("cf").alias("cf"))
    partial = cut_lineage(_first_pass(words, stops, bigrams))
    totals = cut_lineage(
        partial.where(F.col("term").isNotNull())
        .groupBy("term")
        .agg(*sums)
        .where((F.col("df") >= min_documents) | (F.col("term") == ""))
    )
    row = totals.where(F.col("term") == "").first()
    documents = float(row["df"]) if row else 0.0

    def limited(terms: DataFrame) -> DataFrame:
        within = (F.col("term") != "") & (F.col("df") <= max_share * documents)
        return terms.where(within).orderBy(F.desc("cf"), "term").limit(max_features)

    if bigrams:
        last = limited(totals).agg(F.count("*").alias("n"), F.min("cf").alias("cf")).first()
        least = max(min_documents, 1, last["cf"] if last["n"] and last["n"] >= max_features else 0)
        hot = np.zeros(1 << _BITS, bool)
        full = partial.where(F.col("bucket").isNotNull()).groupBy("bucket").agg(F.sum("cf").alias("cf"))
        rows = full.where(F.col("cf") >= least).select("bucket").toArrow()  # at most all buckets
        hot[np.asarray(rows["bucket"])] = True
        pairs = _pair_pass(words, stops, hot).groupBy("term").agg(*sums).where(F.col("df") >= min_documents)
        totals = cut_lineage(totals.unionByName(pairs))
    return limited(totals).withColumn("idf", F.log((1 + F.lit(documents)) / (1 + F.col("df"))) + 1)


class _Vocabulary:
    """Numbers of the terms of a vocabulary: ``single`` words, and pairs by the numbers of their words."""

    def __init__(self, terms: list[str]) -> None:
        halves = [term.split(" ") for term in terms]
        singles = [i for i, h in enumerate(halves) if len(h) == 1]
        pairs = [i for i, h in enumerate(halves) if len(h) == 2]
        self.single, self.single_at = pa.array([terms[i] for i in singles], pa.string()), np.array(singles, np.int64)
        parts = sorted({w for i in pairs for w in halves[i]})
        number = {w: j for j, w in enumerate(parts)}
        codes = np.array([number[halves[i][0]] * len(parts) + number[halves[i][1]] for i in pairs], np.int64)
        order = np.argsort(codes)
        self.part, self.codes, self.pair_at = pa.array(parts, pa.string()), codes[order], np.array(pairs, np.int64)[order]

    def found(self, part: _Words) -> tuple[np.ndarray, np.ndarray]:
        """Document and number of every occurrence of a term."""
        names = part.names.cast(pa.string())
        where = lambda values: np.asarray(pc.index_in(names, values).fill_null(-1)).astype(np.int64)
        single = where(self.single)[part.ids]
        docs, terms = [part.docs[single >= 0]], [self.single_at[single[single >= 0]]]
        if len(self.codes):
            place = where(self.part)
            d, a, b = part.pairs()
            a, b = place[a], place[b]
            known = (a >= 0) & (b >= 0)
            d, code = d[known], a[known] * len(self.part) + b[known]
            at = np.minimum(np.searchsorted(self.codes, code), len(self.codes) - 1)
            hit = self.codes[at] == code
            docs.append(d[hit])
            terms.append(self.pair_at[at[hit]])
        return np.concatenate(docs), np.concatenate(terms)


def sparse_rows(
    words: DataFrame, key: str, terms: Sequence[str], idf: Sequence[float], stop_words: Sequence[str] | None = None
) -> DataFrame:
    """One row per key with parallel arrays ``idx`` (numbers of ``terms``) and ``w``:
    ``w = (1 + ln tf) * idf`` scaled to unit length per key.

    ``terms`` is the bounded vocabulary, so a document holds at most that many entries.
    """
    stops = list(stop_words) if stop_words is not None else english_stop_words()
    shared = words.sparkSession.sparkContext.broadcast((_Vocabulary(list(terms)), np.array(idf, float)))

    def weigh(batches: Batches) -> Batches:
        vocab, idf = shared.value
        for batch in batches:
            texts = batch.column("words")
            for start, end in _cuts(texts):
                part = _Words(texts[start:end], pa.array(stops, texts.type))
                docs, term, tf = _counted(*vocab.found(part), max(1, len(idf)))
                raw = (1 + np.log(tf)) * idf[term]
                some, first = np.unique(docs, return_index=True)
                if not len(some):
                    continue
                bounds = pa.array(np.append(first, len(docs)), pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(key)[start:end].take(pa.array(some)),
                        pa.ListArray.from_arrays(bounds, pa.array(term, pa.int32())),
                        pa.ListArray.from_arrays(bounds, pa.array(raw)),
                        pa.array(np.add.reduceat(raw * raw, first)),
                    ],
                    names=[key, "idx", "raw", "square"],
                )

    schema = T.StructType(
        [
            words.schema[key],
            T.StructField("idx", T.ArrayType(T.IntegerType())),
            T.StructField("raw", T.ArrayType(T.DoubleType())),
            T.StructField("square", T.DoubleType()),
        ]
    )
    merged = words.mapInArrow(weigh, schema).groupBy(key).agg(
        F.flatten(F.collect_list("idx")).alias("idx"),
        F.flatten(F.collect_list("raw")).alias("raw"),
        F.sqrt(F.sum("square")).alias("norm"),
    )
    return merged.select(key, "idx", F.transform("raw", lambda x: x / F.col("norm")).alias("w"))


def collected(vocab: DataFrame) -> tuple[list[str], list[float]]:
    """Terms in order and their ``idf``: at most ``max_features`` rows."""
    rows = sorted((r["term"], r["idf"]) for r in vocab.select("term", "idf").collect())
    return [term for term, _ in rows], [idf for _, idf in rows]


def fit_transform(
    df: DataFrame,
    key: str,
    clean: str,
    stop_words: Sequence[str] | None = None,
    max_features: int = MAX_FEATURES,
    min_documents: int = MIN_DOCUMENTS,
    max_share: float = MAX_SHARE,
) -> DataFrame:
    """``(key, term, w)`` of all documents. The texts are written once and read by every pass."""
    words = document_words(df, key, clean)
    terms, idf = collected(vocabulary(words, stop_words, max_features, min_documents, max_share))
    index = df.sparkSession.createDataFrame(list(enumerate(terms)), "idx int, term string")
    entries = sparse_rows(words, key, terms, idf, stop_words).select(key, F.explode(F.arrays_zip("idx", "w")).alias("e"))
    return (
        entries.select(key, F.col("e.idx").alias("idx"), F.col("e.w").alias("w"))
        .join(F.broadcast(index), "idx")
        .select(key, "term", "w")
    )


def fit_sample(df: DataFrame, key: str, keep: float, seed: int = 42) -> DataFrame:
    """Rows whose hashed key falls below ``keep``: the same rows however the table is
    partitioned. Used only when the caller asks to fit on a part of the corpus."""
    parts = 1_000_000
    return df.where(
        F.pmod(F.xxhash64(F.col(key), F.lit(seed)), F.lit(parts)) < int(keep * parts)
    )
