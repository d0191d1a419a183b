"""Token ids as wavelet matrices, one compressed file per shard of documents.

A wavelet matrix keeps one bit-plane per id bit, highest first; after each plane the ids are split
stably into those with a zero and those with a one. With a directory of ones per 512 bits, rank on a
plane is constant time, so single tokens, counts of an id in a prefix and the places of an id are
read from the planes without decoding the shard.

Documents are dealt by ranges of doc_id, sorted, encoded and cut into shards of about ``SHARD_TOKENS``.
A shard's file is one row of a Parquet table (part, shard, sizes, file): any store Spark can write
holds it, and only committed tasks appear. File layout, little-endian: ``WMX1``, bits, tokens,
documents; then zstd blocks with their lengths: doc_ids (present flags, values), tokens per document,
and per plane its zeros, bits and directory.

Defined results: a null text is an empty one; every row is written, also rows that share a doc_id
(ordered by text hash) or have none (first); texts that hold a special string, are not in composed
normal form or hold a capital dotted I are encoded whole by the library; extra columns are ignored;
an empty table gives an empty result.
"""

from __future__ import annotations

import struct
import unicodedata
import zlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.arrays import Texts, slices
from tidemark.llm.exchange import Batches
from tidemark.llm.pretokens import Points, lower, with_specials
from tidemark.llm.token_counts import library, special_strings, vocabulary_path
from tidemark.runtime import scratch_path

MAGIC, SHARD_TOKENS, END_ID, CACHE_WORDS = b"WMX1", 1 << 20, 2, 1 << 20
_LINE = 512  # bits per directory entry


class WaveletMatrix:
    """Ids below ``2**bits`` with access, rank, select, count and occurrence lookup."""

    def __init__(self, n: int, bits: int, planes: list[tuple[int, np.ndarray, np.ndarray]]) -> None:
        self.n, self.bits, self.planes = n, bits, planes

    @classmethod
    def build(cls, ids: np.ndarray, bits: int) -> WaveletMatrix:
        kind = np.uint16 if bits <= 16 else np.uint32
        values, planes = np.ascontiguousarray(ids, kind), []
        for level in range(bits - 1, -1, -1):
            one = (values >> kind(level)) & kind(1) == 1
            packed = np.packbits(one, bitorder="little")
            packed = np.concatenate((packed, np.zeros(-len(packed) % (_LINE // 8), np.uint8)))
            ones = np.bitwise_count(packed.view(np.uint64)).reshape(-1, _LINE // 64).sum(axis=1)
            directory = np.concatenate(([0], np.cumsum(ones))).astype(np.uint32)
            zero = ~one
            zeros = int(np.count_nonzero(zero))
            planes.append((zeros, packed, directory))
            values = np.concatenate((values[zero], values[one]))
        return cls(len(ids), bits, planes)

    def _bit(self, level: int, i: int) -> int:
        return (int(self.planes[level][1][i >> 3]) >> (i & 7)) & 1

    def _ones(self, level: int, i: int) -> int:
        """Ones among the first ``i`` bits of a plane."""
        _, packed, directory = self.planes[level]
        line = i // _LINE
        part = packed[line * _LINE // 8 : i >> 3]
        rest = int(packed[i >> 3]) & ((1 << (i & 7)) - 1) if i & 7 else 0
        return int(directory[line]) + int(np.bitwise_count(part).sum()) + rest.bit_count()

    def access(self, i: int) -> int:
        """The id at place ``i``."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        value = 0
        for level in range(self.bits):
            bit = self._bit(level, i)
            ones = self._ones(level, i)
            i = self.planes[level][0] + ones if bit else i - ones
            value = value << 1 | bit
        return value

    def _block(self, token: int, i: int) -> tuple[int, int]:
        """Begin and end, after the last plane, of the occurrences of an id among the first ``i``."""
        lo, hi = 0, i
        for level in range(self.bits):
            a, b = self._ones(level, lo), self._ones(level, hi)
            if token >> (self.bits - 1 - level) & 1:
                lo, hi = self.planes[level][0] + a, self.planes[level][0] + b
            else:
                lo, hi = lo - a, hi - b
        return lo, hi

    def rank(self, token: int, i: int) -> int:
        """Occurrences of an id among the first ``i``."""
        if token >> self.bits:
            return 0
        lo, hi = self._block(token, i)
        return hi - lo

    def count(self, token: int) -> int:
        return self.rank(token, self.n)

    def select(self, token: int, k: int) -> int:
        """Place of the ``k``-th occurrence (from 0) of an id."""
        if not 0 <= k < self.count(token):
            raise IndexError(k)
        i = self._block(token, self.n)[0] + k
        for level in range(self.bits - 1, -1, -1):
            bit = token >> (self.bits - 1 - level) & 1
            i = self._nth(level, bit, i - self.planes[level][0] if bit else i)
        return i

    def occurrences(self, token: int) -> list[int]:
        return [self.select(token, k) for k in range(self.count(token))]

    def _nth(self, level: int, bit: int, k: int) -> int:
        """Place of the ``k``-th (from 0) bit of this value in a plane, by directory and one line."""
        _, packed, directory = self.planes[level]
        before = directory if bit else np.arange(len(directory)) * _LINE - directory.astype(np.int64)
        line = int(np.searchsorted(before, k, side="right")) - 1
        bits = np.unpackbits(packed[line * _LINE // 8 : (line + 1) * _LINE // 8], bitorder="little")
        return line * _LINE + int(np.flatnonzero(bits == bit)[k - int(before[line])])

    def decode(self) -> np.ndarray:
        """All ids, by undoing the splits from the last plane to the first."""
        kind = np.uint16 if self.bits <= 16 else np.uint32
        values = np.zeros(self.n, kind)
        for level in range(self.bits - 1, -1, -1):
            zeros, packed, _ = self.planes[level]
            one = np.unpackbits(packed, count=self.n, bitorder="little").view(bool)
            above = np.empty(self.n, kind)
            above[one] = values[zeros:] | kind(1 << (self.bits - 1 - level))
            above[~one] = values[:zeros]
            values = above
        return values

    def to_bytes(self, doc_ids: np.ndarray, present: np.ndarray, lengths: np.ndarray) -> bytes:
        press = zstandard.ZstdCompressor(level=1).compress
        blocks = [present.astype(np.uint8).tobytes(), doc_ids.astype("<i8").tobytes(), lengths.astype("<u4").tobytes()]
        for zeros, packed, directory in self.planes:
            blocks += [struct.pack("<Q", zeros), packed.tobytes(), directory.astype("<u4").tobytes()]
        packed_blocks = [press(b) for b in blocks]
        head = MAGIC + struct.pack("<IQQ", self.bits, self.n, len(lengths))
        return head + b"".join(struct.pack("<QQ", len(p), len(b)) + p for p, b in zip(packed_blocks, blocks))


def from_bytes(data: bytes) -> tuple[WaveletMatrix, np.ndarray, np.ndarray, np.ndarray]:
    """The matrix of a file, and its doc_ids, present flags and tokens per document."""
    if data[:4] != MAGIC:
        raise ValueError("not a wavelet matrix file")
    bits, n, _ = struct.unpack_from("<IQQ", data, 4)
    at, blocks, unpress = 24, [], zstandard.ZstdDecompressor()
    while at < len(data):
        packed, size = struct.unpack_from("<QQ", data, at)
        at += 16
        blocks.append(unpress.decompress(data[at : at + packed], max_output_size=size) if size else b"")
        at += packed
    present, ids = np.frombuffer(blocks[0], np.uint8) == 1, np.frombuffer(blocks[1], "<i8")
    planes = [
        (struct.unpack("<Q", z)[0], np.frombuffer(b, np.uint8), np.frombuffer(d, "<u4"))
        for z, b, d in zip(blocks[3::3], blocks[4::3], blocks[5::3])
    ]
    return WaveletMatrix(n, bits, planes), ids, present, np.frombuffer(blocks[2], "<u4")


class WordEncoder:
    """Ids of whole texts, with each distinct pre-token encoded once while it is remembered.

    At most about ``CACHE_WORDS`` pre-tokens are kept; beyond that the memory starts anew.
    """

    def __init__(self, path: str) -> None:
        self.path, self.specials = path, special_strings(path)
        self._forget()

    def _forget(self) -> None:
        self.h1, self.h2 = np.zeros(0, np.uint64), np.zeros(0, np.uint32)
        self.begin, self.size = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.int32)

    def _learn(self, h1: np.ndarray, h2: np.ndarray, words: list[str]) -> None:
        lists = [e.ids for e in library(self.path).encode_batch_fast(words, add_special_tokens=False)]
        size = np.fromiter(map(len, lists), np.int64, len(lists))
        flat = np.fromiter((i for x in lists for i in x), np.int32, int(size.sum()))
        begin = len(self.ids) + np.cumsum(size) - size
        place = np.searchsorted(self.h1, h1)
        self.ids = np.concatenate((self.ids, flat))
        self.h1, self.h2 = np.insert(self.h1, place, h1), np.insert(self.h2, place, h2)
        self.begin, self.size = np.insert(self.begin, place, begin), np.insert(self.size, place, size)

    def __call__(self, texts: Texts) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts end to end, and how many each has."""
        raw = Points.of(texts)
        odd = set(with_specials(texts, self.specials).tolist())
        if len(raw.points) and raw.points.max() >= 0x130:
            high = np.flatnonzero(raw.points >= 0x130)
            for i in np.unique(np.searchsorted(raw.bounds, high, side="right") - 1).tolist():
                text = raw.points[raw.bounds[i] : raw.bounds[i + 1]].tobytes().decode("utf-32-le")
                if "İ" in text or not unicodedata.is_normalized("NFC", text):
                    odd.add(i)
        points = Points(lower()[raw.points], raw.bounds)
        starts, ends = points.bare_tokens()
        owner = np.searchsorted(points.bounds, starts, side="right") - 1
        h1, h2 = points.hashes(starts, ends)
        one, first, inverse = np.unique(h1, return_index=True, return_inverse=True)
        new = first[~self._known(one)]
        if len(self.h1) + len(new) > CACHE_WORDS:
            self._forget()
            new = first
        if len(new):
            self._learn(h1[new], h2[new], points.strings(starts[new], ends[new]))
        at = np.searchsorted(self.h1, one)[inverse]
        odd.update(owner[self.h2[at] != h2].tolist())  # two words under one 64-bit hash
        if odd:
            keep = ~np.isin(owner, list(odd))
            at, owner = at[keep], owner[keep]
        size = self.size[at]
        total = np.bincount(owner, size, minlength=len(texts)).astype(np.int64)
        ends = np.cumsum(size)
        ids = self.ids[np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.begin[at] - (ends - size), size)]
        for i in sorted(odd):
            text = texts.data[texts.bounds[i] : texts.bounds[i + 1]].tobytes().decode()
            own = library(self.path).encode(text, add_special_tokens=False).ids
            ids = np.insert(ids, int(total[:i].sum()), own)
            total[i] = len(own)
        return ids, total

    def _known(self, hashes: np.ndarray) -> np.ndarray:
        if not len(self.h1):
            return np.zeros(len(hashes), bool)
        return self.h1[np.minimum(np.searchsorted(self.h1, hashes), len(self.h1) - 1)] == hashes


_encoders: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """The worker's encoder, kept from task to task."""
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def write_shards(docs: DataFrame, tokenizer: str, folder: str, shard_tokens: int = SHARD_TOKENS) -> None:
    """Encode ``docs`` (doc_id, text) in ascending doc_id order into shard files below ``folder``."""
    bits = max(library(tokenizer).get_vocab_size() - 1, END_ID).bit_length()

    def encode(batches: Batches) -> Batches:
        part, shard = TaskContext.get().partitionId(), 0
        ids: list[np.ndarray] = []
        names: list[np.ndarray] = []
        has: list[np.ndarray] = []
        counts: list[np.ndarray] = []

        def file() -> pa.RecordBatch:
            tokens, lengths = np.concatenate(ids), np.concatenate(counts)
            data = WaveletMatrix.build(tokens, bits).to_bytes(np.concatenate(names), np.concatenate(has), lengths)
            row = {"part": [part], "shard": [shard], "n_docs": [len(lengths)], "n_tokens": [len(tokens)], "file": [data]}
            for held in (ids, names, has, counts):
                held.clear()
            return pa.RecordBatch.from_pydict(row, schema=pa.schema(
                [("part", pa.int32()), ("shard", pa.int32()), ("n_docs", pa.int64()), ("n_tokens", pa.int64()), ("file", pa.binary())]
            ))

        for batch in batches:
            doc, known = batch.column("doc_id").fill_null(0), batch.column("doc_id").is_valid()
            doc, known = np.asarray(doc), known.to_numpy(zero_copy_only=False)
            for texts in slices(batch.column("text"), 2 << 20):
                own, total = encoder(tokenizer)(texts)
                ends = np.cumsum(total)
                flat = np.insert(own, ends, END_ID).astype(np.int32)
                ids.append(flat)
                counts.append(total + 1)
                names.append(doc[texts.first : texts.first + len(texts)])
                has.append(known[texts.first : texts.first + len(texts)])
                if sum(map(len, ids)) >= shard_tokens:
                    yield file()
                    shard += 1
        if ids:
            yield file()

    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    (
        docs.repartitionByRange("doc_id")
        .sortWithinPartitions("doc_id", F.xxhash64("text"))
        .mapInArrow(encode, "part int, shard int, n_docs bigint, n_tokens bigint, file binary")
        .write.option("compression", "none")
        .parquet(folder)
    )


def read_shards(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, decoded from the shard files."""

    def decode(batches: Batches) -> Batches:
        for batch in batches:
            for part, shard, data in zip(*(batch.column(c).to_pylist() for c in ("part", "shard", "file"))):
                matrix, doc, present, lengths = from_bytes(data)
                ids = matrix.decode().astype("<u4")
                ends = np.cumsum(lengths.astype(np.int64))
                starts = ends - lengths
                body = memoryview(ids).cast("B")
                sums = [zlib.crc32(body[4 * a : 4 * b]) for a, b in zip(starts.tolist(), ends.tolist())]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(doc), part, np.int32)), pa.array(np.full(len(doc), shard, np.int32)),
                     pa.array(doc, mask=~present), pa.array(starts), pa.array(lengths.astype(np.int64)), pa.array(sums, pa.int64())],
                    names=["part", "shard", "doc_id", "here", "n_tokens", "ids_crc32"],
                )

    files = spark.read.parquet(folder)
    sizes = files.select("part", "shard", "n_tokens")
    # tokens before each part (one row per task is ordered as a whole), then before each shard in it
    parts = sizes.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    parts = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before_part"))
    inside = F.sum("n_tokens").over(Window.partitionBy("part").orderBy("shard")) - F.col("n_tokens")
    before = sizes.select("part", "shard", inside.alias("before")).join(parts, "part")
    rows = files.select("part", "shard", "file").mapInArrow(
        decode, "part int, shard int, doc_id bigint, here bigint, n_tokens bigint, ids_crc32 bigint"
    )
    start = F.col("before_part") + F.col("before") + F.col("here")
    return rows.join(before, ["part", "shard"]).select("doc_id", start.alias("start"), "n_tokens", "ids_crc32")


def op3_wavelet_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write all documents' ids as wavelet matrices, and read place, size and checksum back."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = scratch_path(spark, "wavelet")
    write_shards(docs, vocabulary_path("word_bpe_49k.json"), folder)
    return read_shards(spark, folder)
