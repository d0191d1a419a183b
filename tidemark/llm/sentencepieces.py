"""SentencePiece encoding and decoding with batched merging and a batched Viterbi search.

Texts are escaped as the model does it (identity normalisation, a leading space, spaces as U+2581)
and cut into words at spaces and around characters that no piece contains; no piece crosses such a
cut, so the best segmentation of a text is that of its words. Distinct words of equal length advance
together: substring hashes of each length probe the sorted hashes of the pieces, and at every end
position vectorised maxima over the piece lengths store the score and the backpointer. Ties take the
longest last piece. Characters without a piece cost ten less than the worst piece and become bytes.

The search gives the best-scoring segmentation under the scores in the file. A model file of the BPE
kind holds merge priorities as scores, and its segmentation is another: as long as two neighbours
form a piece, the pair of the highest score (the leftmost of equal ones) is merged. ``merge`` does
that for words of equal length at once, one merge per word and step, and for long words one by one
with a heap; its ids are those of the library. Both decode to the same text.

Defined results: null and empty texts give no ids; every row is encoded by itself, also rows that
share a doc_id or have none; U+2581 in a text decodes to a space, as in the library; ids that are
not in the model raise; extra columns are kept aside; an empty table gives an empty result.
"""

from __future__ import annotations

from functools import cache
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.arrays import _power, gather, mix, prefix, slices
from tidemark.llm.exchange import Batches
from tidemark.llm.pretokens import Points
from tidemark.llm.token_counts import vocabulary_path

BLANK, CACHE_WORDS, CELLS, CHUNK_IDS = 0x2581, 1 << 19, 1 << 16, 1 << 18
LONG_WORD = 256
_SEED = 3


def _letters(points: np.ndarray) -> np.ndarray:
    return mix(points.astype(np.uint64) + np.uint64(0x51ED270B))


class PieceModel:
    """Pieces of a model file as arrays, with search and decoding."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        plain = [i for i in range(n) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
        strings = [model.id_to_piece(i) for i in plain]
        points = [np.array([ord(c) for c in s], np.uint32) for s in strings]
        self.longest = max(map(len, points))
        hashes = np.array([int(mix(prefix(_letters(p), _SEED)[-1:])[0]) for p in points], np.uint64)
        if len(np.unique(hashes)) < len(hashes):
            raise ValueError("two pieces share a hash")
        order = np.argsort(hashes)
        self.hashes, self.ids = hashes[order], np.array(plain, np.int32)[order]
        self.heads = np.zeros(1 << 20, bool)
        self.heads[self.hashes >> np.uint64(44)] = True
        self.scores = np.array([model.get_score(i) for i in plain])[order]
        self.priority = {s: model.get_score(i) for s, i in zip(strings, plain)}
        self.unknown = self.scores.min() - 10.0
        self.known = np.zeros(0x110000, bool)
        self.known[np.unique(np.concatenate(points))] = True
        self.bytes = np.array([model.piece_to_id(f"<0x{b:02X}>") for b in range(256)], np.int32)
        said = [model.id_to_piece(i).replace("▁", " ").encode() for i in range(n)]
        for b, i in enumerate(self.bytes.tolist()):
            said[i] = bytes([b])
        for i in range(n):
            if model.is_control(i):
                said[i] = b""
        self.said = np.frombuffer(b"".join(said), np.uint8)
        self.said_size = np.fromiter(map(len, said), np.int64, n)
        self.said_at = np.cumsum(self.said_size) - self.said_size

    def _find(self, h: np.ndarray) -> np.ndarray:
        """Place of the piece with each hash, or -1; a table of hash heads spares most searches."""
        out = np.full(h.shape, -1)
        likely = np.nonzero(self.heads[h >> np.uint64(44)])
        some = h[likely]
        at = np.minimum(np.searchsorted(self.hashes, some), len(self.hashes) - 1)
        out[likely] = np.where(self.hashes[at] == some, at, -1)
        return out

    def _pieces(self, words: np.ndarray) -> list[np.ndarray]:
        """By length less one: for every word and start, the place of the piece or -1."""
        m, size = words.shape
        sums = np.zeros((m, size + 1), np.uint64)
        np.cumsum(_letters(words) * _power(_SEED, size), axis=1, out=sums[:, 1:])
        shift = _power(_SEED, size, inverse=True)
        return [
            self._find(mix((sums[:, length:] - sums[:, : size - length + 1]) * shift[: size - length + 1]))
            for length in range(1, min(self.longest, size) + 1)
        ]

    def search(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Best pieces of words of one length (one word per row of code points): ids end to end, and
        how many each word has."""
        m, size = words.shape
        piece = self._pieces(words)
        reach = len(piece)
        gain = [np.where(p >= 0, self.scores[p], -np.inf) for p in piece]
        gain[0] = np.where(piece[0] >= 0, gain[0], self.unknown)
        best = np.zeros((m, size + 1))
        back = np.zeros((m, size + 1), np.int64)
        for end in range(1, size + 1):
            lengths = range(min(reach, end), 0, -1)
            options = np.stack([best[:, end - k] + gain[k - 1][:, end - k] for k in lengths])
            choice = options.argmax(axis=0)
            best[:, end] = options[choice, np.arange(m)]
            back[:, end] = lengths[0] - choice
        rows, ends, steps = np.arange(m), np.full(m, size), []
        while len(rows):
            length = back[rows, ends]
            start = ends - length
            steps.append((rows, start, length))
            more = start > 0
            rows, ends = rows[more], start[more]
        row, start, length = (np.concatenate(c) for c in zip(*steps))
        order = np.lexsort((start, row))
        return self._spelled(words, piece, row[order], start[order], length[order])

    def merge(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merged pieces of words of one length, as the library forms them: ids end to end, and how
        many each word has."""
        m, size = words.shape
        piece = self._pieces(words)
        if size > LONG_WORD:
            ends = [self._merged_alone("".join(map(chr, w))) for w in words.tolist()]
            row = np.repeat(np.arange(m), [len(e) for e in ends])
            end = np.concatenate(ends)
            start = np.concatenate([[0, *e[:-1]] for e in ends])
            return self._spelled(words, piece, row, start, end - start)
        reach = len(piece)
        score = np.full((reach + 1, m, size + 1), -np.inf)
        for k in range(2, reach + 1):
            score[k, :, : size - k + 1] = np.where(piece[k - 1] >= 0, self.scores[piece[k - 1]], -np.inf)
        head = np.ones((m, size), bool)
        # of every symbol's start: the next one's and the one before it; the score of joining it to the next
        after = np.tile(np.arange(1, size + 2), (m, 1))
        before = np.tile(np.arange(-1, size), (m, 1))
        pair = score[min(2, reach)].copy() if size > 1 else np.full((m, size + 1), -np.inf)
        rows = np.arange(m)
        while True:
            at = pair[rows].argmax(axis=1) if len(rows) < m else pair.argmax(axis=1)
            more = pair[rows, at] > -np.inf
            rows, at = rows[more], at[more]
            if not len(rows):
                break
            gone = after[rows, at]
            end = after[rows, gone]
            head[rows, gone] = False
            after[rows, at], before[rows, end] = end, at
            pair[rows, gone] = -np.inf
            span = after[rows, end] - at
            joins = (end < size) & (span <= reach)
            pair[rows, at] = np.where(joins, score[np.where(joins, span, 0), rows, at], -np.inf)
            left = before[rows, at]
            some = left >= 0
            r, to, stop = rows[some], left[some], end[some]
            span = stop - to
            pair[r, to] = np.where(span <= reach, score[np.minimum(span, reach), r, to], -np.inf)
        row, start = np.nonzero(head)
        return self._spelled(words, piece, row, start, after[row, start] - start)

    def _merged_alone(self, word: str) -> list[int]:
        """Ends of the merged pieces of one word."""
        size, score = len(word), self.priority
        after, before = list(range(1, size + 1)), list(range(-1, size))
        heap = [(-score[word[i : i + 2]], i, i + 1, i + 2) for i in range(size - 1) if word[i : i + 2] in score]
        heapify(heap)
        while heap:
            _, at, middle, end = heappop(heap)
            if after[at] != middle or middle >= size or after[middle] != end:
                continue  # one of the two was merged since
            after[at], after[middle], before[end] = end, -1, at
            if end < size and word[at : after[end]] in score:
                heappush(heap, (-score[word[at : after[end]]], at, end, after[end]))
            left = before[at]
            if left >= 0 and word[left:end] in score:
                heappush(heap, (-score[word[left:end]], left, at, end))
        ends, at = [], 0
        while at < size:
            at = after[at]
            ends.append(at)
        return ends

    def _spelled(
        self, words: np.ndarray, piece: list[np.ndarray], row: np.ndarray, start: np.ndarray, length: np.ndarray
    ) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the spans in order, characters without a piece as bytes, and how many each word has."""
        m = len(words)
        found = np.empty(len(row), np.int64)
        for k in np.unique(length).tolist():
            of = length == k
            found[of] = piece[k - 1][row[of], start[of]]
        ids, times = self.ids[found], np.ones(len(row), np.int64)
        if (found < 0).any():
            lost = np.flatnonzero(found < 0)
            spelled = [self.bytes[list(chr(c).encode())] for c in words[row[lost], start[lost]].tolist()]
            times[lost] = [len(s) for s in spelled]
            first = np.cumsum(times) - times
            ids = np.repeat(ids, times)
            for at, s in zip(first[lost].tolist(), spelled):
                ids[at : at + len(s)] = s
        return ids, np.bincount(row, times, minlength=m).astype(np.int64)

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> list[bytes]:
        """Text of each list of ids, without the leading space."""
        if len(ids) and (ids.min() < 0 or ids.max() >= len(self.said_at)):
            raise ValueError("id outside the model")
        out = gather(self.said, self.said_at[ids], self.said_size[ids]).tobytes()
        ends = np.concatenate(([0], np.cumsum(self.said_size[ids])))
        to = ends[np.concatenate(([0], np.cumsum(counts)))].tolist()
        return [out[a + (out[a : a + 1] == b" ") : b] for a, b in zip(to, to[1:])]


@cache
def model(path: str) -> PieceModel:
    """The worker's model, kept from task to task."""
    return PieceModel(path)


class PieceEncoder:
    """Encodes slices of texts by search or, ``merged``, by merging; remembers up to about ``CACHE_WORDS`` words, then starts anew."""

    def __init__(self, path: str, merged: bool = False) -> None:
        self.model = model(path)
        self._split = self.model.merge if merged else self.model.search
        self._forget()

    def _forget(self) -> None:
        self.h1, self.h2 = np.zeros(0, np.uint64), np.zeros(0, np.uint32)
        self.begin, self.size = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.int32)

    def _known(self, hashes: np.ndarray) -> np.ndarray:
        if not len(self.h1):
            return np.zeros(len(hashes), bool)
        return self.h1[np.minimum(np.searchsorted(self.h1, hashes), len(self.h1) - 1)] == hashes

    def _search(self, points: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids and their number for every word."""
        length = ends - starts
        number = np.zeros(len(starts), np.int64)
        parts: list[tuple[np.ndarray, np.ndarray]] = []
        order = np.argsort(length, kind="stable")
        cuts = np.flatnonzero(np.diff(length[order])) + 1
        for same in np.split(order, cuts) if len(order) else ():
            size = int(length[same[0]])
            for lo in range(0, len(same), max(1, CELLS // size)):
                some = same[lo : lo + max(1, CELLS // size)]
                ids, counts = self._split(points[starts[some][:, None] + np.arange(size)])
                number[some] = counts
                parts.append((some, ids))
        begin = np.cumsum(number) - number
        out = np.empty(int(number.sum()), np.int32)
        for some, ids in parts:
            to = np.cumsum(number[some])
            out[np.arange(len(ids)) + np.repeat(begin[some] - (to - number[some]), number[some])] = ids
        return out, number

    def __call__(self, raw: Points) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts end to end, and how many each has."""
        n = len(raw.bounds) - 1
        full = np.flatnonzero(np.diff(raw.bounds) > 0)
        points = np.insert(raw.points, raw.bounds[full], BLANK)
        points[points == 0x20] = BLANK
        bounds = raw.bounds + np.searchsorted(full, np.arange(n + 1))
        if not len(points):
            return np.zeros(0, np.int32), np.zeros(n, np.int64)
        blank, lost = points == BLANK, ~self.model.known[points]
        begin = np.ones(len(points), bool)
        begin[1:] = (blank[1:] & ~blank[:-1]) | lost[1:] | lost[:-1]
        begin[bounds[:-1][bounds[:-1] < len(points)]] = True
        starts = np.flatnonzero(begin)
        ends = np.append(starts[1:], len(points))
        cut = Points(points, bounds)
        h1, h2 = cut.hashes(starts, ends)
        one, first, inverse = np.unique(h1, return_index=True, return_inverse=True)
        new = first[~self._known(one)]
        if len(self.h1) + len(new) > CACHE_WORDS:
            self._forget()
            new = first
        if len(new):
            ids, size = self._search(points, starts[new], ends[new])
            at = len(self.ids) + np.cumsum(size) - size
            place = np.searchsorted(self.h1, h1[new])
            self.ids = np.concatenate((self.ids, ids))
            self.h1, self.h2 = np.insert(self.h1, place, h1[new]), np.insert(self.h2, place, h2[new])
            self.begin, self.size = np.insert(self.begin, place, at), np.insert(self.size, place, size)
        at = np.searchsorted(self.h1, one)[inverse]
        other = np.flatnonzero(self.h2[at] != h2)  # two words under one 64-bit hash
        size, source, where = self.size[at], self.ids, self.begin[at]
        if len(other):
            ids, size[other] = self._search(points, starts[other], ends[other])
            where[other] = len(source) + np.cumsum(size[other]) - size[other]
            source = np.concatenate((source, ids))
        to = np.cumsum(size)
        ids = source[np.arange(to[-1]) + np.repeat(where - (to - size), size)]
        owner = np.searchsorted(bounds, starts, side="right") - 1
        return ids, np.bincount(owner, size, minlength=n).astype(np.int64)


@cache
def encoder(path: str, merged: bool = False) -> PieceEncoder:
    """The worker's encoder, kept from task to task."""
    return PieceEncoder(path, merged)


def _offsets(counts: np.ndarray) -> pa.Array:
    return pa.array(np.concatenate(([0], np.cumsum(counts))).astype(np.int32))


def encode_texts(
    docs: DataFrame,
    path: str,
    text: str = "text",
    ids: str | None = "piece_ids",
    check: str | None = None,
    merged: str | None = None,
) -> DataFrame:
    """``docs`` with a column ``ids`` of searched piece ids after its others, with ``merged`` a column
    of the ids that merging gives, and with ``check`` a column that tells whether all of them decode to
    the text again (with U+2581 as a space)."""
    ways = [(name, way) for name, way in ((ids, False), (merged, True)) if name]

    def encode(batches: Batches) -> Batches:
        for batch in batches:
            for texts in slices(batch.column(text)):
                points = Points.of(texts)
                columns = [*batch.slice(texts.first, len(texts)).columns]
                same = np.ones(len(texts), bool)
                if check:
                    data = texts.data.tobytes()
                    own_text = [data[a:b].replace(b"\xe2\x96\x81", b" ") for a, b in zip(texts.bounds, texts.bounds[1:])]
                for _, way in ways:
                    own, number = encoder(path, way)(points)
                    columns.append(pa.ListArray.from_arrays(_offsets(number), pa.array(own)))
                    if check:
                        said = model(path).decode(own, number)
                        same &= np.fromiter((x == y for x, y in zip(said, own_text)), bool, len(texts))
                if check:
                    columns.append(pa.array(same))
                yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, *(name for name, _ in ways), *([check] if check else [])])

    kept = docs.drop(*(name for name, _ in ways), *([check] if check else [])).withColumn(text, F.col(text).cast("string"))
    added = {name: F.lit(None).cast("array<int>") for name, _ in ways}
    added |= {check: F.lit(None).cast("boolean")} if check else {}
    return kept.mapInArrow(encode, kept.withColumns(added).schema)


def decode_ids(docs: DataFrame, path: str, ids: str = "piece_ids", text: str = "decoded") -> DataFrame:
    """``docs`` with a column of the text that its ids say."""

    def decode(batches: Batches) -> Batches:
        for batch in batches:
            ends = np.cumsum(np.asarray(batch.column(ids).value_lengths().fill_null(0)).astype(np.int64))
            lo = 0
            while lo < batch.num_rows:
                limit = (ends[lo - 1] if lo else 0) + CHUNK_IDS
                hi = max(lo + 1, int(np.searchsorted(ends, limit, side="right")))
                part = batch.slice(lo, hi - lo)
                column, lo = part.column(ids), hi
                counts = np.asarray(column.value_lengths().fill_null(0)).astype(np.int64)
                said = encoder(path).model.decode(np.asarray(column.flatten()), counts)
                strings = pa.array([s.decode(errors="replace") for s in said], pa.string())
                yield pa.RecordBatch.from_arrays([*part.columns, strings], names=[*batch.schema.names, text])

    kept = docs.drop(text)
    return kept.mapInArrow(decode, kept.withColumn(text, F.lit(None).cast("string")).schema)


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Piece ids of every document by search and by the model's own merging (``model_ids``), and whether
    both decode to its text again."""
    path = vocabulary_path("piece_bpe_32k.model")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    encoded = encode_texts(docs, path, check="round_trip", merged="model_ids")
    return encoded.select(
        "doc_id", "piece_ids", F.size("piece_ids").cast("bigint").alias("n_pieces"), "round_trip",
        "model_ids", F.size("model_ids").cast("bigint").alias("n_model_ids"),
    )
