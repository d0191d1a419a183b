"""Toxicity scores from a bidirectional gated recurrent network with attention pooling.

Words are runs of letters and digits, lower-cased. A word's input is its own embedding (hashed) plus
two character inputs: the mean embedding of its trigrams (hashed bytes, with marks for both ends) and
the embedding of its first ``STEM`` bytes. Windows of
``WINDOW`` words, starting every ``STRIDE`` words and once at the end, run through a forward and a
backward gated recurrent layer; attention pools their states, and a logistic unit scores the window.
A text's score is that of its worst window.

Training is in numpy, inside one task, on a bounded sample: of either class the ``per_class``
labelled documents with the smallest hash of their doc_id. Only the label of a whole document is
known, so each step scores all windows of its documents and learns from the worst window of each
(in the first updates from random windows). Scoring runs over all windows of all texts; the input
gates of a word are computed once per distinct word of a slice.

Defined results: a text without words scores 0; null counts as empty; without labels of both classes
all scores are 0; null labels are ignored; rows are scored by themselves, also those that share a
doc_id or have none; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import io

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.arrays import Texts, letters, mix, prefix, slices, span_hash
from tidemark.llm.exchange import Batches

WINDOW, STRIDE = 64, 32
WORDS, GRAMS, STEM, WIDTH, HIDDEN = 1 << 15, 1 << 13, 5, 16, 8
PER_CLASS, CLEAN_SHARE, UPDATES, WARM, BATCH, RATE, SEED = 1000, 2, 260, 60, 96, 0.01, 7
CUT, LIMIT = 0.7, 1 << 12
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True


class WordInputs:
    """Words of a slice: distinct ones with hashed ids of themselves and of their trigrams."""

    def __init__(self, texts: Texts) -> None:
        data = _LOWER[texts.data]
        inside = np.zeros(len(data) + 2, bool)
        inside[1:-1] = _WORD[data]
        begins, ends = inside[1:] & ~inside[:-1], inside[:-1] & ~inside[1:]
        cuts = texts.bounds[1:-1]
        joined = cuts[inside[cuts] & inside[cuts + 1]]
        begins[joined] = ends[joined] = True
        starts, stops = np.flatnonzero(begins[: len(data)]), np.flatnonzero(ends)
        self.first = np.searchsorted(starts, texts.bounds)
        sums = prefix(letters(0)[data], 0)
        name = span_hash(sums, starts, stops, 0)
        one, at, self.words = np.unique(name, return_index=True, return_inverse=True)
        self.ids = (one % np.uint64(WORDS)).astype(np.int64)
        lo, size = starts[at], stops[at] - starts[at]
        self.stems = (span_hash(sums, lo, lo + np.minimum(size, STEM), 0) % np.uint64(WORDS)).astype(np.int64)
        place = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
        here = np.repeat(lo, size) + place
        padded = np.concatenate(([0], data, [0])).astype(np.uint64)
        left = np.where(place > 0, padded[here], 256)
        right = np.where(place + 1 < np.repeat(size, size), padded[here + 2], 256)
        gram = (left * np.uint64(512) + padded[here + 1]) * np.uint64(512) + right
        self.grams = (mix(gram + np.uint64(99)) % np.uint64(GRAMS)).astype(np.int64)
        self.sizes = size
        self.longest = np.argsort(-size, kind="stable")

    def mean_rows(self, table: np.ndarray) -> np.ndarray:
        """Mean of the table's rows over each word's trigrams."""
        total = np.zeros((len(self.sizes), table.shape[1]), table.dtype)
        at = (np.cumsum(self.sizes) - self.sizes)[self.longest]
        left = len(at) - np.cumsum(np.bincount(self.sizes)) if len(at) else []
        for k, n in enumerate(left):  # n words have a trigram k: the first ones, as long words come first
            total[:n] += table[self.grams[at[:n] + k]]
        out = np.empty_like(total)
        out[self.longest] = total
        return out / np.maximum(self.sizes, 1)[:, None].astype(table.dtype)

    def windows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First word and size of every window, and the text it is in."""
        count = np.diff(self.first)
        number = np.where(count > 0, 1 + np.maximum(0, -(-(count - WINDOW) // STRIDE)), 0)
        owner = np.repeat(np.arange(len(count)), number)
        k = np.arange(len(owner)) - np.repeat(np.cumsum(number) - number, number)
        start = np.minimum(k * STRIDE, np.maximum(count[owner] - WINDOW, 0))
        return self.first[owner] + start, np.minimum(count[owner], WINDOW), owner


def _sigmoid(x: np.ndarray) -> np.ndarray:
    out = np.tanh(0.5 * x)
    out *= 0.5
    out += 0.5
    return out


def _scatter(index: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    """Sum of the rows of each index."""
    return np.stack([np.bincount(index, column, n) for column in rows.T], axis=1).astype(rows.dtype)


class Network:
    """Weights by name, with scoring and one training step."""

    def __init__(self, weights: dict[str, np.ndarray]) -> None:
        self.w = weights

    @classmethod
    def fresh(cls) -> Network:
        rng = np.random.default_rng(SEED)
        draw = lambda scale, *shape: (rng.normal(size=shape) * scale).astype(np.float32)
        w = {"words": draw(0.3, WORDS, WIDTH), "grams": draw(0.3, GRAMS, WIDTH), "stems": draw(0.3, WORDS, WIDTH)}
        for d in "fb":
            w[f"in_{d}"] = draw(0.3, WIDTH, 3 * HIDDEN)
            w[f"bias_{d}"] = np.zeros(3 * HIDDEN, np.float32)
            w[f"state_{d}"] = draw(0.3, HIDDEN, 3 * HIDDEN)
        w |= {"attend": draw(0.5, 2 * HIDDEN, HIDDEN), "attend_bias": np.zeros(HIDDEN, np.float32), "query": draw(0.5, HIDDEN)}
        w |= {"out": draw(0.5, 2 * HIDDEN), "out_bias": np.zeros(1, np.float32)}
        return cls(w)

    def to_bytes(self) -> bytes:
        file = io.BytesIO()
        np.savez(file, **self.w)
        return file.getvalue()

    @classmethod
    def from_bytes(cls, data: bytes) -> Network:
        return cls(dict(np.load(io.BytesIO(data))))

    def vectors(self, inputs: WordInputs) -> np.ndarray:
        """Input of every distinct word, and one row of zeros for no word."""
        w = self.w
        own = w["words"][inputs.ids] + w["stems"][inputs.stems] + inputs.mean_rows(w["grams"])
        return np.concatenate((own, np.zeros((1, WIDTH), own.dtype)))

    def gates(self, vectors: np.ndarray) -> dict[str, np.ndarray]:
        """Input gates of these words per direction; those of the last row, no word, are zeros."""
        out = {d: vectors @ self.w[f"in_{d}"] for d in "fb"}
        for d, rows in out.items():
            rows[:-1] += self.w[f"bias_{d}"]
        return out

    def _run(self, gates: np.ndarray, index: np.ndarray, mask: np.ndarray, d: str, keep: list | None) -> np.ndarray:
        """States of one direction, (steps, windows, hidden); ``keep`` collects what backward needs."""
        steps, n = index.shape
        gate_r, gate_z, gate_c = map(np.ascontiguousarray, np.split(gates, 3, axis=1))
        state_r, state_z, state_c = map(np.ascontiguousarray, np.split(self.w[f"state_{d}"], 3, axis=1))
        h = np.zeros((n, HIDDEN), np.float32)
        out = np.empty((steps, n, HIDDEN), np.float32)
        full = mask.all(axis=1)
        for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
            r = _sigmoid(gate_r.take(index[t], axis=0) + h @ state_r)
            z = _sigmoid(gate_z.take(index[t], axis=0) + h @ state_z)
            s = h @ state_c
            c = r * s
            c += gate_c.take(index[t], axis=0)
            np.tanh(c, out=c)
            new = h - c
            new *= z
            new += c
            if keep is not None:
                keep.append((t, h, r, z, c, s))
            h = new if full[t] else np.where(mask[t][:, None], new, h)
            out[t] = h
        return out

    def _pool(self, states: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, ...]:
        u = np.tanh(states @ self.w["attend"] + self.w["attend_bias"])
        e = np.where(mask, u @ self.w["query"], -np.inf)
        e = np.exp(e - e.max(axis=0))
        alpha = e / e.sum(axis=0)
        pooled = np.einsum("tn,tnh->nh", alpha, states)
        return u, alpha, pooled, pooled @ self.w["out"] + self.w["out_bias"][0]

    @staticmethod
    def _index(inputs: WordInputs, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        t = np.arange(int(size.max()))[:, None]
        mask = t < size
        none = len(inputs.ids)
        words = np.append(inputs.words, none)
        return np.where(mask, words[np.minimum(start + t, len(words) - 1)], none), mask

    def score(self, inputs: WordInputs, vectors: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Logit of every window."""
        gates = self.gates(vectors)
        out = np.empty(len(start), np.float32)
        order = np.argsort(size, kind="stable")
        for lo in range(0, len(start), LIMIT):
            some = order[lo : lo + LIMIT]
            index, mask = self._index(inputs, start[some], size[some])
            states = np.concatenate([self._run(gates[d], index, mask, d, None) for d in "fb"], axis=2)
            out[some] = self._pool(states, mask)[3]
        return out

    def gradients(
        self, inputs: WordInputs, vectors: np.ndarray, start: np.ndarray, size: np.ndarray, label: np.ndarray
    ) -> dict[str, np.ndarray]:
        """Gradient of the mean log loss over these windows for every weight."""
        w = self.w
        gates = self.gates(vectors)
        index, mask = self._index(inputs, start, size)
        kept: dict[str, list] = {"f": [], "b": []}
        states = np.concatenate([self._run(gates[d], index, mask, d, kept[d]) for d in "fb"], axis=2)
        u, alpha, pooled, logit = self._pool(states, mask)
        d_logit = ((_sigmoid(logit) - label) / len(label)).astype(np.float32)
        grad = {"out": d_logit @ pooled, "out_bias": d_logit.sum(keepdims=True)}
        d_pooled = d_logit[:, None] * w["out"]
        d_states = alpha[:, :, None] * d_pooled
        d_alpha = np.einsum("tnh,nh->tn", states, d_pooled)
        d_e = alpha * (d_alpha - (alpha * d_alpha).sum(axis=0))
        grad["query"] = np.einsum("tn,tnk->k", d_e, u)
        d_u = d_e[:, :, None] * w["query"] * (1 - u * u)
        grad["attend"] = np.einsum("tnh,tnk->hk", states, d_u)
        grad["attend_bias"] = d_u.sum(axis=(0, 1))
        d_states += d_u @ w["attend"].T
        d_input = np.zeros((len(inputs.ids) + 1, WIDTH), np.float32)
        for d, part in (("f", slice(0, HIDDEN)), ("b", slice(HIDDEN, None))):
            state = w[f"state_{d}"]
            d_state, carry = np.zeros_like(state), np.zeros((len(label), HIDDEN), np.float32)
            slopes = np.empty((*index.shape, 3 * HIDDEN), gates[d].dtype)
            for t, h, r, z, c, s in reversed(kept[d]):
                there = mask[t][:, None]
                total = carry + d_states[t][:, part]
                d_new = np.where(there, total, 0)
                d_c = d_new * (1 - z) * (1 - c * c)
                d_z = d_new * (h - c) * z * (1 - z)
                d_r = d_c * s * r * (1 - r)
                d_s = np.concatenate((d_r, d_z, d_c * r), axis=1)
                slopes[t] = np.concatenate((d_r, d_z, d_c), axis=1)
                d_state += h.T @ d_s
                carry = np.where(there, d_new * z, total) + d_s @ state.T
            d_gates = _scatter(index.ravel(), slopes.reshape(-1, 3 * HIDDEN), len(gates[d]))
            d_gates[-1] = 0
            grad[f"state_{d}"], grad[f"bias_{d}"] = d_state, d_gates.sum(axis=0)
            grad[f"in_{d}"] = vectors.T @ d_gates
            d_input += d_gates @ w[f"in_{d}"].T
        d_input = d_input[:-1]
        shares = (d_input / np.maximum(inputs.sizes, 1)[:, None]).astype(d_input.dtype)
        grad["words"] = _scatter(inputs.ids, d_input, WORDS)
        grad["stems"] = _scatter(inputs.stems, d_input, WORDS)
        grad["grams"] = _scatter(inputs.grams, np.repeat(shares, inputs.sizes, axis=0), GRAMS)
        return grad


def train(texts: list[str], labels: np.ndarray) -> Network:
    """Fit a network to whole texts with one label each (Adam, worst window per text)."""
    net, rng = Network.fresh(), np.random.default_rng(SEED)
    first = {k: np.zeros_like(v) for k, v in net.w.items()}
    second = {k: np.zeros_like(v) for k, v in net.w.items()}
    step = 0
    while step < UPDATES:
        before = step
        order = rng.permutation(len(texts))
        for lo in range(0, len(order), BATCH):
            some = order[lo : lo + BATCH]
            column = pa.array([texts[i] for i in some])
            inputs = WordInputs(next(slices(column, 1 << 40)))
            start, size, owner = inputs.windows()
            if not len(start):
                continue
            vectors = net.vectors(inputs)
            rank = rng.random(len(start)) if step < WARM else net.score(inputs, vectors, start, size)
            best = np.lexsort((-rank, owner))
            head = np.ones(len(best), bool)
            head[1:] = owner[best][1:] != owner[best][:-1]
            if step < WARM:  # several random windows of each text
                place = np.arange(len(best)) - np.maximum.accumulate(np.where(head, np.arange(len(best)), 0))
                head = place < 4
            pick = best[head]
            grad = net.gradients(inputs, vectors, start[pick], size[pick], labels[some][owner[pick]].astype(np.float32))
            step += 1
            for k, g in grad.items():
                first[k] += 0.1 * (g - first[k])
                second[k] += 0.001 * (g * g - second[k])
                scale = RATE * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
                net.w[k] -= (scale * first[k] / (np.sqrt(second[k]) + 1e-8)).astype(np.float32)
        if step == before:  # no text has a word
            break
    return net


def learned(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> bytes | None:
    """Weights fitted in one task to at most ``per_class`` toxic and twice as many clean documents.

    Of rows that share a chosen doc_id the one whose text has the smallest hash is learned.
    """
    told = labels.where("doc_id is not null and toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    least = F.xxhash64("doc_id"), "doc_id"
    chosen = told.where("toxic = 1").orderBy(*least).limit(per_class)
    chosen = chosen.union(told.where("toxic = 0").orderBy(*least).limit(CLEAN_SHARE * per_class))
    text = F.col("text").cast("string")
    sample = (
        docs.select("doc_id", text.alias("text"))
        .join(F.broadcast(chosen), "doc_id")
        .groupBy("doc_id", "toxic")
        .agg(F.min_by("text", F.struct(F.xxhash64("text"), F.length("text"))).alias("text"))
        .select("doc_id", "text", "toxic")
        .repartition(1)
    )

    def fit(batches: Batches) -> Batches:
        rows = [r for batch in batches for r in batch.to_pylist()]
        rows.sort(key=lambda r: (r["doc_id"], r["text"] or ""))
        toxic = np.array([r["toxic"] for r in rows])
        if len(set(toxic.tolist())) == 2:
            model = train([r["text"] or "" for r in rows], toxic).to_bytes()
            yield pa.RecordBatch.from_pydict({"model": [model]}, schema=pa.schema([("model", pa.binary())]))

    rows = sample.mapInArrow(fit, "model binary").collect()
    return bytes(rows[0].model) if rows else None


def scored(docs: DataFrame, model: bytes | None, name: str = "score", keep_text: bool = False) -> DataFrame:
    """``docs`` and the score of every row, with or without the text."""
    dropped = {name} if keep_text else {name, "text"}
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Batches) -> Batches:
        net = Network.from_bytes(shared.value) if shared.value else None
        for batch in batches:
            out = [np.zeros(0)]
            for texts in slices(batch.column("text")):
                worst = np.full(len(texts), -np.inf)
                inputs = WordInputs(texts)
                start, size, owner = inputs.windows()
                if net is not None and len(start):
                    np.maximum.at(worst, owner, net.score(inputs, net.vectors(inputs), start, size))
                out.append(np.where(np.isfinite(worst), _sigmoid(np.maximum(worst, -700)), 0.0))
            kept = [i for i, column in enumerate(batch.schema.names) if column not in dropped]
            yield pa.RecordBatch.from_arrays(
                [batch.column(i) for i in kept] + [pa.array(np.concatenate(out))],
                names=[batch.schema.names[i] for i in kept] + [name],
            )

    docs = docs.withColumn("text", F.col("text").cast("string"))
    return docs.mapInArrow(score, docs.drop(*dropped).withColumn(name, F.lit(None).cast("double")).schema)


def held_out() -> Column:
    """Rows whose labels are never learned: crc32 of the doc_id as text leaves 1 modulo 3."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document by a network learned from the labels outside the hold-out."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    model = learned(docs, labels.where(~held_out()))
    return scored(docs, model).select(
        "doc_id", held_out().alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted")
    )
