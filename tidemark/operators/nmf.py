"""Non-negative matrix factorisation of a sparse document-term table.

Documents stay distributed, as written blocks of numbers that every iteration reads. One pass per
iteration solves each document's topic weights against the broadcast topic matrix H and sums the
small products W'V and W'W per topic; only those sums (``topics x terms`` numbers, fixed by
parameters) reach the driver, where H is updated. Document weights are recomputed from H, so no
lineage grows with the iterations.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.runtime import cut_lineage

_CHUNK_VALUES = 200_000
_SWEEPS = 20_000
_TOLERANCE = 1e-9


def _chunks(idx: list, w: list) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """Slices of a batch with a bounded number of stored values."""
    sizes = np.array([len(i) for i in idx])
    start = 0
    while start < len(sizes):
        end = start + max(1, int(np.searchsorted(np.cumsum(sizes[start:]), _CHUNK_VALUES, "right")))
        rows = np.repeat(np.arange(end - start), sizes[start:end])
        yield start, end, rows, np.concatenate(idx[start:end]), np.concatenate(w[start:end])
        start = end


def _project(rows, idx, w, count: int, h: np.ndarray) -> np.ndarray:
    """V H' for one chunk."""
    k = h.shape[0]
    return np.column_stack(
        [np.bincount(rows, weights=w * h[j, idx], minlength=count) for j in range(k)]
    )


def _solve(vh: np.ndarray, gram: np.ndarray) -> np.ndarray:
    """Non-negative least squares of every row by coordinate descent.

    A row is done when it meets the optimality conditions: the slope of a positive weight is zero,
    that of a zero weight not negative, up to ``_TOLERANCE`` of the row's largest product. Raises if
    a row does not get there.
    """
    weights, left = np.zeros_like(vh), np.arange(len(vh))
    scale = _TOLERANCE * np.maximum(np.abs(vh).max(axis=1, initial=0.0), 1e-300)
    live = [j for j in range(vh.shape[1]) if gram[j, j] > 0]
    for sweep in range(_SWEEPS):
        own, goal = weights[left], vh[left]
        for j in live:
            own[:, j] = np.maximum(0.0, own[:, j] + (goal[:, j] - own @ gram[:, j]) / gram[j, j])
        weights[left] = own
        if sweep % 5 == 4:
            slope = own @ gram - goal
            fault = np.where(own > 0, np.abs(slope), np.maximum(0.0, -slope)).max(axis=1, initial=0.0)
            left = left[fault > scale[left]]
            if not len(left):
                return weights
    raise ArithmeticError(f"{len(left)} rows did not reach the least-squares optimum")


@dataclass
class TopicModel:
    """Topic-term matrix with the terms of its columns and the error after each iteration."""

    terms: list[str]
    h: np.ndarray
    errors: list[float] = field(default_factory=list)

    @property
    def reconstruction_error(self) -> float:
        return self.errors[-1] if self.errors else float("nan")


def _blocks(docs: DataFrame) -> DataFrame:
    """The documents as rows of packed numbers: entries per document, their terms and weights."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            idx, w = batch.column("idx"), batch.column("w")
            size = np.asarray(idx.value_lengths()).astype(np.int32)
            terms, weights = np.asarray(idx.flatten()), np.asarray(w.flatten())
            ends = np.cumsum(size, dtype=np.int64)
            start = 0
            while start < len(size):
                before = int(ends[start - 1]) if start else 0
                end = max(start + 1, int(np.searchsorted(ends, before + _CHUNK_VALUES, "right")))
                mine = slice(before, int(ends[end - 1]))
                row = (size[start:end], terms[mine].astype(np.int32), weights[mine])
                yield pa.RecordBatch.from_arrays(
                    [pa.array([x.tobytes()], pa.binary()) for x in row], names=["size", "idx", "w"]
                )
                start = end

    return cut_lineage(docs.select("idx", "w").mapInArrow(pack, "size binary, idx binary, w binary"))


def _pass_sums(blocks: DataFrame, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """W'V, W'W and the squared error for the best W under ``h``."""
    k, m = h.shape
    shared = blocks.sparkSession.sparkContext.broadcast(h)

    def rows(sums: dict[int, np.ndarray]) -> pa.RecordBatch:
        values = [pa.array(list(sums), pa.int32()), pa.array([v.tobytes() for v in sums.values()], pa.binary())]
        return pa.RecordBatch.from_arrays(values, names=["topic", "v"])

    def accumulate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h_local = shared.value
        gram = h_local @ h_local.T
        wv, ww, error = np.zeros((k, m)), np.zeros((k, k)), 0.0
        for batch in batches:
            for packed in zip(*(batch.column(c) for c in ("size", "idx", "w"))):
                size, idx, w = (
                    np.frombuffer(x.as_buffer(), t) for x, t in zip(packed, (np.int32, np.int32, np.float64))
                )
                rows_of = np.repeat(np.arange(len(size)), size)
                vh = _project(rows_of, idx, w, len(size), h_local)
                weights = _solve(vh, gram)
                for j in range(k):
                    wv[j] += np.bincount(idx, weights=w * weights[rows_of, j], minlength=m)
                ww += weights.T @ weights
                error += float(
                    w @ w - 2 * np.sum(weights * vh) + np.sum((weights @ gram) * weights)
                )
        yield rows({j: np.concatenate((wv[j], ww[j], [error if j == 0 else 0.0])) for j in range(k)})

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for topic, v in zip(batch.column("topic").to_pylist(), batch.column("v")):
                part = np.frombuffer(v.as_buffer())
                sums[topic] = sums[topic] + part if topic in sums else part.copy()
        yield rows(sums)

    shape = "topic int, v binary"
    partial = blocks.mapInArrow(accumulate, shape)
    sums = partial.repartition("topic").mapInArrow(add, shape).toArrow()  # topics * (terms + topics + 1) numbers
    shared.unpersist()
    total = np.zeros((k, m + k + 1))
    for topic, v in zip(sums["topic"].to_pylist(), sums["v"].to_pylist()):
        total[topic] = np.frombuffer(v)
    return total[:, :m], total[:, m : m + k], max(float(total[0, -1]), 0.0)


def fit_topics(
    docs: DataFrame,
    terms: list[str],
    topics: int = 20,
    max_iter: int = 400,
    tolerance: float = 1e-4,
    seed: int = 42,
    inner_steps: int = 20,
) -> TopicModel:
    """Factorise ``docs`` (from :func:`tidemark.operators.tfidf.sparse_rows`), which should be a written or
    cached table.

    Stops when the error falls by less than ``tolerance`` of its first value.
    """
    stats = docs.agg(
        F.count("*").alias("n"), F.sum(F.aggregate("w", F.lit(0.0), lambda a, x: a + x)).alias("s")
    ).first()
    mean = (stats["s"] or 0.0) / max(1, stats["n"] * len(terms))
    h = np.sqrt(mean / topics) * np.abs(
        np.random.default_rng(seed).standard_normal((topics, len(terms)))
    )
    errors: list[float] = []
    blocks = _blocks(docs)
    for _ in range(max_iter):
        wv, ww, squared = _pass_sums(blocks, h)
        errors.append(float(np.sqrt(squared)))
        if len(errors) > 1 and errors[-2] - errors[-1] < tolerance * errors[0]:
            break
        for _ in range(inner_steps):
            h = h * wv / np.maximum(ww @ h, 1e-12)
    return TopicModel(list(terms), h, errors)


def document_topics(docs: DataFrame, key: str, model: TopicModel) -> DataFrame:
    """``(key, weights array<double>)`` of every document, partition-parallel."""
    shared = docs.sparkSession.sparkContext.broadcast(model.h)

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        h_local = shared.value
        gram = h_local @ h_local.T
        for batch in batches:
            parts = [
                _solve(_project(rows, idx, w, end - start, h_local), gram)
                for start, end, rows, idx, w in _chunks(list(batch["idx"]), list(batch["w"]))
            ]
            if parts:
                yield pd.DataFrame({key: batch[key], "weights": list(np.concatenate(parts))})

    schema = T.StructType(
        [docs.schema[key], T.StructField("weights", T.ArrayType(T.DoubleType()))]
    )
    return docs.mapInPandas(solve, schema)


def topic_terms(df_session, model: TopicModel, top_n: int | None = None) -> DataFrame:
    """``(topic, term, w)`` of the model: ``topics x terms`` rows, or the top ones per topic."""
    frames = []
    for topic, row in enumerate(model.h):
        order = np.argsort(-row, kind="stable")
        order = order if top_n is None else order[:top_n]
        frames.append(
            pd.DataFrame(
                {"topic": topic, "term": [model.terms[i] for i in order], "w": row[order]}
            )
        )
    return df_session.createDataFrame(
        pd.concat(frames, ignore_index=True), "topic int, term string, w double"
    )
