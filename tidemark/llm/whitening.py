"""Whitening of embeddings by the leading components of their covariance.

Entries become whole numbers, so sums per dimension and deviations from the mean are exact. Three
passes, each a sum over partitions: sums per dimension; the covariance of vectors centred before they
are multiplied; the covariance of the whitened vectors, which tells how good the result is. The
covariance (dimensions squared, whatever the number of rows) is solved on the driver: Householder
reflections make it tridiagonal, counts of negative pivots (Sturm) bracket the leading eigenvalues by
bisection, inverse iteration gives their vectors, made orthogonal within clusters of close eigenvalues,
and the reflections take them back. The projection is broadcast for the last pass.

Defined results: a row is left out if its vector is null, holds null or non-finite entries, holds an
entry too large for a whole number (1024 times it reaches 2**52), or has not the most common length
(the longer of equally common ones); rows are never merged, so repeated rows count and are returned
repeatedly, also without a vec_id; only components of a positive eigenvalue (beyond rounding: 1e-13
of the trace) are returned, so fewer than asked if the vectors span less, and none if all are equal;
a deviation beyond 2**63 - 1 is null; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.exchange import Batches

COMPONENTS, SCALE, SHIFT = 8, 1024.0, 100_000
ROWS = 4096  # vectors handled at once
_LARGE = 2.0**52


def vectors(batch: pa.RecordBatch, dims: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows of ``batch`` (in parts) that have a usable vector of ``dims`` entries, and these as whole
    numbers."""
    column = batch.column("embedding")
    sizes = np.asarray(column.value_lengths().fill_null(-1))
    right = np.flatnonzero(sizes == dims)
    for lo in range(0, len(right), ROWS):
        some = right[lo : lo + ROWS]
        flat = column.take(pa.array(some)).flatten()
        entries = np.asarray(flat.cast(pa.float64()).fill_null(float("nan"))).reshape(-1, dims)
        scaled = np.floor(SCALE * entries)
        good = (np.isfinite(scaled) & (np.abs(scaled) < _LARGE)).all(axis=1)
        yield some[good], scaled[good].astype(np.int64) + SHIFT


def tridiagonal(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Diagonal, off-diagonal and Householder vectors of a symmetric matrix."""
    a, d = matrix.copy(), len(matrix)
    mirrors = []
    for k in range(d - 2):
        v = a[k + 1 :, k].copy()
        size = np.sqrt(v @ v)
        v[0] += np.copysign(size, v[0])
        norm = np.sqrt(v @ v)
        v = v / norm if norm > 0 else np.zeros(len(v))
        part = a[k + 1 :, k + 1 :]
        w = part @ v
        w -= (v @ w) * v
        part -= 2 * (np.outer(v, w) + np.outer(w, v))
        a[k + 1, k] -= 2 * v[0] * (v @ a[k + 1 :, k])
        mirrors.append(v)
    return np.diagonal(a).copy(), np.diagonal(a, -1).copy(), mirrors


def below(diagonal: np.ndarray, squares: np.ndarray, shifts: np.ndarray, least: float) -> np.ndarray:
    """How many eigenvalues of a tridiagonal matrix are below each shift: the negative pivots."""
    count = np.zeros(len(shifts), np.int64)
    pivot = np.ones(len(shifts))
    for i, a in enumerate(diagonal):
        pivot = a - shifts - (squares[i - 1] / pivot if i else 0.0)
        pivot = np.where(np.abs(pivot) < least, -least, pivot)
        count += pivot < 0
    return count


def leading(diagonal: np.ndarray, off: np.ndarray, k: int) -> np.ndarray:
    """The ``k`` largest eigenvalues, largest first, by bisection to the last bits."""
    d = len(diagonal)
    reach = np.abs(np.append(off, 0)) + np.abs(np.insert(off, 0, 0))
    scale = max(float((np.abs(diagonal) + reach).max()), np.finfo(float).tiny * 4)
    least = np.finfo(float).tiny + scale * np.finfo(float).eps ** 2
    low = np.full(k, (diagonal - reach).min() - scale * 1e-15)
    high = np.full(k, (diagonal + reach).max() + scale * 1e-15)
    rank = d - 1 - np.arange(k)  # as many eigenvalues are below the one sought
    for _ in range(128):
        middle = (low + high) / 2
        if ((middle <= low) | (middle >= high)).all():
            break
        under = below(diagonal, off * off, middle, least) > rank
        high, low = np.where(under, middle, high), np.where(under, low, middle)
    return (low + high) / 2


def _solve(diagonal: np.ndarray, off: np.ndarray, right: np.ndarray, least: float) -> np.ndarray:
    """Solution of a tridiagonal system, with row exchanges; tiny pivots are replaced."""
    d = len(diagonal)
    a, b, c = diagonal.copy(), np.append(off, 0.0), np.zeros(d)
    x = right.copy()
    low = np.append(off, 0.0)
    for i in range(d - 1):
        if abs(low[i]) > abs(a[i]):
            factor = a[i] / low[i]
            a[i], b[i], c[i], a[i + 1], b[i + 1] = low[i], a[i + 1], b[i + 1], b[i] - factor * a[i + 1], -factor * b[i + 1]
            x[i], x[i + 1] = x[i + 1], x[i] - factor * x[i + 1]
        else:
            a[i] = a[i] if abs(a[i]) > least else least
            factor = low[i] / a[i]
            a[i + 1] -= factor * b[i]
            x[i + 1] -= factor * x[i]
    for i in range(d - 1, -1, -1):
        pivot = a[i] if abs(a[i]) > least else least
        known = (b[i] * x[i + 1] if i + 1 < d else 0.0) + (c[i] * x[i + 2] if i + 2 < d else 0.0)
        x[i] = (x[i] - known) / pivot
    return x


def components(matrix: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` largest eigenvalues and, as columns, unit eigenvectors of a symmetric matrix."""
    d, unit = len(matrix), float(np.abs(matrix).max())
    if not unit:
        return np.zeros(k), np.eye(d)[:, :k]
    diagonal, off, mirrors = tridiagonal(matrix / unit)
    values = leading(diagonal, off, k)
    scale = max(float(np.abs(diagonal).max()), float(np.abs(off).max(initial=0)))
    least = scale * np.finfo(float).eps
    rng = np.random.default_rng(7)
    out = np.zeros((d, k))
    for j, value in enumerate(values):
        close = [i for i in range(j) if abs(values[i] - value) <= 1e-3 * scale]
        x = rng.standard_normal(d)
        for _ in range(6):
            for i in close * 2:
                x -= (out[:, i] @ x) * out[:, i]
            x = _solve(diagonal - value, off, x / np.sqrt(x @ x), least)
        for i in close * 2:
            x -= (out[:, i] @ x) * out[:, i]
        out[:, j] = x / np.sqrt(x @ x)
    for step in range(len(mirrors) - 1, -1, -1):
        v = mirrors[step]
        out[step + 1 :] -= 2 * np.outer(v, v @ out[step + 1 :])
    signs = np.sign(out[np.abs(out).argmax(axis=0), np.arange(k)])
    return values * unit, out * np.where(signs == 0, 1, signs)


def whitened(embeddings: DataFrame, k: int = COMPONENTS) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error for every usable row of
    ``embeddings`` (vec_id, embedding) and component."""
    schema = "vec_id bigint, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"
    rows = embeddings.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    none = embeddings.sparkSession.createDataFrame([], schema)

    usable = rows.where(F.col("embedding").isNotNull() & (F.size("embedding") > 0))
    lengths = usable.groupBy(F.size("embedding").alias("dims")).agg(F.count("*").alias("c"))
    common = lengths.orderBy(F.desc("c"), F.desc("dims")).first()
    if common is None:
        return none
    dims = common["dims"]

    def sums(batches: Batches) -> Batches:
        total, count = np.zeros(dims, np.int64), 0
        for batch in batches:
            for _, x in vectors(batch, dims):
                total += x.sum(axis=0)
                count += len(x)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(-1, dims, dtype=np.int32)), pa.array(np.insert(total, 0, count))], names=["i", "s"]
        )

    held = {r["i"]: int(r["s"]) for r in rows.mapInArrow(sums, "i int, s bigint").groupBy("i").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect()}
    n = held.get(-1, 0)
    if not n:
        return none
    exact = [held[i] for i in range(dims)]
    whole = np.array([s // n for s in exact], np.int64)
    part = np.array([s % n for s in exact], np.float64) / n  # the mean is whole + part

    def centred(x: np.ndarray) -> np.ndarray:
        return (x - whole) - part

    def products(blocks: Iterator[np.ndarray], size: int) -> Batches:
        total, upper = np.zeros((size, size)), np.triu_indices(size)
        for c in blocks:
            total += c.T @ c
        yield pa.RecordBatch.from_arrays(
            [pa.array(upper[0].astype(np.int32)), pa.array(upper[1].astype(np.int32)), pa.array(total[upper])], names=["i", "j", "s"]
        )

    def covariance(blocks_of, size: int) -> np.ndarray:
        """Summed products of all blocks over n, centred blocks in."""
        def emit(batches: Batches) -> Batches:
            return products((c for batch in batches for c in blocks_of(batch)), size)

        out = np.zeros((size, size))
        for r in rows.mapInArrow(emit, "i int, j int, s double").groupBy("i", "j").agg(F.sum("s").alias("s")).collect():
            out[r["i"], r["j"]] = out[r["j"], r["i"]] = r["s"] / n
        return out

    v = covariance(lambda batch: (centred(x) for _, x in vectors(batch, dims)), dims)
    trace = float(np.trace(v))
    values, axes = components(v, min(k, dims))
    keep = values > 1e-13 * trace
    values, axes = values[keep], axes[:, keep]
    if not len(values):
        return none
    projection = embeddings.sparkSession.sparkContext.broadcast(axes / np.sqrt(values))
    white = covariance(lambda batch: (centred(x) @ projection.value for _, x in vectors(batch, dims)), len(values))
    error = float(np.abs(white - np.eye(len(values))).max())

    def project(batches: Batches) -> Batches:
        for batch in batches:
            for at, x in vectors(batch, dims):
                apart = _deviations(x, whole, exact, n)
                m = len(values)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("vec_id").take(pa.array(np.repeat(at, m))),
                        pa.array(np.tile(np.arange(1, m + 1, dtype=np.int32), len(x))),
                        pa.array(np.full(len(x) * m, n)),
                        apart.take(pa.array(np.repeat(np.arange(len(x)), m))),
                        pa.array((centred(x) @ projection.value).ravel()),
                        pa.array(np.tile(values / trace, len(x))),
                        pa.array(np.full(len(x) * m, error)),
                    ],
                    names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    return rows.mapInArrow(project, schema)


def _deviations(x: np.ndarray, whole: np.ndarray, exact: list[int], n: int) -> pa.Array:
    """Sum over dimensions of (n x - S) squared; in whole numbers of any size where 64 bits might not do."""
    rest = np.array([s - int(w) * n for s, w in zip(exact, whole)], np.int64)
    near = (x - whole).astype(np.float64) * n
    if not ((near * near).sum(axis=1) > 2.0**61).any():
        apart = n * (x - whole) - rest
        return pa.array((apart * apart).sum(axis=1))
    apart = (x - whole).astype(object) * n - rest.astype(object)
    total = (apart * apart).sum(axis=1).tolist() if len(x) else []
    return pa.array([t if t < 1 << 63 else None for t in total], pa.int64())


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings projected on eight whitened components, with exact deviations from the mean."""
    return whitened(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
