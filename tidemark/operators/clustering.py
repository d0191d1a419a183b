"""Scaling and k-means."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.columns import rule_label
from tidemark.operators.order import with_keys
from tidemark.operators.quantiles import exact_medians
from tidemark.runtime import cut_lineage, discard


def z_scores(df: DataFrame, columns: Sequence[str], suffix: str = "") -> DataFrame:
    """Subtract the mean and divide by the population deviation (1 for a constant column).

    The feature table is written once, because the summary and the scaling both read it.
    """
    df = cut_lineage(df)
    summary = df.agg(
        F.struct(
            *[F.avg(c).alias(f"m_{c}") for c in columns],
            *[F.stddev_pop(c).alias(f"s_{c}") for c in columns],
        ).alias("s")
    ).scalar()
    scaled = {}
    for c in columns:
        deviation = summary.getField(f"s_{c}")
        scaled[f"{c}{suffix}"] = (F.col(c) - summary.getField(f"m_{c}")) / F.when(
            deviation == 0, 1.0
        ).otherwise(deviation)
    return df.withColumns(scaled)


def _nearest(x: np.ndarray, centres: np.ndarray, squares: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Number of the nearest centre of each row and the squared distance to it; ``squares`` are the rows' own."""
    squares = (x * x).sum(1) if squares is None else squares
    apart = np.maximum(squares[:, None] - 2 * x @ centres.T + (centres * centres).sum(1), 0)
    at = apart.argmin(axis=1)
    return at, apart[np.arange(len(x)), at]


def _uniform(key: np.ndarray, restart: int, turn: int) -> np.ndarray:
    """A number in [0, 1) for each row hash, restart and turn."""
    x = (key ^ np.uint64(restart * 1_000_003 + turn + 1)) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return ((x ^ (x >> np.uint64(32))) >> np.uint64(11)).astype(np.float64) / 2.0**53


def _matrix_of(columns: Sequence[str]) -> Callable[[pa.RecordBatch], np.ndarray]:
    return lambda batch: np.column_stack([np.asarray(batch.column(c).cast(pa.float64())) for c in columns])


class _Restarts:
    """Centre sets of all restarts over one written table; every method is one aggregation for all.

    The table is written once more as blocks of numbers, which every step reads without taking rows apart.
    """

    def __init__(self, rows: DataFrame, columns: Sequence[str]) -> None:
        self.columns, matrix = list(columns), _matrix_of(columns)

        def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                values = matrix(batch).tobytes(), np.asarray(batch.column("_h")).tobytes()
                yield pa.RecordBatch.from_arrays([pa.array([v], pa.binary()) for v in values], names=["x", "h"])

        self.blocks = cut_lineage(rows.select("_h", *columns).mapInArrow(pack, "x binary, h binary"))

    def _unpacked(self) -> Callable[[pa.RecordBatch], Iterator[tuple[np.ndarray, np.ndarray]]]:
        d = len(self.columns)

        def unpack(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
            for x, h in zip(batch.column("x"), batch.column("h")):
                yield np.frombuffer(x.as_buffer(), np.float64).reshape(-1, d), np.frombuffer(h.as_buffer(), np.uint64)

        return unpack

    def sums(self, sets: dict[int, np.ndarray]) -> dict[int, tuple[np.ndarray, np.ndarray, float]]:
        """Per restart: rows and sums of every cluster, and the cost."""
        d, unpack = len(self.columns), self._unpacked()
        schema = pa.schema([("r", pa.int32()), ("c", pa.int32())] + [(f"s{i}", pa.float64()) for i in range(d + 2)])

        def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held = {r: np.zeros((len(c), d + 2)) for r, c in sets.items()}
            for x, _ in (block for batch in batches for block in unpack(batch)):
                squares = (x * x).sum(1)
                for r, centres in sets.items():
                    at, apart = _nearest(x, centres, squares)
                    held[r][:, 0] += np.bincount(at, minlength=len(centres))
                    held[r][:, 1] += np.bincount(at, apart, minlength=len(centres))
                    held[r][:, 2:] += (at == np.arange(len(centres))[:, None]).astype(float) @ x
            for r, table in held.items():
                arrays = [pa.array(np.full(len(table), r, np.int32)), pa.array(np.arange(len(table), dtype=np.int32))]
                yield pa.RecordBatch.from_arrays(arrays + [pa.array(table[:, i].copy()) for i in range(d + 2)], schema=schema)

        shape = "r int, c int, " + ", ".join(f"s{i} double" for i in range(d + 2))
        total = self.blocks.mapInArrow(emit, shape).groupBy("r", "c").agg(*[F.sum(f"s{i}").alias(f"s{i}") for i in range(d + 2)])
        out = {r: (np.zeros(len(c)), np.zeros((len(c), d)), 0.0) for r, c in sets.items()}
        for row in total.collect():
            count, table, cost = out[row["r"]]
            count[row["c"]] = row["s0"]
            table[row["c"]] = [row[f"s{i}"] for i in range(2, d + 2)]
            out[row["r"]] = (count, table, cost + row["s1"])
        return out

    def candidates(self, sets: dict[int, np.ndarray], costs: dict[int, float], wanted: float, turn: int) -> dict[int, np.ndarray]:
        """Rows drawn with a chance in proportion to their squared distance, about ``wanted`` per restart."""
        d, unpack = len(self.columns), self._unpacked()

        def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for x, key in (block for batch in batches for block in unpack(batch)):
                squares = (x * x).sum(1)
                for r, centres in sets.items():
                    drawn = np.flatnonzero(_uniform(key, r, turn) * costs[r] < wanted * _nearest(x, centres, squares)[1])
                    lists = pa.FixedSizeListArray.from_arrays(pa.array(x[drawn].ravel()), d).cast(pa.list_(pa.float64()))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(drawn), r, np.int32)), lists], names=["r", "x"])

        out = {r: [c] for r, c in sets.items()}
        for row in self.blocks.mapInArrow(emit, "r int, x array<double>").distinct().orderBy("r", "x").collect():
            out[row["r"]].append(np.array([row["x"]]))
        return {r: np.concatenate(parts) for r, parts in out.items()}


def _chosen(points: np.ndarray, weights: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """``k`` of some weighted points, each drawn by its weight times its squared distance to those before."""
    centres = points[rng.choice(len(points), p=weights / weights.sum())][None]
    while len(centres) < min(k, len(points)):
        chance = weights * _nearest(points, centres)[1]
        if chance.sum() <= 0:
            break
        centres = np.vstack((centres, points[rng.choice(len(points), p=chance / chance.sum())]))
    return centres


def kmeans(
    df: DataFrame,
    columns: Sequence[str],
    k: int = 4,
    restarts: int = 20,
    seed: int = 42,
    max_iter: int = 300,
    prediction: str = "cluster",
    tol: float = 1e-4,
    turns: int = 5,
) -> tuple[DataFrame, float]:
    """Assign clusters from the restart with the lowest cost; rows with nulls are dropped first.

    All restarts advance together, one aggregation per step; one that no longer moves is left out.
    Starts are drawn in ``turns`` of about ``2 k`` rows by their distance to those drawn before, and
    ``k`` of them by how many rows they stand for. Only centres and drawn rows reach the driver.
    """
    d = len(columns)
    rows = cut_lineage(df.na.drop(subset=list(columns)).withColumn("_h", F.xxhash64(*columns)))
    shape = rows.drop("_h").withColumn(prediction, F.lit(None).cast("int")).schema
    firsts = rows.select(*[F.min_by(F.array(*[F.col(c).cast("double") for c in columns]), F.xxhash64("_h", F.lit(seed + r))).alias(f"p{r}") for r in range(restarts)]).first()
    if firsts["p0"] is None:
        return df.sparkSession.createDataFrame([], shape), 0.0
    work = _Restarts(rows, columns)
    sets = {r: np.array(firsts[f"p{r}"], float).reshape(1, d) for r in range(restarts)}
    for turn in range(turns):
        costs = {r: c for r, (_, _, c) in work.sums(sets).items() if c > 0}
        if not costs:
            break
        sets = sets | work.candidates({r: sets[r] for r in costs}, costs, 2.0 * k, seed + turn)
    stands = work.sums(sets)
    sets = {r: _chosen(c, stands[r][0], k, np.random.default_rng([seed, r])) for r, c in sets.items()}
    active = dict(sets)
    for _ in range(max_iter):
        moved = {}
        for r, (count, table, _) in work.sums(active).items():
            fresh = np.where(count[:, None] > 0, table / np.maximum(count, 1)[:, None], active[r])
            if ((fresh - active[r]) ** 2).sum(axis=1).max() > tol * tol:
                moved[r] = fresh
            sets[r] = fresh
        active = moved
        if not active:
            break
    costs = {r: c for r, (_, _, c) in work.sums(sets).items()}
    discard(work.blocks)
    best = min(costs, key=lambda r: (costs[r], r))
    centres, matrix = df.sparkSession.sparkContext.broadcast(sets[best]), _matrix_of(list(columns))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, _ = _nearest(matrix(batch), centres.value)
            kept = [c for c in batch.schema.names if c not in ("_h", prediction)]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in kept] + [pa.array(at.astype(np.int32))], names=[*kept, prediction])

    return rows.mapInArrow(assign, shape), costs[best]


def cluster_profile(
    df: DataFrame, cluster: str, ratio: str, columns: Sequence[str]
) -> DataFrame:
    """Size, column medians and the rule name of each cluster."""
    df = cut_lineage(df.select(cluster, *columns))
    medians = exact_medians(df, [cluster], {f"median_{c}": F.col(c) for c in columns})
    middle = F.col(f"median_{ratio}")
    name = rule_label(
        [
            (middle >= 1.2, "residential"),
            (middle <= 0.7, "commercial"),
            (middle.between(0.8, 1.2), "commuter"),
        ],
        "mixed",
    )
    return (
        with_keys(df.groupBy(cluster).agg(F.count("*").alias("n")), medians, [cluster], "left")
        .withColumn("cluster_name", F.concat(name, F.lit(" (C"), F.col(cluster), F.lit(")")))
    )
