"""Shapley attribution of predictions against a bounded set of background rows."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.boosting import matrix
from tidemark.operators.regression import FEATURES, PREDICTION

BACKGROUND_ROWS = 100


def background(df: DataFrame, key: str, columns: Sequence[str], size: int = BACKGROUND_ROWS, seed: int = 42) -> DataFrame:
    """At most ``size`` rows, chosen by hashed key."""
    return (
        df.select(key, *columns)
        .orderBy(F.xxhash64(F.col(key), F.lit(seed)), key)
        .limit(size)
        .select(*columns)
    )


def linear_attribution(
    df: DataFrame,
    key: str,
    columns: Sequence[str],
    coefficients: Sequence[float],
    reference: DataFrame,
) -> DataFrame:
    """Exact values of a linear model: coefficient times distance from the background mean."""
    means = reference.agg(F.struct(*[F.avg(c).alias(c) for c in columns]).alias("m")).scalar()
    parts = F.array(
        *[
            F.struct(
                F.lit(c).alias("feature"),
                (F.lit(float(b)) * (F.col(c) - F.col("_m").getField(c))).alias("phi"),
            )
            for c, b in zip(columns, coefficients)
        ]
    )
    return df.withColumn("_m", means).select(key, F.inline(parts))


def permutation_attribution(
    df: DataFrame,
    key: str,
    columns: Sequence[str],
    model,
    reference: DataFrame,
    permutations: int = 4,
    seed: int = 42,
) -> DataFrame:
    """Sampled values of any model with ``transform``: the average change of the prediction when a
    feature switches from a background row to the explained row along random feature orders.

    Every order is used with its reverse and with every row of ``reference`` (bound it with
    :func:`background`), so for each row the
    values add up to its prediction minus the mean background prediction. A row becomes
    ``background x orders x (features + 1)`` scored rows inside its own task; only per-feature sums
    are shuffled.
    """
    d = len(columns)
    rng = np.random.default_rng(seed)
    orders = []
    for _ in range(max(1, permutations // 2)):
        order = rng.permutation(d)
        orders += [order, order[::-1]]
    rank_lists = [np.argsort(order).tolist() for order in orders]
    ranks = F.array(*[F.array(*[F.lit(int(r)) for r in row]) for row in rank_lists])
    pool = (
        reference
        .agg(F.collect_list(F.array(*[F.col(c).cast("double") for c in columns])).alias("b"))
        .scalar()
    )
    x = F.array(*[F.col(c).cast("double") for c in columns])
    mixed = F.transform(
        F.col("_x"),
        lambda v, j: F.when(F.get("_rank", j) < F.col("_step"), v).otherwise(F.get("_b", j)),
    )
    walks = (
        df.select(key, x.alias("_x"))
        .withColumn("_pool", pool)
        .select(key, "_x", F.size("_pool").alias("_nb"), F.explode("_pool").alias("_b"))
        .withColumn("_rank", F.explode(ranks))
        .withColumn("_step", F.explode(F.sequence(F.lit(0), F.lit(d))))
        .withColumn(FEATURES, array_to_vector(mixed))
    )
    scored = model.transform(walks).select(key, "_nb", "_rank", "_step", PREDICTION)
    weight = 1.0 / len(rank_lists)
    effects = scored.select(
        key,
        F.inline(
            F.array(
                F.struct(
                    F.array_position("_rank", F.col("_step") - 1).alias("pos"),
                    (F.col(PREDICTION) * weight / F.col("_nb")).alias("v"),
                ),
                F.struct(
                    F.array_position("_rank", F.col("_step")).alias("pos"),
                    (-F.col(PREDICTION) * weight / F.col("_nb")).alias("v"),
                ),
            )
        ),
    ).where(F.col("pos") > 0)
    names = F.array(*[F.lit(c) for c in columns])
    return (
        effects.groupBy(key, "pos")
        .agg(F.sum("v").alias("phi"))
        .select(key, F.get(names, F.col("pos").cast("int") - 1).alias("feature"), "phi")
    )


def _shares(features: int) -> np.ndarray:
    """Shapley values of one leaf of value 1 for every pair of patterns: which of the path's features
    the explained row satisfies, and which the background row (bit k for the k-th feature).

    A feature only the explained row satisfies must be switched, one only the background row satisfies
    must not be; with a and b such features the first gain (a-1)! b! / (a+b)!, the others lose
    a! (b-1)! / (a+b)!. A feature that neither satisfies keeps the leaf out of reach.
    """
    size = 1 << features
    out = np.zeros((size, size, features))
    for x in range(size):
        for y in range(size):
            if x | y != size - 1:
                continue
            a, b = (x & ~y).bit_count(), (y & ~x).bit_count()
            for k in range(features):
                if x >> k & 1 and not y >> k & 1:
                    out[x, y, k] = factorial(a - 1) * factorial(b) / factorial(a + b)
                elif y >> k & 1 and not x >> k & 1:
                    out[x, y, k] = -factorial(a) * factorial(b - 1) / factorial(a + b)
    return out


class LeafPaths:
    """Interventional Shapley values of a forest: for every leaf the intervals of its path and, for each
    pattern of satisfied intervals, its share per feature averaged over the background rows."""

    def __init__(self, forest, background_rows: np.ndarray) -> None:
        self.features = background_rows.shape[1]
        shares = {n: _shares(n) for n in {len(path) for _, path in forest.leaves()}}
        self.leaves = []
        for value, path in forest.leaves():
            if not path:
                continue
            names = np.array(list(path))
            low, high = (np.array([path[f][k] for f in names]) for k in (0, 1))
            seen = np.bincount(self._pattern(background_rows, names, low, high), minlength=1 << len(names)) / len(background_rows)
            self.leaves.append((names, low, high, value * np.tensordot(shares[len(names)], seen, axes=([1], [0]))))

    @staticmethod
    def _pattern(rows: np.ndarray, names: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        x = rows[:, names]
        return (((x > low) & (x <= high) | np.isneginf(x) & np.isneginf(low)) * (1 << np.arange(len(names)))).sum(axis=1)

    def values(self, rows: np.ndarray) -> np.ndarray:
        out = np.zeros((len(rows), self.features))
        for names, low, high, table in self.leaves:
            out[:, names] += table[self._pattern(rows, names, low, high)]
        return out


def tree_attribution(df: DataFrame, key: str, columns: Sequence[str], forest, reference: DataFrame) -> DataFrame:
    """Exact values of a forest: the mean over the rows of ``reference`` (bound it with
    :func:`background`) of the Shapley values of the game that switches features from that row to the
    explained one. They add up to the prediction minus the mean background prediction.

    The leaves meet the background once on the driver; a row is explained by one look-up per leaf.
    """
    pool = np.array(
        [[-np.inf if v is None else float(v) for v in r] for r in reference.select(*columns).collect()], float
    ).reshape(-1, len(columns))
    if not len(pool):
        raise ValueError("no background rows")
    shared = df.sparkSession.sparkContext.broadcast(LeafPaths(forest, pool))
    names = list(columns)

    def explain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            phi = shared.value.values(matrix(batch, names))
            yield pa.RecordBatch.from_arrays(
                [batch.column(key), pa.FixedSizeListArray.from_arrays(pa.array(phi.ravel()), len(names)).cast(pa.list_(pa.float64()))],
                names=[key, "_phi"],
            )

    rows = df.select(key, *names)
    told = rows.mapInArrow(explain, rows.select(key, F.lit(None).cast("array<double>").alias("_phi")).schema)
    labels = F.array(*[F.lit(c) for c in names])
    return told.select(key, F.posexplode("_phi").alias("_i", "phi")).select(key, F.get(labels, F.col("_i")).alias("feature"), "phi")


def importance(attribution: DataFrame) -> DataFrame:
    """Mean absolute value per feature, ranked."""
    return (
        attribution.groupBy("feature")
        .agg(F.avg(F.abs("phi")).alias("importance"))
        .orderBy(F.desc("importance"), "feature")
    )
