"""Boosted regression trees with leaf penalties and columns sampled per tree.

The objective is the second-order one of squared error: a leaf's weight is the soft-thresholded
gradient sum over the row count plus ``l2``, and a split gains what the children's scores exceed their
parent's by. Columns are binned once. Rows stay distributed as blocks of bins; a level of a tree is one
job in which every partition adds its gradients per (model, node, feature, bin), and the sums of a node
meet in one task, which searches its best split. Their size depends on the parameters only, and only
splits reach the driver. The models of all folds and the final one grow together, so that folds cost no
further jobs.

Rows are sampled per tree by a hash of their key, columns by a seeded choice, so the model does not
depend on how the rows are partitioned. A null feature counts as the lowest value.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.regression import PREDICTION, metrics
from tidemark.runtime import cut_lineage

Block = dict[str, np.ndarray]
REFRESH = 10  # trees after which the blocks take up their predictions
_ROWS = 65_536


@dataclass(frozen=True)
class Boosting:
    """Parameters of the learner."""

    trees: int = 200
    depth: int = 5
    rate: float = 0.05
    rows: float = 0.8
    columns: float = 0.8
    l1: float = 1.0
    l2: float = 2.0
    child: float = 1.0  # least rows of a child
    bins: int = 256
    seed: int = 42


@dataclass
class Tree:
    """A tree as arrays; node 0 is the root, ``left`` is -1 at a leaf, rows up to the cut go left."""

    feature: list[int] = field(default_factory=lambda: [-1])
    cut: list[float] = field(default_factory=lambda: [0.0])
    left: list[int] = field(default_factory=lambda: [-1])
    right: list[int] = field(default_factory=lambda: [-1])
    value: list[float] = field(default_factory=lambda: [0.0])

    def split(self, node: int, feature: int, cut: float) -> tuple[int, int]:
        a = len(self.feature)
        self.feature[node], self.cut[node], self.left[node], self.right[node] = feature, cut, a, a + 1
        for _ in range(2):
            for column, empty in ((self.feature, -1), (self.cut, 0.0), (self.left, -1), (self.right, -1), (self.value, 0.0)):
                column.append(empty)
        return a, a + 1

    def nodes(self, x: np.ndarray) -> np.ndarray:
        """The node each row of ``x`` (rows x features) comes to."""
        feature, cut, left, right = (np.array(c) for c in (self.feature, self.cut, self.left, self.right))
        at = np.zeros(len(x), np.int64)
        while True:
            go = np.flatnonzero(left[at] >= 0)
            if not len(go):
                return at
            here = at[go]
            at[go] = np.where(x[go, feature[here]] <= cut[here], left[here], right[here])

    def predict(self, x: np.ndarray) -> np.ndarray:
        return np.array(self.value)[self.nodes(x)]


@dataclass
class Forest:
    """A base value and trees whose cuts are feature values."""

    base: float
    trees: list[Tree]

    def predict(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        for tree in self.trees:
            out += tree.predict(x)
        return out

    def transform(self, df: DataFrame, columns: Sequence[str], prediction: str = PREDICTION) -> DataFrame:
        """``df`` with its predictions; the forest is sent to every task once."""
        shared = df.sparkSession.sparkContext.broadcast(self)

        def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x = matrix(batch, columns)
                values = [*batch.columns, pa.array(shared.value.predict(x))]
                yield pa.RecordBatch.from_arrays(values, names=[*batch.schema.names, prediction])

        kept = df.drop(prediction)
        return kept.mapInArrow(score, kept.withColumn(prediction, F.lit(None).cast("double")).schema)

    def leaves(self) -> list[tuple[float, dict[int, tuple[float, float]]]]:
        """Value of every leaf, and per feature of its path the interval (low, high] it needs."""
        out = []
        for tree in self.trees:
            stack: list[tuple[int, dict[int, tuple[float, float]]]] = [(0, {})]
            while stack:
                node, path = stack.pop()
                if tree.left[node] < 0:
                    out.append((tree.value[node], path))
                    continue
                f, cut = tree.feature[node], tree.cut[node]
                low, high = path.get(f, (-np.inf, np.inf))
                stack.append((tree.right[node], path | {f: (max(low, cut), high)}))
                stack.append((tree.left[node], path | {f: (low, min(high, cut))}))
        return out


def matrix(batch: pa.RecordBatch, columns: Sequence[str]) -> np.ndarray:
    """Columns of a batch as a matrix; null is minus infinity."""
    parts = [np.asarray(batch.column(c).cast(pa.float64()).fill_null(-np.inf)) for c in columns]
    return np.column_stack(parts) if parts else np.zeros((batch.num_rows, 0))


def cut_points(df: DataFrame, columns: Sequence[str], bins: int) -> list[np.ndarray]:
    """At most ``bins - 1`` cuts per column: middles of neighbouring values at even ranks, of all
    values where there are few."""
    steps = [i / bins for i in range(bins + 1)]
    edges = df.agg(*[F.percentile_approx(F.col(c).cast("double"), steps, 10_000).alias(f"q{i}") for i, c in enumerate(columns)]).first()
    out = []
    for i in range(len(columns)):
        values = np.unique(np.array([v for v in edges[f"q{i}"] or [] if v is not None and np.isfinite(v)], float))
        out.append((values[1:] + values[:-1]) / 2)
    return out


def score(g: np.ndarray, n: np.ndarray, p: Boosting) -> np.ndarray:
    return np.maximum(np.abs(g) - p.l1, 0) ** 2 / (n + p.l2)


def weight(g: np.ndarray, n: np.ndarray, p: Boosting) -> np.ndarray:
    return -p.rate * np.sign(g) * np.maximum(np.abs(g) - p.l1, 0) / (n + p.l2)


def best_split(g: np.ndarray, n: np.ndarray, allowed: np.ndarray, p: Boosting) -> tuple[int, int] | None:
    """Feature and last bin on the left of the best split of a node, from its sums per (feature, bin);
    the first of equal ones. None if no split gains."""
    left_g, left_n = np.cumsum(g, axis=1)[:, :-1], np.cumsum(n, axis=1)[:, :-1]
    all_g, all_n = g.sum(axis=1, keepdims=True), n.sum(axis=1, keepdims=True)
    gain = score(left_g, left_n, p) + score(all_g - left_g, all_n - left_n, p) - score(all_g, all_n, p)
    gain[(left_n < p.child) | (all_n - left_n < p.child) | ~allowed[:, None]] = -np.inf
    if not gain.size:
        return None
    at = int(np.argmax(np.round(gain, 10)))
    f, b = divmod(at, gain.shape[1])
    return (f, b) if gain[f, b] > 1e-10 else None


def sampled(key: np.ndarray, tree: int, p: Boosting) -> np.ndarray:
    """Which rows (by 64-bit hash) a tree sees."""
    x = (key ^ np.uint64((tree + 1) * 0x9E3779B97F4A7C15 + p.seed & (1 << 64) - 1)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
    return (x >> np.uint64(11)).astype(np.float64) / 2.0**53 < p.rows


def sampled_columns(tree: int, count: int, p: Boosting) -> np.ndarray:
    """Which columns a tree may split on."""
    out = np.zeros(count, bool)
    rng = np.random.default_rng([p.seed, tree])
    out[rng.permutation(count)[: max(1, int(round(p.columns * count)))]] = True
    return out


def level_sums(block: Block, trees: Sequence[Tree], active: Sequence[Sequence[int]], bins: int, tree: int, p: Boosting) -> np.ndarray:
    """Gradient and row sums of one block: 2 x (active nodes of all models) x features x bins."""
    x = block["bins"]
    rows, features = x.shape
    out = np.zeros((2, sum(map(len, active)), features, bins))
    seen = sampled(block["key"], tree, p)
    first = 0
    for m, nodes in enumerate(active):
        if len(nodes):
            slot = np.full(len(trees[m].feature), -1)
            slot[list(nodes)] = np.arange(len(nodes))
            place = slot[trees[m].nodes(x)]
            use = np.flatnonzero((place >= 0) & seen & block["uses"][:, m])
            gradient = block["made"][use, m] - block["y"][use]
            for f in range(features):
                cell = place[use] * bins + x[use, f]
                for k, w in enumerate((gradient, None)):
                    sums = np.bincount(cell, w, minlength=len(nodes) * bins)
                    out[k, first : first + len(nodes), f] = sums.reshape(len(nodes), bins)
        first += len(nodes)
    return out


def partition_sums(
    blocks: Iterator[Block], trees: Sequence[Tree], active: Sequence[Sequence[int]], bins: int, tree: int, p: Boosting
) -> Iterator[tuple[int, np.ndarray]]:
    """Number of each active node, over all models, and its sums 2 x features x bins in one partition."""
    total = None
    for block in blocks:
        sums = level_sums(block, trees, active, bins, tree, p)
        total = sums if total is None else total + sums
    if total is not None:
        yield from ((at, total[:, at].copy()) for at in range(total.shape[1]))


def node_split(sums: np.ndarray, allowed: np.ndarray, p: Boosting) -> tuple[tuple, tuple[int, int] | None, tuple | None]:
    """Gradient and row sums of a node, its best split and the sums to the left of that."""
    g, n = sums
    split = best_split(g, n, allowed, p)
    part = None
    if split:
        f, b = split
        part = g[f, : b + 1].sum(), n[f, : b + 1].sum()
    return (g[0].sum(), n[0].sum()), split, part


def fit(
    df: DataFrame, key: str, label: str, columns: Sequence[str], uses: Sequence[str], params: Boosting = Boosting()
) -> list[Forest]:
    """One forest per boolean column of ``uses``, each learned from the rows where it is true.

    ``df`` should be a written table: it is read twice.
    """
    p, columns, uses = params, list(columns), list(uses)
    df = df.where(F.col(label).isNotNull())
    cuts = cut_points(df, columns, p.bins)
    width = max((len(c) for c in cuts), default=0) + 1
    bases = [r or 0.0 for r in df.agg(*[F.avg(F.when(F.col(u), F.col(label).cast("double"))).alias(f"b{i}") for i, u in enumerate(uses)]).first()]
    wanted = df.select(F.xxhash64(key).alias("_key"), F.col(label).cast("double").alias("_y"), *[F.col(c).cast("double").alias(f"_x{i}") for i, c in enumerate(columns)],
                       *[F.coalesce(F.col(u), F.lit(False)).alias(f"_u{i}") for i, u in enumerate(uses)])
    names = [f"_x{i}" for i in range(len(columns))]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, _ROWS):
                part = batch.slice(lo, _ROWS)
                x = matrix(part, names)
                binned = np.column_stack([np.searchsorted(c, x[:, i], side="left") for i, c in enumerate(cuts)]).astype(np.int16)
                use = np.column_stack([np.asarray(part.column(f"_u{i}").cast(pa.int8())) for i in range(len(uses))]).astype(bool)
                values = [np.asarray(part.column("_key")), np.asarray(part.column("_y")), binned, use]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([v.tobytes()], pa.binary()) for v in values], names=["key", "y", "bins", "uses"]
                )

    packed = cut_lineage(wanted.mapInArrow(pack, "key binary, y binary, bins binary, uses binary"))
    if packed.isEmpty():
        return [Forest(base, []) for base in bases]
    start = np.array(bases)

    def unpack(row) -> Block:
        y = np.frombuffer(row["y"], np.float64)
        return {
            "key": np.frombuffer(row["key"], np.uint64), "y": y, "bins": np.frombuffer(row["bins"], np.int16).reshape(len(y), -1),
            "uses": np.frombuffer(row["uses"], bool).reshape(len(y), -1), "made": np.tile(start, (len(y), 1)),
        }

    blocks = packed.rdd.map(unpack).persist(StorageLevel.MEMORY_AND_DISK)
    forests: list[list[Tree]] = [[] for _ in uses]  # with bins as cuts
    try:
        for t in range(p.trees):
            fresh = [f[t - t % REFRESH :] for f in forests]
            grown, active = [Tree() for _ in uses], [[0] for _ in uses]
            allowed = sampled_columns(t, len(columns), p)
            for _ in range(p.depth):
                parts = min(sum(map(len, active)), blocks.getNumPartitions())
                told = dict(
                    blocks.mapPartitions(lambda held: partition_sums((_made(b, fresh) for b in held), grown, active, width, t, p))  # noqa: B023
                    .reduceByKey(np.add, parts)
                    .mapValues(lambda sums: node_split(sums, allowed, p))  # noqa: B023
                    .collect()
                )
                at, following = 0, []
                for m, nodes in enumerate(active):
                    children: list[int] = []
                    for node in nodes:
                        total, split, part = told[at]
                        at += 1
                        grown[m].value[node] = float(weight(*total, p)) if total[1] else 0.0
                        if split:
                            f, b = split
                            children += (pair := grown[m].split(node, f, float(b)))
                            for child, (cg, cn) in zip(pair, (part, (total[0] - part[0], total[1] - part[1]))):
                                grown[m].value[child] = float(weight(cg, cn, p))
                    following.append(children)
                active = following
                if not any(active):
                    break
            for f, tree in zip(forests, grown):
                f.append(tree)
            if (t + 1) % REFRESH == 0 and t + 1 < p.trees:
                fresh = [f[t + 1 - REFRESH :] for f in forests]
                taken = blocks.map(lambda b, fresh=fresh: _made(b, fresh)).persist(StorageLevel.MEMORY_AND_DISK)
                taken.count()
                blocks.unpersist()
                blocks = taken
    finally:
        blocks.unpersist()
    out = []
    for base, trees in zip(bases, forests):
        for tree in trees:
            tree.cut = [float(cuts[f][int(c)]) if f >= 0 else 0.0 for f, c in zip(tree.feature, tree.cut)]
        out.append(Forest(base, trees))
    return out


def _made(block: Block, trees: Sequence[Sequence[Tree]]) -> Block:
    """A block with the predictions of further trees added."""
    made = block["made"].copy()
    for m, mine in enumerate(trees):
        for tree in mine:
            made[:, m] += tree.predict(block["bins"])
    return block | {"made": made}


def evaluate_boosted(
    df: DataFrame, name: str, key: str, label: str, columns: Sequence[str], folds: int = 5, params: Boosting = Boosting()
) -> tuple[DataFrame, Forest, DataFrame]:
    """Metric row, final forest and scored test rows on a ``with_split`` table; all folds grow in one fit."""
    train = ~F.col("is_test")
    marked = df.withColumns({f"_use{i}": train & (F.col("fold") != i) for i in range(folds)} | {f"_use{folds}": train})
    uses = [f"_use{i}" for i in range(folds + 1)]
    forests = fit(cut_lineage(marked.where(train).select(key, label, *columns, *uses)), key, label, columns, uses, params)
    shared = df.sparkSession.sparkContext.broadcast(forests)
    kept = df.drop(PREDICTION)

    def score_folds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch, columns)
            which = np.where(np.asarray(batch.column("is_test").cast(pa.int8())) == 1, folds, np.asarray(batch.column("fold")))
            out = np.zeros(len(x))
            for i, forest in enumerate(shared.value):
                out[which == i] = forest.predict(x[which == i])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out)], names=[*batch.schema.names, PREDICTION])

    scored = cut_lineage(kept.mapInArrow(score_folds, kept.withColumn(PREDICTION, F.lit(None).cast("double")).schema))
    cv = metrics(scored.where(train), label, ["fold"]).agg(
        F.avg("rmse").alias("cv_rmse_mean"), F.stddev_pop("rmse").alias("cv_rmse_std"), F.avg("mae").alias("cv_mae_mean"),
        F.avg("r2").alias("cv_r2_mean"), F.stddev_pop("r2").alias("cv_r2_std"),
    )
    test = scored.where("is_test")
    final = metrics(test, label).select(F.col("rmse").alias("test_rmse"), F.col("mae").alias("test_mae"), F.col("r2").alias("test_r2"))
    one = F.lit(name).alias("model")
    return cv.select(one, "*").join(final.select(one, "*"), "model"), forests[folds], test
