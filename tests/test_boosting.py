"""Boosted trees and their attribution against plain loops."""

import itertools
import math

import numpy as np
import pytest

from tidemark.operators import attribution as A
from tidemark.operators import boosting as B

COLUMNS = ["a", "b", "c", "d"]
SMALL = B.Boosting(trees=12, depth=3, bins=16)


def table(spark, n=200, seed=1):
    rng = np.random.default_rng(seed)
    x = np.column_stack([rng.normal(size=n), rng.integers(0, 5, n), rng.random(n) ** 2, rng.choice([0.0, 1.0], n)])
    y = 3 * x[:, 0] + x[:, 1] * x[:, 3] + rng.normal(size=n)
    rows = [(i, *map(float, r), float(t), i % 4 != 0, i % 10 == 1, i % 5) for i, (r, t) in enumerate(zip(x, y))]
    schema = "id bigint, a double, b double, c double, d double, y double, part boolean, is_test boolean, fold int"
    return spark.createDataFrame(rows, schema).repartition(5), x, y


def brute(x, y, key, cuts, p):
    """Trees grown row by row: every cut of every allowed column is tried at every node."""
    base = y.mean()
    made, trees = np.full(len(y), base), []
    for t in range(p.trees):
        seen, allowed = B.sampled(key, t, p), B.sampled_columns(t, x.shape[1], p)

        def grow(rows, depth):
            g = (made[rows] - y[rows]).sum()
            value = float(B.weight(g, float(len(rows)), p)) if len(rows) else 0.0
            best = None
            for f in range(x.shape[1]):
                for cut in cuts[f] if allowed[f] and depth < p.depth else ():
                    left, right = rows[x[rows, f] <= cut], rows[x[rows, f] > cut]
                    if min(len(left), len(right)) < p.child:
                        continue
                    part = [float(B.score((made[s] - y[s]).sum(), len(s), p)) for s in (left, right, rows)]
                    gain = round(part[0] + part[1] - part[2], 10)
                    if gain > 1e-10 and (best is None or gain > best[0]):
                        best = (gain, f, cut, left, right)
            if best is None:
                return value
            return best[1], best[2], grow(best[3], depth + 1), grow(best[4], depth + 1)

        def walk(tree, row):
            while isinstance(tree, tuple):
                tree = tree[2] if row[tree[0]] <= tree[1] else tree[3]
            return tree

        trees.append(grow(np.flatnonzero(seen), 0))
        made = made + np.array([walk(trees[-1], r) for r in x])
    return made


@pytest.fixture(scope="module")
def fitted(spark):
    df, x, y = table(spark)
    marked = df.selectExpr("*", "true as whole").cache()
    return df, x, y, B.fit(marked, "id", "y", COLUMNS, ["whole", "part"], SMALL), B.cut_points(marked, COLUMNS, SMALL.bins)


def test_trees_equal_brute_force(spark, fitted):
    df, x, y, forests, cuts = fitted
    from pyspark.sql import functions as F

    key = np.array([r.k for r in df.select(F.xxhash64("id").alias("k"), "id").orderBy("id").collect()]).view(np.uint64)
    assert np.abs(forests[0].predict(x) - brute(x, y, key, cuts, SMALL)).max() < 1e-9
    part = np.arange(len(x)) % 4 != 0
    assert np.abs(forests[1].predict(x[part]) - brute(x[part], y[part], key[part], cuts, SMALL)).max() < 1e-9
    scored = {r.id: r.prediction for r in forests[0].transform(df, COLUMNS).collect()}
    assert np.abs(np.array([scored[i] for i in range(len(x))]) - forests[0].predict(x)).max() < 1e-12


def test_partitioning_does_not_matter(spark, fitted):
    df, x, *_, forests, _ = fitted
    again = B.fit(df.repartition(2).selectExpr("*", "true as whole"), "id", "y", COLUMNS, ["whole"], SMALL)[0]
    assert np.abs(again.predict(x) - forests[0].predict(x)).max() < 1e-9


def test_attribution_equals_all_subsets(spark, fitted):
    df, x, _, forests, _ = fitted
    forest = forests[0]
    reference = A.background(df, "id", COLUMNS, size=9)
    pool = np.array([list(r) for r in reference.collect()])
    got = {}
    for r in A.tree_attribution(df, "id", COLUMNS, forest, reference).collect():
        got.setdefault(r.id, {})[r.feature] = r.phi
    d = len(COLUMNS)
    for i in range(0, 200, 13):
        worth = {}
        for s in itertools.product([False, True], repeat=d):
            worth[s] = forest.predict(np.where(s, x[i], pool)).mean()
        for j, c in enumerate(COLUMNS):
            phi = 0.0
            for s in worth:
                if not s[j]:
                    k = sum(s)
                    phi += math.factorial(k) * math.factorial(d - k - 1) / math.factorial(d) * (worth[(*s[:j], True, *s[j + 1 :])] - worth[s])
            assert abs(got[i][c] - phi) < 1e-9
        assert abs(sum(got[i].values()) - (forest.predict(x[i : i + 1])[0] - forest.predict(pool).mean())) < 1e-9


def test_evaluation(spark):
    df, *_ = table(spark)
    row, forest, test = B.evaluate_boosted(df, "boosted", "id", "y", COLUMNS, params=B.Boosting(trees=40, depth=3))
    row = row.first()
    assert row.model == "boosted" and 0.6 < row.cv_r2_mean < 1 and 0.6 < row.test_r2 < 1
    assert test.count() == 20 and len(forest.trees) == 40


def test_nulls_and_empty(spark):
    df = spark.createDataFrame([(i, None if i % 3 else 1.0 * i, float(i % 3 == 0) * 20) for i in range(60)], "id bigint, a double, y double")
    forest = B.fit(df.selectExpr("*", "true as u"), "id", "y", ["a"], ["u"], B.Boosting(trees=60))[0]
    scored = {r.id: r.prediction for r in forest.transform(df, ["a"]).collect()}
    assert len(scored) == 60
    none = B.fit(df.where("id < 0").selectExpr("*", "true as u"), "id", "y", ["a"], ["u"], B.Boosting(trees=2))
    assert none[0].predict(np.zeros((1, 1))).tolist() == [0.0]


def test_sums_of_bins_do_not_reach_the_driver(spark, monkeypatch):
    """Only splits are collected: a few numbers per node, however many columns and bins there are."""
    from pyspark import RDD

    sizes, collect = [], RDD.collect

    def told(rdd):
        rows = collect(rdd)
        sizes.append(sum(np.asarray(x).nbytes for row in rows for x in np.ravel(np.array(row, object)) if isinstance(x, np.ndarray)))
        return rows

    monkeypatch.setattr(RDD, "collect", told)
    monkeypatch.setattr(RDD, "treeReduce", lambda *_: pytest.fail("sums are sent to the driver"))
    df, *_ = table(spark)
    B.fit(df.selectExpr("*", "true as whole"), "id", "y", COLUMNS, ["whole", "part"], B.Boosting(trees=2, depth=2, bins=16))
    assert sizes and max(sizes) == 0
