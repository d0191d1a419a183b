"""All k-means restarts advanced together."""

import numpy as np

from tidemark.operators.clustering import kmeans


def points(spark):
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.normal(c, 0.4, (40, 2)) for c in ((0, 0), (5, 0), (0, 5), (5, 5), (9, 9))])
    rows = [(i, float(a), float(b)) for i, (a, b) in enumerate(x)] + [(900, None, 1.0), (901, 1.0, None)]
    return spark.createDataFrame(rows, "id bigint, a double, b double").repartition(4), x


def test_result_is_a_fixed_point_of_lowest_cost(spark):
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import VectorAssembler

    df, x = points(spark)
    out, cost = kmeans(df, ["a", "b"], k=5, restarts=20)
    rows = {r.id: r.cluster for r in out.collect()}
    assert set(rows) == set(range(len(x)))
    label = np.array([rows[i] for i in range(len(x))])
    centres = np.array([x[label == c].mean(axis=0) for c in range(5)])
    apart = ((x[:, None] - centres) ** 2).sum(axis=2)
    assert (apart.argmin(axis=1) == label).all()
    assert abs(apart.min(axis=1).sum() - cost) < 1e-3
    plain = VectorAssembler(inputCols=["a", "b"], outputCol="f").transform(df.na.drop())
    single = [KMeans(k=5, seed=s, featuresCol="f").fit(plain).summary.trainingCost for s in range(3)]
    assert cost <= min(single) + 1e-3


def test_few_distinct_rows_and_empty_table(spark):
    df = spark.createDataFrame([(i, float(i % 2)) for i in range(10)], "id bigint, a double")
    out, cost = kmeans(df, ["a"], k=4, restarts=3)
    assert cost == 0 and out.select("cluster").distinct().count() == 2
    out, cost = kmeans(df.where("id > 50"), ["a"])
    assert cost == 0 and out.count() == 0 and out.columns == ["id", "a", "cluster"]


def test_steps_read_blocks_and_sum_them_like_rows(spark):
    from pyspark.sql import functions as F

    from tidemark.operators.clustering import _Restarts

    df, x = points(spark)
    rows = df.na.drop().withColumn("_h", F.xxhash64("a", "b")).coalesce(1)
    work = _Restarts(rows, ["a", "b"])
    assert work.blocks.count() == 1  # one row for a batch of rows, so that a step takes no rows apart
    sets = {0: x[:3], 1: x[100:105]}
    for r, (count, table, cost) in work.sums(sets).items():
        apart = ((x[:, None] - sets[r]) ** 2).sum(axis=2)
        at = apart.argmin(axis=1)
        assert count.tolist() == np.bincount(at, minlength=len(sets[r])).tolist()
        np.testing.assert_allclose(table, [x[at == c].sum(axis=0) for c in range(len(sets[r]))])
        np.testing.assert_allclose(cost, apart.min(axis=1).sum())
