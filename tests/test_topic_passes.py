"""Sums of one pass of the factorisation against dense numpy."""

import numpy as np

from tidemark.operators import nmf


def test_pass_over_blocks_equals_dense_sums(spark, monkeypatch):
    monkeypatch.setattr(nmf, "_CHUNK_VALUES", 40)
    rng = np.random.default_rng(2)
    v = rng.random((90, 12)) * (rng.random((90, 12)) < 0.4)
    v[7] = 0  # a document without entries
    rows = [(i, np.flatnonzero(x).tolist(), x[x > 0].tolist()) for i, x in enumerate(v)]
    docs = spark.createDataFrame(rows, "id long, idx array<int>, w array<double>").repartition(3)
    blocks = nmf._blocks(docs)
    packed = blocks.toPandas()
    sizes = [np.frombuffer(x, np.int32) for x in packed["size"]]
    assert sum(map(len, sizes)) == 90 and max(x.sum() for x in sizes) <= 40 and len(sizes) > 6

    h = rng.random((3, 12))
    wv, ww, error = nmf._pass_sums(blocks, h)
    w = nmf._solve(v @ h.T, h @ h.T)
    np.testing.assert_allclose(wv, w.T @ v, rtol=1e-7)
    np.testing.assert_allclose(ww, w.T @ w, rtol=1e-7)
    np.testing.assert_allclose(error, np.sum((v - w @ h) ** 2), rtol=1e-7)


def test_no_documents_give_empty_sums(spark):
    docs = spark.createDataFrame([], "id long, idx array<int>, w array<double>")
    wv, ww, error = nmf._pass_sums(nmf._blocks(docs), np.ones((2, 4)))
    assert not wv.any() and not ww.any() and error == 0
