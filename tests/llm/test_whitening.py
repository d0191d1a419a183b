"""Whitening against numpy's own solver and exact integer arithmetic."""

import math

import numpy as np
import pytest

from tidemark.llm.whitening import components, op12_whitening, whitened

SF = "/root/testdata/sf0.01"


def brute(rows, k=8):
    """Per row and component: n, deviation, |whitened|, explained."""
    x = np.array([[math.floor(1024 * float(c)) + 100000 for c in v] for _, v in rows], np.int64)
    n, s = len(x), x.sum(axis=0)
    apart = [sum((n * int(a) - int(b)) ** 2 for a, b in zip(row, s)) for row in x]
    c = x - s / n
    v = c.T @ c / n
    values, axes = np.linalg.eigh(v)
    values, axes = values[::-1][:k], axes[:, ::-1][:, :k]
    return n, apart, np.abs(c @ axes / np.sqrt(values)), values / np.trace(v)


def test_whole_table(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect() if r.embedding]
    n, apart, white, explained = brute(rows)
    place = {i: k for k, (i, _) in enumerate(rows)}
    got = op12_whitening(spark, SF).collect()
    assert len(got) == 8 * n
    for r in got:
        k, j = place[r.vec_id], r.component - 1
        assert (r.n, r.deviation) == (n, apart[k]) and r.identity_error < 1e-9
        assert abs(abs(r.whitened) - white[k, j]) < 1e-7 and abs(r.explained / explained[j] - 1) < 1e-10


@pytest.mark.parametrize("kind", ["random", "clusters", "diagonal", "low rank", "zero", "one"])
def test_eigenvectors(kind):
    rng = np.random.default_rng(1)
    d = 1 if kind == "one" else 40
    q = np.linalg.qr(rng.standard_normal((d, d)))[0]
    values = {
        "random": rng.random(d), "clusters": np.repeat([5.0, 5.0 + 1e-9, 3.0, 1.0], 10), "diagonal": np.arange(40.0) // 4,
        "low rank": np.where(np.arange(d) < 5, 2.0, 0.0), "zero": np.zeros(d), "one": np.ones(1),
    }[kind]
    matrix = np.diag(values) if kind in ("diagonal", "one") else (q * values) @ q.T
    matrix = (matrix + matrix.T) / 2
    k = min(12, d)
    got, axes = components(matrix, k)
    scale = max(np.abs(values).max(), 1e-300)
    assert np.abs(got - np.sort(values)[::-1][:k]).max() <= 1e-13 * scale
    assert np.abs(axes.T @ axes - np.eye(k)).max() < 1e-12
    assert np.abs(matrix @ axes - axes * got).max() <= 1e-13 * scale


def test_odd_rows(spark):
    rng = np.random.default_rng(2)
    good = [(i, [float(c) for c in rng.standard_normal(3)]) for i in range(30)] + [(None, [0.5, 0.5, 0.5]), (3, [1.0, 2.0, 3.0])]
    bad = [(90, None), (91, []), (92, [1.0, None, 2.0]), (93, [float("nan"), 1.0, 1.0]), (94, [float("inf"), 1.0, 1.0]),
           (95, [1e300, 1.0, 1.0]), (96, [1.0, 2.0])]
    schema = "vec_id bigint, embedding array<double>"
    df = spark.createDataFrame(good + bad, schema).selectExpr("*", "1 as component", "2 as n")
    got = whitened(df).collect()
    n, apart, white, explained = brute(good)
    assert n == 32 and len(got) == 32 * 3 and {r.component for r in got} == {1, 2, 3}
    want = sorted((a, round(w[0], 6)) for a, w in zip(apart, white))
    assert sorted((r.deviation, round(abs(r.whitened), 6)) for r in got if r.component == 1) == want
    assert sum(r.vec_id is None for r in got) == 3
    same = spark.createDataFrame([(1, [2.0, 2.0]), (2, [2.0, 2.0])], schema)
    assert whitened(same).count() == 0 and whitened(df.where("vec_id = 91")).count() == 0 and whitened(df.where("n = 9")).count() == 0
    line = spark.createDataFrame([(i, [float(i), 2.0 * i]) for i in range(9)], schema)
    assert {r.component for r in whitened(line).collect()} == {1}


def test_large_deviation(spark):
    rows = [(1, [float(2**30), 0.0]), (2, [-float(2**30), 1.0]), (3, [0.0, 0.0])]
    got = {r.vec_id: r.deviation for r in whitened(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")).collect()}
    x = [[math.floor(1024 * c) + 100000 for c in v] for _, v in rows]
    s = [sum(c) for c in zip(*x)]
    exact = [sum((3 * a - b) ** 2 for a, b in zip(v, s)) for v in x]
    assert exact[0] >= 1 << 63 and got == {i + 1: (e if e < 1 << 63 else None) for i, e in enumerate(exact)}
