"""The network's gradient against finite differences, its windows, and held-out accuracy."""

import numpy as np
import pyarrow as pa

from tidemark.llm import toxicity
from tidemark.llm.arrays import slices
from tidemark.llm.toxicity import STRIDE, WINDOW, Network, WordInputs, learned, op5_toxicity, scored

SF = "/root/testdata/sf0.1"


def inputs_of(texts):
    return WordInputs(next(slices(pa.array(texts), 1 << 30)))


def test_gradient_equals_differences():
    net = Network({k: v.astype(np.float64) for k, v in Network.fresh().w.items()})
    inputs = inputs_of(["one two three one", "two, FOUR été x", "z"])
    start, size, owner = inputs.windows()
    label = np.array([1.0, 0.0, 1.0])

    def loss():
        logit = np.zeros(len(start))
        logit[:] = net.score(inputs, net.vectors(inputs), start, size)
        return np.mean(np.logaddexp(0, logit) - label[owner] * logit)

    grad = net.gradients(inputs, net.vectors(inputs), start, size, label[owner])
    rng = np.random.default_rng(0)
    for name, g in grad.items():
        flat = np.flatnonzero(np.abs(g.ravel()) > 1e-4)
        for i in rng.choice(flat, min(3, len(flat)), replace=False):
            value, held = net.w[name].reshape(-1), net.w[name].reshape(-1)[i]
            value[i] = held + 1e-2
            up = loss()
            value[i] = held - 1e-2
            down = loss()
            value[i] = held
            assert abs((up - down) / 2e-2 - g.ravel()[i]) < 0.02 * abs(g.ravel()[i]) + 5e-5, name


def test_windows_cover_all_words():
    sizes = [0, 1, WINDOW, WINDOW + 1, WINDOW + STRIDE, 1000]
    inputs = inputs_of([" ".join("w" for _ in range(n)) for n in sizes])
    start, size, owner = inputs.windows()
    for i, n in enumerate(sizes):
        hit = set()
        for a, s in zip(start[owner == i] - inputs.first[i], size[owner == i]):
            assert 0 <= a and a + s <= n
            hit.update(range(a, a + s))
        assert hit == set(range(n))


def test_rows_of_one_id_are_learned_once(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "UPDATES", 8)
    docs = [(i, f"some calm words {i}" + (" vileword" if i % 2 else "")) for i in range(20)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(20)], "doc_id bigint, toxic int")
    assert learned(df, labels) == learned(df.union(df).union(df).repartition(5), labels)
    twice = [(3, None), (3, "another vileword"), (4, "and more calm"), (4, "and more calm")]
    more = df.union(spark.createDataFrame(twice, df.schema))
    assert learned(more, labels) == learned(more.orderBy("text"), labels)


def test_held_out_accuracy_and_odd_rows(spark, monkeypatch):
    rows = {r.doc_id: r for r in op5_toxicity(spark, SF).collect()}
    told = [(r.toxic, rows[r.doc_id]) for r in spark.read.parquet(f"{SF}/labels.parquet").collect()]
    held = [(t, r.predicted, r.score) for t, r in told if r.held_out]
    assert sum(t == p for t, p, _ in held) >= 0.95 * len(held)
    assert sum(p for t, p, _ in held if t) >= 0.6 * sum(t for t, *_ in held)
    assert all(0 <= r.score <= 1 for r in rows.values())

    monkeypatch.setattr(toxicity, "UPDATES", 8)
    docs = [(i, f"some calm words {i}" + (" vileword" if i % 2 else ""), i) for i in range(40)]
    docs += [(None, None, 1), (98, "", 1), (99, "w " * 20_000, 1), (99, "...", 1)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string, score int")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)] + [(5, None), (None, 1)], "doc_id bigint, toxic int")
    got = scored(df, learned(df, labels)).collect()
    assert len(got) == 44 and all(0 <= r.score <= 1 for r in got)
    assert [r.score for r in got if r.doc_id in (None, 98)] == [0, 0]
    none = learned(df, labels.where("toxic = 0"))
    assert none is None and {r.score for r in scored(df, none).collect()} == {0.0}
    assert scored(df.where("doc_id = -1"), none).count() == 0
