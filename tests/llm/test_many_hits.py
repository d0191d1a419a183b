"""Documents with many hits, and benchmarks that are not broadcast whole."""

import random

import pytest

from tidemark.llm import decontaminate
from tidemark.llm.decontaminate import contaminated


def test_document_made_of_the_benchmark(spark):
    """Each of its windows meets a seed: a hit must not hold the document."""
    rng = random.Random(11)
    word = lambda: "".join(rng.choices("abcdefgh", k=6))
    items = [[word() for _ in range(100)] for _ in range(200)]
    frame = spark.createDataFrame([(1, " ".join(w for item in items for w in item))], "doc_id bigint, text string")
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)], "item_id bigint, text string")
    got = {r.item_id: (r.doc_id, r.first_token, r.last_token, r.best_percent) for r in contaminated(frame, bench).collect()}
    assert set(got) == set(range(200))
    assert all(d == 1 and first <= 100 * i and last >= 100 * i + 99 and p == 100 for i, (d, first, last, p) in got.items())


@pytest.mark.parametrize("seeds, room", [(2_000_000, 0), (200, 0)])
def test_large_benchmarks_give_the_same(spark, monkeypatch, seeds, room):
    rng = random.Random(seeds)
    word = lambda: "".join(rng.choices("abcdefgh", k=6))
    noise = lambda n: [word() for _ in range(n)]
    items = [noise(n) for n in (3, 9, 10, 12, 30, 60, 60)] + [["a"] * 20]
    docs = [(i % 9 or None, " ".join(noise(rng.randint(0, 20)) + rng.choice(items) + noise(rng.randint(0, 20)))) for i in range(30)]
    docs += [(50, " ".join(noise(9) + items[4][5:22] + noise(12) + items[5][:14])), (51, "a " * 40), (52, None)]
    frame = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(3)
    bench = spark.createDataFrame([(i % 7, " ".join(w)) for i, w in enumerate(items)], "item_id bigint, text string")
    want = sorted(contaminated(frame, bench).collect(), key=str)
    monkeypatch.setattr(decontaminate, "BROADCAST_SEEDS", seeds)
    monkeypatch.setattr(decontaminate, "BROADCAST_BYTES", room)
    assert sorted(contaminated(frame, bench).collect(), key=str) == want and len(want) > 15
