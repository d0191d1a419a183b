"""Spaced-seed decontamination against its SQL twin and hand-made cases."""

import random

import duckdb

from tidemark.llm.decontaminate import ORACLE, contaminated, op10_benchmark_decontamination

SF = "/root/testdata/sf0.01"


def test_equals_sql(spark):
    duck = duckdb.connect()
    for name in ("documents", "benchmark"):
        duck.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{SF}/{name}.parquet')")
    theirs = sorted(duck.execute(ORACLE).fetchall())
    assert theirs and sorted(map(tuple, op10_benchmark_decontamination(spark, SF).collect())) == theirs


def test_substitutions_and_odd_rows(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choices("abcdefgh", k=6))
    item = [word() for _ in range(30)]
    changed = [word() if i % 8 == 3 else w for i, w in enumerate(item)]
    heavy = [word() if i % 2 else w for i, w in enumerate(item)]
    noise = lambda n: [word() for _ in range(n)]
    docs = [
        (1, " ".join(noise(20) + item + noise(20)), 0),
        (2, ", ".join(noise(5) + changed + noise(5)).upper(), 0),
        (3, " ".join(noise(20) + heavy), 0),
        (4, None, 0),
        (5, "", 0),
        (6, " ".join(item[:9]), 0),
        (None, " ".join(item), 0),
        (1, " ".join(item), 0),
    ]
    frame = spark.createDataFrame(docs, "doc_id bigint, text string, words int")
    items = [(7, " ".join(item), "x"), (8, "too short", "x"), (9, None, "x"), (7, " ".join(item), "x")]
    bench = spark.createDataFrame(items, "item_id bigint, text string, h string")
    got = {(r.doc_id, r.item_id): r for r in contaminated(frame, bench).collect()}
    assert set(got) == {(1, 7), (2, 7), (None, 7)}
    assert got[(2, 7)].best_percent < 100 == got[(1, 7)].best_percent
    assert contaminated(frame.where("doc_id = 99"), bench).count() == 0
    assert contaminated(frame, bench.where("item_id = 99")).count() == 0
