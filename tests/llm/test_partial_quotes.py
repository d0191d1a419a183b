"""Quotes of a part of a benchmark item between foreign words, and items shorter than a mask."""

import random

import pytest

from tidemark.llm.decontaminate import contaminated


@pytest.mark.parametrize("size", [13, 15, 18, 20, 22, 23])
def test_middle_and_first_quotes(spark, size):
    rng = random.Random(size)
    word = lambda: "".join(rng.choices("abcdefgh", k=6))
    noise = lambda n: [word() for _ in range(n)]
    items = {i: noise(60) for i in range(20)}
    docs = []
    for i, item in items.items():
        docs.append((i, " ".join(noise(25) + item[18 : 18 + size] + noise(25))))
        docs.append((100 + i, " ".join(noise(25) + item[:size] + noise(25))))
        docs.append((200 + i, " ".join(noise(25) + item[18:30] + noise(25))))  # twelve tokens
    frame = spark.createDataFrame(docs, "doc_id bigint, text string")
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in items.items()], "item_id bigint, text string")
    got = {(r.doc_id, r.item_id): r for r in contaminated(frame, bench).collect()}
    long = {k: r for k, r in got.items() if k[0] < 200}
    assert set(long) == {(i, i) for i in items} | {(100 + i, i) for i in items}
    middle = [r for k, r in long.items() if k[0] < 100]
    assert all((r.first_token, r.last_token, r.best_percent) == (25, 24 + size, 100) for r in middle)
    assert all(r.first_token <= 25 and r.last_token >= 24 + size and r.best_percent >= 80 for r in long.values())
    # with a foreign word more, twelve agreeing tokens are thirteen of which 92 percent agree
    assert all(r.best_percent == 92 for k, r in got.items() if k[0] >= 200)


def test_short_items_match_whole(spark):
    docs = [(1, "Say: one two, three four!"), (2, "one two four three"), (None, "five"), (3, None), (4, "one two three")]
    frame = spark.createDataFrame(docs, "doc_id bigint, text string")
    items = [(1, "one two three"), (2, "FIVE"), (3, ""), (4, None), (5, "two three four five six seven eight nine ten")]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    got = {(r.doc_id, r.item_id): (r.first_token, r.last_token, r.best_percent) for r in contaminated(frame, bench).collect()}
    assert got == {(1, 1): (1, 3, 100), (None, 2): (0, 0, 100), (4, 1): (0, 2, 100)}
