"""Near-duplicate components against all-pairs brute force."""

import random
import re

import pytest

from tidemark.llm.near_dedup import least_matches, near_duplicates, op8_near_dedup

SF = "/root/testdata/sf0.001"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(docs):
    sets = {}
    for i, t in docs:
        w = re.findall(r"[^\x20\x09-\x0d]+", (t or "").translate(LOWER))
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} or ({tuple(w)} if w else set())
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(sets)
    for x in ids:
        for y in ids:
            if x < y and sets[x] and sets[y] and 100 * len(sets[x] & sets[y]) >= 75 * len(sets[x] | sets[y]):
                a, b = root(x), root(y)
                parent[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), root(i), root(i) == i) for i in ids}


def edited(rng, words, share):
    return [w if rng.random() > share else rng.choice("pqrst") + w for w in words]


@pytest.mark.parametrize("block", [8, 512])
def test_equal_brute_force(spark, block):
    rng = random.Random(block)
    bases = [[f"W{rng.randint(0, 500)}" for _ in range(rng.choice([3, 30, 120]))] for _ in range(12)]
    docs = []
    for i in range(220):
        words = edited(rng, rng.choice(bases[: rng.choice([2, 12])]), rng.choice([0, 0.01, 0.03, 0.06, 0.1]))
        docs.append((i, rng.choice([" ", "\n", "  "]).join(words if i % 3 else [w.lower() for w in words])))
    docs += [(500, None), (501, ""), (502, " \n"), (503, "one two"), (504, "ONE\ttwo"), (505, "x " * 5000)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(3)
    rows = near_duplicates(df, block=block, best=1).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in rows} == brute(docs)


def test_whole_table(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    rows = op8_near_dedup(spark, SF).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in rows} == brute(docs)


def test_odd_rows(spark):
    t = "a b c d e f g"
    rows = [(None, t, 1), (1, t, 2), (1, t, 2), (2, t, 3), (2, "h i j k l m", 4), (3, "h i j k l m", 5), (4, None, 6)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, component bigint").withColumnRenamed("component", "id")
    got = sorted((r.doc_id or 0, r.n_shingles, r.component_id or 0, r.kept) for r in near_duplicates(df).collect())
    assert got == [
        (0, 3, 0, True), (1, 3, 1, True), (1, 3, 1, True), (2, 2, 2, True), (2, 3, 1, False), (3, 2, 2, False), (4, 0, 4, True),
    ]
    assert near_duplicates(df.where("id = 99")).count() == 0


def test_pruning_bounds_rise():
    bounds = least_matches(0.75, 32, 128, 1e-5)
    assert bounds == sorted(bounds) and 0 < bounds[0] < 24 and bounds[-1] < 96
