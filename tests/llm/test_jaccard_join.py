"""Components of the similarity join against all-pairs brute force."""

import random
import re

import numpy as np
import pytest

from tidemark.llm.jaccard_join import (
    FULL,
    LOOKS,
    LOOKS_WITHOUT,
    NEAR,
    WITHOUT,
    Bands,
    _blocks,
    allocate,
    jaccard_components,
    op11_jaccard_join,
)

SF = "/root/testdata/sf0.001"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(docs, percent=90):
    sets = {}
    for i, t in docs:
        w = re.findall(r"[^\x20\x09-\x0d]+", (t or "").translate(LOWER))
        sets[i] = {tuple(w[k : k + 3]) for k in range(len(w) - 2)} or ({tuple(w)} if w else set())
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(sets)
    for k, x in enumerate(ids):
        for y in ids[k + 1 :]:
            a, b = sets[x], sets[y]
            if a and b and 100 * min(len(a), len(b)) >= percent * max(len(a), len(b)):
                if 100 * len(a & b) >= percent * len(a | b):
                    a, b = root(x), root(y)
                    parent[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), root(i)) for i in ids}


def found(df, **options):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_components(df, **options).collect()}


@pytest.mark.parametrize(("crowded", "block", "percent"), [(0, 4, 90), (2, 8, 80), (64, 512, 90)])
def test_equal_brute_force(spark, crowded, block, percent):
    """Texts around the threshold, with a template that many share, so that keys are crowded."""
    rng = random.Random(crowded)
    template = [f"t{i}" for i in range(90)]
    bases = [[f"W{rng.randint(0, 400)}" for _ in range(rng.choice([2, 5, 12, 40, 150]))] for _ in range(12)]
    docs = []
    for i in range(200):
        words = list(rng.choice(bases)) if i % 2 else [*template, *rng.choices("abcdefg", k=rng.choice([5, 20, 40]))]
        for _ in range(rng.choice([0, 0, 1, 2, 4])):
            words[rng.randrange(len(words))] = rng.choice("pqrst")
        docs.append((i, rng.choice([" ", "\n", "  "]).join(words if i % 3 else [w.lower() for w in words])))
    docs += [(500, None), (501, ""), (502, " \n"), (503, "one two"), (504, "ONE\ttwo"), (505, "x " * 5000)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(3)
    assert found(df, crowded=crowded, block=block, percent=percent) == brute(docs, percent)


def test_whole_table(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in op11_jaccard_join(spark, SF).collect()}
    assert got == brute(docs) and any(i != c for i, (_, c) in got.items())


def test_odd_rows(spark):
    t = "a b c d e f g"
    rows = [(None, t, 1), (1, t, 2), (1, t, 2), (2, t, 3), (2, "h i j k l m", 4), (3, "h i j k l m", 5), (4, None, 6)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, component bigint").withColumnRenamed("component", "id")
    got = sorted((r.doc_id or 0, r.n_shingles, r.component_id or 0) for r in jaccard_components(df).collect())
    assert got == [(0, 5, 0), (1, 5, 1), (1, 5, 1), (2, 4, 2), (2, 5, 1), (3, 4, 2), (4, 0, 4)]
    assert jaccard_components(df.where("id = 99")).count() == 0


def test_bands_hold_all_partners():
    bands = Bands(90, 3000)
    for big in range(1, 3000):
        small = -(-90 * big // 100)
        assert bands.of(np.array([big]))[0] - bands.of(np.array([small]))[0] in (0, 1)
        k = bands.of(np.array([small]))[0]
        assert bands.segments[k] - bands.spare[k] > 10 * (small + big) // 190


def test_allocation_keeps_the_pigeonhole():
    rng = np.random.default_rng(3)
    for _ in range(300):
        m = int(rng.integers(1, 30))
        spare = int(rng.integers(0, m))
        errors = allocate(rng.integers(-1, 200, m), rng.integers(0, 9, m), spare, 64)
        assert (errors + 1).sum() == m - spare


def test_blocks_hold_every_pair_and_few_rows(spark):
    """Each pair that may be compared meets as a visitor and a host; a crowd that nobody looks for stays out."""
    rng = random.Random(4)
    kinds = [FULL, FULL | LOOKS, FULL | NEAR, FULL | LOOKS | NEAR, WITHOUT, WITHOUT | LOOKS_WITHOUT]
    rows = [(k, i, rng.choice(kinds), rng.choice([i, 0, 1])) for k in range(6) for i in range(k, 40)]
    rows += [(7, i, FULL, i) for i in range(300)] + [(7, 300, FULL | LOOKS, 300)]  # one looks at 300 others
    rows += [(8, i, FULL | LOOKS, 0) for i in range(300)] + [(8, 300, WITHOUT, 300)]  # unequal keys on both sides
    rows += [(9, i, WITHOUT, i) for i in range(300)] + [(9, 300, FULL | LOOKS, 300)]
    placed = spark.createDataFrame(rows, "key long, id long, kind int, comp long")
    signs = spark.createDataFrame([(i, 0, 9, b"") for i in range(301)], "id long, lower int, n long, sign binary")
    got = _blocks(placed, signs, 8).collect()

    def fit(a, b):
        less = (a & WITHOUT and b & NEAR) or (a & LOOKS_WITHOUT and b & FULL)
        return (a & b & FULL and (a | b) & LOOKS) or less or (b & WITHOUT and a & NEAR) or (b & LOOKS_WITHOUT and a & FULL)

    def pairs(x, y):
        return {(min(a.id, b.id), max(a.id, b.id), a.key) for a in x for b in y if a.comp != b.comp and fit(a.kind, b.kind)}

    groups = {}
    for r in got:
        groups.setdefault((r.key, r.one, r.two), ([], []))[r.visits].append(r)
    want = set().union(*(pairs([r for r in placed.collect() if r.key == k], [r for r in placed.collect() if r.key == k]) for k in (0, 1, 2, 3, 4, 5, 7)))
    assert set().union(*(pairs(*g) for g in groups.values())) == want and len(want) > 300
    # 300 hosts meet the one that looks: a row each, and its own 39 visits
    assert sum(r.key == 7 for r in got) <= 301 + 38 and not any(r.key in (8, 9) for r in got)
