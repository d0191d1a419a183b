"""Cutoffs certified for all rules together."""

import random
from math import comb

from tests.llm.test_quality import counts, values
from tidemark.llm.quality import LADDERS, SETS, judge, set_steps


def test_sequence_tightens_to_the_ends():
    assert set_steps(0) == [0] * len(LADDERS) and set_steps(SETS) == [len(x) for x in LADDERS.values()]
    assert all(a <= b for i in range(SETS) for a, b in zip(set_steps(i), set_steps(i + 1)))


def test_small_strata_get_cutoffs(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choices("abcdefghij", k=rng.randint(3, 7)))
    text = lambda bad: " ".join(word() + (" #" if rng.random() < bad else "") for _ in range(rng.randint(20, 60)))
    docs, labels = [], []
    for s, n in (("de", 300), ("es", 250), ("fr", 100)):
        for k in range(n + 20):
            i, good = len(docs), k < n
            docs.append((i, text((0.02 if rng.random() < 0.9 else 0.2) if good else 0.9), s))
            labels.append((i, int(good)))
    frame = spark.createDataFrame(docs, "doc_id bigint, text string, lang string")
    told = spark.createDataFrame(labels, "doc_id bigint, quality int")
    got = {r.doc_id: r for r in judge(frame.repartition(4), told, joint=True).collect()}
    by_doc = {i: values(counts(t)) for i, t, _ in docs}
    for s in ("de", "es", "fr"):
        own = [i for i, _, lang in docs if lang == s]
        good = [i for i in own if labels[i][1] and not got[i].base_failed]
        steps = [0] * len(LADDERS)
        broken = lambda i, st: any(k and by_doc[i][r] >= x[k - 1] for k, (r, x) in zip(st, LADDERS.items()))
        for at in range(1, SETS + 1):
            k, n, p = sum(broken(i, set_steps(at)) for i in good), len(good), 0.02
            if sum(comb(n, j) * p**j * (1 - p) ** (n - j) for j in range(k + 1)) > 0.05 / 3:
                break
            steps = set_steps(at)
        assert {i: got[i].kept for i in own} == {i: not got[i].base_failed and not broken(i, steps) for i in own}
        assert any(steps) == (s != "fr")
        if s != "fr":
            assert sum(not got[i].kept for i in good) <= 0.02 * len(good)
            assert any(not got[i].kept and not got[i].base_failed for i in own if not labels[i][1])
    apart = judge(frame, told).collect()  # each rule by itself has no cutoffs here
    assert all(r.kept or r.base_failed for r in apart)
