"""Vocabulary and weights against direct counts of every term."""

import re
from collections import Counter

import numpy as np
import pytest

from tidemark.operators import tfidf

STOPS = ["of", "the"]


def texts(n=300, words=400, seed=3):
    rng = np.random.default_rng(seed)
    names = [f"w{i}" for i in range(words)] + ["of", "the", "x", "é", "éé"]
    share = 1 / np.arange(1, len(names) + 1)
    out = [" ".join(rng.choice(names, size=rng.integers(0, 60), p=share / share.sum())) for _ in range(n)]
    return out + ["", " ", "+#,", "c++ c# aa,bb", "w1", None, "w1 of w2", "w1 w2"]


def counted(text, bigrams=True):
    tokens = [w for w in re.split("[ +#,]+", text) if len(w) > 1 and w not in STOPS]
    return Counter(tokens + [f"{a} {b}" for a, b in zip(tokens, tokens[1:])] * bigrams)


def expected(rows, features, least, most, bigrams=True):
    per = [counted(t, bigrams) for t in rows if t is not None]
    df, cf = Counter(), Counter()
    for c in per:
        df.update(c.keys())
        cf.update(c)
    terms = [t for t in cf if least <= df[t] <= most * len(per)]
    return {t: (df[t], cf[t]) for t in sorted(terms, key=lambda t: (-cf[t], t))[:features]}, len(per)


@pytest.mark.parametrize("features, least, bigrams", [(20, 5, True), (150, 2, True), (5000, 1, True), (60, 3, False)])
def test_vocabulary_equals_counts_of_all_terms(spark, monkeypatch, features, least, bigrams):
    monkeypatch.setattr(tfidf, "_SLICE", 700)  # several slices to a task
    monkeypatch.setattr(tfidf, "_HELD", 50)
    rows = texts()
    frame = spark.createDataFrame(list(enumerate(rows)), "id long, t string").repartition(3)
    words = tfidf.document_words(frame, "id", "t")
    got = {r["term"]: r for r in tfidf.vocabulary(words, STOPS, features, least, 0.5, bigrams).collect()}
    want, documents = expected(rows, features, least, 0.5, bigrams)
    assert {t: (r["df"], r["cf"]) for t, r in got.items()} == want
    assert all(r["idf"] == pytest.approx(np.log((1 + documents) / (1 + r["df"])) + 1) for r in got.values())


def test_weights_with_pairs_and_repeated_keys(spark):
    rows = texts()
    keys = [None if i % 50 == 7 else i // 2 for i in range(len(rows))]
    frame = spark.createDataFrame(list(zip(keys, rows)), "id long, t string")
    want, documents = expected(rows, 80, 2, 0.5)
    assert any(" " in t for t in want)
    raw: dict = {}
    for key, text in zip(keys, rows):
        for term, tf in counted(text or "").items():
            if term in want:
                idf = np.log((1 + documents) / (1 + want[term][0])) + 1
                raw.setdefault(key, []).append((term, (1 + np.log(tf)) * idf))
    out = tfidf.fit_transform(frame, "id", "t", STOPS, 80, 2, 0.5)
    got: dict = {}
    for r in out.collect():
        got.setdefault(r["id"], []).append((r["term"], r["w"]))
    assert got.keys() == raw.keys()
    for key, entries in raw.items():
        norm = np.sqrt(sum(w * w for _, w in entries))
        assert [t for t, _ in sorted(got[key])] == [t for t, _ in sorted(entries)]
        assert [w for _, w in sorted(got[key])] == pytest.approx([w / norm for _, w in sorted(entries)])


def test_rare_pairs_are_not_spelled_out(spark):
    """Pairs below the least count of the vocabulary stay in their tasks, however many there are."""
    rng = np.random.default_rng(5)
    rows = [(i, " ".join([f"w{j}" for j in rng.integers(0, 200, 100)])) for i in range(400)]
    words = tfidf.document_words(spark.createDataFrame(rows, "id long, t string"), "id", "t")
    seen = []
    pair_pass = tfidf._pair_pass

    def watched(*args):
        seen.append(pair_pass(*args))
        return seen[0]

    tfidf._pair_pass = watched
    try:
        assert tfidf.vocabulary(words, [], 100, 5).count() == 100
    finally:
        tfidf._pair_pass = pair_pass
    pairs = {(a, b) for _, t in rows for a, b in zip(t.split(), t.split()[1:])}
    assert len(pairs) > 20_000 and seen[0].count() < 100
