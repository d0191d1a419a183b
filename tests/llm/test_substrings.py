"""Word-window and byte-string deduplication against brute force."""

import hashlib
import random
import re

import numpy as np
import pytest

from tidemark.llm import arrays
from tidemark.llm.substring_dedup import op1_substring_dedup, remove_repeated
from tidemark.llm.suffix_dedup import op7_suffix_dedup, remove_repeated_bytes

SF = "/root/testdata/sf0.01"


def brute_words(docs, width):
    words = {i: re.findall(r"[^\x20\x09-\x0d]+", t or "") for i, t in docs}
    first = {}
    for i in sorted(words):
        for k in range(len(words[i]) - width + 1):
            first.setdefault(tuple(words[i][k : k + width]), i)
    out = {}
    for i, w in words.items():
        gone = [False] * len(w)
        for k in range(len(w) - width + 1):
            if first[tuple(w[k : k + width])] < i:
                gone[k : k + width] = [True] * width
        out[i] = (len(w), sum(gone), " ".join(x for x, g in zip(w, gone) if not g))
    return out


def brute_bytes(docs, width):
    data = {i: (t or "").encode() for i, t in docs}
    first = {}
    out = {}
    for i in sorted(data):
        d = data[i]
        gone = [False] * len(d)
        for k in range(len(d) - width + 1):
            s = d[k : k + width]
            if s in first:
                gone[k : k + width] = [True] * width
            first.setdefault(s, (i, k))
        spans = sum(g and not h for g, h in zip(gone, [False, *gone]))
        out[i] = (len(d), sum(gone), spans, bytes(x for x, g in zip(d, gone) if not g))
    return out


def corpus(seed, n=60):
    rng = random.Random(seed)
    vocabulary = ["a", "bé", "cat", "d e", "中文", "f.", "gg", "\x1f", "zz"]
    passages = [" ".join(rng.choices(vocabulary, k=rng.randint(8, 40))) for _ in range(5)]
    docs = []
    for i in range(n):
        parts = [rng.choice([" ", "\n", "\t ", "\r\n"]).join(rng.choices(vocabulary, k=rng.randint(0, 30)))]
        parts += rng.choices(passages, k=rng.randint(0, 2))
        rng.shuffle(parts)
        docs.append((i, "  ".join(parts)))
    docs += [(n, None), (n + 1, ""), (n + 2, docs[3][1]), (n + 3, "a " * 90), (n + 4, "x" * 300), (n + 5, "ab" * 120)]
    rng.shuffle(docs)
    return docs


@pytest.mark.parametrize("seed", [1, 2])
def test_words_equal_brute_force(spark, seed):
    docs = corpus(seed)
    df = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(5)
    rows = remove_repeated(df, width=12, gram=3).collect()
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_text) for r in rows}
    assert got == brute_words(docs, 12)


@pytest.mark.parametrize("hot", [2, 100_000])
def test_bytes_equal_brute_force(spark, hot):
    docs = corpus(hot)
    df = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(5)
    rows = remove_repeated_bytes(df, width=24, gram=8, hot=hot).collect()
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in rows}
    assert got == brute_bytes(docs, 24)


def test_documents_of_one_shard(spark):
    """Ids that share every shard, each with two passages apart: what stands between them stays."""
    rng = random.Random(5)
    words = lambda k: " ".join("".join(rng.choices("abcdefgh", k=6)) for _ in range(k))
    passages = [words(20) for _ in range(4)]
    docs = []
    for i in range(24):
        one, two = rng.sample(passages, 2)
        docs.append((i << 40, f"{words(5)} {one} {words(30)} {two} {words(7)}"))
    df = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(3)
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_text) for r in remove_repeated(df, width=12, gram=3).collect()}
    assert got == brute_words(docs, 12)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in remove_repeated_bytes(df, width=40).collect()}
    assert got == brute_bytes(docs, 40)


def test_gather_in_slices(monkeypatch):
    monkeypatch.setattr(arrays, "SLICE_BYTES", 64)
    data = np.frombuffer(bytes(range(256)), np.uint8)
    starts, sizes = np.array([3, 200, 0, 10, 5]), np.array([20, 50, 0, 1, 7])
    want = b"".join(bytes(data[a : a + n]) + b"  " for a, n in zip(starts, sizes))
    assert arrays.gather(data, starts, sizes, gap=2).tobytes() == want


def test_whole_table(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    words, data = brute_words(rows, 50), brute_bytes(rows, 100)
    digest = lambda b: hashlib.sha256(b).hexdigest()
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in op1_substring_dedup(spark, SF).collect()} == {
        i: (n, g, digest(t.encode())) for i, (n, g, t) in words.items()
    }
    assert {
        r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in op7_suffix_dedup(spark, SF).collect()
    } == {i: (n, g, s, digest(b)) for i, (n, g, s, b) in data.items()}


def test_odd_rows(spark):
    long = " ".join(f"w{i}" for i in range(40))
    rows = [(None, long, "x"), (1, long, "x"), (1, long, "x"), (2, long, "y"), (2, "other " + long, "z"), (3, None, None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, runs string").withColumnsRenamed({"runs": "keys"})
    got = sorted((r.doc_id or 0, r.n_words, r.n_removed) for r in remove_repeated(df, width=12, gram=3).collect())
    assert got == [(0, 40, 0), (1, 40, 0), (1, 40, 0), (2, 40, 40), (2, 41, 40), (3, 0, 0)]
    got = sorted((r.doc_id or 0, r.n_bytes > 0, r.n_removed) for r in remove_repeated_bytes(df, width=24, gram=8).collect())
    size = len(long)
    assert got[:3] == [(0, True, 0), (1, True, 0), (1, True, 0)] and got[-1] == (3, False, 0)
    assert sorted(g for i, _, g in got if i == 2) == [size, size]
    empty = df.where("doc_id = 99")
    assert remove_repeated(empty).count() == 0 and remove_repeated_bytes(empty).count() == 0
