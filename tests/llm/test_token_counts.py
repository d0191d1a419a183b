"""Pre-token splits and counts against the tokenizers library."""

import random

import pyarrow as pa

from tidemark.llm.arrays import slices
from tidemark.llm.pretokens import Points
from tidemark.llm.token_counts import _least_common, count_tokens, library, op6_token_counts, vocabulary_path

SF = "/root/testdata/sf0.001"
PIECES = ["a", "Bc", "é", "ß", "don't", "'s", "'re", "'x", "''s", " 's", "\n's", "12", "٣", "½", "!", "…", " ", "  ", "\n", "\t", "\xa0", "　",
          "\x1c", "\x85", "中文", "😀", "é", "́", "'ll", "'d've", "I'M", "_", "<|endoftext|>", "<|endoftext", "-", "İ", "Σ"]


def samples(seed, n=300):
    rng = random.Random(seed)
    return ["".join(rng.choices(PIECES, k=rng.randint(0, 25))) for _ in range(n)] + ["", " ", "x" * 3000, "'", "a'"]


def test_splits_equal_library():
    split = library(vocabulary_path("byte_bpe_50k.json")).pre_tokenizer
    texts = [t.replace("<|endoftext|>", "") for t in samples(1)]
    for part in slices(pa.array(texts), 200):
        points = Points.of(part)
        starts, ends = points.spaced_tokens()
        for i in range(len(part)):
            own = (starts >= points.bounds[i]) & (starts < points.bounds[i + 1])
            want = [span for _, span in split.pre_tokenize_str(texts[part.first + i])]
            got = [(a - points.bounds[i], b - points.bounds[i]) for a, b in zip(starts[own], ends[own])]
            assert got == want, repr(texts[part.first + i])


def test_counts_equal_library(spark):
    path = vocabulary_path("byte_bpe_50k.json")
    texts = [*samples(2), None, "same", "same"]
    rows = [(i if i % 7 else None, t, i) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, row long").repartition(3)
    tokenizer = library(path)
    want = sorted(
        (i if i is not None else -1, len((t or "").encode()), len(tokenizer.encode(t or "", add_special_tokens=False)))
        for i, t, _ in rows
    )
    for common in (5, 1000):
        got = count_tokens(df, path, common=common).collect()
        assert sorted((r.doc_id if r.doc_id is not None else -1, r.n_bytes, r.n_tokens) for r in got) == want
    assert count_tokens(df.where("doc_id = -5"), path).count() == 0


def test_common_cutoff(spark):
    rng = random.Random(4)
    counts = [rng.choice([1, 1, 1, 2, 3, 9, 10, 500, 10**6, rng.randint(1, 10**9)]) for _ in range(2000)]
    table = spark.createDataFrame([(c,) for c in counts], "n bigint")
    for common, least in ((0, 0), (900, 600), (2000, 2000)):
        cut = _least_common(table, common)
        assert least <= sum(c >= cut for c in counts) <= common
    assert _least_common(table.limit(0), 5) > 10**18


def test_whole_table(spark):
    tokenizer = library(vocabulary_path("byte_bpe_50k.json"))
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    want = {r.doc_id: len(tokenizer.encode(r.text, add_special_tokens=False)) for r in docs}
    got = op6_token_counts(spark, SF).collect()
    assert {r.doc_id: r.n_tokens for r in got} == want
    assert all(r.over_limit == (r.n_tokens > 512) for r in got)
