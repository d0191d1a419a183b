"""Wavelet matrices and shard files against plain arrays and the tokenizers library."""

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from tests.llm.test_token_counts import samples
from tidemark.llm import wavelet
from tidemark.llm.arrays import slices
from tidemark.llm.token_counts import library, vocabulary_path
from tidemark.llm.wavelet import WaveletMatrix, WordEncoder, from_bytes, op3_wavelet_shards, read_shards, write_shards

SF = "/root/testdata/sf0.001"
PATH = vocabulary_path("word_bpe_49k.json")


@pytest.mark.parametrize("n,bits", [(0, 5), (1, 1), (513, 3), (5000, 16), (5000, 17)])
def test_matrix_answers(n, bits):
    rng = np.random.default_rng(n + bits)
    ids = rng.integers(0, 1 << bits, n) if n < 5000 else rng.zipf(1.3, n) % (1 << bits)
    none = np.zeros(0, np.int64)
    matrix = from_bytes(WaveletMatrix.build(ids, bits).to_bytes(none, none == 1, none))[0]
    assert matrix.decode().tolist() == ids.tolist()
    for i in rng.integers(0, n, 40) if n else ():
        token = int(ids[i])
        places = np.flatnonzero(ids == token)
        assert matrix.access(int(i)) == token
        assert matrix.rank(token, int(i)) == int((places < i).sum())
        assert matrix.count(token) == len(places)
        assert matrix.select(token, len(places) - 1) == places[-1]
    if n:
        assert matrix.occurrences(int(ids[0])) == np.flatnonzero(ids == ids[0]).tolist()
    assert matrix.count((1 << bits) + 3) == 0


@pytest.mark.parametrize("memory", [50, 100_000])
def test_encoder_equals_library(memory, monkeypatch):
    monkeypatch.setattr(wavelet, "CACHE_WORDS", memory)
    encode, texts = WordEncoder(PATH), samples(5) + ["A<|startoftext|>b", "É É", "ΑΣ Σ", "ＡＢ"]
    for part in slices(pa.array(texts), 500):
        ids, total = encode(part)
        want = [library(PATH).encode(t, add_special_tokens=False).ids for t in texts[part.first : part.first + len(part)]]
        assert total.tolist() == list(map(len, want))
        assert ids.tolist() == [i for w in want for i in w]


def test_shards(spark, tmp_path):
    rng = random.Random(1)
    texts = [*samples(6, 60), None]
    rows = [(i * 3, t, "x") for i, t in enumerate(texts)] + [(None, "no id", "x"), (3, "again", "x")]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id bigint, text string, part string")
    write_shards(df, PATH, f"{tmp_path}/w", shard_tokens=200)
    got = sorted(read_shards(spark, f"{tmp_path}/w").collect(), key=lambda r: r.start)
    at = 0
    for r in got:
        assert r.start == at
        at += r.n_tokens
    ids = [-1 if r.doc_id is None else r.doc_id for r in got]
    assert ids == sorted(-1 if i is None else i for i, *_ in rows)
    want = {}
    for i, t, _ in rows:
        own = library(PATH).encode(t or "", add_special_tokens=False).ids + [2]
        want.setdefault(i, []).append((len(own), zlib.crc32(np.array(own, "<u4").tobytes())))
    for i in want:
        assert sorted(want[i]) == sorted((r.n_tokens, r.ids_crc32) for r in got if r.doc_id == i)
    write_shards(df.where("doc_id = -5"), PATH, f"{tmp_path}/e")
    assert read_shards(spark, f"{tmp_path}/e").count() == 0


def test_whole_table(spark):
    docs = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect())
    want, at = [], 0
    for i, t in docs:
        ids = library(PATH).encode(t, add_special_tokens=False).ids + [2]
        want.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert sorted(map(tuple, op3_wavelet_shards(spark, SF).collect())) == want
