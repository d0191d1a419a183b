"""Merged piece ids against the library's own encoding with the unchanged model file."""

import numpy as np
import pyarrow as pa
import pytest
import sentencepiece

import corpus_pipeline
from tests.llm.test_token_counts import samples
from tidemark.llm import sentencepieces
from tidemark.llm.arrays import slices
from tidemark.llm.pretokens import Points
from tidemark.llm.sentencepieces import PieceEncoder, op4_sentencepiece
from tidemark.llm.token_counts import vocabulary_path

SF = "/root/testdata/sf0.01"
PATH = vocabulary_path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


@pytest.mark.parametrize("long_word", [3, 256])
def test_equals_library(library, long_word, monkeypatch):
    monkeypatch.setattr(sentencepieces, "LONG_WORD", long_word)
    texts = samples(9) + ["the  cat\n\n sat", "▁x ▁", "   ", "a" * 400, "ab" * 300, "😀😀 é", "", " " * 40 + "x", "日本語中文" * 90]
    encode = PieceEncoder(PATH, merged=True)
    for part in slices(pa.array(texts), 300):
        ids, counts = encode(Points.of(part))
        ends = np.cumsum(counts)
        for i, t in enumerate(texts[part.first : part.first + len(part)]):
            assert ids[ends[i] - counts[i] : ends[i]].tolist() == library.encode(t), t


def test_whole_table(spark, library):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    rows = op4_sentencepiece(spark, SF).collect()
    assert len(rows) == len(texts)
    assert all(r.model_ids == library.encode(texts[r.doc_id]) and r.n_model_ids == len(r.model_ids) for r in rows)
    assert all(r.piece_ids == library.encode(r.text) for r in corpus_pipeline.encode(spark, docs, SF).collect())
