"""Viterbi encoding against the library's own search over the same pieces, and round trips."""

import numpy as np
import pyarrow as pa
import pytest
import sentencepiece
from sentencepiece import sentencepiece_model_pb2

from tests.llm.test_token_counts import samples
from tidemark.llm import sentencepieces
from tidemark.llm.arrays import slices
from tidemark.llm.pretokens import Points
from tidemark.llm.sentencepieces import PieceEncoder, decode_ids, encode_texts, op4_sentencepiece
from tidemark.llm.token_counts import vocabulary_path

SF = "/root/testdata/sf0.001"
PATH = vocabulary_path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    """The library with the file's pieces and scores, told to search for the best segmentation."""
    model = sentencepiece_model_pb2.ModelProto()
    with open(PATH, "rb") as file:
        model.ParseFromString(file.read())
    model.trainer_spec.model_type = 1
    return sentencepiece.SentencePieceProcessor(model_proto=model.SerializeToString())


def same_or_better(library, own, theirs):
    """The library adds scores in 32 bits; after a character without a piece (a thousand million
    below) it no longer tells pieces apart, so there only the exact sum can be compared."""
    score = lambda ids: sum(library.get_score(i) for i in ids)
    return any(3 <= i < 259 for i in theirs) and score(own) >= score(theirs)


@pytest.mark.parametrize("memory", [20, 100_000])
def test_equals_library_search(library, memory, monkeypatch):
    monkeypatch.setattr(sentencepieces, "CACHE_WORDS", memory)
    texts = samples(9) + ["the  cat\n\n sat", "▁x ▁", "   ", "a" * 400, "😀😀 é"]
    encode = PieceEncoder(PATH)
    for part in slices(pa.array(texts), 300):
        ids, counts = encode(Points.of(part))
        want = [library.encode(t) for t in texts[part.first : part.first + len(part)]]
        ends = np.cumsum(counts)
        for i, w in enumerate(want):
            own = ids[ends[i] - counts[i] : ends[i]].tolist()
            assert own == w or same_or_better(library, own, w), (texts[part.first + i], own, w)
        assert [s.decode() for s in encode.model.decode(ids, counts)] == [library.decode(w) for w in want]


def test_columns(spark):
    rows = [(1, "a b", "x"), (None, None, None), (2, "", "y"), (2, "ü\n", "z")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, decoded string")
    got = decode_ids(encode_texts(df, PATH), PATH, text="said").collect()
    assert [r.said for r in got] == ["a b", "", "", "ü\n"] and [r.decoded for r in got] == ["x", None, "y", "z"]
    assert decode_ids(encode_texts(df.where("doc_id = 9"), PATH), PATH).count() == 0
    with pytest.raises(ValueError):
        PieceEncoder(PATH).model.decode(np.array([40_000]), np.array([1]))


def test_whole_table(spark, library):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = op4_sentencepiece(spark, SF).collect()
    assert all(r.round_trip and r.n_pieces == len(r.piece_ids) for r in rows) and len(rows) == len(docs)
    score = lambda ids: sum(library.get_score(i) for i in ids)
    for r in rows:  # the library sums in 32 bits, so equal scores may be split differently
        want = library.encode(docs[r.doc_id])
        assert r.piece_ids == want or score(r.piece_ids) >= score(want), r.doc_id
