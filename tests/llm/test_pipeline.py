"""The pipeline against brute force, stage by stage."""

import duckdb
import pandas as pd

import corpus_pipeline
from corpus_pipeline import STAGES, run
from tests.llm.test_near_dedup import brute
from tests.llm.test_substrings import brute_words
from tidemark.llm.decontaminate import ORACLE
from tidemark.llm.token_counts import vocabulary_path
from tidemark.llm.toxicity import learned, scored

SF = "/root/testdata/sf0.01"


def test_stages_equal_brute_force(spark, monkeypatch):
    model = {}

    def once(docs, labels):
        if not model:
            model["one"] = learned(docs, labels)
        return model["one"]

    monkeypatch.setattr(corpus_pipeline, "learned", once)
    columns = spark.read.parquet(f"{SF}/documents.parquet").columns
    rows = run(spark, SF).collect()
    source = spark.read.parquet(f"{SF}/documents.parquet")
    docs = {r.doc_id: r.text for r in source.collect()}
    toxic = {r.doc_id for r in scored(source.select("doc_id", "text"), model["one"]).collect() if r.score >= 0.7}
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    assert toxic and sum(labels.get(i) == 1 for i in toxic) > len(toxic) / 3
    docs = {i: t for i, t in docs.items() if i not in toxic}
    docs = {i: docs[i] for i, (_, _, kept) in brute(docs.items()).items() if kept}
    cut = brute_words(docs.items(), 50)
    docs = {i: (t if not cut[i][1] else cut[i][2]) for i, t in docs.items() if not cut[i][1] or cut[i][1] < cut[i][0]}
    duck = duckdb.connect()
    duck.register("documents", pd.DataFrame({"doc_id": list(docs), "text": list(docs.values())}))
    duck.execute(f"CREATE VIEW benchmark AS SELECT * FROM read_parquet('{SF}/benchmark.parquet')")
    hits = {r[0] for r in duck.execute(ORACLE).fetchall()}
    assert hits
    docs = {i: t for i, t in docs.items() if i not in hits}
    assert {r.doc_id: r.text for r in rows} == docs
    assert rows[0].asDict().keys() == {*columns, "piece_ids"}
    import sentencepiece

    pieces = sentencepiece.SentencePieceProcessor(model_file=vocabulary_path("piece_bpe_32k.model"))
    assert all(pieces.decode(r.piece_ids) == r.text and r.n_chars == len(r.text) for r in rows[:50])


def test_odd_rows(spark, tmp_path):
    spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = [(None, "a b", "en", "s", 3), (1, None, None, None, None), (2, "", "en", "s", 0), (2, "x y", "en", "s", 3)]
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    for part, n in ((rows, 4), ([], 0)):
        docs = spark.createDataFrame(part, schema)
        for _, stage in STAGES:
            docs = stage(spark, docs, str(tmp_path))
            assert docs.count() == n
