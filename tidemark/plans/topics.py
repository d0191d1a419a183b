"""Topic model of a corpus: term weights, factorisation and document topics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from tidemark.operators import nmf, tfidf
from tidemark.runtime import cut_lineage


def run_topic_model(
    df: DataFrame,
    key: str,
    clean: str,
    topics: int = 20,
    max_features: int = tfidf.MAX_FEATURES,
    max_iter: int = 400,
    stop_words: Sequence[str] | None = None,
    min_documents: int = tfidf.MIN_DOCUMENTS,
    max_share: float = tfidf.MAX_SHARE,
    seed: int = 42,
) -> tuple[DataFrame, nmf.TopicModel]:
    """Document topics ``(key, weights)`` of every document, and the model.

    Vocabulary and topics are fitted on all documents. Texts and sparse rows are written once, since every iteration reads the latter.
    """
    words = tfidf.document_words(df, key, clean)
    names, idf = tfidf.collected(tfidf.vocabulary(words, stop_words, max_features, min_documents, max_share))
    docs = cut_lineage(tfidf.sparse_rows(words, key, names, idf, stop_words))
    model = nmf.fit_topics(docs, names, topics, max_iter, seed=seed)
    return nmf.document_topics(docs, key, model), model
