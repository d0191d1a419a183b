"""Registered queries of this subpackage and, where SQL can state them, their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import decontaminate
from tidemark.llm.alignment import op13_token_alignment
from tidemark.llm.decontaminate import op10_benchmark_decontamination
from tidemark.llm.html_text import op9_html_extraction
from tidemark.llm.jaccard_join import op11_jaccard_join
from tidemark.llm.near_dedup import op8_near_dedup
from tidemark.llm.quality import op2_quality_rules
from tidemark.llm.sentencepieces import op4_sentencepiece
from tidemark.llm.substring_dedup import op1_substring_dedup
from tidemark.llm.suffix_dedup import op7_suffix_dedup
from tidemark.llm.token_counts import op6_token_counts
from tidemark.llm.toxicity import op5_toxicity
from tidemark.llm.wavelet import op3_wavelet_shards
from tidemark.llm.whitening import op12_whitening

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    fn.__name__: fn
    for fn in (
        op1_substring_dedup,
        op2_quality_rules,
        op3_wavelet_shards,
        op4_sentencepiece,
        op5_toxicity,
        op6_token_counts,
        op7_suffix_dedup,
        op8_near_dedup,
        op9_html_extraction,
        op10_benchmark_decontamination,
        op11_jaccard_join,
        op12_whitening,
        op13_token_alignment,
    )
}

ORACLES: dict[str, str] = {"op10_benchmark_decontamination": decontaminate.ORACLE}
