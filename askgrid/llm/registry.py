"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from askgrid.llm import (
    byte_bpe,
    decontamination,
    fingerprints,
    html_text,
    jaccard,
    oracles,
    quality,
    sharding,
    spelling,
    substrings,
    suffix_sort,
    suffix_tree,
    url_filters,
    whitening,
)


def all_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_substrings": substrings.op1_substrings,
        "op2_html_text": html_text.op2_html_text,
        "op3_url_filters": url_filters.op3_url_filters,
        "op4_sharding": sharding.op4_sharding,
        "op5_jaccard": jaccard.op5_jaccard,
        "op6_byte_bpe": byte_bpe.op6_byte_bpe,
        "op7_suffix_tree": suffix_tree.op7_suffix_tree,
        "op8_decontamination": decontamination.op8_decontamination,
        "op9_fingerprints": fingerprints.op9_fingerprints,
        "op10_quality": quality.op10_quality,
        "op11_whitening": whitening.op11_whitening,
        "op12_suffix_sort": suffix_sort.op12_suffix_sort,
        "op13_spelling": spelling.op13_spelling,
        "pipeline": corpus_pipeline.run,
    }


def all_oracles() -> dict[str, str]:
    return oracles.all_oracles()
