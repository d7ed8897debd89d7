"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from lodestone.llm import ann, chat, cws, maxent, packing, pieces, pii, quality, simhash, suffix

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    return {
        "op1_projected_neighbours": ann.op1_projected_neighbours,
        "op2_pii": pii.op2_pii,
        "op3_quality_classifier": quality.op3_quality_classifier,
        "op4_document_fingerprints": cws.op4_document_fingerprints,
        "op5_simhash_near_dedup": simhash.op5_simhash_near_dedup,
        "op6_lm_scoring": maxent.op6_lm_scoring,
        "op7_best_fit_packing": packing.op7_best_fit_packing,
        "op8_sentencepiece": pieces.op8_sentencepiece,
        "op9_suffix_array_dedup": suffix.op9_suffix_array_dedup,
        "op10_chat_formatting": chat.op10_chat_formatting,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    """SQL for the queries that SQL expresses whole; the rest are tested against brute force in tests/llm."""
    return chat.ORACLE
