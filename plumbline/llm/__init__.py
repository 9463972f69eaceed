"""Operators of a training-data pipeline. Nothing outside this package imports it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from plumbline.llm import audio, bit_codes, conversations, exact_dedup, jaccard_join, licences, line_dedup, mixing, packing, quality, suffix_dedup, toxicity, vector_codes

_QUERIES = {
    "op1_exact_dedup": (exact_dedup.op1_exact_dedup, exact_dedup.ORACLE_SQL),
    "op2_jaccard_join": (jaccard_join.op2_jaccard_join, None),
    "op3_suffix_dedup": (suffix_dedup.op3_suffix_dedup, None),
    "op4_packing": (packing.op4_packing, None),
    "op5_audio": (audio.op5_audio, None),
    "op6_line_dedup": (line_dedup.op6_line_dedup, line_dedup.ORACLE_SQL),
    "op7_source_mixing": (mixing.op7_source_mixing, mixing.ORACLE_SQL),
    "op8_licences": (licences.op8_licences, licences.ORACLE_SQL),
    "op9_toxicity": (toxicity.op9_toxicity, None),
    "op10_quality": (quality.op10_quality, None),
    "op11_vector_codes": (vector_codes.op11_vector_codes, vector_codes.ORACLE_SQL),
    "op12_prefix_trie": (conversations.op12_prefix_trie, conversations.ORACLE_SQL),
    "op13_bit_codes": (bit_codes.op13_bit_codes, bit_codes.ORACLE_SQL),
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: query for name, (query, _) in _QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _QUERIES.items() if sql}
