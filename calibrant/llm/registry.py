"""Queries of this subpackage: name to (spark, sf_dir) -> DataFrame, and DuckDB SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from calibrant.llm import chat_format, decontaminate, fingerprints, html_text, language_id, near_dedup, prefix_trie, quality_rules, sentencepiece_codec, substring_dedup, token_files, toxicity, vector_codes


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_sentencepiece": sentencepiece_codec.query,
        "op2_html_text": html_text.query,
        "op3_substring_dedup": substring_dedup.query,
        "op4_near_dedup": near_dedup.query,
        "op5_chat_format": chat_format.query,
        "op6_language_id": language_id.query,
        "op7_token_files": token_files.query,
        "op8_decontaminate": decontaminate.query,
        "op9_toxicity": toxicity.query,
        "op10_quality_rules": quality_rules.query,
        "op11_prefix_trie": prefix_trie.query,
        "op12_fingerprints": fingerprints.query,
        "op13_vector_codes": vector_codes.query,
    }


def oracle_sql() -> dict[str, str]:
    return {"op4_near_dedup": near_dedup.ORACLE, "op8_decontaminate": decontaminate.ORACLE, "op11_prefix_trie": prefix_trie.ORACLE, "op13_vector_codes": vector_codes.ORACLE}
