"""The numbered queries and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lodeweave.llm import bpe, chat_format, conversation_repair, decontaminate, fingerprint, html_text, jaccard_join, language, line_dedup, suffix_dedup, token_files, url_filter, whitening


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_ngram_jaccard_join": jaccard_join.op1_ngram_jaccard_join,
        "op2_line_dedup": line_dedup.op2_line_dedup,
        "op3_fingerprint": fingerprint.op3_fingerprint,
        "op4_html_extraction": html_text.op4_html_extraction,
        "op5_token_files": token_files.op5_token_files,
        "op6_bpe": bpe.op6_bpe,
        "op7_language_id": language.op7_language_id,
        "op8_url_filter": url_filter.op8_url_filter,
        "op9_decontamination": decontaminate.op9_decontamination,
        "op10_suffix_dedup": suffix_dedup.op10_suffix_dedup,
        "op11_embedding_whitening": whitening.op11_embedding_whitening,
        "op12_chat_format": chat_format.op12_chat_format,
        "op13_conversation_repair": conversation_repair.op13_conversation_repair,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_ngram_jaccard_join": jaccard_join.ORACLE_SQL,
        "op2_line_dedup": line_dedup.ORACLE_SQL,
        "op8_url_filter": url_filter.ORACLE_SQL,
        "op10_suffix_dedup": suffix_dedup.ORACLE_SQL,
        "op12_chat_format": chat_format.ORACLE_SQL,
    }
