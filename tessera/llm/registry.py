"""Queries of the text operators, and the SQL that checks those that SQL can express."""

from __future__ import annotations

from tessera.llm import chat_format, decontaminate, exact_dedup, language_id, license_scan, line_dedup, near_dedup, packing, substring_dedup, url_filter


def queries() -> dict:
    return {
        "op1_exact_dedup": exact_dedup.op1_exact_dedup,
        "op2_language_id": language_id.op2_language_id,
        "op3_license_scan": license_scan.op3_license_scan,
        "op4_chat_format": chat_format.op4_chat_format,
        "op5_benchmark_decontamination": decontaminate.op5_benchmark_decontamination,
        "op6_substring_dedup": substring_dedup.op6_substring_dedup,
        "op7_packing": packing.op7_packing,
        "op8_url_filter": url_filter.op8_url_filter,
        "op9_line_dedup": line_dedup.op9_line_dedup,
        "op10_ngram_jaccard_join": near_dedup.op10_ngram_jaccard_join,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_exact_dedup": exact_dedup.ORACLE_SQL,
        "op3_license_scan": license_scan.ORACLE_SQL,
        "op4_chat_format": chat_format.ORACLE_SQL,
        "op6_substring_dedup": substring_dedup.ORACLE_SQL,
    }
