"""The queries of the training-data operators, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from slotgram.llm import chat_format, decontaminate, mixing, near_dedup, quality, secrets, substring_dedup, suffix_dedup, tokens, url_filters

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_chat_formatting": chat_format.query,
    "op2_substring_dedup": substring_dedup.query,
    "op3_quality_rules": quality.query,
    "op4_url_filters": url_filters.query,
    "op5_source_mixing": mixing.query,
    "op6_secret_scans": secrets.query,
    "op7_suffix_dedup": suffix_dedup.query,
    "op8_token_counts": tokens.query,
    "op9_decontamination": decontaminate.query,
    "op10_near_dedup": near_dedup.query,
}
ORACLE_SQL: dict[str, str] = {
    "op1_chat_formatting": chat_format.SQL,
    "op2_substring_dedup": substring_dedup.SQL,
    "op3_quality_rules": quality.SQL,
    "op4_url_filters": url_filters.SQL,
    "op5_source_mixing": mixing.SQL,
    "op7_suffix_dedup": suffix_dedup.SQL,
    "op9_decontamination": decontaminate.SQL,
    "op10_near_dedup": near_dedup.SQL,
}
