"""Named queries of this subpackage, and the SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import chat, decontaminate, exact_dedup, language, licences, near_dedup, packing, quality, substrings, urls

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_near_dedup": near_dedup.op1_near_dedup,
    "op2_chat_format": chat.op2_chat_format,
    "op3_quality_classifier": quality.op3_quality_classifier,
    "op4_url_filter": urls.op4_url_filter,
    "op5_licence_scan": licences.op5_licence_scan,
    "op6_decontaminate": decontaminate.op6_decontaminate,
    "op7_exact_dedup": exact_dedup.op7_exact_dedup,
    "op8_substring_dedup": substrings.op8_substring_dedup,
    "op9_language_id": language.op9_language_id,
    "op10_best_fit_packing": packing.op10_best_fit_packing,
}
ORACLES: dict[str, str] = {
    "op1_near_dedup": near_dedup.ORACLE,
    "op2_chat_format": chat.ORACLE,
    "op5_licence_scan": licences.ORACLE,
    "op6_decontaminate": decontaminate.ORACLE,
    "op7_exact_dedup": exact_dedup.ORACLE,
    "op8_substring_dedup": substrings.ORACLE,
}
