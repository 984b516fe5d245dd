"""The queries of this subpackage, and the SQL that gives the same rows where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import chat_format, collocations, conversation_repair, embedding_dedup, language, license_scan, line_dedup, mixing, near_dedup, packing, personal_data, quality, url_filters

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_rules": quality.op1_quality_rules,
    "op2_embedding_dedup": embedding_dedup.op2_embedding_dedup,
    "op3_license_scan": license_scan.op3_license_scan,
    "op4_near_dedup": near_dedup.op4_near_dedup,
    "op5_packing": packing.op5_packing,
    "op6_language_id": language.op6_language_id,
    "op7_chat_format": chat_format.op7_chat_format,
    "op8_url_filters": url_filters.op8_url_filters,
    "op9_line_dedup": line_dedup.op9_line_dedup,
    "op10_mixing": mixing.op10_mixing,
    "op11_collocations": collocations.op11_collocations,
    "op12_conversation_repair": conversation_repair.op12_conversation_repair,
    "op13_personal_data": personal_data.op13_personal_data,
}

ORACLES: dict[str, str] = {
    "op1_quality_rules": quality.OP1_SQL,
    "op2_embedding_dedup": embedding_dedup.OP2_SQL,
    "op3_license_scan": license_scan.OP3_SQL,
    "op4_near_dedup": near_dedup.OP4_SQL,
    "op7_chat_format": chat_format.OP7_SQL,
    "op8_url_filters": url_filters.OP8_SQL,
    "op9_line_dedup": line_dedup.OP9_SQL,
    "op10_mixing": mixing.OP10_SQL,
    "op11_collocations": collocations.OP11_SQL,
    "op12_conversation_repair": conversation_repair.OP12_SQL,
}
