"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, chat, html, jaccard, licenses, line_dedup, mixing, mtree, quality, substring_dedup

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {
    "op1_byte_bpe": bpe.op1_byte_bpe,
    "op2_line_dedup": line_dedup.op2_line_dedup,
    "op3_chat_format": chat.op3_chat_format,
    "op4_mixing": mixing.op4_mixing,
    "op5_html_text": html.op5_html_text,
    "op6_top_k": mtree.op6_top_k,
    "op7_quality_rules": quality.op7_quality_rules,
    "op8_substring_dedup": substring_dedup.op8_substring_dedup,
    "op9_jaccard_join": jaccard.op9_jaccard_join,
    "op10_license_scan": licenses.op10_license_scan,
}

ORACLE_SQL: dict[str, str] = {
    "op2_line_dedup": line_dedup.OP2_SQL,
    "op3_chat_format": chat.OP3_SQL,
    "op4_mixing": mixing.OP4_SQL,
    "op6_top_k": mtree.OP6_SQL,
    "op7_quality_rules": quality.OP7_SQL,
    "op9_jaccard_join": jaccard.OP9_SQL,
    "op10_license_scan": licenses.OP10_SQL,
}
