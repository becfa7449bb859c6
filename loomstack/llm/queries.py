"""Queries and oracle SQL of this package, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from loomstack.llm import chat, decontaminate, language_id, line_dedup, mixing, near_dup, quality, substring_dedup, token_count, warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_pareto_mix": mixing.op1_pareto_mix,
    "op2_substring_dedup": substring_dedup.op2_substring_dedup,
    "op3_quality_rules": quality.op3_quality_rules,
    "op4_token_count": token_count.op4_token_count,
    "op5_minhash_near_dup": near_dup.op5_minhash_near_dup,
    "op6_line_dedup": line_dedup.op6_line_dedup,
    "op7_language_id": language_id.op7_language_id,
    "op8_preferences": chat.op8_preferences,
    "op9_decontaminate": decontaminate.op9_decontaminate,
    "op10_warc": warc.op10_warc,
}

ORACLE: dict[str, str] = {
    "op1_pareto_mix": mixing.OP1_SQL,
    "op2_substring_dedup": substring_dedup.OP2_SQL,
    "op3_quality_rules": quality.OP3_SQL,
    "op5_minhash_near_dup": near_dup.OP5_SQL,
    "op6_line_dedup": line_dedup.OP6_SQL,
    "op8_preferences": chat.OP8_SQL,
    "op10_warc": warc.OP10_SQL,
}
