"""The registered queries of these operators and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import conversation_repair, decontaminate, hard_negatives, host_reputation, language_id, license_scan, line_dedup, lm_scoring, ngram_join, packing, quality_rules, sharding, tensor_minhash


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (
        line_dedup.op1_line_dedup, language_id.op2_language_id, sharding.op3_sharding, packing.op4_packing, ngram_join.op5_ngram_join,
        host_reputation.op6_host_reputation, license_scan.op7_license_scan, quality_rules.op8_quality_rules, lm_scoring.op9_lm_scoring,
        decontaminate.op10_decontaminate, tensor_minhash.op11_minhash_dedup, hard_negatives.op12_hard_negatives, conversation_repair.op13_conversation_repair)}


def oracle_sql() -> dict[str, str]:
    return {
        "op1_line_dedup": line_dedup.ORACLE_SQL,
        "op6_host_reputation": host_reputation.ORACLE_SQL,
        "op7_license_scan": license_scan.ORACLE_SQL,
        "op8_quality_rules": quality_rules.ORACLE_SQL,
        "op10_decontaminate": decontaminate.ORACLE_SQL,
        "op11_minhash_dedup": tensor_minhash.ORACLE_SQL,
        "op12_hard_negatives": hard_negatives.ORACLE_SQL,
    }
