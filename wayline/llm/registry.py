"""The corpus queries and their SQL, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from wayline.llm import chat, divergence, exact_dedup, lm_scoring, manifest, mixing, near_dedup, nearest, pieces, privacy, quality, substring, toxicity


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_substring_dedup": substring.op1_substring_dedup,
        "op2_nearest_neighbours": nearest.op2_nearest_neighbours,
        "op3_sentencepiece": pieces.op3_sentencepiece,
        "op4_lm_score": lm_scoring.op4_lm_score,
        "op4_lm_score_order2": lm_scoring.op4_lm_score_order2,
        "op5_toxicity": toxicity.op5_toxicity,
        "op6_exact_dedup": exact_dedup.op6_exact_dedup,
        "op7_near_dedup": near_dedup.op7_near_dedup,
        "op8_personal_data": privacy.op8_personal_data,
        "op9_chat_format": chat.op9_chat_format,
        "op10_mix_sources": mixing.op10_mix_sources,
        "op11_merkle_manifest": manifest.op11_merkle_manifest,
        "op12_source_divergence": divergence.op12_source_divergence,
        "op13_quality": quality.op13_quality,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_substring_dedup": substring.OP1_SQL,
        "op4_lm_score": lm_scoring.OP4_SQL,
        "op4_lm_score_order2": lm_scoring.OP4_ORDER2_SQL,
        "op6_exact_dedup": exact_dedup.OP6_SQL,
        "op7_near_dedup": near_dedup.OP7_SQL,
        "op9_chat_format": chat.OP9_SQL,
        "op10_mix_sources": mixing.OP10_SQL,
        "op11_merkle_manifest": manifest.OP11_SQL,
        "op12_source_divergence": divergence.OP12_SQL,
    }
