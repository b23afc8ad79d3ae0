"""The registered queries of this subpackage, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontaminate, jaccard, language, pieces, pii, quality, secrets, substrings, topk, toxicity


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_top_k": topk.op1_top_k,
        "op2_decontaminate": decontaminate.op2_decontaminate,
        "op3_near_duplicates": jaccard.op3_near_duplicates,
        "op4_pieces": pieces.op4_pieces,
        "op5_quality": quality.op5_quality,
        "op6_pii": pii.op6_pii,
        "op7_secrets": secrets.op7_secrets,
        "op8_substrings": substrings.op8_substrings,
        "op9_toxicity": toxicity.op9_toxicity,
        "op10_language": language.op10_language,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_top_k": topk.OP1_SQL,
        "op2_decontaminate": decontaminate.OP2_SQL,
        "op3_near_duplicates": jaccard.OP3_SQL,
        "op8_substrings": substrings.OP8_SQL,
    }
