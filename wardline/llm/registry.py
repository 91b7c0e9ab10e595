"""Queries of this package and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from wardline.llm import bpe_codec, chat_format, embedding_dedup, fill_middle, language_id, license_scan, merkle_manifest, packing, quality, simhash_dedup, substring_dedup, topk_search, toxicity


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_substring_dedup": substring_dedup.query,
        "op2_quality_classifier": quality.query,
        "op3_embedding_dedup": embedding_dedup.query,
        "op4_language_id": language_id.query,
        "op5_simhash_dedup": simhash_dedup.query,
        "op6_best_fit_packing": packing.query,
        "op7_topk_search": topk_search.query,
        "op8_bpe_codec": bpe_codec.query,
        "op9_chat_format": chat_format.query,
        "op10_license_scan": license_scan.query,
        "op11_toxic_spans": toxicity.query,
        "op12_fill_middle": fill_middle.query,
        "op13_merkle_manifest": merkle_manifest.query,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_substring_dedup": substring_dedup.ORACLE_SQL,
        "op7_topk_search": topk_search.ORACLE_SQL,
        "op9_chat_format": chat_format.ORACLE_SQL,
        "op12_fill_middle": fill_middle.ORACLE_SQL,
        "op13_merkle_manifest": merkle_manifest.ORACLE_SQL,
    }
