"""The queries of this subpackage and their SQL."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from caresift.llm import chat, divergence, exact_dedup, lexical, sharding

_MODULES = {
    "op1_best_fit_packing": "packing",
    "op2_order_minhash": "order_minhash",
    "op3_secret_scan": "secret_scan",
    "op4_ngram_jaccard": "ngram_join",
    "op5_rendezvous_sharding": "sharding",
    "op6_media_tiles": "media",
    "op7_byte_bpe": "byte_bpe",
    "op8_suffix_repeats": "suffix_repeats",
    "op9_chat_format": "chat",
    "op10_quality_ftrl": "quality",
    "op11_exact_dedup": "exact_dedup",
    "op12_source_divergence": "divergence",
    "op13_lexical_search": "lexical",
}


def _query(module: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: importlib.import_module(f"caresift.llm.{module}").query(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: _query(module) for name, module in _MODULES.items()}


def oracle_sql() -> dict[str, str]:
    modules = {"op5_rendezvous_sharding": sharding, "op9_chat_format": chat, "op11_exact_dedup": exact_dedup, "op12_source_divergence": divergence, "op13_lexical_search": lexical}
    return {name: module.ORACLE_SQL for name, module in modules.items()}
