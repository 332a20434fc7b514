"""Queries of this subpackage for the entry module, and their SQL."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

MODULES = {
    "op1_ngram_jaccard_join": "ngram_join",
    "op2_toxicity": "toxicity",
    "op3_lm_scoring": "lm_scoring",
    "op4_sharding": "sharding",
    "op5_exact_topk": "exact_topk",
    "op6_language_id": "language_id",
    "op7_pii": "pii",
    "op8_suffix_dedup": "suffix_dedup",
    "op9_packing": "packing",
    "op10_decontamination": "decontamination",
    "op11_conversation_trie": "conversation_trie",
    "op12_merkle_manifest": "merkle",
    "op13_url_filters": "url_filters",
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    out = {name: getattr(importlib.import_module(f"{__package__}.{module}"), name) for name, module in MODULES.items()}
    return out | {"pipeline": importlib.import_module("corpus_pipeline").run}
