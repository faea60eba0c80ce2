"""Queries and oracle SQL of this subpackage, by name."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

#: query: module of this subpackage that defines a function of the same name
WHERE = {
    "op1_embedding_near_dedup": "embedding_dedup",
    "op2_url_filters": "url_filter",
    "op3_minhash_near_dedup": "minhash_dedup",
    "op5_best_fit_packing": "packing",
    "op9_chat_formatting": "chat",
    "op10_html_extraction": "html_text",
    "op7_quality_classifier": "quality",
    "op6_source_mixing": "mixing",
    "op8_suffix_array_dedup": "suffix_dedup",
    "op4_approximate_nearest_neighbours": "neighbours",
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: getattr(import_module(f"{__package__}.{module}"), name) for name, module in WHERE.items()}


def oracle_sql() -> dict[str, str]:
    """SQL of those queries that SQL can express on whole tables."""
    out = {}
    for name, module in WHERE.items():
        sql = getattr(import_module(f"{__package__}.{module}"), "ORACLE_SQL", None)
        if sql:
            out[name] = sql
    return out
