"""The subpackage's queries by name, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

_MODULES = {
    "op1_warc_captures": "warc",
    "op2_scaled_fingerprints": "fingerprint",
    "op3_superminhash_near_dedup": "near_dedup",
    "op4_ppm_scores": "ppm",
    "op5_projected_neighbours": "neighbours",
    "op6_rule_quality": "quality",
    "op7_language_id": "language",
    "op8_length_buckets": "packing",
    "op9_mix_sources": "mixing",
    "op10_paragraph_dedup": "substring",
    "op11_ftrl_toxicity": "toxicity",
    "op12_vector_codes": "codes",
    "op13_fill_in_middle": "infill",
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: getattr(import_module(f"{__package__}.{module}"), name) for name, module in _MODULES.items()}


def oracle_sql() -> dict[str, str]:
    found = {name: getattr(import_module(f"{__package__}.{module}"), "ORACLE_SQL", None) for name, module in _MODULES.items()}
    return {name: sql for name, sql in found.items() if sql}
