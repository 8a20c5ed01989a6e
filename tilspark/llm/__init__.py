"""Operators of a training-data pipeline.  Nothing else in the library imports this package."""

from __future__ import annotations

import importlib

#: query name -> module with ``query(spark, sf_dir)`` and ``SQL`` (None where SQL can't express it)
MODULES = {
    "op1_html_extraction": "op1_html_extraction",
    "op2_jaccard_join": "op2_jaccard_join",
    "op3_nearest": "op3_nearest",
    "op4_quality_rules": "op4_quality_rules",
    "op5_suffix_dedup": "op5_suffix_dedup",
    "op6_token_counts": "op6_token_counts",
    "op7_mix_sources": "op7_mix_sources",
    "op8_byte_bpe": "op8_byte_bpe",
    "op9_line_dedup": "op9_line_dedup",
    "op10_substring_dedup": "op10_substring_dedup",
}


#: imported with the package, so that whoever guards its import guards theirs
_LOADED = {name: importlib.import_module(f"{__name__}.{module}") for name, module in MODULES.items()}


def queries() -> dict:
    return {name: module.query for name, module in _LOADED.items()}


def oracle_sql() -> dict[str, str]:
    found = {name: module.SQL for name, module in _LOADED.items()}
    return {name: sql for name, sql in found.items() if sql}
