"""The queries of the training-data operators and their SQL."""

from __future__ import annotations

import importlib

#: Query name -> module of this subpackage; each has query(spark, sf_dir) and may have ORACLE_SQL.
MODULES = {
    "op1_token_counts": "tokencount",
    "op2_decontamination": "decontaminate",
    "op3_near_duplicates": "neardup",
    "op4_language_id": "langid",
    "op5_warc": "warc",
    "op6_sentencepiece": "pieces",
    "op7_personal_data": "pii",
    "op8_quality_rules": "quality",
    "op9_substring_dedup": "substrings",
    "op10_quality_classifier": "ordinal",
    "op11_nearest_neighbours": "neighbours",
    "op12_token_alignment": "alignment",
    "op13_fill_in_middle": "fim",
}


def _lazy(module: str):
    def run(spark, sf_dir):
        return importlib.import_module(f"{__package__}.{module}").query(spark, sf_dir)

    return run


def queries() -> dict:
    return {name: _lazy(module) for name, module in MODULES.items()}


def oracle_sql() -> dict:
    found = {name: getattr(importlib.import_module(f"{__package__}.{module}"), "ORACLE_SQL", None) for name, module in MODULES.items()}
    return {name: sql for name, sql in found.items() if sql}
