"""The registered queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

import importlib

_NAMES = {
    "op1_minhash_dedup": "minhash_dedup",
    "op2_quality_classifier": "quality",
    "op3_toxicity": "toxicity",
    "op4_pii": "pii",
    "op5_language_id": "language",
    "op6_vp_tree_search": "vptree",
    "op7_backoff_scores": "lm_score",
    "op8_substring_dedup": "substring_dedup",
    "op9_decontamination": "decontaminate",
    "op10_source_mix": "source_mix",
}


def _caller(module: str, name: str):
    def call(spark, sf_dir):
        return getattr(importlib.import_module(f"sumloom.llm.{module}"), name)(spark, sf_dir)

    return call


def queries() -> dict:
    return {name: _caller(module, name) for name, module in _NAMES.items()}


def oracle_sql() -> dict[str, str]:
    modules = ("op1_minhash_dedup", "op6_vp_tree_search", "op7_backoff_scores", "op8_substring_dedup", "op10_source_mix")
    return {name: importlib.import_module(f"sumloom.llm.{_NAMES[name]}").ORACLE_SQL for name in modules}
