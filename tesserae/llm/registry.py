"""Queries of the training-data operators and, where SQL can express them, their SQL."""

from __future__ import annotations

import importlib

#: Query name -> module of this subpackage that has a function of that name, and its SQL as ORACLE_SQL if any.
MODULES = {
    "op1_pivot_near_dedup": "pivots",
    "op2_tag_path_text": "html",
    "op3_systematic_mix": "mixing",
    "op4_surrogates": "pii",
    "op5_attention_lm": "lm",
    "op6_ordinal_quality": "quality",
    "op7_minhash_near_dedup": "minhash",
    "op8_suffix_decontamination": "decontaminate",
    "op9_url_lists": "urls",
    "op10_secret_ownership": "secrets",
}


def _query(name: str, module: str):
    def run(spark, sf_dir):
        return getattr(importlib.import_module(f"tesserae.llm.{module}"), name)(spark, sf_dir)

    return run


def _pipeline(spark, sf_dir):
    return importlib.import_module("corpus_pipeline").run(spark, sf_dir)


def queries() -> dict:
    return {name: _query(name, module) for name, module in MODULES.items()} | {"pipeline": _pipeline}


def oracle_sql() -> dict[str, str]:
    found = {}
    for name, module in MODULES.items():
        sql = getattr(importlib.import_module(f"tesserae.llm.{module}"), "ORACLE_SQL", None)
        if sql:
            found[name] = sql
    sql = importlib.import_module("corpus_pipeline").ORACLE_SQL
    return found | ({"pipeline": sql} if sql else {})
