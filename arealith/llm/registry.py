"""Queries of the subpackage, by name, and their DuckDB twins where SQL can say them."""

from __future__ import annotations

from importlib import import_module

#: Query name and the module of ``arealith.llm.queries`` that holds it (function ``run``, optional ``SQL``).
NAMES = {
    "op1_mixing": "mixing",
    "op2_warc": "warc",
    "op3_jpeg": "media",
    "op4_language": "language",
    "op5_toxicity": "toxicity",
    "op6_prob_minhash": "neardup",
    "op7_sentencepiece": "pieces",
    "op8_chat": "chat",
    "op9_grid_join": "vectors",
    "op10_quality": "quality",
    "op11_merkle": "merkle",
    "op12_suffix_array": "repeats",
    "op13_dual_tree": "lexical",
}


def _modules():
    return {name: import_module(f"arealith.llm.queries.{module}") for name, module in NAMES.items()}


def queries():
    return {name: m.run for name, m in _modules().items()}


def oracle_sql():
    return {name: m.SQL for name, m in _modules().items() if getattr(m, "SQL", None)}
