"""Queries of this package, and SQL for those that SQL can express."""

from __future__ import annotations

from importlib import import_module

_QUERIES = {"op1_decontamination": "decontaminate", "op2_mpeg_audio": "mpeg", "op3_passages": "passages", "op4_toxicity": "toxicity", "op5_simhash": "simhash", "op6_html_text": "html", "op7_packing": "packing", "op8_quality": "quality", "op9_secrets": "secrets", "op10_language": "language", "op11_prefix_trie": "prefix_trie", "op12_alignment": "alignment", "op13_best_fit": "best_fit"}


def queries() -> dict:
    return {name: getattr(import_module(f".{module}", __package__), name) for name, module in _QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    out: dict[str, str] = {}
    for module in dict.fromkeys(_QUERIES.values()):
        out |= getattr(import_module(f".{module}", __package__), "ORACLE", {})
    return out
