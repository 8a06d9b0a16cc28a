"""The queries of this subpackage, by name, and the SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

#: Query name and the module that holds it; a module may have ORACLE_SQL.
MODULES = {
    "op1_fingerprints": "op1_fingerprints",
    "op2_quality": "op2_quality",
    "op3_sharding": "op3_sharding",
    "op4_tool_calls": "op4_tool_calls",
    "op5_decontamination": "op5_decontamination",
    "op6_jaccard": "op6_jaccard",
    "op7_packing": "op7_packing",
    "op8_url_filter": "op8_url_filter",
    "op9_toxicity": "op9_toxicity",
    "op10_language": "op10_language",
    "op11_importance": "op11_importance",
    "op12_search": "op12_search",
    "op13_token_files": "op13_token_files",
}


def queries() -> dict[str, Callable]:
    return {name: import_module(f"lodewell.llm.{module}").query for name, module in MODULES.items()}


def oracle_sql() -> dict[str, str]:
    found = {name: getattr(import_module(f"lodewell.llm.{module}"), "ORACLE_SQL", None) for name, module in MODULES.items()}
    return {name: sql for name, sql in found.items() if sql}
