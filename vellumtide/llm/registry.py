"""The operators' queries, and SQL for those that SQL can express."""

from __future__ import annotations

import importlib

#: Query name, module and whether the module has an ORACLE.
_QUERIES = {
    "op1_suffixdedup": ("suffixdedup", False),
    "op2_packing": ("packing", False),
    "op3_langid": ("langid", False),
    "op4_toxicity": ("toxicity", False),
    "op5_fingerprints": ("fingerprints", False),
    "op6_ann": ("annindex", False),
    "op7_warcaudit": ("warcaudit", True),
    "op8_pii": ("pii", False),
    "op9_jaccard": ("jaccard", False),
    "op10_mixing": ("mixing", True),
}


def _module(name: str):
    return importlib.import_module(f"vellumtide.llm.{name}")


def queries() -> dict:
    return {q: getattr(_module(m), q) for q, (m, _) in _QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {q: _module(m).ORACLE for q, (m, sql) in _QUERIES.items() if sql}
