"""Operators for large text corpora. Nothing else in the library imports this subpackage.

queries() and oracle_sql() list what __spark_entry__.py registers.
"""

from __future__ import annotations

import importlib

#: Module of each operator, in the order of their numbers. A module has a query of its own name
#: and, where SQL can express the query, ORACLE_SQL.
OPERATORS = [
    "op1_langid",
    "op2_suffix",
    "op3_quality",
    "op4_jaccard",
    "op5_shards",
    "op6_decontaminate",
    "op7_lines",
    "op8_secrets",
    "op9_warc",
    "op10_sentencepiece",
]


def queries() -> dict:
    return {name: getattr(importlib.import_module(f"{__name__}.{name}"), name) for name in OPERATORS}


def oracle_sql() -> dict[str, str]:
    found = {name: getattr(importlib.import_module(f"{__name__}.{name}"), "ORACLE_SQL", None) for name in OPERATORS}
    return {name: sql for name, sql in found.items() if sql}
