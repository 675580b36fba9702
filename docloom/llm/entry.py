"""Queries of the training-data operators, and the SQL of those that SQL can express.

A module whose library is not installed (a tokenizer, say) is left out with a warning; the others stay.
"""

from __future__ import annotations

import warnings
from collections.abc import Callable
from importlib import import_module
from types import ModuleType

from pyspark.sql import DataFrame, SparkSession

#: Query name -> module of this subpackage.
QUERIES = {
    "p1_found": "cross_split",
    "p1_report": "cross_split",
    "p1_spans": "cross_split",
    "p2_found": "grouped_splits",
    "p2_splits": "grouped_splits",
    "p3_found": "consensus",
    "p3_agreement": "consensus",
    "p3_annotators": "consensus",
    "p3_overall": "consensus",
    "p4_found": "repeated_lines",
    "p4_clean": "repeated_lines",
    "p4_lines": "repeated_lines",
    "p4_near": "repeated_lines",
    "p5_found": "token_budget",
    "p5_totals": "token_budget",
    "p6_found": "scanned_pages",
    "p6_text": "scanned_pages",
    "p7_found": "split_oversized",
    "p7_pieces": "split_oversized",
    "p8_ids": "encode",
    "p9_found": "leaks",
    "p9_items": "leaks",
    "p10_found": "shared_spans",
    "p10_spans": "shared_spans",
}


def _modules() -> dict[str, ModuleType]:
    found: dict[str, ModuleType] = {}
    for name in dict.fromkeys(QUERIES.values()):
        try:
            found[name] = import_module(f"docloom.llm.{name}")
        except ImportError as missing:
            warnings.warn(f"docloom.llm.{name} is left out: {missing}")
    return found


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    modules = _modules()
    return {name: getattr(modules[module], name) for name, module in QUERIES.items() if module in modules}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in _modules().values() for name, sql in getattr(module, "SQL", {}).items()}
