"""All registered queries."""

from __future__ import annotations

import importlib

from ledgerline.plans.registry import ORACLES, QUERIES

MODULES = [
    "integrity_queries",
    "text_queries",
    "event_queries",
    "selection_queries",
    "config_queries",
    "graph_queries",
    "source_queries",
    "stream_queries",
    "migration_queries",
    "run_queries",
]

for _module in MODULES:
    importlib.import_module(f"ledgerline.plans.{_module}")

__all__ = ["ORACLES", "QUERIES"]
