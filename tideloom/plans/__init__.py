"""Registered queries and multi-statement SQL jobs."""

from __future__ import annotations

import importlib

_MODULES = (
    "window_queries",
    "join_queries",
    "sql_queries",
    "function_queries",
    "flow_queries",
    "stream_queries",
)


def load_all():
    """Import every query module and return (queries, oracle SQL)."""
    for name in _MODULES:
        importlib.import_module(f"{__name__}.{name}")
    from tideloom.plans.registry import ORACLES, QUERIES

    return QUERIES, ORACLES
