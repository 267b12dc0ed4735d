"""Assembles the query registry and the oracle SQL from all plan modules."""

from __future__ import annotations

import importlib

_QUERY_MODULES = ["queries"]
_ORACLE_MODULES = ["oracle", "oracle_content", "oracle_vectors", "oracle_hybrid", "oracle_eval", "oracle_browse", "oracle_live"]


def all_queries() -> dict:
    reg = {}
    for m in _QUERY_MODULES:
        reg = importlib.import_module(f"{__package__}.{m}").REGISTRY
    return dict(reg)


def all_oracles() -> dict:
    for m in _ORACLE_MODULES:
        importlib.import_module(f"{__package__}.{m}")
    from .oracle import ORACLE
    return dict(ORACLE)
