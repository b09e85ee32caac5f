"""Registered queries of the operators, one per operator, and their SQL."""

from __future__ import annotations

from importlib import import_module

_MODULES = ["queries", "pipeline"]

QUERIES: dict = {}
SQL: dict = {}
for _name in _MODULES:
    _module = import_module(f"{__name__}.{_name}")
    QUERIES |= _module.QUERIES
    SQL |= _module.SQL
