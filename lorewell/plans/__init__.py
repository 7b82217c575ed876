"""Registered queries and their oracle SQL, one module per area."""

from __future__ import annotations

import importlib

MODULES: tuple[str, ...] = ("corpus", "retrieval", "knowledge", "semantic", "streams")

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
for _name in MODULES:
    _module = importlib.import_module(f"{__package__}.{_name}")
    QUERIES |= _module.QUERIES
    ORACLES |= _module.ORACLES
