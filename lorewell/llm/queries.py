"""All queries of this subpackage, and the SQL of those that SQL can express."""

from __future__ import annotations

import importlib

MODULES = ("langid", "spans", "sharding", "simhash", "winnow", "embeddings", "toxicity", "packing", "tokens")

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
for name in MODULES:
    module = importlib.import_module(f"{__package__}.{name}")
    QUERIES |= module.QUERIES
    ORACLES |= module.ORACLES
