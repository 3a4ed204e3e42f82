"""All queries over the driver tables and their DuckDB twins."""

from __future__ import annotations

import importlib

FLAGSHIP = "regime_activation"
QUERIES: dict = {}
ORACLES: dict = {}
for _name in ("corpus", "regimes", "panels", "statistics", "comparisons", "topics", "checks"):
    _m = importlib.import_module(f"tidemark.plans.{_name}")
    QUERIES |= _m.Q
    ORACLES |= _m.O
