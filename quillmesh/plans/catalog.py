"""All queries and their SQL, collected from the areas."""

from __future__ import annotations

import importlib

AREAS = ("lexical", "scalars", "graphs", "dependencies", "ledgers", "packs", "routes")
QUERIES: dict = {}
ORACLE: dict = {}
for _area in AREAS:
    _module = importlib.import_module(f"quillmesh.plans.{_area}")
    QUERIES |= _module.QUERIES
    ORACLE |= _module.ORACLE
