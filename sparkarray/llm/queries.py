"""All queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

import importlib
import pkgutil

QUERIES: dict = {}
ORACLE_SQL: dict = {}
for _found in sorted(pkgutil.iter_modules(__path__ if "__path__" in globals() else importlib.import_module(__package__).__path__), key=lambda m: m.name):
    if _found.name != "queries":
        _module = importlib.import_module(f"{__package__}.{_found.name}")
        QUERIES.update(getattr(_module, "QUERIES", {}))
        ORACLE_SQL.update(getattr(_module, "ORACLE_SQL", {}))
