"""Every registered query of the library, with the SQL that states the same result."""

from __future__ import annotations

import importlib
import pkgutil

from plumbline import operators
from plumbline.plans.registry import ORACLE_SQL, QUERIES

for _module in sorted(m.name for m in pkgutil.iter_modules(operators.__path__)):
    importlib.import_module(f"{operators.__name__}.{_module}")

FLAGSHIP = "rules_order_lines"
__all__ = ["FLAGSHIP", "ORACLE_SQL", "QUERIES"]
