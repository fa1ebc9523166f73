"""All registered queries; importing this package fills the registry."""

import importlib
import pkgutil

from sparksymbols.plans.registry import ORACLE_SQL, QUERIES

for _module in pkgutil.iter_modules(__path__):
    importlib.import_module(f"{__name__}.{_module.name}")

__all__ = ["ORACLE_SQL", "QUERIES"]
