"""Named queries over the driver's tables, and the SQL that gives the same rows."""

from __future__ import annotations

from importlib import import_module

MODULES = ("scalars", "relational", "trees", "clusters", "files")

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
for _name in MODULES:
    _module = import_module(f"dendrospark.plans.{_name}")
    QUERIES |= _module.QUERIES
    ORACLE |= _module.ORACLE
