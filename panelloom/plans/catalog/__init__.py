"""Named queries over the given tables, each with SQL to check it by."""

from __future__ import annotations

from importlib import import_module

from panelloom.plans.catalog.registry import ORACLES, QUERIES

for _area in ("build", "coverage", "profile", "temporal", "splits", "prep", "evaluation", "learning"):
    import_module(f"panelloom.plans.catalog.{_area}")

__all__ = ["ORACLES", "QUERIES"]
