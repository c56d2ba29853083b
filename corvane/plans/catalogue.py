"""Imports every module of plans, each of which registers its queries."""

import importlib
import pkgutil

import corvane.plans as _plans
from corvane.plans.registry import QUERIES, SQL

for _m in pkgutil.iter_modules(_plans.__path__):
    if _m.name not in ("catalogue", "registry"):
        importlib.import_module(f"corvane.plans.{_m.name}")

__all__ = ["QUERIES", "SQL"]
