"""Imports every module that registers queries."""

import importlib

from corvane.llm.registry import QUERIES, SQL

for _name in ("caps", "membership", "distinctive", "encoding", "leaks", "languages", "pages"):
    importlib.import_module(f"corvane.llm.{_name}")

__all__ = ["QUERIES", "SQL"]
