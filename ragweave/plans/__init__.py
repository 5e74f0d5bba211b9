"""Registered queries over the test tables, and pipelines of operators."""

from __future__ import annotations

import importlib
from types import ModuleType

MODULES = ("retrieval", "texts", "guarding", "operations", "scoring", "streams", "relational")


def load() -> ModuleType:
    """Import all modules of queries; gives the registry."""
    for name in MODULES:
        importlib.import_module(f"ragweave.plans.{name}")
    return importlib.import_module("ragweave.plans.registry")
