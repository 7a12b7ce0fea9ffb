"""Queries over the given tables."""

from __future__ import annotations

import importlib

MODULES = ("features", "evaluation", "ensembles", "detectors", "tables", "streams")


def load():
    """Import every query module and return the registry."""
    for name in MODULES:
        importlib.import_module(f"workload.{name}")
    return importlib.import_module("workload.catalog").ENTRIES
