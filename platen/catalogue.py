"""Collects the queries of all modules that register some."""

from __future__ import annotations

import importlib

MODULES: tuple[str, ...] = ("queries_library", "queries_raster", "queries_flow", "queries_tiles", "queries_places", "queries_mutations")


def _merged(name: str) -> dict:
    found: dict = {}
    for m in MODULES:
        found |= getattr(importlib.import_module(f"platen.{m}"), name)
    return found


def queries() -> dict:
    return _merged("QUERIES")


def oracle_sql() -> dict:
    return _merged("ORACLES")
