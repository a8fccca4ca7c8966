"""The registered queries: one module for each part of the library, each with pairs of a DataFrame function and its DuckDB SQL."""

from __future__ import annotations

import importlib

#: The modules that have QUERIES and ORACLES.
MODULES: tuple[str, ...] = ("tables", "texts", "records", "advice", "models")


def _merged(name: str) -> dict:
    return {k: v for m in MODULES for k, v in getattr(importlib.import_module(f"{__name__}.{m}"), name).items()}


def queries() -> dict:
    return _merged("QUERIES")


def oracle_sql() -> dict:
    return _merged("ORACLES")
