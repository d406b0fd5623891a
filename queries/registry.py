"""Name -> (Spark function, checking SQL)."""

from __future__ import annotations

import importlib

_QUERIES: dict = {}
_ORACLES: dict = {}
_MODULES = ("indices", "classes", "quality", "statistics", "tiles", "raster", "focal", "clouds", "scenes",
            "geometry", "change", "sources")


def query(name: str, sql: str | None = None):
    """Register a Spark function under ``name``; ``sql`` is its DuckDB equivalent."""
    def keep(fn):
        if name in _QUERIES:
            raise ValueError(f"query {name} registered twice")
        _QUERIES[name] = fn
        if sql is not None:
            _ORACLES[name] = sql
        return fn
    return keep


def _load() -> None:
    for module in _MODULES:
        importlib.import_module(f"queries.{module}")


def all_queries() -> dict:
    _load()
    return dict(_QUERIES)


def all_oracles() -> dict:
    _load()
    return dict(_ORACLES)
