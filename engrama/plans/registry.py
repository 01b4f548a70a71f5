"""All registered queries and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from engrama.sources import tables

_QUERIES: dict[str, Callable] = {}
_ORACLES: dict[str, str] = {}
_MODULES = ("store", "views", "text", "recall", "lifecycle", "graph", "relational")


def query(name: str, sql: str | None = None) -> Callable:
    """Registers f(spark, sf_dir) -> DataFrame, and the SQL that gives the same rows."""

    def add(f: Callable) -> Callable:
        _QUERIES[name] = f
        if sql is not None:
            _ORACLES[name] = tables.sql(sql)
        return f

    return add


def _load() -> None:
    for m in _MODULES:
        import_module(f"engrama.plans.{m}")


def queries() -> dict[str, Callable]:
    _load()
    return dict(_QUERIES)


def oracles() -> dict[str, str]:
    _load()
    return dict(_ORACLES)
