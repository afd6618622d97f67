"""All registered queries and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

from deucebase.sources.adapter import CTES

MODULES = ("reporting", "shots", "value", "sequences", "screens", "tendencies", "series", "relational", "entities", "form", "identity", "feeds", "ingest", "gold", "live")
_FOUND: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None, ctes: str = CTES):
    """Register a function of (spark, sf_dir) under its name; ``sql`` may use ``matches`` and ``points``."""

    def add(f):
        name = f.__name__
        assert name not in _FOUND, name
        _FOUND[name] = f
        if sql:
            _SQL[name] = f"WITH {ctes} {sql}" if ctes else sql
        return f

    return add


def _load() -> None:
    for m in MODULES:
        import_module(f"deucebase.plans.{m}")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    return dict(_FOUND)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_SQL)
