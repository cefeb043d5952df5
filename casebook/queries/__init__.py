"""Every operator as a query over the shared tables, with the SQL it must agree with."""

from __future__ import annotations

import importlib
from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}

_MODULES = (
    "matrices",
    "storage",
    "cleaning",
    "merging",
    "splits",
    "scaling",
    "tests_stat",
    "selection",
    "scores",
    "results",
    "models",
    "survival",
)


def query(name: str, sql: str | None = None):
    """Register a callable (spark, sf_dir) -> DataFrame and its SQL."""

    def wrap(fn):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return wrap


def load_all() -> None:
    for m in _MODULES:
        importlib.import_module(f"casebook.queries.{m}")
