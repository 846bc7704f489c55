"""Queries by name, each with its SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .adapters import PRELUDE, Views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Registers a function of the views; ``sql`` is a SELECT over the views' names."""

    def of(f: Callable[[Views], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = lambda spark, sf_dir: f(Views(spark, sf_dir))
        if sql:
            ORACLES[name] = f"{PRELUDE} {sql}"
        return f

    return of


def load() -> None:
    from . import affect, graphs, more, stores, texts, work  # noqa: F401
