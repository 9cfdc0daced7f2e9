"""Named queries over the input tables, each with an optional ANSI-SQL twin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from kerbline.sources.tables import Tables, with_derived

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``fn(tables) -> DataFrame`` under ``name``; ``sql`` is its twin."""

    def register(fn: Callable[[Tables], DataFrame]):
        if name in _QUERIES:
            raise ValueError(f"query {name} is registered twice")
        _QUERIES[name] = lambda spark, folder: fn(Tables(spark, folder))
        if sql:
            _ORACLES[name] = with_derived(sql)
        return fn

    return register


def load() -> None:
    from kerbline.catalog import (  # noqa: F401
        areas, functions_q, graphs, index, joins, measures, relational, shortlist_q, sources_q,
        streams_q, walking,
    )


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    load()
    return dict(_QUERIES)


def oracles() -> dict[str, str]:
    load()
    return dict(_ORACLES)
