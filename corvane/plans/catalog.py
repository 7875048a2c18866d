"""Registry of the library's queries and their SQL equivalents."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def register(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Add a query under a name, with its SQL where SQL can express it."""

    def keep(query: Query) -> Query:
        if name in _QUERIES:
            raise ValueError(f"two queries are named {name}")
        _QUERIES[name] = query
        if sql:
            _SQL[name] = sql
        return query

    return keep


def _load() -> None:
    for module in ("q_features", "q_selection", "q_runs", "q_streams", "q_candidates", "q_contracts", "q_sinks"):
        importlib.import_module(f"corvane.plans.{module}")


def queries() -> dict[str, Query]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_SQL)


def FLAGSHIP(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queries()["preference_pairs"](spark, sf_dir)
