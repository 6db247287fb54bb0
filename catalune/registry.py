"""All queries of the engine's own operators, by name, with their DuckDB twins.

Query modules register with ``@query``; importing them here fills the tables.
"""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_ORACLES: dict[str, str] = {}
_MODULES = ("search", "browse", "audit", "vectors", "deltas", "graphs", "shapes", "positions", "ingest", "sinks")


def query(oracle: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function's name, with the DuckDB SQL of the same rows if there is any."""

    def add(f: Query) -> Query:
        if f.__name__ in _QUERIES:
            raise ValueError(f"two queries are named {f.__name__}")
        _QUERIES[f.__name__] = f
        if oracle:
            _ORACLES[f.__name__] = oracle
        return f

    return add


def _load() -> None:
    for name in _MODULES:
        importlib.import_module(f"catalune.plans.{name}")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    _load()
    return _QUERIES["autocomplete_parts"](spark, sf_dir)


def queries() -> dict[str, Query]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_ORACLES)
