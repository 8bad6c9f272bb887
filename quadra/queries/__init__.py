"""Registered queries of the engine's own operators, and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

for _name in ("relational", "wide", "series", "search", "graph", "rdf", "streams"):
    for _key, (_query, _oracle) in import_module(f"quadra.queries.{_name}").REGISTERED.items():
        QUERIES[_key] = _query
        if _oracle:
            ORACLES[_key] = _oracle

flagship = QUERIES["revenue_by_nation"]
