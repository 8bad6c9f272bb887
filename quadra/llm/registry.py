"""Registered queries of the subpackage, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

#: Modules with QUERY = (name, function) and ORACLE (DuckDB SQL or None).
MODULES: list[str] = [
    "decontaminate",
    "hmm",
    "line_dedup",
    "media_tiff",
    "minhash",
    "mixing",
    "packing",
    "pii",
    "quality",
    "warc",
]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    import corpus_pipeline

    out = dict(import_module(f"quadra.llm.{m}").QUERY for m in MODULES)
    return out | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    import corpus_pipeline

    found = {}
    for m in MODULES:
        module = import_module(f"quadra.llm.{m}")
        if module.ORACLE:
            found[module.QUERY[0]] = module.ORACLE
    if corpus_pipeline.ORACLE_SQL:
        found["pipeline"] = corpus_pipeline.ORACLE_SQL
    return found
