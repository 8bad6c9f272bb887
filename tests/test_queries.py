"""Every registered query against its DuckDB SQL on the smallest tables."""

from __future__ import annotations

import duckdb
import pytest
from pyspark.sql import SparkSession

from quadra.queries import ORACLES, QUERIES
from quadra.sources.tables import TABLES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def _plain(rows: list) -> list:
    return sorted(tuple(repr(float(x)) if isinstance(x, float) else str(x) for x in r) for r in rows)


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark: SparkSession, duck, name: str) -> None:
    got = QUERIES[name](spark, SF)
    cols = sorted(got.columns)
    rows = [tuple(r) for r in got.select(*[got[c] for c in cols]).collect()]
    if name in ORACLES:
        names = ", ".join(f'"{c}"' for c in cols)
        assert _plain(rows) == _plain(duck.sql(f"SELECT {names} FROM ({ORACLES[name]}) q").fetchall())
