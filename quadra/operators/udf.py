"""User functions: SQL scalar functions, Python functions, and folding aggregates with partial states."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Names that the front ends may call.
USER_FUNCTIONS: set[str] = set()


def create_function(spark: SparkSession, name: str, arguments: str, returns: str, body: str, replace: bool = False) -> None:
    """A scalar function whose body is a SQL expression; Catalyst inlines it."""
    spark.sql(f"CREATE {'OR REPLACE ' if replace else ''}TEMPORARY FUNCTION {name}({arguments}) RETURNS {returns} RETURN {body}")
    USER_FUNCTIONS.add(name.lower())


def register_python(spark: SparkSession, name: str, f: Callable, returns: str, null_on_null: bool = True):
    """A Python function over Arrow batches; RETURNS NULL ON NULL INPUT unless asked otherwise."""

    def run(*columns: pd.Series) -> pd.Series:
        # a null comes as None or NaN
        rows = [[None if pd.isna(x) is True else x for x in r] for r in zip(*columns, strict=True)]
        return pd.Series([None if null_on_null and any(x is None for x in r) else f(*r) for r in rows], dtype=object)

    USER_FUNCTIONS.add(name.lower())
    udf = F.pandas_udf(run, returns)
    return spark.udf.register(name, udf)


def fold_aggregate(df: DataFrame, keys: list[str], column: str, init: Callable, accumulate: Callable, merge: Callable, finish: Callable, returns: str, name: str) -> DataFrame:
    """init / accumulate / merge / finalize, partial per task: one state per key and task is shuffled, not the rows."""
    schema = df.select(*keys).schema

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        states: dict[Any, Any] = {}
        for pdf in batches:
            for key, xs in pdf.groupby(keys, dropna=False, sort=False)[column]:
                s = states.get(key)
                s = init() if s is None else s
                for x in xs.dropna():
                    s = accumulate(s, x)
                states[key] = s
        if states:
            yield pd.DataFrame([[*k, pickle.dumps(s)] for k, s in states.items()], columns=[*keys, "_state"])

    def final(pdf: pd.DataFrame) -> pd.DataFrame:
        total = init()
        for s in pdf["_state"]:
            total = merge(total, pickle.loads(s))
        return pdf[keys].head(1).assign(**{name: [finish(total)]})

    from pyspark.sql.types import BinaryType, StructField, StructType, _parse_datatype_string

    parts = df.select(*keys, column).mapInPandas(partial, StructType([*schema.fields, StructField("_state", BinaryType())]))
    out = StructType([*schema.fields, StructField(name, _parse_datatype_string(returns))])
    return parts.groupBy(*keys).applyInPandas(final, out)


def array_fold(column: str, init, merge, finish=None):
    """A fold over collected values, inside the JVM."""
    return F.aggregate(F.collect_list(column), init, merge, finish)
