"""Changes to tables as functions: each gives the table's new rows and the rows it would RETURN."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadra.functions.semantics import first_per_key


@dataclass
class Change:
    table: DataFrame
    returning: DataFrame


def insert(target: DataFrame, rows: DataFrame) -> Change:
    """Columns that ``rows`` lacks are null; columns that the target lacks are an error."""
    extra = set(rows.columns) - set(target.columns)
    if extra:
        raise ValueError(f"no such column: {sorted(extra)}")
    full = rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) if f.name in rows.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in target.schema])
    return Change(target.unionByName(full), full)


def update(target: DataFrame, key: list[str], assign: dict[str, Column], where: Column | None = None, source: DataFrame | None = None, on: Column | None = None, arrival: list[Column] | None = None) -> Change:
    """UPDATE … [FROM source]: a row that several source rows match takes the first in arrival order."""
    types = {f.name: f.dataType for f in target.schema}
    new = [(assign[c].cast(types[c]) if c in assign else target[c]).alias(c) for c in target.columns]
    if source is None:
        changed = target.where(where if where is not None else F.lit(True)).select(*new)
    else:
        joined = target.join(source, on, "inner")
        joined = joined if where is None else joined.where(where)
        ranked = joined.select(*new, *[target[k].alias(f"_k{i}") for i, k in enumerate(key)], *[a.alias(f"_a{i}") for i, a in enumerate(arrival or [F.lit(0)])])
        order = [F.col(f"_a{i}") for i in range(len(arrival or [0]))]
        changed = first_per_key(ranked, [f"_k{i}" for i in range(len(key))], order)
        touched = changed.select(*[F.col(f"_k{i}") for i in range(len(key))])
        kept = target.join(touched, [target[k] == touched[f"_k{i}"] for i, k in enumerate(key)], "left_anti")
        changed = changed.select(target.columns)
        return Change(kept.unionByName(changed), changed)
    rest = target.where(~F.coalesce(where, F.lit(False))) if where is not None else target.limit(0)
    return Change(rest.unionByName(changed), changed)


def delete(target: DataFrame, where: Column | None = None, using: DataFrame | None = None, on: Column | None = None) -> Change:
    """DELETE … [USING source]: rows with any match go; RETURNING gives each once."""
    if using is None:
        gone = F.coalesce(where, F.lit(False)) if where is not None else F.lit(True)
        return Change(target.where(~gone), target.where(gone))
    cond = on if where is None else on & where
    return Change(target.join(using, cond, "left_anti"), target.join(using, cond, "left_semi"))


def conditional_insert(state: DataFrame, rows: DataFrame, key: list[str]) -> DataFrame:
    """INSERT … IF NOT EXISTS per row: ``[applied]`` tells whether the row went in."""
    have = state.select(*key).distinct().withColumn("_has", F.lit(True))
    return rows.join(have, key, "left").withColumn("[applied]", F.col("_has").isNull()).drop("_has")


def conditional_update(state: DataFrame, changes: DataFrame, key: list[str], condition: Column) -> DataFrame:
    """UPDATE … IF condition: changes joined with the current row; unknown or missing means not applied."""
    return changes.join(state, key, "left").withColumn("[applied]", F.coalesce(condition, F.lit(False)))
