"""Wide-column changes as text: INSERT, UPDATE, DELETE and BATCH on tables of current rows.

A statement names its rows by key, so it rewrites those and leaves the rest of the table as it was. INSERT and UPDATE
both make a row that is missing. IF reads the one current row first and answers with ``[applied]``. Write times and times
to live belong to tables of cells (``cql.cells_of``, ``versions.latest``) and are refused here.
"""

from __future__ import annotations

import itertools
from dataclasses import replace
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadra.functions import semantics as S
from quadra.plans import cql
from quadra.plans.cql import Change, Predicate, Table
from quadra.plans.lex import SyntaxFault

Catalog = dict[str, Table]


def execute(catalog: Catalog, text: str, binds: tuple = ()) -> tuple[Catalog, DataFrame | None]:
    """The catalog after a statement or batch, and the rows it answers with."""
    parsed = cql.parse(text, binds)
    if isinstance(parsed, cql.Select):
        return catalog, cql.select(catalog, text, binds)
    batch = isinstance(parsed, list)
    out = None
    for c in parsed if batch else [parsed]:
        if batch and c.condition is not None:
            raise SyntaxFault("conditions inside a batch are not supported")
        catalog, out = _apply(catalog, c)
    return catalog, out


def _apply(catalog: Catalog, c: Change) -> tuple[Catalog, DataFrame | None]:
    if c.table not in catalog:
        raise LookupError(f"no such table: {c.table}")
    t = catalog[c.table]
    if c.timestamp is not None or c.ttl is not None:
        raise SyntaxFault("a table of current rows keeps no write times")
    unknown = [n for n in c.cells if n not in t.df.columns]
    if unknown:
        raise LookupError(f"no such column: {unknown[0]}")
    where = c.where
    if c.kind == "insert":
        where = [Predicate((k,), "=", c.cells[k]) for k in t.partition + t.clustering if k in c.cells]
    named = {p.columns[0] for p in where if len(p.columns) == 1 and p.op in ("=", "in")}
    missing = [k for k in (t.partition if c.kind == "delete" else t.partition + t.clustering) if k not in named]
    if missing:
        raise SyntaxFault(f"the statement does not name {missing[0]}")
    if any(set(p.columns) - set(t.partition + t.clustering) for p in where):
        raise SyntaxFault("WHERE of a change takes key columns")
    match = F.lit(True)
    for p in where:
        match = match & F.coalesce(cql.condition(p, t.df), F.lit(False))
    current = t.df.where(match)
    answer = None
    if c.condition is not None:
        applied, answer = _condition(t, c, where, current)
        if not applied:
            return catalog, answer
    if c.kind == "delete":
        df = _deleted(t, c, match)
    else:
        df = t.df.where(~match).unionByName(_upserted(t, c, where, current))
    return catalog | {c.table: replace(t, df=df)}, answer


def _condition(t: Table, c: Change, where: list[Predicate], current: DataFrame) -> tuple[bool, DataFrame]:
    """Whether the one row that the statement names fits its IF."""
    if {k for p in where if p.op == "=" for k in p.columns} != set(t.partition + t.clustering):
        raise SyntaxFault("a conditional change names one row")
    if isinstance(c.condition, list):
        fit = current
        for p in c.condition:
            fit = fit.where(F.col(p.columns[0]).isNull() if p.op == "=" and p.value is None else F.col(p.columns[0]).isNotNull() if p.op == "!=" and p.value is None else cql.condition(p, t.df))
        applied = not fit.isEmpty()
    else:
        applied = current.isEmpty() == (c.condition == "not exists")
    flag = F.lit(applied).alias("[applied]")
    answer = t.df.sparkSession.range(1).select(flag)
    if not applied and not current.isEmpty():
        answer = current.select(flag, "*")
    return applied, answer


def _deleted(t: Table, c: Change, match: Column) -> DataFrame:
    if not c.cells:
        return t.df.where(~match)
    new = {}
    for name, what in c.cells.items():
        if name in t.partition + t.clustering:
            raise SyntaxFault("a key column is deleted with its row")
        gone = F.lit(None) if what is None else _without(F.col(name), dict(t.df.dtypes)[name], what[1])
        new[name] = F.when(match, gone).otherwise(F.col(name))
    return t.df.withColumns(new)


def _without(column: Column, kind: str, key: Any) -> Column:
    if kind.startswith("map"):
        return S.map_remove(column, F.array(F.lit(key)))
    return F.filter(column, lambda _, i: i != key)


def _upserted(t: Table, c: Change, where: list[Predicate], current: DataFrame) -> DataFrame:
    """The named rows with their new cells; the statement lists as many as it has keys."""
    keys = t.partition + t.clustering
    types = dict(t.df.dtypes)
    values = {p.columns[0]: list(p.value) if p.op == "in" else [p.value] for p in where}
    rows = None
    for combination in itertools.product(*[values[k] for k in keys]):
        row = t.df.sparkSession.range(1).select(*[cql._literal(v).cast(types[k]).alias(k) for k, v in zip(keys, combination, strict=True)])
        rows = row if rows is None else rows.unionByName(row)
    found = rows.join(current, keys, "left")
    cells = {n: _cell(F.col(n), types[n], v).cast(types[n]) for n, v in c.cells.items() if n not in keys}
    return found.select(*[cells.get(n, F.col(n)).alias(n) for n in t.df.columns])


def _cell(old: Column, kind: str, v: Any) -> Column:
    if not (isinstance(v, tuple) and v and v[0] in ("+", "-", "put")):
        if isinstance(v, (list, set, dict)) and not v:
            return F.lit(None)  # an empty collection is none
        return cql._literal(v)
    if v[0] == "put":
        _, key, value = v
        if kind.startswith("map"):
            return S.map_add(F.coalesce(old, F.from_json(F.lit("{}"), kind)), F.create_map(F.lit(key), cql._literal(value)).cast(kind))
        return F.transform(old, lambda x, i: F.when(i == key, cql._literal(value)).otherwise(x))
    sign, x = v
    if isinstance(x, dict) or kind.startswith("map"):
        if sign == "-":
            return S.map_remove(old, cql._literal(set(x)))
        return S.map_add(F.coalesce(old, F.from_json(F.lit("{}"), kind)), cql._literal(x).cast(kind))
    if isinstance(x, (set, list)):
        some = cql._literal(x).cast(kind)
        none = F.array().cast(kind)
        if isinstance(x, set):
            return S.set_add(F.coalesce(old, none), some) if sign == "+" else S.set_remove(old, some)
        return F.concat(F.coalesce(old, none), some) if sign == "+" else F.filter(old, lambda y: ~F.array_contains(some, y))
    return F.coalesce(old, F.lit(0)) + (x if sign == "+" else -x)
