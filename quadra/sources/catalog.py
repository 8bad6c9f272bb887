"""Catalog tables: relations, columns and types of the session under the names that clients ask for."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession

#: Numbers of relations begin here, as those below belong to the system.
FIRST_OID = 16_384
#: Fixed numbers of types.
TYPE_OIDS = {"boolean": 16, "binary": 17, "bigint": 20, "smallint": 21, "int": 23, "string": 25, "float": 700, "double": 701, "date": 1082, "timestamp_ntz": 1114, "timestamp": 1184, "decimal": 1700}
_NAMES = {16: "bool", 17: "bytea", 20: "int8", 21: "int2", 23: "int4", 25: "text", 700: "float4", 701: "float8", 1082: "date", 1114: "timestamp", 1184: "timestamptz", 1700: "numeric"}
PUBLIC, CATALOG = 2200, 11


def relations(spark: SparkSession) -> list[str]:
    """Names of the session's tables and views, in order."""
    return sorted({t.name for t in spark.catalog.listTables() if "__" not in t.name})


def oid_of(spark: SparkSession, name: str) -> int | None:
    """The number of a relation; None for a name that is none."""
    names = relations(spark)
    plain = name.removeprefix("public.").strip('"').lower()
    return FIRST_OID + names.index(plain) if plain in names else None


def _type(kind: str) -> int:
    return TYPE_OIDS.get(kind.split("(")[0], TYPE_OIDS["string"])


def _columns(spark: SparkSession) -> Iterable[tuple]:
    for i, name in enumerate(relations(spark)):
        for k, f in enumerate(spark.table(name).schema, 1):
            yield FIRST_OID + i, name, f.name, k, f.dataType.simpleString(), f.nullable


#: Schema and name to columns and rows; rows are as many as the session has tables, or columns of them.
VIEWS: dict[str, tuple[str, Callable[[SparkSession], list[tuple]]]] = {
    "pg_catalog.pg_namespace": ("oid long, nspname string", lambda s: [(CATALOG, "pg_catalog"), (PUBLIC, "public")]),
    "pg_catalog.pg_class": ("oid long, relname string, relnamespace long, relkind string", lambda s: [(FIRST_OID + i, n, PUBLIC, "r") for i, n in enumerate(relations(s))]),
    "pg_catalog.pg_attribute": ("attrelid long, attname string, atttypid long, attnum int, attnotnull boolean", lambda s: [(o, c, _type(t), k, not null) for o, _, c, k, t, null in _columns(s)]),
    "pg_catalog.pg_type": ("oid long, typname string", lambda s: sorted(_NAMES.items())),
    "information_schema.tables": ("table_schema string, table_name string, table_type string", lambda s: [("public", n, "BASE TABLE") for n in relations(s)]),
    "information_schema.columns": ("table_schema string, table_name string, column_name string, ordinal_position int, data_type string, is_nullable string", lambda s: [("public", n, c, k, t, "YES" if null else "NO") for _, n, c, k, t, null in _columns(s)]),
    "system_schema.keyspaces": ("keyspace_name string, durable_writes boolean", lambda s: [("public", True)]),
    "system_schema.tables": ("keyspace_name string, table_name string", lambda s: [("public", n) for n in relations(s)]),
    "system_schema.columns": ("keyspace_name string, table_name string, column_name string, position int, type string", lambda s: [("public", n, c, k - 1, t) for _, n, c, k, t, _ in _columns(s)]),
    "system_observability.active_queries": ("query_id string, stages int", lambda s: [(str(j), len(getattr(s.sparkContext.statusTracker().getJobInfo(j), "stageIds", []) or [])) for j in s.sparkContext.statusTracker().getActiveJobsIds()]),
}


def view(spark: SparkSession, name: str) -> DataFrame | None:
    """The catalog table of a qualified name, as it is now; None for other names."""
    if name.lower() not in VIEWS:
        return None
    schema, rows = VIEWS[name.lower()]
    return spark.createDataFrame(rows(spark), schema)
