"""Definitions: tables, types and indexes as statements over an in-process registry of empty or loaded DataFrames."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quadra.operators.udf import USER_FUNCTIONS, create_function
from quadra.plans.cql import Function, Table, parse
from quadra.plans.lex import Cursor, SyntaxFault, unquote
from quadra.plans.procedures import Procedure

_SCALARS = {
    "tinyint": "tinyint", "smallint": "smallint", "int": "int", "integer": "int", "bigint": "bigint", "counter": "bigint", "varint": "decimal(38,0)",
    "decimal": "decimal(38,18)", "numeric": "decimal(38,18)", "float": "float", "double": "double", "text": "string", "varchar": "string", "ascii": "string",
    "boolean": "boolean", "blob": "binary", "bytea": "binary", "uuid": "string", "timeuuid": "string", "inet": "string", "timestamp": "timestamp_ntz",
    "timestamptz": "timestamp", "date": "date", "time": "bigint", "duration": "struct<months:int,days:int,nanos:bigint>", "jsonb": "string", "json": "string",
}


@dataclass
class Routine:
    """A scalar function by its SQL expression over named arguments."""

    arguments: list[tuple[str, str]]
    returns: str
    body: str


@dataclass
class Aggregate:
    """A fold by scalar functions: state, and what comes out of the last state."""

    step: str
    state: str
    final: str | None
    start: str


@dataclass
class Registry:
    """Tables by name, structured types, enumerations (with their order), and comments."""

    spark: SparkSession
    tables: dict[str, Table] = field(default_factory=dict)
    types: dict[str, str] = field(default_factory=dict)
    enums: dict[str, list[str]] = field(default_factory=dict)
    comments: dict[str, str] = field(default_factory=dict)
    routines: dict[str, Routine] = field(default_factory=dict)
    procedures: dict[str, Procedure] = field(default_factory=dict)
    aggregates: dict[str, Aggregate] = field(default_factory=dict)

    def call(self, name: str, *arguments: Any) -> Any:
        """Run a procedural function."""
        return self.procedures[name].call(*arguments)

    def aggregate(self, name: str, column: str) -> Column:
        """A user aggregate over a column, in the order of its values so that reruns agree; nulls are passed over.

        The step function has no way to merge states, so a group's values meet in one row: use the built-in
        aggregates, or ``udf.fold_aggregate`` with a merge function, where groups have no bound.
        """
        a = self.aggregates[name]
        step = self.routines[a.step]
        (s, _), (v, _) = step.arguments
        fold = f"aggregate(array_sort(collect_list(`{column}`)), CAST({a.start} AS {a.state}), ({s}, {v}) -> CAST({step.body} AS {a.state})"
        if a.final:
            done = self.routines[a.final]
            fold += f", {done.arguments[0][0]} -> CAST({done.body} AS {done.returns})"
        return F.expr(fold + ")")

    def functions(self) -> dict[str, Function]:
        """What the wide-column front end may call."""
        out = {n: Function(lambda *c, n=n: F.call_function(n, *c)) for n in self.routines}
        named = lambda c: c._jc.toString()
        return out | {n: Function(lambda c, n=n: self.aggregate(n, named(c)), True) for n in self.aggregates}

    def system(self) -> dict[str, Table]:
        """The definitions as tables (tables, columns, indexes, types, functions, aggregates) that a SELECT reads."""
        kind = {}
        for n, t in self.tables.items():
            kind |= {(n, c): "partition_key" for c in t.partition} | {(n, c): "clustering" for c in t.clustering}
        listed = {
            "tables": ([(n, self.comments.get(n)) for n in self.tables], "table_name string, comment string"),
            "columns": ([(n, c, kind.get((n, c), "regular"), i, k) for n, t in self.tables.items() for i, (c, k) in enumerate(t.df.dtypes)], "table_name string, column_name string, kind string, position int, type string"),
            "indexes": ([(n, i, k, ",".join(c)) for n, t in self.tables.items() for i, (c, k) in t.indexes.items()], "table_name string, index_name string, kind string, columns string"),
            "types": ([(n, d) for n, d in self.types.items()] + [(n, f"enum({','.join(v)})") for n, v in self.enums.items()], "type_name string, definition string"),
            "functions": ([(n, ",".join(k for _, k in f.arguments), f.returns) for n, f in self.routines.items()], "function_name string, argument_types string, return_type string"),
            "aggregates": ([(n, a.step, a.state, a.final) for n, a in self.aggregates.items()], "aggregate_name string, state_func string, state_type string, final_func string"),
        }
        return {n: Table(self.spark.createDataFrame(rows, schema), [schema.split()[0]]) for n, (rows, schema) in listed.items()}

    def run(self, text: str) -> None:
        """One definition."""
        _Definition(text, self).statement()

    def ordinal(self, enum: str, column: str):
        """The order of an enumeration's values, as a sort key."""
        return F.array_position(F.array(*[F.lit(v) for v in self.enums[enum]]), F.col(column))


class _Definition(Cursor):
    def __init__(self, text: str, registry: Registry) -> None:
        # a dollar-quoted body becomes a string
        text = re.sub(r"(?s)\$(\w*)\$(.*?)\$\1\$", lambda m: "'" + m[2].replace("'", "''") + "'", text)
        super().__init__(text)
        self.r = registry

    def exists(self, no: bool) -> bool:
        return self.words("IF NOT EXISTS" if no else "IF EXISTS")

    def named(self) -> str:
        name = self.name().lower()
        while self.op("."):
            name = self.name().lower()
        return name

    def kind(self) -> str:
        name = self.name().lower()
        if name == "double":
            self.word("PRECISION")
        if self.op("<"):
            inner = [self.next().text if self.tok.kind == "num" else self.kind()]
            while self.op(","):
                inner.append(self.next().text if self.tok.kind == "num" else self.kind())
            self.need(">")
            if name == "frozen":
                return inner[0]
            if name in ("list", "set", "vector"):
                return f"array<{inner[0]}>"
            if name == "map":
                return f"map<{inner[0]},{inner[1]}>"
            if name == "tuple":
                return "struct<" + ",".join(f"f{i}:{k}" for i, k in enumerate(inner)) + ">"
            raise SyntaxFault(f"unknown type {name}")
        out = self.r.types.get(name) or ("string" if name in self.r.enums else _SCALARS.get(name))
        if out is None:
            raise SyntaxFault(f"unknown type {name}")
        if name in ("numeric", "decimal", "varchar") and self.op("("):
            sizes = [self.next().text]
            while self.op(","):
                sizes.append(self.next().text)
            self.need(")")
            out = f"decimal({','.join(sizes)})" if name != "varchar" else out
        while self.op("["):
            self.need("]")
            out = f"array<{out}>"
        return out

    def table(self, name: str) -> Table:
        if name not in self.r.tables:
            raise LookupError(f"no such table: {name}")
        return self.r.tables[name]

    def statement(self) -> None:
        if self.word("CREATE"):
            replace = self.words("OR REPLACE")
            if self.word("FUNCTION"):
                self.create_function(replace)
            elif self.word("AGGREGATE"):
                self.create_aggregate(replace)
            elif self.word("TABLE"):
                self.create_table()
            elif self.word("TYPE"):
                self.create_type()
            elif self.is_word("INDEX", "CUSTOM", "UNIQUE"):
                self.create_index()
            elif self.word("KEYSPACE", "SCHEMA"):
                self.exists(True)
                self.named()
                self.i = len(self.toks) - 1
            else:
                self.fault("unsupported definition")
        elif self.word("DROP"):
            what = self.need_word("TABLE", "INDEX", "TYPE", "KEYSPACE", "SCHEMA", "FUNCTION", "AGGREGATE")
            maybe = self.exists(False)
            name = self.named()
            if what in ("FUNCTION", "AGGREGATE") and self.op("("):
                while not self.op(")"):
                    self.next()
            self.drop(what, name, maybe)
        elif self.words("ALTER TABLE"):
            self.alter(self.table(self.named()))
        elif self.word("TRUNCATE"):
            self.word("TABLE")
            t = self.table(self.named())
            t.df = t.df.limit(0)
        elif self.words("COMMENT ON TABLE"):
            name = self.named()
            self.need_word("IS")
            self.r.comments[name] = unquote(self.next().text)
        elif self.is_word("LOCK", "VACUUM", "ANALYZE", "COMPACT"):
            self.i = len(self.toks) - 1  # accepted; a batch engine has nothing to do
        else:
            self.fault("unsupported definition")
        self.done()

    def create_table(self) -> None:
        maybe = self.exists(True)
        name = self.named()
        self.need("(")
        columns: list[tuple[str, str]] = []
        partition: list[str] = []
        clustering: list[str] = []
        while not self.op(")"):
            if self.words("PRIMARY KEY"):
                self.need("(")
                if self.op("("):
                    partition = [self.name().lower()]
                    while self.op(","):
                        partition.append(self.name().lower())
                    self.need(")")
                else:
                    partition = [self.name().lower()]
                while self.op(","):
                    clustering.append(self.name().lower())
                self.need(")")
            else:
                column = self.name().lower()
                columns.append((column, self.kind()))
                while self.tok.text not in (",", ")"):
                    if self.words("PRIMARY KEY"):
                        partition = [column]
                    elif self.word("STATIC") or self.words("NOT NULL"):
                        pass
                    else:
                        self.fault("unsupported column option")
            self.op(",")
        extensions = {}
        if self.word("WITH"):
            while self.tok.kind != "end" and self.tok.text != ";":
                if self.words("CLUSTERING ORDER BY"):
                    self.need("(")
                    while not self.op(")"):
                        self.next()
                else:
                    key = self.name().lower()
                    self.need("=")
                    if self.op("{"):
                        while not self.op("}"):
                            k = unquote(self.next().text)
                            self.need(":")
                            extensions[k] = unquote(self.next().text)
                            self.op(",")
                    else:
                        extensions[key] = self.next().text.strip("'")
                self.word("AND")
        if name in self.r.tables:
            if maybe:
                return
            raise SyntaxFault(f"table {name} exists")
        if not set(partition + clustering) <= {c for c, _ in columns}:
            raise SyntaxFault("a key column is not defined")
        schema = ", ".join(f"`{c}` {k}" for c, k in columns)
        self.r.tables[name] = Table(self.r.spark.createDataFrame([], schema), partition, clustering, {}, extensions)

    def create_type(self) -> None:
        self.exists(True)
        name = self.named()
        if self.word("AS"):
            self.need_word("ENUM")
            self.need("(")
            values = []
            while not self.op(")"):
                values.append(unquote(self.next().text))
                self.op(",")
            self.r.enums[name] = values
            return
        self.need("(")
        fields = []
        while not self.op(")"):
            field_name = self.name().lower()
            fields.append(f"{field_name}:{self.kind()}")
            self.op(",")
        self.r.types[name] = f"struct<{','.join(fields)}>"

    def taken(self, name: str, replace: bool, maybe: bool) -> bool:
        """Whether the name is in use and the statement lets it be."""
        if name in {**self.r.routines, **self.r.procedures, **self.r.aggregates} and not replace:
            if not maybe:
                raise SyntaxFault(f"{name} exists")
            return True
        return False

    def create_function(self, replace: bool) -> None:
        """LANGUAGE sql: an expression that Catalyst inlines; plpgsql: a procedural block. Compiled languages are refused."""
        maybe = self.exists(True)
        name = self.named()
        self.need("(")
        args: list[tuple[str, str]] = []
        while not self.op(")"):
            args.append((self.name().lower(), self.kind()))
            self.op(",")
        strict, returns, language, body = False, None, None, None
        while self.tok.kind != "end" and self.tok.text != ";":
            if self.words("CALLED ON NULL INPUT") or self.word("IMMUTABLE", "STABLE", "VOLATILE"):
                pass
            elif self.words("RETURNS NULL ON NULL INPUT") or self.word("STRICT"):
                strict = True
            elif self.word("RETURNS"):
                returns = "void" if self.word("VOID") else self.kind()
            elif self.word("LANGUAGE"):
                language = unquote(self.next().text).lower() if self.tok.kind == "str" else self.name().lower()
            elif self.word("AS"):
                if self.word("FILE", "URL") or self.tok.kind != "str":
                    raise SyntaxFault("a function's body is quoted text")
                body = unquote(self.next().text).strip()
            else:
                self.fault("unsupported function option")
        if returns is None or language is None or body is None:
            raise SyntaxFault("a function needs RETURNS, LANGUAGE and AS")
        if self.taken(name, replace, maybe):
            return
        if language == "plpgsql":
            self.r.procedures[name] = Procedure(self.r.spark, body, [a for a, _ in args])
            return
        if language != "sql":
            raise SyntaxFault(f"language {language} is not supported: register a Python function instead")
        body = re.sub(r"(?is)^select\s+|;$", "", body)
        if strict and args:
            body = f"CASE WHEN {' AND '.join(f'{a} IS NOT NULL' for a, _ in args)} THEN {body} END"
        self.r.routines[name] = Routine(args, returns, body)
        create_function(self.r.spark, name, ", ".join(f"{a} {k}" for a, k in args), returns, body, True)

    def create_aggregate(self, replace: bool) -> None:
        maybe = self.exists(True)
        name = self.named()
        self.need("(")
        self.kind()
        self.need(")")
        self.need_word("SFUNC")
        step = self.named()
        self.need_word("STYPE")
        state = self.kind()
        final = self.named() if self.word("FINALFUNC") else None
        start = "NULL"
        if self.word("INITCOND"):
            at, end = self.tok.at, self.i
            while self.toks[end].kind != "end" and self.toks[end].text != ";":
                end += 1
            start, self.i = self.source[at : self.toks[end].at].strip(), end
        for f, n in ((step, 2), (final, 1)):
            if f and (f not in self.r.routines or len(self.r.routines[f].arguments) != n):
                raise SyntaxFault(f"{f} is no function of {n} arguments")
        if not self.taken(name, replace, maybe):
            self.r.aggregates[name] = Aggregate(step, state, final, start)

    def create_index(self) -> None:
        self.word("CUSTOM", "UNIQUE")
        self.need_word("INDEX")
        self.exists(True)
        name = "" if self.is_word("ON") else self.named()
        self.need_word("ON")
        t = self.named()
        kind = "btree"
        if self.word("USING"):
            kind = self.next().text.strip("'").lower()
        self.need("(")
        columns = [self.name().lower()]
        while self.op(","):
            columns.append(self.name().lower())
        self.need(")")
        if self.word("USING"):
            kind = self.next().text.strip("'").lower()
        if kind not in ("btree", "hash", "composite", "phonetic", "filtered", "vector", "fulltext", "geo"):
            raise SyntaxFault(f"unknown index kind {kind}")
        partial = []
        if self.word("WHERE"):
            # a conjunction of comparisons, read as those of a SELECT
            at = self.tok.at
            while self.tok.kind != "end" and self.tok.text != ";":
                self.next()
            text = self.source[at : self.tok.at] if self.tok.kind != "end" else self.source[at:]
            partial = parse(f"SELECT * FROM t WHERE {text}").where
            if any(p.op not in ("=", "!=", "<", ">", "<=", ">=") or len(p.columns) > 1 or p.token for p in partial):
                raise SyntaxFault("a partial index takes comparisons of columns with values")
        missing = {*columns, *(c for p in partial for c in p.columns)} - set(self.table(t).df.columns)
        if missing:
            raise SyntaxFault(f"no such column: {sorted(missing)}")
        if (kind == "filtered") != bool(partial):
            raise SyntaxFault("a filtered index has a WHERE, and no other has one")
        name = name or f"{t}_{'_'.join(columns)}_idx"
        self.table(t).indexes[name] = (columns, kind)
        self.table(t).partial[name] = partial

    def drop(self, what: str, name: str, maybe: bool) -> None:
        if what in ("KEYSPACE", "SCHEMA"):
            return
        places = {"TABLE": [self.r.tables], "TYPE": [self.r.types, self.r.enums], "INDEX": [t.indexes for t in self.r.tables.values()], "FUNCTION": [self.r.routines, self.r.procedures], "AGGREGATE": [self.r.aggregates]}[what]
        for p in places:
            if name in p:
                del p[name]
                if p is self.r.routines:
                    USER_FUNCTIONS.discard(name)
                    self.r.spark.sql(f"DROP TEMPORARY FUNCTION IF EXISTS {name}")
                return
        if not maybe:
            raise LookupError(f"no such {what.lower()}: {name}")

    def alter(self, t: Table) -> None:
        if self.word("ADD"):
            self.word("COLUMN")
            name = self.name().lower()
            t.df = t.df.withColumn(name, F.lit(None).cast(T._parse_datatype_string(self.kind())))
        elif self.word("DROP"):
            self.word("COLUMN")
            name = self.name().lower()
            if name in t.partition + t.clustering:
                raise SyntaxFault("a key column cannot go")
            t.df = t.df.drop(name)
        elif self.word("RENAME"):
            self.word("COLUMN")
            old = self.name().lower()
            self.need_word("TO")
            new = self.name().lower()
            t.df = t.df.withColumnRenamed(old, new)
            t.partition = [new if c == old else c for c in t.partition]
            t.clustering = [new if c == old else c for c in t.clustering]
        elif self.word("ALTER"):
            self.word("COLUMN")
            name = self.name().lower()
            self.need_word("TYPE")
            t.df = t.df.withColumn(name, F.col(name).cast(T._parse_datatype_string(self.kind())))
        else:
            self.fault("unsupported change")
