"""INSERT, UPDATE and DELETE as text, over named tables with keys.

A change is one query: the target joined with its FROM or USING list, reduced to one row per target key (the first
match in the stored order of the sources, combined before it is shuffled). Tables are replaced, never written in place.
What the grammar lacks is refused by name.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadra.operators.graph import cut
from quadra.plans.lex import unquote
from quadra.plans.sql import SqlError, _Rewriter, _sql
from quadra.sources.tables import copy_csv, copy_text

_JOINS = ("JOIN", "INNER", "LEFT", "RIGHT", "FULL", "CROSS", "NATURAL")


@dataclass
class Database:
    """Tables and their keys; ``execute`` runs one statement and gives its rows, or None."""

    spark: SparkSession
    tables: dict[str, DataFrame]
    keys: dict[str, list[str]] = field(default_factory=dict)

    def __post_init__(self) -> None:
        for name, df in self.tables.items():
            df.createOrReplaceTempView(name)

    def put(self, name: str, df: DataFrame) -> None:
        self.tables[name] = df
        df.createOrReplaceTempView(name)

    def settle(self, name: str) -> None:
        """Write the table to the checkpoint folder: its plan has grown with every change."""
        self.put(name, cut(self.tables[name]))

    def key(self, name: str) -> list[str]:
        if name not in self.tables:
            raise SqlError("42P01", f"relation {name} does not exist")
        missing = [k for k in self.keys.get(name, []) if k not in self.tables[name].columns]
        if missing or not self.keys.get(name):
            raise SqlError("42703", f"key of {name}: no column {missing[0]}" if missing else f"{name} has no key")
        return self.keys[name]

    def copy(self, text: str, path: str) -> int:
        """COPY … FROM STDIN, whose rows lie at ``path``; gives their number. FREEZE is read and has no meaning here."""
        name, columns, options = _Statement(text, self, ()).copy()
        table = self.tables[name]
        types = {f.name: f.dataType.simpleString() for f in table.schema}
        schema = ", ".join(f"`{c}` {types[c]}" for c in columns)
        if options.get("FORMAT", "text") == "csv":
            rows = copy_csv(self.spark, path, schema, options.get("HEADER", False), options.get("DELIMITER", ","), options.get("NULL", ""))
        else:
            rows = copy_text(self.spark, path, schema)
        rows = cut(rows)
        full = rows.select(*[(F.col(f"`{c}`") if c in columns else F.lit(None)).cast(types[c]).alias(c) for c in table.columns])
        key = self.key(name)
        self.put(name, table.join(full.select(*key), key, "left_anti").unionByName(full))
        return rows.count()

    def execute(self, text: str, params: tuple[Any, ...] = ()) -> DataFrame | None:
        return _Statement(text, self, params).run()


class _Statement(_Rewriter):
    def __init__(self, text: str, db: Database, params: tuple) -> None:
        super().__init__(text, db.spark, params)
        self.db = db

    def sql(self, text: str) -> DataFrame:
        return _sql(self.spark, text, self.params)

    def run(self) -> DataFrame | None:
        start = self.with_()
        if self.is_word("SELECT"):
            out = start + self.select()
            self.done()
            return self.sql(out)
        if self.words("INSERT INTO"):
            return self.insert(start)
        if self.word("UPDATE"):
            return self.update(start)
        if self.words("DELETE FROM"):
            return self.delete(start)
        if self.word("TRUNCATE"):
            self.word("TABLE")
            return self.truncate()
        if self.is_word("VACUUM", "ANALYZE", "ANALYSE", "BEGIN", "START", "COMMIT", "END", "SET", "RESET", "LOCK"):
            return None  # accepted: there is no heap to keep and no session state
        if self.is_word("ROLLBACK", "ABORT"):
            raise SqlError("0A000", "a change cannot be taken back: keep the tables of before")
        return self.fault("unsupported statement")

    def truncate(self) -> None:
        names = [self.table_name().strip("`")]
        while self.op(","):
            names.append(self.table_name().strip("`"))
        if self.is_word("CASCADE", "RESTART"):
            raise SqlError("0A000", f"TRUNCATE {self.tok.text.upper()} is not supported")
        self.done()
        for n in names:
            if n not in self.db.tables:
                raise SqlError("42P01", f"relation {n} does not exist")
        for n in names:
            self.db.put(n, self.db.tables[n].limit(0))

    def copy(self) -> tuple[str, list[str], dict[str, Any]]:
        self.need_word("COPY")
        name = self.table_name().strip("`")
        self.db.key(name)
        columns = list(self.db.tables[name].columns)
        if self.op("("):
            columns = [self.name().strip("`")]
            while self.op(","):
                columns.append(self.name().strip("`"))
            self.need(")")
            self.known(columns, self.db.tables[name].columns)
        if self.is_word("TO"):
            raise SqlError("0A000", "COPY TO is not supported")
        self.need_word("FROM")
        self.need_word("STDIN")
        self.word("WITH")
        options: dict[str, Any] = {}
        if self.op("("):
            while not self.op(")"):
                o = self.name().upper()
                if o not in ("FORMAT", "HEADER", "DELIMITER", "NULL", "FREEZE"):
                    raise SqlError("0A000", f"COPY option {o} is not supported")
                bare = self.tok.text in (",", ")")
                value = "on" if bare else unquote(self.next().text) if self.tok.kind == "str" else self.next().text.lower()
                options[o] = value in ("on", "true", "1") if o in ("HEADER", "FREEZE") else value
                if o == "FORMAT" and value not in ("text", "csv"):
                    raise SqlError("0A000", f"COPY format {value} is not supported")
                self.op(",")
        self.done()
        if options.get("FORMAT", "text") == "text" and set(options) & {"HEADER", "DELIMITER", "NULL"}:
            raise SqlError("0A000", "options of COPY's text format are not supported")
        return name, columns, options

    def target(self) -> tuple[str, str]:
        if self.is_word("ONLY"):
            raise SqlError("0A000", "ONLY is not supported")
        name = self.table_name().strip("`")
        if any(c.startswith((f"{name} AS", f"`{name}` AS")) for c in self.ctes):
            raise SqlError("0A000", f"{name} is a WITH query and cannot be changed")
        self.db.key(name)
        named = self.word("AS") or self.tok.kind == "name" and not self.is_word("SET", "USING", "WHERE", "RETURNING", "VALUES", "SELECT")
        return name, self.name() if named else name

    def sources(self) -> list[tuple[str, str]]:
        """(body, alias) of a comma list; joins inside it are refused."""
        out = []
        while True:
            text = self.relation()
            body, _, alias = text.rpartition(" AS ")
            out.append((body, alias) if body else (text, text))
            if self.is_word(*_JOINS):
                raise SqlError("0A000", "JOIN in a FROM or USING list is not supported")
            if not self.op(","):
                return out

    def scope_of(self, name: str, alias: str, sources: list[tuple[str, str]]) -> str:
        return "FROM " + ", ".join(f"{b} AS {a}" for b, a in [(name, alias), *sources])

    def condition(self) -> str:
        if not self.word("WHERE"):
            return ""
        if self.is_word("CURRENT") and self.ahead().text.upper() == "OF":
            raise SqlError("0A000", "WHERE CURRENT OF is not supported")
        return f"WHERE {self.expr()}"

    def returned(self, columns: list[str], alias: str) -> list[str] | None:
        if not self.word("RETURNING"):
            return None
        items = [self.item()]
        while self.op(","):
            items.append(self.item())
        return [", ".join(f"{alias}.`{c}`" for c in columns) if i == "*" else i for i in items]

    def insert(self, start: str) -> DataFrame | None:
        name, alias = self.target()
        table = self.db.tables[name]
        types = {f.name: f.dataType.simpleString() for f in table.schema}
        columns = list(types)
        if self.op("("):
            columns = [self.name().strip("`")]
            while self.op(","):
                columns.append(self.name().strip("`"))
            self.need(")")
        self.known(columns, types)
        if self.word("VALUES"):
            rows = []
            while True:
                self.need("(")
                row = [self.expr()]
                while self.op(","):
                    row.append(self.expr())
                self.need(")")
                if len(row) != len(columns):
                    raise SqlError("42601", "INSERT has more or fewer values than columns")
                rows.append(row)
                if not self.op(","):
                    break
            made = self.sql(start + " UNION ALL ".join("SELECT " + ", ".join(f"CAST({e} AS {types[c]}) AS `{c}`" for c, e in zip(columns, row, strict=True)) for row in rows))
        else:
            made = self.sql(start + self.select())
            if len(made.columns) != len(columns):
                raise SqlError("42601", "INSERT has more or fewer columns than its query")
            made = made.toDF(*columns)
        full = made.select(*[(F.col(f"`{c}`") if c in columns else F.lit(None)).cast(types[c]).alias(c) for c in table.columns])
        items = self.returned(table.columns, alias)
        self.done()
        key = self.db.key(name)
        # a row of an existing key takes its place
        self.db.put(name, table.join(full.select(*key), key, "left_anti").unionByName(full))
        return self.returning(full.select(F.struct("*").alias("n")), items, [(alias, "n", table.columns)])

    def update(self, start: str) -> DataFrame | None:
        name, alias = self.target()
        self.need_word("SET")
        at, sources, after = self._find_from(), [], None
        if at is not None:
            back, self.i = self.i, at + 1
            sources = self.sources()
            after, self.i = self.i, back
        self.scope.append(self.scope_of(name, alias, sources))
        sets: dict[str, str] = {}
        while True:
            if self.tok.text == "(":
                raise SqlError("0A000", "SET of a column list is not supported")
            column = self.name().strip("`")
            self.need("=")
            if self.is_word("DEFAULT"):
                raise SqlError("0A000", "SET to DEFAULT is not supported")
            sets[column] = self.expr()
            if not self.op(","):
                break
        if after is not None:
            if not self.is_word("FROM"):
                self.fault("unexpected text in SET")
            self.i = after
        table = self.db.tables[name]
        self.known(list(sets), table.columns)
        if set(sets) & set(self.db.key(name)):
            raise SqlError("0A000", "a key column cannot be assigned")
        return self.change(start, name, alias, sources, sets)

    def delete(self, start: str) -> DataFrame | None:
        name, alias = self.target()
        sources = self.sources() if self.word("USING") else []
        self.scope.append(self.scope_of(name, alias, sources))
        return self.change(start, name, alias, sources, None)

    def known(self, columns: list[str], have) -> None:
        for c in columns:
            if c not in have:
                raise SqlError("42703", f"column {c} does not exist")

    def change(self, start: str, name: str, alias: str, sources: list[tuple[str, str]], sets: dict[str, str] | None) -> DataFrame | None:
        where = self.condition()
        table, key = self.db.tables[name], self.db.key(name)
        items = self.returned(table.columns, alias)
        self.done()
        types = {f.name: f.dataType.simpleString() for f in table.schema}
        cells = ", ".join(f"'{c}', " + (f"CAST({sets[c]} AS {types[c]})" if sets and c in sets else f"{alias}.`{c}`") for c in table.columns)
        parts = [f"named_struct({cells}) AS n", *[f"struct({a}.*) AS s{i}" for i, (_, a) in enumerate(sources)]]
        text = f"{name} AS {alias}"
        if sources:
            parts.append("struct(" + ", ".join(f"{a}._arrival" for _, a in sources) + ") AS _at")
            text += "".join(f" CROSS JOIN (SELECT *, monotonically_increasing_id() AS _arrival FROM {b}) AS {a}" for b, a in sources)
        found = self.sql(f"{start}SELECT {', '.join(parts)} FROM {text} {where}")
        if sources:
            kept = [c for c in found.columns if c != "_at"]
            found = found.groupBy(*[F.col(f"n.{k}").alias(f"_k{i}") for i, k in enumerate(key)]).agg(F.min_by(F.struct(*kept), "_at").alias("p")).select("p.*")
        rest = table.join(found.select(*[F.col(f"n.{k}").alias(k) for k in key]), key, "left_anti")
        self.db.put(name, rest if sets is None else rest.unionByName(found.select("n.*")))
        fields = lambda c: [f.name for f in found.schema[c].dataType.fields if f.name != "_arrival"]
        return self.returning(found, items, [(alias, "n", table.columns), *[(a, f"s{i}", fields(f"s{i}")) for i, (_, a) in enumerate(sources)]])

    def returning(self, found: DataFrame, items: list[str] | None, tables: list[tuple[str, str, list[str]]]) -> DataFrame | None:
        """Items over the new rows and their matches, under the statement's own aliases."""
        if items is None:
            return None
        view = f"_changed_{uuid.uuid4().hex}"
        found.createOrReplaceTempView(view)
        scopes = "".join(f", LATERAL (SELECT {', '.join(f'_p.{c}.`{f}` AS `{f}`' for f in fields)}) AS {a}" for a, c, fields in tables)
        out = self.sql(f"SELECT {', '.join(items)} FROM {view} AS _p{scopes}")
        self.spark.catalog.dropTempView(view)
        return out
