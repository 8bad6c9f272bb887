"""The SQL front end: a PostgreSQL-style subset, checked and rewritten to Spark SQL.

What differs from Spark is rewritten (placement of nulls in ORDER BY, integer division, NaN in comparisons,
``op ANY``, array append, JSON objects, parameters); what the subset lacks is refused with ``SyntaxFault``.
"""

from __future__ import annotations

import re
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from quadra.operators.udf import USER_FUNCTIONS
from quadra.sources import catalog
from quadra.plans.lex import Cursor, SyntaxFault

_STOP = {"FROM", "WHERE", "GROUP", "HAVING", "ORDER", "LIMIT", "OFFSET", "ON", "JOIN", "LEFT", "INNER", "CROSS", "AS", "AND", "OR", "NOT", "THEN", "ELSE", "END", "WHEN", "IN", "IS", "BETWEEN", "LIKE", "ASC", "DESC", "NULLS", "UNION", "INTERSECT", "EXCEPT", "FOR", "RETURNING", "SET", "USING", "VALUES"}
_ABSENT = {"UNION", "INTERSECT", "EXCEPT", "RIGHT", "FULL", "OVER", "ROLLUP", "CUBE", "GROUPING"}
_INTEGRAL = {"tinyint", "smallint", "int", "bigint"}
_TYPES = {"int": "INT", "int4": "INT", "integer": "INT", "int8": "BIGINT", "bigint": "BIGINT", "int2": "SMALLINT", "smallint": "SMALLINT", "text": "STRING", "varchar": "STRING", "bool": "BOOLEAN", "boolean": "BOOLEAN", "float8": "DOUBLE", "float4": "FLOAT", "real": "FLOAT", "double": "DOUBLE", "numeric": "DECIMAL(38,18)", "decimal": "DECIMAL(38,18)", "uuid": "STRING", "inet": "STRING", "timestamp": "TIMESTAMP_NTZ", "timestamptz": "TIMESTAMP", "date": "DATE", "bytea": "BINARY", "jsonb": "STRING", "json": "STRING", "oid": "BIGINT", "string": "STRING"}
_FUNCTIONS = {"count", "sum", "avg", "min", "max", "coalesce", "char_length", "length", "mod", "abs", "lower", "upper", "nullif", "round", "substr", "substring", "greatest", "least", "array_append", "json_build_object", "now", "timezone", "version", "current_database", "concat", "date_trunc", "floor", "ceil"}


class SqlError(ValueError):
    """A statement error with its SQLSTATE."""

    def __init__(self, state: str, message: str) -> None:
        super().__init__(f"{state}: {message}")
        self.state = state


class _Rewriter(Cursor):
    def __init__(self, text: str, spark: SparkSession, params: tuple) -> None:
        super().__init__(text)
        self.spark, self.params = spark, params
        self.scope = [""]
        self.negated = 0
        self.ctes: list[str] = []

    # statements

    def name(self) -> str:
        """A plain name, or a quoted one in Spark's quotes."""
        if self.tok.kind == "str" and self.tok.text[0] == '"':
            return "`" + self.next().text[1:-1] + "`"
        return super().name()

    def table_name(self) -> str:
        """A table's name; the schema public is the session's own, and catalog tables are made as they are asked for."""
        out = self.name()
        if self.op("."):
            out = self.name() if out.strip("`") == "public" else f"{out}.{self.name()}"
        made = catalog.view(self.spark, out.replace("`", ""))
        if made is not None:
            out = out.replace("`", "").replace(".", "__").lower()
            made.createOrReplaceTempView(out)
        return out

    def query(self) -> str:
        return self.with_() + self.select()

    def with_(self) -> str:
        prefix = ""
        if self.word("WITH"):
            parts = []
            while True:
                name = self.name()
                self.need_word("AS")
                self.need("(")
                body = self.select()
                self.need(")")
                parts.append(f"{name} AS ({body})")
                self.ctes = [*self.ctes, parts[-1]]
                if not self.op(","):
                    break
            prefix = f"WITH {', '.join(parts)} "
        return prefix

    def _find_from(self) -> int | None:
        depth, k = 0, self.i
        while self.toks[k].kind != "end":
            t = self.toks[k]
            if t.text in "([" and t.kind == "op":
                depth += 1
            elif t.text in ")]" and t.kind == "op":
                depth -= 1
                if depth < 0:
                    return None
            elif not depth and t.kind == "name":
                if t.text.upper() == "FROM":
                    return k
                if t.text.upper() in _ABSENT:
                    raise SyntaxFault(f"{t.text.upper()} is not supported")
                if t.text.upper() in ("WHERE", "ORDER", "LIMIT"):
                    return None
            k += 1
        return None

    def select(self) -> str:
        self.need_word("SELECT")
        at, source, after = self._find_from(), "", None
        if at is not None:
            back, self.i = self.i, at + 1
            source = "FROM " + self.from_()
            after, self.i = self.i, back
        self.scope.append(source)
        distinct = "DISTINCT " if self.word("DISTINCT") else ""
        items = [self.item()]
        while self.op(","):
            items.append(self.item())
        if after is not None:
            if self.tok.text.upper() != "FROM":
                self.fault("unexpected text in the select list")
            self.i = after
        out = f"SELECT {distinct}{', '.join(items)} {source}"
        if self.word("WHERE"):
            out += f" WHERE {self.expr()}"
        if self.words("GROUP BY"):
            out += f" GROUP BY {self.expr()}"
            while self.op(","):
                out += f", {self.expr()}"
        if self.word("HAVING"):
            out += f" HAVING {self.expr()}"
        if self.words("ORDER BY"):
            keys = [self.order_key()]
            while self.op(","):
                keys.append(self.order_key())
            out += " ORDER BY " + ", ".join(keys)
        limit = offset = None
        while True:
            if self.word("LIMIT"):
                limit = self.bound("2201W", "LIMIT")
            elif self.word("OFFSET"):
                offset = self.bound("2201X", "OFFSET")
            else:
                break
        if limit is not None:
            out += f" LIMIT {limit}"
        if offset is not None:
            out += f" OFFSET {offset}"
        if self.word("FOR"):
            # read and dropped: a batch query has no rows to lock
            self.words("NO KEY") or self.word("KEY")
            self.need_word("UPDATE", "SHARE")
            if self.word("OF"):
                self.name()
                while self.op(","):
                    self.name()
            self.word("NOWAIT") or self.words("SKIP LOCKED")
        if self.is_word(*_ABSENT):
            raise SyntaxFault(f"{self.tok.text.upper()} is not supported")
        self.scope.pop()
        return out

    def bound(self, state: str, what: str) -> int | None:
        if self.word("NULL") or self.word("ALL"):
            return None
        minus = bool(self.op("-"))
        t = self.next()
        if t.kind == "par":
            value = self.params[int(t.text[1:]) - 1]
        elif t.kind == "num":
            value = int(t.text)
        else:
            self.fault(f"{what} takes a number")
        if value is None:
            return None
        value = -value if minus else value
        if value < 0:
            raise SqlError(state, f"{what} must not be negative")
        return value

    def item(self) -> str:
        if self.op("*"):
            return "*"
        if self.tok.kind == "name" and self.ahead().text == "." and self.ahead(2).text == "*":
            t = self.name()
            self.i += 2
            return f"{t}.*"
        e = self.expr()
        if self.word("AS"):
            return f"{e} AS {self.name()}"
        if self.tok.kind == "name" and self.tok.text.upper() not in _STOP:
            return f"{e} AS {self.name()}"
        return e

    def order_key(self) -> str:
        e = self.expr()
        down = self.word("ASC", "DESC") == "DESC"
        if self.word("NULLS"):
            return f"{e} {'DESC' if down else 'ASC'} NULLS {self.need_word('FIRST', 'LAST')}"
        return f"{e} {'DESC NULLS FIRST' if down else 'ASC NULLS LAST'}"

    def from_(self) -> str:
        out = self.relation()
        while True:
            if self.is_word("RIGHT", "FULL", "NATURAL"):
                raise SyntaxFault(f"{self.tok.text.upper()} JOIN is not supported")
            if self.op(","):
                out += f" CROSS JOIN {self.relation()}"
            elif self.words("CROSS JOIN"):
                out += f" CROSS JOIN {self.relation()}"
            elif self.is_word("JOIN", "INNER", "LEFT"):
                kind = "LEFT JOIN" if self.word("LEFT") else "JOIN"
                self.word("INNER")
                self.word("OUTER")
                self.need_word("JOIN")
                right = self.relation()
                self.need_word("ON")
                self.scope.append(f"FROM {out} {kind} {right}")
                out += f" {kind} {right} ON {self.expr()}"
                self.scope.pop()
            else:
                return out

    def relation(self) -> str:
        if self.op("("):
            out = f"({self.query()})"
            self.need(")")
        else:
            out = self.table_name()
        if self.word("AS") or self.tok.kind == "name" and self.tok.text.upper() not in _STOP | {"RIGHT", "FULL", "NATURAL"}:
            out += " AS " + self.name()
        return out

    # expressions, lowest precedence first

    def expr(self) -> str:
        out = self.conj()
        while self.word("OR"):
            out = f"({out} OR {self.conj()})"
        return out

    def conj(self) -> str:
        out = self.inverse()
        while self.word("AND"):
            out = f"({out} AND {self.inverse()})"
        return out

    def inverse(self) -> str:
        if self.word("NOT"):
            self.negated += 1
            out = f"(NOT {self.inverse()})"
            self.negated -= 1
            return out
        return self.predicate()

    def predicate(self) -> str:
        left = self.joined()
        while True:
            op = self.op("=", "<>", "!=", "<=", ">=", "<", ">")
            if op:
                if self.word("ANY", "SOME"):
                    left = self.any_(left, op)
                else:
                    left = self.compare(left, op, self.joined())
            elif self.word("IS"):
                no = "NOT " if self.word("NOT") else ""
                left = f"({left} IS {no}{self.need_word('NULL', 'TRUE', 'FALSE')})"
            elif self.is_word("IN", "BETWEEN", "LIKE") or self.is_word("NOT") and self.ahead().text.upper() in ("IN", "BETWEEN", "LIKE"):
                no = "NOT " if self.word("NOT") else ""
                if self.word("IN"):
                    self.need("(")
                    if self.is_word("SELECT", "WITH"):
                        inner = self.query()
                    else:
                        inner = self.expr()
                        while self.op(","):
                            inner += ", " + self.expr()
                    self.need(")")
                    left = f"({left} {no}IN ({inner}))"
                elif self.word("BETWEEN"):
                    low = self.joined()
                    self.need_word("AND")
                    left = f"({left} {no}BETWEEN {low} AND {self.joined()})"
                else:
                    self.next()
                    left = f"({left} {no}LIKE {self.joined()})"
            else:
                return left

    def compare(self, a: str, op: str, b: str) -> str:
        op = "<>" if op == "!=" else op
        ta, tb = self.kind(a), self.kind(b)
        plain = lambda s: s.replace(".", "").replace("_", "").isalnum() and not s[0].isdigit()
        if ta and tb and plain(a) and plain(b) and a.upper() not in ("TRUE", "FALSE", "NULL") and b.upper() not in ("TRUE", "FALSE", "NULL") and (ta == "string") != (tb == "string"):
            raise SqlError("42883", f"operator does not exist: {ta} {op} {tb}")
        floats = [x for x, t in ((a, ta), (b, tb)) if t in ("double", "float") and not x.replace(".", "").isdigit()]
        if not floats:
            return f"({a} {op} {b})"
        if self.negated:
            guard = lambda x: f"nullif({x}, double('NaN'))" if x in floats else x
            return f"({guard(a)} {op} {guard(b)})"
        # as a conjunct the guard leaves the comparison itself to be pushed to the scan
        return f"({a} {op} {b} AND " + " AND ".join(f"NOT isnan({x})" for x in floats) + ")"

    def any_(self, left: str, op: str) -> str:
        op = "<>" if op == "!=" else op
        self.need("(")
        if self.is_word("SELECT", "WITH"):
            inner = self.query()
            self.need(")")
            if op == "=":
                return f"({left} IN ({inner}))"
            # a semi join on the comparison; Spark has no ANY (subquery)
            return f"EXISTS (SELECT 1 FROM (SELECT * FROM ({inner}) AS _q(_x)) AS _any WHERE {left} {op} _any._x)"
        inner = self.expr()
        self.need(")")
        return f"exists({inner}, _e -> {left} {op} _e)"

    def joined(self) -> str:
        out = self.sum_()
        while self.op("||"):
            out = f"concat({out}, {self.sum_()})"
        return out

    def sum_(self) -> str:
        out = self.product()
        while op := self.op("+", "-"):
            out = f"({out} {op} {self.product()})"
        return out

    def product(self) -> str:
        out = self.sign()
        while op := self.op("*", "/", "%"):
            right = self.sign()
            if op == "/" and self.kind(out) in _INTEGRAL and self.kind(right) in _INTEGRAL:
                kind = "BIGINT" if "bigint" in (self.kind(out), self.kind(right)) else "INT"
                out = f"CAST({out} div {right} AS {kind})"
            else:
                out = f"({out} {op} {right})"
        return out

    def sign(self) -> str:
        if self.op("-"):
            return f"(- {self.sign()})"
        self.op("+")
        return self.postfix()

    def postfix(self) -> str:
        out = self.primary()
        while True:
            if self.op("::"):
                out = self.relation_oid(out) if self.regclass() else self.cast(out)
            elif self.op("["):
                out = f"get({out}, CAST({self.expr()} AS INT) - 1)"
                self.need("]")
            elif self.words("AT TIME ZONE"):
                self.utc(self.next().text)
                out = self.zoned(out)
            else:
                return out

    def regclass(self) -> bool:
        if self.tok.kind == "name" and self.tok.text.lower() == "pg_catalog" and self.ahead().text == "." and self.ahead(2).text.lower() == "regclass":
            self.next()
            self.next()
        return bool(self.word("REGCLASS"))

    def relation_oid(self, e: str) -> str:
        """The number of the relation that a text or parameter names."""
        name = self.params[int(e.removeprefix(":p")) - 1] if re.fullmatch(r":p\d+", e) else e[1:-1].replace("''", "'") if re.fullmatch(r"'(?:[^']|'')*'", e) else None
        if name is None:
            raise SqlError("0A000", "regclass takes a text or a parameter")
        oid = catalog.oid_of(self.spark, str(name))
        if oid is None:
            raise SqlError("42P01", f"no such relation: {name}")
        return f"{oid}L"

    def utc(self, zone: str) -> None:
        if zone.strip("'").upper() != "UTC":
            raise SqlError("0A000", f"time zone {zone}: only UTC is supported")

    def zoned(self, e: str) -> str:
        return f"CAST({e} AS TIMESTAMP_NTZ)" if self.kind(e) == "timestamp" else f"CAST({e} AS TIMESTAMP)"

    def type_name(self) -> str:
        name = self.name().lower()
        if name == "double":
            self.word("PRECISION")
        if name not in _TYPES:
            raise SqlError("42704", f"type {name} does not exist")
        out = _TYPES[name]
        if self.op("("):
            sizes = [self.next().text]
            while self.op(","):
                sizes.append(self.next().text)
            self.need(")")
            if name in ("numeric", "decimal"):
                out = f"DECIMAL({', '.join(sizes)})"
        while self.op("["):
            self.need("]")
            out = f"ARRAY<{out}>"
        return out

    def cast(self, e: str) -> str:
        return f"CAST({e} AS {self.type_name()})"

    def primary(self) -> str:
        t = self.tok
        if t.kind == "num":
            return self.next().text
        if t.kind == "str":
            if t.text[0] == '"':
                return self.reference()
            self.next()
            return "'" + t.text[1:-1].replace("''", "\\'") + "'"
        if t.kind == "par":
            self.next()
            n = int(t.text[1:])
            if n > len(self.params):
                raise SqlError("08P01", f"no value for ${n}")
            return f":p{n}"
        if self.op("("):
            if self.is_word("SELECT", "WITH"):
                out = f"({self.query()})"
            else:
                out = f"({self.expr()})"
            self.need(")")
            return out
        if t.kind != "name":
            self.fault("expected an expression")
        if t.text.upper() in _ABSENT:
            raise SyntaxFault(f"{t.text.upper()} is not supported")
        if self.word("CASE"):
            out = "CASE"
            if not self.is_word("WHEN"):
                out += " " + self.expr()
            while self.word("WHEN"):
                out += f" WHEN {self.expr()}"
                self.need_word("THEN")
                out += f" THEN {self.expr()}"
            if self.word("ELSE"):
                out += f" ELSE {self.expr()}"
            self.need_word("END")
            return out + " END"
        if self.word("CAST"):
            self.need("(")
            e = self.expr()
            self.need_word("AS")
            out = self.cast(e)
            self.need(")")
            return out
        if self.word("EXISTS"):
            self.need("(")
            out = f"EXISTS ({self.query()})"
            self.need(")")
            return out
        if self.word("ARRAY"):
            if self.op("["):
                items = [] if self.tok.text == "]" else [self.expr()]
                while self.op(","):
                    items.append(self.expr())
                self.need("]")
                return f"array({', '.join(items)})"
            self.need("(")
            out = self.array_of()
            self.need(")")
            return out
        if t.text.upper() in ("TIMESTAMP", "DATE", "TIME", "INET", "NUMERIC") and self.ahead().kind == "str":
            self.next()
            value = self.next().text
            return f"CAST({value} AS {_TYPES.get(t.text.lower(), 'STRING') if t.text.upper() != 'TIME' else 'TIME'})"
        if self.word("CURRENT_TIMESTAMP"):
            return "current_timestamp()"
        if t.text.upper() in ("TRUE", "FALSE", "NULL"):
            return self.next().text.upper()
        name = self.name()
        if self.op("("):
            return self.call(name.lower())
        return self.reference(name)

    def reference(self, start: str | None = None) -> str:
        out = self.name() if start is None else start
        while self.op("."):
            out += "." + self.name()
        return out

    def array_of(self) -> str:
        """``ARRAY(SELECT e ... ORDER BY k)``: a scalar subquery that collects, sorted by the key."""
        at = self.i
        inner = self.select()
        head, _, rest = inner.partition(" FROM ")
        value = head.removeprefix("SELECT ").split(" AS ")[0].strip()
        body, _, order = rest.partition(" ORDER BY ")
        if not order:
            return f"(SELECT coalesce(collect_list({value}), array()) FROM {body})"
        key, _, way = order.partition(" ")
        if " LIMIT " in order or "," in order:
            self.i = at
            self.fault("ARRAY(SELECT) sorts by one key and takes no LIMIT")
        sorted_ = f"array_sort(collect_list(struct({key} AS k, {value} AS v)))"
        if way.startswith("DESC"):
            sorted_ = f"reverse({sorted_})"
        return f"(SELECT transform({sorted_}, s -> s.v) FROM {body})"

    def call(self, name: str) -> str:
        if name not in _FUNCTIONS and name not in USER_FUNCTIONS:
            raise SqlError("42883", f"function {name} does not exist")
        if name == "count" and self.op("*"):
            self.need(")")
            return "count(*)"
        distinct = "DISTINCT " if self.word("DISTINCT") else ""
        args = [] if self.tok.text == ")" else [self.expr()]
        while self.op(","):
            args.append(self.expr())
        self.need(")")
        if self.is_word("OVER"):
            raise SyntaxFault("OVER is not supported")
        if name == "sum" and self.kind(args[0]) == "bigint":
            return f"sum({distinct}CAST({args[0]} AS DECIMAL(38,0)))"
        if name == "avg" and self.kind(args[0]) in _INTEGRAL:
            return f"avg({distinct}CAST({args[0]} AS DECIMAL(38,12)))"
        if name == "array_append":
            return f"concat(coalesce({args[0]}, array()), array({args[1]}))"
        if name == "json_build_object":
            return self.json_object(args)
        if name == "now":
            return "current_timestamp()"
        if name == "timezone":
            self.utc(args[0])
            return self.zoned(args[1])
        if name == "current_database":
            return "current_database()"
        if name == "version":
            return "'quadra on Spark'"
        return f"{name}({distinct}{', '.join(args)})"

    def json_object(self, args: list[str]) -> str:
        if len(args) % 2:
            raise SqlError("42883", "json_build_object takes pairs")
        parts = []
        for k, v in sorted(zip(args[::2], args[1::2], strict=True)):
            text = f"regexp_extract(to_json(struct({v} AS v), map('ignoreNullFields', 'false')), '(?s)^\\\\{{\"v\":(.*)\\\\}}$', 1)"
            parts.append(f"concat('\"', {k}, '\": ', {text})")
        return f"concat('{{', concat_ws(', ', {', '.join(parts)}), '}}')" if parts else "'{}'"

    def kind(self, e: str) -> str | None:
        """The type of an expression over the tables in scope, by analysis alone; None if it needs an outer row."""
        if re.search(r"\bSELECT\b", e) or any(not re.search(rf"\b{q}\b", self.scope[-1]) for q in re.findall(r"\b([A-Za-z_]\w*)\.[A-Za-z_]", re.sub(r"'[^']*'", "", e))):
            return None
        with_ = f"WITH {', '.join(self.ctes)} " if self.ctes else ""
        for source in (self.scope[-1], ""):
            try:
                df = _sql(self.spark, f"{with_}SELECT {e} AS x {source}", self.params)
                return df.schema[0].dataType.simpleString()
            except Exception:  # noqa: BLE001  analysis errors surface when the whole statement is analysed
                continue
        return None


def _sql(spark: SparkSession, text: str, params: tuple) -> DataFrame:
    return spark.sql(text, args={f"p{i + 1}": p for i, p in enumerate(params)} or None)


def rewrite(spark: SparkSession, text: str, params: tuple = ()) -> str:
    """The Spark SQL of a supported SELECT."""
    r = _Rewriter(text, spark, params)
    out = r.query()
    r.done()
    return out


def select(spark: SparkSession, text: str, params: tuple[Any, ...] = ()) -> DataFrame:
    """Run a SELECT over the session's temporary views; its schema is known without running it."""
    return _sql(spark, rewrite(spark, text, params), params)
