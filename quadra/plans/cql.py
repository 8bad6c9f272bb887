"""The wide-column front end: statements to DataFrames, scan plans, and change rows.

Grammar outside the subset is refused. Reads need keys, an index, or ALLOW FILTERING, as the plan tells.
"""

from __future__ import annotations

import datetime as dt
import struct
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadra.functions import geo, phonetic
from quadra.functions.murmur import bigint_token, text_token, token
from quadra.functions.temporal import Duration, new_timeuuid, parse_duration, to_timestamp
from quadra.operators.search import TextIndex, distance
from quadra.plans.lex import Cursor, SyntaxFault, unquote


@dataclass
class Table:
    """A table and its keys; ``indexes`` maps a name to (columns, kind), ``partial`` those that hold only some rows to
    the predicates that all of these meet."""

    df: DataFrame
    partition: list[str]
    clustering: list[str] = field(default_factory=list)
    indexes: dict[str, tuple[list[str], str]] = field(default_factory=dict)
    extensions: dict[str, str] = field(default_factory=dict)
    partial: dict[str, list[Predicate]] = field(default_factory=dict)


@dataclass(frozen=True)
class Shift:
    """A date or time literal moved by a duration."""

    base: Any
    by: Duration
    sign: int


@dataclass(frozen=True)
class TokenOf:
    """``token(v)`` of one partition key value."""

    value: Any


@dataclass(frozen=True)
class Predicate:
    columns: tuple[str, ...]
    op: str
    value: Any
    token: bool = False


@dataclass
class Select:
    table: str = ""
    items: list[tuple[str, Any, str | None]] = field(default_factory=list)  # (kind, argument or arguments, alias)
    distinct: bool = False
    where: list[Predicate] = field(default_factory=list)
    order: list[tuple[str, bool]] = field(default_factory=list)
    ann: tuple[str, list[float]] | None = None
    near: tuple[str, float, float] | None = None
    limit: int | None = None
    filtering: bool = False
    explain: bool = False


@dataclass
class Change:
    """One INSERT, UPDATE or DELETE: cells to write, by key."""

    kind: str
    table: str
    cells: dict[str, Any]
    where: list[Predicate]
    timestamp: int | None = None
    ttl: int | None = None
    condition: str | list[Predicate] | None = None


class _Parser(Cursor):
    def __init__(self, text: str, binds: tuple = ()) -> None:
        super().__init__(text, "-- //")
        self.binds = list(binds)

    def statement(self) -> Select | Change | list[Change]:
        if self.word("EXPLAIN"):
            out = self.select()
            out.explain = True
        elif self.is_word("SELECT"):
            out = self.select()
        elif self.word("BEGIN"):
            self.word("LOGGED", "UNLOGGED", "COUNTER")
            self.need_word("BATCH")
            out = []
            while not self.is_word("APPLY"):
                out.append(self.change())
                self.op(";")
            self.next()
            self.need_word("BATCH")
        else:
            out = self.change()
        self.done()
        return out

    def column(self) -> str:
        t = self.tok
        if t.kind == "str" and t.text[0] == '"':
            self.next()
            return unquote(t.text)
        return self.name().lower()

    def table_name(self) -> str:
        """A table, with or without its keyspace."""
        name = self.column()
        return self.column() if self.op(".") else name

    def select(self) -> Select:
        self.need_word("SELECT")
        s = Select(distinct=bool(self.word("DISTINCT")))
        self.word("JSON")
        while True:
            s.items.append(self.item())
            if not self.op(","):
                break
        self.need_word("FROM")
        s.table = self.table_name()
        if self.word("WHERE"):
            s.where = self.predicates()
        if self.words("ORDER BY"):
            first = self.column()
            if self.words("ANN OF"):
                s.ann = (first, self.value())
            elif self.words("GEO_NEAREST OF"):
                self.need("(")
                lat = float(self.value())
                self.need(",")
                s.near = (first, lat, float(self.value()))
                self.need(")")
            else:
                s.order = [(first, self.word("ASC", "DESC") == "DESC")]
                while self.op(","):
                    s.order.append((self.column(), self.word("ASC", "DESC") == "DESC"))
        if self.word("LIMIT"):
            s.limit = int(self.value())
            if s.limit <= 0:
                self.fault("LIMIT must be positive")
        if self.words("ALLOW FILTERING"):
            s.filtering = True
        if self.is_word("GROUP", "PER"):
            raise SyntaxFault(f"{self.tok.text.upper()} is not supported")
        return s

    def item(self) -> tuple[str, str, str | None]:
        if self.op("*"):
            return ("*", "*", None)
        name = self.column()
        kind, arg = "column", name
        if self.op("["):
            kind, arg = "element", (name, self.value())
            self.need("]")
        elif self.op("."):
            kind, arg = "field", (name, self.column())
            if self.tok.text == "(":  # a function named with its keyspace
                name = arg[1]
        if kind != "element" and self.op("("):
            kind = name
            if kind == "count" and self.op("*"):
                arg = "*"
            elif kind == "count" and self.word("DISTINCT"):
                kind, arg = "count_distinct", self.column()
            elif kind == "count" and self.word("ESTIMATE_DISTINCT"):
                kind, arg = "estimate_distinct", self.column()
            elif self.tok.text == ")":
                arg = ""
            else:
                arg = self.column()
                if kind == "totimestamp" and arg == "now" and self.op("("):
                    self.need(")")
                    arg = "now()"
                if self.tok.text == ",":
                    arg = [arg]
                    while self.op(","):
                        arg.append(self.column() if self.tok.kind == "name" and self.tok.text.upper() not in ("TRUE", "FALSE", "NULL") else (self.value(),))
            self.need(")")
        return (kind, arg, self.column() if self.word("AS") else None)

    def predicates(self) -> list[Predicate]:
        out = [self.predicate()]
        while self.word("AND"):
            out.append(self.predicate())
        if self.is_word("OR"):
            raise SyntaxFault("OR is not supported")
        return out

    def predicate(self) -> Predicate:
        if self.is_word("GEO_WITHIN_RADIUS", "GEO_WITHIN_BBOX", "ST_WITHIN", "FTS_MATCH") and self.ahead().text == "(":
            op = self.next().text.lower()
            self.need("(")
            col, args = self.column(), []
            while self.op(","):
                args.append(self.value())
            self.need(")")
            return Predicate((col,), op, args)
        token = False
        if self.is_word("TOKEN") and self.ahead().text == "(":
            self.next()
            token = True
        if self.op("("):
            cols = [self.column()]
            while self.op(","):
                cols.append(self.column())
            self.need(")")
        else:
            cols = [self.column()]
        if self.word("CONTAINS"):
            op = "contains key" if self.word("KEY") else "contains"
        elif self.word("IN"):
            op = "in"
        elif self.word("LIKE"):
            op = "like"
        elif self.words("SOUNDS LIKE"):
            op = "sounds like"
        else:
            op = self.op("=", "<", ">", "<=", ">=", "!=") or self.fault("expected a comparison")
            if op == "=" and self.is_word("FTS_MATCH"):
                self.next()
                self.need("(")
                query = self.value()
                self.need(")")
                return Predicate(tuple(cols), "fts_match", [query])
        return Predicate(tuple(cols), op, self.value(), token)

    def value(self) -> Any:
        out = self.term()
        while self.tok.text in ("+", "-") and self.ahead().kind == "dur":
            sign = 1 if self.next().text == "+" else -1
            out = Shift(out, parse_duration(self.next().text), sign)
        return out

    def function(self, name: str) -> Any:
        """A function of literals: now, uuid, currenttimestamp, totimestamp, token."""
        args = []
        while not self.op(")"):
            args.append(self.value())
            self.op(",")
        if name == "token" and len(args) == 1:
            return TokenOf(args[0])
        if name == "uuid" and not args:
            return str(uuid.uuid4())
        if name == "now" and not args:
            return str(uuid.uuid1())
        if name == "currenttimestamp" and not args:
            return dt.datetime.now(dt.UTC).replace(tzinfo=None)
        if name == "totimestamp" and len(args) == 1:
            ticks = uuid.UUID(str(args[0])).time
            return dt.datetime(1582, 10, 15) + dt.timedelta(microseconds=ticks // 10)
        raise SyntaxFault(f"function {name} is not supported")

    def term(self) -> Any:
        t = self.next()
        if t.kind == "op" and t.text == "?":
            if not self.binds:
                self.fault("no value for ?")
            return self.binds.pop(0)
        if t.kind == "op" and t.text == "-":
            v = self.value()
            return Duration(-v.months, -v.days, -v.nanos) if isinstance(v, Duration) else -v
        if t.kind == "str":
            return unquote(t.text)
        if t.kind == "num":
            return float(t.text) if any(c in t.text for c in ".eE") else int(t.text)
        if t.kind == "dur" and t.text[:2].lower() == "0x":
            return bytes.fromhex(t.text[2:])
        if t.kind == "dur":
            return parse_duration(t.text)
        if t.kind == "uuid":
            return t.text.lower()
        if t.kind == "name" and t.text.upper() in ("TRUE", "FALSE", "NULL"):
            return {"TRUE": True, "FALSE": False, "NULL": None}[t.text.upper()]
        if t.kind == "name" and self.op("("):
            return self.function(t.text.lower())
        if t.kind == "name" and t.text.upper().startswith("P"):
            return parse_duration(t.text)
        if t.kind == "op" and t.text in "([":
            close = ")" if t.text == "(" else "]"
            out = []
            while not self.op(close):
                out.append(self.value())
                self.op(",")
            return out if close == "]" else tuple(out)
        if t.kind == "op" and t.text == "{":
            keys, values, is_map = [], [], False
            while not self.op("}"):
                keys.append(self.value())
                if self.op(":"):
                    is_map = True
                    values.append(self.value())
                self.op(",")
            return dict(zip(keys, values, strict=True)) if is_map else set(keys)
        self.i -= 1
        return self.fault("expected a value")

    def using(self, c: Change) -> None:
        while self.word("USING", "AND"):
            if self.word("TIMESTAMP"):
                c.timestamp = int(self.value())
            else:
                self.need_word("TTL")
                c.ttl = int(self.value())

    def change(self) -> Change:
        if self.words("INSERT INTO"):
            c = Change("insert", self.table_name(), {}, [])
            self.need("(")
            names = [self.column()]
            while self.op(","):
                names.append(self.column())
            self.need(")")
            self.need_word("VALUES")
            c.cells = dict(zip(names, self.value(), strict=True))
            if self.words("IF NOT EXISTS"):
                c.condition = "not exists"
            self.using(c)
            return c
        if self.word("UPDATE"):
            c = Change("update", self.table_name(), {}, [])
            self.using(c)
            self.need_word("SET")
            while True:
                name = self.column()
                key = None
                if self.op("["):
                    key = self.value()
                    self.need("]")
                self.need("=")
                if self.tok.kind == "name" and self.tok.text.lower() == name:
                    self.next()
                    sign = self.op("+", "-") or self.fault("expected + or -")
                    c.cells[name] = (sign, self.value())
                else:
                    c.cells[name] = ("put", key, self.value()) if key is not None else self.value()
                if not self.op(","):
                    break
            self.need_word("WHERE")
            c.where = self.predicates()
        elif self.word("DELETE"):
            gone: dict[str, Any] = {}
            while not self.is_word("FROM"):
                name = self.column()
                gone[name] = None
                if self.op("["):
                    gone[name] = ("drop", self.value())
                    self.need("]")
                self.op(",")
            self.next()
            c = Change("delete", self.table_name(), gone, [])
            self.using(c)
            self.need_word("WHERE")
            c.where = self.predicates()
        else:
            return self.fault("unsupported statement")
        if self.words("IF EXISTS"):
            c.condition = "exists"
        elif self.word("IF"):
            c.condition = self.predicates()
        return c


def parse(text: str, binds: tuple = ()) -> Select | Change | list[Change]:
    return _Parser(text, binds).statement()


def _implies(p: Predicate, q: Predicate) -> bool:
    """Whether every row that meets ``p`` meets ``q``, both comparisons of one column with a value."""
    if p.columns != q.columns or p.value is None:
        return False
    if p.op == "in":
        return all(_implies(Predicate(p.columns, "=", v), q) for v in p.value)
    if type(p.value) is not type(q.value) and not all(isinstance(v, (int, float)) for v in (p.value, q.value)):
        return False
    a, b = p.value, q.value
    holds = {"=": a == b, "!=": a != b, "<": a < b, ">": a > b, "<=": a <= b, ">=": a >= b}
    if p.op == "=":
        return holds[q.op]
    if p.op == q.op:
        return holds["="] or p.op in ("<", ">", "<=", ">=") and holds[p.op[0]]
    below, above = p.op in ("<", "<="), p.op in (">", ">=")
    if q.op == "!=":
        return below and (holds["<"] or p.op == "<" and holds["="]) or above and (holds[">"] or p.op == ">" and holds["="])
    if below and q.op in ("<", "<="):
        return holds["<"] or holds["="] and q.op == "<="
    return above and q.op in (">", ">=") and (holds[">"] or holds["="] and q.op == ">=")


def plan(where: list[Predicate], table: Table, covered: tuple[str, ...] = ()) -> tuple:
    """The access path: ('PartitionKeyLookup',), ('SingleIndex', name, column), … Indexes change it, not the answer."""
    plain = [p for p in where if not p.token]
    equal = {c for p in plain if p.op == "=" for c in p.columns}
    usable = {name: x for name, x in table.indexes.items() if all(any(_implies(p, q) for p in plain) for q in table.partial.get(name, []))}
    single = {cols[0]: name for name, (cols, _) in reversed(usable.items()) if len(cols) == 1}
    hits = [(single[p.columns[0]], p.columns[0]) for p in plain if p.op == "=" and p.columns[0] in single]
    if table.partition and equal.issuperset(table.partition):
        rest = [h for h in hits if h[1] not in table.partition]
        if rest and not (equal.issuperset(table.clustering)):
            return ("PartitionIndexLookup", *rest[0])
        return ("PartitionKeyLookup",)
    if not hits:
        return ("FullScan",)
    if len(hits) > 1:
        return ("IndexIntersection", tuple(hits))
    name, column = hits[0]
    others = [c for p in plain for c in p.columns if c != column and c not in single and c not in covered]
    return ("IndexScanWithFilter", name, column, tuple(others)) if others else ("SingleIndex", name, column)


def _literal(v: Any) -> Column:
    if isinstance(v, Shift):
        return v.by.added_to(_literal(v.base).cast("timestamp_ntz"), v.sign)
    if isinstance(v, Duration):
        return F.struct(F.lit(v.months).alias("months"), F.lit(v.days).alias("days"), F.lit(v.nanos).cast("long").alias("nanos"))
    if isinstance(v, (list, tuple)):
        return F.array(*[_literal(x) for x in v])
    if isinstance(v, set):
        return F.array(*[_literal(x) for x in sorted(v)])
    if isinstance(v, dict):
        return F.create_map(*[_literal(x) for kv in v.items() for x in kv])
    return F.lit(v)


_COMPARE = {"=": "__eq__", "<": "__lt__", ">": "__gt__", "<=": "__le__", ">=": "__ge__", "!=": "__ne__"}


def condition(p: Predicate, df: DataFrame, key: str | None = None) -> Column:
    """A predicate as a Column; FTS_MATCH is a join and not made here."""
    cols = [F.col(c) for c in p.columns]
    first = cols[0]
    if p.token:
        if len(cols) > 1:
            raise SyntaxFault("token() of one partition key column only")
        kind = dict(df.dtypes)[p.columns[0]]
        t = text_token(first) if kind == "string" else bigint_token(first.cast("long"))
        end = p.value
        if isinstance(end, TokenOf):
            end = token(end.value.encode() if kind == "string" else struct.pack(">q", int(end.value)))
        return getattr(t, _COMPARE[p.op])(F.lit(end))
    if p.op == "in":
        if len(cols) > 1:
            options = [getattr(F.struct(*cols), "__eq__")(F.struct(*[F.lit(x).cast(df.schema[c].dataType).alias(c) for c, x in zip(p.columns, v, strict=True)])) for v in p.value]
            out = options[0]
            for o in options[1:]:
                out = out | o
            return out
        return first.isin(list(p.value))
    if p.op in _COMPARE:
        if len(cols) > 1:
            right = F.struct(*[F.lit(x).cast(df.schema[c].dataType).alias(c) for c, x in zip(p.columns, p.value, strict=True)])
            out = getattr(F.struct(*cols), _COMPARE[p.op])(right)
            if p.op in ("=", "!="):
                return out
            # what the slice says of its first column alone, for the scan to use
            return getattr(first, "__ge__" if ">" in p.op else "__le__")(F.lit(p.value[0])) & out
        return getattr(first, _COMPARE[p.op])(_literal(p.value))
    if p.op == "contains":
        return F.array_contains(F.map_values(first) if dict(df.dtypes)[p.columns[0]].startswith("map") else first, p.value)
    if p.op == "contains key":
        return F.map_contains_key(first, p.value)
    if p.op == "like":
        return first.like(str(p.value).replace("\\", "\\\\").replace("_", "\\_"))
    if p.op == "sounds like":
        return phonetic.sounds_like(first, p.value)
    lat, lon = first["lat"], first["lon"]
    if p.op == "geo_within_radius":
        return geo.within_radius(lat, lon, *map(float, p.value[0]), float(p.value[1]))
    if p.op == "geo_within_bbox":
        (south, west), (north, east) = p.value
        return geo.within_bbox(lat, lon, south, west, north, east)
    if p.op == "st_within":
        return geo.within_polygon(lat, lon, [tuple(map(float, x)) for x in p.value[0]])
    raise SyntaxFault(f"{p.op} is not supported")


_AGGREGATES = {"count": F.count, "sum": F.sum, "avg": F.avg, "min": F.min, "max": F.max, "count_distinct": F.count_distinct, "estimate_distinct": lambda c: F.approx_count_distinct(c, 0.02)}


@dataclass
class Function:
    """A user function: Columns to a Column, per row or per group."""

    make: Callable[..., Column]
    aggregate: bool = False


def select(catalog: dict[str, Table], text: str, binds: tuple = (), functions: dict[str, Function] | None = None) -> DataFrame:
    """Run a SELECT over the tables of ``catalog``; EXPLAIN gives its scan plan. ``functions``: the user's own, by name."""
    s = parse(text, binds)
    if not isinstance(s, Select):
        raise SyntaxFault("not a SELECT")
    functions = functions or {}
    if s.table not in catalog:
        raise LookupError(f"no such table: {s.table}")
    t = catalog[s.table]
    df = t.df
    how = plan(s.where, t)
    if s.explain:
        return df.sparkSession.createDataFrame([(how[0], str(how[1:]))], "plan string, detail string")
    searched = any(p.op in ("fts_match", "sounds like") or p.op.startswith(("geo_", "st_")) for p in s.where)
    slice_ = {c for p in s.where for c in p.columns}
    if s.where and how[0] in ("FullScan", "IndexScanWithFilter") and not s.filtering and not searched and not all(p.token for p in s.where) and not (slice_ <= set(t.partition)):
        raise SyntaxFault("this query reads every row: it needs ALLOW FILTERING")
    if any(p.op in ("like", "sounds like") for p in s.where) and not s.filtering and not any(k == "phonetic" for _, k in t.indexes.values()):
        raise SyntaxFault("LIKE needs ALLOW FILTERING")
    ranked = False
    for p in s.where:
        if p.op == "fts_match":
            key = t.partition[0]
            hits = TextIndex(df, key, p.columns[0]).match(p.value[0]).select(F.col("doc").alias(key), F.col("score").alias("_score"))
            df = df.drop("_score").join(hits, key)
            ranked = not s.order
        else:
            df = df.where(condition(p, df))
    own = lambda a: [F.lit(x[0]) if isinstance(x, tuple) else F.col(x) for x in (a if isinstance(a, list) else [a] if a else [])]
    aggs = [(k, a, n) for k, a, n in s.items if k in _AGGREGATES or k in functions and functions[k].aggregate]
    if aggs:
        if len(aggs) != len(s.items):
            raise SyntaxFault("aggregates reduce to one row: other columns have no value")
        made = []
        for k, a, n in aggs:
            if k in functions:
                made.append(functions[k].make(*own(a)).alias(n or f"{k}({a})"))
                continue
            made.append(_AGGREGATES[k](F.lit(1) if a == "*" else F.col(a)).alias(n or f"{k}({a})"))
        # sketches apart: beside a distinct count Spark would keep one for every distinct value
        wide = [k == "estimate_distinct" for k, _, _ in aggs]
        if any(wide) and any(k == "count_distinct" for k, _, _ in aggs):
            sketched, rest = ([c for c, w in zip(made, wide, strict=True) if w is x] for x in (True, False))
            # one row each, by place, as names may be the same
            named = [[c.alias(f"_{side}{i}") for i, c in enumerate(cols)] for side, cols in (("w", sketched), ("r", rest))]
            both = df.agg(*named[0]).crossJoin(df.agg(*named[1]))
            places = {True: iter(range(len(sketched))), False: iter(range(len(rest)))}
            out = both.select(*[F.col(f"_{'w' if w else 'r'}{next(places[w])}").alias(n or f"{k}({a})") for w, (k, a, n) in zip(wide, aggs, strict=True)])
        else:
            out = df.agg(*made)
        return out.limit(s.limit) if s.limit else out
    if s.ann:
        df = df.orderBy(distance(F.col(s.ann[0]), s.ann[1], t.extensions.get("metric", "l2")), *t.partition).limit(s.limit or 10)
    elif s.near:
        c = F.col(s.near[0])
        df = df.orderBy(geo.haversine(c["lat"], c["lon"], s.near[1], s.near[2]), *t.partition).limit(s.limit or 10)
    if ranked:
        df = df.orderBy(F.col("_score").desc(), *t.partition)
    cols = []
    for k, a, n in s.items:
        if k in functions:
            cols.append(functions[k].make(*own(a)).alias(n or f"{k}({a})"))
        elif k == "element":
            kind = dict(df.dtypes)[a[0]]
            cols.append((F.try_element_at(a[0], F.lit(a[1])) if kind.startswith("map") else F.get(a[0], F.lit(a[1]))).alias(n or f"{a[0]}[{a[1]}]"))
        elif k == "field":
            cols.append(F.col(a[0])[a[1]].alias(n or f"{a[0]}.{a[1]}"))
        elif k == "*":
            cols += [F.col(c) for c in t.df.columns]
        elif k == "column":
            cols.append(F.col(a).alias(n or a))
        elif k == "tojson":
            cols.append(F.to_json(F.struct(F.col(a).alias("v"))).alias(n or f"tojson({a})") if dict(df.dtypes)[a].split("<")[0] not in ("array", "map", "struct") else F.to_json(a).alias(n or f"tojson({a})"))
        elif k == "token":
            cols.append((text_token(a) if dict(df.dtypes)[a] == "string" else bigint_token(F.col(a).cast("long"))).alias(n or f"token({a})"))
        elif k in ("ttl", "writetime"):
            cols.append(F.lit(None).cast("long").alias(n or f"{k}({a})"))
        elif k == "totimestamp":
            cols.append(to_timestamp(new_timeuuid() if a == "now()" else F.col(a)).alias(n or f"totimestamp({a})"))
        elif k in ("now", "uuid"):
            cols.append((new_timeuuid() if k == "now" else F.expr("uuid()")).alias(n or f"{k}()"))
        else:
            raise SyntaxFault(f"function {k} is not supported")
    order = [F.col(c).desc() if down else F.col(c).asc() for c, down in s.order]
    if order and not s.distinct:
        df = df.orderBy(*order)
    out = df.select(*cols)
    if s.distinct:
        if not {a for _, a, _ in s.items} <= set(t.partition):
            raise SyntaxFault("DISTINCT takes partition key columns")
        out = out.distinct()
        out = out.orderBy(*order) if order else out
    return out.limit(s.limit) if s.limit and not s.ann and not s.near else out


def cells_of(text: str, keys: list[str], binds: tuple = (), now_us: int | None = None) -> list[dict]:
    """The change rows of a statement or batch: key, col, value, write_ts, ttl_s, tombstone."""
    parsed = parse(text, binds)
    stamp = int(time.time() * 1e6) if now_us is None else now_us
    out = []
    for c in parsed if isinstance(parsed, list) else [parsed]:
        if isinstance(c, Select):
            raise SyntaxFault("not a change")
        key = {k: c.cells[k] for k in keys if k in c.cells} if c.kind == "insert" else {p.columns[0]: p.value for p in c.where if p.op == "="}
        ts = stamp if c.timestamp is None else c.timestamp
        for name, value in c.cells.items():
            if name in keys:
                continue
            # an explicit null is a delete
            out.append(key | {"col": name, "value": None if value is None else str(value), "write_ts": ts, "ttl_s": c.ttl, "tombstone": c.kind == "delete" or value is None})
        if c.kind == "delete" and not c.cells:
            out.append(key | {"col": None, "value": None, "write_ts": ts, "ttl_s": None, "tombstone": True})
    return out
