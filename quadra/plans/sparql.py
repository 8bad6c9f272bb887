"""The RDF front end: a SPARQL 1.1 subset over a table of triples.

A variable is a column of terms; triple patterns are filters and joins on whole terms; FILTER and BIND are
Column expressions; paths are closures. OPTIONAL is an extra (a left join). What is not supported is refused.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quadra.functions.semantics import close
from quadra.operators import rdf
from quadra.plans.lex import Cursor, SyntaxFault, unquote

_REFUSED = {"MINUS", "VALUES", "SERVICE", "HAVING", "EXISTS"}
_FUNCTIONS = {"str", "ucase", "lcase", "strlen", "abs", "ceil", "floor", "round", "if", "bound", "sameterm", "triple"}


class _Parser(Cursor):
    def __init__(self, text: str) -> None:
        super().__init__(text, "#")
        self.prefixes: dict[str, str] = {}
        self.blank = 0

    def prologue(self) -> None:
        while self.word("PREFIX"):
            name = self.name() if self.tok.kind == "name" else ""
            self.need(":")
            self.prefixes[name] = self.iri()

    def iri(self) -> str:
        t = self.tok
        if t.kind == "iri":
            self.next()
            return t.text[1:-1]
        name = self.name() if t.kind == "name" else ""
        self.need(":")
        if name not in self.prefixes:
            self.fault(f"unknown prefix {name}")
        local = self.next().text if self.tok.kind in ("name", "num", "dur") else ""
        return self.prefixes[name] + local

    def var(self) -> str:
        if self.tok.kind != "par":
            self.fault("expected a variable")
        return self.next().text[1:]

    def term(self) -> tuple:
        t = self.tok
        if t.kind == "par":
            return ("var", self.var())
        if t.kind == "name" and t.text == "_" and self.ahead().text == ":":
            self.i += 2
            return ("var", f"_b_{self.name()}")
        if self.op("["):
            self.need("]")
            self.blank += 1
            return ("var", f"_b{self.blank}")
        if t.kind == "str":
            self.next()
            value = unquote(t.text)
            if self.op("@"):
                lang = self.name()
                while self.op("-"):
                    lang += "-" + self.next().text
                return ("lit", value, None, lang.lower())
            if self.op("^^"):
                return ("lit", value, self.iri(), None)
            return ("lit", value, rdf.XSD + "string", None)
        if t.kind == "num" or t.kind == "op" and t.text in "+-":
            sign = self.op("-", "+") or ""
            text = self.next().text
            kind = "double" if "e" in text.lower() else "decimal" if "." in text else "integer"
            return ("lit", sign.replace("+", "") + text, rdf.XSD + kind, None)
        if self.is_word("TRUE", "FALSE"):
            return ("lit", self.next().text.lower(), rdf.XSD + "boolean", None)
        return ("iri", self.iri())

    def verb(self) -> tuple:
        if self.tok.kind == "par":
            return ("var", self.var())
        inverse = bool(self.op("^"))
        if self.is_word("A") and self.ahead().text != ":":
            self.next()
            name = rdf.RDF_TYPE
        else:
            name = self.iri()
        mark = self.op("+", "*", "?")
        if self.tok.text in ("/", "|", "!"):
            raise SyntaxFault(f"path operator {self.tok.text} is not supported")
        return ("path", name, inverse, mark) if inverse or mark else ("iri", name)

    def triples(self) -> list[tuple]:
        out = []
        s = self.term()
        while True:
            p = self.verb()
            while True:
                out.append(("triple", s, p, self.term()))
                if not self.op(","):
                    break
            if not self.op(";") or self.tok.text in (".", "}"):
                break
        self.op(".")
        return out

    def group(self) -> list[tuple]:
        self.need("{")
        out: list[tuple] = []
        while not self.op("}"):
            if self.is_word(*_REFUSED):
                raise SyntaxFault(f"{self.tok.text.upper()} is not supported")
            if self.word("FILTER"):
                if self.is_word("NOT", "EXISTS"):
                    raise SyntaxFault("FILTER EXISTS is not supported")
                out.append(("filter", self.expr()))
            elif self.word("BIND"):
                self.need("(")
                e = self.expr()
                self.need_word("AS")
                out.append(("bind", e, self.var()))
                self.need(")")
            elif self.word("OPTIONAL"):
                out.append(("optional", self.group()))
            elif self.word("GRAPH"):
                if self.tok.kind == "par":
                    raise SyntaxFault("GRAPH takes an IRI")
                out.append(("graph", self.iri(), self.group()))
            elif self.tok.text == "{":
                arms = [self.group()]
                while self.word("UNION"):
                    arms.append(self.group())
                out.append(("union", arms) if len(arms) > 1 else ("group", arms[0]))
            else:
                out += self.triples()
            self.op(".")
        return out

    # expressions

    def expr(self) -> tuple:
        out = self.conj()
        while self.op("||"):
            out = ("or", out, self.conj())
        return out

    def conj(self) -> tuple:
        out = self.comparison()
        while self.op("&&"):
            out = ("and", out, self.comparison())
        return out

    def comparison(self) -> tuple:
        out = self.sum_()
        if op := self.op("=", "!=", "<=", ">=", "<", ">"):
            out = ("cmp", op, out, self.sum_())
        return out

    def sum_(self) -> tuple:
        out = self.product()
        while op := self.op("+", "-"):
            out = ("math", op, out, self.product())
        return out

    def product(self) -> tuple:
        out = self.unary()
        while op := self.op("*", "/"):
            out = ("math", op, out, self.unary())
        return out

    def unary(self) -> tuple:
        if self.op("!"):
            return ("not", self.unary())
        if self.op("-"):
            return ("math", "-", ("lit", "0", rdf.XSD + "integer", None), self.unary())
        if self.op("("):
            out = self.expr()
            self.need(")")
            return out
        if self.tok.kind == "name" and self.ahead().text == "(":
            name = self.name().lower()
            self.need("(")
            if name == "count":
                distinct = bool(self.word("DISTINCT"))
                arg = None if self.op("*") else self.expr()
                self.need(")")
                return ("count", arg, distinct)
            if name not in _FUNCTIONS:
                raise SyntaxFault(f"function {name} is not supported")
            args = []
            while not self.op(")"):
                args.append(self.expr())
                self.op(",")
            return ("call", name, args)
        return self.term()


def _const(t: tuple) -> Column:
    if t[0] == "iri":
        return rdf.iri(t[1])
    return rdf.term("literal", t[1], t[2], t[3])


_BOOL = rdf.XSD + "boolean"


def _boolean(c: Column) -> Column:
    return F.when(c.isNotNull(), rdf.term("literal", c.cast("string"), _BOOL))


def _number_term(c: Column, kind: str) -> Column:
    return F.when(c.isNotNull(), rdf.term("literal", c, rdf.XSD + kind))


@dataclass(frozen=True)
class Solutions:
    """Rows of variables, and those variables that some rows leave open."""

    df: DataFrame
    loose: frozenset[str] = frozenset()


class _Run:
    def __init__(self, graph: DataFrame) -> None:
        self.graph, self.spark, self.n = graph, graph.sparkSession, 0

    def group(self, parts: list[tuple], graph: DataFrame) -> DataFrame:
        return self.solve(parts, graph).df

    def solve(self, parts: list[tuple], graph: DataFrame) -> Solutions:
        """Solutions of a group; its filters hold for the whole group."""
        rows: Solutions | None = None
        filters, at = [], 0
        while at < len(parts):
            p = parts[at]
            if p[0] == "triple":
                # patterns in a row are joined in an order of their own
                run = []
                while at < len(parts) and parts[at][0] == "triple":
                    run.append(parts[at])
                    at += 1
                rows = self.triples(run, graph, rows)
                continue
            at += 1
            if p[0] == "group":
                rows = self.join(rows, self.solve(p[1], graph))
            elif p[0] == "graph":
                rows = self.join(rows, self.solve(p[2], self.graph.where(F.col("graph") == p[1])))
            elif p[0] == "union":
                arms = [self.solve(arm, graph) for arm in p[1]]
                out = arms[0].df
                for x in arms[1:]:
                    out = out.unionByName(x.df, allowMissingColumns=True)
                loose = {c for c in out.columns for x in arms if c not in x.df.columns or c in x.loose}
                rows = self.join(rows, Solutions(out, frozenset(loose)))
            elif p[0] == "optional":
                rows = self.join(rows, self.solve(p[1], graph), "left")
            elif p[0] == "bind":
                base = Solutions(self.spark.range(1).select()) if rows is None else rows
                rows = Solutions(base.df.withColumn(p[2], self.value(p[1], base.df)), base.loose - {p[2]})
            else:
                filters.append(p[1])
        rows = Solutions(self.spark.range(1).select()) if rows is None else rows
        for e in filters:
            rows = Solutions(rows.df.where(self.truth(e, rows.df)), rows.loose)
        return rows

    def triples(self, todo: list[tuple], graph: DataFrame, rows: Solutions | None) -> Solutions:
        """Patterns from the one with most fixed places on, each next one sharing a variable where any does."""
        todo = list(todo)
        while todo:
            have = set() if rows is None else set(rows.df.columns)
            fixed = lambda p: sum(t[0] != "var" or t[1] in have for t in p[1:] if t[0] != "path")
            shares = lambda p: any(t[0] == "var" and t[1] in have for t in p[1:])
            is_path = lambda p: p[2][0] == "path"
            p = max(todo, key=lambda p: (shares(p), fixed(p), not is_path(p)))
            todo.remove(p)
            rows = self.join(rows, Solutions(self.triple(p, graph, rows)))
        return rows

    def join(self, rows: Solutions | None, found: Solutions, how: str = "inner") -> Solutions:
        """Compatible solutions. An open variable fits any value, so rows are parted by which shared variables they
        leave open, and each pair of parts is an equi-join on what both have; variables that are bound for
        certain never part anything."""
        if rows is None:
            base = self.spark.range(1).select()
            return found if how == "inner" else Solutions(base.join(found.df, F.lit(True), "left"), frozenset(found.df.columns))
        shared = [c for c in found.df.columns if c in rows.df.columns]
        self.n += 1
        names = {c: f"_j{self.n}_{c}" for c in shared}
        new = [c for c in found.df.columns if c not in shared]
        right = found.df.withColumnsRenamed(names)
        left_open, right_open = [c for c in shared if c in rows.loose], [c for c in shared if c in found.loose]

        def parts(df: DataFrame, names: dict[str, str], loose: list[str]) -> list[tuple[DataFrame, frozenset]]:
            out = []
            for mask in range(2 ** len(loose)):
                gone = {c for i, c in enumerate(loose) if mask >> i & 1}
                part = df
                for c in loose:
                    x = F.col(f"`{names[c]}`")
                    part = part.where(x.isNull() if c in gone else x.isNotNull())
                out.append((part, frozenset(gone)))
            return out

        def merged(df: DataFrame) -> DataFrame:
            return df.select(*[F.coalesce(F.col(f"`{c}`"), F.col(names[c])).alias(c) if c in shared else F.col(f"`{c}`") for c in rows.df.columns], *[F.col(f"`{c}`") for c in new])

        lefts, rights = parts(rows.df, {c: c for c in shared}, left_open), parts(right, names, right_open)
        out = None
        for l, l_gone in lefts:
            rest = l
            for r, r_gone in rights:
                keys = [c for c in shared if c not in l_gone and c not in r_gone]
                on = F.lit(True)
                for c in keys:
                    on = on & (F.col(f"`{c}`") == F.col(names[c]))
                if how == "left" and len(rights) == 1:
                    made = merged(l.join(r, on, "left"))
                else:
                    made = merged(l.join(r, on) if keys else l.crossJoin(r))
                    rest = rest.join(r.select(*names.values()), on, "left_anti") if how == "left" else rest
                out = made if out is None else out.unionByName(made)
            if how == "left" and len(rights) > 1:
                out = out.unionByName(rest.select(*rows.df.columns, *[F.lit(None).cast(rdf.TERM).alias(c) for c in new]))
        loose = (set(rows.loose) - set(shared)) | {c for c in shared if c in rows.loose and (c in found.loose or how == "left")}
        loose |= set(new) if how == "left" else set(found.loose) - set(shared)
        return Solutions(out, frozenset(loose))

    def triple(self, p: tuple, graph: DataFrame, known: Solutions | None = None) -> DataFrame:
        _, s, v, o = p
        rows = graph
        if v[0] == "path":
            rows = self.path(v, s, o, graph, known)
        elif v[0] == "iri":
            # by parts, so that the scan sees plain comparisons
            rows = rows.where((F.col("p.value") == v[1]) & (F.col("p.kind") == "iri"))
        out: list[Column] = []
        seen: dict[str, str] = {}
        for place, t in (("s", s), ("p", v), ("o", o)):
            if t[0] == "path" or place == "p" and t[0] == "iri":
                continue
            if t[0] == "var":
                if t[1] in seen:
                    rows = rows.where(F.col(place) == F.col(seen[t[1]]))
                else:
                    seen[t[1]] = place
                    out.append(F.col(place).alias(t[1]))
            else:
                rows = rows.where((F.col(f"{place}.value") == t[1]) & F.col(place).eqNullSafe(_const(t)))
        return rows.select(*out)

    def path(self, v: tuple, s: tuple, o: tuple, graph: DataFrame, known: Solutions | None = None) -> DataFrame:
        """(s, o) of a path. It is walked from the end that is fixed, or bound by the solutions so far, if any is."""
        _, name, inverse, mark = v
        edges = graph.where((F.col("p.value") == name) & (F.col("p.kind") == "iri")).select("s", "o")
        if inverse:
            edges = edges.select(F.col("o").alias("s"), F.col("s").alias("o"))
        if not mark:
            return edges.distinct().withColumn("p", F.lit(None))

        def ends(t: tuple) -> DataFrame | None:
            if t[0] != "var":
                return self.spark.range(1).select(_const(t).alias("s"))
            if known is not None and t[1] in known.df.columns and t[1] not in known.loose:
                return known.df.select(F.col(f"`{t[1]}`").alias("s")).distinct()
            return None

        starts, back = ends(s), False
        if starts is None:
            starts = ends(o)
            back = starts is not None
        if back:
            edges = edges.select(F.col("o").alias("s"), F.col("s").alias("o"))
        if starts is None and mark != "+":
            starts = graph.select("s").unionByName(graph.select(F.col("o").alias("s"))).distinct()
        found = rdf.closure(edges, starts, mark in "*?", mark in "+*")
        if back:
            found = found.select(F.col("o").alias("s"), F.col("s").alias("o"))
        return found.withColumn("p", F.lit(None))

    # expressions give terms; a null is an error or unbound

    def value(self, e: tuple, rows: DataFrame) -> Column:
        v = lambda x: self.value(x, rows)
        kind = e[0]
        if kind == "var":
            return F.col(f"`{e[1]}`") if e[1] in rows.columns else F.lit(None).cast(rdf.TERM)
        if kind in ("iri", "lit"):
            return _const(e)
        if kind in ("and", "or", "not", "cmp"):
            return _boolean(self.truth(e, rows))
        if kind == "math":
            return self.math(e[1], v(e[2]), v(e[3]))
        if kind == "call":
            return self.call(e[1], e[2], v, rows)
        raise SyntaxFault(f"{kind} is not supported here")

    def math(self, op: str, a: Column, b: Column) -> Column:
        """Integers stay exact; division gives a decimal cut at 18 digits; anything else is a double."""
        ints = rdf.is_integer(a) & rdf.is_integer(b)
        x, y = a["value"].try_cast("long"), b["value"].try_cast("long")
        p, q = rdf.number(a), rdf.number(b)
        if op == "/":
            frac = F.call_function("div", (F.abs(x) % F.abs(y)).cast("decimal(38,0)") * F.lit(10**18).cast("decimal(19,0)"), F.abs(y).cast("decimal(38,0)"))
            text = F.concat(F.when((x < 0) != (y < 0), "-").otherwise(""), F.call_function("div", F.abs(x), F.abs(y)), F.lit("."), F.lpad(frac.cast("string"), 18, "0"))
            text = F.regexp_replace(F.regexp_replace(text, "0+$", ""), r"\.$", "")
            return F.when(ints & (y != 0), rdf.term("literal", text, rdf.XSD + "decimal")).when(~ints, _number_term(F.try_divide(p, q), "double"))
        exact = {"+": F.try_add, "-": F.try_subtract, "*": F.try_multiply}[op](x, y)
        rough = {"+": p + q, "-": p - q, "*": p * q}[op]
        return F.when(ints, _number_term(exact, "integer")).otherwise(_number_term(rough, "double"))

    def call(self, name: str, args: list[tuple], v: Any, rows: DataFrame) -> Column:
        if name == "bound":
            return _boolean(v(args[0]).isNotNull())
        if name == "if":
            return F.when(self.truth(args[0], rows), v(args[1])).when(~self.truth(args[0], rows), v(args[2]))
        xs = [v(a) for a in args]
        if name == "sameterm":
            return _boolean(xs[0] == xs[1])
        if name == "triple":
            return F.when(xs[0].isNotNull() & xs[1].isNotNull() & xs[2].isNotNull(), rdf.term("triple", F.to_json(F.struct(xs[0].alias("s"), xs[1].alias("p"), xs[2].alias("o")))))
        text = xs[0]["value"]
        if name in ("str", "ucase", "lcase"):
            out = {"str": text, "ucase": F.upper(text), "lcase": F.lower(text)}[name]
            return F.when(out.isNotNull(), rdf.literal(out))
        if name == "strlen":
            return _number_term(F.char_length(text), "integer")
        n = rdf.number(xs[0])
        out = {"abs": F.abs(n), "ceil": F.ceil(n), "floor": F.floor(n), "round": F.round(n)}[name]
        whole = rdf.is_integer(xs[0])
        return F.when(whole, _number_term(out.cast("long"), "integer")).otherwise(_number_term(out.cast("double"), "double"))

    def truth(self, e: tuple, rows: DataFrame) -> Column:
        """The effective boolean value."""
        if e[0] == "and":
            return self.truth(e[1], rows) & self.truth(e[2], rows)
        if e[0] == "or":
            return self.truth(e[1], rows) | self.truth(e[2], rows)
        if e[0] == "not":
            return ~self.truth(e[1], rows)
        if e[0] == "cmp":
            a, b = self.value(e[2], rows), self.value(e[3], rows)
            p, q = rdf.number(a), rdf.number(b)
            s, t = a["value"], b["value"]
            ops = {"=": (close(p, q), s == t), "!=": (~close(p, q), s != t), "<": (p < q, s < t), ">": (p > q, s > t), "<=": (p <= q, s <= t), ">=": (p >= q, s >= t)}[e[1]]
            return F.when(p.isNotNull() & q.isNotNull(), ops[0]).otherwise(ops[1])
        t = self.value(e, rows)
        n = rdf.number(t)
        return F.when(t["datatype"] == _BOOL, t["value"] == "true").when(n.isNotNull(), n != 0).otherwise(F.char_length(t["value"]) > 0)


def _order_key(c: Column, down: bool) -> list[Column]:
    """Unbound first, then numbers by value, then by text."""
    keys = [c.isNotNull(), rdf.number(c), c["value"]]
    return [k.desc_nulls_last() if down else k.asc_nulls_first() for k in keys]


def query(graph: DataFrame, text: str) -> DataFrame:
    """Solutions (one column of terms per variable), a boolean row for ASK, or triples for CONSTRUCT and DESCRIBE."""
    p = _Parser(text)
    p.prologue()
    r = _Run(graph)
    if p.word("ASK"):
        p.word("WHERE")
        found = r.group(p.group(), graph)
        p.done()
        return found.limit(1).agg((F.count(F.lit(1)) > 0).alias("ask"))
    if p.word("CONSTRUCT"):
        template = [x for x in p.group() if x[0] == "triple"]
        p.word("WHERE")
        rows = r.group(p.group(), graph)
        p.done()
        return _build(r, template, rows).drop("graph").distinct()
    if p.word("DESCRIBE"):
        target = p.term()
        if target[0] == "iri":
            p.done()
            return graph.where((F.col("s.value") == target[1]) & (F.col("s.kind") == "iri")).select("s", "p", "o").distinct()
        p.word("WHERE")
        rows = r.group(p.group(), graph)
        p.done()
        ids = rows.select(F.col(target[1]).alias("_d")).distinct()
        return graph.join(ids, F.col("s") == F.col("_d"), "left_semi").select("s", "p", "o").distinct()
    p.need_word("SELECT")
    distinct = p.word("DISTINCT", "REDUCED") == "DISTINCT"
    items: list[tuple[tuple, str]] | None = None
    if not p.op("*"):
        items = []
        while not p.is_word("WHERE") and p.tok.text != "{":
            if p.op("("):
                e = p.expr()
                p.need_word("AS")
                items.append((e, p.var()))
                p.need(")")
            else:
                v = p.var()
                items.append((("var", v), v))
    p.word("WHERE")
    rows = r.group(p.group(), graph)
    keys: list[str] = []
    if p.words("GROUP BY"):
        while p.tok.kind == "par":
            keys.append(p.var())
    if p.is_word("HAVING"):
        raise SyntaxFault("HAVING is not supported")
    order: list[tuple[tuple, bool]] = []
    if p.words("ORDER BY"):
        while p.tok.kind == "par" or p.is_word("ASC", "DESC"):
            way = p.word("ASC", "DESC")
            if way:
                p.need("(")
                order.append((p.expr(), way == "DESC"))
                p.need(")")
            else:
                order.append((("var", p.var()), False))
    limit = offset = None
    while p.is_word("LIMIT", "OFFSET"):
        if p.word("LIMIT"):
            limit = int(p.next().text)
        else:
            p.next()
            offset = int(p.next().text)
    p.done()
    if items is None:
        items = [(("var", c), c) for c in rows.columns if not c.startswith("_b")]
    if keys or any(e[0] == "count" for e, _ in items):
        aggs = []
        for e, name in items:
            if e[0] == "count":
                arg = F.lit(1) if e[1] is None and not e[2] else F.struct(*[F.col(f"`{c}`") for c in rows.columns]) if e[1] is None else r.value(e[1], rows)
                aggs.append(_number_term(F.count_distinct(arg) if e[2] else F.count(arg), "integer").alias(name))
            elif e[0] != "var" or e[1] not in keys:
                raise SyntaxFault("a selected variable must be grouped")
        rows = rows.groupBy(*[F.col(f"`{k}`") for k in keys]).agg(*aggs)
        items = [(("var", n if e[0] == "count" else e[1]), n) for e, n in items]
    for e, name in items:
        if e[0] != "var":
            rows = rows.withColumn(name, r.value(e, rows))
    chosen = [(r.value(e, rows) if e[0] == "var" else F.col(f"`{n}`")).alias(n) for e, n in items]
    sort = lambda df: df.orderBy(*[k for e, down in order for k in _order_key(r.value(e, df), down)]) if order else df
    out = sort(rows.select(*chosen).distinct()) if distinct else sort(rows).select(*chosen)
    if offset:
        out = out.offset(offset)
    return out if limit is None else out.limit(limit)


def _build(r: _Run, template: list[tuple], rows: DataFrame, name: str = "") -> DataFrame:
    """Triples of a template, one per solution in which all its parts are bound."""
    spots = []
    for _, s, v, o in template:
        spots.append(F.named_struct(F.lit("graph"), F.lit(name), F.lit("s"), r.value(s, rows), F.lit("p"), r.value(v, rows), F.lit("o"), r.value(o, rows)))
    out = rows.select(F.explode(F.array(*spots)).alias("t")).select("t.*")
    return out.where("s is not null and p is not null and o is not null")


def update(graph: DataFrame, text: str) -> DataFrame:
    """The graph after an update request; the whole request is parsed before anything changes."""
    p = _Parser(text)
    p.prologue()
    todo: list[tuple] = []
    while p.tok.kind != "end":
        if p.words("INSERT DATA"):
            todo.append(("insert", *_quads(p)))
        elif p.words("DELETE DATA"):
            todo.append(("delete", *_quads(p)))
        elif p.words("DELETE WHERE"):
            body = p.group()
            todo.append(("modify", body, [], body))
        elif p.is_word("DELETE", "INSERT"):
            gone = p.group() if p.word("DELETE") else []
            put = p.group() if p.word("INSERT") else []
            p.need_word("WHERE")
            todo.append(("modify", gone, put, p.group()))
        elif p.word("CLEAR", "DROP"):
            p.word("SILENT")
            todo.append(("clear", p.iri() if p.word("GRAPH") else None if p.word("ALL") else "" if p.need_word("DEFAULT") else None))
        elif p.word("CREATE"):
            p.word("SILENT")
            p.need_word("GRAPH")
            p.iri()
        else:
            raise SyntaxFault(f"{p.tok.text} is not supported")
        p.op(";")
    for x in todo:
        r = _Run(graph)
        if x[0] in ("insert", "delete"):
            one = graph.sparkSession.range(1).select()
            rows = _build(r, x[2], one, x[1])
            graph = rdf.insert(graph, rows) if x[0] == "insert" else rdf.delete(graph, rows)
        elif x[0] == "clear":
            graph = rdf.clear(graph, x[1])
        else:
            found = r.group(x[3], graph)
            triples = lambda parts: [t for t in parts if t[0] == "triple"]
            before = graph
            if x[1]:
                graph = rdf.delete(graph, _build(r, triples(x[1]), found))
            if x[2]:
                graph = rdf.insert(graph, _build(_Run(before), triples(x[2]), found))
    return graph


def _quads(p: _Parser) -> tuple[str, list[tuple]]:
    body = p.group()
    if len(body) == 1 and body[0][0] == "graph":
        return body[0][1], body[0][2]
    if any(t[0] != "triple" or any(x[0] == "var" for x in t[1:]) for t in body):
        raise SyntaxFault("DATA takes triples without variables")
    return "", body


def lexical(solutions: DataFrame) -> DataFrame:
    """The lexical forms of all variables."""
    return solutions.select(*[F.col(f"`{c}`")["value"].alias(c) for c in solutions.columns])


def load(spark: SparkSession, rows: list[tuple[str, str, str]]) -> DataFrame:
    """A small graph of (subject IRI, predicate IRI, object): objects that are numbers or text become literals."""
    made = []
    for s, q, o in rows:
        if isinstance(o, int):
            t = ("literal", str(o), rdf.XSD + "integer", None)
        else:
            t = ("iri", o, None, None) if re.match(r"[a-z]+:", o) else ("literal", o, rdf.XSD + "string", None)
        made.append(("", ("iri", s, None, None), ("iri", q, None, None), t))
    return rdf.graph_of(spark.createDataFrame(made, f"graph string, s {rdf.TERM}, p {rdf.TERM}, o {rdf.TERM}"))
