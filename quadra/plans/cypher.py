"""The graph front end: a Cypher-style subset as joins, groupings and generators over DataFrames.

A variable is a struct column of its vertex or edge. Patterns are join chains; pattern predicates are semi and anti
joins; OPTIONAL MATCH is a left join; UNWIND is a generator; WITH and RETURN group by their plain items.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quadra.functions.semantics import EPSILON, cypher_order
from quadra.operators.graph import Graph, reach
from quadra.plans.lex import Cursor, SyntaxFault, unquote

_AGG = {"count", "sum", "avg", "min", "max", "collect"}
_REFUSED = {"SKIP", "XOR", "STARTS", "ENDS", "CONTAINS", "LOAD", "CASE"}


@dataclass
class Node:
    var: str
    label: str | None
    props: list[tuple[str, Any]]


@dataclass
class Rel:
    var: str
    types: list[str]
    direction: str  # out, in, both
    props: list[tuple[str, Any]]
    span: tuple[int, int | None] | None = None


@dataclass
class Item:
    expr: tuple
    name: str


@dataclass
class Projection:
    items: list[Item]
    distinct: bool = False
    where: tuple | None = None
    order: list[tuple[tuple, bool]] = field(default_factory=list)
    limit: int | None = None


class _Parser(Cursor):
    def __init__(self, text: str, params: dict[str, Any]) -> None:
        super().__init__(text, "//")
        self.params, self.n = params, 0
        if self.is_word("LOAD"):
            self.fault("unsupported statement")

    def fresh(self) -> str:
        self.n += 1
        return f"_v{self.n}"

    def statement(self) -> tuple[list[list[tuple]], bool]:
        arms, every = [self.arm()], None
        while self.word("UNION"):
            all_ = bool(self.word("ALL"))
            if every is not None and every != all_:
                self.fault("UNION and UNION ALL do not mix")
            every = all_
            arms.append(self.arm())
        self.done()
        return arms, every is not False

    def arm(self) -> list[tuple]:
        out: list[tuple] = []
        withs = 0
        while self.tok.kind != "end" and self.tok.text != ";" and not self.is_word("UNION") and self.tok.text != "}":
            if self.words("OPTIONAL MATCH"):
                out.append(("optional", self.patterns(), self.where()))
            elif self.word("MATCH"):
                out.append(("match", self.patterns(), self.where()))
            elif self.word("UNWIND"):
                e = self.expr()
                self.need_word("AS")
                out.append(("unwind", e, self.name()))
            elif self.word("WITH"):
                withs += 1
                if withs > 1:
                    raise SyntaxFault("one WITH stage only")
                out.append(("with", self.projection()))
            elif self.word("RETURN"):
                out.append(("return", self.projection()))
            elif self.word("CALL"):
                self.need("{")
                imports = []
                if self.word("WITH"):
                    imports = [self.name()]
                    while self.op(","):
                        imports.append(self.name())
                inner = self.arm()
                self.need("}")
                out.append(("call", imports, inner))
            elif self.word("CREATE"):
                out.append(("create", self.patterns()))
            elif self.word("MERGE"):
                out.append(("merge", self.patterns()))
            elif self.is_word("FOREACH"):
                out.append(self.inner_change())
            elif self.word("SET"):
                out.append(("set", self.assignments()))
            elif self.word("REMOVE"):
                var = self.name()
                self.need(".")
                out.append(("set", [(var, self.name(), None)]))
            elif self.is_word("DETACH", "DELETE"):
                detach = bool(self.word("DETACH"))
                self.need_word("DELETE")
                names = [self.name()]
                while self.op(","):
                    names.append(self.name())
                out.append(("delete", names, detach))
            else:
                self.fault("unsupported clause")
        return out

    def inner_change(self) -> tuple:
        """One changing clause of a FOREACH body."""
        kind = self.need_word("CREATE", "MERGE", "SET", "FOREACH")
        if kind == "SET":
            return ("set", self.assignments())
        if kind != "FOREACH":
            return (kind.lower(), self.patterns())
        self.need("(")
        var = self.name()
        self.need_word("IN")
        xs = self.expr()
        self.need("|")
        inner = []
        while not self.op(")"):
            inner.append(self.inner_change())
        return ("foreach", var, xs, inner)

    def assignments(self) -> list[tuple]:
        out = []
        while True:
            var = self.name()
            self.need(".")
            prop = self.name()
            self.need("=")
            out.append((var, prop, self.expr()))
            if not self.op(","):
                return out

    def where(self) -> tuple | None:
        return self.expr() if self.word("WHERE") else None

    def projection(self) -> Projection:
        p = Projection([], bool(self.word("DISTINCT")))
        while True:
            at = self.tok.at
            e = self.expr()
            name = self.name() if self.word("AS") else self.source[at : self.tok.at].strip()
            p.items.append(Item(e, name))
            if not self.op(","):
                break
        if self.words("ORDER BY"):
            while True:
                e = self.expr()
                p.order.append((e, self.word("ASC", "DESC", "ASCENDING", "DESCENDING") in ("DESC", "DESCENDING")))
                if not self.op(","):
                    break
        if self.word("LIMIT"):
            t = self.next()
            p.limit = int(t.text) if t.kind == "num" else int(self.params[t.text[1:]])
        if self.is_word("SKIP"):
            raise SyntaxFault("SKIP is not supported")
        p.where = self.where()
        return p

    def patterns(self) -> list[list]:
        out = [self.path()]
        while self.op(","):
            out.append(self.path())
        return out

    def path(self) -> list:
        out: list = [self.node()]
        while self.tok.text in ("-", "<-", "<", "->"):
            out.append(self.rel())
            out.append(self.node())
        return out

    def props(self) -> list[tuple[str, Any]]:
        out = []
        if self.op("{"):
            while not self.op("}"):
                k = self.name()
                self.need(":")
                out.append((k, self.expr()))
                self.op(",")
        return out

    def node(self) -> Node:
        self.need("(")
        var = self.name() if self.tok.kind == "name" else self.fresh()
        label = self.name() if self.op(":") else None
        n = Node(var, label, self.props())
        self.need(")")
        return n

    def rel(self) -> Rel:
        left = bool(self.op("<-")) or bool(self.op("<") and self.op("-"))
        if not left:
            self.need("-")
        r = Rel(self.fresh(), [], "both", [])
        if self.op("["):
            if self.tok.kind == "name":
                r.var = self.name()
            if self.op(":"):
                r.types = [self.name()]
                while self.op("|"):
                    self.op(":")
                    r.types.append(self.name())
            if self.op("*"):
                number = lambda: int(self.next().text) if self.tok.kind == "num" else None
                low = number()
                high = number() if self.op("..") else low
                r.span = (1 if low is None else low, high)
            r.props = self.props()
            self.need("]")
        right = bool(self.op("->"))
        if not right:
            self.need("-")
            right = bool(self.op(">"))
        if left and right:
            self.fault("a relationship has one direction")
        r.direction = "in" if left else "out" if right else "both"
        return r

    # expressions as tuples

    def expr(self) -> tuple:
        out = self.conj()
        while self.word("OR"):
            out = ("or", out, self.conj())
        return out

    def conj(self) -> tuple:
        out = self.inverse()
        while self.word("AND"):
            out = ("and", out, self.inverse())
        return out

    def inverse(self) -> tuple:
        return ("not", self.inverse()) if self.word("NOT") else self.comparison()

    def comparison(self) -> tuple:
        out = self.sum_()
        while True:
            op = self.op("=", "<>", "<=", ">=", "<", ">")
            if op:
                out = ("cmp", op, out, self.sum_())
            elif self.word("IN"):
                out = ("in", out, self.sum_())
            elif self.word("IS"):
                no = bool(self.word("NOT"))
                self.need_word("NULL")
                out = ("isnull", out, no)
            elif self.is_word(*_REFUSED):
                raise SyntaxFault(f"{self.tok.text.upper()} is not supported")
            else:
                return out

    def sum_(self) -> tuple:
        out = self.product()
        while op := self.op("+", "-"):
            out = ("math", op, out, self.product())
        return out

    def product(self) -> tuple:
        out = self.sign()
        while op := self.op("*", "/"):
            out = ("math", op, out, self.sign())
        if self.tok.text in ("%", "^"):
            raise SyntaxFault(f"{self.tok.text} is not supported")
        return out

    def sign(self) -> tuple:
        if self.op("-"):
            return ("math", "-", ("lit", 0), self.sign())
        return self.postfix()

    def postfix(self) -> tuple:
        out = self.primary()
        while True:
            if self.op("."):
                out = ("prop", out, self.name())
            elif self.op("["):
                if self.op(".."):
                    out = ("slice", out, None, None if self.tok.text == "]" else self.expr())
                else:
                    a = self.expr()
                    if self.op(".."):
                        out = ("slice", out, a, None if self.tok.text == "]" else self.expr())
                    else:
                        out = ("index", out, a)
                self.need("]")
            elif self.tok.text == "{" and out[0] == "var":
                self.next()
                parts = []
                while not self.op("}"):
                    if self.op("."):
                        parts.append(("all",) if self.op("*") else ("own", self.name()))
                    else:
                        k = self.name()
                        self.need(":")
                        parts.append(("key", k, self.expr()))
                    self.op(",")
                out = ("mapproj", out[1], parts)
            else:
                return out

    def _pattern_here(self) -> bool:
        """Whether a path begins here: a closing parenthesis followed by a dash or an arrow."""
        k, depth = self.i, 0
        while self.toks[k].kind != "end":
            t = self.toks[k].text
            if self.toks[k].kind == "op":
                depth += (t == "(") - (t == ")")
                if not depth:
                    a, b = self.toks[k + 1].text, self.toks[k + 2].text if k + 2 < len(self.toks) else ""
                    return a == "<-" or a == "-" and b in ("[", "-", "->", ">") or a == "<" and b == "-" or a == "->"
            k += 1
        return False

    def primary(self) -> tuple:
        t = self.tok
        if t.kind == "num":
            self.next()
            return ("lit", float(t.text) if any(c in t.text for c in ".eE") else int(t.text))
        if t.kind == "str":
            return ("lit", unquote(self.next().text))
        if t.kind == "par":
            name = self.next().text[1:]
            if name not in self.params:
                self.fault(f"no value for ${name}")
            return ("lit", self.params[name])
        if t.text == "(":
            if self._pattern_here():
                return ("exists", self.path())
            self.next()
            out = self.expr()
            self.need(")")
            return out
        if self.op("["):
            if self.tok.text == "(" and self._pattern_here():
                path = self.path()
                where = self.where()
                self.need("|")
                e = self.expr()
                self.need("]")
                return ("patcomp", path, where, e)
            if self.tok.kind == "name" and self.ahead().text.upper() == "IN" and self.tok.text.upper() not in ("TRUE", "FALSE", "NULL"):
                var = self.name()
                self.next()
                xs = self.expr()
                where = self.where()
                e = self.expr() if self.op("|") else None
                self.need("]")
                return ("listcomp", var, xs, where, e)
            items = []
            while not self.op("]"):
                items.append(self.expr())
                self.op(",")
            return ("list", items)
        if t.text == "{":
            return ("map", self.props())
        if t.kind != "name":
            self.fault("expected an expression")
        word = t.text.upper()
        if word in ("TRUE", "FALSE", "NULL"):
            self.next()
            return ("lit", {"TRUE": True, "FALSE": False, "NULL": None}[word])
        if word in _REFUSED:
            raise SyntaxFault(f"{word} is not supported")
        name = self.name()
        if self.tok.text != "(":
            return ("var", name)
        self.next()
        low = name.lower()
        if low in ("any", "all"):
            var = self.name()
            self.need_word("IN")
            xs = self.expr()
            self.need_word("WHERE")
            p = self.expr()
            self.need(")")
            return ("quant", low, var, xs, p)
        if low == "count" and self.op("*"):
            self.need(")")
            return ("agg", "count", None, False)
        distinct = bool(self.word("DISTINCT"))
        args = []
        while not self.op(")"):
            args.append(self.expr())
            self.op(",")
        if low in _AGG:
            return ("agg", low, args[0], distinct)
        return ("call", low, args)


def _has_agg(e: Any) -> bool:
    return isinstance(e, tuple) and bool(e) and (e[0] == "agg" or any(_has_agg(x) for x in e[1:]))


def _conjuncts(e: tuple | None) -> list[tuple]:
    if e is None:
        return []
    return _conjuncts(e[1]) + _conjuncts(e[2]) if e[0] == "and" else [e]


def _variables(e: Any) -> set[str]:
    """Names that an expression reads."""
    if isinstance(e, (list, tuple)):
        if len(e) == 2 and e[0] == "var":
            return {e[1]}
        return set().union(*map(_variables, e)) if e else set()
    return set()


def _reads(clauses: list[tuple]) -> bool:
    return all(c[0] in ("match", "optional", "unwind", "with", "return") or c[0] == "call" and _reads(c[2]) for c in clauses)


def _rows(df: DataFrame) -> float:
    """About how many rows a table has: the catalog's count, or its size on disk at eight bytes a column."""
    stats = df._jdf.queryExecution().optimizedPlan().stats()
    known = stats.rowCount()
    return float(str(known.get())) if known.isDefined() else float(str(stats.sizeInBytes())) / (8 * len(df.columns))


def _lit(v: Any) -> Column:
    if isinstance(v, (list, tuple)):
        if v and all(isinstance(x, dict) for x in v):
            # maps of one list have all its keys
            keys = list(dict.fromkeys(k for x in v for k in x))
            v = [{k: x.get(k) for k in keys} for x in v]
        return F.array(*[_lit(x) for x in v])
    if isinstance(v, dict):
        return F.struct(*[_lit(x).alias(k) for k, x in v.items()])
    return F.lit(v)


class _Run:
    def __init__(self, graph: Graph, spark: SparkSession, ids: str = "string") -> None:
        self.graph, self.spark, self.n = graph, spark, 0
        self.ids = ids  # type of _id, _src and _dst
        self.filtered: set[str] = set()  # variables that a conjunct restricts by itself

    def arm(self, clauses: list[tuple], rows: DataFrame | None = None) -> DataFrame:
        for c in clauses:
            kind = c[0]
            if kind == "match":
                rows = self.match(c[1], c[2], rows)
            elif kind == "optional":
                rows = self.optional(c[1], c[2], rows)
            elif kind == "unwind":
                base = self.spark.range(1).select() if rows is None else rows
                rows = base.select("*", F.explode(self.value(c[1], base)).alias(c[2]))
            elif kind == "with":
                rows = self.project(c[1], rows)
            elif kind == "return":
                return self.project(c[1], self.spark.range(1).select() if rows is None else rows, last=True)
            elif kind == "call":
                rows = self.subquery(c[1], c[2], rows)
            elif kind == "foreach":
                self.foreach(c, self.spark.range(1).select() if rows is None else rows)
            elif kind in ("create", "merge", "set", "delete"):
                rows = self.change(c, self.spark.range(1).select() if rows is None else rows)
            else:
                raise SyntaxFault(f"{kind} is not supported here")
        return rows

    # reading

    def match(self, paths: list[list], where: tuple | None, rows: DataFrame | None) -> DataFrame:
        for c in _conjuncts(where):
            if c[0] in ("cmp", "in") and len(names := _variables(c)) == 1:
                self.filtered |= names
        return self.filter(self.pattern(paths, rows), where)

    def pattern(self, paths: list[list], rows: DataFrame | None) -> DataFrame:
        """All paths of a pattern, joined edge by edge in an order of their own.

        Edges with both ends bound come first, as they only thin out; then the edge that adds the fewest rows to each:
        its table's size by that of the vertices it starts from, a tenth if its new end has a test of its own. What is
        not joined to the rest starts from its most restricted vertex.
        """
        nodes: dict[str, Node] = {}
        hops = []
        for path in paths:
            for n in path[::2]:
                old = nodes.get(n.var, Node(n.var, None, []))
                if old.label and n.label and old.label != n.label or any(_variables(e) for _, e in n.props):
                    break
                nodes[n.var] = Node(n.var, old.label or n.label, old.props + n.props)
            else:
                hops += [(path[i - 1].var, path[i], path[i + 1].var) for i in range(1, len(path), 2)]
                continue
            # tests that read other variables, or two labels: in the order of the text
            for p in paths:
                rows = self.path(p, rows)
            return rows
        if rows is None and len(nodes) <= len(hops) <= 10 and all(not rel.span and not rel.props for _, rel, _ in hops) and {v for h in hops for v in (h[0], h[2])} == set(nodes):
            return self.cycle(nodes, hops)
        if rows is not None:
            for v in nodes:
                if v in rows.columns:
                    rows = self.check(rows, nodes[v])
        todo, have = list(nodes), set() if rows is None else set(rows.columns)
        flip = {"out": "in", "in": "out", "both": "both"}
        while hops or any(v not in have for v in todo):
            closing = [h for h in hops if h[0] in have and h[2] in have]
            open_ = [h for h in hops if h[0] in have or h[2] in have]
            if closing:
                hop = closing[0]
            elif open_:
                hop = min(open_, key=lambda h: self.growth(nodes, *h, h[0] not in have)) if len(open_) > 1 else open_[0]
            else:
                left = {v for h in hops for v in (h[0], h[2])} or {v for v in todo if v not in have}
                start = max((v for v in todo if v in left), key=self.restricted(nodes))
                found = self.scan(nodes[start])
                rows = found if rows is None else rows.crossJoin(found)
                rows = self.check(rows, Node(start, None, [p for p in nodes[start].props if p[1][0] != "lit"]))
                have.add(start)
                continue
            hops.remove(hop)
            a, rel, b = hop
            if a not in have:
                a, rel, b = b, replace(rel, direction=flip[rel.direction]), a
            rows = self.hop(rows, nodes[a], rel, nodes[b])
            have |= {a, b}
        return rows

    def cycle(self, nodes: dict[str, Node], hops: list[tuple]) -> DataFrame:
        """A pattern with cycles: edge tables are joined by ids, parts of the pattern with parts of it, on all vertices that
        they share at once, so that a cycle closes where both its halves are small. Vertices come last.

        The tree of joins is the one with the fewest rows in all, by estimates: vertices times, for each edge, the share of
        pairs that it joins.
        """
        end = lambda v: [f"_n_{v}_i", f"_n_{v}_l"]
        count = {v: self.vertices(nodes[v]) * (0.1 if self.restricted(nodes)(v) else 1.0) for v in nodes}
        ids = {v: self.scan(nodes[v]).select(*[F.col(f"{v}.{c}").alias(n) for c, n in zip(("_id", "_label"), end(v), strict=True)]) for v in nodes}
        leaves, share = [], []
        for a, rel, b in hops:
            links = self.links(rel, nodes[a], nodes[b])
            if links is None:
                raise SyntaxFault(f"no edge table joins {nodes[a].label} and {nodes[b].label}")
            share.append(_rows(links.select("_src", "_dst")) / (self.vertices(nodes[a]) * self.vertices(nodes[b])))
            names = zip(("_src", "_sl", "_dst", "_tl"), end(a) + end(b), strict=True)
            if a == b:
                links, names = links.where((F.col("_src") == F.col("_dst")) & (F.col("_sl") == F.col("_tl"))), list(names)[:2]
            links = links.select(*[F.col(c).alias(n) for c, n in names], F.col("e").alias(rel.var))
            for v in dict.fromkeys((a, b)):
                if self.restricted(nodes)(v):
                    links = links.join(ids[v], end(v), "left_semi")
            leaves.append(links)
        ends = [{a, b} for a, _, b in hops]
        over = {1 << k: ends[k] for k in range(len(hops))}
        best: dict[int, tuple[float, Any]] = {1 << k: (0.0, k) for k in range(len(hops))}

        def estimate(m: int) -> float:
            out = 1.0
            for v in over[m]:
                out *= count[v]
            for k in range(len(hops)):
                out *= share[k] if m >> k & 1 else 1.0
            return out

        for m in range(1, 1 << len(hops)):
            if m in best:
                continue
            part, found = (m - 1) & m, None
            while part:
                if part > m ^ part and part in best and m ^ part in best and over[part] & over[m ^ part]:
                    over[m] = over[part] | over[m ^ part]
                    cost = best[part][0] + best[m ^ part][0] + estimate(m)
                    found = min(found, (cost, (part, m ^ part)), key=lambda x: x[0]) if found else (cost, (part, m ^ part))
                part = (part - 1) & m
            if found:
                best[m] = found

        def joined(m: int) -> DataFrame:
            tree = best[m][1]
            if isinstance(tree, int):
                return leaves[tree]
            return joined(tree[0]).join(joined(tree[1]), [c for v in nodes if v in over[tree[0]] & over[tree[1]] for c in end(v)])

        # what no edge connects is crossed in the end, as the text asks
        whole, left = None, (1 << len(hops)) - 1
        while left:
            m = max((x for x in best if x & left == x), key=lambda x: x.bit_count())
            out = joined(m)
            whole, left = out if whole is None else whole.crossJoin(out), left ^ m
        for v in nodes:
            found = self.scan(nodes[v])
            whole = whole.join(found, (F.col(end(v)[0]) == F.col(f"{v}._id")) & (F.col(end(v)[1]) == F.col(f"{v}._label"))).drop(*end(v))
        return whole

    def vertices(self, n: Node) -> float:
        tables = [n.label] if n.label else list(self.graph.vertices)
        return max(1.0, sum(_rows(df.select(key)) for df, key in (self.graph.vertices[t] for t in tables if t in self.graph.vertices)))

    def restricted(self, nodes: dict[str, Node]):
        return lambda v: 2 * any(e[0] == "lit" for _, e in nodes[v].props) + (v in self.filtered)

    def growth(self, nodes: dict[str, Node], a: str, rel: Rel, b: str, back: bool) -> float:
        """About how many rows a hop makes of one, by the sizes that the tables have in the catalog or on disk."""
        start, end = (b, a) if back else (a, b)
        links = self.links(rel, nodes[a], nodes[b])
        grown = 0.0 if links is None else _rows(links.select("_src", "_dst")) / self.vertices(nodes[start])
        return grown / (10 if self.restricted(nodes)(end) else 1)

    def scan(self, n: Node) -> DataFrame:
        out = self.graph.nodes(n.label, self.ids).select(F.col("v").alias(n.var))
        for k, e in n.props:
            if e[0] == "lit":
                out = out.where(F.col(f"{n.var}.{k}") == self.value(e, out))
        return out

    def bound_props(self, rows: DataFrame, n: Node) -> DataFrame:
        """Property tests that read other variables; Spark turns those over a cross join into an equi-join."""
        return self.check(rows, replace(n, label=None, props=[p for p in n.props if p[1][0] != "lit"]))

    def path(self, path: list, rows: DataFrame | None) -> DataFrame:
        have = set() if rows is None else set(rows.columns)
        if path[0].var not in have and len(path) > 1 and path[-1].var in have:
            flip = {"out": "in", "in": "out", "both": "both"}
            path = [replace(x, direction=flip[x.direction]) if isinstance(x, Rel) else x for x in reversed(path)]
        first = path[0]
        if rows is None:
            rows = self.scan(first)
        elif first.var not in have:
            rows = self.bound_props(rows.crossJoin(self.scan(first)), first)
        elif first.props or first.label:
            rows = self.check(rows, first)
        for rel, node in zip(path[1::2], path[2::2], strict=True):
            rows = self.hop(rows, first, rel, node)
            first = node
        return rows

    def check(self, rows: DataFrame, n: Node) -> DataFrame:
        if n.label:
            rows = rows.where(F.col(f"{n.var}._label") == n.label)
        for k, e in n.props:
            rows = rows.where(F.col(f"{n.var}.{k}") == self.value(e, rows))
        return rows

    def hop(self, rows: DataFrame, a: Node, rel: Rel, b: Node) -> DataFrame:
        links = self.links(rel, a, b)
        bound = b.var in rows.columns
        if links is None:
            raise SyntaxFault(f"no edge table joins {a.label} and {b.label}")
        for k, e in rel.props:
            links = links.where(F.col(f"e.{k}") == self.value(e, links))
        if rel.span:
            links = self.spans(rows, a, rel, links)
        self.n += 1
        t = f"_h{self.n}"
        links = links.select(*[F.col(c).alias(f"{t}{c}") for c in ("_src", "_sl", "_dst", "_tl")], F.col("e").alias(rel.var))
        on = (F.col(f"{a.var}._id") == F.col(f"{t}_src")) & (F.col(f"{a.var}._label") == F.col(f"{t}_sl"))
        if bound:
            on = on & (F.col(f"{b.var}._id") == F.col(f"{t}_dst")) & (F.col(f"{b.var}._label") == F.col(f"{t}_tl"))
        end = (F.col(f"{t}_dst") == F.col(f"{b.var}._id")) & (F.col(f"{t}_tl") == F.col(f"{b.var}._label"))
        if not bound and (b.var in self.filtered or any(e[0] == "lit" for _, e in b.props)):
            # an end with a test of its own thins the edges out before they meet the rows
            out = rows.join(links.join(self.scan(b), end), on)
        else:
            out = rows.join(links, on)
            out = out if bound else out.join(self.scan(b), end)
        out = out.drop(*[f"{t}{c}" for c in ("_src", "_sl", "_dst", "_tl")])
        return self.check(out, b) if bound else self.bound_props(out, b)

    def links(self, rel: Rel, a: Node, b: Node) -> DataFrame | None:
        span = rel.span is not None
        out = self.graph.links(rel.types, None if span else a.label, None if span else b.label, self.ids) if rel.direction != "in" else None
        back = self.graph.links(rel.types, None if span else b.label, None if span else a.label, self.ids) if rel.direction != "out" else None
        if back is not None:
            back = back.select(F.col("_dst").alias("_src"), F.col("_tl").alias("_sl"), F.col("_src").alias("_dst"), F.col("_sl").alias("_tl"), "e")
        if out is None or back is None:
            return back if out is None else out
        return out.unionByName(back)

    def spans(self, rows: DataFrame, a: Node, rel: Rel, links: DataFrame) -> DataFrame:
        """Reachable pairs as links: each end once per start, at its least depth."""
        end = lambda i, l: F.struct(F.col(i).alias("i"), F.col(l).alias("l"))
        edges = links.select(end("_src", "_sl").alias("src"), end("_dst", "_tl").alias("dst"))
        starts = rows.select(F.struct(F.col(f"{a.var}._id").alias("i"), F.col(f"{a.var}._label").alias("l")).alias("start"))
        found = reach(starts, edges, *rel.span)
        return found.select(F.col("start.i").alias("_src"), F.col("start.l").alias("_sl"), F.col("end.i").alias("_dst"), F.col("end.l").alias("_tl"), F.struct("depth").alias("e"))

    def optional(self, paths: list[list], where: tuple | None, rows: DataFrame) -> DataFrame:
        shared = [v for v in dict.fromkeys(x.var for p in paths for x in p) if v in rows.columns]
        ids = rows.select(*shared).distinct()
        # the pattern's own WHERE may read outer variables, so those it names come along
        found = self.match(paths, where, ids)
        new = [c for c in found.columns if c not in shared]
        keys = found.select(*[F.col(f"{v}._id").alias(f"_k{i}") for i, v in enumerate(shared)], *[F.col(f"{v}._label").alias(f"_l{i}") for i, v in enumerate(shared)], *new)
        on = F.lit(True)
        for i, v in enumerate(shared):
            on = on & (F.col(f"{v}._id") == F.col(f"_k{i}")) & (F.col(f"{v}._label") == F.col(f"_l{i}"))
        return rows.join(keys, on, "left").drop(*[f"_k{i}" for i in range(len(shared))], *[f"_l{i}" for i in range(len(shared))])

    def filter(self, rows: DataFrame, where: tuple | None) -> DataFrame:
        if where is None:
            return rows
        if where[0] == "and":
            return self.filter(self.filter(rows, where[1]), where[2])
        if where[0] == "exists":
            return self.semi(rows, where[1], "left_semi")
        if where[0] == "not" and where[1][0] == "exists":
            return self.semi(rows, where[1][1], "left_anti")
        return rows.where(self.value(where, rows))

    def semi(self, rows: DataFrame, path: list, how: str) -> DataFrame:
        shared = [x.var for x in path if x.var in rows.columns]
        found = self.path(path, rows.select(*dict.fromkeys(shared)).distinct())
        keys = found.select(*[F.struct(f"{v}._id", f"{v}._label").alias(f"_k{i}") for i, v in enumerate(shared)]).distinct()
        on = F.lit(True)
        for i, v in enumerate(shared):
            on = on & (F.struct(f"{v}._id", f"{v}._label") == F.col(f"_k{i}"))
        return rows.join(keys, on, how)

    def subquery(self, imports: list[str], inner: list[tuple], rows: DataFrame) -> DataFrame:
        """Once per distinct row of the imports, grouped by them; a row without a result goes."""
        keys = rows.select(*imports).distinct() if imports else None
        body = [c for c in inner]
        if body[-1][0] != "return":
            self.arm(body, keys)
            return rows
        p = body[-1][1]
        carried = replace(p, items=[*[Item(("var", v), f"_in_{v}") for v in imports], *p.items])
        out = self.arm([*body[:-1], ("return", carried)], keys)
        if not imports:
            return rows.crossJoin(out)
        on = F.lit(True)
        for v in imports:
            on = on & rows[v].eqNullSafe(F.col(f"_in_{v}"))
        return rows.join(out, on).drop(*[f"_in_{v}" for v in imports])

    # projecting

    def project(self, p: Projection, rows: DataFrame, last: bool = False) -> DataFrame:
        rows, items = self.lift(rows, p.items)
        if any(_has_agg(i.expr) for i in items):
            plain = [i for i in items if not _has_agg(i.expr)]
            grouped = rows.groupBy(*[self.value(i.expr, rows).alias(i.name) for i in plain])
            out = grouped.agg(*[self.value(i.expr, rows).alias(i.name) for i in items if _has_agg(i.expr)])
            out = out.select(*[F.col(f"`{i.name}`") for i in items])
            order = [cypher_order(self.ordered(e, items, out), down) for e, down in p.order]
            if p.distinct:
                out = out.distinct()
            out = out.orderBy(*order) if order else out
        else:
            out = rows.select(*[self.value(i.expr, rows).alias(i.name) for i in items])
            if p.distinct:
                out = out.distinct()
            if p.order:
                if p.distinct or all(self.known(e, items) for e, _ in p.order):
                    out = out.orderBy(*[cypher_order(self.ordered(e, items, out), down) for e, down in p.order])
                else:
                    named = {i.name: self.value(i.expr, rows) for i in items}
                    out = rows.orderBy(*[cypher_order(named[e[1]] if e[0] == "var" and e[1] in named else self.value(e, rows), down) for e, down in p.order]).select(*[c.alias(n) for n, c in named.items()])
        if p.limit is not None:
            out = out.limit(p.limit)
        return self.filter(out, p.where)

    def known(self, e: tuple, items: list[Item]) -> bool:
        return e[0] == "var" and any(i.name == e[1] for i in items) or any(i.expr == e for i in items)

    def ordered(self, e: tuple, items: list[Item], out: DataFrame) -> Column:
        for i in items:
            if i.expr == e or e == ("var", i.name):
                return F.col(f"`{i.name}`")
        return self.value(e, out)

    def lift(self, rows: DataFrame, items: list[Item]) -> tuple[DataFrame, list[Item]]:
        """Pattern comprehensions become joined columns of collected lists."""
        out = []
        for i in items:
            if isinstance(i.expr, tuple) and i.expr[0] == "patcomp":
                _, path, where, e = i.expr
                shared = [x.var for x in path if x.var in rows.columns][:1]
                if not shared:
                    raise SyntaxFault("a pattern comprehension begins at a known variable")
                v = shared[0]
                found = self.filter(self.path(path, rows.select(v).distinct()), where)
                self.n += 1
                name = f"_pc{self.n}"
                made = found.groupBy(F.col(f"{v}._id").alias(f"{name}i"), F.col(f"{v}._label").alias(f"{name}l")).agg(F.collect_list(self.value(e, found)).alias(name))
                rows = rows.join(made, (F.col(f"{v}._id") == F.col(f"{name}i")) & (F.col(f"{v}._label") == F.col(f"{name}l")), "left").drop(f"{name}i", f"{name}l")
                out.append(Item(("coalesce_list", name), i.name))
            else:
                out.append(i)
        return rows, out

    def value(self, e: tuple, rows: DataFrame, scope: dict[str, Column] | None = None) -> Column:
        scope = scope or {}
        v = lambda x: self.value(x, rows, scope)
        kind = e[0]
        if kind == "lit":
            return _lit(e[1])
        if kind == "var":
            return scope.get(e[1], F.col(f"`{e[1]}`"))
        if kind == "coalesce_list":
            return F.coalesce(F.col(e[1]), F.array())
        if kind == "prop":
            return v(e[1])[e[2]]
        if kind == "and":
            return v(e[1]) & v(e[2])
        if kind == "or":
            return v(e[1]) | v(e[2])
        if kind == "not":
            return ~v(e[1])
        if kind == "isnull":
            return v(e[1]).isNotNull() if e[2] else v(e[1]).isNull()
        if kind == "in":
            xs = v(e[2])
            return F.exists(xs, lambda x: x == v(e[1]))
        if kind == "cmp":
            return self.compare(e[1], e[2], e[3], v, rows)
        if kind == "math":
            a, b = v(e[2]), v(e[3])
            return {"+": a + b, "-": a - b, "*": a * b, "/": a / b}[e[1]]
        if kind == "list":
            return F.array(*[v(x) for x in e[1]])
        if kind == "map":
            return F.struct(*[v(x).alias(k) for k, x in e[1]])
        if kind == "index":
            i = v(e[2])
            xs = v(e[1])
            return F.get(xs, F.when(i < 0, F.size(xs) + i).otherwise(i).cast("int"))
        if kind == "slice":
            xs = v(e[1])
            end = lambda x, default: default if x is None else F.when(v(x) < 0, F.greatest(F.size(xs) + v(x), F.lit(0))).otherwise(v(x)).cast("int")
            a, b = end(e[2], F.lit(0)), end(e[3], F.size(xs))
            return F.slice(xs, a + 1, F.greatest(F.least(b, F.size(xs)) - a, F.lit(0)))
        if kind == "listcomp":
            _, var, xs, where, out = e
            made = v(xs)
            if where is not None:
                made = F.filter(made, lambda x: self.value(where, rows, scope | {var: x}))
            return made if out is None else F.transform(made, lambda x: self.value(out, rows, scope | {var: x}))
        if kind == "quant":
            f = F.exists if e[1] == "any" else F.forall
            return f(v(e[3]), lambda x: self.value(e[4], rows, scope | {e[2]: x}))
        if kind == "mapproj":
            own = [f.name for f in rows.schema[e[1]].dataType.fields]
            parts = {}
            for p in e[2]:
                if p[0] == "all":
                    parts |= {k: F.col(f"{e[1]}.{k}") for k in own if not k.startswith("_")}
                elif p[0] == "own":
                    parts[p[1]] = F.col(f"{e[1]}.{p[1]}") if p[1] in own else F.lit(None)
                else:
                    parts[p[1]] = v(p[2])
            return F.struct(*[c.alias(k) for k, c in parts.items()])
        if kind == "agg":
            return self.aggregate(e, v)
        if kind == "call":
            return self.call(e[1], e[2], v, rows)
        raise SyntaxFault(f"{kind} is not supported here")

    def compare(self, op: str, left: tuple, right: tuple, v: Any, rows: DataFrame) -> Column:
        a, b = v(left), v(right)
        floats = any(x[0] == "lit" and isinstance(x[1], float) for x in (left, right))
        if floats and op in ("=", "<>"):
            near = F.abs(a - b) < EPSILON
            return near if op == "=" else ~near
        return {"=": a == b, "<>": a != b, "<": a < b, ">": a > b, "<=": a <= b, ">=": a >= b}[op]

    def aggregate(self, e: tuple, v: Any) -> Column:
        _, name, arg, distinct = e
        if arg is None:
            return F.count(F.lit(1))
        c = v(arg)
        if name == "count":
            return F.count_distinct(c) if distinct else F.count(c)
        if name == "collect":
            return F.collect_set(c) if distinct else F.collect_list(c)
        n = c.try_cast("double")
        if name == "sum":
            return F.coalesce(F.sum_distinct(n) if distinct else F.sum(n), F.lit(0.0))
        return {"avg": F.avg, "min": F.min, "max": F.max}[name](n)

    def call(self, name: str, args: list[tuple], v: Any, rows: DataFrame) -> Column:
        xs = [v(a) for a in args]
        if name == "id":
            return xs[0]["_id"].cast("string")
        if name == "type":
            return xs[0]["_type"]
        if name == "labels":
            return F.array(xs[0]["_label"])
        if name == "tostring":
            return xs[0].cast("string")
        if name == "tointeger":
            return xs[0].try_cast("double").cast("long")
        if name == "tofloat":
            return xs[0].try_cast("double")
        if name == "coalesce":
            return F.coalesce(*xs)
        if name == "abs":
            return F.abs(xs[0])
        if name == "keys":
            fields = [f.name for f in rows.schema[args[0][1]].dataType.fields if not f.name.startswith("_")]
            return F.array(*[F.lit(k) for k in sorted(fields)])
        if name == "size":
            kind = rows.select(xs[0].alias("x")).schema[0].dataType.typeName()
            return F.char_length(xs[0]) if kind == "string" else F.size(xs[0])
        raise SyntaxFault(f"function {name} is not supported")

    # changing; each change gives the rows that a RETURN after it sees

    def foreach(self, c: tuple, rows: DataFrame) -> None:
        each = rows.select("*", F.explode(self.value(c[2], rows)).alias(c[1]))
        for x in c[3]:
            if x[0] == "foreach":
                self.foreach(x, each)
            else:
                each = self.change(x, each)

    def change(self, c: tuple, rows: DataFrame) -> DataFrame:
        if c[0] in ("create", "merge"):
            for path in c[1]:
                for n in path[::2]:
                    if n.var not in rows.columns:
                        rows = self.new_node(n, rows, c[0] == "merge")
                for a, rel, b in zip(path[::2], path[1::2], path[2::2], strict=False):
                    self.new_edge(a, rel, b, rows, c[0] == "merge")
        elif c[0] == "set":
            for var, prop, e in c[1]:
                rows = self.assign(rows, var, prop, e)
        else:
            for var in c[1]:
                fields = [f.name for f in rows.schema[var].dataType.fields]
                if "_type" in fields:
                    self.graph = self.graph.unlink(rows.select(f"{var}.*").distinct())
                    continue
                for label in self.labels(rows, var):
                    self.graph = self.graph.delete(label, rows.where(F.col(f"{var}._label") == label).select(F.col(f"{var}._id").alias("id")), c[2])
        return rows

    def labels(self, rows: DataFrame, *variables: str) -> list:
        """The labels that occur: as many rows as there are vertex tables, or pairs of them."""
        found = [tuple(r) for r in rows.select(*[F.col(f"{v}._label").alias(f"l{i}") for i, v in enumerate(variables)]).distinct().collect() if None not in tuple(r)]
        return sorted(found) if len(variables) > 1 else sorted(x for x, in found)

    def new_node(self, n: Node, rows: DataFrame, merge: bool) -> DataFrame:
        if n.label is None:
            raise SyntaxFault("a new vertex needs a label")
        made = rows.select(*[self.value(e, rows).alias(k) for k, e in n.props])
        if merge and n.label in self.graph.vertices:
            self.graph = self.graph.merge(n.label, made.distinct(), [k for k, _ in n.props])
        else:
            self.graph = self.graph.create(n.label, made.distinct() if merge else made)
        if merge:
            return self.path([n], rows)
        key = self.graph.vertices[n.label][1]
        own = [self.value(e, rows).alias(k) for k, e in n.props]
        ident = [self.value(e, rows) for k, e in n.props if k == key] or [F.lit(None)]
        return rows.withColumn(n.var, F.struct(*own, ident[0].cast("string").alias("_id"), F.lit(n.label).alias("_label")))

    def new_edge(self, a: Node, rel: Rel, b: Node, rows: DataFrame, merge: bool) -> None:
        if rel.direction == "both" or rel.span or len(rel.types) != 1:
            raise SyntaxFault("a new edge has one type, one direction and one step")
        a, b = (b, a) if rel.direction == "in" else (a, b)
        ends = [F.col(f"{a.var}._id").alias("_from"), F.col(f"{b.var}._id").alias("_to")]
        for la, lb in self.labels(rows, a.var, b.var):
            some = rows.where((F.col(f"{a.var}._label") == la) & (F.col(f"{b.var}._label") == lb))
            made = some.select(*ends, *[self.value(e, some).alias(k) for k, e in rel.props])
            self.graph = self.graph.link(rel.types[0], la, lb, made, merge)

    def assign(self, rows: DataFrame, var: str, prop: str, e: tuple | None) -> DataFrame:
        """SET or REMOVE of one property, in every vertex table whose label occurs."""
        if "_type" in [f.name for f in rows.schema[var].dataType.fields]:
            raise SyntaxFault("properties of edges are set by deleting and creating them")
        have = {f.name: f.dataType for f in rows.schema[var].dataType.fields}
        value = self.value(e, rows) if e is not None else F.lit(None).cast(have.get(prop, "string"))
        for label in self.labels(rows, var):
            df, key = self.graph.vertices[label]
            new = rows.where(F.col(f"{var}._label") == label).select(F.col(f"{var}._id").alias("_hit"), value.alias("_new")).dropDuplicates(["_hit"])
            joined = df.join(new, F.col(key).cast("string") == F.col("_hit"), "left")
            old = F.col(prop) if prop in df.columns else F.lit(None)
            joined = joined.withColumn(prop, F.when(F.col("_hit").isNotNull(), F.col("_new")).otherwise(old)).drop("_hit", "_new")
            self.graph = replace(self.graph, vertices=self.graph.vertices | {label: (joined, key)})
        return rows.withColumn(var, F.col(var).withField(prop, value))


def run(graph: Graph, spark: SparkSession, text: str, params: dict[str, Any] | None = None) -> tuple[DataFrame | None, Graph]:
    """The rows of a statement, and the graph after it."""
    arms, all_ = _Parser(text, params or {}).statement()
    # a change may bring keys of other types, so only reading works on keys as they are
    r = _Run(graph, spark, graph.id_type() if all(map(_reads, arms)) else "string")
    out = None
    for arm in arms:
        rows = r.arm(arm)
        if out is None:
            out = rows
        else:
            if len(out.columns) != len(rows.columns):
                raise SyntaxFault("arms of a UNION have as many columns")
            out = out.union(rows)
    if len(arms) > 1 and not all_:
        out = out.distinct()
    return out, r.graph


def query(graph: Graph, spark: SparkSession, text: str, params: dict[str, Any] | None = None) -> DataFrame:
    return run(graph, spark, text, params)[0]
