"""Procedural blocks: declarations, assignments, IF, SELECT INTO, PERFORM, EXECUTE, RETURN, NULL.

Control flow runs on the driver; every expression and query is SQL of the relational front end, so data stays on
the cluster and one row at most comes back per statement.
"""

from __future__ import annotations

import re
from typing import Any

from pyspark.sql import SparkSession

from quadra.plans import sql
from quadra.plans.lex import SyntaxFault, Token, tokens

_RETURN = object()


class Procedure:
    """A parsed block; ``call`` runs it with its arguments and gives what it returns."""

    def __init__(self, spark: SparkSession, text: str, arguments: list[str] | None = None) -> None:
        body = re.sub(r"^\s*DO\s+", "", text, flags=re.I).strip().rstrip(";")
        m = re.fullmatch(r"(?s)\$(\w*)\$(.*)\$\1\$", body)
        self.source = m[2] if m else body
        self.spark, self.arguments = spark, arguments or []
        self.toks, self.i = tokens(self.source, "--"), 0
        self.declared: list[tuple[str, str | None]] = []
        if self._word("DECLARE"):
            while not self._is("BEGIN"):
                name = self._next().text
                self._type()
                start = None
                if self._op(":") and self._op("=") or self._op("="):
                    start = self._text(";")
                self._op(";")
                self.declared.append((name, start))
        self._need("BEGIN")
        self.body = self._block("END")
        self._need("END")

    def _next(self) -> Token:
        self.i += 1
        return self.toks[self.i - 1]

    def _is(self, *words: str) -> bool:
        return self.toks[self.i].kind == "name" and self.toks[self.i].text.upper() in words

    def _word(self, *words: str) -> bool:
        if self._is(*words):
            self.i += 1
            return True
        return False

    def _op(self, op: str) -> bool:
        if self.toks[self.i].kind == "op" and self.toks[self.i].text == op:
            self.i += 1
            return True
        return False

    def _need(self, word: str) -> None:
        if not self._word(word):
            raise SyntaxFault(f"expected {word} at {self.toks[self.i].text!r}")

    def _type(self) -> None:
        while not (self.toks[self.i].kind == "op" and self.toks[self.i].text in (":", ";", "=")):
            self._next()

    def _text(self, *ends: str) -> str:
        """Source text up to one of ``ends`` outside parentheses."""
        at, depth = self.toks[self.i].at, 0
        while True:
            t = self.toks[self.i]
            if t.kind == "end":
                raise SyntaxFault("a statement is not ended")
            if not depth and (t.text in ends or t.text.upper() in ends):
                return self.source[at : t.at]
            depth += (t.text == "(") - (t.text == ")")
            self.i += 1

    def _block(self, *ends: str) -> list[tuple]:
        out: list[tuple] = []
        while not self._is(*ends):
            if self._word("IF"):
                arms, other = [], []
                arms.append((self._text("THEN"), (self._need("THEN"), self._block("ELSIF", "ELSE", "END"))[1]))
                while self._word("ELSIF"):
                    arms.append((self._text("THEN"), (self._need("THEN"), self._block("ELSIF", "ELSE", "END"))[1]))
                if self._word("ELSE"):
                    other = self._block("END")
                self._need("END")
                self._need("IF")
                out.append(("if", arms, other))
            elif self._word("RETURN"):
                out.append(("return", None if self.toks[self.i].text == ";" else self._text(";")))
            elif self._word("PERFORM"):
                out.append(("perform", self._text(";")))
            elif self._word("EXECUTE"):
                out.append(("execute", self._text(";")))
            elif self._word("NULL"):
                pass
            elif self._is("SELECT"):
                text = self._text(";")
                m = re.fullmatch(r"(?is)\s*select\s+(.*?)\s+into\s+(\w+(?:\s*,\s*\w+)*)\s*(.*)", text)
                if not m:
                    raise SyntaxFault("a query needs INTO or PERFORM")
                out.append(("into", [x.strip() for x in m[2].split(",")], f"SELECT {m[1]} {m[3]}"))
            else:
                name = self._next().text
                if not (self._op(":") and self._op("=")):
                    raise SyntaxFault(f"unsupported statement at {name!r}")
                out.append(("set", name, self._text(";")))
            if not self._op(";"):
                raise SyntaxFault("a statement is not ended")
        return out

    def call(self, *arguments: Any) -> Any:
        scope = dict(zip(self.arguments, arguments, strict=True))
        for name, start in self.declared:
            scope[name] = None if start is None else self._value(start, scope)
        out = self._run(self.body, scope)
        return None if out is None else out[1]

    def _sql(self, text: str, scope: dict[str, Any]):
        names = sorted(scope, key=len, reverse=True)
        used: list[Any] = []

        def mark(m: re.Match) -> str:
            if m[0][0] in "'\"":
                return m[0]
            used.append(scope[m[0]])
            return f"${len(used)}"

        if names:
            text = re.sub(r"'(?:[^']|'')*'|\"[^\"]*\"|(?<![\w.])(?:" + "|".join(map(re.escape, names)) + r")(?![\w.(])", mark, text)
        return sql.select(self.spark, text, tuple(used))

    def _value(self, expression: str, scope: dict[str, Any]) -> Any:
        return self._sql(f"SELECT {expression}", scope).first()[0]

    def _run(self, body: list[tuple], scope: dict[str, Any]) -> tuple | None:
        for s in body:
            if s[0] == "set":
                if s[1] not in scope:
                    raise SyntaxFault(f"{s[1]} is not declared")
                scope[s[1]] = self._value(s[2], scope)
            elif s[0] == "if":
                chosen = next((arm for test, arm in s[1] if self._value(test, scope) is True), s[2])
                if (out := self._run(chosen, scope)) is not None:
                    return out
            elif s[0] == "return":
                return (_RETURN, None if s[1] is None else self._value(s[1], scope))
            elif s[0] == "into":
                row = self._sql(s[2], scope).first()
                for k, name in enumerate(s[1]):
                    scope[name] = None if row is None else row[k]
            elif s[0] == "perform":
                self._sql(f"SELECT {s[1]}", scope).write.format("noop").mode("overwrite").save()
            else:
                self._sql(self._value(s[1], scope), scope).write.format("noop").mode("overwrite").save()
        return None
