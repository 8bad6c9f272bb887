"""A tokenizer for the four query languages."""

from __future__ import annotations

import re
from dataclasses import dataclass

_TOKEN = re.compile(
    r"""(?P<space>\s+|--[^\n]*|//[^\n]*|/\*.*?\*/)
    |(?P<iri><[A-Za-z][A-Za-z0-9+.-]*:[^<>"{}|\\^`\s]*>)
    |(?P<str>'(?:[^'\\]|''|\\.)*'|"(?:[^"\\]|\\.)*")
    |(?P<uuid>[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12})
    |(?P<num>\d+\.\d+(?:[eE][+-]?\d+)?|\.\d+|\d++(?:[eE][+-]?\d+)?(?![A-Za-z_]))
    |(?P<dur>\d+[A-Za-z][A-Za-z0-9]*)
    |(?P<par>\$\w+|\?\w+)
    |(?P<name>[A-Za-z_]\w*|`[^`]+`)
    |(?P<op>::|->|<-|<=|>=|<>|!=|\|\||&&|\^\^|\.\.|[-+*/%=<>(),.\[\]{}:;|!?^$@#&])""",
    re.S | re.X,
)


class SyntaxFault(ValueError):
    """Text outside the supported grammar: refused, never guessed at."""


@dataclass(frozen=True)
class Token:
    kind: str
    text: str
    at: int


def tokens(text: str, comments: str = "--") -> list[Token]:
    out, at = [], 0
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise SyntaxFault(f"unexpected {text[at]!r} at {at}")
        kind = m.lastgroup
        if kind == "space" and m[0].startswith(("--", "//")) and not m[0].startswith(tuple(comments.split())):
            # a pattern such as (a)--(b), or an IRI's //, is no comment here
            out.append(Token("op", m[0][0], at))
            at += 1
            continue
        if kind != "space":
            out.append(Token(kind, m[0], at))
        at = m.end()
    out.append(Token("end", "", at))
    return out


class Cursor:
    """Recursive descent over tokens."""

    def __init__(self, text: str, comments: str = "--") -> None:
        self.source, self.toks, self.i = text, tokens(text, comments), 0

    @property
    def tok(self) -> Token:
        return self.toks[self.i]

    def ahead(self, n: int = 1) -> Token:
        return self.toks[min(self.i + n, len(self.toks) - 1)]

    def next(self) -> Token:
        t = self.tok
        self.i += 1
        return t

    def is_word(self, *words: str) -> bool:
        return self.tok.kind == "name" and self.tok.text.upper() in words

    def word(self, *words: str) -> str | None:
        """Take one of ``words`` if it is next."""
        if self.is_word(*words):
            return self.next().text.upper()
        return None

    def words(self, phrase: str) -> bool:
        """Take a run of words if it is next."""
        parts = phrase.split()
        if all(self.ahead(k).kind == "name" and self.ahead(k).text.upper() == p for k, p in enumerate(parts)):
            self.i += len(parts)
            return True
        return False

    def op(self, *ops: str) -> str | None:
        if self.tok.kind == "op" and self.tok.text in ops:
            return self.next().text
        return None

    def need(self, op: str) -> None:
        if not self.op(op):
            self.fault(f"expected {op!r}")

    def need_word(self, *words: str) -> str:
        return self.word(*words) or self.fault(f"expected {' or '.join(words)}")

    def name(self) -> str:
        if self.tok.kind != "name":
            self.fault("expected a name")
        return self.next().text.strip("`")

    def fault(self, what: str) -> None:
        raise SyntaxFault(f"{what} at {self.tok.text!r} (position {self.tok.at})")

    def done(self) -> None:
        self.op(";")
        if self.tok.kind != "end":
            self.fault("unexpected text")


def unquote(text: str) -> str:
    """The value of a quoted string."""
    body = text[1:-1]
    return re.sub(r"\\(.)", r"\1", body.replace("''", "'") if text[0] == "'" else body)
