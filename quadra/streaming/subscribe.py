"""SUBSCRIBE: a query run again and again, whole or as the rows that are new or changed, or a table's change stream."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from quadra.operators.graph import cut
from quadra.operators.timeseries import seconds
from quadra.operators.views import committed, subscription_delta
from quadra.plans.lex import SyntaxFault

_FORM = re.compile(r"(?is)\s*SUBSCRIBE\s+(?P<inner>(?:SELECT|MATCH|RETURN|UNWIND)\b.*?)(?:\s+ON\s+(?P<on>(?:LOCAL|COMMITTED)(?:\s*,\s*(?:LOCAL|COMMITTED))*))?(?:\s+EVERY\s+(?P<every>\w+))?(?P<delta>\s+DELTA)?\s*;?\s*")


@dataclass
class Subscription:
    """One subscribed query; ``run`` is the front end that carries it out."""

    inner: str
    run: Callable[[str], DataFrame]
    interval: float | None = None
    delta: bool = False
    streams: tuple[str, ...] = ()
    last: DataFrame | None = field(default=None, repr=False)

    def poll(self) -> DataFrame:
        """The rows now, or with DELTA those that the poll before did not have; a poll's rows are kept in the checkpoint folder."""
        now = cut(self.run(self.inner)) if self.delta else self.run(self.inner)
        out = subscription_delta(self.last, now) if self.delta and self.last is not None else now
        self.last = now if self.delta else None
        return out

    def changes(self, events: DataFrame) -> DataFrame:
        """The events of the subscribed streams, each mutation once per stream."""
        out = None
        for s in self.streams:
            part = committed(events, s)
            out = part if out is None else out.unionByName(part)
        if out is None:
            raise SyntaxFault("a polled subscription has no change stream")
        return out


@dataclass
class Subscriptions:
    """The open subscriptions of one client, by number."""

    run: Callable[[str], DataFrame]
    open: dict[int, Subscription] = field(default_factory=dict)
    _next: int = 1

    def execute(self, text: str) -> int | None:
        """SUBSCRIBE gives the number of the new subscription; UNSUBSCRIBE ends one or all."""
        if m := re.fullmatch(r"(?is)\s*UNSUBSCRIBE(?:\s+(\d+))?\s*;?\s*", text):
            if m[1] is None:
                self.open.clear()
            elif self.open.pop(int(m[1]), None) is None:
                raise LookupError(f"no such subscription: {m[1]}")
            return None
        self.open[self._next] = parse(text, self.run)
        self._next += 1
        return self._next - 1


def parse(text: str, run: Callable[[str], DataFrame]) -> Subscription:
    m = _FORM.fullmatch(text)
    if not m:
        raise SyntaxFault("expected SUBSCRIBE, a query, and ON, EVERY or DELTA")
    streams = tuple(x.strip().lower() for x in m["on"].split(",")) if m["on"] else ()
    if streams and (m["every"] or m["delta"]):
        raise SyntaxFault("a change stream is not polled")
    return Subscription(m["inner"], run, seconds(m["every"]) if m["every"] else None, bool(m["delta"]), streams)
