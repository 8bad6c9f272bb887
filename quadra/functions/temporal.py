"""Durations, time-based identifiers, addresses."""

from __future__ import annotations

import ipaddress
import re
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_UNITS = {"y": (12, 0, 0), "mo": (1, 0, 0), "w": (0, 7, 0), "d": (0, 1, 0), "h": (0, 0, 3_600_000_000_000), "m": (0, 0, 60_000_000_000), "s": (0, 0, 1_000_000_000), "ms": (0, 0, 1_000_000), "us": (0, 0, 1000), "µs": (0, 0, 1000), "ns": (0, 0, 1)}


@dataclass(frozen=True)
class Duration:
    months: int = 0
    days: int = 0
    nanos: int = 0

    def added_to(self, ts: Column, sign: int = 1) -> Column:
        from quadra.functions.semantics import add_duration

        return add_duration(ts, self.months, self.days, self.nanos, sign)


def parse_duration(text: str) -> Duration:
    """``1y2mo3d4h``, ``P1Y2M3DT4H5M6S``, ``P3W``; a leading minus negates all parts."""
    body = text.strip()
    sign = -1 if body.startswith("-") else 1
    body = body.removeprefix("-")
    if body[:1].upper() == "P":
        m = re.fullmatch(r"P(?:(\d+)W|(?:(\d+)Y)?(?:(\d+)M)?(?:(\d+)D)?(?:T(?:(\d+)H)?(?:(\d+)M)?(?:(\d+)S)?)?)", body.upper())
        if not m or not any(m.groups()):
            raise ValueError(f"no duration: {text!r}")
        w, y, mo, d, h, mi, s = (int(x or 0) for x in m.groups())
        return Duration(sign * (12 * y + mo), sign * (7 * w + d), sign * (h * 3600 + mi * 60 + s) * 10**9)
    parts = re.findall(r"(\d+)(mo|ms|us|µs|ns|[ywdhms])", body.lower())
    if not parts or "".join(n + u for n, u in parts) != body.lower():
        raise ValueError(f"no duration: {text!r}")
    months, days, nanos = (sum(int(n) * _UNITS[u][k] for n, u in parts) for k in range(3))
    return Duration(sign * months, sign * days, sign * nanos)


def timeuuid_micros(c: Column) -> Column:
    """Microseconds since 1970 of a version-1 UUID, from its 60-bit time."""
    hexes = F.concat(F.substring(c, 16, 3), F.substring(c, 10, 4), F.substring(c, 1, 8))
    ticks = F.conv(hexes, 16, 10).cast("decimal(20,0)")
    return ((ticks - F.lit(122192928000000000)) / 10).cast("long")


def new_timeuuid() -> Column:
    """A version-1 UUID of the statement's time; its clock and node parts are drawn for every row."""
    ticks = F.unix_micros(F.current_timestamp()) * 10 + F.lit(122192928000000000)
    h, drawn = F.lpad(F.lower(F.hex(ticks)), 16, "0"), F.expr("uuid()")
    return F.concat_ws("-", F.substring(h, 9, 8), F.substring(h, 5, 4), F.concat(F.lit("1"), F.substring(h, 2, 3)), F.substring(drawn, 20, 4), F.substring(drawn, 25, 12))


def to_timestamp(c: Column) -> Column:
    return F.timestamp_micros(timeuuid_micros(c))


@F.pandas_udf(T.BinaryType())
def inet_key(s: pd.Series) -> pd.Series:
    """Sort key of addresses: version 4 before 6, then by number."""

    def key(x):  # noqa: ANN001, ANN202
        if x is None:
            return None
        a = ipaddress.ip_address(x)
        return bytes([a.version]) + a.packed.rjust(16, b"\0")

    return s.map({x: key(x) for x in s.dropna().unique()}).astype(object).where(s.notna(), None)
