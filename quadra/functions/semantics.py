"""Column helpers for comparison, ordering and arithmetic rules that differ from Spark's own."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

EPSILON = 2.220446049250313e-16


def pg_order(name: str | Column, descending: bool = False) -> Column:
    """SQL placement of nulls: last when ascending, first when descending."""
    c = F.col(name) if isinstance(name, str) else name
    return c.desc_nulls_first() if descending else c.asc_nulls_last()


def cypher_order(name: str | Column, descending: bool = False) -> Column:
    """Graph-query placement of nulls: before values when ascending."""
    c = F.col(name) if isinstance(name, str) else name
    return c.desc_nulls_last() if descending else c.asc_nulls_first()


def no_nan(c: Column) -> Column:
    """NaN as null, so that comparing it is unknown."""
    return F.when(~F.isnan(c), c)


def int_div(a: Column, b: Column) -> Column:
    """Integer division that truncates; division by zero is an error."""
    return F.call_function("div", a, b)


def any_of(xs: Column, test) -> Column:
    """``x op ANY (array)`` with three-valued logic; ``test`` maps an element to the comparison."""
    return F.exists(xs, test)


def append(xs: Column, x: Column, kind: str) -> Column:
    """Array append where a null array starts a new one."""
    return F.concat(F.coalesce(xs, F.array().cast(f"array<{kind}>")), F.array(x))


def close(a: Column, b: Column) -> Column:
    """Float equality within machine epsilon."""
    return F.abs(a - b) < EPSILON


def first_per_key(df: DataFrame, keys: list[str], arrival: list[Column]) -> DataFrame:
    """The first row of each key in arrival order: one row per key and task is shuffled, and nothing is sorted."""
    first = F.min_by(F.struct(*[F.col(f"`{c}`") for c in df.columns]), F.struct(*[a.alias(f"a{i}") for i, a in enumerate(arrival)]))
    return df.groupBy(*keys).agg(first.alias("_first")).select("_first.*")


def set_of(xs: Column) -> Column:
    """A list as a set: sorted, without repeats."""
    return F.array_sort(F.array_distinct(xs))


def set_add(xs: Column, ys: Column) -> Column:
    return F.array_sort(F.array_union(xs, ys))


def set_remove(xs: Column, ys: Column) -> Column:
    return F.array_sort(F.array_except(xs, ys))


def map_add(m: Column, n: Column) -> Column:
    """Entries of ``n`` replace those of ``m``."""
    return F.map_concat(F.map_filter(m, lambda k, _: ~F.array_contains(F.map_keys(n), k)), n)


def map_remove(m: Column, keys: Column) -> Column:
    return F.map_filter(m, lambda k, _: ~F.array_contains(keys, k))


def map_key(m: Column) -> Column:
    """A map as something that groups, joins and sorts."""
    return F.array_sort(F.map_entries(m))


def add_duration(ts: Column, months: int = 0, days: int = 0, nanos: int = 0, sign: int = 1) -> Column:
    """Months first (clamped to the month's end), then days, then nanoseconds (below a microsecond they are lost)."""
    seconds = sign * nanos / 1e9
    span = F.make_interval(F.lit(0), F.lit(sign * months), F.lit(0), F.lit(sign * days), F.lit(0), F.lit(0), F.lit(seconds).cast("decimal(18,6)"))
    return ts + span


def json_object(pairs: dict[str, Column]) -> Column:
    """JSON text of an object: keys sorted, nulls kept, ``": "`` and ``", "`` between."""

    def value(c: Column) -> Column:
        text = F.to_json(F.struct(c.alias("v")), {"ignoreNullFields": "false"})
        return F.regexp_extract(text, r"(?s)^\{\"v\":(.*)\}$", 1)

    parts = []
    for k in sorted(pairs):
        parts += [F.lit(", " if parts else ""), F.lit(f'"{k}": '), value(pairs[k])]
    return F.concat(F.lit("{"), *parts, F.lit("}"))


@F.pandas_udf(T.StringType())
def json_key(s):  # noqa: ANN001, ANN201
    """A canonical text of a JSON value that groups, joins and sorts by value: object keys sorted, 1 = 1.0."""
    import json
    from decimal import Decimal

    def plain(x):  # noqa: ANN001, ANN202
        if isinstance(x, dict):
            return "{" + ",".join(f"{json.dumps(k)}:{plain(x[k])}" for k in sorted(x)) + "}"
        if isinstance(x, list):
            return "[" + ",".join(map(plain, x)) + "]"
        if isinstance(x, Decimal):
            n = x.normalize()
            return format(n, "f") if n else "0"
        return json.dumps(x, ensure_ascii=False)

    known = {t: plain(json.loads(t, parse_float=Decimal, parse_int=Decimal)) for t in s.dropna().unique()}
    return s.map(known).astype(object).where(s.notna(), None)


def _json_bytes(x, top: bool = False) -> bytes:  # noqa: ANN001
    """Bytes that compare as the values do; see ``json_sort_key``."""
    from decimal import Decimal

    text = lambda t: t.encode().replace(b"\0", b"\0\xff") + b"\0\0"
    if x is None:
        return b"\x01"
    if isinstance(x, bool):
        return b"\x04\x01" if x else b"\x04\x00"
    if isinstance(x, str):
        return b"\x02" + text(x)
    if isinstance(x, Decimal):
        if not x:
            return b"\x03\x80"
        _, digits, _ = x.normalize().as_tuple()
        body = (x.adjusted() + (1 << 62)).to_bytes(8, "big") + bytes(d + 1 for d in digits) + b"\0"
        return b"\x03\x81" + body if x > 0 else b"\x03\x7f" + bytes(255 - b for b in body)
    if isinstance(x, list):
        if top and not x:
            return b"\x00"
        return b"\x05" + len(x).to_bytes(4, "big") + b"".join(map(_json_bytes, x))
    pairs = sorted(x.items(), key=lambda kv: (len(kv[0].encode()), kv[0].encode()))
    return b"\x06" + len(x).to_bytes(4, "big") + b"".join(len(k.encode()).to_bytes(4, "big") + k.encode() + _json_bytes(v) for k, v in pairs)


@F.pandas_udf(T.BinaryType())
def json_sort_key(s):  # noqa: ANN001, ANN201
    """Sort key of JSON values: null < string < number < boolean < array < object, and an empty array as a whole value
    before them all; numbers by exact value, arrays by length, objects by number of pairs and keys by length first."""
    import json
    from decimal import Decimal

    known = {t: _json_bytes(json.loads(t, parse_float=Decimal, parse_int=Decimal), True) for t in s.dropna().unique()}
    return s.map(known).astype(object).where(s.notna(), None)
