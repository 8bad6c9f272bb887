"""Table sources: Parquet folders, rows in memory, COPY files, and system tables."""

from __future__ import annotations

import base64
import hashlib
import hmac
import json
import math
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A Parquet table; one that is missing is an error, never empty."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def views(spark: SparkSession, folder: str, names: Iterable[str] = TABLES[:8]) -> SparkSession:
    """Register tables of a folder as temporary views (only schemas are read)."""
    for name in names:
        table(spark, folder, name).createOrReplaceTempView(name)
    return spark


def memory(spark: SparkSession, rows: list, schema: str) -> DataFrame:
    """A table of rows in memory."""
    return spark.createDataFrame(rows, schema)


def one_row(spark: SparkSession) -> DataFrame:
    """The source of a query without FROM."""
    return spark.range(1).select()


def copy_csv(spark: SparkSession, path: str, schema: str, header: bool = False, delimiter: str = ",", null: str = "") -> DataFrame:
    """COPY FORMAT csv: doubled quotes, unquoted empty fields are null, quoted ones are empty text."""
    # a null marker that no field holds keeps quoted empty text apart from an empty field
    null = null or "\x01"
    return spark.read.schema(schema).options(header=header, sep=delimiter, quote='"', escape='"', nullValue=null, emptyValue="", mode="FAILFAST", multiLine=True).csv(path)


def _unescape(c: Column) -> Column:
    """COPY text escapes; a doubled backslash is set aside first, so that it escapes nothing."""
    hold = "\ue000"
    c = F.replace(c, F.lit("\\\\"), F.lit(hold))
    for mark, value in (("\\t", "\t"), ("\\n", "\n"), ("\\r", "\r"), ("\\b", "\b"), ("\\f", "\f"), ("\\v", "\v")):
        c = F.replace(c, F.lit(mark), F.lit(value))
    return F.replace(F.regexp_replace(c, r"\\(.)", "$1"), F.lit(hold), F.lit("\\"))


def copy_text(spark: SparkSession, path: str, schema: str) -> DataFrame:
    r"""COPY FORMAT text: tabs between fields, ``\N`` for null, C escapes; ends at ``\.``."""
    from pyspark.sql.types import _parse_datatype_string

    fields = _parse_datatype_string(schema).fields
    parts = F.split("value", "\t", -1)
    lines = spark.read.text(path).where("value <> '\\\\.'")
    wrong = F.size(parts) != len(fields)
    cells = [F.when(wrong, F.raise_error(F.concat(F.lit("wrong number of fields: "), F.col("value")))).when(parts[i] != "\\N", _unescape(parts[i])).cast(f.dataType).alias(f.name) for i, f in enumerate(fields)]
    return lines.select(*cells)


def system_tables(spark: SparkSession) -> DataFrame:
    """(name, type, temporary) of the session's tables."""
    rows = [(t.name, t.tableType, t.isTemporary) for t in spark.catalog.listTables()]
    return spark.createDataFrame(rows, "name string, type string, temporary boolean")


def system_columns(spark: SparkSession, names: Iterable[str]) -> DataFrame:
    """(table, column, position, type) of the named tables."""
    rows = [(n, f.name, i, f.dataType.simpleString()) for n in names for i, f in enumerate(spark.table(n).schema, 1)]
    return spark.createDataFrame(rows, "table string, column string, position int, type string")


def pages(df: DataFrame, keys: list[str], size: int, after: tuple | None = None) -> DataFrame:
    """One page in key order: rows whose key follows ``after``, by value, so no row is counted to be skipped."""
    if after is not None:
        # the first key's own bound is for the scan
        df = df.where(F.col(keys[0]) >= F.lit(after[0])).where(F.struct(*keys) > F.struct(*[F.lit(v).cast(df.schema[k].dataType).alias(k) for k, v in zip(keys, after, strict=True)]))
    return df.orderBy(*keys).limit(size)


def token_ranges(n: int) -> list[tuple[int, int]]:
    """The ring cut in ``n`` half-open ranges (start, end]."""
    step = math.ceil(2**64 / n)
    cuts = [-(2**63) + step * i for i in range(n)] + [2**63 - 1]
    return list(zip(cuts[:-1], cuts[1:], strict=True))


def page_token(last: tuple, secret: bytes) -> str:
    """A signed mark of a page's last key, for the client to hand back."""
    body = json.dumps(list(last)).encode()
    return base64.urlsafe_b64encode(hmac.digest(secret, body, hashlib.sha256) + body).decode()


def page_after(token: str, secret: bytes) -> tuple:
    """The key in a page token; one that was not signed with ``secret`` is refused."""
    raw = base64.urlsafe_b64decode(token)
    if not hmac.compare_digest(raw[:32], hmac.digest(secret, raw[32:], hashlib.sha256)):
        raise ValueError("the paging state was changed")
    return tuple(json.loads(raw[32:]))
