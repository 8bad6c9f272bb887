"""Reading versioned cells: last write wins, tombstones, time to live, counters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def latest(cells: DataFrame, key: list[str], value: str = "value", ts: str = "write_ts", tombstone: str = "tombstone", ttl: str | None = None, now: Column | None = None) -> DataFrame:
    """The winning cell per key: the newest, a write before a delete of the same time; deleted and expired ones go.

    One aggregation without sorting: the maximum of (time, is write, value).
    """
    # a null value written is a delete
    live = ~F.coalesce(F.col(tombstone), F.lit(False)) & F.col(value).isNotNull()
    cols = [F.col(ts).alias("t"), live.alias("w"), F.col(value).alias("v")]
    if ttl:
        cols.append(F.col(ttl).alias("l"))
    best = cells.groupBy(*key).agg(F.max(F.struct(*cols)).alias("b")).where("b.w")
    if ttl:
        best = best.where(F.col("b.l").isNull() | (F.col("b.t") + F.col("b.l") > now))
    stamp = [] if ts in key else [F.col("b.t").alias(ts)]
    return best.select(*key, F.col("b.v").alias(value), *stamp)


def latest_rows(cells: DataFrame, key: list[str], columns: list[str], **names: str) -> DataFrame:
    """Rows of the latest cells: one column per cell name."""
    got = latest(cells, [*key, "col"], **names)
    return got.groupBy(*key).agg(*[F.max(F.when(F.col("col") == c, F.col("value"))).alias(c) for c in columns])


def counters(deltas: DataFrame, key: list[str], delta: str = "delta") -> DataFrame:
    return deltas.groupBy(*key).agg(F.sum(delta).alias("value"))


def window_rows(cells: DataFrame, key: list[str], ck: str, start, end, **names: str) -> DataFrame:
    """Latest cells with ``start <= ck < end``, one per key and clustering value."""
    return latest(cells.where((F.col(ck) >= start) & (F.col(ck) < end)), [*key, ck], **names)
