"""Incremental views, subscriptions and change streams as differences of tables."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class ViewError(ValueError):
    """A view that cannot be kept row by row."""


@dataclass
class View:
    """A view's key and columns over a base table's key."""

    base_key: list[str]
    key: list[str]
    columns: list[str]
    aggregates: bool = False
    static: list[str] = field(default_factory=list)
    over_view: bool = False
    not_null: list[str] = field(default_factory=list)
    counter_base: bool = False

    def check(self) -> None:
        if self.aggregates or self.static or self.over_view or self.counter_base:
            raise ViewError("aggregates, static columns, counters and views of views are not kept")
        if not set(self.base_key) <= set(self.key):
            raise ViewError("a view's key holds the whole key of its base")
        if len(set(self.key) - set(self.base_key)) > 1:
            raise ViewError("a view's key adds one column at most")
        if not set(self.key) <= set(self.not_null):
            raise ViewError("every key column must be restricted to IS NOT NULL")


def view_delta(old: DataFrame, new: DataFrame, view: View) -> DataFrame:
    """Changes of the view between two states of the base: op (upsert or delete) and the view's columns.

    A base row shows if its view key has no null; a changed view key is a delete and an upsert.
    """
    view.check()
    cols = list(dict.fromkeys([*view.key, *view.columns]))
    pack = lambda df, side: df.select(*[F.col(k).alias(f"_{k}") for k in view.base_key], F.struct(*cols).alias(side))
    on = [f"_{k}" for k in view.base_key]
    both = pack(old, "o").join(pack(new, "n"), on, "full_outer")

    def shows(side: str) -> Column:
        out = F.col(side).isNotNull()
        for k in view.key:
            out = out & F.col(f"{side}.{k}").isNotNull()
        return out

    key = lambda side: F.struct(*[F.col(f"{side}.{k}") for k in view.key])
    gone = shows("o") & (~shows("n") | (key("o") != key("n")))
    put = shows("n") & (~shows("o") | ~F.col("o").eqNullSafe(F.col("n")))
    change = lambda op, side, keep: F.struct(F.lit(op).alias("op"), *[(F.col(f"{side}.{c}") if c in keep else F.lit(None).cast(new.schema[c].dataType)).alias(c) for c in cols])
    ops = F.array_compact(F.array(F.when(gone, change("delete", "o", view.key)), F.when(put, change("upsert", "n", cols))))
    return both.select(F.explode(ops).alias("x")).select("x.*")


def apply_delta(view_rows: DataFrame, delta: DataFrame, view: View) -> DataFrame:
    """The view after its changes."""
    touched = delta.select(*view.key).distinct()
    return view_rows.join(touched, view.key, "left_anti").unionByName(delta.where("op = 'upsert'").select(view_rows.columns))


def subscription_delta(before: DataFrame, after: DataFrame) -> DataFrame:
    """Rows of a subscribed query that are new or changed since the last poll."""
    return after.exceptAll(before)


def committed(events: DataFrame, stream: str = "committed") -> DataFrame:
    """A change stream: at-least-once events of one stream, each mutation once."""
    return events.where(F.col("stream") == stream).dropDuplicates(["mutation_id"])


def gaps(events: DataFrame, sequence: str) -> DataFrame:
    """(table, from, to, missing): gaps in a stream's sequence numbers, per table; repeats are no gaps.

    Joins on (table, number) find the numbers next to a gap, so only those are put in order, however long a table's stream is.
    """
    from pyspark.sql import Window

    seen = events.select("table", F.col(sequence).alias("_at")).distinct()
    edge = lambda step, kind: seen.join(seen.select("table", (F.col("_at") + step).alias("_at")), ["table", "_at"], "left_anti").select("table", "_at", F.lit(kind).alias("_kind"))
    edges = edge(-1, 0).unionByName(edge(1, 1))  # 0: nothing follows, 1: nothing comes before
    after = F.lead("_at").over(Window.partitionBy("table").orderBy("_at", F.col("_kind").desc()))
    found = edges.withColumn("to", after).where("_kind = 0 and to is not null")
    return found.select("table", F.col("_at").alias("from"), "to", (F.col("to") - F.col("_at") - 1).alias("missing"))
