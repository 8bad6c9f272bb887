"""Connected components of an edge table, by alternating stars; nothing is collected."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadra.llm.store import Workspace


#: Edges that one task takes at a time: a table of fewer is done in one task, without shuffles, as tables get in late rounds.
PART_ROWS = 200_000


def _is_star(edges: DataFrame, n: int) -> bool:
    """Whether every u has one v, and no v is a u: each v is then the least node of its component."""
    if edges.agg(F.count_distinct("u")).first()[0] != n:
        return False
    roots = edges.select("v").distinct().hint("merge")
    return edges.join(roots.withColumnRenamed("v", "r"), F.col("u") == F.col("r"), "left_semi").isEmpty()


def stars(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of some edges, one for each node but the least of its component: to that least node."""
    nodes, ends = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = ends[: len(u)], ends[len(u) :]
    low = np.arange(len(nodes))
    while True:
        x, y = low[a], low[b]
        apart = x != y
        if not apart.any():
            break
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(low, np.maximum(x, y), np.minimum(x, y))
        while (low[low] != low).any():
            low = low[low]
    outer = np.flatnonzero(low != np.arange(len(nodes)))
    return nodes[outer], nodes[low[outer]]


def contracted(edges: DataFrame, rows: int) -> DataFrame:
    """Edges (u, v) of the same components, u > v: each task holds ``rows`` edges at a time and gives their stars."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def given() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x) for x in stars(*(np.concatenate([h[i] for h in held]) for i in (0, 1)))], names=["u", "v"])

        held, n = [], 0
        for batch in batches:
            held.append([batch.column(i).to_numpy() for i in (0, 1)])
            n += batch.num_rows
            if n >= rows:
                yield given()
                held, n = [], 0
        if held:
            yield given()

    return edges.select("u", "v").mapInArrow(run, "u long, v long")


def components(edges: DataFrame, space: Workspace, most_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of ``edges`` (u, v): root is the smallest node of its component.

    Edges that tasks can do without go first: ``PART_ROWS`` edges at a time become the stars of their components, as
    long as that halves the table; a table of fewer is done with that. Of the rest, each round writes its edges, so a
    lost executor costs one round at most. Minima are combined before shuffles and hubs are joined, not gathered, so
    Spark can split them.
    """
    e = space.keep(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    for _ in range(most_rounds):
        n = e.count()
        while n:
            whole, before = n < PART_ROWS, n
            old, e = e, space.keep(contracted(e.coalesce(n // PART_ROWS + 1), PART_ROWS), "stars")
            space.drop(old)
            n = e.count()
            if whole or n >= PART_ROWS and 2 * n > before:
                break
        if not n or whole or _is_star(e, n):
            break
        parts = n // PART_ROWS + 1
        ends = F.array(F.struct(F.col("u").alias("u"), F.col("v").alias("v")), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))
        both = e.select(F.explode(ends).alias("x")).select("x.*")
        low = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("c"), F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low.hint("merge"), F.col("u") == F.col("c")).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = space.keep(large.coalesce(parts), "large")
        low = large.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("c"), "m")
        joined = large.join(low.hint("merge"), F.col("u") == F.col("c"))
        to_low = F.array(F.struct(F.col("u").alias("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))
        small = joined.select(F.explode(to_low).alias("x")).select("x.*").where("u <> v").distinct()
        nxt = space.keep(small.coalesce(parts), "small")
        space.drop(e, large)
        e = nxt
    else:
        raise RuntimeError("components did not settle")
    roots = e.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
