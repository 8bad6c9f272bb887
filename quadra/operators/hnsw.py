"""Approximate nearest vectors by navigable small-world graphs in layers, one graph to a shard of the table.

A shard's graph is built by one task and kept as one row of a table, so an index of any size is built and searched
shard by shard, and a lost task builds its shard again alike. A search walks the graph of every shard for every query, in
blocks of queries, and merges the shards' nearest. Distances are l2.
"""

from __future__ import annotations

import heapq
import io
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadra.operators.search import _least


class Layers:
    """Vectors and their links by layer; a vector of layer l is in all layers up to l."""

    def __init__(self, vectors: np.ndarray, links: int, seed: int = 1) -> None:
        self.v, self.links = np.ascontiguousarray(vectors, np.float32), links
        draws = np.random.default_rng(seed).random(len(vectors))
        self.level = np.floor(-np.log(np.maximum(draws, 1e-12)) / math.log(max(2, links))).astype(np.int32)
        #: Neighbours by layer and vector; the lowest layer has twice as many.
        self.near: list[dict[int, np.ndarray]] = [{} for _ in range(int(self.level.max(initial=0)) + 1)]
        self.entry = -1

    def far(self, q: np.ndarray, which: np.ndarray) -> np.ndarray:
        x = self.v[which] - q
        return np.einsum("ij,ij->i", x, x)

    def walk(self, q: np.ndarray, start: list[tuple[float, int]], breadth: int, layer: int) -> list[tuple[float, int]]:
        """The ``breadth`` nearest that a best-first walk from ``start`` meets, nearest first."""
        seen, todo = {i for _, i in start}, list(start)
        best = [(-d, i) for d, i in start]
        heapq.heapify(todo)
        heapq.heapify(best)
        while todo:
            d, i = heapq.heappop(todo)
            if len(best) >= breadth and d > -best[0][0]:
                break
            new = np.array([j for j in self.near[layer].get(i, ()) if j not in seen], np.int64)
            if not len(new):
                continue
            seen.update(new.tolist())
            for x, j in zip(self.far(q, new).tolist(), new.tolist(), strict=True):
                if len(best) < breadth or x < -best[0][0]:
                    heapq.heappush(todo, (x, j))
                    heapq.heappush(best, (-x, j))
                    if len(best) > breadth:
                        heapq.heappop(best)
        return sorted((-d, i) for d, i in best)

    def chosen(self, found: list[tuple[float, int]], most: int) -> np.ndarray:
        """Neighbours in different directions: each nearer to the vector than to any chosen before it; then the nearest."""
        kept: list[int] = []
        for d, i in found:
            if len(kept) == most:
                break
            if not kept or self.far(self.v[i], np.array(kept)).min() > d:
                kept.append(i)
        rest = [i for _, i in found if i not in kept]
        return np.array(kept + rest[: most - len(kept)], np.int64)

    def add(self, i: int, breadth: int) -> None:
        q, top = self.v[i], int(self.level[i])
        if self.entry >= 0:
            high = int(self.level[self.entry])
            start = [(float(self.far(q, np.array([self.entry]))[0]), self.entry)]
            for layer in range(high, top, -1):
                start = self.walk(q, start, 1, layer)
            for layer in range(min(high, top), -1, -1):
                start = self.walk(q, start, breadth, layer)
                most = self.links * (2 if layer == 0 else 1)
                mine = self.chosen(start, self.links)
                self.near[layer][i] = mine
                for j in mine.tolist():
                    both = np.append(self.near[layer].get(j, np.zeros(0, np.int64)), i)
                    if len(both) > most:
                        both = self.chosen(sorted(zip(self.far(self.v[j], both).tolist(), both.tolist(), strict=True)), most)
                    self.near[layer][j] = both
        for layer in range(top + 1):
            self.near[layer].setdefault(i, np.zeros(0, np.int64))
        if self.entry < 0 or top > self.level[self.entry]:
            self.entry = i

    def search(self, q: np.ndarray, k: int, breadth: int) -> list[tuple[float, int]]:
        if self.entry < 0:
            return []
        start = [(float(self.far(q, np.array([self.entry]))[0]), self.entry)]
        for layer in range(int(self.level[self.entry]), 0, -1):
            start = self.walk(q, start, 1, layer)
        return self.walk(q, start, max(k, breadth), 0)[:k]

    def dump(self, ids: np.ndarray) -> bytes:
        out, arrays = io.BytesIO(), {"ids": ids, "v": self.v, "level": self.level, "about": np.array([self.links, self.entry])}
        for layer, near in enumerate(self.near):
            keys = np.array(sorted(near), np.int64)
            sizes = np.array([len(near[k]) for k in keys.tolist()], np.int64)
            arrays |= {f"k{layer}": keys, f"n{layer}": sizes, f"l{layer}": np.concatenate([near[k] for k in keys.tolist()] or [np.zeros(0, np.int64)]).astype(np.int32)}
        np.savez(out, **arrays)
        return out.getvalue()

    @classmethod
    def load(cls, raw: bytes) -> tuple[Layers, np.ndarray]:
        x = np.load(io.BytesIO(raw))
        out = cls.__new__(cls)
        out.v, out.level, (out.links, out.entry), out.near = x["v"], x["level"], (int(a) for a in x["about"]), []
        while f"k{len(out.near)}" in x:
            layer = len(out.near)
            cut = np.split(x[f"l{layer}"].astype(np.int64), np.cumsum(x[f"n{layer}"])[:-1])
            out.near.append(dict(zip(x[f"k{layer}"].tolist(), cut, strict=False)))
        return out, x["ids"]


class LayeredIndex:
    """The graphs of a table's vectors: ``graphs`` has (shard, graph)."""

    def __init__(self, graphs: DataFrame, column: str, key: str) -> None:
        self.graphs, self.column, self.key = graphs, column, key

    @classmethod
    def build(cls, df: DataFrame, column: str, key: str, folder: str, shard_rows: int = 10_000, links: int = 16, breadth: int = 100) -> LayeredIndex:
        """Write the graphs of shards of about ``shard_rows`` vectors; null vectors are not indexed."""
        rows = df.where(F.col(column).isNotNull()).select(F.col(key).cast("long").alias("id"), F.col(column).alias("v"))
        shards = max(1, math.ceil(rows.count() / shard_rows))

        def graph(t: pa.Table) -> pa.Table:
            t = t.sort_by("id")
            made = Layers(np.array(t.column("v").to_pylist(), np.float32), links)
            for i in range(t.num_rows):
                made.add(i, breadth)
            return pa.table({"shard": pa.array([t.column("shard")[0].as_py()], pa.int32()), "graph": pa.array([made.dump(t.column("id").to_numpy())], pa.binary())})

        dealt = rows.withColumn("shard", F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int"))
        dealt.groupBy("shard").applyInArrow(graph, "shard int, graph binary").write.parquet(folder)
        return cls.load(df.sparkSession, folder, column, key)

    @classmethod
    def load(cls, spark: SparkSession, folder: str, column: str, key: str) -> LayeredIndex:
        return cls(spark.read.parquet(folder), column, key)

    def search_all(self, queries: DataFrame, k: int, breadth: int = 100, block: int = 1000, digits: int = 6) -> DataFrame:
        """(query, key, distance): the ``k`` nearest found for every row of ``queries``."""
        asked = queries.where(F.col(self.column).isNotNull()).select(F.col(self.key).cast("long").alias("query"), F.col(self.column).alias("v"))
        blocks = max(1, math.ceil(asked.count() / block))
        # every block meets every shard, as each may hold the nearest
        shards = self.graphs.agg(F.coalesce(F.max("shard"), F.lit(-1))).first()[0] + 1
        asked = asked.select("query", "v", F.pmod(F.xxhash64("query"), F.lit(blocks)).cast("int").alias("b"), F.explode(F.sequence(F.lit(0), F.lit(shards - 1)) if shards else F.array().cast("array<int>")).alias("shard"))
        graphs = self.graphs.select(F.col("shard").alias("s"), "graph", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("b"))

        def run(left: pa.Table, right: pa.Table) -> pa.Table:
            out = []
            if left.num_rows and right.num_rows:
                graph, ids = Layers.load(right.column("graph")[0].as_py())
                for name, v in zip(left.column("query").to_pylist(), left.column("v").to_pylist(), strict=True):
                    q = np.array(v, np.float32)
                    found = np.array([i for _, i in graph.search(q, k, breadth)], np.int64)
                    exact = np.round(np.sqrt(((graph.v[found].astype(float) - q.astype(float)) ** 2).sum(1)), digits)
                    out += zip([name] * len(found), ids[found].tolist(), exact.tolist(), strict=True)
            return pa.table({n: pa.array([x[i] for x in out], kind) for i, (n, kind) in enumerate((("query", pa.int64()), ("id", pa.int64()), ("distance", pa.float64())))})

        found = asked.groupBy("shard", "b").cogroup(graphs.groupBy("s", "b")).applyInArrow(run, "query long, id long, distance double")
        return _least(found, "distance", k).select("query", F.col("id").alias(self.key), "distance")
