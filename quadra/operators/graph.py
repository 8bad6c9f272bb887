"""Property graphs over DataFrames: vertex tables by label, edge tables by type, and reachability."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadra.sources.shared import shared_dir


class GraphError(ValueError):
    """A graph statement that cannot be carried out."""


@dataclass(frozen=True)
class Edges:
    """One edge table and the labels of its ends."""

    df: DataFrame
    src: str
    dst: str
    source: str
    target: str


@dataclass(frozen=True)
class Graph:
    """Vertex tables (DataFrame, id column) by label; edge tables by type, several per type if need be."""

    vertices: dict[str, tuple[DataFrame, str]]
    edges: dict[str, list[Edges]] = field(default_factory=dict)

    def id_type(self) -> str:
        """The type that every key has or widens to: bigint where all are whole numbers, else string."""
        keys = [(df, key) for df, key in self.vertices.values()] + [(e.df, c) for tables in self.edges.values() for e in tables for c in (e.src, e.dst)]
        return "bigint" if all(df.schema[key].dataType.simpleString() in ("tinyint", "smallint", "int", "bigint") for df, key in keys) else "string"

    def nodes(self, label: str | None, ids: str = "string") -> DataFrame:
        """(v): struct of all properties with _id (of type ``ids``) and _label."""
        labels = [label] if label else list(self.vertices)
        out = None
        for name in labels:
            if name not in self.vertices:
                raise GraphError(f"no such label: {name}")
            df, key = self.vertices[name]
            rows = df.withColumns({"_id": F.col(key).cast(ids), "_label": F.lit(name)})
            out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
        return out.select(F.struct(*out.columns).alias("v"))

    def links(self, types: list[str] | None, source: str | None = None, target: str | None = None, ids: str = "string") -> DataFrame:
        """(_src, _sl, _dst, _tl, e) of edge tables that fit the labels; e holds the properties and _type."""
        out = None
        for name in types or list(self.edges):
            if name not in self.edges:
                raise GraphError(f"no such edge type: {name}")
            for e in self.edges[name]:
                if not e.source or not e.target:
                    raise GraphError(f"edge table {name} does not tell its labels")
                if source and e.source != source or target and e.target != target:
                    continue
                rows = e.df.withColumns({"_type": F.lit(name), "_src": F.col(e.src).cast(ids), "_dst": F.col(e.dst).cast(ids), "_sl": F.lit(e.source), "_tl": F.lit(e.target)})
                out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
        if out is None:
            return None
        return out.select("_src", "_sl", "_dst", "_tl", F.struct(*[c for c in out.columns if c not in ("_sl", "_tl")]).alias("e"))

    def create(self, label: str, rows: DataFrame) -> Graph:
        """New vertices; a new label or property adds its table or column."""
        if label in self.vertices:
            df, key = self.vertices[label]
            return replace(self, vertices=self.vertices | {label: (df.unionByName(rows, allowMissingColumns=True), key)})
        return replace(self, vertices=self.vertices | {label: (rows, "id" if "id" in rows.columns else rows.columns[0])})

    def update(self, label: str, where: Column, assign: dict[str, Column | None]) -> Graph:
        """SET and REMOVE (None) on the vertices that ``where`` keeps."""
        df, key = self.vertices[label]
        hit = F.coalesce(where, F.lit(False))
        for c, value in assign.items():
            old = F.col(c) if c in df.columns else F.lit(None)
            df = df.withColumn(c, F.when(hit, F.lit(None) if value is None else value).otherwise(old))
        return replace(self, vertices=self.vertices | {label: (df, key)})

    def delete(self, label: str, ids: DataFrame, detach: bool = False) -> Graph:
        """Vertices (column id) go; with live edges that is an error unless they are detached too."""
        df, key = self.vertices[label]
        gone = ids.select(F.col("id").cast("string").alias("_gone")).distinct()
        edges = dict(self.edges)
        for name, tables in edges.items():
            kept = []
            for e in tables:
                for end, at in ((e.source, e.src), (e.target, e.dst)):
                    if end != label:
                        continue
                    if not detach and not e.df.join(gone, F.col(at).cast("string") == F.col("_gone"), "left_semi").isEmpty():
                        raise GraphError("a vertex with edges is deleted only with DETACH")
                    e = replace(e, df=e.df.join(gone, F.col(at).cast("string") == F.col("_gone"), "left_anti"))
                kept.append(e)
            edges[name] = kept
        left = df.join(gone, F.col(key).cast("string") == F.col("_gone"), "left_anti")
        return Graph(self.vertices | {label: (left, key)}, edges)

    def link(self, name: str, source: str, target: str, rows: DataFrame, merge: bool = False) -> Graph:
        """New edges (_from, _to and properties) of a type; with ``merge`` only those that no equal edge has."""
        tables = list(self.edges.get(name, []))
        at = next((i for i, e in enumerate(tables) if (e.source, e.target) == (source, target)), None)
        if at is None:
            made = rows.withColumnsRenamed({"_from": "src", "_to": "dst"})
            tables.append(Edges(made.distinct() if merge else made, "src", "dst", source, target))
            return replace(self, edges=self.edges | {name: tables})
        e = tables[at]
        types = dict(e.df.dtypes)
        made = rows.withColumns({e.src: F.col("_from").cast(types[e.src]), e.dst: F.col("_to").cast(types[e.dst])}).drop("_from", "_to")
        if merge:
            made = made.distinct()
            have = e.df.select(*[F.col(c).alias(f"_h_{c}") for c in made.columns if c in types])
            on = [made[c].eqNullSafe(have[f"_h_{c}"]) for c in made.columns if c in types]
            made = made.join(have, on, "left_anti") if set(made.columns) <= set(types) else made
        tables[at] = replace(e, df=e.df.unionByName(made, allowMissingColumns=True))
        return replace(self, edges=self.edges | {name: tables})

    def unlink(self, gone: DataFrame) -> Graph:
        """Edges go that equal a row of ``gone``: _type, _src, _dst and properties."""
        edges = {}
        for name, tables in self.edges.items():
            edges[name] = []
            for e in tables:
                mine = gone.where(F.col("_type") == name)
                shared = [c for c in e.df.columns if c in mine.columns and c not in (e.src, e.dst)]
                mine = mine.select("_src", "_dst", *[F.col(c).alias(f"_g_{c}") for c in shared])
                on = [e.df[e.src].cast("string") == mine["_src"], e.df[e.dst].cast("string") == mine["_dst"], *[e.df[c].eqNullSafe(mine[f"_g_{c}"]) for c in shared]]
                edges[name].append(replace(e, df=e.df.join(mine, on, "left_anti")))
        return replace(self, edges=edges)

    def merge(self, label: str, rows: DataFrame, on: list[str]) -> Graph:
        """Rows whose ``on`` properties match no vertex are created."""
        df, _ = self.vertices[label]
        return self.create(label, rows.join(df.select(*on).distinct(), on, "left_anti"))


def adjacency(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(vertex, neighbour, direction): a row for each end of each edge."""
    out = edges.select(F.col(src).alias("vertex"), F.col(dst).alias("neighbour"), F.lit("OUT").alias("direction"))
    return out.unionByName(edges.select(F.col(dst).alias("vertex"), F.col(src).alias("neighbour"), F.lit("IN").alias("direction")))


def cut(df: DataFrame) -> DataFrame:
    """Write and read again through the checkpoint folder, so an iteration's plan does not grow."""
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        context.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint()


#: Levels after which what was seen is written as one table again.
COMPACT = 16


def grow(first: DataFrame, step: Callable[[DataFrame, int], DataFrame], on: list[str], most: int | None = None) -> DataFrame:
    """``first`` and what ``step`` (frontier, depth) reaches from it, each ``on`` once; levels are written as they come.

    A level writes its new rows only: what was seen is the union of the levels.
    """

    def union(parts: list[DataFrame]) -> DataFrame:
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out

    front = cut(first)
    parts, depth = [front], 0
    while most is None or depth < most:
        depth += 1
        front = cut(step(front, depth).join(union(parts).select(*on), on, "left_anti"))
        if front.isEmpty():
            break
        parts.append(front)
        parts = [cut(union(parts))] if len(parts) > COMPACT else parts
    return union(parts)


def reach(starts: DataFrame, edges: DataFrame, least: int = 1, most: int | None = None) -> DataFrame:
    """(start, end, depth): breadth first from ``starts`` (start), each vertex once per start at its least depth.

    ``edges`` has (src, dst). Levels are joins against the frontier only; what was seen is removed by an anti join.
    """
    first = starts.select("start", F.col("start").alias("end"), F.lit(0).alias("depth")).distinct()

    def step(front: DataFrame, depth: int) -> DataFrame:
        return front.join(edges, F.col("end") == F.col("src")).select("start", F.col("dst").alias("end")).distinct().withColumn("depth", F.lit(depth))

    return grow(first, step, ["start", "end"], most).where(F.col("depth") >= least)
