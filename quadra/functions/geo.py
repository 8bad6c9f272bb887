"""Geometry on (latitude, longitude) columns, in Column arithmetic."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

EARTH_M = 6_371_008.8
EPS = 1e-12


def haversine(lat: Column, lon: Column, lat0: float, lon0: float) -> Column:
    """Great-circle metres."""
    a, b = F.radians(lat), F.radians(F.lit(lat0))
    h = F.pow(F.sin((a - b) / 2), 2) + F.cos(a) * F.cos(b) * F.pow(F.sin(F.radians(lon - F.lit(lon0)) / 2), 2)
    return F.lit(2 * EARTH_M) * F.asin(F.least(F.lit(1.0), F.sqrt(h)))


def within_bbox(lat: Column, lon: Column, south: float, west: float, north: float, east: float) -> Column:
    """A box whose west lies east of its east crosses the antimeridian."""
    inside = lon.between(west, east) if west <= east else (lon >= west) | (lon <= east)
    return lat.between(south, north) & inside


def within_radius(lat: Column, lon: Column, lat0: float, lon0: float, metres: float) -> Column:
    """The distance test behind a latitude band, which the scan can use."""
    band = math.degrees(metres / EARTH_M) + 1e-9
    return lat.between(lat0 - band, lat0 + band) & (haversine(lat, lon, lat0, lon0) <= metres)


def within_polygon(lat: Column, lon: Column, ring: list[tuple[float, float]]) -> Column:
    """Ray casting over a closed ring of (lat, lon); the boundary is inside."""
    edges = list(zip(ring, [*ring[1:], ring[0]], strict=True))
    odd, edge = F.lit(0), F.lit(False)
    for (y1, x1), (y2, x2) in edges:
        if y1 != y2:
            at = (x2 - x1) * (lat - y1) / (y2 - y1) + x1
            odd = odd + F.when(((F.lit(y1) > lat) != (F.lit(y2) > lat)) & (lon < at), 1).otherwise(0)
        cross = (lon - x1) * (y2 - y1) - (lat - y1) * (x2 - x1)
        edge = edge | ((F.abs(cross) <= EPS) & lon.between(min(x1, x2) - EPS, max(x1, x2) + EPS) & lat.between(min(y1, y2) - EPS, max(y1, y2) + EPS))
    box = lat.between(min(p[0] for p in ring), max(p[0] for p in ring)) & lon.between(min(p[1] for p in ring), max(p[1] for p in ring))
    return box & (edge | (odd % 2 == 1))


def st_contains(a: tuple, lat: Column, lon: Column) -> Column:
    """('polygon', ring) or ('point', (lat, lon)) against point columns."""
    kind, shape = a
    if kind == "polygon":
        return within_polygon(lat, lon, shape)
    if kind == "point":
        return (F.abs(lat - shape[0]) <= EPS) & (F.abs(lon - shape[1]) <= EPS)
    raise ValueError(f"{kind} is not supported")


def st_intersects(a: tuple, b: tuple | None, lat: Column, lon: Column) -> Column:
    """Point with point, or polygon with point; two polygons are refused."""
    if b is not None and a[0] == b[0] == "polygon":
        raise ValueError("polygon with polygon is not supported")
    return st_contains(a, lat, lon)


def cell(lat: Column, lon: Column, level: int) -> Column:
    """Z-order cell id, two bits a level."""
    y = F.least(F.floor((lat + 90) / 180 * (1 << level)), F.lit((1 << level) - 1)).cast("long")
    x = F.least(F.floor((lon + 180) / 360 * (1 << level)), F.lit((1 << level) - 1)).cast("long")
    out = F.lit(0).cast("long")
    for b in range(level):
        out = out + F.shiftleft(F.shiftright(x, b) % 2, 2 * b) + F.shiftleft(F.shiftright(y, b) % 2, 2 * b + 1)
    return out


def nearest(df: DataFrame, lat: str, lon: str, key: str, lat0: float, lon0: float, k: int) -> DataFrame:
    """The k nearest rows; Spark keeps k rows per task and merges them."""
    return df.withColumn("distance", haversine(F.col(lat), F.col(lon), lat0, lon0)).orderBy("distance", key).limit(k)


def cover(south: float, west: float, north: float, east: float, level: int) -> list[tuple[int, int]]:
    """Ranges [first, last] of cell ids at ``level`` that meet a box; neighbouring ranges are joined.

    A quarter that lies wholly inside is one range, so the list grows with the box's edge and not with its area. A box
    whose west lies east of its east crosses the antimeridian and is covered in two parts.
    """
    if west > east:
        parts = sorted(cover(south, west, north, 180.0, level) + cover(south, -180.0, north, east, level))
    else:
        parts = []

        def visit(y: float, x: float, height: float, width: float, first: int, depth: int) -> None:
            if y > north or x > east or y + height < south or x + width < west:
                return
            inside = south <= y and y + height <= north and west <= x and x + width <= east
            size = 1 << (2 * (level - depth))
            if inside or depth == level:
                parts.append((first, first + size - 1))
                return
            for q in range(4):
                visit(y + (q >> 1) * height / 2, x + (q & 1) * width / 2, height / 2, width / 2, first + q * (size // 4), depth + 1)

        visit(-90.0, -180.0, 180.0, 360.0, 0, 0)
    out: list[tuple[int, int]] = []
    for a, b in parts:
        if out and a <= out[-1][1] + 1:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def in_ranges(cells: Column, ranges: list[tuple[int, int]]) -> Column:
    """Whether a cell column lies in a cover's ranges: plain bounds, which a scan of a clustered table can use."""
    out = F.lit(False)
    for a, b in ranges:
        out = out | cells.between(a, b)
    return out


class StoredPlaces:
    """Points written in the order of their cells, so that files and row groups hold neighbours: a search reads those whose
    least and greatest cells meet the cover of what it looks for."""

    def __init__(self, spark: SparkSession, folder: str, lat: str, lon: str, level: int = 12) -> None:
        self.rows, self.lat, self.lon, self.level = spark.read.parquet(folder), F.col(lat), F.col(lon), level

    @classmethod
    def build(cls, df: DataFrame, lat: str, lon: str, folder: str, level: int = 12, partitions: int | None = None) -> StoredPlaces:
        spark = df.sparkSession
        n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
        # many points of one cell are told apart by their place in it
        rows = df.withColumn("_cell", cell(F.col(lat), F.col(lon), level)).repartitionByRange(n, "_cell", lat, lon)
        rows.sortWithinPartitions("_cell").write.option("parquet.block.size", 8 << 20).parquet(folder)
        return cls(spark, folder, lat, lon, level)

    def within_bbox(self, south: float, west: float, north: float, east: float) -> DataFrame:
        # a coarse cover is enough to skip by, and short
        depth = min(self.level, 6)
        shift = 2 * (self.level - depth)
        ranges = [(a << shift, ((b + 1) << shift) - 1) for a, b in cover(south, west, north, east, depth)]
        return self.rows.where(in_ranges(F.col("_cell"), ranges)).where(within_bbox(self.lat, self.lon, south, west, north, east)).drop("_cell")

    def within_radius(self, lat0: float, lon0: float, metres: float) -> DataFrame:
        """The points within a distance, from the box around it (all longitudes where it reaches a pole)."""
        height = math.degrees(metres / EARTH_M)
        south, north = max(-90.0, lat0 - height), min(90.0, lat0 + height)
        if south <= -90 or north >= 90:
            box = self.within_bbox(south, -180.0, north, 180.0)
        else:
            width = math.degrees(math.asin(min(1.0, math.sin(metres / EARTH_M) / math.cos(math.radians(lat0))))) + 1e-9 if metres / EARTH_M < math.pi / 2 else 180.0
            west, east = lon0 - width, lon0 + width
            box = self.within_bbox(south, -180.0, north, 180.0) if width >= 180 else self.within_bbox(south, west + 360 if west < -180 else west, north, east - 360 if east > 180 else east)
        return box.where(haversine(self.lat, self.lon, lat0, lon0) <= metres)
