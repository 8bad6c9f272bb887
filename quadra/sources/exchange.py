"""Exchange with clients: tables by ticket (a wide-column SELECT), in Arrow pages; upserts; listings."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quadra.functions.murmur import bigint_token, text_token
from quadra.plans import cql
from quadra.sources.tables import token_ranges

PAGE_ROWS = 1024


def paged(catalog: dict[str, cql.Table], ticket: str, page_rows: int = PAGE_ROWS) -> DataFrame:
    """(page): a SELECT's rows in serialised pages, made and left where the rows are; the last page of a partition may be short."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def page() -> pa.RecordBatch:
            out = pa.BufferOutputStream()
            with pa.ipc.new_stream(out, held[0].schema) as w:
                w.write_table(pa.Table.from_batches(held).combine_chunks())
            return pa.RecordBatch.from_arrays([pa.array([out.getvalue().to_pybytes()], pa.binary())], names=["page"])

        for batch in batches:
            while batch.num_rows:
                room = page_rows - sum(b.num_rows for b in held)
                held.append(batch.slice(0, room))
                batch = batch.slice(room)
                if sum(b.num_rows for b in held) == page_rows:
                    yield page()
                    held = []
        if held:
            yield page()

    return cql.select(catalog, ticket).mapInArrow(run, "page binary")


def unpaged(pages: DataFrame, schema: StructType, page_rows: int = PAGE_ROWS) -> DataFrame:
    """The rows of ``pages``, read where the pages are; a page of more than ``page_rows`` rows is refused."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for raw in batch.column("page"):
                with pa.ipc.open_stream(raw.as_buffer()) as r:
                    rows = r.read_all()
                if rows.num_rows > page_rows:
                    raise ValueError(f"a page of {rows.num_rows} rows")
                yield from rows.to_batches()

    return pages.mapInArrow(run, schema)


def get(catalog: dict[str, cql.Table], ticket: str, page_rows: int = PAGE_ROWS) -> Iterator[pa.Table]:
    """Pages of a SELECT's rows, serialised where the rows are; one partition at a time is on the client, which puts the
    ends of partitions together, so every page but the last is full."""
    rest = None
    for row in paged(catalog, ticket, page_rows).toLocalIterator():
        with pa.ipc.open_stream(row["page"]) as r:
            page = r.read_all()
        rest = page if rest is None else pa.concat_tables([rest, page])
        while rest.num_rows >= page_rows:
            yield rest.slice(0, page_rows).combine_chunks()
            rest = rest.slice(page_rows)
    if rest is not None and rest.num_rows:
        yield rest.combine_chunks()


def endpoints(table: cql.Table, n: int) -> list[DataFrame]:
    """The table in ``n`` parts by token range, (start, end] each; every row is in one."""
    key = table.partition[0]
    token = text_token(key) if dict(table.df.dtypes)[key] == "string" else bigint_token(F.col(key).cast("long"))
    rows = table.df.withColumn("_t", token)
    return [rows.where((F.col("_t") > low) & (F.col("_t") <= high)).drop("_t") for low, high in token_ranges(n)]


def put(table: cql.Table, rows: pa.Table | DataFrame) -> cql.Table:
    """The table after an upsert by its whole key."""
    new = rows if isinstance(rows, DataFrame) else table.df.sparkSession.createDataFrame(rows)
    key = table.partition + table.clustering
    new = new.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in table.df.schema])
    return cql.Table(table.df.join(new.select(*key), key, "left_anti").unionByName(new), table.partition, table.clustering, table.indexes, table.extensions)


def listing(catalog: dict[str, cql.Table]) -> dict[str, str]:
    """Names and schemas, known without running anything."""
    return {name: t.df.schema.simpleString() for name, t in catalog.items()}
