"""WARC archives with a two-level capture index.

``write_archives`` writes one gzip member per record to files in a shared folder (any store that
``pyarrow.fs`` opens by URI), finding equal payloads first: the capture with the largest id is the response,
the others are revisit records that refer to it. ``read_archives`` streams files back, also those of other writers.

``build_index`` sorts capture lines by reversed-host URL key and page id into shards of compressed blocks of
``block_lines`` lines. A shard ends with its sparse directory, which has the first line of every block. What leaves a
shard is one row, its first and last line; these rows, one per shard, are the root. ``resolve`` finds captures in tasks:
the root tells the shards, the shard's directory is binary-searched for the block, the block for the line.
``fetch`` reads the records found by byte range, ranges that lie together in one read. ``CaptureIndex`` does the same for
single URLs from the driver and holds the root only.

File names and contents depend on the partition's rows only and files appear by rename, so a task that runs
twice writes the same file again.

Defined results: a null html is an empty payload; a null url is archived as "urn:none"; records with a null
page_id are never what others refer to unless all equal payloads have null ids (then each is a response);
repeated rows are archived each; those with the response's own id are responses too. Extra columns of pages are not
read. Records of other kinds and writers have a null page_id, the payload after their HTTP header (or the whole block
where the content is no HTTP), and a digest that is computed where none is given; a revisit without a length in its HTTP
header has null payload_bytes. A record whose length or SHA-1 is wrong is an error (``WarcError``).
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import struct
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from urllib.parse import urlsplit

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quadra.llm.documents import table
from quadra.llm.store import Workspace, open_store, small_batches


def url_key(url: str | None) -> str:
    """Reversed-host key: scheme, www, port, case of the host and fragment do not matter. It fits in an index line."""
    url = (url or "urn:none").strip()
    try:
        parts = urlsplit(url)
        host = parts.hostname or ""
    except ValueError:
        parts, host = None, ""
    if host:
        labels = [x for x in host.split(".") if x]
        if len(labels) > 2 and labels[0] == "www":
            labels = labels[1:]
        query = "?" + "&".join(sorted(parts.query.split("&"))) if parts.query else ""
        url = ",".join(reversed(labels)) + ")" + (parts.path or "/") + query
    return url.replace("\t", "%09").replace("\n", "%0A")


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def make_record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool, date: str = "2024-01-01T00:00:00Z") -> bytes:
    """One uncompressed WARC/1.1 record; a revisit holds the HTTP header only."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    clean = (url or "urn:none").replace("\r", "%0D").replace("\n", "%0A")
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:page:{'none' if page_id is None else page_id}>",
        f"WARC-Date: {date}",
        f"WARC-Target-URI: {clean}",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"WARC-Block-Digest: sha1:{sha1_base32(block)}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Truncated: length"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


class WarcError(ValueError):
    """An archive that breaks the format or whose content does not have its digest."""


def _headers(head: bytes) -> dict[str, str]:
    """Header fields by lower-case name; folded lines are put together."""
    fields: dict[str, str] = {}
    name = None
    for line in head.decode("utf-8", "replace").splitlines()[1:]:
        if line[:1] in (" ", "\t") and name:
            fields[name] += " " + line.strip()
            continue
        name, _, value = line.partition(":")
        name = name.strip().lower()
        fields[name] = value.strip()
    return fields


def _page(ident: str | None) -> int | None:
    digits = ident[10:-1] if ident and ident.startswith("<urn:page:") else ""
    return int(digits) if digits.lstrip("-").isdigit() else None


def parse_record(raw: bytes) -> dict:
    """Fields of one uncompressed record, of any type and writer; a payload is held against its SHA-1, if it has one."""
    head, sep, rest = raw.partition(b"\r\n\r\n")
    if not sep or not head.startswith(b"WARC/"):
        raise WarcError("no record here")
    fields = _headers(head)
    size = fields.get("content-length", "")
    if not size.isdigit() or len(rest) < int(size):
        raise WarcError("a record ends early")
    block, kind = rest[: int(size)], fields.get("warc-type", "")
    revisit, digest = kind == "revisit", fields.get("warc-payload-digest")
    payload, length = block, None
    if fields.get("content-type", "").lower().startswith("application/http"):
        http, _, payload = block.partition(b"\r\n\r\n")
        stated = _headers(http).get("content-length", "")
        length = int(stated) if stated.isdigit() else None
    cut = "warc-truncated" in fields
    if not revisit:
        if length is not None and len(payload) != length and not cut:
            raise WarcError("a payload does not have its length")
        length = len(payload)
        name, _, value = (digest or "").partition(":")
        if name.lower() == "sha1" and len(value) == 32 and not cut and value.upper() != sha1_base32(payload):
            raise WarcError("a payload does not have its digest")
        digest = digest or f"sha1:{sha1_base32(payload)}"
    return {"page_id": _page(fields.get("warc-record-id")), "record_id": fields.get("warc-record-id"), "url": fields.get("warc-target-uri"), "payload": None if revisit else payload, "payload_bytes": length, "payload_digest": None if digest is None else digest.removeprefix("sha1:"), "record_type": kind, "refers_to": _page(fields.get("warc-refers-to"))}


def members(stream, chunk: int = 1 << 20) -> Iterator[tuple[int, int, bytes]]:
    """Gzip members of a stream: (offset, length, content), one in memory at a time."""
    data, at = stream.read(chunk), 0
    while data:
        unzip = zlib.decompressobj(31)
        parts, used = [], 0
        while True:
            parts.append(unzip.decompress(data))
            if unzip.eof:
                used += len(data) - len(unzip.unused_data)
                break
            used += len(data)
            data = stream.read(chunk)
            if not data:
                raise WarcError("an archive ends early")
        yield at, used, b"".join(parts)
        at += used
        data = unzip.unused_data or stream.read(chunk)


def captures(pages: DataFrame, least_bytes: int = 0, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(page_id, url, payload, digest hex, revisit, refers_to): which capture of equal payloads is the response."""
    payload = F.coalesce(F.col(html).cast("binary"), F.lit(b""))
    x = pages.select(F.col(key).cast("long").alias("page_id"), F.col(url).alias("url"), payload.alias("payload"), F.sha1(payload).alias("sha1"))
    # only ids and digests are grouped, and only payloads that repeat are joined; one very large group of
    # copies is one row of the right side, and Spark splits its left side
    first = x.where(F.length("payload") >= least_bytes).groupBy("sha1").agg(F.max("page_id").alias("last_id"), F.count(F.lit(1)).alias("n")).where("n > 1 and last_id is not null").select("sha1", "last_id")
    return x.join(first, "sha1", "left")


def write_archives(pages: DataFrame, folder: str, least_bytes: int = 0, level: int = 3) -> DataFrame:
    """Write the archives; gives (file, offset, length, page_id, url, key, record_type) per record."""
    spark = pages.sparkSession
    small_batches(spark, 256)
    schema = "file string, offset long, length long, page_id long, url string, key string, record_type string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = open_store(folder)
        fs.create_dir(base, recursive=True)
        context = TaskContext.get()
        name = f"pages-{context.partitionId():06d}.warc.gz"
        part = f"{base}/.{name}.{context.taskAttemptId()}"
        at, written = 0, False
        with fs.open_output_stream(part, compression=None) as out:
            for batch in batches:
                rows = batch.to_pylist()
                made = []
                for r in rows:
                    revisit = r["last_id"] is not None and r["page_id"] != r["last_id"]
                    digest = base64.b32encode(bytes.fromhex(r["sha1"])).decode()
                    raw = gzip.compress(make_record(r["page_id"], r["url"], r["payload"], digest, r["last_id"], revisit), level, mtime=0)
                    out.write(raw)
                    made.append((name, at, len(raw), r["page_id"], r["url"], url_key(r["url"]), "revisit" if revisit else "response"))
                    at += len(raw)
                    written = True
                yield pa.RecordBatch.from_pylist([dict(zip(_PLACE.names, m, strict=True)) for m in made], schema=_PLACE)
        if written:
            fs.move(part, f"{base}/{name}")
        else:
            fs.delete_file(part)

    return captures(pages, least_bytes).mapInArrow(run, schema)


_PLACE = pa.schema([("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("page_id", pa.int64()), ("url", pa.string()), ("key", pa.string()), ("record_type", pa.string())])


READ = "page_id long, record_id string, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long"


def _fields(payloads: bool) -> tuple[T.StructType, pa.Schema]:
    fields = [f for f in T._parse_datatype_string(READ).fields if payloads or f.name != "payload"]
    return T.StructType(fields), pa.schema([(f.name, pa.int64() if f.dataType == T.LongType() else pa.binary() if f.dataType == T.BinaryType() else pa.string()) for f in fields])


def _batched(records: Iterator[tuple[dict, int]], arrow: pa.Schema, most_bytes: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """Arrow batches of (record, bytes it keeps in memory)."""
    rows, size = [], 0
    for record, n in records:
        rows.append({f: record[f] for f in arrow.names})
        size += n + 300
        if size > most_bytes:
            yield pa.RecordBatch.from_pylist(rows, schema=arrow)
            rows, size = [], 0
    yield pa.RecordBatch.from_pylist(rows, schema=arrow)


def read_archives(spark: SparkSession, folder: str, files: DataFrame, payloads: bool = True) -> DataFrame:
    """All records of the archives named in ``files`` (column file), streamed record by record."""
    schema, arrow = _fields(payloads)

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict, int]]:
        fs, base = open_store(folder)
        for batch in batches:
            for name in batch.column(0).to_pylist():
                with fs.open_input_stream(f"{base}/{name}", compression=None) as stream:
                    for _, _, raw in members(stream):
                        yield parse_record(raw), len(raw) if payloads else 0

    n = max(1, min(spark.sparkContext.defaultParallelism * 4, 10_000))
    return files.select("file").distinct().repartition(n, "file").mapInArrow(lambda b: _batched(records(b), arrow), schema)


#: Bytes between two wanted ranges that are read rather than left out, and the most that one read takes.
GAP, MOST = 65_536, 8_000_000


def fetch(places: DataFrame, folder: str, payloads: bool = True) -> DataFrame:
    """The records at ``places`` (file, offset, length), by range reads in the order of the files."""
    schema, arrow = _fields(payloads)

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict, int]]:
        fs, base = open_store(folder)
        name, stream, wanted = None, None, []

        def read() -> Iterator[tuple[dict, int]]:
            if wanted:
                first = wanted[0][0]
                stream.seek(first)
                raw = stream.read(wanted[-1][0] + wanted[-1][1] - first)
                for at, n in wanted:
                    record = gzip.decompress(raw[at - first : at - first + n])
                    yield parse_record(record), len(record) if payloads else 0

        for batch in batches:
            for file, at, n in zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True):
                if wanted and (file != name or at > sum(wanted[-1]) + GAP or at + n - wanted[0][0] > MOST):
                    yield from read()
                    wanted = []
                if file != name:
                    if stream:
                        stream.close()
                    name, stream = file, fs.open_input_file(f"{base}/{file}")
                wanted.append((at, n))
        yield from read()
        if stream:
            stream.close()

    # a stretch of a file goes to one task, so what is read together lies together
    n = int(places.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = places.select("file", "offset", "length").repartition(n, "file", F.floor(F.col("offset") / F.lit(64_000_000)))
    return dealt.sortWithinPartitions("file", "offset").mapInArrow(lambda b: _batched(records(b), arrow), schema)


ROOT = "shard string, first_key string, first_id long, last_key string, last_id long, lines long"
#: At the end of a shard: the place and length of its directory.
_TRAILER = "<QQ"


def _order(key: str, page_id: int | None) -> tuple:
    """Where a capture stands in the index: by key, then id, null ids first; as Spark sorts."""
    return key, page_id is not None, page_id or 0


def _line(line: str) -> tuple:
    """The order of an index or directory line."""
    key, ident = line.split("\t", 2)[:2]
    return _order(key, int(ident) if ident else None)


def build_index(places: DataFrame, folder: str, block_lines: int = 3000, partitions: int | None = None) -> DataFrame:
    """Write sorted index shards; gives the root, a row per shard.

    Ranges of all columns that tell captures apart spread a host, or one capture written very often, over several shards.
    """
    n = partitions or int(places.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = open_store(folder)
        fs.create_dir(base, recursive=True)
        context = TaskContext.get()
        name = f"index-{context.partitionId():06d}"
        part = f"{base}/.{name}.{context.taskAttemptId()}"
        directory: list[str] = []
        lines: list[str] = []
        first = last = None
        at = total = 0
        with fs.open_output_stream(part, compression=None) as out:

            def flush() -> None:
                nonlocal at, lines
                raw = gzip.compress("\n".join(lines).encode(), 6, mtime=0)
                out.write(raw)
                directory.append("\t".join([*lines[0].split("\t", 2)[:2], str(at), str(len(raw))]))
                at += len(raw)
                lines = []

            for batch in batches:
                for r in batch.to_pylist():
                    last = (r["key"], r["page_id"])
                    first = first or last
                    lines.append(f"{r['key']}\t{'' if r['page_id'] is None else r['page_id']}\t{r['record_type']}\t{r['file']}\t{r['offset']}\t{r['length']}")
                    total += 1
                    if len(lines) == block_lines:
                        flush()
            if lines:
                flush()
            raw = gzip.compress("\n".join(directory).encode(), 6, mtime=0)
            out.write(raw + struct.pack(_TRAILER, at, len(raw)))
        kinds = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
        if not total:
            fs.delete_file(part)
            return
        fs.move(part, f"{base}/{name}")
        yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip([name, *first, *last, total], kinds, strict=True)], names=[x.split()[0] for x in ROOT.split(", ")])

    order = ["key", "page_id", "file", "offset"]
    return places.repartitionByRange(n, *order).sortWithinPartitions(*order).mapInArrow(run, ROOT)


class Root:
    """First and last line of every shard, in order: a row per shard, whatever the number of captures."""

    def __init__(self, root: DataFrame) -> None:
        rows = sorted(((_order(r["first_key"], r["first_id"]), _order(r["last_key"], r["last_id"]), r["shard"]) for r in root.collect()), key=lambda x: (x[0], x[1], x[2]))
        self.first, self.last, self.shards = ([r[k] for r in rows] for k in range(3))

    def holding(self, low: tuple, high: tuple) -> list[str]:
        """Shards that may hold lines from ``low`` to ``high``."""
        return self.shards[bisect_left(self.last, low) : bisect_right(self.first, high)]


class _Shard:
    """An open shard: its directory, and the block read last."""

    def __init__(self, fs: pafs.FileSystem, path: str) -> None:
        self.file = fs.open_input_file(path)
        self.bytes_read = self.blocks_read = 0
        size = self.file.size()
        at, n = struct.unpack(_TRAILER, self._read(size - 16, 16))
        self.directory = gzip.decompress(self._read(at, n)).decode().split("\n")
        self.firsts = [_line(x) for x in self.directory]
        self.held: tuple[int, list[str]] | None = None

    def _read(self, at: int, n: int) -> bytes:
        self.file.seek(at)
        self.bytes_read += n
        return self.file.read(n)

    def _block(self, k: int) -> list[str]:
        if self.held is None or self.held[0] != k:
            at, n = map(int, self.directory[k].split("\t")[2:])
            self.held = k, gzip.decompress(self._read(at, n)).decode().split("\n")
            self.blocks_read += 1
        return self.held[1]

    def find(self, low: tuple, high: tuple) -> Iterator[list[str]]:
        """Cells of the lines from ``low`` to ``high``."""
        for k in range(max(0, bisect_left(self.firsts, low) - 1), bisect_right(self.firsts, high)):
            lines = self._block(k)
            for i in range(bisect_left(lines, low, key=_line), len(lines)):
                if _line(lines[i]) > high:
                    return
                yield lines[i].split("\t")


def _bounds(key: str, page_id: int | None, any_id: bool) -> tuple[tuple, tuple]:
    return (_order(key, None), (key, True, 2**63)) if any_id else (_order(key, page_id),) * 2


def capture_keys(pages: DataFrame, key: str = "page_id", url: str = "url") -> DataFrame:
    """(key, page_id) of pages, each once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([url_key(u) for u in batch.column(1).to_pylist()], pa.string()), batch.column(0)], names=["key", "page_id"])

    return pages.select(F.col(key).cast("long"), F.col(url)).mapInArrow(run, "key string, page_id long").distinct()


def resolve(wanted: DataFrame, root: DataFrame, folder: str) -> DataFrame:
    """Places of captures: (key, page_id, record_type, file, offset, length) for ``wanted``, distinct rows of
    (key, page_id), or of (key) for all captures of a key."""
    any_id = "page_id" not in wanted.columns
    spark = wanted.sparkSession
    sent = spark.sparkContext.broadcast(Root(root))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shards = [sent.value.holding(*_bounds(k, i, any_id)) for k, i in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
            at = pa.array([i for i, x in enumerate(shards) for _ in x], pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([s for x in shards for s in x], pa.string()), *(c.take(at) for c in batch.columns)], names=["shard", "key", "page_id"])

    kinds = pa.schema([("key", pa.string()), ("page_id", pa.int64()), ("record_type", pa.string()), ("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64())])

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict, int]]:
        fs, base = open_store(folder)
        name = shard = None
        for batch in batches:
            for s, k, i in zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True):
                if s != name:
                    if shard:
                        shard.file.close()
                    name, shard = s, _Shard(fs, f"{base}/{s}")
                for c in shard.find(*_bounds(k, i, any_id)):
                    yield {"key": c[0], "page_id": int(c[1]) if c[1] else None, "record_type": c[2], "file": c[3], "offset": int(c[4]), "length": int(c[5])}, 0
        if shard:
            shard.file.close()

    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = wanted.select("key", (F.lit(None).cast("long") if any_id else F.col("page_id")).alias("page_id")).mapInArrow(deal, "shard string, key string, page_id long")
    # looked up in the order of the index, so a block is read once
    dealt = dealt.repartition(n, "shard").sortWithinPartitions("shard", "key", "page_id")
    return dealt.mapInArrow(lambda b: _batched(lines(b), kinds), "key string, page_id long, record_type string, file string, offset long, length long")


class CaptureIndex:
    """Lookups of single URLs from the driver, which holds the root only."""

    def __init__(self, root: DataFrame, index_folder: str, archive_folder: str) -> None:
        self.root = Root(root)
        self.index_folder, self.archive_folder = index_folder, archive_folder
        #: What the last lookup read of the index and of the archives.
        self.blocks_read = self.index_bytes = self.archive_bytes = 0

    def places(self, url: str) -> list[tuple[str, int, int]]:
        """(file, offset, length) of all captures of a URL."""
        fs, base = open_store(self.index_folder)
        self.blocks_read = self.index_bytes = 0
        bounds, found = _bounds(url_key(url), None, True), []
        for name in self.root.holding(*bounds):
            shard = _Shard(fs, f"{base}/{name}")
            found += [(c[3], int(c[4]), int(c[5])) for c in shard.find(*bounds)]
            self.blocks_read += shard.blocks_read
            self.index_bytes += shard.bytes_read
            shard.file.close()
        return found

    def lookup(self, url: str) -> list[dict]:
        """The records of a URL, each read by its byte range."""
        fs, base = open_store(self.archive_folder)
        self.archive_bytes, out = 0, []
        for name, at, n in self.places(url):
            with fs.open_input_file(f"{base}/{name}") as f:
                f.seek(at)
                out.append(parse_record(gzip.decompress(f.read(n))))
            self.archive_bytes += n
        return out


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write archives and their index, then find every page's records through the index and read them by range."""
    space = Workspace(spark, "warc")
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    archives, index = f"{space.path}/archives", f"{space.path}/index"
    root = space.keep(build_index(space.keep(write_archives(pages, archives), "places"), index), "root")
    places = resolve(capture_keys(pages), root, index)
    return fetch(places, archives, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


QUERY = ("op10_warc", op10_warc)
#: DuckDB has SHA-1 but no base32: 40 hex digits are 32 groups of five bits.
ORACLE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
g AS (SELECT h, max(page_id) AS last_id, count(*) AS n FROM p GROUP BY h)
SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes,
  list_aggregate(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(1 + (
    CAST('0x' || substr(h, CAST(1 + (i * 5) // 4 AS BIGINT), 1) AS INT) * 16 + CAST('0x' || coalesce(nullif(substr(h, CAST(2 + (i * 5) // 4 AS BIGINT), 1), ''), '0') AS INT))
    // (1 << CAST(3 - (i * 5) % 4 AS INT)) % 32 AS BIGINT), 1)), 'string_agg', '') AS payload_digest,
  CASE WHEN n > 1 AND page_id <> last_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n > 1 AND page_id <> last_id THEN last_id END AS refers_to
FROM p JOIN g USING (h)
"""
