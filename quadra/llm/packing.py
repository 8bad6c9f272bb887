"""Token ids packed into rows of fixed length: best-fit decreasing over all documents, with a segment tree of capacities.

1. Texts are tokenised once, into a table of pieces: whole rows of long documents, and what is left. A piece is known
   by its task, its length and its number among the task's pieces of that length.
2. Counts of pieces by length (at most ``row_len`` of them) are all that packing needs: ``plan`` packs them on the
   driver, longest first, each piece into the row with the least free space that holds it. Rows of equal space are
   one interval of row numbers, so equal pieces are dealt to intervals at once, and the plan has some thousand
   entries for any number of documents. A segment tree over capacities 0..row_len finds the tightest one.
3. Each piece finds its row and place in the plan by its rank among all pieces of its length: its number, plus the
   counts of earlier tasks. Those sums are kept in files of the shared folder, of which a task reads the one it needs.
4. Pieces meet in one shuffle by row; runs of rows are put together as they come, in order.

The number of rows depends on nothing but the documents: not on partitions, files or batches.

A packed row has: ``row_id`` (0, 1, ...), ``ids`` (row_len little-endian unsigned 16- or 32-bit ids, padded),
``cu_seqlens`` (0, then the end of every segment), ``resets`` (positions where position ids start again from 0: the
segment starts), and per segment its ``doc_ids``, ``doc_rows`` (an id of the document's row: tells repeated documents
apart), ``starts`` (offset in the document's tokens).

Defined results: null and empty texts have no tokens and are dealt to the rows' ``empty_ids``, at most ``EMPTIES`` to a
row (rows without segments are added where there are too few); repeated rows are packed each; null document ids
stay null in ``doc_ids``; extra columns are not read.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quadra.llm.bytestok import blocks
from quadra.llm.documents import table
from quadra.llm.store import Workspace, open_store, small_batches

#: The vocabulary file of the queries; operators take any path.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The public split pattern of that vocabulary.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


#: Empty documents that one row names at most.
EMPTIES = 4096
#: Bytes of text that are tokenised at once.
_CHUNK = 1_000_000
#: A place where the split pattern always splits: a letter, then a blank before a letter.
_SAFE = re.compile(r"(?<=[A-Za-z])(?= [A-Za-z])")


@lru_cache(maxsize=2)
def encoding(vocabulary: bytes):
    """The encoder of a vocabulary file's content."""
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in vocabulary.splitlines() if line.strip())}
    return tiktoken.Encoding("packing", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})


def load_vocabulary(path: str) -> bytes:
    """The content of a vocabulary file on the driver; it is sent to the tasks, which need no such file."""
    with open(path, "rb") as f:
        return f.read()


def tokens_of(enc, text: str, kind: np.dtype) -> np.ndarray:
    """Ids of a text. A long one is tokenised by parts, cut where the split pattern splits anyway."""
    if len(text) <= _CHUNK:
        return np.array(enc.encode_ordinary(text), kind)
    parts, at = [], 0
    while at < len(text):
        cut = _SAFE.search(text, at + _CHUNK)
        to = cut.start() if cut else len(text)
        parts.append(np.array(enc.encode_ordinary(text[at:to]), kind))
        at = to
    return np.concatenate(parts)


class CapacityTree:
    """Intervals of row numbers by free space; finds the least space that is at least a need."""

    def __init__(self, most: int) -> None:
        self.size = 1
        while self.size <= most:
            self.size *= 2
        self.count = [0] * (2 * self.size)
        self.rows: dict[int, list[tuple[int, int]]] = {}

    def add(self, space: int, first: int, n: int) -> None:
        """``n`` rows from ``first`` on have this space."""
        self.rows.setdefault(space, []).append((first, n))
        i = space + self.size
        while i:
            self.count[i] += 1
            i >>= 1

    def take(self, need: int) -> tuple[int, int, int] | None:
        """Remove and give (space, first row, rows) of a tightest interval that holds ``need``."""
        count, i = self.count, need + self.size
        if not count[i]:
            # climb until a right neighbour has rows, then go down to its leftmost leaf
            while i > 1 and (i & 1 or not count[i + 1]):
                i >>= 1
            if i <= 1:
                return None
            i += 1
            while i < self.size:
                i *= 2
                if not count[i]:
                    i += 1
        space = i - self.size
        while i:
            count[i] -= 1
            i >>= 1
        return space, *self.rows[space].pop()


class Plan:
    """Where pieces go: sorted stretches (length, first rank, row of that rank, pieces to a row, place in the row)."""

    def __init__(self, n_rows: int, stretches: list[tuple[int, int, int, int, int]]) -> None:
        self.n_rows = n_rows
        self.length, self.rank, self.row, self.each, self.at = (np.array([s[k] for s in stretches], np.int64) for k in range(5))
        # stretches of one length lie together, so a piece is looked up among those only
        self.first = np.searchsorted(self.length, np.arange(int(self.length.max(initial=0)) + 2))

    def find(self, length: int, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, place in it) of pieces of one length."""
        a, b = self.first[length : length + 2]
        k = a + np.searchsorted(self.rank[a:b], ranks, side="right") - 1
        row, nth = np.divmod(ranks - self.rank[k], self.each[k])
        return self.row[k] + row, self.at[k] + nth * length


def plan(counts: dict[int, int], row_len: int) -> Plan:
    """Best-fit decreasing of ``counts`` pieces by length, each 1 to ``row_len``.

    A row of the least space that holds a piece of length n takes as many of them as fit, one after the other, because
    what is left of it is tighter still; so an interval of rows is filled at once.
    """
    tree, stretches, n_rows = CapacityTree(row_len), [], 0
    for n in sorted(counts, reverse=True):
        rank, left = 0, counts[n]
        while left:
            got = tree.take(n)
            if got is None:
                fit = row_len // n
                got = row_len, n_rows, -(-left // fit)
                n_rows += got[2]
            space, first, rows = got
            fit = space // n
            full = min(rows, left // fit)
            part = left - full * fit if full < rows else 0
            if full:
                stretches.append((n, rank, first, fit, row_len - space))
                tree.add(space - fit * n, first, full)
            if part:
                # the last pieces share a row that could hold more of them
                stretches.append((n, rank + full * fit, first + full, part, row_len - space))
                tree.add(space - part * n, first + full, 1)
            if full + bool(part) < rows:
                tree.add(space, first + full + bool(part), rows - full - bool(part))
            rank, left = rank + full * fit + part, left - full * fit - part
    return Plan(n_rows, sorted(stretches))


PIECE = "task long, length int, number long, doc_id long, doc_row long, start long, ids binary"


def pieces(docs: DataFrame, row_len: int, pad: int, vocabulary: bytes, text: str = "text", key: str = "doc_id", most_bytes: int = 4_000_000) -> DataFrame:
    """Tokenised pieces of all documents; an empty document is a piece of length 0."""
    kind = np.dtype("<u2" if pad < 2**16 else "<u4")
    sent = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(sent.value)
        task = TaskContext.get().partitionId()
        number, doc_row = [0] * (row_len + 1), task << 40
        made, size = [], 0
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for i, _, data, offsets in blocks(batch.column(1), _CHUNK):
                for k in range(len(offsets) - 1):
                    x = tokens_of(enc, data[offsets[k] : offsets[k + 1]].tobytes().decode("utf-8"), kind)
                    for start in range(0, max(1, len(x)), row_len):
                        part = x[start : start + row_len]
                        made.append((task, len(part), number[len(part)], ids[i + k], doc_row, start, part.tobytes()))
                        number[len(part)] += 1
                        size += part.nbytes + 100
                        if size > most_bytes:
                            yield _pieces(made)
                            made, size = [], 0
                    doc_row += 1
        yield _pieces(made)

    return docs.select(F.col(key).cast("long"), F.col(text)).mapInArrow(run, PIECE)


_PIECE = pa.schema([("task", pa.int64()), ("length", pa.int32()), ("number", pa.int64()), ("doc_id", pa.int64()), ("doc_row", pa.int64()), ("start", pa.int64()), ("ids", pa.binary())])


def _pieces(made: list[tuple]) -> pa.RecordBatch:
    columns = zip(*made, strict=True) if made else [[] for _ in _PIECE]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _PIECE, strict=True)], schema=_PIECE)


def _tasks(row_len: int) -> int:
    """Tasks whose sums lie in one file, of a few megabytes."""
    return max(1, min(256, 2**20 // (row_len + 1)))


def _write_sums(per: DataFrame, row_len: int, folder: str) -> None:
    """Files of sums: of every task and length, the pieces of that length in earlier tasks. ``per``: (task, length, n)."""
    n = _tasks(row_len)
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    sums = per.select("task", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("n"), F.floor(F.col("task") / n).alias("file"))

    def write(t: pa.Table) -> pa.Table:
        out = np.zeros((n, row_len + 1), np.int64)
        out[t.column("task").to_numpy() % n, t.column("length").to_numpy()] = t.column("n").to_numpy()
        fs, base = open_store(folder)
        fs.create_dir(base, recursive=True)
        name = f"{base}/{t.column('file')[0].as_py():06d}"
        with fs.open_output_stream(f"{name}.{TaskContext.get().taskAttemptId()}", compression=None) as f:
            f.write(out.tobytes())
        fs.move(f"{name}.{TaskContext.get().taskAttemptId()}", name)
        return pa.table({"file": pa.array([t.column("file")[0].as_py()], pa.int64())})

    sums.groupBy("file").applyInArrow(write, "file long").count()


SCHEMA = "row_id long, n_tokens int, ids binary, cu_seqlens array<int>, resets array<int>, doc_ids array<long>, doc_rows array<long>, starts array<long>, empty_ids array<long>"
_ARROW = pa.schema([("row_id", pa.int64()), ("n_tokens", pa.int32()), ("ids", pa.binary()), ("cu_seqlens", pa.list_(pa.int32())), ("resets", pa.list_(pa.int32())), ("doc_ids", pa.list_(pa.int64())), ("doc_rows", pa.list_(pa.int64())), ("starts", pa.list_(pa.int64())), ("empty_ids", pa.list_(pa.int64()))])


def packed_rows(docs: DataFrame, row_len: int = 2048, pad: int = 50256, vocabulary: str = VOCABULARY, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Packed rows of all documents. ``row_len`` at most 2**20; ids take 16 bits if ``pad`` fits in them, else 32."""
    spark = docs.sparkSession
    small_batches(spark)
    space = Workspace(spark, "packing")
    kind = np.dtype("<u2" if pad < 2**16 else "<u4")
    all_ = space.keep(pieces(docs, row_len, pad, load_vocabulary(vocabulary), text, key), "pieces")
    per = space.keep(all_.groupBy("task", "length").agg(F.count(F.lit(1)).alias("n")), "counts")
    # at most row_len + 1 rows
    counts = {r["length"]: r["n"] for r in per.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    empties = counts.pop(0, 0)
    made = plan(counts, row_len)
    n_rows = max(made.n_rows, -(-empties // EMPTIES))
    folder = space.new_path("sums")
    _write_sums(per, row_len, folder)
    space.drop(per)
    sent = spark.sparkContext.broadcast(made)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = open_store(folder)
        task, sums = None, np.zeros(0, np.int64)
        width, per_file = (row_len + 1) * 8, _tasks(row_len)
        for batch in batches:
            tasks, lengths = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            rank = batch.column(2).to_numpy().copy()
            for t in np.unique(tasks).tolist():
                if t != task:
                    with fs.open_input_file(f"{base}/{t // per_file:06d}") as f:
                        f.seek(t % per_file * width)
                        task, sums = t, np.frombuffer(f.read(width), np.int64)
                rank += np.where(tasks == t, sums[lengths], 0)
            row, at = np.zeros(len(rank), np.int64), np.full(len(rank), -1, np.int64)
            for n in np.unique(lengths).tolist():
                here = lengths == n
                if n:
                    row[here], at[here] = sent.value.find(n, rank[here])
                else:
                    row[here] = rank[here] % n_rows
            yield pa.RecordBatch.from_arrays([pa.array(row), pa.array(at.astype(np.int32)), *batch.columns[3:]], names=["row_id", "at", "doc_id", "doc_row", "start", "ids"])

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, out = None, [], []

        def close() -> None:
            segments = [x for x in held if x[0] >= 0]
            ids = np.full(row_len, pad, kind)
            ends = [0]
            for at, _, _, _, x in segments:
                ids[at : at + len(x)] = x
                ends.append(at + len(x))
            out.append((now, ends[-1], ids.tobytes(), ends, ends[:-1], *([x[k] for x in segments] for k in (1, 2, 3)), [x[1] for x in held if x[0] < 0]))

        for batch in batches:
            for row, at, doc, doc_row, start, x in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if row != now and held:
                    close()
                    held = []
                    if len(out) == 512:
                        yield _batch(out)
                        out = []
                now = row
                held.append((at, doc, doc_row, start, np.frombuffer(x, kind)))
        if held:
            close()
        if out:
            yield _batch(out)

    dealt = all_.mapInArrow(deal, "row_id long, at int, doc_id long, doc_row long, start long, ids binary")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return dealt.repartition(n, "row_id").sortWithinPartitions("row_id", "at").mapInArrow(join, SCHEMA)


def _batch(made: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*made, strict=True), _ARROW, strict=True)], schema=_ARROW)


def position_ids(resets: list[int], n_tokens: int) -> np.ndarray:
    """Position ids of a packed row, from its resets."""
    at = np.zeros(n_tokens, np.int64)
    at[resets] = resets
    return np.arange(n_tokens) - np.maximum.accumulate(at)


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed_rows(table(spark, sf_dir, "documents"))


QUERY = ("op7_packing", op7_packing)
#: Byte-pair encoding is not SQL; tests unpack and decode every document.
ORACLE = None
