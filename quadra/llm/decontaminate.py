"""Benchmark decontamination by suffix arrays of the training texts.

Each shard (a run of whole documents of bounded size) gets a suffix array over its words, built by
prefix doubling. Every suffix of every benchmark item is binary-searched in it, word by word, which gives
the longest verbatim match, its places, and the places of its first ``window`` words. Nothing of the documents is
shuffled: a document lies in one shard, so its row is complete where it is made.

The benchmark is tokenised by tasks into slices of about ``slice_words`` words, files in the shared folder; the driver
sees their number only. A task sorts its shards once and searches ``GROUP`` of them for one slice after the other, so
it holds one slice at a time, whatever the benchmark's size. Sorting stops at the depth of the longest item: no search
looks deeper, so the order beyond it is unused.

Defined results: a null or wordless text has no words and is never contaminated; null or wordless items have
no windows; an item of fewer words than ``window`` is one window of all its words; repeated document rows each
get their own row; repeated items count once per id, and null ids as one id written "null". Of equally long matches the
item whose id sorts first as text, then the first place, is named. Extra columns are kept by ``decontaminate``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quadra.llm.bytestok import ALNUM, blocks, words
from quadra.llm.documents import table
from quadra.llm.store import Workspace, open_store, small_batches

#: Words of benchmark text in one slice (16 bytes a word).
SLICE_WORDS = 2_000_000
#: Shards that are searched for a slice before the next one is read.
GROUP = 8


@dataclass
class Queries:
    """Items of one slice: word hashes, their first words (n + 1), ids, and the suffixes to search."""

    hashes: np.ndarray
    first: np.ndarray
    ids: list[str]
    item: np.ndarray
    start: np.ndarray
    length: np.ndarray
    need: np.ndarray

    @classmethod
    def of(cls, ids: list[str], hashes: list[np.ndarray], window: int) -> Queries:
        # in the order of their ids, so an item's number tells which of two ids sorts first
        order = sorted(range(len(ids)), key=lambda k: ids[k])
        hashes = [hashes[k] for k in order]
        lengths = np.array([len(h) for h in hashes])
        first = np.concatenate([[0], np.cumsum(lengths)])
        item = np.repeat(np.arange(len(hashes)), lengths)
        start = np.arange(first[-1]) - first[item]
        return cls(np.concatenate(hashes), first, [ids[k] for k in order], item, start, lengths[item] - start, np.minimum(window, lengths[item]))


@dataclass
class Slices:
    """Files with the benchmark's items, and the words of the longest of them."""

    files: list[str]
    depth: int
    window: int

    def __iter__(self) -> Iterator[Queries]:
        return (_read_slice(f, self.window) for f in self.files)


@lru_cache(maxsize=1)
def _read_slice(file: str, window: int) -> Queries:
    fs, path = open_store(file)
    with fs.open_input_stream(path, compression=None) as f, pa.ipc.open_stream(f) as reader:
        t = reader.read_all()
    return Queries.of(t.column("item").to_pylist(), [np.frombuffer(x, np.uint64) for x in t.column("words").to_pylist()], window)


def write_slices(benchmark: DataFrame, window: int, text: str = "text", item: str = "item_id", slice_words: int = SLICE_WORDS) -> Slices:
    """Tokenise the benchmark and write its slices, each by one task; a slice holds one item at least."""
    space = Workspace(benchmark.sparkSession, "benchmark")

    def tokenise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, offsets in blocks(batch.column(1)):
                got = words(data, offsets, ALNUM)
                x = [got.of(k) for k in range(j - i)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array([w.tobytes() for w in x], pa.binary()), pa.array([len(w) for w in x], pa.int64())], names=["item", "words", "n"])

    items = benchmark.select(F.coalesce(F.col(item).cast("string"), F.lit("null")), F.col(text)).mapInArrow(tokenise, "item string, words binary, n long")
    items = space.keep(items.where("n > 0").distinct(), "items")
    n, depth = items.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.max("n"), F.lit(1))).first()
    number = F.pmod(F.xxhash64("item", "words"), F.lit(max(1, -(-n // slice_words))))
    folder = space.new_path("slices")

    def write(t: pa.Table) -> pa.Table:
        from pyspark import TaskContext

        fs, base = open_store(folder)
        fs.create_dir(base, recursive=True)
        name = f"slice-{t.column('slice')[0].as_py():06d}"
        part = f"{base}/.{name}.{TaskContext.get().taskAttemptId()}"
        t = t.select(["item", "words"])
        with fs.open_output_stream(part, compression=None) as f, pa.ipc.new_stream(f, t.schema) as out:
            out.write_table(t)
        fs.move(part, f"{base}/{name}")
        return pa.table({"file": [f"{folder}/{name}"]})

    made = items.withColumn("slice", number).groupBy("slice").applyInArrow(write, "file string").collect()
    space.drop(items)
    return Slices(sorted(r["file"] for r in made), depth, window)


def suffix_array(rank: np.ndarray, depth: int) -> np.ndarray:
    """Positions of ``rank`` (small integers, 0 as terminator) sorted by their first ``depth`` values at least."""
    n = len(rank)
    counts = np.bincount(rank)
    r = (np.cumsum(counts) - counts)[rank]  # the place where the group of equal prefixes begins
    size = counts[rank]
    live = np.flatnonzero(size > 1)
    h = 1
    while h < depth and len(live):
        ahead = live + h
        second = np.where(ahead < n, r[np.minimum(ahead, n - 1)] + 1, 0)
        group = r[live]
        key = group * np.int64(n + 2) + second
        order = np.argsort(key)
        key, group, at = key[order], group[order], live[order]
        j = np.arange(len(at))
        new_group = np.ones(len(at), bool)
        new_group[1:] = group[1:] != group[:-1]
        new_key = np.ones(len(at), bool)
        new_key[1:] = key[1:] != key[:-1]
        group_at = np.maximum.accumulate(np.where(new_group, j, 0))
        key_at = np.maximum.accumulate(np.where(new_key, j, 0))
        r[at] = group + key_at - group_at
        lengths = np.diff(np.append(np.flatnonzero(new_key), len(at)))
        live = np.sort(at[np.repeat(lengths, lengths) > 1])
        h *= 2
    return np.argsort(r, kind="stable")


def _bound(column: np.ndarray, sa: np.ndarray, d: int, lo: np.ndarray, hi: np.ndarray, want: np.ndarray) -> np.ndarray:
    """First place in [lo, hi) whose suffix has at ``d`` a value of at least ``want``; all searches at once."""
    lo, hi = lo.copy(), hi.copy()
    last = len(column) - 1
    while True:
        open_ = lo < hi
        if not open_.any():
            return lo
        mid = (lo + hi) >> 1
        less = column[np.minimum(sa[np.minimum(mid, len(sa) - 1)] + d, last)] < want
        lo = np.where(open_ & less, mid + 1, lo)
        hi = np.where(open_ & ~less, mid, hi)


@dataclass
class Found:
    """For each searched suffix: its range at ``need`` words, its longest match and that match's range."""

    lo: np.ndarray
    hi: np.ndarray
    longest: np.ndarray
    longest_lo: np.ndarray
    longest_hi: np.ndarray


def search(column: np.ndarray, sa: np.ndarray, ranks: np.ndarray, q: Queries) -> Found:
    """Binary-search all item suffixes. ``ranks``: the items' words as values of ``column``, -1 if absent."""
    m = len(q.item)
    found = Found(*(np.zeros(m, np.int64) for _ in range(5)))
    at = q.first[q.item] + q.start
    live = np.flatnonzero(ranks[at] >= 0)
    lo, hi = np.zeros(len(live), np.int64), np.full(len(live), len(sa), np.int64)
    d = 0
    while len(live):
        want = ranks[at[live] + d]
        low = _bound(column, sa, d, lo, hi, want)
        high = _bound(column, sa, d, low, hi, want + 1)
        ok = low < high
        live, lo, hi = live[ok], low[ok], high[ok]
        d += 1
        found.longest[live], found.longest_lo[live], found.longest_hi[live] = d, lo, hi
        full = q.need[live] == d
        found.lo[live[full]], found.hi[live[full]] = lo[full], hi[full]
        more = d < q.length[live]
        live, lo, hi = live[more], lo[more], hi[more]
        known = ranks[at[live] + d] >= 0
        live, lo, hi = live[known], lo[known], hi[known]
    return found


@dataclass
class Shard:
    """Words of a run of documents as ranks, a 0 after each document, and the sorted suffixes that begin with a word."""

    column: np.ndarray
    first: np.ndarray
    sa: np.ndarray
    vocabulary: np.ndarray

    @classmethod
    def of(cls, hashes: np.ndarray, first: np.ndarray, depth: int) -> Shard:
        docs = len(first) - 1
        vocabulary, rank = np.unique(hashes, return_inverse=True)
        column = np.zeros(len(hashes) + docs, np.int64)
        of = np.repeat(np.arange(docs), np.diff(first))
        column[np.arange(len(hashes)) + of] = rank + 1
        sa = suffix_array(column, depth) if len(column) else np.zeros(0, np.int64)
        return cls(column, first + np.arange(docs + 1), sa[docs:], vocabulary)

    def ranks(self, q: Queries) -> np.ndarray:
        if not len(self.vocabulary):
            return np.full(len(q.hashes), -1)
        at = np.minimum(np.searchsorted(self.vocabulary, q.hashes), len(self.vocabulary) - 1)
        return np.where(self.vocabulary[at] == q.hashes, at + 1, -1)


def _expand(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All places of the ranges, and the range of each."""
    n = hi - lo
    of = np.repeat(np.arange(len(n)), n)
    return np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + lo[of], of


@dataclass
class Marks:
    """What the slices so far have found in one shard."""

    hit: np.ndarray
    items: list[set[str]]
    #: Per document the longest match: (-words, item, place in the document), or None.
    best: list[tuple | None] = field(default_factory=list)

    @classmethod
    def of(cls, shard: Shard) -> Marks:
        n = len(shard.first) - 1
        return cls(np.zeros(len(shard.column), bool), [set() for _ in range(n)], [None] * n)

    def add(self, shard: Shard, q: Queries) -> None:
        ranks = shard.ranks(q)
        found = search(shard.column, shard.sa, ranks, q)
        hit = np.zeros(len(shard.column) + 1, np.int64)
        some = np.flatnonzero(found.hi > found.lo)
        place, of = _expand(found.lo[some], found.hi[some])
        at, which = shard.sa[place], some[of]
        np.add.at(hit, at, 1)
        np.add.at(hit, at + q.need[which], -1)
        self.hit |= np.cumsum(hit)[:-1] > 0
        pairs = np.unique((np.searchsorted(shard.first, at, side="right") - 1) * np.int64(len(q.ids)) + q.item[which])
        for d, i in zip((pairs // len(q.ids)).tolist(), (pairs % len(q.ids)).tolist(), strict=True):
            self.items[d].add(q.ids[i])
        # every place of a window that no longer match holds, grown to its end: a document's longest is among them
        opens = _opens(shard, q, ranks, at, which)
        at, which = at[opens], which[opens]
        words_ = _grown(shard, q, ranks, at, which)
        doc = np.searchsorted(shard.first, at, side="right") - 1
        order = np.lexsort((at, q.item[which], -words_, doc))
        top = order[np.flatnonzero(np.diff(doc[order], prepend=-1))]
        for d, k in zip(doc[top].tolist(), top.tolist(), strict=True):
            new = (-int(words_[k]), q.ids[q.item[which[k]]], int(at[k] - shard.first[d]))
            self.best[d] = new if self.best[d] is None else min(self.best[d], new)


def _opens(shard: Shard, q: Queries, ranks: np.ndarray, at: np.ndarray, which: np.ndarray) -> np.ndarray:
    """Whether a match of suffix ``which`` at ``at`` cannot be made longer to the left."""
    start = q.start[which]
    before = np.where(start > 0, ranks[q.first[q.item[which]] + np.maximum(start, 1) - 1], -2)
    return (at == 0) | (shard.column[np.maximum(at, 1) - 1] != before)


def _grown(shard: Shard, q: Queries, ranks: np.ndarray, at: np.ndarray, which: np.ndarray) -> np.ndarray:
    """Words of the matches at ``at`` that hold a window, each to its end."""
    words_ = q.need[which].copy()
    from_, most = q.first[q.item[which]] + q.start[which], q.length[which]
    live = np.flatnonzero(words_ < most)
    while len(live):
        n = words_[live]
        live = live[shard.column[at[live] + n] == ranks[from_[live] + n]]
        words_[live] += 1
        live = live[words_[live] < most[live]]
    return words_


def _groups(batches: Iterator[pa.RecordBatch], text: int, depth: int) -> Iterator[list[tuple[list[pa.Array], Shard]]]:
    """Groups of shards with the columns before ``text``."""
    held = []
    for batch in batches:
        for i, j, data, offsets in blocks(batch.column(text)):
            got = words(data, offsets, ALNUM)
            held.append(([batch.column(c).slice(i, j - i) for c in range(text)], Shard.of(got.hashes, got.first, depth)))
            if len(held) == GROUP:
                yield held
                held = []
    if held:
        yield held


MADE = "n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, longest long, longest_item string, longest_at long"


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = 10, text: str = "text", keep: list[str] | None = None, slice_words: int = SLICE_WORDS) -> DataFrame:
    """The columns ``keep`` of ``docs`` with, per row: n_words, n_hit, n_items, items_sha256, contaminated, and the
    longest match that holds a window: its words (0 if there is none), its item and its first word in the document.

    A word is hit if it lies in an occurrence of a window of ``window`` consecutive item words.
    """
    small_batches(docs.sparkSession)
    keep = docs.columns if keep is None else keep
    slices = write_slices(benchmark, window, slice_words=slice_words)
    k = len(keep)
    out = T.StructType([*(docs.schema[c] for c in keep), *T._parse_datatype_string(MADE).fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches, k, slices.depth):
            marks = [Marks.of(shard) for _, shard in group]
            for q in slices:
                for m, (_, shard) in zip(marks, group, strict=True):
                    m.add(shard, q)
            for m, (kept, shard) in zip(marks, group, strict=True):
                first = shard.first
                n = np.diff(first) - 1  # each document ends with a terminator
                sums = np.concatenate([[0], np.cumsum(m.hit)])
                count = sums[first[1:]] - sums[first[:-1]]
                items = [sorted(x) for x in m.items]
                sha = [hashlib.sha256(",".join(x).encode()).hexdigest() for x in items]
                best = [x or (0, None, None) for x in m.best]
                made = [pa.array(n, pa.int64()), pa.array(count, pa.int64()), pa.array([len(x) for x in items], pa.int64()), pa.array(sha, pa.string()), pa.array(count > 0), pa.array([-x[0] for x in best], pa.int64()), pa.array([x[1] for x in best], pa.string()), pa.array([x[2] for x in best], pa.int64())]
                yield pa.RecordBatch.from_arrays([*kept, *made], names=out.names)

    return docs.select(*[F.col(c) for c in keep], F.col(text).alias("__quadra_text")).mapInArrow(run, out)


def matches(docs: DataFrame, benchmark: DataFrame, window: int = 10, text: str = "text", key: str = "doc_id", slice_words: int = SLICE_WORDS) -> DataFrame:
    """Longest verbatim matches of item suffixes: (doc_id, item_id, item_start, doc_start, n_words), word positions from 0.

    A row for every place of each suffix's longest match that is at least the item's window long and
    cannot be made longer to the left.
    """
    small_batches(docs.sparkSession)
    slices = write_slices(benchmark, window, slice_words=slice_words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches, 1, slices.depth):
            for q in slices:
                for kept, shard in group:
                    ranks = shard.ranks(q)
                    found = search(shard.column, shard.sa, ranks, q)
                    some = np.flatnonzero(found.longest >= q.need)
                    place, of = _expand(found.longest_lo[some], found.longest_hi[some])
                    at, which = shard.sa[place], some[of]
                    opens = _opens(shard, q, ranks, at, which)
                    at, which, n_words = at[opens], which[opens], found.longest[which[opens]]
                    doc = np.searchsorted(shard.first, at, side="right") - 1
                    names = pa.array([q.ids[x] for x in q.item[which]], pa.string())
                    yield pa.RecordBatch.from_arrays([kept[0].take(pa.array(doc)), names, pa.array(q.start[which]), pa.array(at - shard.first[doc]), pa.array(n_words)], names=["doc_id", "item_id", "item_start", "doc_start", "n_words"])

    return docs.select(F.col(key).cast("long"), F.col(text)).mapInArrow(run, "doc_id long, item_id string, item_start long, doc_start long, n_words long")


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 10) -> DataFrame:
    """The documents without a word in an occurrence of a benchmark window; columns as they came."""
    made = {x.split()[0] for x in MADE.split(", ")}
    clash = {c: f"_in_{c}" for c in made & set(docs.columns)}
    plain = docs.withColumnsRenamed(clash)
    kept = contamination(plain, benchmark, window).where("not contaminated").select(plain.columns)
    return kept.withColumnsRenamed({v: c for c, v in clash.items()}).select(docs.columns)


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return contamination(docs, table(spark, sf_dir, "benchmark"), keep=["doc_id"])


_AZ = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
_WORDS = rf"regexp_extract_all(translate(coalesce(text, ''), {_AZ}), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

QUERY = ("op2_decontaminate", op2_decontaminate)
ORACLE = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {_WORDS} AS w FROM documents),
i AS (
  SELECT row_number() OVER () AS irow, * FROM (
    SELECT DISTINCT coalesce(CAST(item_id AS VARCHAR), 'null') AS item_id, {_WORDS} AS w FROM benchmark)),
win AS (
  SELECT item_id, irow, s AS t, least(10, len(w)) AS sz, array_to_string(w[s:s + least(10, len(w)) - 1], ' ') AS k
  FROM (SELECT item_id, irow, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS s FROM i WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT sz FROM win),
dw AS (
  SELECT rid, sz, s, array_to_string(w[s:s + sz - 1], ' ') AS k
  FROM (SELECT rid, w, sz, unnest(range(1, len(w) - sz + 2)) AS s FROM d, sizes WHERE len(w) >= sz)),
hits AS (SELECT rid, s, dw.sz, item_id, irow, t FROM dw JOIN win ON dw.sz = win.sz AND dw.k = win.k),
hit AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(s, s + sz)) AS p FROM hits) GROUP BY rid),
items AS (
  SELECT rid, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids
  FROM (SELECT DISTINCT rid, item_id FROM hits) GROUP BY rid),
-- windows that follow one another in document and item alike are one match
runs AS (
  SELECT rid, item_id, min(s) - 1 AS place, any_value(sz) - 1 + count(*) AS n
  FROM (SELECT *, s - row_number() OVER (PARTITION BY rid, irow, s - t ORDER BY s) AS run FROM hits)
  GROUP BY rid, item_id, irow, s - t, run),
best AS (
  SELECT rid, item_id, place, n FROM runs QUALIFY row_number() OVER (PARTITION BY rid ORDER BY n DESC, item_id, place) = 1)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AS contaminated, CAST(coalesce(best.n, 0) AS BIGINT) AS longest,
  best.item_id AS longest_item, CAST(best.place AS BIGINT) AS longest_at
FROM d LEFT JOIN hit USING (rid) LEFT JOIN items USING (rid) LEFT JOIN best USING (rid)
"""
