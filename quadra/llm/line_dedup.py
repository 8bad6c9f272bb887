"""Line dedup with levelled sorted runs of line hashes.

``LineRuns`` is the store. A run is a table bucketed and sorted by line hash, with the number of documents that hold
the line and, in the run where the line first came, the document that brought it. Every batch of documents is
aggregated by hash, merge-anti-joined with each standing run (so it is known which of its lines are new) and adds
itself as a run. When ``fanout`` runs stand on a level, they are merged, two sorted runs at a time, into one run of the
next level, so a store of n batches has O(fanout * log n) runs. Runs of one store share their buckets: joins and merges
of runs shuffle nothing and sort nothing.

``drop_repeated`` is the rule of the query: a line key found in at least ``min_docs`` documents loses all its lines
except in the largest document that holds it. Its batches are ranges of document ids, the largest first, so the
document that brings a new line is the largest of all that hold it, and the counts that the runs carry are complete
when the last batch is in. ``LineRuns.unseen`` is the rule for a stream of batches: a batch loses the lines that earlier
batches hold.

A line's key is the line without ``[\\x20\\x09-\\x0D]`` at its ends and with A-Z lower-cased; keys shorter than
``min_chars`` code points are never dropped. Runs hold the MD5 of the key (128 bits), not the key.

Defined results: a null or empty text is one empty line and stays (the result text is empty); repeated document
rows are one document for counting and each keep the same lines; documents with a null id count as one document
smaller than all others. Columns of the input named like the output's are replaced by it.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quadra.llm.documents import table
from quadra.llm.store import Workspace

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_BLANK = " \t\n\x0b\x0c\r"
#: Stands for a null document id: below every id that is not null.
_NO_ID = -(2**63)


def line_key(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(_BLANK)), _UPPER, _LOWER)


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _hashes(lines: Column, min_chars: int) -> Column:
    """For each line the hash of its key, or null if the key is short."""
    # a line shorter than the bound can't have a longer key, so most short lines are not trimmed at all
    return F.transform(lines, lambda x: F.when((F.length(x) >= min_chars) & (F.length(F.btrim(x, F.lit(_BLANK))) >= min_chars), F.unhex(F.md5(line_key(x).cast("binary")))))


@contextmanager
def _sorted_scans(spark: SparkSession) -> Iterator[None]:
    """While runs are joined and written: a bucket of one sorted file is read as sorted."""
    key = "spark.sql.legacy.bucketedTableScan.outputOrdering"
    before = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


class LineRuns:
    """Sorted runs in the shared folder: ``levels[i]`` lists the runs of level i, oldest first.

    Runs are known to the session's catalog (Spark's own, as others know no buckets) only as long as they stand;
    ``close`` removes them.
    """

    def __init__(self, spark: SparkSession, fanout: int = 2, min_chars: int = 40, buckets: int | None = None) -> None:
        if fanout < 2:
            raise ValueError("a level holds two runs at least")
        self.space = Workspace(spark, "line-runs")
        self.spark, self.fanout, self.min_chars = spark, fanout, min_chars
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[str]] = []
        self._name, self._n = f"quadra_lines_{uuid.uuid4().hex}", 0

    def runs(self) -> list[DataFrame]:
        return [self.spark.table(r) for level in self.levels for r in level]

    def _write(self, df: DataFrame) -> str:
        self._n += 1
        name = f"{self._name}_{self._n}"
        path = f"{self.space.path}/{name}"
        df.write.format("parquet").option("compression", "zstd").option("path", path).bucketBy(self.buckets, "h").sortBy("h").saveAsTable(name)
        return name

    def _drop(self, *names: str) -> None:
        for name in names:
            self.spark.sql(f"DROP TABLE IF EXISTS `{name}`")
            self.space.delete(f"{self.space.path}/{name}")

    def close(self) -> None:
        self._drop(*(r for level in self.levels for r in level))
        self.levels = []

    @staticmethod
    def merged(old: DataFrame, new: DataFrame) -> DataFrame:
        """One run of two: a merge of sorted runs, counts added, the document of the run that knew the line first."""
        both = old.alias("a").join(new.alias("b").hint("merge"), F.col("a.h") == F.col("b.h"), "full")
        return both.select(F.coalesce("a.h", "b.h").alias("h"), (F.coalesce("a.n_docs", F.lit(0)) + F.coalesce("b.n_docs", F.lit(0))).alias("n_docs"), F.coalesce("a.first_doc", "b.first_doc").alias("first_doc"))

    def _one(self, runs: list[str]) -> str:
        done = runs[0]
        for r in runs[1:]:
            with _sorted_scans(self.spark):
                nxt = self._write(self.merged(self.spark.table(done), self.spark.table(r)))
            self._drop(done, r)
            done = nxt
        return done

    def add(self, lines: DataFrame) -> None:
        """Add a batch of lines (h, d): hold its hashes against all runs, then add them as a run and merge full levels.

        A hash that no run has is new, and ``first_doc`` is the largest document that brings it; a hash that is
        known only adds to the count.
        """
        # two steps of counting, so that a line of a third of all documents never meets in one task
        batch = lines.groupBy("h").agg(F.count_distinct("d").alias("n_docs"), F.max("d").alias("first_doc"))
        known = F.lit(False)
        for k, r in enumerate(self.runs()):
            mark = r.select(F.col("h").alias(f"h{k}"))
            batch = batch.join(mark.hint("merge"), F.col("h") == F.col(f"h{k}"), "left")
            known = known | F.col(f"h{k}").isNotNull()
        with _sorted_scans(self.spark):
            run = self._write(batch.select("h", "n_docs", F.when(~known, F.col("first_doc")).alias("first_doc")))
        level = 0
        while True:
            if level == len(self.levels):
                self.levels.append([])
            self.levels[level].append(run)
            if len(self.levels[level]) < self.fanout:
                return
            full, self.levels[level] = self.levels[level], []
            run = self._one(full)
            level += 1

    def counted(self) -> DataFrame:
        """All runs as one, (h, n_docs, first_doc), each hash once; older runs, on higher levels, first."""
        whole = [r for level in reversed(self.levels) for r in level]
        if not whole:
            return self.spark.createDataFrame([], "h binary, n_docs long, first_doc long")
        self.levels = [[self._one(whole)]]
        return self.spark.table(self.levels[0][0])

    def unseen(self, docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
        """The batch without lines that earlier batches hold (and without later copies in the batch); adds its run."""
        space = self.space
        # numbered rows are written first: a plan that runs again may not number them alike
        rows = space.keep(docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("doc"), F.monotonically_increasing_id().alias("row")), "rows")
        hashed = rows.select("row", _lines(F.col(f"doc.`{text}`")).alias("lines")).withColumn("hs", _hashes(F.col("lines"), self.min_chars))
        zipped = F.arrays_zip(F.col("lines").alias("line"), F.col("hs").alias("h"))
        lines = hashed.select("row", F.posexplode(zipped).alias("pos", "x")).select("row", "pos", F.col("x").getField("line").alias("line"), F.col("x").getField("h").alias("h"))
        lines = space.keep(lines, "batch")
        first = lines.where("h is not null").groupBy("h").agg(F.min(F.struct("row", "pos")).alias("first"))
        for r in self.runs():
            first = first.join(r.select("h").hint("merge"), "h", "left_anti")
        kept = lines.join(first.withColumnRenamed("h", "fh").hint("merge"), F.col("h") == F.col("fh"), "left")
        keep = F.col("h").isNull() | (F.struct("row", "pos") == F.col("first"))
        out = kept.groupBy("row").agg(F.array_sort(F.collect_list(F.when(F.coalesce(keep, F.lit(False)), F.struct("pos", "line")))).alias("kept"))
        joined = F.array_join(F.transform("kept", lambda x: x["line"]), "\n")
        new = [F.col("_kept").alias(text) if c == text else F.col(f"doc.`{c}`").alias(c) for c in docs.columns]
        with _sorted_scans(self.spark):
            done = space.keep(rows.join(out.select("row", joined.alias("_kept")), "row").select(*new), "kept")
        ids = rows.select("row", F.coalesce(F.col(f"doc.`{key}`").cast("long"), F.lit(_NO_ID)).alias("d"))
        self.add(lines.where("h is not null").join(ids, "row").select("h", "d"))
        space.drop(lines, rows)
        return done


def _flags(places: Column) -> Column:
    """Array of booleans, true at the (sorted) places; as long as the last of them needs."""
    gap = F.transform(places, lambda x, i: F.concat(F.array_repeat(F.lit(False), x - F.coalesce(F.get(places, i - 1), F.lit(-1)) - 1), F.array(F.lit(True))))
    return F.flatten(gap)


def drop_repeated(docs: DataFrame, min_docs: int = 5, min_chars: int = 40, batches: int = 6, fanout: int = 2, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``docs`` with the kept text and (n_lines, n_dropped).

    Texts are hashed once, into a table of line hashes by document. Its batches, ranges of ids, go through the runs one
    after the other; the merged runs tell which lines are common and which document keeps them.
    """
    spark = docs.sparkSession
    store = LineRuns(spark, fanout, min_chars)
    space = store.space
    doc = F.coalesce(F.col(key).cast("long"), F.lit(_NO_ID))
    # a row is known by its id and its text's hash: equal rows lose equal lines, and a repeated id makes no hot group
    same = F.xxhash64(F.coalesce(F.col(text), F.lit("")))
    hashed = docs.select(doc.alias("d"), same.alias("t"), _hashes(_lines(F.col(text)), min_chars).alias("hs"))
    hashed = space.keep(hashed.where(F.exists("hs", lambda h: h.isNotNull())), "hashed")
    cuts = hashed.agg(F.percentile_approx("d", [i / batches for i in range(1, batches)] or [0.5], 1000)).first()[0] or []
    cuts = [None, *sorted(set(cuts)), None][:: 1 if batches > 1 else 2]
    for low, high in list(zip(cuts, cuts[1:], strict=False))[::-1]:
        part = hashed
        part = part if low is None else part.where(F.col("d") > low)
        part = part if high is None else part.where(F.col("d") <= high)
        store.add(part.select("d", F.explode(F.array_compact(F.array_distinct("hs"))).alias("h")))
    common = space.keep(store.counted().where(F.col("n_docs") >= min_docs).select("h", F.col("first_doc").alias("last_doc")), "common")
    store.close()
    # the places of lines that a row loses; merge joins at every size, as neither side has a bound, and Spark
    # splits the partition of a very common line
    lines = hashed.select("d", "t", F.posexplode("hs").alias("pos", "h")).where("h is not null")
    lost = lines.join(common.hint("merge"), "h").where("d < last_doc").groupBy("d", "t").agg(F.array_sort(F.collect_set("pos")).alias("places"))
    lost = space.keep(lost.select("d", "t", F.size("places").cast("long").alias("n"), _flags(F.col("places")).alias("flags")), "lost")
    space.drop(common, hashed)
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), doc.alias("_d"), same.alias("_t"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    joined = rows.join(lost.hint("merge"), (F.col("_d") == F.col("d")) & (F.col("_t") == F.col("t")), "left")
    stays = F.filter(_lines(F.col("_text")), lambda x, i: ~F.coalesce(F.get(F.col("flags"), i), F.lit(False)))
    kept = F.when(F.col("flags").isNull(), F.col("_text")).otherwise(F.array_join(stays, "\n"))
    n_lines = (F.length("_text") - F.length(F.replace("_text", F.lit("\n"), F.lit(""))) + 1).cast("long")
    out = joined.select("row", n_lines.alias("n_lines"), F.coalesce("n", F.lit(0).cast("long")).alias("n_dropped"), kept.alias("_kept"))
    plain = [F.col("_kept").alias(text) if c == text else F.col(f"row.`{c}`").alias(c) for c in docs.columns if c not in ("n_lines", "n_dropped")]
    return out.select(*plain, "n_lines", "n_dropped")


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = drop_repeated(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


QUERY = ("op9_line_dedup", op9_line_dedup)
ORACLE = r"""
WITH l AS (
  SELECT rid, doc_id, p, line, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (
    SELECT rid, doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS p
    FROM (SELECT row_number() OVER () AS rid, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents))),
common AS (
  SELECT k, max(coalesce(doc_id, -9223372036854775808)) AS last_doc FROM l WHERE length(k) >= 40
  GROUP BY k HAVING count(DISTINCT coalesce(doc_id, -9223372036854775808)) >= 5),
marked AS (
  SELECT rid, doc_id, p, line, last_doc IS NOT NULL AND coalesce(doc_id, -9223372036854775808) < last_doc AS gone
  FROM l LEFT JOIN common USING (k))
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, CAST(sum(CAST(gone AS INT)) AS BIGINT) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY p) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY rid
"""
