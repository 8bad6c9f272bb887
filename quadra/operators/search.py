"""Search: exact and approximate vectors, full text with BM25."""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import TYPE_CHECKING

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quadra.operators.graph import cut

if TYPE_CHECKING:
    from pyspark.ml.clustering import KMeansModel

STOP = "a an and are as at be but by for if in into is it no not of on or such that the their then there these they this to was will with".split()
K1, B = 1.2, 0.75


def distance(c: Column, q: list[float], metric: str) -> Column:
    """l2, cosine (1 for a zero vector) or inner_product (negated) distance to a query vector."""
    v = F.array(*[F.lit(float(x)) for x in q])
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)
    if metric == "l2":
        return F.sqrt(F.aggregate(F.zip_with(c, v, lambda x, y: F.pow(x.cast("double") - y, F.lit(2.0))), F.lit(0.0), lambda s, x: s + x))
    if metric == "inner_product":
        return -dot(c, v)
    if metric == "cosine":
        norms = F.sqrt(dot(c, F.transform(c, lambda x: x.cast("double")))) * float(np.linalg.norm(q))
        return F.when(norms == 0, F.lit(1.0)).otherwise(1 - dot(c, v) / norms)
    raise ValueError(f"unknown metric {metric}")


def top_vectors(df: DataFrame, column: str, key: str, q: list[float], k: int, metric: str = "l2", digits: int = 6) -> DataFrame:
    """Exact nearest rows; Spark keeps k rows per task, so nothing but those is shuffled."""
    return df.select(key, F.round(distance(F.col(column), q, metric), digits).alias("distance")).orderBy("distance", key).limit(k)


def _least_of_block(w: np.ndarray, v: np.ndarray, ids: np.ndarray, asked: np.ndarray, probed: np.ndarray | None, k: int, digits: int) -> list[tuple[np.ndarray, ...]]:
    """(place of the query, id, rough, distance) arrays, one of each a query: the ``k`` rows of least (rough, id).

    Products of matrices give squares that are near enough to leave out nearly all rows; what is left, with all that may
    round to the k-th distance, is measured and ordered as if every row was. ``probed``: which rows each query may meet.
    """
    out, norms, step = [], np.einsum("ij,ij->i", w, w), max(1, 4_000_000 // max(1, len(w)))
    for start in range(0, len(asked), step):
        x = asked[start : start + step]
        own = np.einsum("ij,ij->i", x, x)
        near = norms[None, :] - 2 * (x @ w.T) + own[:, None]
        if probed is not None:
            near[~probed[start : start + step]] = np.inf
        least = np.partition(near, k - 1, axis=1)[:, k - 1] if k < len(w) else np.full(len(x), np.inf)
        slack = 1e-10 * (norms[np.isfinite(norms)].max(initial=0) + own) + 1e-300
        bound = (np.sqrt(np.maximum(least, 0) + slack) + 2 * 10.0**-digits) ** 2 + slack
        for i in range(len(x)):
            # not a number is kept, and comes last
            left = ~(near[i] > bound[i])
            if probed is not None:
                left &= probed[start + i]
            some = np.flatnonzero(left)
            rough = np.round(np.sqrt(((w[some] - x[i]) ** 2).sum(1)), digits)
            best = np.lexsort((ids[some], rough))[:k]
            exact = np.round(np.sqrt(((v[some[best]] - x[i]) ** 2).sum(1)), digits)
            out.append((np.full(len(best), start + i), ids[some[best]], rough[best], exact))
    return out


def _blocked(rows: DataFrame, queries: DataFrame, k: int, digits: int) -> DataFrame:
    """(query, id, rough, distance): per query and block of rows the ``k`` of least rough distance.

    ``rows``: (list, id, v, w), ``queries``: (lists, query, v); a query meets the rows of its lists, block by block.
    Distances are l2, to v and (rough) to w.
    """
    # few large blocks, as each gives k rows a query
    r, q = max(4, -(-rows.count() // 50_000)), max(1, -(-queries.count() // 4000))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    dealt = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    left = rows.withColumn("a", dealt("id", r)).withColumn("b", every(q))
    right = queries.withColumn("b", dealt("query", q)).withColumn("a", every(r))

    def run(t: pa.Table, u: pa.Table) -> pa.Table:
        matrix = lambda x, name: x.column(name).combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(float).reshape(x.num_rows, -1)
        found = []
        if t.num_rows and u.num_rows:
            lists, asked = t.column("list").to_numpy(), u.column("lists").to_pylist()
            held = np.zeros((u.num_rows, max(int(lists.max()), *map(max, asked)) + 1), bool)
            for i, probes in enumerate(asked):
                held[i, probes] = True
            ids, names, v, w, x = t.column("id").to_numpy(), u.column("query").to_numpy(), matrix(t, "v"), matrix(t, "w"), matrix(u, "v")
            whole = held[:, np.unique(lists)].all()
            for start in range(0, len(x), 64):
                part = slice(start, start + 64)
                for i, *rest in _least_of_block(w, v, ids, x[part], None if whole else held[part][:, lists], k, digits):
                    found.append((names[part][i], *rest))
        columns = [np.concatenate(c) for c in zip(*found, strict=True)] if found else [np.zeros(0)] * 4
        return pa.table({n: pa.array(c.astype(kind)) for c, (n, kind) in zip(columns, (("query", np.int64), ("id", np.int64), ("rough", float), ("distance", float)), strict=True)})

    return left.groupBy("a", "b").cogroup(right.groupBy("a", "b")).applyInArrow(run, "query long, id long, rough double, distance double")


def _least(df: DataFrame, by: str, k: int) -> DataFrame:
    return df.withColumn("_n", F.row_number().over(Window.partitionBy("query").orderBy(by, "id"))).where(F.col("_n") <= k).drop("_n")


def nearest(df: DataFrame, queries: DataFrame, column: str, key: str, k: int, digits: int = 6) -> DataFrame:
    """(query, key, distance): the exact nearest rows (l2) of every row of ``queries``, by blocks of both."""
    v = F.col(column)
    rows = df.where(v.isNotNull()).select(F.lit(0).alias("list"), F.col(key).cast("long").alias("id"), v.alias("v"), v.alias("w"))
    asked = queries.where(v.isNotNull()).select(F.array(F.lit(0)).alias("lists"), F.col(key).cast("long").alias("query"), v.alias("v"))
    return _least(_blocked(rows, asked, k, digits), "distance", k).select("query", F.col("id").alias(key), "distance")


def quantize(c: Column, low: float, high: float, bits: int) -> Column:
    """Each component as one of 2**bits steps between ``low`` and ``high``."""
    steps = (1 << bits) - 1
    return F.transform(c, lambda x: F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), (x - low) / (high - low))) * steps).cast("int"))


def dequantize(c: Column, low: float, high: float, bits: int) -> Column:
    return F.transform(c, lambda x: low + x * ((high - low) / ((1 << bits) - 1)))


class IvfIndex:
    """Inverted lists around k-means centres; a search probes the nearest lists and reranks exactly.

    With ``bits`` (8, 4, 2 or 1) the probed rows are ranked by quantized vectors first and ``rerank`` times k of them
    exactly. ``save`` writes the rows by list, so a search through a loaded index reads the files of the lists it probes.
    """

    def __init__(self, df: DataFrame, column: str, key: str, lists: int, seed: int = 1, bits: int | None = None, sample: int = 100_000, model: KMeansModel | None = None) -> None:
        from pyspark.ml.clustering import KMeans
        from pyspark.ml.functions import array_to_vector

        self.column, self.key, self.bits = column, key, bits
        x = df.withColumn("_v", array_to_vector(F.col(column)))
        # centres are trained on a bounded sample, or are another index's; every row is indexed
        self.model = model = model or KMeans(k=lists, seed=seed, featuresCol="_v", predictionCol="list", maxIter=10).fit(x.orderBy(F.xxhash64(key)).limit(sample))
        self.centres = [c.tolist() for c in model.clusterCenters()]
        self.rows = model.transform(x).drop("_v")
        if bits:
            bounds = df.select(F.explode(column).alias("x")).agg(F.min("x"), F.max("x")).first()
            self.low, self.high = float(bounds[0]), float(bounds[1])
            self.rows = self.rows.withColumn("_q", quantize(F.col(column), self.low, self.high, bits))

    def save(self, folder: str) -> None:
        spark = self.rows.sparkSession
        self.rows.repartition("list").write.partitionBy("list").parquet(f"{folder}/rows")
        about = [(self.column, self.key, self.bits, getattr(self, "low", None), getattr(self, "high", None), self.centres)]
        spark.createDataFrame(about, "column string, key string, bits int, low double, high double, centres array<array<double>>").write.parquet(f"{folder}/about")

    @classmethod
    def load(cls, spark: SparkSession, folder: str) -> IvfIndex:
        out = cls.__new__(cls)
        about = spark.read.parquet(f"{folder}/about").first()
        out.column, out.key, out.bits, out.low, out.high, out.centres = about["column"], about["key"], about["bits"], about["low"], about["high"], [list(c) for c in about["centres"]]
        out.rows = spark.read.parquet(f"{folder}/rows")
        return out

    def search(self, q: list[float], k: int, probes: int, metric: str = "l2", rerank: int = 4) -> DataFrame:
        near = np.argsort([np.linalg.norm(np.array(c) - q) for c in self.centres])[:probes]
        found = self.rows.where(F.col("list").isin([int(x) for x in near]))
        if self.bits:
            rough = distance(dequantize(F.col("_q"), self.low, self.high, self.bits), q, metric)
            found = found.orderBy(rough, self.key).limit(k * rerank)
        return top_vectors(found, self.column, self.key, q, k, metric)

    def search_all(self, queries: DataFrame, k: int, probes: int, rerank: int = 4, digits: int = 6) -> DataFrame:
        """(query, key, distance): what ``search`` finds (l2) for every row of ``queries``."""
        v = F.col(self.column)
        near = F.array_sort(F.array(*[F.struct(distance(v, c, "l2").alias("d"), F.lit(i).alias("list")) for i, c in enumerate(self.centres)]))
        asked = queries.where(v.isNotNull()).select(F.slice(near, 1, probes)["list"].alias("lists"), F.col(self.key).cast("long").alias("query"), v.alias("v"))
        w = dequantize(F.col("_q"), self.low, self.high, self.bits) if self.bits else v
        rows = self.rows.select("list", F.col(self.key).cast("long").alias("id"), v.alias("v"), w.alias("w"))
        first = k * rerank if self.bits else k
        found = _least(_blocked(rows, asked, first, digits), "rough", first)
        return _least(found, "distance", k).select("query", F.col("id").alias(self.key), "distance")


def analyze(c: Column, analyzer: str = "standard") -> Column:
    """Tokens of a text: standard drops stop words, simple keeps them, keyword is the whole text."""
    if analyzer == "keyword":
        return F.array(c)
    dropped = [""] if analyzer == "simple" else ["", *STOP]
    return F.filter(F.split(F.lower(c), r"[^\p{L}\p{N}]+"), lambda x: ~x.isin(dropped))


def _porter(w: str) -> str:
    """Porter's stemmer."""
    if len(w) < 3:
        return w
    v = lambda s: "".join("v" if c in "aeiou" else "c" for c in re.sub("(?<=[^aeiou])y", "i", s))
    measure = lambda s: len(re.findall("v+c+", v(s)))
    has_vowel = lambda s: "v" in v(s)
    double = lambda s: len(s) > 1 and s[-1] == s[-2] and v(s)[-1] == "c"
    cvc = lambda s: v(s)[-3:] == "cvc" and s[-1] not in "wxy"

    def swap(w: str, pairs: str, least: int) -> str:
        for pair in pairs.split():
            old, _, new = pair.partition(">")
            if w.endswith(old):
                return w[: -len(old)] + new if measure(w[: -len(old)]) > least else w
        return w

    for old, new in (("sses", "ss"), ("ies", "i"), ("ss", "ss"), ("s", "")):
        if w.endswith(old):
            w = w[: -len(old)] + new
            break
    if w.endswith("eed"):
        w = w[:-1] if measure(w[:-3]) > 0 else w
    else:
        for end in ("ed", "ing"):
            if w.endswith(end) and has_vowel(w[: -len(end)]):
                w = w[: -len(end)]
                if w.endswith(("at", "bl", "iz")):
                    w += "e"
                elif double(w) and w[-1] not in "lsz":
                    w = w[:-1]
                elif measure(w) == 1 and cvc(w):
                    w += "e"
                break
    if w.endswith("y") and has_vowel(w[:-1]):
        w = w[:-1] + "i"
    w = swap(w, "ational>ate tional>tion enci>ence anci>ance izer>ize abli>able alli>al entli>ent eli>e ousli>ous ization>ize ation>ate ator>ate alism>al iveness>ive fulness>ful ousness>ous aliti>al iviti>ive biliti>ble", 0)
    w = swap(w, "icate>ic ative> alize>al iciti>ic ical>ic ful> ness>", 0)
    if w.endswith("ion"):
        w = w[:-3] if len(w) > 3 and w[-4] in "st" and measure(w[:-3]) > 1 else w
    else:
        w = swap(w, "ement> ment> al> ance> ence> er> ic> able> ible> ant> ent> ou> ism> ate> iti> ous> ive> ize>", 1)
    if w.endswith("e") and (measure(w[:-1]) > 1 or measure(w[:-1]) == 1 and not cvc(w[:-1])):
        w = w[:-1]
    return w[:-1] if w.endswith("ll") and measure(w[:-1]) > 1 else w


@F.pandas_udf(T.ArrayType(T.StringType()))
def stem(words: pd.Series) -> pd.Series:
    """Stems of arrays of words, each distinct word of a batch stemmed once."""
    known = {w: _porter(w) for w in {w for ws in words if ws is not None for w in ws}}
    return words.map(lambda ws: None if ws is None else [known[w] for w in ws])


def _bm25(tf: Column, df: Column) -> Column:
    """One term's part of a score, beside columns n, dl and avgdl."""
    idf = F.log(1 + (F.col("n") - df + 0.5) / (df + 0.5))
    return idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))


def _has_prefix(tree: tuple) -> bool:
    return tree[0] == "prefix" or tree[0] == "or" and any(map(_has_prefix, tree[1:])) or tree[0] == "and" and any(map(_has_prefix, tree[1] + tree[2]))


def _words(tree: tuple) -> list[str]:
    if tree[0] in ("or", "and"):
        parts = tree[1:] if tree[0] == "or" else tree[1] + tree[2]
        return [w for t in parts for w in _words(t)]
    return list(tree[1])


def _score_column(tree: tuple, part: dict[str, Column]) -> Column:
    """A tree's score from its words' parts; null where it does not match."""
    kind = tree[0]
    if kind == "or":
        return F.greatest(_score_column(tree[1], part), _score_column(tree[2], part))
    if kind == "and":
        hits = [_score_column(t, part) for t in tree[1]]
        out = F.lit(1.0) if not hits else hits[0]
        for h in hits[1:]:
            out = out + h
        for t in tree[2]:
            out = F.when(_score_column(t, part).isNull(), out)
        return out
    total, some, every = F.lit(0.0), F.lit(False), F.lit(True)
    for w in dict.fromkeys(tree[1]):
        total = total + F.coalesce(part[w], F.lit(0.0))
        some, every = some | part[w].isNotNull(), every & part[w].isNotNull()
    return F.when((every & some) if kind == "phrase" else some, total)


class TextIndex:
    """Full-text search over a table; scores are BM25. Each search reads and analyses the texts: see ``StoredTextIndex``."""

    def __init__(self, df: DataFrame, key: str, text: str, analyzer: str = "standard") -> None:
        self.key, self.analyzer = key, analyzer
        toks = df.select(F.col(key).alias("doc"), analyze(F.coalesce(F.col(text), F.lit("")), analyzer).alias("terms"))
        self.docs = toks.select("doc", F.size("terms").alias("dl"), "terms")

    def _stats(self) -> Column:
        return self.docs.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))

    def score_terms(self, words: list[str] | None, prefix: str | None = None) -> DataFrame:
        """(doc, score): the sum over the query's terms. Postings of other terms are dropped before the shuffle."""
        wanted = (lambda x: x.startswith(prefix)) if prefix is not None else (lambda x: x.isin(words))
        post = self.docs.select("doc", "dl", F.explode(F.filter("terms", wanted)).alias("term")).groupBy("doc", "dl", "term").agg(F.count("*").alias("tf"))
        df_ = post.groupBy("term").agg(F.count("*").alias("df"))
        # one row of statistics, and one per query term
        x = post.join(F.broadcast(df_) if prefix is None else df_, "term").crossJoin(F.broadcast(self._stats()))
        return x.groupBy("doc").agg(F.sum(_bm25(F.col("tf"), F.col("df"))).alias("score"))

    def match(self, query: str) -> DataFrame:
        """Terms, AND, OR, NOT, ``prefix*`` and "phrases" (all words, in any order), with parentheses.

        Without prefixes the words are known: one pass over the texts counts them, with no posting shuffled.
        """
        tree = _TextQuery(self, query).run()
        return self._joined(tree) if _has_prefix(tree) else self._scored(tree)

    def _scored(self, tree: tuple) -> DataFrame:
        words = list(dict.fromkeys(_words(tree)))
        # few words are left of a text before each is counted
        wanted = self.docs.select("doc", "dl", F.filter("terms", lambda x: x.isin(words)).alias("hits"))
        times = lambda w: F.size(F.filter("hits", lambda x: x == w))
        # kept in the checkpoint folder: texts are analysed once for the counts and the scores
        counted = cut(wanted.select("doc", "dl", *[times(w).alias(f"tf{i}") for i, w in enumerate(words)]))
        found = [F.count_if(F.col(f"tf{i}") > 0).alias(f"df{i}") for i in range(len(words))]
        stats = counted.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"), *found)
        x = counted.crossJoin(F.broadcast(stats))  # one row
        part = {w: F.when(F.col(f"tf{i}") > 0, _bm25(F.col(f"tf{i}"), F.col(f"df{i}"))) for i, w in enumerate(words)}
        return x.select("doc", _score_column(tree, part).alias("score")).where("score is not null")

    def _joined(self, tree: tuple) -> DataFrame:
        kind = tree[0]
        if kind == "or":
            # an entry that both sides hold keeps the larger score
            return self._joined(tree[1]).unionByName(self._joined(tree[2])).groupBy("doc").agg(F.max("score").alias("score"))
        if kind == "and":
            out = None
            for t in tree[1]:
                x = self._joined(t)
                out = x if out is None else out.join(x.withColumnRenamed("score", "s2"), "doc").select("doc", (F.col("score") + F.col("s2")).alias("score"))
            out = self.docs.select("doc", F.lit(1.0).alias("score")) if out is None else out
            for t in tree[2]:
                out = out.join(self._joined(t), "doc", "left_anti")
            return out
        if kind == "prefix":
            return self.score_terms(None, tree[1])
        return self._scored(tree)

    def top(self, query: str, k: int) -> DataFrame:
        return self.match(query).orderBy(F.col("score").desc(), "doc").limit(k)


#: Tokens counted at a time when postings are made, but for a longer text, which is counted whole.
CHUNK_TOKENS = 2_000_000


def _postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Postings by term of (doc, terms) rows: (term, first, doc, tf, dl), and under a null term all documents of a chunk.

    Texts are counted in chunks, each term of a chunk once, so what is shuffled later has a row a term and chunk.
    """
    for batch in batches:
        docs, terms = batch.column("doc"), batch.column("terms")
        sizes = pc.list_value_length(terms).to_numpy(zero_copy_only=False).astype(np.int64)
        ends, start = np.cumsum(sizes), 0
        while start < len(docs):
            stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + CHUNK_TOKENS, "right")))
            held = np.arange(start, stop)
            words = pc.list_flatten(terms.slice(start, stop - start)).dictionary_encode()
            n = max(1, stop - start)
            # by term, then document
            codes = words.indices.to_numpy(zero_copy_only=False).astype(np.int64)
            key, tf = np.unique(codes * n + np.repeat(held - start, sizes[held]), return_counts=True)
            which, at = key // n, np.concatenate([key % n + start, held])
            begins = np.flatnonzero(np.diff(which, prepend=-1))
            offsets = pa.array(np.append(np.append(begins, len(key)), len(at)).astype(np.int32))
            lists = [docs.take(pa.array(at)), pa.array(np.append(tf, np.zeros(n, np.int64))), pa.array(sizes[at].astype(np.int32))]
            names = pa.concat_arrays([words.dictionary.take(pa.array(which[begins])), pa.nulls(1, words.dictionary.type)])
            first = docs.take(pa.array(at[offsets.to_numpy()[:-1]]))
            yield pa.RecordBatch.from_arrays([names, first, *[pa.ListArray.from_arrays(offsets, x) for x in lists]], names=["term", "first", "doc", "tf", "dl"])
            start = stop


class StoredTextIndex(TextIndex):
    """A text index that is built once: postings, document lengths, terms with their document counts. Keys are unique.

    Postings lie in blocks, (term, first, doc, tf, dl) with a block's postings as arrays, sorted by term in files of
    ranges of (term, first), so a term's files and row groups are found by their least and greatest terms, and a very
    common term is spread over several files. A search reads the postings of its own terms; document lengths are read
    only by searches that all documents may answer.
    """

    def __init__(self, spark: SparkSession, folder: str, analyzer: str = "standard") -> None:
        self.analyzer = analyzer
        blocks = spark.read.parquet(f"{folder}/postings")
        self.postings = blocks.select("term", F.inline(F.arrays_zip("doc", "tf", "dl")))
        self.terms = spark.read.parquet(f"{folder}/terms")
        self.docs = spark.read.parquet(f"{folder}/docs")
        self.n, self.avgdl = spark.read.parquet(f"{folder}/stats").first()

    @classmethod
    def build(cls, df: DataFrame, key: str, text: str, folder: str, analyzer: str = "standard", partitions: int | None = None) -> StoredTextIndex:
        spark = df.sparkSession
        plain = TextIndex(df, key, text, analyzer)
        n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
        kind = plain.docs.schema["doc"].dataType.simpleString()
        # texts are analysed once; written before it is ranged, as finding the ranges would count all over again
        plain.docs.select("doc", "terms").mapInArrow(_postings, f"term string, first {kind}, doc array<{kind}>, tf array<long>, dl array<int>").write.parquet(f"{folder}/counted")
        counted = spark.read.parquet(f"{folder}/counted")
        counted.where("term is null").select(F.inline(F.arrays_zip("doc", "dl"))).write.parquet(f"{folder}/docs")
        counted = counted.where("term is not null")
        post = counted.repartitionByRange(n, "term", "first").sortWithinPartitions("term", "first")
        post.write.option("parquet.block.size", 8 << 20).parquet(f"{folder}/postings")
        # the blocks of a term are together but for those at the ends of files
        terms = spark.read.parquet(f"{folder}/postings").groupBy("term").agg(F.sum(F.size("doc")).alias("df"))
        terms.repartitionByRange(n, "term").sortWithinPartitions("term").write.parquet(f"{folder}/terms")
        spark.read.parquet(f"{folder}/docs").agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.avg("dl"), F.lit(0.0)).alias("avgdl")).write.parquet(f"{folder}/stats")
        return cls(spark, folder, analyzer)

    def _weighed(self, post: DataFrame, df: Column) -> Column:
        tf, dl = post["tf"], post["dl"]
        idf = F.log(1 + (self.n - df + 0.5) / (df + 0.5))
        return idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / F.lit(float(self.avgdl or 1.0))))

    def score_terms(self, words: list[str] | None, prefix: str | None = None) -> DataFrame:
        wanted = lambda c: c.startswith(prefix) if prefix is not None else c.isin(words)
        post, terms = self.postings.where(wanted(F.col("term"))), self.terms.where(wanted(F.col("term")))
        joined = post.join(terms.withColumnRenamed("term", "_t"), F.col("term") == F.col("_t"))
        return joined.groupBy("doc").agg(F.sum(self._weighed(post, F.col("df"))).alias("score"))

    def _scored(self, tree: tuple) -> DataFrame:
        words = list(dict.fromkeys(_words(tree)))
        # a number for each word of the search
        df = {r["term"]: r["df"] for r in self.terms.where(F.col("term").isin(words)).collect()} if words else {}
        post = self.postings.where(F.col("term").isin(words))
        part = {w: f"s{i}" for i, w in enumerate(words)}
        scores = [F.max(F.when(post["term"] == w, self._weighed(post, F.lit(df.get(w, 0))))).alias(part[w]) for w in words] or [F.max(F.lit(None).cast("double")).alias("_none")]
        x = post.groupBy("doc").agg(*scores)
        if _fits_without_words(tree):
            x = self.docs.select(F.col("doc").alias("_d")).join(x, F.col("doc") == F.col("_d"), "left").drop("doc").withColumnRenamed("_d", "doc")
        return x.select("doc", _score_column(tree, {w: F.col(c) for w, c in part.items()}).alias("score")).where("score is not null")


def _fits_without_words(tree: tuple) -> bool:
    """Whether a document that has none of the search's words may answer it."""
    if tree[0] == "or":
        return any(map(_fits_without_words, tree[1:]))
    return tree[0] == "and" and all(map(_fits_without_words, tree[1]))


class _TextQuery:
    def __init__(self, index: TextIndex, query: str) -> None:
        self.index = index
        self.toks = re.findall(r'"[^"]*"|\(|\)|[^\s()]+', query)
        self.i = 0

    def run(self) -> tuple:
        out = self.either()
        if self.i < len(self.toks):
            raise ValueError(f"unexpected {self.toks[self.i]!r} in the search")
        return out

    def peek(self) -> str | None:
        return self.toks[self.i] if self.i < len(self.toks) else None

    def either(self) -> tuple:
        out = self.both()
        while self.peek() == "OR":
            self.i += 1
            out = ("or", out, self.both())
        return out

    def both(self) -> tuple:
        positive, negative = [], []
        while self.peek() not in (None, ")", "OR"):
            if self.peek() == "AND":
                self.i += 1
            elif self.peek() == "NOT":
                self.i += 1
                negative.append(self.unit())
            else:
                positive.append(self.unit())
        if not positive and not negative:
            raise ValueError("an empty search")
        return positive[0] if len(positive) == 1 and not negative else ("and", positive, negative)

    def words(self, text: str) -> list[str]:
        if self.index.analyzer == "keyword":
            return [text]
        found = [w for w in re.split(r"[\W_]+", text.lower()) if w]
        return [w for w in found if w not in STOP] if self.index.analyzer == "standard" else found

    def unit(self) -> tuple:
        t = self.peek()
        self.i += 1
        if t is None:
            raise ValueError("a search ends too soon")
        if t == "(":
            out = self.either()
            if self.peek() != ")":
                raise ValueError("a parenthesis is not closed")
            self.i += 1
            return out
        if t.startswith('"'):
            return ("phrase", self.words(t[1:-1]))
        if t.endswith("*"):
            return ("prefix", t[:-1].lower())
        return ("terms", self.words(t))
