"""Quality classifier: similarity-weighted votes of the nearest labelled documents in a latent-semantic space.

Terms are the document's words (lower-cased, by ``WORDS`` hash buckets), pairs of neighbouring character classes (lower
case and non-ASCII letters, upper case, digits, blanks and every ASCII mark by itself) and eighths of three repetition
rates; a document's vector is the square root of its weighted term shares. A truncated singular value decomposition of
at most ``sample`` labelled documents gives the latent axes; their latent vectors, of fixed size, are broadcast, and every
document's exact cosines with all of them are taken in blocks. The ``neighbours`` nearest, without the document itself,
vote with similarity to the power ``sharpness``; of equally near ones (to a millionth) those of smaller ids.

The bound on labelled rows is the parameter ``sample`` (4,096 by default, chosen by a hash of the id). All documents
are scored, over their whole texts. Labels, language, source and id never enter a score: a document that teaches
leaves its own label out of its vote.

Defined results: null and empty texts are scored like any other (their terms are all zero); labels that are null
or whose document is missing teach nothing; several labels of one id are averaged; of several texts of a labelled id
one teaches, and none of that id is scored by it; without any usable label of another document the score is 0.5;
repeated rows are each scored; columns of the input named like the output's are replaced.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quadra.llm.bytestok import BLANK_SPLIT, blocks, shingles, words
from quadra.llm.documents import fold_of, table
from quadra.llm.store import small_batches

_MARKS = [b for b in range(33, 127) if not chr(b).isalnum()]
_CLASS = np.zeros(256, np.int64)
_CLASS[65:91] = 1
_CLASS[48:58] = 2
_CLASS[32] = 3
_CLASS[10] = 4
_CLASS[_MARKS] = np.arange(5, 5 + len(_MARKS))
_CLASS[[*range(10), *range(11, 32), 127]] = 5 + len(_MARKS)
_K = 6 + len(_MARKS)
#: Buckets of words.
WORDS = 2048
#: Terms: pairs of classes, then eighths of three rates, then words.
_RATES = _K * _K
_WORDS = _RATES + 24
TERMS = _WORDS + WORDS
#: Weights of a repetition rate and of the sum of all word shares against the sum of all pair shares, 1.
_RATE, _WORD = 0.05, 0.2


def terms(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray]]:
    """(from, to, vectors) for runs of whole texts."""
    for i, j, data, offsets in blocks(texts, 1_000_000):
        n = j - i
        # a run holds few enough texts that its dense vectors stay small
        for a in range(0, n, 512):
            b = min(n, a + 512)
            part, cut = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
            yield i + a, i + b, _vectors(part, cut)


def _vectors(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    n = len(offsets) - 1
    out = np.zeros((n, TERMS), np.float32)
    kinds = _CLASS[data]
    if len(kinds) > 1:
        doc = np.repeat(np.arange(n), np.diff(offsets))
        same = doc[1:] == doc[:-1]
        pair = (doc[:-1] * (_K * _K) + kinds[:-1] * _K + kinds[1:])[same]
        counts = np.bincount(pair, minlength=n * _K * _K).reshape(n, _K * _K)
        out[:, : _K * _K] = counts / np.maximum(1, counts.sum(1, keepdims=True))
    got = words(data, offsets, BLANK_SPLIT)
    for k in range(n):
        h = got.of(k)
        m = len(h)
        if not m:
            continue
        again = float((h[1:] == h[:-1]).mean()) if m > 1 else 0.0
        rates = (again, 1 - len(shingles(h, 3)) / max(1, m - 2), 1 - len(np.unique(h)) / m)
        for r, rate in enumerate(rates):
            out[k, _RATES + 8 * r + min(7, int(max(0.0, rate) * 8))] = _RATE
    of = np.repeat(np.arange(n), np.diff(got.first))
    counts = np.bincount(of * WORDS + (got.hashes >> np.uint64(40)).astype(np.int64) % WORDS, minlength=n * WORDS).reshape(n, WORDS)
    out[:, _WORDS:] = counts * (_WORD / np.maximum(1, counts.sum(1, keepdims=True)))
    return np.sqrt(out)


class Space:
    """Latent axes and the labelled vectors in them, in the order of their ids."""

    def __init__(self, vectors: np.ndarray, labels: np.ndarray, dims: int, ids: np.ndarray | None = None) -> None:
        self.mean = vectors.mean(0)
        self.axes = _leading(vectors - self.mean, dims).astype(np.float32)
        self.points = self.project(vectors)
        self.labels = labels.astype(np.float32)
        self.ids = np.arange(len(vectors)) if ids is None else ids

    def project(self, vectors: np.ndarray) -> np.ndarray:
        x = (vectors - self.mean) @ self.axes
        return (x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)).astype(np.float32)

    def score(self, vectors: np.ndarray, neighbours: int, sharpness: float, ids: np.ndarray | None = None, known: np.ndarray | None = None) -> np.ndarray:
        """Scores of documents with these ids (``known``: which ids are not null), each without its own vote."""
        cosines = self.project(vectors) @ self.points.T
        n = len(self.points)
        # whole numbers, so that ties are ties however rows were batched, and their order is that of ids
        near_by = np.rint(cosines * 1e6)
        rank = near_by.astype(np.int64) * n + np.arange(n - 1, -1, -1)
        if ids is not None:
            at = np.minimum(np.searchsorted(self.ids, ids), n - 1)
            own = np.flatnonzero((self.ids[at] == ids) & (True if known is None else known))
            rank[own, at[own]] = -(2**62)
        k = min(neighbours, n)
        near = np.argpartition(-rank, k - 1, axis=1)[:, :k]
        weight = (np.maximum(np.take_along_axis(near_by, near, 1), 0).astype(np.float64) / 1e6) ** sharpness + 1e-9
        weight[np.take_along_axis(rank, near, 1) == -(2**62)] = 0
        total = weight.sum(1)
        return np.where(total > 0, np.clip((weight * self.labels[near]).sum(1) / np.where(total > 0, total, 1), 0, 1), 0.5)


def _leading(x: np.ndarray, dims: int, rounds: int = 12, seed: int = 5) -> np.ndarray:
    """The leading right singular vectors of ``x``, by subspace iteration."""
    dims = min(dims, *x.shape)
    q = np.random.default_rng(seed).standard_normal((x.shape[1], min(2 * dims + 8, *x.shape))).astype(x.dtype)
    for _ in range(rounds):
        q, _ = np.linalg.qr(x.T @ (x @ q))
    _, _, v = np.linalg.svd(x @ q, full_matrices=False)
    return q @ v[:dims].T


def fit(docs: DataFrame, labels: DataFrame, sample: int = 4096, dims: int = 32, text: str = "text", key: str = "doc_id", label: str = "quality") -> Space | None:
    """The space of at most ``sample`` labelled documents outside the held-out fold."""
    known = labels.where(F.col(key).isNotNull() & F.col(label).isNotNull() & (fold_of(key) != 0))
    chosen = known.groupBy(F.col(key).cast("long").alias("_id")).agg(F.avg(F.col(label).cast("double")).alias("_y")).orderBy(F.xxhash64("_id"), "_id").limit(sample)
    # at most ``sample`` rows of two numbers: small enough to broadcast at any size of the corpus
    taught = docs.select(F.col(key).cast("long").alias("_id"), F.col(text).alias("_t")).join(F.broadcast(chosen), "_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, x in terms(batch.column(2)):
                blobs = pa.array([zlib.compress(row.tobytes(), 1) for row in x], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), batch.column(1).slice(i, j - i), blobs], names=["_id", "_y", "x"])

    rows = taught.select("_id", "_y", "_t").mapInArrow(run, "_id long, _y double, x binary").groupBy("_id", "_y").agg(F.min("x").alias("x")).collect()
    if not rows:
        return None
    rows.sort(key=lambda r: r["_id"])
    vectors = np.empty((len(rows), TERMS), np.float32)
    for i, r in enumerate(rows):
        vectors[i] = np.frombuffer(zlib.decompress(r["x"]), np.float32)
    return Space(vectors, np.array([r["_y"] for r in rows]), dims, np.array([r["_id"] for r in rows]))


def score(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, sample: int = 4096, dims: int = 32, neighbours: int = 16, sharpness: float = 8.0, text: str = "text", key: str = "doc_id", keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` of ``docs`` with held_out, score and predicted (1 from ``threshold`` on)."""
    spark = docs.sparkSession
    small_batches(spark)
    made = ("held_out", "score", "predicted")
    keep = [c for c in (docs.columns if keep is None else keep) if c not in made]
    sent = spark.sparkContext.broadcast(fit(docs, labels, sample, dims, text, key))
    k = len(keep)
    out = T.StructType([*(docs.schema[c] for c in keep), T.StructField("held_out", T.BooleanType()), T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        space = sent.value
        for batch in batches:
            for i, j, x in terms(batch.column(k)):
                ids = batch.column(k + 2).slice(i, j - i)
                known = ids.is_valid().to_numpy(zero_copy_only=False)
                s = np.full(j - i, 0.5) if space is None else space.score(x, neighbours, sharpness, ids.fill_null(0).to_numpy(), known)
                kept = [batch.column(c).slice(i, j - i) for c in range(k)]
                yield pa.RecordBatch.from_arrays([*kept, batch.column(k + 1).slice(i, j - i), pa.array(s), pa.array((s >= threshold).astype(np.int32))], names=out.names)

    return docs.select(*[F.col(c) for c in keep], F.col(text).alias("__quadra_text"), (fold_of(key) == 0).alias("__quadra_held"), F.col(key).cast("long").alias("__quadra_id")).mapInArrow(run, out)


def keep_good(docs: DataFrame, labels: DataFrame, **parameters) -> DataFrame:
    """The documents that are not rejected; columns as they came."""
    made = {"held_out": "_in_held_out", "score": "_in_score", "predicted": "_in_predicted"}
    clash = {c: made[c] for c in docs.columns if c in made}
    plain = docs.withColumnsRenamed(clash)
    return score(plain, labels, **parameters).where("predicted = 1").select(plain.columns).withColumnsRenamed({v: c for c, v in clash.items()})


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return score(docs, table(spark, sf_dir, "labels"), keep=["doc_id"])


QUERY = ("op1_quality_classifier", op1_quality_classifier)
#: A trained classifier is not SQL; tests measure held-out accuracy.
ORACLE = None
