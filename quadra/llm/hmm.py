"""Hidden Markov language model of words, trained by Baum-Welch, with exact likelihoods.

A state emits a symbol. Every training word that makes up a share of at least 1 / ``COMMON`` of all training tokens is a
symbol of its own (so there are at most ``COMMON`` of them); all other words are emitted through one of ``CLASSES``
classes, buckets of a hash of a word's last three bytes and whether it is longer than eight, and the class emits the
word: p(word | state) = p(symbol | state) * p(word) / p(symbol), scaled so that all seen words together leave the unseen
word its chance, which is the same in every state. p(word) is the smoothed unigram of all training texts, from exact
counts: (c + 0.5) / (N + 0.5 * (V + 1)), where all unseen words are one word of c = 0. The log likelihood of a text
is then the forward recursion over its symbols plus the sum of log p(word) / p(symbol).

Counting and training take every training text whole. A text longer than ``SPAN`` tokens is worked on in spans, which
changes nothing: every span's product of transition matrices is taken first, and these chain the forward state into
and the backward state out of each span, so expected counts and likelihoods are those of the whole text, and one very
long text needs as many steps as a span. Expected counts are summed per task, then by a tree of bounded fan-in;
only sums of bounded size reach the driver. Rounds end when the likelihood per token grows by less than ``tolerance``.

Texts are tokenised once, into a table of blocks (bounded runs of whole texts): distinct word hashes, their training
counts and word numbers in order. Counts are summed by word with partial sums before the shuffle. Blocks get the
counts of common words from a table of at most ``COMMON`` rows that is sent to the tasks; all other words
are joined back to their blocks, and none of those is in more than N / ``COMMON`` rows.

Words are 64-bit hashes: at 10**9 distinct words about 0.03 pairs are expected to collide, each shifting two counts.

Defined results: a null text is empty; an empty text is one token, the end; documents with a null id have no remainder,
so they are scored, are not held out and train (crc32 of null is null); an empty training set gives N = 0, V = 0 and the uniform
unseen probability; repeated rows count and are scored each; extra columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadra.llm.bytestok import BLANK_SPLIT, blocks, mix, words
from quadra.llm.documents import fold_of, table
from quadra.llm.store import Workspace, small_batches

CLASSES = 1024
COMMON = 65_536
SPAN = 1024
#: Tokens of one forward-backward pass: bounds its memory (a float for each token and state, and some more).
PASS_TOKENS = 400_000
END = 0  # the class of the end token
_END_HASH = np.uint64(0x5851F42D4C957F2D)
FAN_IN = 32


def word_classes(low: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Class of each word, 1..CLASSES-1, from its last three bytes and its length."""
    code = np.zeros(len(starts), np.uint64)
    for back in (1, 2, 3):
        at = ends - back
        code = code * np.uint64(257) + np.where(at >= starts, low[np.maximum(at, 0)].astype(np.uint64) + np.uint64(1), np.uint64(0))
    code = code * np.uint64(2) + ((ends - starts) > 8)
    return (mix(code) % np.uint64(CLASSES - 1) + np.uint64(1)).astype(np.uint16)


BLOCK = "block long, doc_ids binary, held binary, lengths binary, words binary, counts binary, classes binary, docs array<int>, sequences array<binary>"


def _pack(x: np.ndarray) -> bytes:
    raw = np.ascontiguousarray(x).tobytes()
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def _unpack(x: bytes, kind) -> np.ndarray:
    size = int.from_bytes(x[:8], "little")
    return np.frombuffer(pa.decompress(x[8:], decompressed_size=size, codec="zstd") if size else b"", kind)


class _Block:
    """A block in the making: pieces (runs of whole texts) with their own word numbers, which ``row`` makes the block's."""

    def __init__(self) -> None:
        self.bytes = 0
        self.ids, self.held, self.lengths, self.words, self.often, self.counts, self.classes, self.sequences = ([] for _ in range(8))

    def add(self, ids: pa.Array, held: np.ndarray, data: np.ndarray, offsets: np.ndarray) -> None:
        got = words(data, offsets, BLANK_SPLIT)
        lengths = np.diff(got.first) + 1
        total = int(lengths.sum())
        inside = np.ones(total, bool)
        inside[np.cumsum(lengths) - 1] = False
        h, kind = np.full(total, _END_HASH, np.uint64), np.zeros(total, np.uint16)
        h[inside] = got.hashes
        kind[inside] = word_classes(got.data, got.starts, got.ends)
        del got
        distinct, first, number, often = np.unique(h, return_index=True, return_inverse=True, return_counts=True)
        self.bytes += len(data)
        self.ids.append(ids)
        self.held.append(held)
        self.lengths.append(lengths)
        self.words.append(distinct)
        self.often.append(often)
        self.counts.append(np.bincount(number[np.repeat(~held, lengths)], minlength=len(distinct)))
        self.classes.append(kind[first])
        self.sequences.append(number.astype(np.uint32))

    def row(self, number: int) -> pa.RecordBatch:
        distinct, first, of = np.unique(np.concatenate(self.words), return_index=True, return_inverse=True)
        # common words get small numbers, which pack well
        order = np.argsort(-np.bincount(of, weights=np.concatenate(self.often)), kind="stable")
        place = np.empty(len(order), np.uint32)
        place[order] = np.arange(len(order), dtype=np.uint32)
        counts = np.bincount(of, weights=np.concatenate(self.counts)).astype(np.int64)
        of, at, sequences = place[of], 0, []
        for mine, x in zip(self.words, self.sequences, strict=True):
            sequences.append(_pack(of[at : at + len(mine)][x]))
            at += len(mine)
        blob = pa.BufferOutputStream()
        with pa.ipc.new_stream(blob, pa.schema([("doc_id", pa.int64())])) as w:
            w.write_batch(pa.RecordBatch.from_arrays([pa.concat_arrays(self.ids)], names=["doc_id"]))
        held, lengths = np.concatenate(self.held), np.concatenate(self.lengths)
        row = [number, blob.getvalue().to_pybytes(), held.astype(np.uint8).tobytes(), lengths.astype(np.int64).tobytes(), distinct[order].tobytes(), _pack(counts[order]), _pack(np.concatenate(self.classes)[first][order]), [len(x) for x in self.ids], sequences]
        kinds = [pa.int64(), *[pa.binary()] * 6, pa.list_(pa.int32()), pa.list_(pa.binary())]
        return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds, strict=True)], names=[x.split()[0] for x in BLOCK.split(", ")])


def tokenise(docs: DataFrame, folds: int = 5, fold: int = 1, block_bytes: int = 16_000_000, piece_bytes: int = 3_000_000, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Blocks of whole texts: ids, fold, token counts (with the end), distinct words, training counts, and by pieces of
    about ``piece_bytes`` the number of texts and the word numbers. The larger a block, the fewer words are repeated."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 40
        block = _Block()
        for batch in _gathered(batches, piece_bytes):
            for i, j, data, offsets in blocks(batch.column(2), piece_bytes):
                if block.bytes and block.bytes + len(data) > block_bytes:
                    yield block.row(number)
                    number, block = number + 1, _Block()
                held = batch.column(1).slice(i, j - i).fill_null(False).to_numpy(zero_copy_only=False)
                block.add(batch.column(0).slice(i, j - i), held, data, offsets)
        if block.ids:
            yield block.row(number)

    return docs.select(F.col(key).cast("long"), (fold_of(key, folds) == fold).alias("held"), F.col(text)).mapInArrow(run, BLOCK)


def _gathered(batches: Iterator[pa.RecordBatch], most_bytes: int) -> Iterator[pa.RecordBatch]:
    """Batches put together up to ``most_bytes``."""
    held, size = [], 0
    for batch in batches:
        if held and size + batch.nbytes > most_bytes:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, size = [], 0
        if batch.num_rows:
            held.append(batch)
            size += batch.nbytes
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def word_counts(table_: DataFrame, parts: int) -> DataFrame:
    """(word, class, c) of all training words, in ``parts`` partitions by word. A block has a word once, so the most
    common word is as many rows as there are blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for w, c, k in zip(*(batch.column(x).to_pylist() for x in range(3)), strict=True):
                w, c, k = np.frombuffer(w, np.int64), _unpack(c, np.int64), _unpack(k, np.uint16)
                some = c > 0
                w, c, k = w[some], c[some], k[some].astype(np.int32)
                for a in range(0, len(w), 100_000):
                    yield pa.RecordBatch.from_arrays([pa.array(x[a : a + 100_000]) for x in (w, k, c)], names=["word", "class", "n"])

    seen = table_.select("words", "counts", "classes").mapInArrow(run, "word long, class int, n long")
    return seen.repartition(parts, "word").groupBy("word").agg(F.max("class").alias("class"), F.sum("n").alias("c"))


@dataclass
class Lexicon:
    """Common words (sorted hashes, signed) with their counts; a word's symbol is its class or, if common, CLASSES + place."""

    words: np.ndarray
    counts: np.ndarray

    def find(self, words_: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(whether common, place) of each word."""
        if not len(self.words):
            return np.zeros(len(words_), bool), np.zeros(len(words_), np.int64)
        at = np.minimum(np.searchsorted(self.words, words_), len(self.words) - 1)
        return self.words[at] == words_, at

    def symbols(self, words_: np.ndarray, classes: np.ndarray) -> np.ndarray:
        common, at = self.find(words_)
        return np.where(common, CLASSES + at, classes)

    @property
    def size(self) -> int:
        return CLASSES + len(self.words)


def rare_words(table_: DataFrame, lexicon) -> DataFrame:
    """(block, at, word): the distinct words of each block that are not common."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, w in zip(*(batch.column(x).to_pylist() for x in range(2)), strict=True):
                w = np.frombuffer(w, np.int64)
                at = np.flatnonzero(~lexicon.value.find(w)[0]).astype(np.int32)
                for a in range(0, len(at), 100_000):
                    part = at[a : a + 100_000]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), block)), pa.array(part), pa.array(w[part])], names=["block", "at", "word"])

    return table_.select("block", "words").mapInArrow(run, "block long, at int, word long")


class Model:
    """Start, transition and symbol emission probabilities."""

    def __init__(self, start: np.ndarray, move: np.ndarray, emit: np.ndarray) -> None:
        self.start, self.move, self.emit = start, move, emit

    @classmethod
    def random(cls, states: int, share: np.ndarray, seed: int = 11) -> Model:
        rng = np.random.default_rng(seed)
        emit = share * rng.uniform(0.5, 1.5, (states, len(share)))
        move = np.full((states, states), 0.1 / max(1, states - 1))
        np.fill_diagonal(move, 0.9)
        return cls(np.full(states, 1 / states), move / move.sum(1, keepdims=True), emit / emit.sum(1, keepdims=True))

    @classmethod
    def of_counts(cls, first: np.ndarray, pairs: np.ndarray, emissions: np.ndarray, share: np.ndarray) -> Model:
        """Maximisation, with a little of the overall shares added so that no symbol is impossible."""
        start = first + 0.1
        move = pairs + 0.1
        emit = emissions + 5.0 * share
        return cls(start / start.sum(), move / move.sum(1, keepdims=True), emit / emit.sum(1, keepdims=True))


@dataclass
class Spans:
    """Texts cut in spans of at most ``SPAN`` tokens: first token, size, text, and number within the text."""

    at: np.ndarray
    size: np.ndarray
    text: np.ndarray
    nth: np.ndarray

    @classmethod
    def of(cls, lengths: np.ndarray) -> Spans:
        pieces = -(-lengths // SPAN)
        text = np.repeat(np.arange(len(lengths)), pieces)
        nth = np.arange(len(text)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        firsts = np.cumsum(lengths) - lengths
        return cls(firsts[text] + nth * SPAN, np.minimum(lengths[text] - nth * SPAN, SPAN), text, nth)


def _passes(size: np.ndarray) -> Iterator[np.ndarray]:
    """Spans in passes of at most ``PASS_TOKENS`` tokens (or one span), each longest first."""
    if not len(size):
        return
    order = np.argsort(-size, kind="stable")
    number = (np.cumsum(size[order]) - 1) // PASS_TOKENS
    yield from np.split(order, np.flatnonzero(np.diff(number)) + 1)


def _alive(size: np.ndarray) -> np.ndarray:
    """Of spans in falling order of size: how many are longer than 0, 1, 2, ..."""
    return np.searchsorted(-size, -np.arange(int(size[0])), side="left")


def _products(model: Model, symbols: np.ndarray, at: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per span the product of its steps (span, to, from), scaled, and the logarithm of its scale."""
    k = len(model.start)
    mats, logs = np.zeros((len(at), k, k), np.float32), np.zeros(len(at))
    turn, emit = np.ascontiguousarray(model.move.T, np.float32), model.emit.astype(np.float32)
    for part in _passes(size * k):
        x = np.zeros((k, k, len(part)), np.float32)  # (to, from, span)
        lg = np.zeros(len(part))
        for t, m in enumerate(_alive(size[part])):
            e = emit[:, symbols[at[part[:m]] + t]]
            y = turn[:, :, None] * e[:, None, :] if t == 0 else (turn @ x[:, :, :m].reshape(k, k * m)).reshape(k, k, m) * e[:, None, :]
            c = np.maximum(y.max((0, 1)), 1e-30)
            x[:, :, :m] = y / c
            lg[:m] += np.log(c)
        mats[part], logs[part] = x.transpose(2, 0, 1), lg
    return mats, logs


def _firsts(model: Model, symbols: np.ndarray, at: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """State after each text's first span (state, text), and the log likelihood of that span."""
    k = len(model.start)
    after, logs = np.zeros((k, len(at))), np.zeros(len(at))
    turn = np.ascontiguousarray(model.move.T)
    for part in _passes(size):
        state = np.zeros((k, len(part)))
        lg = np.zeros(len(part))
        for t, m in enumerate(_alive(size[part])):
            a = (model.start[:, None] if t == 0 else turn @ state[:, :m]) * model.emit[:, symbols[at[part[:m]] + t]]
            c = np.maximum(a.sum(0), 1e-300)
            state[:, :m] = a / c
            lg[:m] += np.log(c)
        after[:, part], logs[part] = state, lg
    return after, logs


def _chained(model: Model, symbols: np.ndarray, spans: Spans, n: int, backward: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(entering, leaving, log likelihoods): the forward state before every span but first ones, the backward
    state (at any scale) after every span but last ones, both (state, span), and each text's log likelihood."""
    k = len(model.start)
    first = np.flatnonzero(spans.nth == 0)
    vector, out = _firsts(model, symbols, spans.at[first], spans.size[first])
    enter, leave = np.zeros((k, len(spans.at))), np.ones((k, len(spans.at)))
    later = np.flatnonzero(spans.nth > 0)
    if not len(later):
        return enter, leave, out
    place = np.zeros(len(spans.at), np.int64)
    place[later] = np.arange(len(later))
    mats, logs = _products(model, symbols, spans.at[later], spans.size[later])
    last = np.zeros(n, np.int64)
    np.maximum.at(last, spans.text, spans.nth)
    texts = np.flatnonzero(last > 0)
    # one step along all texts at once
    rank, todo = 1, texts
    while len(todo):
        s = first[todo] + rank
        enter[:, s] = vector[:, todo]
        v = np.einsum("dij,jd->id", mats[place[s]].astype(np.float64), vector[:, todo])
        c = np.maximum(v.sum(0), 1e-300)
        vector[:, todo] = v / c
        out[todo] += np.log(c) + logs[place[s]]
        rank += 1
        todo = todo[last[todo] >= rank]
    if backward:
        for rank in range(int(last.max()), 0, -1):
            s = first[texts[last[texts] >= rank]] + rank
            v = np.einsum("dij,id->jd", mats[place[s]].astype(np.float64), leave[:, s])
            leave[:, s - 1] = v / np.maximum(v.max(0), 1e-300)
    return enter, leave, out


def log_likelihoods(model: Model, symbols: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Exact natural log likelihood of each text's symbols (texts one after the other in ``symbols``)."""
    if not len(lengths):
        return np.zeros(0)
    return _chained(model, symbols, Spans.of(lengths), len(lengths), False)[2]


def expected_counts(model: Model, symbols: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Expected counts over whole texts: starts, transitions, emissions; and the log likelihood of all."""
    k, width = model.emit.shape
    first, pairs, emissions = np.zeros(k), np.zeros((k, k)), np.zeros((k, width))
    if not len(lengths):
        return first, pairs, emissions, 0.0
    spans = Spans.of(lengths)
    enter, leave, likelihood = _chained(model, symbols, spans, len(lengths), True)
    turn, forward, emit = np.ascontiguousarray(model.move.T, np.float32), model.move.astype(np.float32), model.emit.astype(np.float32)
    start = model.start.astype(np.float32)[:, None]
    for part in _passes(spans.size):
        at, size, opens = spans.at[part], spans.size[part], spans.nth[part] == 0
        entering = enter[:, part].astype(np.float32)
        alive = _alive(size)
        base = np.concatenate([[0], np.cumsum(alive)])
        # alpha of time t lies at base[t]; gamma takes its place on the way back
        alpha, scale, seen = np.empty((k, base[-1]), np.float32), np.empty(base[-1], np.float32), np.empty(base[-1], np.int64)
        for t, m in enumerate(alive):
            here = slice(base[t], base[t] + m)
            seen[here] = symbols[at[:m] + t]
            a = (np.where(opens, start, turn @ entering) if t == 0 else turn @ alpha[:, base[t - 1] : base[t - 1] + m]) * emit[:, seen[here]]
            c = np.maximum(a.sum(0), 1e-30)
            alpha[:, here], scale[here] = a / c, c
        beta = leave[:, part].astype(np.float32)
        for t in range(len(alive) - 1, -1, -1):
            m = alive[t]
            # spans that end here: their backward state is scaled to their forward state
            new = alive[t + 1] if t + 1 < len(alive) else 0
            here = slice(base[t], base[t] + m)
            ends = slice(base[t] + new, base[t] + m)
            beta[:, new:m] /= np.maximum((alpha[:, ends] * beta[:, new:m]).sum(0), 1e-30)
            eb = emit[:, seen[here]] * beta[:, :m] / scale[here]
            alpha[:, here] *= beta[:, :m]
            if t:
                pairs += (alpha[:, base[t - 1] : base[t - 1] + m] @ eb.T) * model.move
                beta[:, :m] = forward @ eb
            else:
                first += alpha[:, :m][:, opens].sum(1)
                pairs += (entering[:, ~opens] @ eb[:, ~opens].T) * model.move
        for s in range(k):
            emissions[s] += np.bincount(seen, weights=alpha[s], minlength=width)
    return first, pairs, emissions, float(likelihood.sum())


def tree_sum(parts: DataFrame, space: Workspace) -> np.ndarray | None:
    """Sum of float64 vectors in rows (g, x): groups of FAN_IN rows are added until few rows remain."""

    def add(t: pa.Table) -> pa.Table:
        total = 0
        for x in t.column("x"):
            total = total + np.frombuffer(x.as_py(), np.float64)
        return pa.table({"g": pa.array([t.column("g")[0].as_py()]), "x": pa.array([total.tobytes()], pa.binary())})

    parts = space.keep(parts, "sums")
    n = parts.count()
    while n > FAN_IN:
        m = -(-n // FAN_IN)
        nxt = space.keep(parts.withColumn("g", F.pmod(F.xxhash64("g", F.lit(n)), F.lit(m))).groupBy("g").applyInArrow(add, "g long, x binary"), "sums")
        space.drop(parts)
        parts = nxt
        n = m
    total = None
    # one order of adding, so reruns agree to the last bit; one row is here at a time
    for r in parts.orderBy("g").toLocalIterator():
        x = np.frombuffer(r["x"], np.float64)
        total = x if total is None else total + x
    space.drop(parts)
    return total


def _pieces(row: dict) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(word number of each token, token counts, held) of each piece of a block."""
    lengths, held = np.frombuffer(row["lengths"], np.int64), np.frombuffer(row["held"], np.uint8).astype(bool)
    at = 0
    for n, x in zip(row["docs"], row["sequences"], strict=True):
        yield _unpack(x, np.uint32), lengths[at : at + n], held[at : at + n]
        at += n


def _symbols(row: dict, lexicon: Lexicon) -> np.ndarray:
    """Symbol of each distinct word of a block."""
    return lexicon.symbols(np.frombuffer(row["words"], np.int64), _unpack(row["classes"], np.uint16).astype(np.int64))


def train(blocks_: DataFrame, model: Model, share: np.ndarray, lexicon, rounds: int, tolerance: float, space: Workspace) -> Model:
    """Baum-Welch over the training texts of all blocks, until likelihood per token grows by less than ``tolerance``."""
    spark = blocks_.sparkSession
    k, width = model.emit.shape
    before = -math.inf
    for _ in range(rounds):
        sent = spark.sparkContext.broadcast(model)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            from pyspark import TaskContext

            total = np.zeros(k + k * k + k * width + 2)
            for batch in batches:
                for i in range(batch.num_rows):
                    row = batch.slice(i, 1).to_pylist()[0]
                    symbols = _symbols(row, lexicon.value)
                    for sequence, lengths, held in _pieces(row):
                        taught = symbols[sequence[np.repeat(~held, lengths)]]
                        first, pairs, emissions, ll = expected_counts(sent.value, taught, lengths[~held])
                        total += np.concatenate([first, pairs.ravel(), emissions.ravel(), [ll, len(taught)]])
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([total.tobytes()], pa.binary())], names=["g", "x"])

        total = tree_sum(blocks_.select("held", "lengths", "words", "classes", "docs", "sequences").mapInArrow(run, "g long, x binary"), space)
        sent.unpersist()
        if total is None or not total[:k].sum():
            return model
        model = Model.of_counts(total[:k], total[k : k + k * k].reshape(k, k), total[k + k * k : -2].reshape(k, width), share)
        now = total[-2] / total[-1]
        if now - before < tolerance:
            break
        before = now
    return model


SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def score(docs: DataFrame, states: int = 6, rounds: int = 4, tolerance: float = 1e-3, folds: int = 5, fold: int = 1, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Train on the documents outside ``fold`` and score all: see ``SCORES``; scores are log10."""
    spark = docs.sparkSession
    small_batches(spark)
    space = Workspace(spark, "hmm")
    table_ = space.keep(tokenise(docs, folds, fold, text=text, key=key), "blocks")
    # as many parts as blocks, however many there are, up to a bound: parts stay small as the corpus grows
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(20_000, table_.count()))
    counts = space.keep(word_counts(table_, parts), "counts")
    # N and V by class: at most CLASSES rows; then the words with at least N / COMMON tokens, at most COMMON rows
    per = counts.groupBy("class").agg(F.sum("c").alias("c"), F.count(F.lit(1)).alias("v")).collect()
    n_train, v_train = sum(r["c"] for r in per), sum(r["v"] for r in per)
    common = counts.where(F.col("c") * F.lit(COMMON) >= F.lit(n_train)).select("word", "c", "class").toArrow().sort_by("word")
    word, c, of = (common.column(x).to_numpy() for x in ("word", "c", "class"))
    lexicon = Lexicon(word, c)
    mass = np.zeros(lexicon.size)
    for r in per:
        mass[r["class"]] = r["c"] + 0.5 * r["v"]
    np.subtract.at(mass, of, c + 0.5)
    mass[CLASSES:] = c + 0.5
    below = n_train + 0.5 * (v_train + 1)
    unseen = 0.5 / below
    share = mass / mass.sum() if n_train else np.full(lexicon.size, 1 / lexicon.size)
    terms = spark.sparkContext.broadcast(lexicon)
    model = train(table_, Model.random(states, share), share, terms, rounds, tolerance, space)
    # a seen word is emitted by its symbol, all of them with chance 1 - unseen; an unseen one by any state alike
    unknown = lexicon.size
    emit = np.hstack([model.emit, np.ones((states, 1))])
    with np.errstate(divide="ignore", invalid="ignore"):
        log_share = np.append(np.log10(mass / below) - np.log10(1 - unseen), 0.0)
    sent = spark.sparkContext.broadcast((Model(model.start, model.move, emit), log_share, n_train, math.log10(below)))
    rare = counts.where(F.col("c") * F.lit(COMMON) < F.lit(n_train)).select("word", "c").repartition(parts, "word")
    back = rare_words(table_, terms).repartition(parts, "word").join(rare.hint("merge"), "word").select("block", "at", "c")

    def run(key_: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        model, log_share, n_train, log_below = sent.value
        ids, held, known, tokens, base, full = [], [], [], [], [], []
        for row in left.to_pylist():
            symbols = _symbols(row, terms.value)
            is_common, at = terms.value.find(np.frombuffer(row["words"], np.int64))
            c = np.zeros(len(symbols))
            c[is_common] = terms.value.counts[at[is_common]]
            c[right.column("at").to_numpy()] = right.column("c").to_numpy()
            log_word = np.log10(c + 0.5) - log_below
            symbols = np.where(c > 0, symbols, unknown)
            for sequence, size, fold_ in _pieces(row):
                first = np.cumsum(size) - size
                base.append(np.add.reduceat(log_word[sequence], first))
                known.append(np.add.reduceat((c > 0)[sequence].astype(np.int64), first))
                within = np.add.reduceat((log_word - log_share[symbols])[sequence], first)
                full.append(within + log_likelihoods(model, symbols[sequence], size) / math.log(10))
                held.append(fold_)
                tokens.append(size)
            ids.append(pa.ipc.open_stream(row["doc_ids"]).read_all().column(0).combine_chunks())
        if not ids:
            return pa.table({f.split()[0]: pa.array([], t) for f, t in zip(SCORES.split(", "), [pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64()], strict=True)})
        size = np.concatenate(tokens)
        return pa.table({"doc_id": pa.concat_arrays(ids), "held_out": np.concatenate(held), "n_tokens": size, "n_known": np.concatenate(known), "train_tokens": np.full(len(size), n_train), "base_score": np.concatenate(base), "score": np.concatenate(full)})

    left = table_.select("block", "doc_ids", "held", "lengths", "words", "classes", "docs", "sequences").repartition(parts, "block").groupBy("block")
    return left.cogroup(back.repartition(parts, "block").groupBy("block")).applyInArrow(run, SCORES)


def op5_hmm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"))


QUERY = ("op5_hmm", op5_hmm)
#: Training is not SQL; tests hold counts, expected counts and every score against brute force.
ORACLE = None
