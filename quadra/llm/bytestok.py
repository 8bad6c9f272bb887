"""Vectorised tokenising over the UTF-8 bytes of an Arrow column of texts.

Both token classes the operators use are unions of whole non-ASCII code points and single ASCII
bytes, so splitting bytes equals splitting code points. Words are identified by 64-bit hashes of
their lower-cased bytes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

#: Words `[^\x20\x09-\x0D]+`.
BLANK_SPLIT = np.ones(256, bool)
BLANK_SPLIT[[32, *range(9, 14)]] = False
#: Words `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` of lower-cased text.
ALNUM = np.zeros(256, bool)
ALNUM[48:58] = ALNUM[97:123] = ALNUM[128:] = True

_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
#: Bytes that one step of hashing works on, so temporaries stay small beside any text.
_STEP = 1 << 18
_tables: list[np.ndarray] = []


def _powers() -> list[np.ndarray]:
    """Powers of the base and of its inverse, for the places of one step; made once a process."""
    if not _tables:
        with np.errstate(over="ignore"):
            for base in (_BASE, pow(_BASE, -1, 2**64)):
                factors = np.full(_STEP, np.uint64(base))
                factors[0] = 1
                _tables.append(np.cumprod(factors))
    return _tables


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (bijective), so that every bit of the input moves every bit of the output."""
    with np.errstate(over="ignore"):
        h = h ^ (h >> np.uint64(33))
        h = h * np.uint64(0xFF51AFD7ED558CCD)
        h ^= h >> np.uint64(33)
        h *= np.uint64(0xC4CEB9FE1A85EC53)
        h ^= h >> np.uint64(33)
    return h


@dataclass
class Words:
    """Words of a run of texts: hash, byte span in ``data`` and the first word of each text (n + 1)."""

    data: np.ndarray
    hashes: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray

    def of(self, i: int) -> np.ndarray:
        return self.hashes[self.first[i] : self.first[i + 1]]


def utf8(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (n + 1) of a string column; a null text is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_binary())
    if texts.null_count:
        texts = texts.fill_null(b"")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def words(data: np.ndarray, offsets: np.ndarray, keep: np.ndarray) -> Words:
    """Split texts into words of the bytes in ``keep``, after lower-casing A-Z.

    A word's hash is a polynomial of its bytes: a difference of running sums, shifted back by its place. Sums run in
    steps of ``_STEP`` bytes and are carried from step to step, so beside the words themselves a text of any length
    takes two bytes a byte.
    """
    low = _LOWER[data]
    n = len(low)
    kind = np.int32 if n < 2**31 - 1 else np.int64
    if not n:
        none = np.zeros(0, kind)
        return Words(low, none.astype(np.uint64), none, none, np.zeros(len(offsets), np.int64))
    inside = np.zeros(n + 2, bool)  # bounded by a place outside on either side
    inside[1:-1] = keep[low]
    edges = offsets[1:-1][(offsets[1:-1] > 0) & (offsets[1:-1] < n)]
    power, back = _powers()
    starts, ends, sum_at_start, sum_at_end = [], [], [], []
    carry, shift = np.uint64(0), np.uint64(1)
    with np.errstate(over="ignore"):
        turn = np.uint64(pow(_BASE, _STEP, 2**64))
        for a in range(0, n, _STEP):
            b = min(n, a + _STEP)
            mine, before, after = inside[a + 1 : b + 1], inside[a:b], inside[a + 2 : b + 2]
            begin, finish = mine & ~before, mine & ~after
            # a word ends where its text ends
            cut = edges[np.searchsorted(edges, a) : np.searchsorted(edges, b)] - a
            begin[cut] = mine[cut]
            cut = edges[np.searchsorted(edges, a, side="right") : np.searchsorted(edges, b, side="right")] - 1 - a
            finish[cut] = mine[cut]
            sums = np.empty(b - a + 1, np.uint64)
            sums[0] = carry
            np.cumsum(_BYTE[low[a:b]] * power[: b - a] * shift, out=sums[1:])
            sums[1:] += carry
            at, to = np.flatnonzero(begin), np.flatnonzero(finish) + 1
            starts.append((at + a).astype(kind))
            ends.append((to + a).astype(kind))
            sum_at_start.append(sums[at])
            sum_at_end.append(sums[to])
            carry, shift = sums[-1], shift * turn
        starts, ends = np.concatenate(starts), np.concatenate(ends)
        hashes = np.concatenate(sum_at_end) - np.concatenate(sum_at_start)
        # powers of whole steps back, then of the place in the step
        step = starts // _STEP
        whole = np.full(int(step.max(initial=0)) + 1, np.uint64(pow(_BASE, -_STEP, 2**64)))
        whole[0] = 1
        hashes *= back[starts - step * _STEP] * np.cumprod(whole)[step]
        hashes = mix(hashes + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    return Words(low, hashes, starts, ends, np.searchsorted(starts, offsets))


def blocks(texts: pa.Array, most_bytes: int = 2_000_000) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Cut a column into runs of whole texts of at most ``most_bytes`` (or one text): (from, to, bytes, offsets)."""
    data, offsets = utf8(texts)
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most_bytes, side="right")) - 1)
        yield i, j, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


def shingles(hashes: np.ndarray, n: int) -> np.ndarray:
    """Sorted distinct hashes of runs of ``n`` words of one text; of fewer words, the whole sequence is one."""
    m = len(hashes)
    if not m:
        return hashes
    with np.errstate(over="ignore"):
        width = min(n, m)
        out = np.full(m - width + 1, np.uint64(0xA0761D6478BD642F + width), np.uint64)
        for k in range(width):
            out = (out ^ hashes[k : m - width + 1 + k]) * np.uint64(0xE7037ED1A0B428DB)
            out ^= out >> np.uint64(29)
    return np.unique(mix(out))
