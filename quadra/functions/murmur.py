"""Partition tokens: Murmur3 x64 128, first half, with the sign extension of tail bytes that the ring uses."""

from __future__ import annotations

import struct

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

_M = 2**64 - 1
_C1, _C2 = 0x87C37B91114253D5, 0x4CF5AD432745937F


def _rot(x: int, r: int) -> int:
    return ((x << r) | (x >> (64 - r))) & _M


def _fmix(k: int) -> int:
    k ^= k >> 33
    k = k * 0xFF51AFD7ED558CCD & _M
    k ^= k >> 33
    k = k * 0xC4CEB9FE1A85EC53 & _M
    return k ^ (k >> 33)


def token(data: bytes) -> int:
    """The token of a serialised partition key, a signed 64-bit number; the least one maps to the greatest."""
    n = len(data)
    h1 = h2 = 0
    for i in range(0, n - n % 16, 16):
        k1, k2 = struct.unpack_from("<QQ", data, i)
        h1 ^= _rot(k1 * _C1 & _M, 31) * _C2 & _M
        h1 = (_rot(h1, 27) + h2) * 5 + 0x52DCE729 & _M
        h2 ^= _rot(k2 * _C2 & _M, 33) * _C1 & _M
        h2 = (_rot(h2, 31) + h1) * 5 + 0x38495AB5 & _M
    tail = [b - 256 if b > 127 else b for b in data[n - n % 16 :]]
    k1 = k2 = 0
    for i, b in enumerate(tail[8:]):
        k2 ^= (b << (8 * i)) & _M
    for i, b in enumerate(tail[:8]):
        k1 ^= (b << (8 * i)) & _M
    if len(tail) > 8:
        h2 ^= _rot(k2 * _C2 & _M, 33) * _C1 & _M
    if tail:
        h1 ^= _rot(k1 * _C1 & _M, 31) * _C2 & _M
    h1 ^= n
    h2 ^= n
    h1 = h1 + h2 & _M
    h2 = h2 + h1 & _M
    h1, h2 = _fmix(h1), _fmix(h2)
    h1 = h1 + h2 & _M
    out = h1 - 2**64 if h1 >= 2**63 else h1
    return 2**63 - 1 if out == -(2**63) else out


def _rotated(x: np.ndarray, r: int) -> np.ndarray:
    return (x << np.uint64(r)) | (x >> np.uint64(64 - r))


def _mixed(k: np.ndarray) -> np.ndarray:
    for c in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53):
        k = (k ^ (k >> np.uint64(33))) * np.uint64(c)
    return k ^ (k >> np.uint64(33))


def tokens(keys: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Tokens of many keys at once: rows of bytes, filled with zeros to a multiple of 16, and their lengths."""
    c1, c2, m = np.uint64(_C1), np.uint64(_C2), len(keys)
    h1 = h2 = np.zeros(m, np.uint64)
    one = lambda k: _rotated(k * c1, 31) * c2
    two = lambda k: _rotated(k * c2, 33) * c1
    whole = lengths // 16
    halves = np.ascontiguousarray(keys).view("<u8")
    for b in range(int(whole.max(initial=0))):
        on = whole > b
        x = (_rotated(h1 ^ one(halves[:, 2 * b]), 27) + h2) * np.uint64(5) + np.uint64(0x52DCE729)
        y = (_rotated(h2 ^ two(halves[:, 2 * b + 1]), 31) + x) * np.uint64(5) + np.uint64(0x38495AB5)
        h1, h2 = np.where(on, x, h1), np.where(on, y, h2)
    # tail bytes are signed
    left = lengths % 16
    k1 = k2 = np.zeros(m, np.uint64)
    signed = keys.view(np.int8)
    for i in range(15):
        at = np.minimum(whole * 16 + i, keys.shape[1] - 1)
        b = np.where(left > i, signed[np.arange(m), at], 0).astype(np.int64).view(np.uint64) << np.uint64(8 * (i % 8))
        k1, k2 = (k1 ^ b, k2) if i < 8 else (k1, k2 ^ b)
    h2 = np.where(left > 8, h2 ^ two(k2), h2)
    h1 = np.where(left > 0, h1 ^ one(k1), h1)
    n = lengths.astype(np.uint64)
    h1, h2 = h1 ^ n, h2 ^ n
    h1 = h1 + h2
    h1, h2 = _mixed(h1), _mixed(h2 + h1)
    out = (h1 + h2).view(np.int64)
    return np.where(out == -(2**63), 2**63 - 1, out)


@F.pandas_udf(T.LongType())
def bigint_token(keys: pd.Series) -> pd.Series:
    """Tokens of one bigint partition key."""
    known = keys.notna().to_numpy()
    rows = np.zeros((len(keys), 16), np.uint8)
    rows[:, :8] = keys.fillna(0).to_numpy(np.int64).astype(">i8").view(np.uint8).reshape(-1, 8)
    return pd.Series(pd.array(tokens(rows, np.full(len(keys), 8)), "Int64"), index=keys.index).where(known)


#: Longer keys are hashed one by one, so that one of them widens no batch.
_WIDE = 256


@F.pandas_udf(T.LongType())
def text_token(keys: pd.Series) -> pd.Series:
    """Tokens of one text partition key."""
    raw = [b"" if k is None else k.encode() for k in keys]
    lengths = np.array([len(k) for k in raw], np.int64)
    short = lengths <= _WIDE
    width = max(16, -(-int(lengths[short].max(initial=0)) // 16) * 16)
    rows = np.zeros((len(raw), width), np.uint8)
    for i, k in enumerate(raw):
        if short[i]:
            rows[i, : len(k)] = np.frombuffer(k, np.uint8)
    out = tokens(rows, np.where(short, lengths, 0))
    for i in np.flatnonzero(~short):
        out[i] = token(raw[i])
    return pd.Series(pd.array(out, "Int64"), index=keys.index).where(keys.notna().to_numpy())
