"""Vectorised words, word hashes and shingles of Arrow text columns.

Words are the maximal runs of bytes outside {0x20, 0x09-0x0D}; A-Z are lower-cased. As no byte of a multi-byte UTF-8
character is below 0x80, working on bytes is the same as working on characters. A word's hash is a keyed polynomial over
Z/2^64 with a 64-bit finaliser; 64 bits stand for the word wherever sets or counts are kept.
"""

from __future__ import annotations

import ctypes
import sys
import zlib

import numpy as np
import pyarrow as pa

U64 = np.uint64
_rng = np.random.default_rng(20240607)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * U64(2) + U64(1)
_P = U64(0x9E3779B97F4A7C15)
_PINV = U64(pow(0x9E3779B97F4A7C15, -1, 2**64))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, dtype=bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
_powers: list[np.ndarray] = [np.ones(1, U64), np.ones(1, U64)]
STEP = 1 << 19


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> U64(33))
    x *= U64(0xFF51AFD7ED558CCD)
    x ^= x >> U64(33)
    x *= U64(0xC4CEB9FE1A85EC53)
    x ^= x >> U64(33)
    return x


def _pow(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        m = 1 << (n - 1).bit_length()
        for k, base in enumerate((_P, _PINV)):
            p = np.full(m, base, U64)
            p[0] = 1
            _powers[k] = np.multiply.accumulate(p)
    return _powers[0], _powers[1]


def column(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (length n + 1) of a string or binary column; nulls are empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = col.fill_null(b"" if pa.types.is_binary(col.type) or pa.types.is_large_binary(col.type) else "")
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    _, offs, data = col.buffers()
    if len(col) == 0 or data is None:
        return np.zeros(0, np.uint8), np.zeros(len(col) + 1, np.int64)
    at = np.frombuffer(offs, np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


def spans(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and for each document the index of its first word (length n + 1)."""
    word = ~SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[at] = True
    before = np.empty_like(word)
    before[:1] = False
    before[1:] = word[:-1]
    starts = np.flatnonzero(word & (~before | edge[:-1]))
    after = np.empty_like(word)
    after[-1:] = False
    after[:-1] = word[1:]
    ends = np.flatnonzero(word & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, at)


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = True) -> np.ndarray:
    """A 64-bit hash of each span; spans are in order. Memory stays bounded: about STEP bytes at a time."""
    out = np.empty(len(starts), U64)
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(starts, starts[i] + STEP)))
        lo, hi = int(starts[i]), int(ends[i:j].max())
        part = data[lo:hi]
        p, q = _pow(hi - lo + 1)
        total = np.empty(hi - lo + 1, U64)
        total[0] = 0
        np.cumsum(_BYTE[LOWER[part] if lower else part] * p[: hi - lo], out=total[1:])
        a, b = starts[i:j] - lo, ends[i:j] - lo
        out[i:j] = mix((total[b] - total[a]) * q[a] + (b - a).astype(U64))
        i = j
    return out


def words(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of a text column, and each document's first word (length n + 1)."""
    data, at = column(col)
    starts, ends, first = spans(data, at)
    return hash_spans(data, starts, ends), first


def pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mix(a * U64(0xD6E8FEB86659FD93) + mix(b + U64(0xA0761D6478BD642F)))


def shingles(h: np.ndarray, k: int) -> np.ndarray:
    """The sorted distinct hashes of one text's k-word shingles; fewer words: the whole sequence; none: empty."""
    if len(h) == 0:
        return h
    n = max(1, len(h) - k + 1)
    out = h[:n]
    for i in range(1, min(k, len(h))):
        out = pair(out, h[i : i + n])
    if len(h) < k:
        out = mix(out + U64(len(h)))
    return np.unique(out)


def slices(batch: pa.RecordBatch, text: str, limit: int = 1 << 21):
    """Parts of a batch, in order, each with about limit bytes of text or a single row."""
    col = batch.column(batch.schema.get_field_index(text))
    _, at = column(col)
    i = 0
    while i < len(col):
        j = max(i + 1, int(np.searchsorted(at, at[i] + limit, "right")) - 1)
        yield batch.slice(i, j - i)
        i = j


def crc(ids: list) -> np.ndarray:
    """crc32 of each id's decimal text; null counts as an empty text."""
    return np.array([zlib.crc32(b"" if x is None else str(x).encode()) for x in ids], np.int64)


def trim() -> None:
    """Gives freed memory back to the system. Workers are kept between tasks, and would hold their peak meanwhile."""
    pa.default_memory_pool().release_unused()
    give = getattr(ctypes.CDLL(None), "malloc_trim", None) if sys.platform == "linux" else None
    if give:
        give(0)


def binaries(data: np.ndarray, at: np.ndarray) -> pa.Array:
    """A binary column from bytes and offsets."""
    return pa.Array.from_buffers(pa.binary(), len(at) - 1, [None, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))])
