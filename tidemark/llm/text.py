"""Vectorised word and shingle hashing over the UTF-8 bytes of an Arrow string column.

Words are the runs of bytes outside ``\\x20 \\x09-\\x0D``; A-Z count as a-z. All separators are ASCII, so byte
runs and code-point runs are the same words. Hashes are 64 bits wide.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
CHUNK_BYTES = 1_000_000
_P = 0x9E6C63D0876A9A55
_P_INV = pow(_P, -1, 1 << 64)
_STEP = np.array([0xC2B2AE3D27D4EB4F, 0x9FB21C651E98DF25, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB], U)
WHITE = np.zeros(256, bool)
WHITE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser with full avalanche; returns a new array."""
    x = x ^ (x >> U(30))
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


@lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    def run(base: int) -> np.ndarray:
        out = np.full(n, base, U)
        out[0] = 1
        return np.cumprod(out, dtype=U)

    return run(_P), run(_P_INV)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = CHUNK_BYTES + 1
    while size < n:
        size *= 2
    p, q = _powers(size)
    return p[:n], q[:n]


@dataclass
class Chunk:
    """Consecutive rows of a batch: ``rows`` of the batch, their bytes, and the byte offset of each row."""

    rows: slice
    data: np.ndarray
    offsets: np.ndarray


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    got = batch.column(batch.schema.get_field_index(name))
    return got.combine_chunks() if isinstance(got, pa.ChunkedArray) else got


def chunks(texts: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[Chunk]:
    """Cut a string column (null: empty text) in runs of rows of about ``limit`` bytes; a longer text stands alone."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    n = len(texts)
    if n == 0:
        return
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1]
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        yield Chunk(slice(at, to), data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at])
        at = to
    give_back()


@lru_cache
def _trim():
    return getattr(ctypes.CDLL(None), "malloc_trim", None)


def give_back() -> None:
    """Returns freed memory to the system: workers live on between tasks, and an executor's limit counts what they hold."""
    pa.default_memory_pool().release_unused()
    if _trim() is not None:
        _trim()(0)


def word_bounds(c: Chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every word, and for each row the number of its first word (one entry more than rows)."""
    size = len(c.data)
    white = WHITE[c.data]
    edge = np.zeros(size + 1, bool)
    edge[c.offsets] = True
    before = np.empty(size, bool)
    before[:1] = True
    before[1:] = white[:-1]
    starts = np.flatnonzero(~white & (before | edge[:-1]))
    after = np.empty(size, bool)
    after[-1:] = True
    after[:-1] = white[1:]
    ends = np.flatnonzero(~white & (after | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, c.offsets)


def word_hashes(c: Chunk, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    p, inverse = powers(len(c.data) + 1)
    total = np.zeros(len(c.data) + 1, U)
    np.cumsum((LOWER[c.data].astype(U) + U(1)) * p[:-1], out=total[1:])
    return mix64((total[ends] - total[starts]) * inverse[starts] + (ends - starts).astype(U) * _STEP[0])


def shingle_hashes(words: np.ndarray, first: np.ndarray, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all ``width``-word shingles of each row, repeats included; a row of fewer words is one shingle.
    Returns the hashes and each row's first position (one entry more than rows)."""
    steps = np.array([pow(int(_STEP[0]), 2 * i + 1, 1 << 64) for i in range(width)], U)
    n = np.diff(first)
    count = np.where(n >= width, n - width + 1, np.minimum(n, 1))
    offsets = np.concatenate(([0], np.cumsum(count)))
    at = np.arange(offsets[-1]) + np.repeat(first[:-1] - offsets[:-1], count)
    used = np.repeat(np.minimum(n, width), count)
    padded = np.concatenate((words, np.zeros(width, U)))
    out = used.astype(U) * _STEP[1]
    short = used < width
    for i in range(width):
        term = padded[at + i] * steps[i]
        if i and short.any():
            term[used <= i] = 0
        out += term
    return mix64(out), offsets


def distinct_sorted(hashes: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row's hashes as an ascending set, and the rows' new offsets."""
    hashes = hashes.copy()
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        if b - a > 1:
            hashes[a:b].sort()
    keep = np.ones(len(hashes), bool)
    keep[1:] = hashes[1:] != hashes[:-1]
    keep[offsets[:-1][offsets[:-1] < len(hashes)]] = True
    total = np.concatenate(([0], np.cumsum(keep)))
    return hashes[keep], total[offsets]


def shingle_sets(c: Chunk, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    starts, ends, first = word_bounds(c)
    return distinct_sorted(*shingle_hashes(word_hashes(c, starts, ends), first, width))


def row_sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of each row's run of values; 0 for an empty run."""
    total = np.zeros(len(values) + 1, values.dtype)
    np.cumsum(values, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]


def set_digest(values: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit sums over each row's set: equal for equal sets, whatever their order."""
    return row_sums(mix64(values + U(0x51ED270B)), offsets).view(np.int64), row_sums(mix64(values ^ _STEP[3]), offsets).view(np.int64)


def binary(values: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """Rows of fixed-width numbers as a binary column."""
    values = np.ascontiguousarray(values)
    return pa.Array.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer((offsets * values.dtype.itemsize).astype(np.int64)), pa.py_buffer(values)]).cast(pa.binary())


def lists(values: np.ndarray) -> pa.Array:
    """The rows of a matrix of int64 as a list column."""
    return pa.ListArray.from_arrays(np.arange(len(values) + 1, dtype=np.int32) * values.shape[1], pa.array(values.reshape(-1)))
