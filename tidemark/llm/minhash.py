"""SuperMinHash and classic MinHash signatures over sets of 64-bit hashes, and band keys."""

from __future__ import annotations

import numpy as np

from .text import U, mix64

_GOLD = 0x9E3779B97F4A7C15
_EMPTY = np.uint32(0xFFFFFFFF)
BLOCK = 50_000


def superminhash(values: np.ndarray, offsets: np.ndarray, slots: int) -> np.ndarray:
    """Signatures (rows x slots, uint32) of each row's set.

    Every element carries its own random permutation of the slots, drawn one rank at a time (Fisher-Yates); at rank
    ``j`` it offers ``j + u`` to its slot, kept as ``j`` in the top 8 bits and 24 bits of ``u``. Ranks are worked
    through for all elements together; a row whose slots all hold less than the next rank is finished, and its
    elements draw no further. Rows without elements keep the largest value in every slot.
    """
    if slots > 255:
        raise ValueError("at most 255 slots")
    rows = len(offsets) - 1
    out = np.full((rows, slots), _EMPTY, np.uint32)
    at = 0
    while at < rows:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + BLOCK, "right")) - 1)
        _block(values[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at], slots, out[at:to])
        at = to
    return out


def _block(values: np.ndarray, offsets: np.ndarray, slots: int, out: np.ndarray) -> None:
    flat = out.reshape(-1)
    size = np.diff(offsets)
    row = np.repeat(np.arange(len(size)), size)
    rank_of = np.tile(np.arange(slots, dtype=np.uint8), (len(values), 1))
    for j in range(slots):
        if not len(values):
            return
        drawn = mix64(values + U((j + 1) * _GOLD & 0xFFFFFFFFFFFFFFFF))
        k = (((drawn >> U(32)) * U(slots - j)) >> U(32)).astype(np.int64) + j
        lines = np.arange(len(values))
        slot = rank_of[lines, k]
        rank_of[lines, k] = rank_of[:, j]
        offer = (drawn & U(0xFFFFFF)).astype(np.uint32) | np.uint32(j << 24)
        np.minimum.at(flat, row * slots + slot, offer)
        if j + 1 < slots:
            open_rows = out.max(axis=1) >= np.uint32((j + 1) << 24)
            left = open_rows[row]
            if left.sum() < 0.8 * len(left):
                values, row, rank_of = values[left], row[left], rank_of[left]


def minhash(values: np.ndarray, offsets: np.ndarray, slots: int) -> np.ndarray:
    """Classic signatures (rows x slots, uint32): the least of each of ``slots`` multiply-shift hashes. Rows must not be empty."""
    seeds = mix64(np.arange(1, 2 * slots + 1, dtype=U) * U(_GOLD))
    out = np.empty((len(offsets) - 1, slots), np.uint32)
    for s in range(slots):
        got = ((values * (seeds[2 * s] | U(1)) + seeds[2 * s + 1]) >> U(32)).astype(np.uint32)
        out[:, s] = np.minimum.reduceat(got, offsets[:-1])
    return out


def band_keys(signatures: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """A key of 48 bits for each band of each signature; the band's number is part of its key."""
    if bands * rows > signatures.shape[1]:
        raise ValueError("more rows in the bands than in the signature")
    parts = signatures[:, : bands * rows].reshape(-1, bands, rows).astype(U)
    key = np.broadcast_to(np.arange(1, bands + 1, dtype=U) * U(_GOLD), parts.shape[:2]).copy()
    for i in range(rows):
        key = mix64(key * U(0xD6E8FEB86659FD93) + parts[:, :, i])
    return (key >> U(16)).view(np.int64)
