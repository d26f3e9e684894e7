"""Tokens, shingles and signatures against plain Python."""

import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm.minhash import band_keys, minhash, superminhash
from tidemark.llm.text import binary, chunks, shingle_sets, word_bounds

WORD = re.compile(r"[^\x20\x09-\x0D]+")
TEXTS = ["", None, " \t\n", "One", "a b c d e f", "A B C d é  É", "x " * 50, "end", "w\x0bv\x0cu"]


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def plain(t, width=5):
    w = WORD.findall(lower(t))
    return {tuple(w[i : i + width]) for i in range(max(len(w) - width + 1, 1))} if w else set()


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="aB é\n\t .", max_size=40)), max_size=6), st.integers(1, 60))
def test_words_and_shingles_are_those_of_a_regular_expression(texts, limit):
    texts = texts + TEXTS
    counts, sizes, sets = [], [], []
    for c in chunks(pa.array(texts), limit):
        counts += np.diff(word_bounds(c)[2]).tolist()
        values, offsets = shingle_sets(c)
        sizes += np.diff(offsets).tolist()
        sets += [frozenset(values[a:b].tolist()) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
    assert counts == [len(WORD.findall(t or "")) for t in texts]
    assert sizes == [len(plain(t)) for t in texts]
    for i, a in enumerate(texts):
        for j, b in enumerate(texts):
            assert (sets[i] == sets[j]) == (plain(a) == plain(b))


def test_a_set_hashes_alike_in_any_chunk_and_place():
    alone = [shingle_sets(c)[0].tolist() for t in ("q r s t u v", "zz") for c in chunks(pa.array([t]))]
    beside = next(iter(chunks(pa.array(["some other words before", "q r s t u v", "", "zz"]))))
    values, offsets = shingle_sets(beside)
    assert [values[offsets[i] : offsets[i + 1]].tolist() for i in (1, 3)] == alone


def signed(a, b, make, slots):
    values = np.concatenate([np.sort(np.array(sorted(x), np.uint64)) for x in (a, b)])
    sig = make(values, np.array([0, len(a), len(a) + len(b)]), slots)
    return (sig[0] == sig[1]).mean()


def test_signatures_estimate_jaccard():
    rng = np.random.default_rng(3)
    pool = rng.integers(0, 1 << 63, 3000).astype(np.uint64)
    for n, shared in ((6, 3), (300, 240), (1000, 100)):
        a, b = set(pool[:n].tolist()), set(pool[n - shared : 2 * n - shared].tolist())
        true = len(a & b) / len(a | b)
        assert abs(signed(a, b, superminhash, 144) - true) < 0.15
        assert abs(signed(a, b, minhash, 144) - true) < 0.15


def brute_superminhash(values, slots):
    """The same draws, one element at a time and without early stopping."""
    from tidemark.llm.text import U, mix64

    out = [0xFFFFFFFF] * slots
    for v in values:
        place = list(range(slots))
        for j in range(slots):
            drawn = int(mix64(np.array([v], np.uint64) + U((j + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))[0])
            k = ((drawn >> 32) * (slots - j) >> 32) + j
            place[j], place[k] = place[k], place[j]
            out[place[j]] = min(out[place[j]], j << 24 | drawn & 0xFFFFFF)
    return out


def test_early_stopping_changes_nothing():
    rng = np.random.default_rng(4)
    sizes = [1, 3, 40, 200]
    values = rng.integers(0, 1 << 63, sum(sizes)).astype(np.uint64)
    offsets = np.concatenate(([0], np.cumsum(sizes)))
    got = superminhash(values, offsets, 24)
    for i in range(len(sizes)):
        assert got[i].tolist() == brute_superminhash(values[offsets[i] : offsets[i + 1]], 24)


def test_band_keys_tell_bands_apart():
    sig = np.ones((2, 6), np.uint32)
    keys = band_keys(sig, 3, 2)
    assert (keys[0] == keys[1]).all() and len(set(keys[0].tolist())) == 3 and (keys >= 0).all()
    assert binary(np.arange(4, dtype=np.uint64), np.array([0, 1, 1, 4])).to_pylist()[1] == b""
