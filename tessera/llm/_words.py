"""Vectorised word kernel over Arrow text columns.

Works on UTF-8 bytes. Every separator is ASCII, so byte-wise splitting is exact. Texts of any length are
handled: the bytes of a batch are cut into blocks between words, never inside one.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

BLOCK = 1 << 20
_rng = np.random.default_rng(20240607)
#: Random 64-bit value of each byte, and an odd multiplier with its inverse modulo 2**64.
BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
STEP = 0x9E3779B97F4A7C15
BACK = pow(STEP, -1, 1 << 64)
_ODD = _rng.integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers: dict[int, np.ndarray] = {}

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Words that end at white space: everything but U+0020 and U+0009 to U+000D.
NOT_SPACE = np.ones(256, dtype=bool)
NOT_SPACE[[9, 10, 11, 12, 13, 32]] = False
#: Words of digits, letters and anything beyond ASCII.
ALNUM = np.zeros(256, dtype=bool)
ALNUM[48:58] = ALNUM[65:91] = ALNUM[97:123] = ALNUM[128:] = True
#: Words of letters and anything beyond ASCII.
LETTERS = ALNUM.copy()
LETTERS[48:58] = False


def _power(base: int, n: int) -> np.ndarray:
    """base**0, base**1, ... modulo 2**64, at least n of them."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(n, BLOCK + 1)
        have = np.full(size, base, dtype=np.uint64)
        have[0] = 1
        np.multiply.accumulate(have, out=have)
        if size > 16 * BLOCK:
            return have
        _powers[base] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and document bounds of a text column; a null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    n, at = len(column), column.offset
    _, offsets, data = column.buffers()
    if offsets is None or n == 0:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    bounds = np.frombuffer(offsets, dtype=np.int64, count=at + n + 1)[at:]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[bounds[0] : bounds[-1]], bounds - bounds[0]


def words(data: np.ndarray, bounds: np.ndarray, inside: np.ndarray, block: int = BLOCK):
    """(hash, start, end) of every word, and for each document the bounds of its words.

    inside: for each byte whether it belongs to a word. Letters A-Z count as a-z. start and end are byte
    positions in data. A word never crosses a document's end.
    """
    total = len(data)
    hashes, starts, ends = [], [], []
    lo = 0
    while lo < total:
        hi = min(lo + block, total)
        if hi < total:
            # Cut where a word cannot continue: at a document's bound, else after the last separator.
            cut = bounds[np.searchsorted(bounds, hi, side="right") - 1]
            if cut > lo:
                hi = int(cut)
            else:
                gaps = np.flatnonzero(~inside[data[lo:hi]])
                while not len(gaps) and hi < total and hi < bounds[np.searchsorted(bounds, lo, side="right")]:
                    hi = min(hi + block, total)
                    gaps = np.flatnonzero(~inside[data[lo:hi]])
                end = int(bounds[np.searchsorted(bounds, lo, side="right")])
                hi = min(end, hi) if end <= hi or not len(gaps) else lo + int(gaps[-1]) + 1
        part = data[lo:hi]
        isin = inside[part]
        first, last = isin.copy(), isin.copy()
        first[1:] &= ~isin[:-1]
        last[:-1] &= ~isin[1:]
        own = bounds[np.searchsorted(bounds, lo, "right") : np.searchsorted(bounds, hi, "left")] - lo
        own = own[own < len(part)]
        if len(own):
            first[own] = isin[own]
            last[own - 1] = isin[own - 1]
        s, e = np.flatnonzero(first), np.flatnonzero(last) + 1
        if len(s):
            n = len(part)
            run = np.zeros(n + 1, dtype=np.uint64)
            np.cumsum(BYTE[LOWER[part]] * _power(STEP, n), out=run[1:])
            hashes.append(mix((run[e] - run[s]) * _power(BACK, n)[s]))
            starts.append(s + lo)
            ends.append(e + lo)
        lo = hi
    if not starts:
        none = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), none, none, np.zeros(len(bounds), np.int64)
    start = np.concatenate(starts)
    return np.concatenate(hashes), start, np.concatenate(ends), np.searchsorted(start, bounds, side="left")


def word_codes(column: pa.Array, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(codes, own, distinct): every word as a place in the array of distinct words, and each document's bounds.

    inside: as in words; letters A-Z become a-z. Words are compared whole, not by a hash.
    """
    data, bounds = buffers(column)
    isin = inside[data]
    first, last = isin.copy(), isin.copy()
    first[1:] &= ~isin[:-1]
    last[:-1] &= ~isin[1:]
    own = bounds[:-1][np.diff(bounds) > 0]
    first[own] = isin[own]
    cut = own[own > 0] - 1
    last[cut] = isin[cut]
    letters = LOWER[data[isin]]
    ends = np.cumsum(isin)[np.flatnonzero(last)]
    offsets = np.concatenate([[0], ends]).astype(np.int64)
    told = pa.Array.from_buffers(pa.large_string(), len(ends), [None, pa.py_buffer(offsets), pa.py_buffer(letters)]).dictionary_encode()
    return np.asarray(told.indices, dtype=np.int64), np.searchsorted(np.flatnonzero(first), bounds, "left"), told.dictionary


def shingles(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k words that begin at each word; the last k-1 of an array are cut short and not for use."""
    if not len(hashes):
        return hashes
    out = hashes * _ODD[0]
    for j in range(1, k):
        out[:-j] += hashes[j:] * _ODD[j]
    return mix(out)


def sequence_hash(hashes: np.ndarray) -> np.uint64:
    """Hash of a whole sequence shorter than a shingle; its length is part of it."""
    out = (hashes * _ODD[32 : 32 + len(hashes)]).sum(dtype=np.uint64)
    return mix(np.array([out + np.uint64(len(hashes))], dtype=np.uint64))[0]


def shingle_sets(column: pa.Array, k: int):
    """For each text its sorted distinct shingle hashes, one text at a time."""
    data, bounds = buffers(column)
    hashes, _, _, own = words(data, bounds, NOT_SPACE)
    grams = shingles(hashes, k)
    for i in range(len(own) - 1):
        a, b = own[i], own[i + 1]
        n = b - a
        if n >= k:
            part = np.sort(grams[a : b - k + 1])
            keep = np.empty(len(part), dtype=bool)
            keep[0] = True
            np.not_equal(part[1:], part[:-1], out=keep[1:])
            yield part[keep]
        elif n:
            yield np.array([sequence_hash(hashes[a:b])], dtype=np.uint64)
        else:
            yield np.zeros(0, dtype=np.uint64)
