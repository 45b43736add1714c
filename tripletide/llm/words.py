"""Words and word shingles of Arrow text columns as 64-bit hashes.

A word is a run of bytes other than space and 0x09-0x0D. Its hash is a polynomial over a
random table of its bytes, so the words of many texts are hashed in a few array operations
and no word becomes a Python object. Equal words have equal hashes; two different words or
shingles share one with a chance of about 2**-64.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_U = np.uint64
_random = np.random.default_rng(20240101)
_VALUES = _random.integers(1, 1 << 63, 256, dtype=np.uint64) | _U(1)
_FOLDED = _VALUES.copy()
_FOLDED[65:91] = _VALUES[97:123]
_PLACES = _random.integers(1, 1 << 63, 64, dtype=np.uint64) | _U(1)
_INSIDE = np.ones(256, bool)
_INSIDE[[32, 9, 10, 11, 12, 13]] = False
_powers: dict[str, np.ndarray] = {}


def mix(h: np.ndarray, salt: int = 0) -> np.ndarray:
    """A 64-bit finaliser: every bit of the input reaches every bit of the output."""
    h = h + _U((0x632BE59BD9B4E019 * (salt + 1)) & 0xFFFFFFFFFFFFFFFF)
    h = (h ^ (h >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> _U(27))) * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


def _power(kind: str, base: int, n: int) -> np.ndarray:
    held = _powers.get(kind)
    if held is None or len(held) < n:
        held = np.full(max(n, 1 << 21), base, np.uint64)
        held[0] = 1
        np.multiply.accumulate(held, out=held)
        if n <= 1 << 22:
            _powers[kind] = held
    return held[:n]


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column and where each text begins; a null is an empty text."""
    column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    starts = offsets.copy()
    if column.null_count:  # a null may cover bytes
        kept = [v.as_py() or "" for v in column]
        joined = "".join(kept).encode()
        sizes = np.fromiter((len(t.encode()) for t in kept), np.int64, len(kept))
        return np.frombuffer(joined, np.uint8), np.concatenate([[0], np.cumsum(sizes)])
    return raw[starts[0] : starts[-1]], starts - starts[0]


def word_spans(raw: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First and past-the-last byte of every word, and the first word of every text (plus the total)."""
    n = len(raw)
    inside = _INSIDE[raw]
    edge = np.zeros(n + 1, bool)
    edge[starts] = True
    before = np.empty(n + 1, bool)
    before[0], before[1:] = False, inside
    after = np.empty(n + 1, bool)
    after[n], after[:n] = False, inside
    begin = np.flatnonzero(after & (~before | edge))
    end = np.flatnonzero(before & (~after | edge))
    return begin, end, np.searchsorted(begin, starts)


def span_hashes(raw: np.ndarray, begin: np.ndarray, end: np.ndarray, fold: bool = True) -> np.ndarray:
    """Hashes of stretches of bytes, A-Z lower-cased if ``fold``."""
    if not len(begin):
        return np.zeros(0, np.uint64)
    total = np.empty(len(raw) + 1, np.uint64)
    total[0] = 0
    np.cumsum((_FOLDED if fold else _VALUES)[raw] * _power("up", _BASE, len(raw)), out=total[1:])
    return mix((total[end] - total[begin]) * _power("down", _INVERSE, len(raw))[np.minimum(begin, len(raw) - 1)])


def word_hashes(column: pa.Array, fold: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of a column, and the first word of every text (plus the total).

    ``fold`` lower-cases A-Z.
    """
    raw, starts = text_bytes(column)
    begin, end, first = word_spans(raw, starts)
    return span_hashes(raw, begin, end, fold), first


def shingle_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all runs of ``size`` words; fewer words make one run of all of them, none make no run."""
    if not len(words):
        return words
    k = min(size, len(words))
    total = np.full(len(words) - k + 1, (k * 0xD6E8FEB86659FD93) & 0xFFFFFFFFFFFFFFFF, np.uint64)
    for i in range(k):
        total += words[i : len(words) - k + 1 + i] * _PLACES[i % 64]
    return mix(total)
