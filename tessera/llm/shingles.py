"""Sets of word shingles as sorted 64-bit hashes, computed for many texts at a time in numpy.

Words are runs of other bytes than space and \\x09-\\x0D, with A-Z lower-cased. A word's hash is a polynomial over random
values of its bytes, taken from one running sum over the buffer; a shingle's hash mixes those of its words. Buffers are
cut at white space into pieces of about ``PIECE`` bytes, so that memory does not grow with the length of a text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

PIECE = 1 << 18
_U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BYTE = np.arange(256, dtype=_U)
_BYTE[65:91] += _U(32)
_BYTE = mix((_BYTE + _U(1)) * _U(0x9E3779B97F4A7C15))
_BASE = 0x2545F4914F6CDD1D
_POWERS: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(n, 2 * PIECE)
        _POWERS[:] = [np.concatenate([[_U(1)], np.cumprod(np.full(size - 1, base, dtype=_U))]).astype(_U) for base in (_U(_BASE), _U(pow(_BASE, -1, 1 << 64)))]
    return _POWERS[0], _POWERS[1]


def _words(buffer: np.ndarray, firsts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, begins) of the words in the buffer; no word goes over one of the places in ``firsts``."""
    n = len(buffer)
    solid = ~_SPACE[buffer]
    begin, end = solid.copy(), solid.copy()
    begin[1:] &= ~solid[:-1]
    end[:-1] &= ~solid[1:]
    inside = firsts[(firsts > 0) & (firsts < n)]
    begin[inside], end[inside - 1] = solid[inside], solid[inside - 1]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(end) + 1
    up, down = _powers(n)
    sums = np.zeros(n + 1, dtype=_U)
    np.cumsum(_BYTE[buffer] * up[:n], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(_U) * _U(0x9E3779B97F4A7C15)), starts


def _all_words(buffer: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, list[int], int, int]]:
    """(hashes, their number in each text, first text, text after the last) for groups of texts of about PIECE bytes."""
    k, n = 0, len(offsets) - 1
    while k < n:
        stop = max(k + 1, int(np.searchsorted(offsets, offsets[k] + PIECE, side="right")) - 1)
        lo, hi = int(offsets[k]), int(offsets[stop])
        if hi - lo <= 2 * PIECE:
            hashes, starts = _words(buffer[lo:hi], offsets[k:stop] - lo) if hi > lo else (np.zeros(0, _U), np.zeros(0, int))
            yield hashes, np.diff(np.searchsorted(starts, offsets[k : stop + 1] - lo)).tolist(), k, stop
        else:
            found = []
            while lo < hi:
                cut = min(hi, lo + PIECE)
                while cut < hi and not _SPACE[buffer[cut]]:
                    cut += 1
                found.append(_words(buffer[lo:cut], np.zeros(0, int))[0])
                lo = cut
            hashes = np.concatenate(found)
            yield hashes, [len(hashes)], k, stop
        k = stop


def sets(texts: pa.Array, width: int = 5) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text. A null text, or one without words, has none; one of fewer than
    ``width`` words has one, of all its words."""
    texts = texts.cast(pa.large_binary())
    filled = texts.fill_null(b"") if texts.null_count else texts
    _, offset_buffer, data = filled.buffers()
    offsets = np.frombuffer(offset_buffer, dtype=np.int64)[filled.offset : filled.offset + len(filled) + 1] if len(filled) else np.zeros(1, np.int64)
    buffer = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    step = _U(0xD6E8FEB86659FD93)
    for hashes, counts, _, _ in _all_words(buffer, offsets):
        n = len(hashes)
        rolled = np.zeros(max(0, n - width + 1), dtype=_U)
        for k in range(width if len(rolled) else 0):
            rolled = rolled * step + hashes[k : k + len(rolled)]
        rolled = mix(rolled)
        at = 0
        for count in counts:
            if count >= width:
                x = np.sort(rolled[at : at + count - width + 1])
                yield x[np.concatenate([[True], x[1:] != x[:-1]])]
            elif count:
                h = _U(count)
                with np.errstate(over="ignore"):
                    for word in hashes[at : at + count]:
                        h = h * step + word
                yield mix(np.array([h ^ _U(0x5851F42D4C957F2D)], dtype=_U))
            else:
                yield np.zeros(0, dtype=_U)
            at += count


def set_id(x: np.ndarray) -> int:
    """A signed 64-bit name of the set, from all members and their number."""
    with np.errstate(over="ignore"):
        return int(mix(np.array([mix(x * _U(0xA0761D6478BD642F)).sum(dtype=_U) + _U(len(x)) * _U(0xE7037ED1A0B428DB)], dtype=_U)).view(np.int64)[0])
