"""Vectorised hashing of the words of a text, on numpy arrays inside Spark tasks."""

from __future__ import annotations

import numpy as np

_U = np.uint64
#: Odd multipliers of the word and shingle hashes.
_BASE = 0x9E3779B97F4A7C15
_LENGTH = 0xC2B2AE3D27D4EB4F
_PLACES = (0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3)
#: Texts are hashed in pieces of about so many bytes, cut between words, so memory does not follow the text.
_PIECE = 1 << 18


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values in which every input bit reaches every output bit."""
    h = h ^ (h >> _U(30))
    h = h * _U(0xBF58476D1CE4E5B9)
    h = h ^ (h >> _U(27))
    h = h * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


_powers = np.ones(1, dtype=_U)


def _power_table(n: int) -> np.ndarray:
    global _powers
    if len(_powers) < n:
        size = max(n, 1024)
        _powers = np.concatenate([np.ones(1, dtype=_U), np.cumprod(np.full(size, _BASE, dtype=_U))])
    return _powers


def _words_of(piece: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    blank = (piece == 32) | ((piece >= 9) & (piece <= 13))
    edge = np.diff(np.concatenate([[1], blank.view(np.int8), [1]]).astype(np.int8))
    return np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)


def words(text: bytes, lower: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, first byte and end byte of each run of bytes other than 0x20 and 0x09-0x0D.

    ``lower`` treats A-Z as a-z.  Equal words have equal hashes in every process.
    """
    data = np.frombuffer(text, dtype=np.uint8)
    out = []
    at = 0
    while at < len(data):
        end = min(len(data), at + _PIECE)
        while end < len(data):  # cut at a blank; a word longer than a piece stays whole
            tail = data[end : end + _PIECE]
            blanks = np.flatnonzero((tail == 32) | ((tail >= 9) & (tail <= 13)))
            if len(blanks):
                end += int(blanks[0])
                break
            end += len(tail)
        piece = data[at:end]
        starts, ends = _words_of(piece)
        if len(starts):
            sizes = ends - starts
            if lower:
                piece = np.where((piece >= 65) & (piece <= 90), piece + np.uint8(32), piece)
            inside = np.repeat(starts - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes)
            n = int(sizes.sum())
            pos = np.arange(n) + inside
            rel = pos - np.repeat(starts, sizes)
            terms = (piece[pos].astype(_U) + _U(1)) * _power_table(int(sizes.max()) + 1)[rel]
            sums = np.add.reduceat(terms, np.cumsum(sizes) - sizes)
            out.append((mixed(sums + sizes.astype(_U) * _U(_LENGTH)), starts + at, ends + at))
        at = end
    if not out:
        return np.empty(0, dtype=_U), np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def shingles(hashes: np.ndarray, size: int) -> np.ndarray:
    """The sorted distinct hashes of ``size`` words in a row; of all words where there are fewer; of none, empty."""
    if not len(hashes):
        return hashes
    n = max(1, len(hashes) - size + 1)
    width = min(size, len(hashes))
    total = np.full(n, width, dtype=_U)
    for k in range(width):
        total = total + hashes[k : k + n] * _U(_PLACES[k % len(_PLACES)] + 2 * (k // len(_PLACES)))
    return np.unique(mixed(total))
