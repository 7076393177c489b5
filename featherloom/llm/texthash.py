"""Hashes of whole Arrow columns of text, many texts at once."""

from __future__ import annotations

import functools
import hashlib

import numpy as np
import pyarrow as pa

from .common import mix64

_RANDOM = np.random.default_rng(20240601)
_TABLE = _RANDOM.integers(0, 2**64, 256, dtype=np.uint64)
_P = 0x9E3779B97F4A7C15
_PINV = pow(_P, -1, 2**64)
_K = np.uint64(0xC2B2AE3D27D4EB4F)
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_ASCII_LOWER = np.arange(256, dtype=np.uint8)
_ASCII_LOWER[65:91] += 32
#: Texts are hashed in runs of about so many bytes, which fit a core's cache.
RUN = 1 << 19
#: A longer text is read in pieces, so that what is made of its bytes stays small beside it.
PIECE = 1 << 22


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string or binary column and n + 1 offsets; null is empty."""
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)), ends


@functools.lru_cache(4)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    with np.errstate(over="ignore"):
        return tuple(np.cumprod(np.r_[np.uint64(1), np.full(n, x, np.uint64)], dtype=np.uint64) for x in (_P, _PINV))


def pieces(batches, rows: int = 1000):
    """Batches of ``rows`` rows at most, so that what is made of one stays small."""
    for b in batches:
        for i in range(0, len(b), rows):
            yield b.slice(i, rows)


class Prefix:
    """Hashes of any spans of a byte array, from prefix sums modulo 2**64."""

    def __init__(self, b: np.ndarray):
        up, self.down = _powers(1 << max(16, int(len(b)).bit_length()))
        self.sums = np.zeros(len(b) + 1, np.uint64)
        np.cumsum(_TABLE[b] * up[: len(b)], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix64((self.sums[end] - self.sums[start]) * self.down[start] + (end - start).astype(np.uint64) * _K)


def runs(ends: np.ndarray):
    """Ranges [i, j) of texts of about RUN bytes together; a longer text is alone."""
    i, n = 0, len(ends) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(ends, ends[i] + RUN, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


#: Longer words are hashed by a digest: sums modulo 2**64 confuse some patterned
#: strings (Thue-Morse words) the sooner the longer they are.
WORD_BYTES = 32


def _digest(b: np.ndarray, lower: bool) -> int:
    d = hashlib.blake2b(digest_size=8)
    for i in range(0, len(b), PIECE):
        d.update(_ASCII_LOWER[b[i : i + PIECE]] if lower else b[i : i + PIECE])
    return int.from_bytes(d.digest(), "little")


def _word_hashes(b: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    h = Prefix(b).of(start, stop)
    for i in np.flatnonzero(stop - start > WORD_BYTES):
        h[i] = _digest(b[start[i] : stop[i]], False)
    return h


def _long_words(b: np.ndarray, lower: bool) -> np.ndarray:
    """Hashes of the words of one long text, read in pieces that end between words."""
    out, i = [np.empty(0, np.uint64)], 0
    while i < len(b):
        j = min(len(b), i + PIECE)
        space = np.flatnonzero(_SPACE[b[i:j]])
        if j < len(b) and not len(space):  # a word longer than a piece
            while j < len(b) and not _SPACE[b[j : j + PIECE]].any():
                j += PIECE
            j = min(len(b), j)
            j += int(_SPACE[b[j : j + PIECE]].argmax()) if j < len(b) else 0
            x = b[i:j]
            out.append(np.array([_digest(x, lower)], np.uint64) if len(x) > WORD_BYTES else _word_hashes(_ASCII_LOWER[x] if lower else x, np.array([0]), np.array([len(x)])))
        else:
            j = j if j == len(b) else i + int(space[-1]) + 1
            x = _ASCII_LOWER[b[i:j]] if lower else b[i:j]
            word = ~_SPACE[x]
            start, stop = np.flatnonzero(word & np.r_[True, ~word[:-1]]), np.flatnonzero(word & np.r_[~word[1:], True]) + 1
            out.append(_word_hashes(x, start, stop))
        i = j
    return np.concatenate(out)


def shingle_sets(column: pa.Array, width: int, lower: bool = True) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of each text's ``width``-word shingles; a
    text with fewer words is one shingle, one without words has none."""
    data, ends = text_bytes(column)
    out: list[np.ndarray] = []
    for i, j in runs(ends):
        b = data[ends[i] : ends[j]]
        if j == i + 1 and len(b) > PIECE:
            h, first = _long_words(b, lower), np.zeros(1, np.int64)
            n = np.array([len(h)])
        else:
            if lower:
                b = _ASCII_LOWER[b]
            off = ends[i : j + 1] - ends[i]
            word = ~_SPACE[b]
            edge = np.zeros(len(b) + 1, bool)
            edge[off] = True
            start = np.flatnonzero(word & np.r_[True, ~word[:-1]][: len(b)] | word & edge[:-1])
            stop = np.flatnonzero(word & (np.r_[~word[1:], True][: len(b)] | edge[1:])) + 1
            h = _word_hashes(b, start, stop)
            first = np.searchsorted(start, off[:-1])
            n = np.searchsorted(start, off[1:]) - first
        s = h.copy()
        for k in range(1, width):
            s *= _K
            s[: max(0, len(s) - k)] += h[k:]
        s = mix64(s)
        for t in range(j - i):
            if n[t] >= width:
                out.append(np.unique(s[first[t] : first[t] + n[t] - width + 1]))
            elif n[t]:
                own = h[first[t] : first[t] + n[t]]
                x = own[:1]
                for y in own[1:]:
                    x = x * _K + y
                out.append(mix64(x + np.uint64(n[t])))
            else:
                out.append(np.empty(0, np.uint64))
    return out
