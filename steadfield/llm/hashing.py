"""Many byte strings of one buffer at once: 64-bit hashes from running sums, and which of the strings are equal.

A hash only proposes: ``distinct`` compares the bytes of strings whose hashes meet, so no two different strings are
ever taken for one, however they are made. Empty buffers, empty strings and repeated strings have no special rule."""

from __future__ import annotations

import numpy as np

_U = np.uint64
_BASE = 0x5851F42D4C957F2D  # odd, so that it has an inverse modulo 2**64


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64, a public bijection of 64-bit words."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


#: A random word for each byte.
BYTES = mix(np.arange(1, 257, dtype=np.uint64) * _U(0x9E3779B97F4A7C15))


class _Powers:
    """Powers of _BASE and of its inverse, as long as the longest text so far. The sum of BYTES[b[i]] * up[i] over a
    string, times down[start], depends on the string alone."""

    def __init__(self) -> None:
        self.up, self.down = (np.ones(1, dtype=np.uint64) for _ in range(2))

    def __call__(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            n = max(n, 2 * len(self.up))
            self.up = np.cumprod(np.concatenate(([_U(1)], np.full(n - 1, _BASE, dtype=np.uint64))), dtype=np.uint64)
            self.down = np.cumprod(np.concatenate(([_U(1)], np.full(n - 1, pow(_BASE, -1, 1 << 64), dtype=np.uint64))), dtype=np.uint64)
        return self.up, self.down


powers = _Powers()


#: Bytes that are compared at a time.
_COMPARED = 1 << 20
#: Bytes whose strings are hashed at a time, and the longest string for that.
_PIECE = 1 << 16


def _same(b: np.ndarray, start: np.ndarray, size: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Whether the string at start has the bytes of the one at other, for pairs of the same sizes (1 or more)."""
    same, upto = np.empty(len(start), dtype=bool), np.cumsum(size)
    at = 0
    while at < len(start):
        end = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + _COMPARED)))
        n = size[at:end]
        first = np.cumsum(n) - n
        inside = np.arange(int(n.sum()), dtype=np.int64) - np.repeat(first, n)
        differ = b[np.repeat(start[at:end], n) + inside] != b[np.repeat(other[at:end], n) + inside]
        same[at:end] = ~np.logical_or.reduceat(differ, first)
        at = end
    return same


def string_hashes(b: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Of short strings in order, by pieces of the buffer, so that the sums stay in a processor's cache; else by the whole buffer."""
    most = int((end - start).max(initial=0))
    if len(b) > _PIECE >= most and (start[1:] >= start[:-1]).all():
        out, cuts = np.empty(len(start), dtype=np.uint64), np.searchsorted(start, np.arange(0, len(b) + 2 * _PIECE, _PIECE))
        for k in np.flatnonzero(np.diff(cuts)).tolist():
            some, at = slice(cuts[k], cuts[k + 1]), k * _PIECE
            out[some] = _sum_hashes(b[at : at + _PIECE + most], start[some] - at, end[some] - at)
        return out
    return _sum_hashes(b, start, end)


def _sum_hashes(b: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    up, down = powers(len(b) + 1)
    sums = np.concatenate((np.zeros(1, dtype=np.uint64), np.cumsum(BYTES[b] * up[: len(b)], dtype=np.uint64)))
    return (sums[end] - sums[start]) * down[start]


def distinct(b: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the strings b[start:end]: for each its number among the distinct ones, and for each of those a string that it is.
    Up to 7 bytes are a key themselves, with their number; longer strings are hashed and compared."""
    if not len(start):
        return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
    size, padded = end - start, np.concatenate((b, np.zeros(8, dtype=np.uint8)))
    word = np.ndarray((len(b) + 1,), "<u8", padded, strides=(1,))  # the 8 bytes from each place on
    short = size < 8
    bits = (np.minimum(size, 7) << 3).astype(np.uint64)
    key = np.where(short, word[start] & ((_U(1) << bits) - _U(1)) | (size.astype(np.uint64) << _U(56)), string_hashes(b, start, end) | _U(1 << 63))
    order = np.argsort(key)
    ranked = key[order]
    first = np.flatnonzero(np.concatenate(([True], ranked[1:] != ranked[:-1])))
    which = np.empty(len(key), dtype=np.int64)
    which[order] = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(key))))
    some = order[first]
    lead = some[which]
    met = np.flatnonzero(~short & (lead != np.arange(len(lead))))
    lead = lead[met]
    differ = size[met] != size[lead]
    differ |= word[start[met]] != word[start[lead]]
    differ |= word[end[met] - 8] != word[end[lead] - 8]
    rest = np.flatnonzero((size[met] > 16) & ~differ)
    differ[rest] = ~_same(b, start[met[rest]], size[met[rest]], start[lead[rest]])
    more: dict[bytes, int] = {}  # strings whose hash is that of another one, by their bytes
    for k in met[differ].tolist():
        which[k] = more.setdefault(b[start[k] : end[k]].tobytes(), len(some))
        if which[k] == len(some):
            some = np.append(some, k)
    return which, some
