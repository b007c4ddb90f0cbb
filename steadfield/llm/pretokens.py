"""Encoding whole texts through a bounded cache of the pieces that byte-level BPE never merges across.

The public split pattern never joins a white-space character to what stands before it, and joins at most one space to
what follows. So a text falls into words, each with the one space before it, and white-space runs without their last
space; encoding these one by one and concatenating gives what encoding the whole text gives.

Defined results: an empty text has no ids; texts of any length and any white space, and repeated texts, give what the
encoder gives for the whole text; callers turn null into the empty text; no texts give no results.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator

import numpy as np

from .hashing import distinct

#: The code points of the Unicode property White_Space, as inclusive ranges.
WHITE_SPACE = [(0x09, 0x0D), (0x20, 0x20), (0x85, 0x85), (0xA0, 0xA0), (0x1680, 0x1680), (0x2000, 0x200A), (0x2028, 0x2029), (0x202F, 0x202F), (0x205F, 0x205F), (0x3000, 0x3000)]
_POINTS = [chr(c) for a, b in WHITE_SPACE for c in range(a, b + 1)]
_CLASS, _OTHERS = "".join(_POINTS), [c for c in _POINTS if c not in " \n"]
_RUNS = re.compile(f"([{_CLASS}]+)")
#: Characters of text that are split, looked up and joined at a time, unless an encoder says otherwise.
GROUP = 1_000_000
_MARKS, BEYOND_LATIN = ".,;:!?", "\u0250"


def _odd(text: str, data: bytes) -> bool:
    """Whether white space stands beside white space, or is any but space and newline. data: text in UTF-8."""
    if any(c in text for c in _OTHERS):
        return True
    b = np.frombuffer(data, dtype=np.uint8)
    white = (b == 0x20) | (b == 0x0A)
    return bool((white[1:] & white[:-1]).any())


def units(text: str) -> list[str]:
    """The pieces of any text."""
    return _runs(text)


def _runs(text: str) -> list[str]:
    parts = _RUNS.split(text)  # words at even places, runs between them
    out = [parts[0]] if parts[0] else []
    for k in range(1, len(parts), 2):
        run, word = parts[k], parts[k + 1]
        if not word:
            out.append(run)
            continue
        if len(run) > 1:
            out.append(run[:-1])
        out += [" " + word] if run[-1] == " " else [run[-1], word]
    return out


class CachedEncoder:
    """encode_many: the ids of each of some pieces, as bytes of little-endian numbers of the given width. most: entries
    of a generation of the cache; when one is full the one before it goes, which bounds memory and keeps common pieces.

    Texts go in groups. Where a text's white space is single spaces and newlines, its pieces are found, told apart (by
    hash, then byte by byte where hashes meet) and put together again as arrays, so that Python handles each distinct
    piece of a group once; other texts are cut piece by piece."""

    def __init__(self, encode_many: Callable[[list[str]], Iterable[bytes]], width: int, most: int = 250_000, group: int = GROUP) -> None:
        self.encode_many, self.kind, self.most, self.group = encode_many, np.dtype(f"<u{width}"), most, group
        self.known: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}

    def _ids(self, pieces: list[bytes]) -> list[bytes]:
        known = self.known
        found = list(map(known.get, pieces))
        if new := {p for p, f in zip(pieces, found) if f is None}:
            if self.older:
                again = {p: f for p in new if (f := self.older.get(p)) is not None}
                known.update(again)
                new -= again.keys()
            self._learn(new)
            found = [known[p] if f is None else f for p, f in zip(pieces, found)]
        return found

    def _learn(self, new: set[bytes]) -> None:
        """A mark after a Latin letter is split from it by the pattern, so most words with one are known without it."""
        known = self.known
        words = {p: p.decode("utf-8", "surrogatepass") for p in new}
        marked = {p for p, w in words.items() if len(w) > 2 and w[-1] in _MARKS and w[-2] < BEYOND_LATIN and w[-2].isalpha()}
        needed = [p for p in (new - marked) | {p[:-1] for p in marked} | {p[-1:] for p in marked} if p not in known]
        known.update(zip(needed, self.encode_many([p.decode("utf-8", "surrogatepass") for p in needed])))
        for p in marked:
            known[p] = known[p[:-1]] + known[p[-1:]]

    def _plain(self, texts: list[bytes]) -> list[np.ndarray]:
        """Texts without other white space than single spaces and newlines, laid end to end with a newline between."""
        buffer = b"\n".join(texts)
        b = np.frombuffer(buffer, dtype=np.uint8)
        if not len(b):
            return [np.empty(0, dtype=self.kind) for _ in texts]
        lengths = np.array([len(t) for t in texts])
        text_end = np.cumsum(lengths + 1) - 1  # the newline after each; the last has none
        newline = b == 0x0A
        begins = newline | (b == 0x20)
        begins[0] = True
        begins[1:] |= newline[:-1]
        start = np.flatnonzero(begins)
        end = np.append(start[1:], len(b))
        which, some = distinct(b, start, end)
        got = self._ids([buffer[a:z] for a, z in zip(start[some].tolist(), end[some].tolist())])
        ids = np.frombuffer(b"".join(got), dtype=self.kind)
        size = np.array([len(g) for g in got]) // self.kind.itemsize
        offset = np.cumsum(size) - size
        n = size[which]
        n[np.searchsorted(start, text_end[:-1])] = 0  # the newlines between texts
        upto = np.cumsum(n)
        out = ids[np.repeat(offset[which] - (upto - n), n) + np.arange(int(upto[-1]))]
        at = np.concatenate(([0], upto))[np.searchsorted(start, text_end)]
        return np.split(out, at[:-1])

    def _group(self, texts: list[str]) -> Iterator[np.ndarray]:
        data = [t.encode("utf-8", "surrogatepass") for t in texts]
        odd = [_odd(t, b) for t, b in zip(texts, data)]
        plain = iter(self._plain([b for b, o in zip(data, odd) if not o]))
        for t, o in zip(texts, odd):
            yield np.frombuffer(b"".join(self._ids([u.encode("utf-8", "surrogatepass") for u in units(t)])), dtype=self.kind) if o else next(plain)

    def __call__(self, texts: Iterable[str]) -> Iterator[np.ndarray]:
        held, size = [], 0
        for t in texts:
            held.append(t)
            size += len(t)
            if size >= self.group:
                yield from self._next(held)
                held, size = [], 0
        if held:
            yield from self._next(held)

    def _next(self, texts: list[str]) -> Iterator[np.ndarray]:
        if len(self.known) > self.most:
            self.older, self.known = self.known, {}
        return self._group(texts)
