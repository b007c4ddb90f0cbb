"""Removal of byte strings that also start in an earlier document, by a multi-document suffix structure built column by
column.

What is compared. A document's ``SPAN``-byte windows are cut into runs that share the smallest hash of a ``GRAM``-byte
string inside them (its leftmost place; a property of the window's bytes alone, so equal windows have equal anchors
wherever they stand). Runs whose anchor stands in one document only can't hold a repeated window and leave here. The
other runs, with the bytes of all their windows, are short strings of at most 2 * SPAN - GRAM bytes.

How. Strings with anchors of one bucket meet in one task, each distinct one once. Equal windows start as far before their
anchor, so for each of ``DISTANCES`` parts of these distances the bytes that all its windows have are hashed; windows
whose bytes stand in one string only leave here. Of the others, with their strings cut to them, a collection Burrows-Wheeler
transform and its common-prefix array are built from the right: round j inserts the suffix of length j of every string,
one symbol for each string, by extending the arrays of round j - 1. A suffix's place is its predecessor's rank among
equal symbols; its common prefix with its neighbours is one more than the least common prefix between the places of the
two occurrences. The arrays are read and written front to back each round; beyond ``IN_MEMORY`` symbols they are files in
the shared folder, so a task holds one part of them and a few numbers for each string. In the finished order, windows that share SPAN bytes lie between two values below SPAN, and the
least doc_id among them is taken for each.

Where data lie. Documents are packed into block files in the shared folder, written once and read by the later passes, and
beside each a file of the places where its strings stand, which the last pass reads;
only hashes (5 bytes for each run), strings and answers are shuffled. Blocks send each distinct hash and each distinct
string once, with the least and largest doc_id that has it in the block, so a passage in a third of all documents is
one entry for each block. The number of buckets grows with the bytes of text. Block names and contents follow from the
input's partitions alone, so a task that runs again writes the same file.

Defined results: null text counts as empty; texts below SPAN bytes keep all bytes; rows of equal doc_id do not remove
each other's bytes; a null doc_id counts as the largest that there is; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import ship
from . import common
from .hashing import BYTES as _BYTES
from .hashing import distinct, string_hashes
from .hashing import mix as _mix

#: Shorter anchors make longer runs, so fewer hashes, but meet by chance in other documents the more there are.
SPAN, GRAM = 50, 24
#: Every block sends a row to every bucket.
BLOCK_BYTES, BUCKET_BYTES = 8 << 20, 16 << 20
#: Bytes that are hashed at a time (their arrays stay in a processor's cache), symbols up to which a collection's arrays stay in
#: memory, and symbols of a file.
PIECE, IN_MEMORY, PART = 1 << 16, 8 << 20, 4 << 20
#: Partitions at most; a partition then holds several buckets, one after another.
PARTITIONS = 20_000
#: Strings that are ordered together, about, and parts of the distances of windows to their anchor.
COLLECTION, DISTANCES = 6_000, 4
_END = 255  # never a byte of UTF-8
_LAST_ID = np.iinfo(np.int64).max
_U = np.uint64
_LOW40 = _U((1 << 40) - 1)


def _gram_hashes(b: np.ndarray) -> np.ndarray:
    """The hash of each GRAM-byte string."""
    h, n, factor = _BYTES[b], 1, 0x5851F42D4C957F2D
    tail, size = np.zeros(len(b) + 1, dtype=np.uint64), 0  # hashes of the last bytes of a string
    while n <= GRAM:  # hashes of strings twice as long from two halves
        if GRAM & n:
            tail = h[: len(tail) - n] * _U(pow(0x5851F42D4C957F2D, size, 1 << 64)) + tail[n:]
            size += n
        if 2 * n <= GRAM:
            h = h[:-n] * _U(factor) + h[n:]
        factor, n = factor * factor % (1 << 64), 2 * n
    return _mix(tail)


def _window_minima(b: np.ndarray) -> np.ndarray:
    """For each window of SPAN bytes the smallest hash of a GRAM-byte string inside it."""
    h = _gram_hashes(b)
    width, n = SPAN - GRAM + 1, 1
    while 2 * n <= width:
        h, n = np.minimum(h[:-n], h[n:]), 2 * n
    return np.minimum(h[: len(h) - (width - n)], h[width - n :]) if width > n else h


def anchored_runs(b: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows with one anchor in texts laid end to end: first window, last window, anchor hash, text number.
    Windows don't cross texts; a piece's edge ends a run as well, which changes no window's anchor."""
    ends = np.cumsum(lengths)
    starts = ends - lengths
    parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for at in range(0, max(0, len(b) - SPAN + 1), PIECE):
        m = _window_minima(b[at : at + PIECE + SPAN - 1])
        cut = np.ones(len(m) + 1, dtype=bool)
        cut[1:-1] = m[1:] != m[:-1]
        inside = starts[np.searchsorted(starts, at) :]
        inside = inside[inside < at + len(m)] - at
        cut[inside] = True
        first = np.flatnonzero(cut[:-1])
        last = np.concatenate((first[1:], [len(m)])) - 1
        parts.append((first + at, last + at, m[first]))
    if not parts:
        return (np.empty(0, dtype=np.int64),) * 2 + (np.empty(0, dtype=np.uint64), np.empty(0, dtype=np.int64))
    first, last, anchor = (np.concatenate(x) for x in zip(*parts))
    text = np.searchsorted(ends, first, side="right")
    last = np.minimum(last, ends[text] - SPAN)
    ok = last >= first
    first, last, anchor, text = first[ok], last[ok], anchor[ok], text[ok]
    # periodic text has one hash at many places; its runs are cut to the length that one place can have
    width = SPAN - GRAM + 1
    pieces = (last - first) // width + 1
    nth = np.arange(int(pieces.sum())) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    first, last, anchor, text = (np.repeat(x, pieces) for x in (first, last, anchor, text))
    first = first + nth * width
    return first, np.minimum(last, first + width - 1), anchor, text


class Block:
    """Documents laid end to end, with the runs of their windows."""

    def __init__(self, doc_ids: np.ndarray, named: np.ndarray, lengths: np.ndarray, b: np.ndarray) -> None:
        """doc_ids: in the order of documents, a null as the last; named: 0 where doc_id is null."""
        self.doc_ids, self.named, self.lengths, self.b = doc_ids, named, lengths, b
        self.first, self.last, self.anchor, self.text = anchored_runs(b, lengths)

    def image(self) -> bytes:
        head = np.array([len(self.doc_ids)], dtype="<i8").tobytes()
        return zstandard.ZstdCompressor(level=1).compress(head + self.doc_ids.astype("<i8").tobytes() + self.lengths.astype("<i8").tobytes() + self.named.astype(np.uint8).tobytes() + self.b.tobytes())

    @classmethod
    def read(cls, folder: str, block: int) -> Block:
        return cls(*_texts(folder, block))

    def hashes(self, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Distinct anchors in order of bucket and hash: bucket, hash, whether two documents here have it; and for each
        run its place among them."""
        bucket = (self.anchor >> _U(40)) % _U(buckets)
        low = self.anchor & _LOW40
        key = bucket << _U(40) | low
        found, place = np.unique(key, return_inverse=True)
        docs = self.doc_ids[self.text]
        least, most = np.full(len(found), _LAST_ID), np.full(len(found), np.iinfo(np.int64).min)
        np.minimum.at(least, place, docs)
        np.maximum.at(most, place, docs)
        return (found >> _U(40)).astype(np.int64), found & _LOW40, least != most, place

    def strings(self, chosen: np.ndarray, place: np.ndarray, bucket: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of the runs with a chosen anchor, the distinct strings (by their bytes) in order of bucket: a run that holds each,
        the least and most doc_id with it; and for each run of the block the number of its string, or -1."""
        runs, own = np.flatnonzero(chosen[place]), np.full(len(place), -1, dtype=np.int64)
        if not len(runs):
            return runs, runs, runs, own
        which, some = distinct(self.b, self.first[runs], self.last[runs] + SPAN)
        by_bucket = np.argsort(bucket[place[runs[some]]], kind="stable")
        rank = np.empty(len(some), dtype=np.int64)
        rank[by_bucket] = np.arange(len(some))
        own[runs] = rank[which]
        docs = self.doc_ids[self.text[runs]]
        least, most = np.full(len(some), _LAST_ID), np.full(len(some), np.iinfo(np.int64).min)
        np.minimum.at(least, own[runs], docs)
        np.maximum.at(most, own[runs], docs)
        return runs[some[by_bucket]], least, most, own


def _write(folder: str, name: str, data: bytes) -> None:
    """A compressed file that is there whole or not at all; a task that runs again replaces it by the same."""
    from pyspark import TaskContext

    fs, base = common.file_system(folder)
    fs.create_dir(base, recursive=True)
    tmp = f"{base}/{name}.{TaskContext.get().taskAttemptId()}"
    with fs.open_output_stream(tmp) as f:
        f.write(data)
    fs.move(tmp, f"{base}/{name}")


def _read(folder: str, name: str) -> bytes:
    fs, base = common.file_system(folder)
    with fs.open_input_stream(f"{base}/{name}") as f:
        return zstandard.ZstdDecompressor().decompress(f.read())


def _texts(folder: str, block: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    data = _read(folder, str(block))
    n = int(np.frombuffer(data, "<i8", 1)[0])
    return np.frombuffer(data, "<i8", n, 8), np.frombuffer(data, np.uint8, n, 8 + 16 * n), np.frombuffer(data, "<i8", n, 8 + 8 * n), np.frombuffer(data, np.uint8, -1, 8 + 17 * n)


def _pack40(h: np.ndarray) -> bytes:
    return h.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5].tobytes()


def _unpack40(b: bytes) -> np.ndarray:
    out = np.zeros((len(b) // 5, 8), dtype=np.uint8)
    out[:, :5] = np.frombuffer(b, dtype=np.uint8).reshape(-1, 5)
    return out.view("<u8").ravel()


class Runs:
    """The transform so far, in order, as pieces (preceding symbols, common prefixes, tags): one in memory, or, beyond
    ``IN_MEMORY`` symbols, files of ``PART`` symbols or so in a folder that is given, read and written front to back."""

    def __init__(self, folder: str | None) -> None:
        self.folder, self.pieces, self.counts = folder, [], []  # counts: of each symbol in each piece

    def add(self, bwt: np.ndarray, lcp: np.ndarray, tag: np.ndarray, count: np.ndarray, filed: bool) -> None:
        if not filed:
            self.pieces.append((bwt, lcp, tag))
            self.counts.append(count)
            return
        fs, base = common.file_system(self.folder)
        fs.create_dir(base, recursive=True)
        for a in range(0, len(bwt), PART):
            name, some = f"{base}/{uuid.uuid4().hex}", slice(a, a + PART)
            with fs.open_output_stream(name) as f:
                for x, kind in ((bwt, "u1"), (lcp, "u1"), (tag, "<i8")):
                    f.write(np.ascontiguousarray(x[some].astype(kind)))
            self.pieces.append((name, len(bwt[some])))
            self.counts.append(np.bincount(bwt[some], minlength=256))

    def __iter__(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        for piece in self.pieces:
            if len(piece) == 3:
                yield piece
                continue
            fs, _ = common.file_system(self.folder)
            name, n = piece
            with fs.open_input_stream(name) as f:
                data = f.read()
            yield np.frombuffer(data, "u1", n), np.frombuffer(data, "u1", n, n), np.frombuffer(data, "<i8", n, 2 * n)

    def remove(self) -> None:
        for piece in self.pieces:
            if len(piece) == 2:
                common.file_system(self.folder)[0].delete_file(piece[0])


def build(symbols: np.ndarray, lengths: np.ndarray, folder: str | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """The transform of strings laid end to end (of 127 symbols at most), in pieces that follow each other: for each place
    the preceding symbol, the common prefix with the place before, the string number and the length of the suffix.

    Round j inserts the suffix of length j of every string that has one. A first pass over the pieces ranks the symbol
    that each string asks for and takes the least common prefix to the places of that symbol on either side; a second
    one copies the pieces with the new suffixes put in. Both go front to back; between pieces, a few numbers for each of
    256 symbols are carried. What is held beside a piece is a few numbers for each string."""
    m = len(lengths)
    kind = np.int32 if m < 1 << 24 else np.int64
    stop, has = np.cumsum(lengths), lengths > 0
    first = np.full(m, _END, dtype=np.uint8)
    first[has] = symbols[stop[has] - 1]
    runs = Runs(folder)
    runs.add(first, np.zeros(m, dtype=np.uint8), np.arange(m, dtype=kind) << 7, np.bincount(first, minlength=256), folder is not None and m > IN_MEMORY)
    active = place = np.arange(m)  # strings by the place of their longest suffix so far, and that place
    for j in range(1, int(lengths.max(initial=0)) + 1):
        goes_on = lengths[active] >= j
        active, place = active[goes_on], place[goes_on]
        rank, symbol, own, following, total = _asked(runs, place)
        left = stop[active] - j - 1
        added = np.where(lengths[active] > j, symbols[np.maximum(left, 0)], np.uint8(_END))
        # a symbol's places come after those of smaller ones, all behind the m ends of strings
        by = np.argsort(symbol, kind="stable")
        active, place = active[by], m + rank[by]
        after = _inserted(runs, place, added[by], own[by], following[by], (active.astype(kind) << 7) + kind(j), folder is not None and total > IN_MEMORY)
        runs.remove()
        runs = after
    for bwt, lcp, tag in runs:
        yield bwt, lcp, (tag >> 7).astype(np.int64), (tag & 127).astype(np.uint8)
    runs.remove()


def _asked(runs: Runs, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]:
    """For ascending places: the rank of each among all places by their symbols, its symbol, one more than the least common prefix
    behind the place of the same symbol before it and up to it (0 if there is none), the same for the one after it, and
    the number of places there will be."""
    symbol = np.empty(len(asked), dtype=np.uint8)
    rank, own, following = np.empty(len(asked), dtype=np.int64), np.zeros(len(asked), dtype=np.uint8), np.zeros(len(asked), dtype=np.uint8)
    count = np.zeros(256, dtype=np.int64)
    carry = np.full(256, 255, dtype=np.uint8)  # the least common prefix since a symbol's last place
    waiting = np.full(256, -1, dtype=np.int64)  # who asked at a symbol's last place, if anyone did
    offset = 0
    for (bwt, lcp, _), here in zip(runs, runs.counts):
        n = len(bwt)
        wide, shift = (np.uint32, 24) if n < 1 << 24 else (np.uint64, 40)
        order = np.sort(bwt.astype(wide) << wide(shift) | np.arange(n, dtype=wide))  # symbols with their places
        where = lambda k: (order[k] & wide((1 << shift) - 1)).astype(np.int64)  # noqa: E731, B023
        edge = np.concatenate(([0], np.cumsum(here)))
        a, z = np.searchsorted(asked, (offset, offset + n))
        spot = asked[a:z] - offset
        mine = bwt[spot]
        wanted, at = mine.astype(wide) << wide(shift) | spot.astype(wide), np.empty(z - a, dtype=np.int64)
        by = np.argsort(wanted)
        at[by] = np.searchsorted(order, wanted[by])
        symbol[a:z], rank[a:z] = mine, at - edge[mine] + count[mine]
        # least prefixes from one place of a symbol to its next, by one pass over the places of asked symbols
        low, high = edge[mine], edge[mine.astype(np.int64) + 1]
        before = np.where(at > low, where(np.maximum(at - 1, 0)), -1)
        after = np.where(at + 1 < high, where(np.minimum(at + 1, n - 1)), -1)
        own[a:z], following[a:z] = _new_prefixes(lcp, before, spot, after)
        if len(runs.pieces) > 1 and n:
            # the first place of a symbol in this piece closes what was open before, its last one opens anew
            there, least, ends = np.flatnonzero(here), np.minimum.accumulate(lcp), np.minimum.accumulate(lcp[::-1])[::-1]
            index = np.full(n, -1, dtype=np.int64)
            index[spot] = np.arange(a, z)
            closes = there[count[there] > 0]
            opening, last = where(edge[closes]), where(edge[there + 1] - 1)
            value = np.minimum(carry[closes], least[opening]) + np.uint8(1)
            for who, v in ((waiting[closes], following), (index[opening], own)):
                v[who[who >= 0]] = value[who >= 0]
            carry = np.minimum(carry, least[-1])
            carry[there] = np.where(last + 1 < n, ends[np.minimum(last + 1, n - 1)], np.uint8(255))
            waiting[there] = index[last]
        count = count + here
        offset += n
    base = np.cumsum(count) - count
    return rank + base[symbol], symbol, own, following, offset + len(asked)


def _inserted(runs: Runs, q: np.ndarray, added: np.ndarray, own: np.ndarray, following: np.ndarray, tag: np.ndarray, filed: bool) -> Runs:
    """The pieces with new entries at the ascending places q. The entry after a new one has a new neighbour; where that is
    new as well, its own value is the same."""
    out, offset = Runs(runs.folder), 0
    before = q - np.arange(len(q))  # how many old entries stand before each new one
    for k, (b, l, t) in enumerate(runs):
        n, final = len(b), k == len(runs.pieces) - 1
        a, z = np.searchsorted(before, offset), len(before) if final else int(np.searchsorted(before, offset + n))
        at = before[a:z] - offset + np.arange(z - a)  # a piece that is not the last has an old entry behind each new one
        fresh = np.zeros(n + len(at), dtype=bool)
        fresh[at] = True
        old, made = ~fresh, []
        for was, new in ((b, added), (l, own), (t, tag)):
            x = np.empty(len(fresh), dtype=was.dtype)
            x[old] = was
            if was is l:
                follows = at + 1 < len(fresh)
                x[at[follows] + 1] = following[a:z][follows]
            x[at] = new[a:z]
            made.append(x)
        out.add(*made, runs.counts[k] + np.bincount(added[a:z], minlength=256), filed)
        offset += n
    return out


def _new_prefixes(lcp: np.ndarray, before: np.ndarray, at: np.ndarray, after: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One more than the least of lcp[before + 1 .. at] and of lcp[at + 1 .. after]; 0 where before or after is -1."""
    if not len(at):
        return np.empty(0, dtype=np.uint8), np.empty(0, dtype=np.uint8)
    low, high = np.where(before >= 0, before, at), np.where(after >= 0, after, at)
    by = np.argsort(low)
    edges = np.stack((low[by], at[by], high[by]), axis=1).ravel() + 1
    least = np.minimum.reduceat(np.append(lcp, np.uint8(0)), edges) + np.uint8(1)
    own, following = np.empty(len(at), dtype=np.uint8), np.empty(len(at), dtype=np.uint8)
    own[by], following[by] = least[0::3], least[1::3]
    own[before < 0], following[after < 0] = 0, 0
    return own, following


def _shared(symbols: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For distinct strings laid end to end, each with one anchor in all its windows: the anchor, and the first and last window
    between which all lie that another string may hold; where there are none, the last is before the first.

    Windows that are equal start as far before their anchor. Those that do so within a part of the distances have some bytes
    in common; only where these stand in two strings, by their hashes, can the windows. Where a string has its anchor at
    several places, as periodic text, all windows of all strings with this anchor stay."""
    stop, last, width = np.cumsum(lengths), lengths - SPAN, SPAN - GRAM + 1
    start = stop - lengths
    anchor, place, several = np.empty(len(lengths), dtype=np.uint64), np.empty(len(lengths), dtype=np.int64), np.empty(len(lengths), dtype=bool)
    cuts = np.searchsorted(start, np.arange(0, len(symbols) + PIECE, PIECE))
    for a, z in zip(cuts, cuts[1:]):
        if z > a:
            h, at = _gram_hashes(symbols[start[a] : stop[z - 1]]), start[a:z] - start[a]
            first = h[at[:, None] + np.arange(width)]
            anchor[a:z], place[a:z] = first.min(axis=1), first.argmin(axis=1)
            same = h == np.repeat(anchor[a:z], lengths[a:z])[: len(h)]
            same = np.append(same, False)
            several[a:z] = np.add.reduceat(same, np.stack((at, at + lengths[a:z] - GRAM + 1), axis=1).ravel(), dtype=np.int64)[::2] > 1
    _, group, members = np.unique(anchor, return_inverse=True, return_counts=True)
    met, low, high = members[group] > 1, last + 1, np.full(len(lengths), -1)
    edges = [width * k // DISTANCES for k in range(DISTANCES + 1)]
    for a, z in zip(edges, edges[1:]):  # windows that start a to z - 1 bytes before their anchor
        some = np.flatnonzero(met & (place >= a) & (place - last < z))
        first = (start + place)[some] - a
        _, which, count = np.unique(string_hashes(symbols, first, first + SPAN - (z - 1 - a)), return_inverse=True, return_counts=True)
        some = some[count[which] > 1]
        low[some] = np.minimum(low[some], np.maximum(place[some] - (z - 1), 0))
        high[some] = np.maximum(high[some], np.minimum(place[some] - a, last[some]))
    whole = met & (np.bincount(group, weights=several) > 0)[group]
    return anchor, np.where(whole, 0, low), np.where(whole, last, high)


def least_ids(strings: list[bytes], ids: np.ndarray, folder: str | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For windows of distinct strings, the least of ids among all strings that hold the window: as runs (string,
    first window, last window, least id), in order of string and window. Windows that no other string can hold are not ordered."""
    lengths = np.array([len(s) for s in strings], dtype=np.int64)
    anchor, low, high = _shared(np.frombuffer(b"".join(strings), dtype=np.uint8), lengths)
    rest, none = np.flatnonzero(low <= high), np.flatnonzero(low > high)
    left, right = rest[low[rest] > 0], rest[high[rest] < lengths[rest] - SPAN]
    zero = np.zeros(len(strings), dtype=np.int64)
    parts = [(k, a, z, ids[k]) for k, a, z in ((none, zero[none], lengths[none] - SPAN), (left, zero[left], low[left] - 1), (right, high[right] + 1, lengths[right] - SPAN))]
    rest, at = rest[np.argsort(anchor[rest], kind="stable")], 0
    while at < len(rest):  # strings of one anchor stay together; small collections stay in a processor's cache
        end = int(np.searchsorted(anchor[rest], anchor[rest[min(at + COLLECTION, len(rest)) - 1]], side="right"))
        some = rest[at:end]
        s, first, last, value = _ordered_least([strings[k][a:z] for k, a, z in zip(some.tolist(), low[some].tolist(), (high[some] + SPAN).tolist())], ids[some], folder)
        s = some[s]
        parts.append((s, first + low[s], last + low[s], value))
        at = end
    s, first, last, value = (np.concatenate(x) for x in zip(*parts))
    order = np.lexsort((first, s))
    return s[order], first[order], last[order], value[order]


def _ordered_least(strings: list[bytes], ids: np.ndarray, folder: str | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    lengths = np.array([len(s) for s in strings], dtype=np.int64)
    symbols = np.frombuffer(b"".join(strings), dtype=np.uint8)
    group, parts = -1, []  # places between two values below SPAN share their window
    least = np.empty(0, dtype=np.int64)
    for _, lcp, who, size in build(symbols, lengths, folder):
        cut = lcp < SPAN
        number = group + np.cumsum(cut)
        start = np.flatnonzero(np.concatenate(([True], number[1:] != number[:-1]))) if len(number) else np.empty(0, dtype=np.int64)
        of = np.minimum.reduceat(ids[who], start) if len(start) else np.empty(0, dtype=np.int64)
        if len(number) and not cut[0]:  # goes on from the piece before
            least[-1], of = min(least[-1], of[0]), of[1:]
        least = np.concatenate((least, of))
        group = int(number[-1]) if len(number) else group
        window = np.flatnonzero(size >= SPAN)
        parts.append((who[window].astype(np.int64), lengths[who[window]] - size[window], number[window]))
    s, offset, number = (np.concatenate(x) for x in zip(*parts))
    value = least[number]
    order = np.lexsort((offset, s))
    s, offset, value = s[order], offset[order], value[order]
    cut = np.ones(len(s) + 1, dtype=bool)
    cut[1:-1] = (s[1:] != s[:-1]) | (value[1:] != value[:-1])
    at = np.flatnonzero(cut)
    first, last = at[:-1], at[1:] - 1
    return s[first], offset[first], offset[last], value[first]


def _blocks(folder: str, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        ids: list[int | None] = []
        texts: list[bytes] = []
        held, seq = 0, 0

        def flush() -> pa.RecordBatch:
            nonlocal held, seq
            number = part << 24 | seq
            block = Block(np.array([_LAST_ID if d is None else d for d in ids], dtype=np.int64), np.array([d is not None for d in ids], dtype=np.uint8), np.array([len(t) for t in texts], dtype=np.int64), np.frombuffer(b"".join(texts), dtype=np.uint8))
            _write(folder, str(number), block.image())
            bucket, low, several, _ = block.hashes(buckets)
            at = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1]))) if len(bucket) else np.empty(0, dtype=np.int64)
            rows = {"bucket": [-1 - number % buckets], "block": [number], "hashes": [b""], "several": [b""]}
            for a, z in zip(at.tolist(), [*at[1:].tolist(), len(bucket)]):
                rows["bucket"].append(int(bucket[a]))
                rows["block"].append(number)
                rows["hashes"].append(_pack40(low[a:z]))
                rows["several"].append(np.packbits(several[a:z]).tobytes())
            ids.clear()
            texts.clear()
            held, seq = 0, seq + 1
            return pa.RecordBatch.from_pydict(rows, schema=pa.schema([("bucket", pa.int32()), ("block", pa.int64()), ("hashes", pa.binary()), ("several", pa.binary())]))

        for batch in batches:
            for d, t in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.large_binary()).to_pylist()):
                ids.append(d)
                texts.append(t or b"")
                held += len(texts[-1])
                if held >= BLOCK_BYTES:
                    yield flush()
        if ids:
            yield flush()

    return run


def _repeated(t: pa.Table) -> pa.Table:
    """Which of the hashes that blocks sent to a bucket stand in two documents: a bit for each, back to its block."""
    blocks, packed = t.column("block").to_pylist(), t.column("hashes").to_pylist()
    lists = [_unpack40(b) for b in packed]
    every, place, count = np.unique(np.concatenate(lists), return_inverse=True, return_counts=True)
    several = np.concatenate([np.unpackbits(np.frombuffer(s, dtype=np.uint8), count=len(x)) for s, x in zip(t.column("several").to_pylist(), lists)]).astype(bool)
    found = count >= 2
    found[place[several]] = True
    masks = np.split(found[place], np.cumsum([len(x) for x in lists])[:-1])
    return pa.table({"block": pa.array(blocks, pa.int64()), "bucket": t.column("bucket"), "mask": pa.array([np.packbits(x).tobytes() for x in masks], pa.binary())})


def _chosen(block: Block, buckets: int, masks: dict[int, bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    bucket, _, _, place = block.hashes(buckets)
    chosen = np.zeros(len(bucket), dtype=bool)
    for k, mask in masks.items():
        if k >= 0:
            a, z = np.searchsorted(bucket, (k, k + 1))
            chosen[a:z] = np.unpackbits(np.frombuffer(mask, dtype=np.uint8), count=z - a).astype(bool)
    return chosen, place, bucket


def _strings(folder: str, buckets: int):
    def run(t: pa.Table) -> pa.Table:
        number = t.column("block")[0].as_py()
        block = Block.read(folder, number)
        masks = dict(zip(t.column("bucket").to_pylist(), t.column("mask").to_pylist()))
        chosen, place, bucket = _chosen(block, buckets, masks)
        held, least, most, own = block.strings(chosen, place, bucket)
        # where each string stands in the block, for the last pass: how often, and its first windows
        runs = np.flatnonzero(own >= 0)
        runs = runs[np.argsort(own[runs], kind="stable")]
        count = np.bincount(own[runs], minlength=len(held))
        _write(folder, f"{number}.runs", zstandard.ZstdCompressor(level=1).compress(b"".join(x.astype("<i8").tobytes() for x in (np.array([len(held)]), count, block.first[runs]))))
        press = zstandard.ZstdCompressor(level=1)
        rows = {"bucket": [], "block": [], "start": [], "lengths": [], "symbols": [], "ids": []}
        data, owner = block.b.tobytes(), bucket[place[held]]
        cuts = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1]))) if len(owner) else owner
        for a, z in zip(cuts.tolist(), [*cuts[1:].tolist(), len(owner)]):
            first, end = block.first[held[a:z]], block.last[held[a:z]] + SPAN
            rows["bucket"].append(int(owner[a]))
            rows["block"].append(number)
            rows["start"].append(a)
            rows["lengths"].append((end - first).astype(np.uint8).tobytes())
            rows["symbols"].append(press.compress(b"".join(data[x:y] for x, y in zip(first.tolist(), end.tolist()))))
            rows["ids"].append(np.stack((least[a:z], most[a:z]), axis=1).astype("<i8").tobytes())
        return pa.table(rows, schema=pa.schema([("bucket", pa.int32()), ("block", pa.int64()), ("start", pa.int64()), ("lengths", pa.binary()), ("symbols", pa.binary()), ("ids", pa.binary())]))

    return run


def _answers(t: pa.Table, folder: str) -> pa.Table:
    """A bucket's strings to runs of windows that an earlier document holds, for each block that asked."""
    press, sizes = zstandard.ZstdDecompressor(), t.column("lengths").to_pylist()
    lengths, ids = np.frombuffer(b"".join(sizes), dtype=np.uint8).astype(np.int64), np.frombuffer(b"".join(t.column("ids").to_pylist()), dtype="<i8").reshape(-1, 2)
    data, ends = bytearray(), np.cumsum(lengths)
    for x in t.column("symbols"):
        data += press.decompress(x.as_py())
    number, some = distinct(np.frombuffer(data, dtype=np.uint8), ends - lengths, ends)
    known = [bytes(data[a:z]) for a, z in zip((ends - lengths)[some].tolist(), ends[some].tolist())]
    del data
    ids_of = np.full(len(known), _LAST_ID)
    np.minimum.at(ids_of, number, ids[:, 0])
    string, first, last, value = least_ids(known, ids_of, folder)
    asked = zip(t.column("block").to_pylist(), t.column("start").to_pylist(), *(np.split(x, np.cumsum([len(x) for x in sizes])[:-1]) for x in (number, ids[:, 1])))
    runs = np.bincount(string, minlength=len(known))
    at = np.cumsum(runs) - runs
    out = {"block": [], "string": [], "first": [], "last": [], "least": []}
    for block, start, numbers, most in asked:
        n = runs[numbers]
        mine = np.repeat(np.arange(len(numbers)), n)
        r = np.repeat(at[numbers], n) + np.arange(len(mine)) - np.repeat(np.cumsum(n) - n, n)
        keep = value[r] < most[mine]
        mine, r = mine[keep], r[keep]
        if len(r):
            out["block"].append(block)
            out["string"].append((start + mine).astype("<i8").tobytes())
            out["first"].append(first[r].astype(np.uint8).tobytes())
            out["last"].append(last[r].astype(np.uint8).tobytes())
            out["least"].append(value[r].astype("<i8").tobytes())
    return pa.table(out, schema=pa.schema([("block", pa.int64()), *((c, pa.binary()) for c in ("string", "first", "last", "least"))]))


def _cut(folder: str):
    def run(blocks: pa.Table, answers: pa.Table) -> pa.Table:
        number = blocks.column("block")[0].as_py()
        doc_ids, named_, lengths, text = _texts(folder, number)
        covered = np.zeros(len(text) + 1, dtype=np.int32)
        if answers.num_rows:
            string, first, last, least = (
                np.concatenate([np.frombuffer(x, dtype=kind) for x in answers.column(c).to_pylist()]).astype(np.int64)
                for c, kind in (("string", "<i8"), ("first", np.uint8), ("last", np.uint8), ("least", "<i8"))
            )
            data = np.frombuffer(_read(folder, f"{number}.runs"), "<i8")
            count, windows = data[1 : 1 + data[0]], data[1 + data[0] :]
            a, n = (np.cumsum(count) - count)[string], count[string]
            answer = np.repeat(np.arange(len(string)), n)
            which = windows[np.repeat(a, n) + np.arange(len(answer)) - np.repeat(np.cumsum(n) - n, n)]
            earlier = least[answer] < doc_ids[np.searchsorted(np.cumsum(lengths), which, side="right")]
            answer, which = answer[earlier], which[earlier]
            np.add.at(covered, which + first[answer], 1)
            np.add.at(covered, which + last[answer] + SPAN, -1)
        gone = np.cumsum(covered[:-1], dtype=np.int32, out=covered[:-1]) > 0
        rows = {"doc_id": [], "n_bytes": [], "spans": [], "kept": []}
        end = 0
        for d, named, n in zip(doc_ids.tolist(), named_.tolist(), lengths.tolist()):
            b, g = text[end : end + n], gone[end : end + n]
            end += n
            edges = np.flatnonzero(np.diff(np.concatenate(([False], g, [False])).astype(np.int8)))
            rows["doc_id"].append(d if named else None)
            rows["n_bytes"].append(n)
            rows["spans"].append(edges.tolist())
            rows["kept"].append(hashlib.sha256(b[~g].tobytes()).hexdigest())
        return pa.table(rows, schema=pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("spans", pa.list_(pa.int64())), ("kept", pa.string())]))

    return run


def repeated_spans(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, spans, kept_sha256), one row for each row of docs; spans holds start and end bytes by turns."""
    spark = docs.sparkSession
    ship(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets, folder = max(16, -(-int(total) // BUCKET_BYTES)), common.new_path(spark, "suffix-blocks")
    # the work of a group is in its texts, not in the rows that name them, so partitions are not merged by their bytes; each bucket
    # has its own, and there are twice as many as blocks, so that few hold more than one
    parts, places = min(buckets, PARTITIONS), min(max(16, -(-2 * int(total) // BLOCK_BYTES)), PARTITIONS)
    files = f"{folder}-rounds"
    sent = rows.mapInArrow(_blocks(folder, buckets), "bucket int, block long, hashes binary, several binary")
    masks = common.materialize(sent.repartitionById(parts, "bucket").groupBy("bucket").applyInArrow(_repeated, "block long, bucket int, mask binary"), "suffix-masks")
    asked = masks.repartition(places, "block").groupBy("block").applyInArrow(_strings(folder, buckets), "bucket int, block long, start long, lengths binary, symbols binary, ids binary")
    answers = asked.repartitionById(parts, "bucket").groupBy("bucket").applyInArrow(lambda t: _answers(t, files), "block long, string binary, first binary, last binary, least binary")
    answers = common.materialize(answers, "suffix-answers")
    every = masks.filter(F.col("bucket") < 0).select("block")  # each block has one row of its own
    cut = every.repartition(places, "block").groupBy("block").cogroup(answers.repartition(places, "block").groupBy("block")).applyInArrow(_cut(folder), "doc_id long, n_bytes long, spans array<long>, kept string")
    return cut.withColumnRenamed("kept", "kept_sha256")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repeated_spans(common.read_table(spark, sf_dir, "documents"))
    length = F.aggregate(F.transform("spans", lambda x, i: F.when(i % 2 == 0, -x).otherwise(x)), F.lit(0).cast("long"), lambda a, x: a + x)
    return found.select("doc_id", "n_bytes", length.alias("n_removed"), (F.size("spans") / 2).cast("long").alias("n_spans"), "kept_sha256")
