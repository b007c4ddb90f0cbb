"""Bit packing, bit transposition and zero-byte removal on NumPy arrays, for use inside Arrow functions."""

from __future__ import annotations

import numpy as np

CHUNK = 16384


def pack(codes: np.ndarray, bits: int) -> bytes:
    """Codes of any width, most significant bit first, padded with zeros to a byte."""
    codes = np.asarray(codes, dtype=np.uint64)
    places = np.arange(bits - 1, -1, -1, dtype=np.uint64)
    return np.packbits(((codes[:, None] >> places) & np.uint64(1)).astype(np.uint8).ravel()).tobytes()


def unpack(data: bytes, bits: int, n: int) -> np.ndarray:
    flat = np.unpackbits(np.frombuffer(data, dtype=np.uint8), count=n * bits).reshape(n, bits).astype(np.uint64)
    return (flat << np.arange(bits - 1, -1, -1, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)


def pack_fast(codes: np.ndarray, bits: int) -> bytes:
    """Widths 4, 8, 16 and 32: two to a byte with the first in the high half, or little-endian words."""
    if bits == 4:
        c = np.asarray(codes, dtype=np.uint8)
        c = np.append(c, np.uint8(0)) if len(c) % 2 else c
        return (c[0::2] << 4 | c[1::2]).tobytes()
    return np.asarray(codes).astype({8: "<u1", 16: "<u2", 32: "<u4"}[bits]).tobytes()


def unpack_fast(data: bytes, bits: int, n: int) -> np.ndarray:
    if bits == 4:
        b = np.frombuffer(data, dtype=np.uint8)
        return np.stack((b >> 4, b & 15), axis=1).ravel()[:n].astype(np.uint32)
    return np.frombuffer(data, dtype={8: "<u1", 16: "<u2", 32: "<u4"}[bits], count=n).astype(np.uint32)


def transpose_bits(words: np.ndarray) -> np.ndarray:
    """Groups of 32 words as 32 bit planes, the plane of the highest bits of all groups first. Words beyond the last
    whole group stay where they are."""
    whole = len(words) // 32 * 32
    bits = np.unpackbits(words[:whole].astype(">u4").view(np.uint8)).reshape(-1, 32, 32)
    planes = np.packbits(bits.transpose(2, 0, 1).reshape(-1)).view(">u4").astype(np.uint32)
    return np.concatenate((planes, words[whole:]))


def restore_bits(words: np.ndarray) -> np.ndarray:
    whole = len(words) // 32 * 32
    bits = np.unpackbits(words[:whole].astype(">u4").view(np.uint8)).reshape(32, -1, 32)
    return np.concatenate((np.packbits(bits.transpose(1, 2, 0).reshape(-1)).view(">u4").astype(np.uint32), words[whole:]))


def _marks(present: np.ndarray, size: int) -> np.ndarray:
    flags = np.zeros(size * 8, dtype=bool)
    flags[: len(present)] = present
    return np.packbits(flags, bitorder="little")


def _changes(bitmap: np.ndarray) -> np.ndarray:
    """Whether a byte differs from the one before (0 before the first)."""
    return bitmap != np.concatenate(([0], bitmap[:-1]))


#: The sizes of the levels of a chunk's bitmap, in bytes.
LEVELS = (2048, 256, 32, 4)


def drop_zeros(data: bytes) -> bytes | None:
    """The nonzero bytes, then a bitmap of where they stand; a bitmap's bytes that repeat are dropped likewise, level by
    level, down to 4 bytes; then the old size. None if that is no smaller than a chunk."""
    b = np.frombuffer(data, dtype=np.uint8)
    out = [b[b != 0]]
    if len(out[0]):
        level = _marks(b != 0, LEVELS[0])
        for size in LEVELS[1:]:
            changed = _changes(level)
            out.append(level[changed])
            level = _marks(changed, size)
        out.append(level)
    body = np.concatenate(out).tobytes() + len(b).to_bytes(2, "little")
    return body if len(body) < CHUNK else None


def restore_zeros(data: bytes) -> bytes:
    size = int.from_bytes(data[-2:], "little")
    body = np.frombuffer(data[:-2], dtype=np.uint8)
    out = np.zeros(size, dtype=np.uint8)
    if len(body):
        end = len(body) - LEVELS[-1]
        level = body[end:]
        for n in reversed(LEVELS[:-1]):
            changed = np.unpackbits(level, bitorder="little", count=n).astype(bool)
            kept = int(changed.sum())
            values = body[end - kept : end]
            end -= kept
            place = np.cumsum(changed)
            level = np.concatenate((np.zeros(1, dtype=np.uint8), values))[place]
        out[np.unpackbits(level, bitorder="little", count=size).astype(bool)] = body[:end]
    return out.tobytes()


def rotate_sign(bits: np.ndarray) -> np.ndarray:
    """The lossless transform of 32-bit floats: exponent re-biased so that values near 1 are small, the sign as the
    lowest bit; equal to a zigzag of the signed magnitude about 1.0."""
    bits = np.asarray(bits, dtype=np.uint32)
    magnitude, sign = bits & np.uint32(0x7FFFFFFF), bits >> np.uint32(31)
    about = (magnitude - np.uint32(0x3F800000)) & np.uint32(0x7FFFFFFF)
    return about << np.uint32(1) | sign


def restore_sign(words: np.ndarray) -> np.ndarray:
    words = np.asarray(words, dtype=np.uint32)
    return ((words >> np.uint32(1)) + np.uint32(0x3F800000)) & np.uint32(0x7FFFFFFF) | (words & np.uint32(1)) << np.uint32(31)
