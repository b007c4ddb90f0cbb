"""Byte containers of coded fields: serialisers and parsers. Inside the engine the same data are typed rows."""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import BinaryType, StructField, StructType

from ..functions import words
from ..model import CHUNK_VALUES, DEFAULT_TIERS, Tier, side_info_bytes
from ..runtime import ship

#: The names that containers begin with.
TIERED, BLOCKED, SCALED = b"VFC1", b"VFB2", b"ZFP+"
#: Fields whose values are one batch.
_AT_ONCE = 500


@dataclass
class TierPart:
    tier: Tier
    indices: np.ndarray
    vmin: float
    vmax: float
    packed: bytes


@dataclass
class TieredField:
    shape: tuple[int, ...]
    parts: list[TierPart] = field(default_factory=list)


def write_tiered(f: TieredField) -> bytes:
    out = [TIERED, struct.pack(f"<B{len(f.shape)}QB", len(f.shape), *f.shape, len(f.parts))]
    for p in f.parts:
        at = np.asarray(p.indices, dtype="<u4").tobytes()
        out += [struct.pack("<ffBQdd", p.tier.lo, p.tier.hi, p.tier.bits, len(p.indices), p.vmin, p.vmax), struct.pack("<Q", len(at)), at, struct.pack("<Q", len(p.packed)), p.packed]
    return b"".join(out)


def read_tiered(data: bytes) -> TieredField:
    if data[:4] != TIERED:
        raise ValueError("not a tiered container")
    n, at = data[4], 5
    shape = struct.unpack_from(f"<{n}Q", data, at)
    at += 8 * n
    parts, count = [], data[at]
    at += 1
    for _ in range(count):
        lo, hi, bits, _, vmin, vmax = struct.unpack_from("<ffBQdd", data, at)
        at += struct.calcsize("<ffBQdd")
        pieces = []
        for _ in range(2):
            (size,) = struct.unpack_from("<Q", data, at)
            pieces.append(data[at + 8 : at + 8 + size])
            at += 8 + size
        parts.append(TierPart(Tier(lo, hi, bits), np.frombuffer(pieces[0], dtype="<u4").astype(np.int64), vmin, vmax, pieces[1]))
    return TieredField(tuple(shape), parts)


def restore_tiered(f: TieredField) -> np.ndarray:
    """The values of a parsed container, flat."""
    out = np.zeros(int(np.prod(f.shape)), dtype=np.float32)
    for p in f.parts:
        n, bits = len(p.indices), p.tier.bits
        if bits >= 32:
            out[p.indices] = np.frombuffer(p.packed, dtype="<f4")
        elif p.vmax - p.vmin < 1e-12:
            out[p.indices] = p.vmin
        else:
            out[p.indices] = (p.vmin + words.unpack_fast(p.packed, bits, n).astype(np.float64) / ((1 << bits) - 1) * (p.vmax - p.vmin)).astype(np.float32)
    return out


def write_chunked(sizes: list[int], payloads: list[bytes], original: int, bound: float | None, targets: list[float]) -> bytes:
    """A header of 16 bytes with the bound, or of 8 without; a 16-bit size for each chunk; chunks; kept invariants."""
    head = struct.pack("<q", original) + (struct.pack("<f4x", bound) if bound is not None else b"")
    return head + np.array([s % 65536 for s in sizes], dtype="<u2").tobytes() + b"".join(payloads) + struct.pack(f"<{len(targets)}d", *targets)


def read_chunked(data: bytes, with_bound: bool, mode: int) -> tuple[int, float | None, list[bytes], list[float]]:
    (original,) = struct.unpack_from("<q", data)
    bound = struct.unpack_from("<f", data, 8)[0] if with_bound else None
    at, chunks = 16 if with_bound else 8, -(-original // (4 * CHUNK_VALUES))
    sizes = np.frombuffer(data, dtype="<u2", count=chunks, offset=at).astype(int)
    at += 2 * chunks
    payloads = []
    for s in sizes:
        payloads.append(data[at : at + s])
        at += s
    kept = side_info_bytes(mode) // 8
    return original, bound, payloads, list(struct.unpack_from(f"<{kept}d", data, at))


def write_scaled(alpha: float, body: bytes) -> bytes:
    """A factor in 64 bits before another codec's bytes."""
    return SCALED + struct.pack("<dQ", alpha, len(body)) + body


def read_scaled(data: bytes) -> tuple[float, bytes]:
    if data[:4] != SCALED:
        raise ValueError("not a scaled container")
    alpha, n = struct.unpack_from("<dQ", data, 4)
    return alpha, data[20 : 20 + n]


def write_blocked(shape: tuple[int, ...], size: int, correctable: int, alpha: float, blocks: tuple[int, int, int], records: list[tuple[int, int, float, float, bytes]]) -> bytes:
    """records: (mode, bits, lo, hi, codes) of each block in C order; modes 1 and 2 have no bits field. The factor is kept in
    64 bits, so that decoding restores the energy as far as the values can hold it."""
    head = BLOCKED + struct.pack(f"<B{len(shape)}QBBd3Q", len(shape), *shape, size, correctable, alpha, *blocks)
    return head + b"".join(_record(*r) for r in records)


def _record(mode: int, bits: int, lo: float, hi: float, codes: bytes) -> bytes:
    return (struct.pack("<Bff", mode, lo, hi) if mode in (1, 2) else struct.pack("<BBff", mode, bits, lo, hi)) + codes


def _coded_block(values: np.ndarray, mode: int, bits: int, lo: float, hi: float, mean: float) -> tuple[int, int, float, float, bytes]:
    if mode == 2:
        return mode, bits, lo, hi, values.astype("<f4").tobytes()
    if mode == 1:
        return mode, bits, mean, mean, b""
    top = (1 << bits) - 1
    level = np.rint((values.astype(np.float64) - lo) / (hi - lo) * top) if hi - lo >= 1e-12 else np.zeros(len(values))
    return mode, bits, lo, hi, words.pack_fast(np.clip(level, 0, top).astype(np.uint32), bits)


def blocked_record(values: np.ndarray, mode: int, bits: int, lo: float, hi: float, mean: float) -> bytes:
    """The record of one block of values in C order."""
    return _record(*_coded_block(values, mode, bits, lo, hi, mean))


def _blocked_head(data: bytes) -> tuple[tuple[int, ...], int, int, float, list[int], int]:
    """(shape, block size, correctable width, factor, counts of blocks, where the records begin)"""
    if data[:4] != BLOCKED:
        raise ValueError("not a blocked container")
    n = data[4]
    size, correctable, alpha, *blocks = struct.unpack_from("<BBd3Q", data, 5 + 8 * n)
    return struct.unpack_from(f"<{n}Q", data, 5), size, correctable, alpha, blocks, 5 + 8 * n + struct.calcsize("<BBd3Q")


def read_blocked(data: bytes) -> tuple[tuple[int, ...], int, float, list[tuple[int, int, float, float, bytes]]]:
    """(shape, block size, factor, records) of a container of whole blocks."""
    shape, size, _, alpha, blocks, at = _blocked_head(data)
    records = []
    for _ in range(int(np.prod(blocks))):
        mode, bits = data[at], 0
        if mode in (1, 2):
            lo, hi = struct.unpack_from("<ff", data, at + 1)
            at += 9
        else:
            bits, lo, hi = struct.unpack_from("<Bff", data, at + 1)
            at += 10
        count = size**3 // (8 if mode == 3 else 1)
        length = {1: 0, 2: 4 * size**3}.get(mode, -(-count * bits // 8))
        records.append((mode, bits, lo, hi, data[at : at + length]))
        at += length
    return tuple(shape), size, alpha, records


def _interpolated(coarse: np.ndarray, size: int) -> np.ndarray:
    """A coarse cube on the finer places between its ends, axis by axis."""
    at = np.linspace(0, len(coarse) - 1, size)
    lo = np.minimum(at.astype(int), len(coarse) - 1)
    hi, part = np.minimum(lo + 1, len(coarse) - 1), at - lo
    for axis in range(3):
        weight = part.reshape([-1 if k == axis else 1 for k in range(3)])
        coarse = np.take(coarse, lo, axis) * (1 - weight) + np.take(coarse, hi, axis) * weight
    return coarse


def restore_blocked(data: bytes) -> np.ndarray:
    """The field of a blocked container, its padding cut off, with the factor on the blocks of correctable width."""
    _, _, correctable, _, blocks, _ = _blocked_head(data)
    shape, size, alpha, records = read_blocked(data)
    out = np.zeros([size * n for n in blocks], dtype=np.float32)
    for k, (mode, bits, lo, hi, codes) in enumerate(records):
        if mode == 2:
            cube = np.frombuffer(codes, "<f4").astype(np.float64).reshape((size,) * 3)
        elif mode == 1:
            cube = np.full((size,) * 3, lo)
        else:
            side = size // 2 if mode == 3 else size
            level = words.unpack_fast(codes, bits, side**3).astype(np.float64) / ((1 << bits) - 1)
            cube = (lo + level * (hi - lo) if hi - lo >= 1e-12 else np.full(side**3, lo)).reshape((side,) * 3)
            cube = _interpolated(cube, size) if mode == 3 else cube
        cube = cube.astype(np.float32)
        if mode == 1 or mode != 2 and bits <= correctable:  # a mean stands for a block of the lowest width
            cube = (alpha * cube.astype(np.float64)).astype(np.float32)
        corner = [size * c for c in np.unravel_index(k, blocks)]
        out[tuple(slice(c, c + size) for c in corner)] = cube
    return out[tuple(slice(0, n) for n in shape)]


def pack_fields(rows: DataFrame, keys: list[str], order: list[str], pack: Callable[[pa.Table, np.ndarray, np.ndarray], Sequence[bytes]]) -> DataFrame:
    """(*keys, container) of many small fields. pack takes tables of many whole fields, each in order, with where they begin and
    end, and gives a container for each: a task pays for values, not for groups. Rows that are dealt by keys are not dealt again."""
    spark = rows.sparkSession
    ship(spark)
    out = StructType([f for f in rows.schema.fields if f.name in keys] + [StructField("container", BinaryType())])
    # numbers within a field, which say where it begins
    numbered = rows.withColumn("_at", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    arrow = to_arrow_schema(out)

    def packed(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(held)
        at = t.column("_at").to_numpy()
        starts = np.flatnonzero(at == 1)
        ends = np.append(starts[1:], len(at))
        if not (at == np.arange(1, len(at) + 1) - np.repeat(starts, ends - starts)).all():
            raise ValueError("rows of a field are not together or not in order")
        made = pa.table({**{k: t.column(k).take(pa.array(starts)) for k in keys}, "container": pack(t, starts, ends)})
        return made.select(arrow.names).cast(arrow).combine_chunks().to_batches()[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for b in batches:
            starts = np.flatnonzero(b.column("_at").to_numpy() == 1)
            if len(starts):
                if starts[-1]:
                    held.append(b.slice(0, starts[-1]))
                if held:
                    yield packed(held)
                held = [b.slice(starts[-1])]
            elif b.num_rows:
                held.append(b)
        if held:
            yield packed(held)

    return numbered.mapInArrow(run, out)


def unpack_fields(packed: DataFrame, restore: Callable[[object], np.ndarray]) -> DataFrame:
    """(vec_id, i, x): the flat values that restore makes of the second column, beside the first; many fields in a batch."""
    ship(packed.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first in range(0, b.num_rows, _AT_ONCE):
                part = b.slice(first, _AT_ONCE)
                x = [restore(v) for v in part.column(1).to_pylist()]
                counts = [len(v) for v in x]
                ids = part.column(0).take(pa.array(np.repeat(np.arange(len(x)), counts)))
                yield pa.RecordBatch.from_arrays([ids, pa.array(np.concatenate([np.arange(n) for n in counts])), pa.array(np.concatenate(x))], names=["vec_id", "i", "x"])

    return packed.mapInArrow(run, "vec_id long, i long, x float")


def blocked_containers(coded: DataFrame, keys: list[str], shape: tuple[int, int, int], size: int, alpha: DataFrame, correctable: int) -> DataFrame:
    """(*keys, container) of quantized whole blocks (keys, b0..b2, r0..r2, x, mode, bits, vmin, vmax, vmean), modes 0 to 2.
    alpha: (*keys, alpha). A field's bytes are one value; the typed rows are the form for larger fields."""
    blocks = tuple(-(-n // size) for n in shape)

    def pack(t: pa.Table, starts: np.ndarray, ends: np.ndarray) -> list[bytes]:
        if ((ends - starts) % size**3).any():
            raise ValueError("fields of whole blocks are needed")
        x = t.column("x").to_numpy().reshape(-1, size**3)
        first = [t.column(c).to_numpy()[:: size**3].tolist() for c in ("mode", "bits", "vmin", "vmax", "vmean")]
        records = [_coded_block(*r) for r in zip(x, *first)]
        alphas = t.column("alpha").to_numpy()[starts].tolist()
        return [write_blocked(shape, size, correctable, a, blocks, records[s:e]) for a, s, e in zip(alphas, (starts // size**3).tolist(), (ends // size**3).tolist())]

    rows = coded.join(alpha.select(*keys, "alpha"), keys).select(*keys, "b0", "b1", "b2", "r0", "r1", "r2", "x", "mode", "bits", "vmin", "vmax", "vmean", "alpha")
    return pack_fields(rows, keys, ["b0", "b1", "b2", "r0", "r1", "r2"], pack)


def tiered_containers(coded: DataFrame, shape: tuple[int, ...], tiers: tuple[Tier, ...] = DEFAULT_TIERS) -> DataFrame:
    """(field_id, container) from coded rows (field_id, i, x, tier, code): one field's bytes are one value, so fields are
    bounded by what a container may hold; the typed rows are the form for larger ones."""

    def pack(t: pa.Table, starts: np.ndarray, ends: np.ndarray) -> list[bytes]:
        tier, i, x = (t.column(c).to_numpy() for c in ("tier", "i", "x"))
        code = np.nan_to_num(t.column("code").to_numpy().astype(np.float64)).astype(np.uint32)
        out = []
        for s, e in zip(starts.tolist(), ends.tolist()):
            cuts = (s + np.searchsorted(tier[s:e], range(len(tiers) + 1))).tolist()  # by tier, as rows are in its order
            parts = []
            for spec, a, b in zip(tiers, cuts, cuts[1:]):
                packed = x[a:b].astype("<f4").tobytes() if spec.bits >= 32 else words.pack_fast(code[a:b], spec.bits)
                parts.append(TierPart(spec, i[a:b], float(x[a:b].min()) if b > a else 0.0, float(x[a:b].max()) if b > a else 0.0, packed))
            out.append(write_tiered(TieredField(shape, parts)))
        return out

    rows = coded.select("field_id", F.col("i").cast("long").alias("i"), "x", F.col("tier").cast("int").alias("tier"), F.col("code").cast("double").alias("code"))
    return pack_fields(rows, ["field_id"], ["tier", "i"], pack).select(F.col("field_id").cast("string").alias("field_id"), "container")


def tiered_bytes(dimensions: int, counts: dict[int, int]) -> int:
    """The size of a tiered container by the number of values of each bit width."""
    return 4 + 1 + 8 * dimensions + 1 + sum(struct.calcsize("<ffBQdd") + 16 + 4 * n + -(-n * bits // 8) for bits, n in counts.items())
