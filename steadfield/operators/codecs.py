"""The codec protocol, codecs that are column expressions, byte-level codecs for chunks, and the entropy bound."""

from __future__ import annotations

import math
import struct
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import bits as B
from ..functions import words
from ..functions.numeric import AbsQuantizer, PowerQuantizer, bits_needed, f32, floor_quantize, uniform_quantize
from ..model import CHUNK_VALUES, SUBCHUNK_VALUES, Invariant
from ..runtime import ship
from ..sources import containers
from . import chunks


class Codec(Protocol):
    """A codec turns values into reconstructions within a bound, and tells the bytes that it takes for a field."""

    name: str

    def recon(self, x: Column, bound: float) -> Column: ...

    def size(self, field: DataFrame, bound: float, mode: int = 0) -> DataFrame: ...


class FloorCodec:
    name = "floor"

    def recon(self, x: Column, bound: float) -> Column:
        return f32(floor_quantize(x, bound))

    def size(self, field: DataFrame, bound: float, mode: int = 0) -> DataFrame:
        return PowerCodec().size(field.withColumn("x", self.recon(F.col("x"), bound)), bound / 2, mode)


class UniformCodec(FloorCodec):
    name = "uniform"

    def recon(self, x: Column, bound: float) -> Column:
        return f32(uniform_quantize(x, 2 * bound))


class PowerCodec:
    """Power-of-two bins and the least width for each subchunk of 128 codes; its size is an aggregate."""

    name = "power"
    header = 8

    def recon(self, x: Column, bound: float) -> Column:
        return f32(PowerQuantizer(bound).recon(x))

    def sizes(self, field: DataFrame, bound: float, keys: list[str] | None = None) -> DataFrame:
        """(*keys, chunk, osize, csize); a value that is kept whole takes 32 bits."""
        code = F.coalesce(PowerQuantizer(bound).code(F.col("x")), F.lit(0xFFFFFFFF).cast("long"))
        return chunks.packed_sizes(chunks.sub_bits(chunks.with_chunks(field.withColumn("code", code)), keys=keys), keys)

    def size(self, field: DataFrame, bound: float, mode: int = 0, keys: list[str] | None = None) -> DataFrame:
        return chunks.file_sizes(self.sizes(field, bound, keys), self.header, mode, keys)

    def sizes_at(self, field: DataFrame, bounds: list[float], keys: list[str] | None = None) -> DataFrame:
        """(*keys, bound, original, bytes) at several bounds from one pass: the widest codes of a subchunk at all bounds are
        columns of one aggregation, and only its rows are multiplied."""
        keys = keys or ["field_id"]
        code = [F.coalesce(PowerQuantizer(b).code(F.col("x")), F.lit(0xFFFFFFFF).cast("long")) for b in bounds]
        widest = chunks.with_chunks(field).groupBy(*keys, "chunk", "sub").agg(F.count(F.lit(1)).alias("n"), *(F.max(c).alias(f"_m{k}") for k, c in enumerate(code)))
        each = F.explode(F.array(*(F.struct(F.lit(float(b)).alias("bound"), bits_needed(F.col(f"_m{k}")).alias("bits")) for k, b in enumerate(bounds))))
        subs = widest.select(*keys, "chunk", "sub", "n", each.alias("_b")).select(*keys, "chunk", "sub", "n", "_b.*")
        return chunks.file_sizes(chunks.packed_sizes(subs, [*keys, "bound"]), self.header, keys=[*keys, "bound"])


CODECS: dict[str, Codec] = {c.name: c for c in (FloorCodec(), UniformCodec(), PowerCodec())}


def register(codec: Codec) -> None:
    """Makes a further codec known by its name, as for libraries that are not there everywhere."""
    CODECS[codec.name] = codec


# Chunks as bytes: one group of at most 4096 values for each (field, chunk).


def encode_planes(x: np.ndarray, bound: float, threshold: float = math.inf) -> bytes:
    """Quantized codes, differences in base -2, bit planes, zero bytes dropped; as they are where that is no gain."""
    q = AbsQuantizer(bound, threshold)
    x = np.asarray(x, dtype="<f4")
    with np.errstate(all="ignore"):
        scaled = x * q.inverse
        bins = np.where(np.isfinite(scaled), np.copysign(np.floor(np.abs(scaled.astype(np.float64)) + 0.5), scaled), 0.0)
        recon = bins.astype(np.float32) * q.width
        whole = np.isnan(x) | ~np.isfinite(scaled) | (np.abs(bins) >= q.MAX_BIN) | (np.abs(x) >= q.threshold) | (np.abs(x - recon) > q.bound)
    b = np.where(whole, 0, bins).astype(np.int32)
    word = np.where(whole, x.view(np.uint32), ((b << 1) ^ (b >> 31)).view(np.uint32))
    difference = word - np.concatenate((np.zeros(1, dtype=np.uint32), word[:-1]))
    s = np.uint32(0xAAAAAAAA)
    planes = words.transpose_bits((difference + s) ^ s)
    body = words.drop_zeros(planes.astype("<u4").tobytes())
    return body if body is not None and len(body) < 4 * len(x) else x.tobytes()


def decode_planes(data: bytes, n: int, bound: float) -> np.ndarray:
    if len(data) == 4 * n:
        return np.frombuffer(data, dtype="<f4").copy()
    q, s = AbsQuantizer(bound), np.uint32(0xAAAAAAAA)
    planes = words.restore_bits(np.frombuffer(words.restore_zeros(data), dtype="<u4"))
    word = np.cumsum((planes ^ s) - s, dtype=np.uint32)
    bins = ((word >> np.uint32(1)) ^ (np.uint32(0) - (word & np.uint32(1)))).view(np.int32)
    return np.where(word < np.uint32(1 << 23), bins.astype(np.float32) * q.width, word.view(np.float32)).astype(np.float32)


def encode_widths(x: np.ndarray, bound: float, bits: int = 32) -> bytes:
    """Power-of-two codes packed with one width for each of 32 subchunks, lowest bits first; whole words keep a flag in
    their top bit. As they are where that is no gain."""
    kind, unsigned, mantissa = (np.float32, np.uint32, 23) if bits == 32 else (np.float64, np.uint64, 52)
    q = PowerQuantizer(bound, mantissa)
    x = np.asarray(x, dtype=kind)
    with np.errstate(all="ignore"):
        n = np.floor(np.abs(x.astype(np.float64)) / (2 * q.power) + 0.5)
        whole = ~np.isfinite(x) | (np.abs(x.astype(np.float64)) >= q.limit)
    n = np.where(whole, 0, n).astype(np.uint64)
    code = np.where(n == 0, np.uint64(0), np.where(x >= 0, 2 * n, 2 * n - np.uint64(1)))
    if whole.any():  # their patterns, turned so that the exponent keeps them apart from codes
        raw = x.view(unsigned).astype(np.uint64)
        turned = ((raw << np.uint64(1)) | (raw >> np.uint64(bits - 1))) & np.uint64((1 << bits) - 1)
        code = np.where(whole, turned, code)
    per = CHUNK_VALUES * 4 // (bits // 8) // 32
    padded = np.zeros(32 * per, dtype=np.uint64)
    padded[: len(code)] = code
    widths = np.array([int(c.max()).bit_length() for c in padded.reshape(32, per)], dtype=np.uint8)
    size = (32 * 8 + int(widths.sum()) * per + 16) // 8
    if size >= 16384 or size >= x.nbytes:
        return x.tobytes()
    out = [widths.tobytes()]
    flat = []
    for c, w in zip(padded.reshape(32, per), widths.tolist()):
        flat.append(((c[:, None] >> np.arange(w, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8).ravel())
    out.append(np.packbits(np.concatenate(flat), bitorder="little").tobytes())
    return b"".join(out) + struct.pack("<H", x.nbytes % 65536)


def decode_widths(data: bytes, n: int, bound: float, bits: int = 32) -> np.ndarray:
    kind, unsigned, mantissa = (np.float32, np.uint32, 23) if bits == 32 else (np.float64, np.uint64, 52)
    if len(data) == n * bits // 8:
        return np.frombuffer(data, dtype=kind).copy()
    q = PowerQuantizer(bound, mantissa)
    per = CHUNK_VALUES * 4 // (bits // 8) // 32
    widths = np.frombuffer(data[:32], dtype=np.uint8).astype(np.int64)
    flat = np.unpackbits(np.frombuffer(data[32:-2], dtype=np.uint8), bitorder="little")
    code, at = np.zeros((32, per), dtype=np.uint64), 0
    for k, w in enumerate(widths.tolist()):
        bits_ = flat[at : at + w * per].reshape(per, w).astype(np.uint64)
        code[k] = (bits_ << np.arange(w, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)
        at += w * per
    code = code.ravel()[:n]
    # a kept pattern turned left by one begins at twice that of the limit, above every code of a value below it
    least_whole = np.uint64(2 * int(np.array([q.limit], dtype=kind).view(unsigned)[0]))
    whole = code >= least_whole
    half = (code + np.uint64(1)) >> np.uint64(1)
    value = np.where(code % np.uint64(2) == 1, -1.0, 1.0) * half.astype(np.float64) * 2 * q.power
    pattern = ((code >> np.uint64(1)) | (code << np.uint64(bits - 1))) & np.uint64((1 << bits) - 1)
    return np.where(whole, pattern.astype(unsigned).view(kind), value.astype(kind)).astype(kind)


def _per_chunk(field: DataFrame, out: str, make: Callable[[np.ndarray], dict]) -> DataFrame:
    """One row for each (field_id, chunk) of field (field_id, i, x): its values in order go to ``make``."""
    ship(field.sparkSession)
    schema = "field_id string, chunk long, " + out

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by("i")
        made = make(t.column("x").to_numpy())
        return pa.table({"field_id": t.column("field_id")[:1], "chunk": t.column("chunk")[:1], **{k: [v] for k, v in made.items()}})

    rows = field.select("field_id", "i", "x", F.floor(F.col("i") / CHUNK_VALUES).cast("long").alias("chunk"))
    return rows.groupBy("field_id", "chunk").applyInArrow(run, schema)


def encode_chunks(field: DataFrame, bound: float, codec: str = "planes") -> DataFrame:
    """(field_id, chunk, osize, csize, payload)"""
    encode = {"planes": encode_planes, "widths": encode_widths}[codec]

    def make(x: np.ndarray) -> dict:
        payload = encode(x, bound)
        return {"osize": 4 * len(x), "csize": len(payload), "payload": payload}

    return _per_chunk(field, "osize long, csize long, payload binary", make)


def decode_chunks(encoded: DataFrame, bound: float, codec: str = "planes") -> DataFrame:
    """(field_id, i, xh)"""
    ship(encoded.sparkSession)
    decode = {"planes": decode_planes, "widths": decode_widths}[codec]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                x = decode(row["payload"], row["osize"] // 4, bound)
                i = row["chunk"] * CHUNK_VALUES + np.arange(len(x))
                yield pa.RecordBatch.from_arrays([pa.array([row["field_id"]] * len(x)), pa.array(i), pa.array(x, pa.float32())], names=["field_id", "i", "xh"])

    return encoded.select("field_id", "chunk", "osize", "payload").mapInArrow(run, "field_id string, i long, xh float")


def compress_scaled(field: DataFrame, bound: float, conserve: bool = True, codec: str = "planes") -> DataFrame:
    """(field_id, alpha, container): each field through a byte codec, with the factor that restores its energy beside. The
    components of a vector are fields of their own, each with its factor. A container is one value; the chunks of
    ``encode_chunks`` are the form for larger fields."""
    ship(field.sparkSession)
    encode, decode = {"planes": (encode_planes, decode_planes), "widths": (encode_widths, decode_widths)}[codec]

    def run(t: pa.Table) -> pa.Table:
        x = t.sort_by("i").column("x").to_numpy()
        parts = [x[a : a + CHUNK_VALUES] for a in range(0, len(x), CHUNK_VALUES)]
        payloads = [encode(p, bound) for p in parts]
        back = np.concatenate([decode(b, len(p), bound) for b, p in zip(payloads, parts)]).astype(np.float64)
        energy = float(back @ back)
        alpha = math.sqrt(float(x.astype(np.float64) @ x.astype(np.float64)) / energy) if conserve and energy >= 1e-30 else 1.0
        body = containers.write_chunked([len(b) for b in payloads], payloads, 4 * len(x), bound, [])
        return pa.table({"field_id": t.column("field_id")[:1], "alpha": [alpha], "container": [containers.write_scaled(alpha, body)]})

    return field.select("field_id", "i", "x").groupBy("field_id").applyInArrow(run, "field_id string, alpha double, container binary")


def decompress_scaled(packed: DataFrame, bound: float, codec: str = "planes") -> DataFrame:
    """(field_id, i, xc) of (field_id, container); i counts from 0."""
    ship(packed.sparkSession)
    decode = {"planes": decode_planes, "widths": decode_widths}[codec]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                alpha, body = containers.read_scaled(r["container"])
                original, _, payloads, _ = containers.read_chunked(body, True, 0)
                for k, b in enumerate(payloads):
                    x = decode(b, min(CHUNK_VALUES, original // 4 - k * CHUNK_VALUES), bound)
                    i = k * CHUNK_VALUES + np.arange(len(x))
                    yield pa.RecordBatch.from_arrays([pa.array([r["field_id"]] * len(x), pa.string()), pa.array(i, pa.int64()), pa.array((alpha * x.astype(np.float64)).astype(np.float32))], names=["field_id", "i", "xc"])

    return packed.select("field_id", "container").mapInArrow(run, "field_id string, i long, xc float")


def entropy_ratio(field: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """(*keys, n, bits, ratio): what an order-0 entropy coder of the four byte planes of 32-bit values would need a value, by
    Shannon's bound, and 32 bits over that; null where all planes are constant. Counts of at most 4 x 256 bytes a field are
    summed in each task first."""
    keys = keys or ["field_id"]
    bits = B.float_to_bits(F.col("x"))
    planes = F.array(*(F.struct(F.lit(k).alias("plane"), F.shiftright(bits, 8 * k).bitwiseAND(F.lit(255).cast("long")).alias("byte")) for k in range(4)))
    counts = field.filter("x is not null").select(*keys, F.explode(planes).alias("p")).groupBy(*keys, "p.plane", "p.byte").agg(F.count(F.lit(1)).alias("c"))
    of_plane = counts.groupBy(*keys, "plane").agg(F.sum("c").alias("n"), F.sum(F.col("c") * F.log2("c")).alias("cl"))
    total = of_plane.groupBy(*keys).agg(F.max("n").alias("n"), F.sum(F.log2("n") - F.col("cl") / F.col("n")).alias("bits"))
    return total.withColumn("ratio", F.when(F.col("bits") > 1e-9, 32 / F.when(F.col("bits") > 1e-9, F.col("bits"))))


def bits_per_value(size: Column, n: Column) -> Column:
    return 8.0 * size / n


def mode_params(field: DataFrame, mode: int, keys: list[str] | None = None) -> DataFrame:
    """The targets that a mode stores, and no other sums: mass, energy or both."""
    sums = []
    if mode & Invariant.MASS:
        sums.append(F.sum(F.col("x").cast("double")).alias("p1"))
    if mode & Invariant.ENERGY:
        sums.append(F.sum(F.col("x").cast("double") * F.col("x").cast("double")).alias("p2"))
    return field.groupBy(*(keys or ["field_id"])).agg(*(sums or [F.count(F.lit(1)).alias("n")]))


def subchunks_per_chunk() -> int:
    return CHUNK_VALUES // SUBCHUNK_VALUES
