"""Containers as files, written and read by many tasks: prefix scans give each piece its place, and pieces are written there.

A writer makes pieces (path, at, data) of typed rows: headers and sizes in column expressions, payloads as they come from
the codec, in groups of a bounded number of values. Pieces are dealt by range of (path, at), so a task writes runs of a
file, one after another. What is written where depends on the data alone, so a task that runs twice writes the same. The
files are those of the single writers in ``containers``, byte for byte, and no task ever holds a field.

Readers take the table of sizes in blocks, scan the blocks' sums and read each block's payloads as one range.

Fields that a group holds, by their stated shape, are packed and written whole, many in a task; larger ones as pieces.

Writing at a place needs files that allow it: the shared folder has to be a mounted one (file://). Chunks, blocks and values
of a field are numbered from 0 without gaps.
"""

from __future__ import annotations

import math
import os
import struct
from collections.abc import Iterator, Sequence
from urllib.parse import quote

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import bits as B
from ..functions import words
from ..model import CHUNK_VALUES, DEFAULT_TIERS, Tier
from ..operators import codecs, scan
from ..operators.correct import attach, hold
from ..runtime import ship
from ..shared import keep
from . import containers

#: Chunks whose sizes are one range of a file, values whose bytes are made in one group, and bytes written at a time.
BLOCK, GROUP, RUN = 1024, 16_384, 4 << 20
#: Bytes of a file whose pieces one task writes.
STRETCH = 64 << 20
_NO_NAME = "%null"


def little_endian(c: Column, size: int) -> Column:
    """The lowest size bytes of a long, lowest first."""
    digits = F.right(F.lpad(F.hex(c.cast("long")), 16, "0"), F.lit(2 * size))
    return F.unhex(F.concat(*(F.substring(digits, 2 * k + 1, 2) for k in reversed(range(size)))))


def literal(data: bytes) -> Column:
    return F.unhex(F.lit(data.hex()))


def path_of(folder: str, field: Column) -> Column:
    """A file for each field, its name quoted; the field without a name has one that no quoted name gives."""
    name = F.regexp_replace(F.url_encode(field.cast("string")), r"\+", "%20")
    return F.concat(F.lit(folder.rstrip("/") + "/"), F.coalesce(name, F.lit(_NO_NAME)), F.lit(".bin"))


def file_name(folder: str, field: object) -> str:
    return f"{folder.rstrip('/')}/{_NO_NAME if field is None else quote(str(field), safe='.-*_')}.bin"


def _local(uri: str) -> str:
    if not uri.startswith("file:"):
        raise ValueError(f"{uri}: pieces are written at their places only in folders that are mounted (file://)")
    return uri.removeprefix("file://").removeprefix("file:")


def write_pieces(pieces: DataFrame) -> DataFrame:
    """Writes pieces (path, at, data) and gives (path, bytes) of the files, one row a file. Runs a job."""
    ship(pieces.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ends: dict[str, int] = {}
        name, handle, at, parts, held = None, -1, 0, [], 0

        def flush() -> None:
            nonlocal parts, held, at
            data, start = b"".join(parts), at
            while data:
                n = os.pwrite(handle, data, start)
                data, start = data[n:], start + n
            at, parts, held = start, [], 0

        for batch in batches:
            for uri, place, data in zip(*(batch.column(k).to_pylist() for k in range(3))):
                if uri != name:
                    if handle >= 0:
                        flush()
                        os.close(handle)
                    target = _local(uri)
                    os.makedirs(os.path.dirname(target), exist_ok=True)
                    name, handle, at = uri, os.open(target, os.O_CREAT | os.O_WRONLY, 0o644), place
                elif place != at + held or held >= RUN:
                    flush()
                    at = place
                parts.append(data)
                held += len(data)
                ends[uri] = max(ends.get(uri, 0), place + len(data))
        if handle >= 0:
            flush()
            os.close(handle)
        yield pa.RecordBatch.from_pydict({"path": list(ends), "end": list(ends.values())}, schema=pa.schema([("path", pa.string()), ("end", pa.int64())]))

    # by stretches and not by ranges, whose bounds would take the pieces to be made twice
    dealt = pieces.select("path", F.col("at").cast("long").alias("at"), "data").repartition("path", F.floor(F.col("at") / STRETCH)).sortWithinPartitions("path", "at")
    return keep(dealt.mapInArrow(run, "path string, end long").groupBy("path").agg(F.max("end").alias("bytes")), "files")


def write_whole(packed: DataFrame, folder: str) -> DataFrame:
    """(field_id, path, bytes): each container (field_id, container) as a file, written by the task that packed it. Runs a job."""
    ship(packed.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = []
            for uri, data in zip(*(batch.column(k).to_pylist() for k in (1, 2))):
                target = _local(uri)
                if not size:
                    os.makedirs(os.path.dirname(target), exist_ok=True)
                handle, at = os.open(target, os.O_CREAT | os.O_WRONLY, 0o644), 0
                while at < len(data):
                    at += os.pwrite(handle, data[at:], at)
                os.close(handle)
                size.append(at)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(size, pa.int64())], names=["field_id", "path", "bytes"])

    named = packed.select(F.col("field_id").cast("string").alias("field_id"), path_of(folder, F.col("field_id")).alias("path"), "container")
    return keep(named.mapInArrow(run, "field_id string, path string, bytes long"), "files")


def _union(parts: Sequence[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def write_chunked(encoded: DataFrame, folder: str, bound: float | None = None, targets: DataFrame | None = None, alpha: DataFrame | None = None) -> DataFrame:
    """(field_id, path, bytes) of the files of encoded (field_id, chunk, osize, csize, payload). targets: (field_id, targets
    array<double>), the kept invariants; alpha: (field_id, alpha), for files that begin with a factor."""
    encoded = keep(encoded.select("field_id", F.col("chunk").cast("long").alias("chunk"), F.col("osize").cast("long").alias("osize"), F.col("csize").cast("long").alias("csize"), "payload"), "chunks")
    per = encoded.groupBy("field_id").agg(F.sum("osize").alias("original"), F.count(F.lit(1)).alias("chunks"), F.sum("csize").alias("body"))
    per = per.join(targets, "field_id", "left") if targets is not None else per.withColumn("targets", F.array().cast("array<double>"))
    per = per.withColumn("targets", F.coalesce("targets", F.array().cast("array<double>")))
    per = hold(per.join(alpha.select("field_id", "alpha"), "field_id") if alpha is not None else per)
    lead, head = 20 if alpha is not None else 0, 16 if bound is not None else 8
    first = lead + head
    begin = little_endian(F.col("original"), 8)
    if bound is not None:
        begin = F.concat(begin, literal(struct.pack("<f4x", bound)))
    if alpha is not None:
        body = F.lit(head) + 2 * F.col("chunks") + F.col("body") + 8 * F.size("targets")
        begin = F.concat(literal(containers.SCALED), little_endian(B.double_to_bits(F.col("alpha")), 8), little_endian(body, 8), begin)
    path = path_of(folder, F.col("field_id")).alias("path")
    sizes = encoded.select("field_id", "chunk", "csize")
    placed = attach(scan.prefix(sizes, ["field_id"], "chunk", F.col("csize"), "offset", BLOCK), per.select("field_id", "chunks"))
    placed = placed.join(encoded.select("field_id", "chunk", "payload").hint("merge"), ["field_id", "chunk"])
    kept = per.select(path, "chunks", "body", F.posexplode("targets").alias("k", "target"))
    pieces = [
        per.select(path, F.lit(0).cast("long").alias("at"), begin.alias("data")),
        sizes.select(path, (F.lit(first) + 2 * F.col("chunk")).alias("at"), little_endian(F.col("csize") % 65536, 2).alias("data")),
        placed.select(path, (F.lit(first) + 2 * F.col("chunks") + F.col("offset")).alias("at"), F.col("payload").alias("data")),
        kept.select("path", (F.lit(first) + 2 * F.col("chunks") + F.col("body") + 8 * F.col("k")).alias("at"), little_endian(B.double_to_bits(F.col("target")), 8).alias("data")),
    ]
    return per.select("field_id", path).join(write_pieces(_union(pieces)), "path").select("field_id", "path", "bytes")


def read_chunked(files: DataFrame, with_bound: bool = True, scaled: bool = False) -> DataFrame:
    """(field_id, chunk, osize, csize, payload, alpha) of files (field_id, path): the rows that ``codecs.decode_chunks`` takes."""
    ship(files.sparkSession)
    lead, block_ = 20 if scaled else 0, BLOCK
    first = lead + (16 if with_bound else 8)

    def heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            original, alpha = [], []
            for uri in batch.column(1).to_pylist():
                with open(_local(uri), "rb") as h:
                    data = h.read(lead + 8)
                if scaled and data[:4] != containers.SCALED:
                    raise ValueError(f"{uri} is not a scaled container")
                alpha.append(struct.unpack_from("<d", data, 4)[0] if scaled else 1.0)
                original.append(struct.unpack_from("<q", data, lead)[0])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(original, pa.int64()), pa.array(alpha, pa.float64())], names=["field_id", "path", "original", "alpha"])

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total = []
            for uri, chunks, block in zip(*(batch.column(k).to_pylist() for k in (1, 4, 5))):
                with open(_local(uri), "rb") as h:
                    total.append(int(_sizes(h, first, chunks, block, block_).sum()))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(total, pa.int64())], names=[*batch.schema.names, "total"])

    def payloads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                with open(_local(r["path"]), "rb") as h:
                    sizes = _sizes(h, first, r["chunks"], r["block"], block_)
                    h.seek(first + 2 * r["chunks"] + r["offset"])
                    data = h.read(int(sizes.sum()))
                ends = np.cumsum(sizes)
                number = r["block"] * block_ + np.arange(len(sizes))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([r["field_id"]] * len(sizes), pa.string()), pa.array(number), pa.array(np.minimum(4 * CHUNK_VALUES, r["original"] - number * 4 * CHUNK_VALUES)), pa.array(sizes),
                        pa.array([data[e - s : e] for s, e in zip(sizes, ends)], pa.binary()), pa.array(np.full(len(sizes), r["alpha"])),
                    ],
                    names=["field_id", "chunk", "osize", "csize", "payload", "alpha"],
                )

    begun = files.select(F.col("field_id").cast("string").alias("field_id"), "path").mapInArrow(heads, "field_id string, path string, original long, alpha double")
    chunks = F.ceil(F.col("original") / (4 * CHUNK_VALUES)).cast("long")
    blocks = begun.withColumn("chunks", chunks).filter("chunks > 0").withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("chunks") - 1) / block_))))
    summed = blocks.repartition("path", "block").mapInArrow(sums, "field_id string, path string, original long, alpha double, chunks long, block long, total long")
    placed = scan.prefix(keep(summed, "chunk-sums"), ["path"], "block", F.col("total"), "offset")
    return placed.select("field_id", "path", "original", "alpha", "chunks", "block", "offset").mapInArrow(payloads, "field_id string, chunk long, osize long, csize long, payload binary, alpha double")


def _sizes(handle, first: int, chunks: int, block: int, per: int) -> np.ndarray:
    handle.seek(first + 2 * block * per)
    return np.frombuffer(handle.read(2 * min(per, chunks - block * per)), "<u2").astype(np.int64)


_PART = struct.calcsize("<ffBQdd")


def write_tiered(coded: DataFrame, folder: str, shape: tuple[int, ...], tiers: Sequence[Tier] = DEFAULT_TIERS) -> DataFrame:
    """(field_id, path, bytes) of tiered containers of coded rows (field_id, i, x, tier, code)."""
    if math.prod(shape) <= GROUP:
        return write_whole(containers.tiered_containers(coded, shape, tiers), folder)
    ship(coded.sparkSession)
    rows = coded.select(F.col("field_id").cast("string").alias("field_id"), F.col("tier").cast("long").alias("tier"), F.col("i").cast("long").alias("i"), "x", F.col("code").cast("double").alias("code"))
    rows = keep(scan.rank(rows, ["field_id", "tier"], "i"), "tier-ranks")
    start = len(containers.TIERED) + 2 + 8 * len(shape)
    spec = F.array(*(F.struct(F.lit(k).cast("long").alias("tier"), F.lit(t.bits).alias("bits"), literal(struct.pack("<ffB", t.lo, t.hi, t.bits)).alias("head")) for k, t in enumerate(tiers)))
    every = rows.groupBy("field_id").agg(F.count(F.lit(1)).alias("n_all")).select("field_id", F.explode(spec).alias("s")).select("field_id", "s.*")
    found = rows.groupBy("field_id", "tier").agg(F.count(F.lit(1)).alias("n"), F.min("x").cast("double").alias("lo"), F.max("x").cast("double").alias("hi"))
    parts = every.join(found, ["field_id", "tier"], "left").fillna(0, ["n"]).fillna(0.0, ["lo", "hi"]).withColumn("packed", F.ceil(F.col("n") * F.col("bits") / 8).cast("long"))
    # a row for each tier of a field
    parts = hold(scan.prefix(parts, ["field_id"], "tier", F.lit(_PART + 16) + 4 * F.col("n") + F.col("packed"), "begin", levels=1).withColumn("begin", F.col("begin") + start))
    path = path_of(folder, F.col("field_id")).alias("path")
    number = lambda c: little_endian(c, 8)
    head = F.concat("head", number(F.col("n")), number(B.double_to_bits(F.col("lo"))), number(B.double_to_bits(F.col("hi"))), number(4 * F.col("n")))
    fixed = [
        parts.filter("tier = 0").select(path, F.lit(0).cast("long").alias("at"), literal(containers.TIERED + struct.pack(f"<B{len(shape)}QB", len(shape), *shape, len(tiers))).alias("data")),
        parts.select(path, F.col("begin").alias("at"), head.alias("data")),
        parts.select(path, (F.col("begin") + _PART + 8 + 4 * F.col("n")).alias("at"), number(F.col("packed")).alias("data")),
    ]

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by("rank")
        bits, begin, n, first, path = (t.column(c)[0].as_py() for c in ("bits", "begin", "n", "rank", "path"))
        x, code = t.column("x").to_numpy(), np.nan_to_num(t.column("code").to_numpy(zero_copy_only=False).astype(np.float64))
        packed = x.astype("<f4").tobytes() if bits >= 32 else words.pack_fast(code.astype(np.uint32), bits)
        at = begin + _PART + 8
        return pa.table({"path": [path] * 2, "at": [at + 4 * first, at + 4 * n + 8 + first * bits // 8], "data": [t.column("i").to_numpy().astype("<u4").tobytes(), packed]})

    # a group's first rank is even, so that codes of half a byte begin at a byte
    grouped = attach(rows.withColumn("run", F.floor(F.col("rank") / GROUP)), parts.select("field_id", "tier", "bits", "begin", "n"), ["field_id", "tier"]).withColumn("path", path)
    made = grouped.select("field_id", "tier", "run", "path", "rank", "i", "x", "code", "bits", "begin", "n").groupBy("field_id", "tier", "run").applyInArrow(run, "path string, at long, data binary")
    return parts.filter("tier = 0").select("field_id", path).join(write_pieces(_union([*fixed, made])), "path").select("field_id", "path", "bytes")


def write_blocked(coded: DataFrame, folder: str, key: str, shape: tuple[int, int, int], size: int, alpha: DataFrame, correctable: int) -> DataFrame:
    """(field_id, path, bytes) of blocked containers of quantized whole blocks (key, b0..b2, r0..r2, x, mode, bits, vmin, vmax,
    vmean), modes 0 to 2. alpha: (key, alpha)."""
    blocks = tuple(-(-n // size) for n in shape)
    if math.prod(blocks) * size**3 <= GROUP:
        packed = containers.blocked_containers(coded, [key], shape, size, alpha, correctable)
        return write_whole(packed.select(F.col(key).alias("field_id"), "container"), folder)
    ship(coded.sparkSession)
    per = max(1, GROUP // size**3)
    number = (F.col("b0") * blocks[1] + F.col("b1")) * blocks[2] + F.col("b2")
    rows = coded.select(F.col(key).cast("string").alias("field_id"), number.cast("long").alias("number"), "r0", "r1", "r2", "x", "mode", "bits", "vmin", "vmax", "vmean")
    length = F.when(F.col("mode") == 1, 9).when(F.col("mode") == 2, 9 + 4 * size**3).otherwise(F.lit(10) + F.ceil(F.lit(size**3) * F.col("bits") / 8)).cast("long")
    records = rows.groupBy("field_id", "number").agg(F.first("mode").alias("mode"), F.first("bits").alias("bits")).withColumn("length", length)
    begin = len(containers.BLOCKED) + 1 + 24 + struct.calcsize("<BBd3Q")
    starts = scan.prefix(records, ["field_id"], "number", F.col("length"), "at").filter(F.col("number") % per == 0)
    starts = starts.select("field_id", F.floor(F.col("number") / per).cast("long").alias("run"), (F.col("at") + begin).alias("at"))
    path = path_of(folder, F.col("field_id")).alias("path")
    factors = hold(alpha.select(F.col(key).cast("string").alias("field_id"), "alpha"))
    head = F.concat(
        literal(containers.BLOCKED + struct.pack("<B3QBB", 3, *shape, size, correctable)), little_endian(B.double_to_bits(F.col("alpha")), 8), literal(struct.pack("<3Q", *blocks))
    )

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by([(c, "ascending") for c in ("number", "r0", "r1", "r2")])
        x = t.column("x").to_numpy().reshape(-1, size**3)
        each = zip(x, *(t.column(c).to_numpy()[:: size**3].tolist() for c in ("mode", "bits", "vmin", "vmax", "vmean")))
        data = b"".join(containers.blocked_record(*r) for r in each)
        return pa.table({"path": t.column("path")[:1], "at": t.column("at")[:1], "data": [data]})

    grouped = rows.withColumn("run", F.floor(F.col("number") / per).cast("long")).join(starts.hint("merge"), ["field_id", "run"]).withColumn("path", path)
    made = grouped.groupBy("field_id", "run").applyInArrow(run, "path string, at long, data binary")
    fixed = factors.select(path, F.lit(0).cast("long").alias("at"), head.alias("data"))
    return factors.select("field_id", path).join(write_pieces(_union([fixed, made])), "path").select("field_id", "path", "bytes")


def compress_scaled(field: DataFrame, bound: float, folder: str, conserve: bool = True, codec: str = "planes") -> DataFrame:
    """(field_id, path, bytes): each field (field_id, i, x) through a byte codec as a file that begins with the factor which
    restores its energy."""
    field = field.select(F.col("field_id").cast("string").alias("field_id"), F.col("i").cast("long").alias("i"), "x")
    encoded = keep(codecs.encode_chunks(field, bound, codec), "encoded")
    square = lambda c: F.sum(F.col(c).cast("double") * F.col(c).cast("double"))
    before = field.groupBy("field_id").agg(square("x").alias("e0"))
    after = codecs.decode_chunks(encoded, bound, codec).groupBy("field_id").agg(square("xh").alias("e1"))
    factor = F.when(F.lit(conserve) & (F.col("e1") >= 1e-30), F.sqrt(F.col("e0") / F.col("e1"))).otherwise(F.lit(1.0))
    return write_chunked(encoded, folder, bound, alpha=hold(before.join(after, "field_id").select("field_id", factor.alias("alpha"))))


def decompress_scaled(files: DataFrame, bound: float, codec: str = "planes") -> DataFrame:
    """(field_id, i, xc) of files (field_id, path)."""
    rows = read_chunked(files, True, True)
    alphas = rows.groupBy("field_id").agg(F.first("alpha").alias("alpha"))
    back = attach(codecs.decode_chunks(rows, bound, codec), alphas)
    return back.select("field_id", "i", (F.col("alpha") * F.col("xh").cast("double")).cast("float").alias("xc"))
