"""Token-id files whose document boundaries are Elias-Fano encoded.

A shard file holds the ids of its documents one after another, in 2 or 4 bytes each, and two Elias-Fano lists: the end
of each document among the ids, and the ascending document ids. An Elias-Fano list of n values below u keeps the low
floor(log2(u / n)) bits of each value packed, and the rest in unary in a bit vector; a 32-bit sample of every
``SAMPLE``-th one in that vector lets ``select`` find any value from a few bytes. That is about 2 + log2(u / n) bits a
document, where an offset table takes 64.

Documents are range-partitioned by id, so that shards in order hold ascending ids, and encoded after that shuffle. A
task writes a new file whenever it holds ``SHARD_TOKENS`` ids, so memory is bounded however many rows meet in one range.
Each attempt of a task writes under a name of its own, and only the rows of the attempt that counts name files, so lost
executors and repeated tasks do no harm. The first id of each shard is a running sum over one row for each file.

Files are written and read through the file system of the shared folder's address, never a machine's own folder.

Defined results: null text encodes as the empty text; a document that is empty has its end id alone; rows with equal
``doc_id`` follow each other in the order of their texts; null ``doc_id`` comes first; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import functools
import struct
import uuid
import zlib
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..runtime import ship
from . import common
from .pretokens import BEYOND_LATIN as _BEYOND_LATIN
from .pretokens import CachedEncoder

MAGIC = b"EFTOKEN1"
SAMPLE = 256
SHARD_TOKENS = 16_000_000
END_ID = 2
VOCABULARY = "byte_bpe_50k.json"


class EliasFano:
    """A list of n ascending values below ``universe`` + 1."""

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray, samples: np.ndarray) -> None:
        self.n, self.low_bits, self.low, self.high, self.samples = n, low_bits, low, high, samples

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, dtype=np.uint64)
        n = len(values)
        top = int(values[-1]) if n else 0
        low_bits = max(0, (top // n).bit_length() - 1) if n else 0
        places = np.arange(low_bits, dtype=np.uint64)
        low = np.packbits(((values[:, None] >> places) & np.uint64(1)).astype(np.uint8).ravel(), bitorder="little")
        ones = (values >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)
        bits = np.zeros(int(ones[-1]) + 1 if n else 0, dtype=np.uint8)
        bits[ones] = 1
        return cls(n, low_bits, low, np.packbits(bits, bitorder="little"), ones[::SAMPLE].astype("<u4"))

    def to_bytes(self) -> bytes:
        return struct.pack("<5Q", self.n, self.low_bits, len(self.low), len(self.high), len(self.samples)) + self.low.tobytes() + self.high.tobytes() + self.samples.tobytes()

    @classmethod
    def read(cls, b: memoryview, at: int) -> tuple[EliasFano, int]:
        n, low_bits, n_low, n_high, n_samples = struct.unpack_from("<5Q", b, at)
        at += 40
        low, high = np.frombuffer(b, np.uint8, n_low, at), np.frombuffer(b, np.uint8, n_high, at + n_low)
        at += n_low + n_high
        return cls(n, low_bits, low, high, np.frombuffer(b, "<u4", n_samples, at)), at + 4 * n_samples

    def _lows(self, i: np.ndarray) -> np.ndarray:
        at = i.astype(np.int64)[:, None] * self.low_bits + np.arange(self.low_bits)
        bits = (self.low[at >> 3] >> (at & 7).astype(np.uint8)) & 1
        return (bits.astype(np.uint64) << np.arange(self.low_bits, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)

    def select(self, i: int) -> int:
        """The value at place i, from one sample and the bytes between it and the next."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        block = i // SAMPLE
        start = int(self.samples[block])
        end = int(self.samples[block + 1]) if block + 1 < len(self.samples) else 8 * len(self.high)
        first = start >> 3
        bits = np.unpackbits(self.high[first : (end >> 3) + 1], bitorder="little")
        one = start + int(np.flatnonzero(bits[start - 8 * first :])[i - block * SAMPLE])
        return ((one - i) << self.low_bits) | int(self._lows(np.array([i]))[0])

    def select_many(self, places: np.ndarray) -> np.ndarray:
        """The values at ascending places. Each sample that stands before some of them is followed once, to the next."""
        places = np.asarray(places, dtype=np.int64)
        if len(places) and not (0 <= places[0] and places[-1] < self.n):
            raise IndexError((int(places[0]), int(places[-1])))
        ones = np.empty(len(places), dtype=np.int64)
        blocks, first = np.unique(places // SAMPLE, return_index=True)
        for block, a, z in zip(blocks.tolist(), first.tolist(), [*first[1:].tolist(), len(places)]):
            start = int(self.samples[block])
            end = int(self.samples[block + 1]) if block + 1 < len(self.samples) else 8 * len(self.high)
            bits = np.unpackbits(self.high[start >> 3 : (end >> 3) + 1], bitorder="little")
            ones[a:z] = start + np.flatnonzero(bits[start & 7 :])[places[a:z] - block * SAMPLE]
        return ((ones - places).astype(np.uint64) << np.uint64(self.low_bits)) | self._lows(places)

    def all(self) -> np.ndarray:
        return self.select_many(np.arange(self.n))


def shard_bytes(doc_ids: list[int | None], lengths: list[int], ids: bytes, width: int) -> bytes:
    """The image of one file. doc_ids ascend, nulls first; lengths are in ids."""
    known = np.array([d for d in doc_ids if d is not None], dtype=np.int64)
    least = int(known[0]) if len(known) else 0
    ends = EliasFano.of(np.cumsum(np.array(lengths, dtype=np.uint64), dtype=np.uint64)).to_bytes()
    names = EliasFano.of((known - least).astype(np.uint64)).to_bytes()
    head = MAGIC + struct.pack("<3Qq", width, len(doc_ids) - len(known), len(ids) // width, least)
    return head + ends + names + ids


class Shard:
    """A file read back: ``ends`` and ``names`` are Elias-Fano lists, ``ids`` the array."""

    def __init__(self, data: bytes) -> None:
        b = memoryview(data)
        if bytes(b[:8]) != MAGIC:
            raise ValueError("not a token file")
        self.width, self.nulls, n_tokens, self.least = struct.unpack_from("<3Qq", b, 8)
        self.ends, at = EliasFano.read(b, 40)
        self.names, at = EliasFano.read(b, at)
        self.ids = np.frombuffer(b, f"<u{self.width}", n_tokens, at)

    def doc_ids(self) -> list[int | None]:
        return [None] * self.nulls + (self.names.all().astype(np.int64) + self.least).tolist()

    def document(self, i: int) -> np.ndarray:
        return self.ids[self.ends.select(i - 1) if i else 0 : self.ends.select(i)]


def _byte_letters() -> dict[int, str]:
    """The letters that stand for bytes in byte-level vocabularies: printable Latin-1 letters for themselves, the other
    bytes in order from U+0100 on."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = [b for b in range(256) if b not in printable]
    return {b: chr(b) for b in printable} | {b: chr(0x100 + n) for n, b in enumerate(others)}


@functools.lru_cache(maxsize=2)  # a Python worker keeps it, and what it has cached, from task to task
def encoder(path: str, end_id: int, width: int) -> Callable[[list[str]], Iterator[bytes]]:
    """Ids of whole texts, each with the end id, as bytes."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    model, split, letters = tokenizer.model.tokenize, tokenizer.pre_tokenizer.pre_tokenize_str, _byte_letters()
    space = letters[0x20]
    code, end = {2: "H", 4: "I"}[width], np.array([end_id], dtype=f"<u{width}").tobytes()
    specials = [t.content for t in tokenizer.get_added_tokens_decoder().values()]

    def whole(text: str) -> bytes:
        return np.array(tokenizer.encode(text, add_special_tokens=False).ids, dtype=f"<u{width}").tobytes()

    def piece(p: str) -> bytes:
        word = p[1:] if p[0] == " " else p
        if word.isascii() and word.isalpha():  # one match of the split pattern, and letters stand for themselves
            found = model(space + word if len(word) < len(p) else word)
        elif word.isalpha() and max(p) < _BEYOND_LATIN:
            found = model(p.encode().decode("latin-1").translate(letters))
        else:
            found = [t for s, _ in split(p) for t in model(s)]
        return array(code, [t.id for t in found]).tobytes()

    def many(pieces: list[str]) -> Iterator[bytes]:
        return map(piece, pieces)

    cached = CachedEncoder(many, width, most=800_000, group=3_000_000)

    def encode(texts: list[str]) -> Iterator[bytes]:
        # added tokens are looked for before the split, in the whole text
        special = [any(s in t for s in specials) for t in texts]
        rest = cached(t for t, s in zip(texts, special) if not s)
        for t, s in zip(texts, special):
            yield whole(t) + end if s else next(rest).tobytes() + end

    return encode


def write_files(docs: DataFrame, folder: str, vocabulary: str, end_id: int = END_ID, shard_tokens: int = SHARD_TOKENS, width: int = 2) -> DataFrame:
    """Writes docs (doc_id, text) to files in folder; one row for each: part, seq, path, n_docs, n_tokens."""
    if end_id >= 1 << (8 * width):
        raise ValueError("ids don't fit the width")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        context = TaskContext.get()
        fs, base = common.file_system(folder)
        fs.create_dir(base, recursive=True)
        encode = encoder(vocabulary, end_id, width)
        doc_ids: list[int | None] = []
        lengths: list[int] = []
        ids: list[bytes] = []
        held, seq, rows = 0, 0, []

        def flush() -> None:
            nonlocal held, seq
            name = f"part-{context.partitionId():06d}-{seq:04d}-{uuid.uuid4().hex[:8]}.eftok"
            with fs.open_output_stream(f"{base}/{name}.tmp") as f:
                f.write(shard_bytes(doc_ids, lengths, b"".join(ids), width))
            fs.move(f"{base}/{name}.tmp", f"{base}/{name}")
            rows.append({"part": context.partitionId(), "seq": seq, "path": f"{folder}/{name}", "n_docs": len(doc_ids), "n_tokens": held})
            for x in (doc_ids, lengths, ids):
                x.clear()
            held, seq = 0, seq + 1

        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for d, got in zip(batch.column(0).to_pylist(), encode(texts)):
                doc_ids.append(d)
                lengths.append(len(got) // width)
                ids.append(got)
                held += lengths[-1]
                if held >= shard_tokens:
                    flush()
        if doc_ids:
            flush()
        yield pa.RecordBatch.from_pylist(rows, schema=schema)

    schema = pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_tokens", pa.int64())])
    ship(docs.sparkSession)
    ranged = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange(F.asc_nulls_first("doc_id")).sortWithinPartitions(F.asc_nulls_first("doc_id"), "text")
    files = ranged.mapInArrow(run, "part int, seq int, path string, n_docs long, n_tokens long")
    return common.materialize(files, "token-shards")


def read_files(files: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32, ids) of each document, read from the files that ``write_files`` named."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                fs, path = common.file_system(row["path"])
                with fs.open_input_stream(path) as f:
                    shard = Shard(f.read())
                ends = np.concatenate(([0], shard.ends.select_many(np.arange(shard.ends.n)).astype(np.int64)))
                crcs = [zlib.crc32(shard.ids[a:b].astype("<u4").tobytes()) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(shard.doc_ids(), pa.int64()), pa.array(ends[:-1] + row["first"], pa.int64()), pa.array(np.diff(ends), pa.int64()), pa.array(crcs, pa.int64())],
                    names=["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    ship(files.sparkSession)
    order = Window.orderBy("part", "seq")
    placed = files.select("path", (F.sum("n_tokens").over(order) - F.col("n_tokens")).alias("first"))
    return placed.repartition(max(1, files.count())).mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = common.read_table(spark, sf_dir, "documents")
    return read_files(write_files(docs, common.new_path(spark, "token-files"), public_tokenizers.path(VOCABULARY)))
