"""Byte-level BPE encoding and decoding through a sentencepiece model made from a rank file.

The model is serialised here, without training: every token of the rank file becomes a piece, its bytes written as one
letter each (``LETTERS``), scored by its negative rank; the normaliser is the identity, and neither spaces nor prefixes
are touched. sentencepiece merges the pair whose piece scores highest, leftmost first, which is the merge of lowest
rank. The split pattern is applied first and each match encoded by itself. Decoding maps ids back to tokens' bytes.

Defined results: null counts as the empty text, which has no ids; bytes outside the vocabulary can't occur, as every
single byte must be a token of the file; repeated rows are encoded alike; an empty table gives an empty result; other
columns are ignored by ``encode_digests``, and those named are kept by ``with_tokens``.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import struct
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import ship
from . import common
from .pretokens import CachedEncoder

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
#: Byte b is written as the letter U+0100 + b: none of these is white space or special to sentencepiece.
_FIRST_LETTER = 0x100
LETTERS = {b: _FIRST_LETTER + b for b in range(256)}
_UNKNOWN = "<unk>"


def read_ranks(path: str) -> list[bytes]:
    """Tokens in order of rank; ranks must run from 0 without gaps and hold every single byte."""
    with open(path, "rb") as f:
        pairs = sorted((int(rank), base64.b64decode(token)) for token, rank in map(bytes.split, filter(None, f.read().splitlines())))
    if [r for r, _ in pairs] != list(range(len(pairs))):
        raise ValueError("ranks have gaps")
    tokens = [t for _, t in pairs]
    if missing := 256 - sum(len(t) == 1 for t in tokens):
        raise ValueError(f"{missing} bytes have no token")
    return tokens


def letters(b: bytes) -> str:
    return b.decode("latin-1").translate(LETTERS)


def _varint(n: int) -> bytes:
    out = bytearray()
    while n >= 0x80:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    return bytes(out) + bytes([n])


def _field(number: int, value: bytes | int | float) -> bytes:
    """A protobuf field: bytes, int (varint) or float (32 bits)."""
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    if isinstance(value, int):
        return _varint(number << 3) + _varint(value)
    return _varint(number << 3 | 2) + _varint(len(value)) + value


def serialize_model(tokens: list[bytes]) -> bytes:
    """A sentencepiece ModelProto whose ids are the ranks. Field numbers are those of sentencepiece_model.proto."""
    normal, unknown, bpe = 1, 2, 2
    pieces = [_field(1, _field(1, letters(t).encode()) + _field(2, -float(r)) + _field(3, normal)) for r, t in enumerate(tokens)]
    pieces.append(_field(1, _field(1, _UNKNOWN.encode()) + _field(2, 0.0) + _field(3, unknown)))
    trainer = _field(3, bpe) + _field(4, len(pieces)) + _field(40, len(tokens))
    normalizer = _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)
    return b"".join(pieces) + _field(2, trainer) + _field(3, normalizer)


class ByteBPE:
    def __init__(self, vocabulary: str, pattern: str) -> None:
        import regex
        import sentencepiece

        self.tokens = read_ranks(vocabulary)
        self._split = regex.compile(pattern).findall
        self._piece = sentencepiece.SentencePieceProcessor(model_proto=serialize_model(self.tokens))
        self._cached = CachedEncoder(self._encode, 4)

    def _encode(self, pieces: list[str]) -> list[bytes]:
        matches = [self._split(p) for p in pieces]
        ids = iter(self._piece.encode([letters(m.encode()) for ms in matches for m in ms], num_threads=1))
        return [np.array([i for _ in ms for i in next(ids)], dtype="<u4").tobytes() for ms in matches]

    def encode(self, texts: list[str]) -> Iterator[np.ndarray]:
        return self._cached(texts)

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids.tolist()))


@functools.lru_cache(maxsize=1)  # a Python worker keeps it, and what it has cached, from task to task
def byte_bpe(vocabulary: str, pattern: str) -> ByteBPE:
    return ByteBPE(vocabulary, pattern)


def _per_text(docs: DataFrame, columns: list[str], make: Callable[[ByteBPE, np.ndarray], tuple], types: str, vocabulary: str, pattern: str) -> DataFrame:
    from pyspark.sql.types import StructType
    from pyspark.sql.pandas.types import to_arrow_schema

    ship(docs.sparkSession)
    kept = docs.select(*columns, "text")
    added = StructType.fromDDL(types)
    out = StructType([f for f in kept.schema.fields if f.name in columns] + added.fields)
    arrow = to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = byte_bpe(vocabulary, pattern)
        for whole in batches:
            for batch in common.slices(whole, len(columns)):
                made = [make(bpe, ids) for ids in bpe.encode([t or "" for t in batch.column(len(columns)).to_pylist()])]
                new = [pa.array([m[k] for m in made], arrow.field(len(columns) + k).type) for k in range(len(added))]
                yield pa.RecordBatch.from_arrays([batch.column(k).cast(arrow.field(k).type) for k in range(len(columns))] + new, schema=arrow)

    return kept.mapInArrow(common.lean(run), out)


def _digests(bpe: ByteBPE, ids: np.ndarray) -> tuple[int, str, str]:
    return len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(bpe.decode(ids)).hexdigest()


def _ids(bpe: ByteBPE, ids: np.ndarray) -> tuple:
    return (ids.astype("int32"), *_digests(bpe, ids))


def encode_digests(docs: DataFrame, vocabulary: str, pattern: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256)"""
    docs = docs.withColumn("doc_id", F.col("doc_id").cast("long"))
    return _per_text(docs, ["doc_id"], _digests, "n_tokens long, ids_sha256 string, decoded_sha256 string", vocabulary, pattern)


def with_tokens(docs: DataFrame, columns: list[str], vocabulary: str, pattern: str) -> DataFrame:
    """(*columns, ids, n_tokens, ids_sha256, decoded_sha256); the last is of the bytes that decoding the ids gives."""
    return _per_text(docs, columns, _ids, "ids array<int>, n_tokens long, ids_sha256 string, decoded_sha256 string", vocabulary, pattern)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encode_digests(common.read_table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN)
