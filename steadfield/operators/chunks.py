"""Lossless transforms inside chunks of 4096 values, chunk offsets and exact sizes, as windows and aggregates.

Windows are partitioned by field and chunk, so that a long field is spread over as many tasks as it has chunks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import MASK32, bits_needed, from_negabinary, negabinary
from ..model import CHUNK_BYTES, CHUNK_VALUES, SUBCHUNK_VALUES


def with_chunks(field: DataFrame, i: str = "i") -> DataFrame:
    return field.withColumns({"chunk": F.floor(F.col(i) / CHUNK_VALUES).cast("long"), "sub": F.floor(F.col(i) / SUBCHUNK_VALUES).cast("long")})


def _wrap(c: Column) -> Column:
    return c.bitwiseAND(F.lit(MASK32).cast("long"))


def differences(words: DataFrame, word: str = "word", keys: list[str] | None = None) -> DataFrame:
    """Adds diff: the wrapping difference from the word before (0 at the start of a chunk) in base -2."""
    w = Window.partitionBy(*(keys or ["field_id"]), "chunk").orderBy("i")
    before = F.coalesce(F.lag(word).over(w), F.lit(0).cast("long"))
    return words.withColumn("diff", negabinary(_wrap(F.col(word) - before)))


def undo_differences(words: DataFrame, diff: str = "diff", keys: list[str] | None = None) -> DataFrame:
    """Adds word: running sums of the differences, modulo 2**32."""
    w = Window.partitionBy(*(keys or ["field_id"]), "chunk").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    return words.withColumn("word", _wrap(F.sum(from_negabinary(F.col(diff))).over(w)))


def running_max(words: DataFrame, word: str = "word", keys: list[str] | None = None) -> DataFrame:
    w = Window.partitionBy(*(keys or ["field_id"]), "chunk").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    return words.withColumn("most", F.max(word).over(w))


def offsets(sizes: DataFrame, size: str = "csize", keys: list[str] | None = None) -> DataFrame:
    """Adds offset: where each chunk begins. One row for each chunk takes part, and fields are apart."""
    w = Window.partitionBy(*(keys or ["field_id"])).orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    return sizes.withColumn("offset", F.coalesce(F.sum(size).over(w), F.lit(0)).cast("long"))


def sub_bits(codes: DataFrame, code: str = "code", keys: list[str] | None = None) -> DataFrame:
    """(*keys, chunk, sub, n, bits): the width that the largest code of each subchunk needs. codes are unsigned words."""
    return codes.groupBy(*(keys or ["field_id"]), "chunk", "sub").agg(F.count(F.lit(1)).alias("n"), bits_needed(F.max(code)).alias("bits"))


def bit_offsets(subs: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Adds bit_offset: where each subchunk begins inside its chunk."""
    w = Window.partitionBy(*(keys or ["field_id"]), "chunk").orderBy("sub").rowsBetween(Window.unboundedPreceding, -1)
    return subs.withColumn("bit_offset", F.coalesce(F.sum(F.col("bits") * SUBCHUNK_VALUES).over(w), F.lit(0)).cast("long"))


def packed_sizes(subs: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """(*keys, chunk, osize, csize): 32 width bytes, the packed codes of whole subchunks and 2 bytes; a chunk that does
    not shrink is stored as it is."""
    sized = subs.groupBy(*(keys or ["field_id"]), "chunk").agg((4 * F.sum("n")).alias("osize"), (34 + 16 * F.sum("bits")).alias("packed"))
    raw = (F.col("packed") >= CHUNK_BYTES) | (F.col("packed") >= F.col("osize"))
    return sized.select(*(keys or ["field_id"]), "chunk", F.col("osize").cast("long").alias("osize"), F.when(raw, F.col("osize")).otherwise(F.col("packed")).cast("long").alias("csize"))


def file_sizes(chunk_sizes: DataFrame, header: int, mode: Column | int = 0, keys: list[str] | None = None) -> DataFrame:
    """(*keys, original, bytes): a header, 2 bytes and the data for each chunk, and 8 bytes for each invariant kept."""
    mode = mode if isinstance(mode, Column) else F.lit(mode)
    trailer = 8 * F.bit_count(mode.bitwiseAND(F.lit(3)))
    return chunk_sizes.groupBy(*(keys or ["field_id"])).agg(F.sum("osize").cast("long").alias("original"), (F.sum(F.col("csize") + 2) + header + trailer).cast("long").alias("bytes"))
