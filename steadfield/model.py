"""The data model: fields as long tables, and the small enumerations that operators take.

A field is a table ``field_id string, i bigint, x float`` and, where a weight goes with it, ``w float``. A grid is a
field whose coordinates are derived from ``i`` in C order. Values are 32-bit floats; sums are taken in 64 bits.
"""

from __future__ import annotations

import enum
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Invariant(enum.IntFlag):
    """Which invariants are restored; the bits add up to a mode from 0 to 3."""

    NONE = 0
    MASS = 1
    ENERGY = 2
    BOTH = 3


class Bound(enum.IntEnum):
    """How a pointwise bound is meant: absolute, relative to the value, or as a fraction of the value range."""

    ABS = 0
    REL = 1
    RANGE = 2


def side_info_bytes(mode: int) -> int:
    """One 64-bit number is stored for each invariant of the mode."""
    return 8 * bin(mode & 3).count("1")


@dataclass(frozen=True)
class Tier:
    """Attention from lo (inclusive) to hi (exclusive) is stored with so many bits."""

    lo: float
    hi: float
    bits: int


#: The default tiers.
DEFAULT_TIERS = (Tier(0.0, 0.15, 4), Tier(0.15, 0.45, 8), Tier(0.45, 0.75, 16), Tier(0.75, 1.0001, 32))
#: Tiers with more bits than this are stored exactly and are not rescaled.
CORRECTABLE_BITS = 16
CHUNK_VALUES, SUBCHUNK_VALUES, CHUNK_BYTES = 4096, 128, 16384


def field_long(df: DataFrame, field_id: Column, i: Column, x: Column, w: Column | None = None) -> DataFrame:
    """The canonical table of one or many fields."""
    columns = [field_id.cast("string").alias("field_id"), i.cast("long").alias("i"), x.cast("float").alias("x")]
    if w is not None:
        columns.append(w.cast("float").alias("w"))
    return df.select(*columns)


def with_coordinates(field: DataFrame, shape: tuple[int, ...], i: str = "i") -> DataFrame:
    """Adds i0, i1, ... of a grid in C order."""
    step = 1
    out = {}
    for axis in range(len(shape) - 1, -1, -1):
        out[f"i{axis}"] = F.pmod(F.floor(F.col(i) / step).cast("long"), F.lit(shape[axis])).cast("long")
        step *= shape[axis]
    return field.withColumns(out)


def explode_vectors(df: DataFrame, vec_id: str, vector: str, component: str = "x") -> DataFrame:
    """(vec_id, i, component): one row for each entry of an array column, i counting from 0."""
    return df.select(vec_id, F.posexplode(F.col(vector)).alias("i", component)).withColumn(component, F.col(component).cast("float"))


def line_out(grid: DataFrame, **fixed: int) -> DataFrame:
    """The part of a grid where the named coordinates have the given values: a slice, or a line of it."""
    for name, value in fixed.items():
        grid = grid.filter(F.col(name) == value)
    return grid
