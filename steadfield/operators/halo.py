"""Grids cut to tiles with a rim of neighbours, so that stencils run tile by tile and no task holds a grid.

A row goes to its own tile and to those whose rim it stands in: with a tile of s cells along each of d axes and a rim of r,
(1 + 2r / s) ** d times the rows are shuffled, once, by (keys, tile). Windows over lines of a tile then need local sorts
only, as rows dealt by a tile's number stand together for every line in it. What a stencil of radius r or less gives at
the tile's own cells is what it gives on the whole grid; the rim's cells are dropped after it.

Coordinates are dense from 0. A grid smaller than a tile is one tile; grids of many fields are cut apart alike.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Cells along an axis, by the number of axes: about 65,536 cells, or 32 to 64 thousand with their rim.
SIDES = {1: 65_536, 2: 256, 3: 32}
#: A grid of so many cells or fewer is taken as one tile.
CELLS = 65_536


def side(axes: list[str]) -> int:
    return SIDES.get(len(axes), max(4, int(CELLS ** (1 / len(axes)))))


def is_one_tile(shape: tuple[int, ...] | None) -> bool:
    return shape is not None and math.prod(shape) <= CELLS


def tile_names(axes: list[str]) -> list[str]:
    """Columns that name a tile within its field; the last, a hash of field and tile, is the one by which rows are dealt,
    so that windows by these names and more need no other shuffle, even where the keys are constants."""
    return [*_places(axes), "_tile"]


def _places(axes: list[str]) -> list[str]:
    return [f"_tile_{a}" for a in axes]


def tiled(field: DataFrame, axes: list[str], keys: list[str], rim: int, size: int | None = None, shape: tuple[int, ...] | None = None) -> DataFrame:
    """field with the tile's coordinates (``tile_names``), each row as often as it has tiles, dealt by tile."""
    size = size or side(axes)
    out = field
    for k, (axis, name) in enumerate(zip(axes, _places(axes))):
        at = lambda i: F.floor(i / size).cast("long")
        first, last = F.greatest(at(F.col(axis) - rim), F.lit(0).cast("long")), at(F.col(axis) + rim)
        if shape:
            last = F.least(last, F.lit((shape[k] - 1) // size).cast("long"))
        out = out.withColumn(name, F.explode(F.sequence(first, last)))
    return out.withColumn("_tile", F.xxhash64(*keys, *_places(axes))).repartition("_tile")


def own(rows: DataFrame, axes: list[str], size: int | None = None) -> DataFrame:
    """The rows that stand in their own tile, without the tile's coordinates."""
    size = size or side(axes)
    here = None
    for axis, name in zip(axes, _places(axes)):
        one = F.col(name) == F.floor(F.col(axis) / size).cast("long")
        here = one if here is None else here & one
    return rows.filter(here).drop(*tile_names(axes))
