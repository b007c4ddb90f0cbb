"""Running sums and ranks of long fields by prefix scans over blocks: no task orders a field.

The sums of blocks of rows are scanned first, then the rows of each block from where it begins; with more levels the
sums of blocks are scanned the same way. A window holds the rows of one block, or one row for each block of the highest level.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 65_536


def prefix(rows: DataFrame, keys: list[str], order: str, size: Column, out: str = "offset", block: int = BLOCK, levels: int = 2) -> DataFrame:
    """Adds out: the sum of size over the rows of a field that come before in order, a whole number that no two of its
    rows share. Null sizes count as 0."""
    if levels < 2:
        w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
        return rows.withColumn(out, F.coalesce(F.sum(size).over(w), F.lit(0)).cast("long"))
    at, total, start = f"_block{levels}", f"_sum{levels}", f"_start{levels}"
    cut = rows.withColumn(at, F.floor(F.col(order) / block).cast("long"))
    sums = cut.groupBy(*keys, at).agg(F.coalesce(F.sum(size), F.lit(0)).alias(total))
    starts = prefix(sums, keys, at, F.col(total), start, block, levels - 1).drop(total)
    inside = Window.partitionBy(*keys, at).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    met = cut.join(starts.hint("merge"), [*keys, at])
    return met.withColumn(out, (F.col(start) + F.coalesce(F.sum(size).over(inside), F.lit(0))).cast("long")).drop(at, start)


def rank(rows: DataFrame, keys: list[str], order: str, out: str = "rank", block: int = BLOCK, levels: int = 2) -> DataFrame:
    """Adds out: how many rows of the field come before."""
    return prefix(rows, keys, order, F.lit(1), out, block, levels)
