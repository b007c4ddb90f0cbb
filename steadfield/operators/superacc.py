"""Sums of doubles that don't hang on the order of their terms: a superaccumulator with a bin for each exponent.

A value is a whole number of 53 bits times a power of two. For each power the whole numbers' upper and lower halves are summed
as longs, exactly, first in each task and then over tasks, in any order; a field has some 2,000 such rows at most. Their
exact total, a whole number of any length, is rounded once to the nearest double. So a sum is the same to its last bit however
rows are dealt, and it is the correctly rounded one. Up to 2 ** 36 terms of one exponent are counted without overflow, which
ANSI mode would report.

Defined results: nulls don't count; no terms give null; a NaN, or infinities of both signs, give NaN, infinities of one sign that
one; a sum beyond the range of doubles is infinite; a zero total has no sign.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import DoubleType, StructField, StructType

from ..functions import bits as B
from ..functions.numeric import f64
from ..runtime import ship

_HALF, _FRACTION = 26, 52
#: The power of two of the least double.
_LEAST = 1074


def rounded(bins: list[tuple[int, int, int]]) -> float:
    """The double nearest to the sum of (high * 2 ** 26 + low) * 2 ** (power - 1074) over bins (power, high, low)."""
    total = sum(((high << _HALF) + low) << power for power, high, low in bins)
    try:
        return total / (1 << _LEAST)  # division of whole numbers is rounded correctly
    except OverflowError:
        return float("inf") if total > 0 else float("-inf")


def exact_sums(field: DataFrame, sums: dict[str, Column], keys: list[str] | None = None) -> DataFrame:
    """(*keys, *names): the exact sum of each column, rounded once."""
    ship(field.sparkSession)
    keys, names = keys or ["field_id"], list(sums)
    terms = F.explode(F.array(*(F.struct(F.lit(k).alias("k"), f64(c).alias("v")) for k, c in enumerate(sums.values()))))
    bits = field.select(*keys, terms.alias("t")).select(*keys, "t.k", B.double_to_bits(F.col("t.v")).alias("b"))
    power = F.shiftright("b", _FRACTION).bitwiseAND(F.lit(2047).cast("long"))
    part = F.col("b").bitwiseAND(F.lit((1 << _FRACTION) - 1).cast("long"))
    split = bits.select(*keys, "k", power.alias("p"), part.alias("m"), F.when(F.col("b") < 0, -1).otherwise(1).cast("long").alias("sign"))
    whole = F.col("m") + F.when((F.col("p") > 0) & (F.col("p") < 2047), F.lit(1 << _FRACTION).cast("long")).otherwise(F.lit(0).cast("long"))
    high = F.sum(F.col("sign") * F.shiftright(whole, _HALF))
    low = F.sum(F.col("sign") * whole.bitwiseAND(F.lit((1 << _HALF) - 1).cast("long")))
    # infinities and NaN share the last power: counted by what they are
    odd = F.sum(F.when((F.col("p") == 2047) & (F.col("m") == 0) & (F.col("sign") > 0), 1).otherwise(0)), F.sum(F.when((F.col("p") == 2047) & (F.col("m") == 0) & (F.col("sign") < 0), 1).otherwise(0))
    binned = split.groupBy(*keys, "k", "p").agg(F.coalesce(high, F.lit(0).cast("long")).alias("high"), F.coalesce(low, F.lit(0).cast("long")).alias("low"), odd[0].alias("up"), odd[1].alias("down"), F.count("m").alias("n"))
    held = binned.groupBy(*keys).agg(F.collect_list(F.struct("k", "p", "high", "low", "up", "down", "n")).alias("bins"))
    out = StructType([f for f in held.schema.fields if f.name != "bins"] + [StructField(n, DoubleType()) for n in names])
    arrow = to_arrow_schema(out)

    def finish(bins: list[dict]) -> float | None:
        if not sum(b["n"] for b in bins):
            return None
        top = [b for b in bins if b["p"] == 2047]
        if top:
            up, down, n = (sum(b[c] for b in top) for c in ("up", "down", "n"))
            return float("nan") if up + down < n or up and down else float("inf") if up else float("-inf")
        return rounded([(max(b["p"], 1) - 1, b["high"], b["low"]) for b in bins if b["p"] is not None])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.column(len(keys)).to_pylist()
            made = [[finish([b for b in row if b["k"] == k]) for row in rows] for k in range(len(names))]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keys)], *(pa.array(v, pa.float64()) for v in made)], schema=arrow)

    return held.mapInArrow(run, out)
