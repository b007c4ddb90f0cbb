"""Exact order statistics by radix selection: the k-th smallest values and quantiles of any number of fields at once.

A value becomes a whole number that orders as it does, its bit pattern with the sign taken in. A round counts the next
``DIGIT`` bits of the values that share the bits found so far with some wanted rank, for all ranks of all fields together,
and so finds these bits. Two rounds settle 32-bit values, four 64-bit ones. Counts are summed in each task before they
are shuffled; a window is over the at most 2 ** DIGIT counts of one prefix, never over rows, also where a field is one
value throughout.

Defined results: nulls don't count; NaN is the largest value; a field without values has no row; equal values are
interchangeable, so of zeros the sign may be either's.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import bits as B
from ..functions.numeric import f64
from .correct import attach

DIGIT = 16


def select(rows: DataFrame, keys: list[str], value: Column, wanted: Callable[[Column], Column], width: int = 32) -> DataFrame:
    """(*keys, id, value): the value of each wanted rank, counted from 0. wanted makes of the number of a field's values
    the array of its (id, rank); ranks beyond either end give no row. width: 32 for floats, 64 for doubles."""
    o = rows.filter(value.isNotNull()).select(*keys, B.order_of(value, width).alias("_o"))
    found, low = None, width
    while low:
        low -= DIGIT
        digit = F.shiftright("_o", low).alias("_at")  # the prefix and the new bits: prefixes are longs of either sign
        if found is None:
            group, counts = keys, o.groupBy(*keys, digit).agg(F.count(F.lit(1)).alias("_c"))
        else:
            group = [*keys, "_prefix"]
            inside = attach(o.withColumn("_prefix", F.shiftright("_o", low + DIGIT)), found, group)
            counts = inside.groupBy(*group, digit).agg(F.count(F.lit(1)).alias("_c"), F.first("_asks").alias("_asks"))
        bins = Window.partitionBy(*group).orderBy("_at")
        counts = counts.withColumn("_upto", F.sum("_c").over(bins))
        if found is None:
            counts = counts.withColumn("_asks", wanted(F.sum("_c").over(Window.partitionBy(*group))))
        here = F.filter("_asks", lambda a: (a["rank"] < F.col("_upto")) & (a["rank"] >= F.col("_upto") - F.col("_c")))
        left = F.transform(here, lambda a: F.struct(a["id"].alias("id"), (a["rank"] - F.col("_upto") + F.col("_c")).alias("rank")))
        found = counts.select(*keys, F.col("_at").alias("_prefix"), left.alias("_asks")).filter(F.size("_asks") > 0)
    return found.select(*keys, F.explode("_asks.id").alias("id"), B.of_order(F.col("_prefix"), width).alias("value"))


def kth_smallest(rows: DataFrame, keys: list[str], value: Column, percent: float, width: int = 32) -> DataFrame:
    """(*keys, kth): the value of rank floor(percent / 100 * (n - 1)), counted from 0."""
    rank = lambda n: F.array(F.struct(F.lit(0).alias("id"), F.floor(F.lit(percent) / 100 * (n - 1)).cast("long").alias("rank")))
    return select(rows, keys, value, rank, width).select(*keys, F.col("value").alias("kth"))


def quantiles(rows: DataFrame, keys: list[str], value: Column, shares: Sequence[float], width: int = 32) -> DataFrame:
    """(*keys, q): quantiles by linear interpolation between the two nearest ranks, in the order of shares."""

    def wanted(n: Column) -> Column:
        place = [F.lit(float(p)) * (n - 1) for p in shares]
        ends = [(F.floor(at), F.ceil(at)) for at in place]
        return F.array(*(F.struct(F.lit(2 * k + e).alias("id"), r.cast("long").alias("rank"), (at - ends[k][0]).alias("part")) for k, at in enumerate(place) for e, r in enumerate(ends[k])))

    def ranks(n: Column) -> Column:
        return F.transform(wanted(n), lambda a: F.struct(a["id"].alias("id"), a["rank"].alias("rank")))

    both = select(rows, keys, value, ranks, width)
    n = rows.filter(value.isNotNull()).groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    of = both.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("id", f64(F.col("value")).alias("v")))).alias("_m")).join(n, keys)
    parts = F.transform(wanted(F.col("_n")), lambda a: a["part"])
    lo = lambda k: F.element_at("_m", F.lit(2 * k))
    hi = lambda k: F.element_at("_m", F.lit(2 * k + 1))
    # equal ends are taken as they are, so that infinities stay
    q = F.array(*(F.when(lo(k) == hi(k), lo(k)).otherwise((1 - parts[2 * k]) * lo(k) + parts[2 * k] * hi(k)) for k in range(len(shares))))
    return of.select(*keys, q.alias("q"))
