"""Attention tiers and the tiered codec."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import clamp, f32, f64, half_even
from ..model import CORRECTABLE_BITS, DEFAULT_TIERS, Tier
from . import correct, halo, ranks
from . import invariants as inv

_NO_SPREAD = 1e-12


def tier_table(spark, tiers: Sequence[Tier] = DEFAULT_TIERS) -> DataFrame:
    return spark.createDataFrame([(k, t.lo, t.hi, t.bits) for k, t in enumerate(tiers)], "tier int, lo double, hi double, bits int")


def tier_of(att: Column, tiers: Sequence[Tier] = DEFAULT_TIERS, otherwise: int = 0) -> Column:
    """The last tier whose range holds the attention; ``otherwise`` where none does, as for NaN."""
    out = None
    for k in reversed(range(len(tiers))):
        t = tiers[k]
        hit = ~F.isnan(att) & (f64(att) >= t.lo) & (f64(att) < t.hi)
        out = F.when(hit, F.lit(k)) if out is None else out.when(hit, F.lit(k))
    return out.otherwise(F.lit(otherwise))


def join_tiers(field: DataFrame, spark, tiers: Sequence[Tier] = DEFAULT_TIERS) -> DataFrame:
    """The same as a range join with the tier table, which has a handful of rows."""
    t = tier_table(spark, tiers)
    return field.join(F.broadcast(t), (f64(field.att) >= t.lo) & (f64(field.att) < t.hi) & ~F.isnan(field.att), "left")


def bits_of(tier: Column, tiers: Sequence[Tier] = DEFAULT_TIERS) -> Column:
    return F.element_at(F.array(*(F.lit(t.bits) for t in tiers)), tier + 1)


def auto_tiers(field: DataFrame, att: str = "att", quantiles: Sequence[float] = (0.60, 0.90, 0.99), keys: list[str] | None = None) -> DataFrame:
    """(*keys, cuts): quantiles of attention by linear interpolation, made to rise by 1e-6 at least. Attention is of 32 bits."""
    keys = keys or ["field_id"]
    rising = F.aggregate("q", F.array().cast("array<double>"), lambda acc, v: F.concat(acc, F.array(F.when((F.size(acc) > 0) & (v <= F.try_element_at(acc, F.lit(-1))), F.try_element_at(acc, F.lit(-1)) + 1e-6).otherwise(v))))
    return ranks.quantiles(field, keys, F.col(att), quantiles).select(*keys, rising.alias("cuts"))


def packed_bytes(n: Column, bits: Column) -> Column:
    """Bytes of n codes of 4, 8, 16 or 32 bits; an odd 4-bit code takes a byte."""
    return F.ceil(n * bits / 8).cast("long")


def histogram(field: DataFrame, keys: list[str], tiers: Sequence[Tier] = DEFAULT_TIERS) -> DataFrame:
    """(*keys, tier, n, pct, bytes)"""
    counts = field.groupBy(*keys, "tier").agg(F.count(F.lit(1)).alias("n"))
    share = 100.0 * F.col("n") / F.sum("n").over(Window.partitionBy(*keys))
    return counts.withColumns({"pct": share, "bytes": packed_bytes(F.col("n"), bits_of(F.col("tier"), tiers))})


def code(x: Column, lo: Column, hi: Column, bits: Column) -> Column:
    """32-bit arithmetic to the code of 2 ** bits levels; null where the tier has no spread or keeps values whole."""
    lo, hi = f32(lo), f32(hi)
    levels = F.pow(F.lit(2.0), f64(bits)) - 1
    spread = f64(hi - lo)
    unit = f32(f64(f32(x) - lo) / F.when(spread >= _NO_SPREAD, spread))
    scaled = F.when(bits < 32, f64(f32(unit * f32(levels))))
    return F.when((spread >= _NO_SPREAD) & (bits < 32), clamp(half_even(scaled), F.lit(0.0), levels))


def decode(c: Column, lo: Column, hi: Column, bits: Column, x: Column) -> Column:
    """64-bit arithmetic back to 32 bits; values kept whole come back as they are."""
    levels = F.pow(F.lit(2.0), f64(bits)) - 1
    return F.when(bits >= 32, f32(x)).when(f64(hi) - f64(lo) < _NO_SPREAD, f32(lo)).otherwise(f32(f64(lo) + c / levels * (f64(hi) - f64(lo))))


def quantize(field: DataFrame, keys: list[str], tiers: Sequence[Tier] = DEFAULT_TIERS, x: str = "x", shape: tuple[int, ...] | None = None) -> DataFrame:
    """field with tier: adds bits, lo, hi of the tier in its field, code and xh. The ranges are a window in grids that a tile
    holds, by their shape; else one row for each field and tier, joined back."""
    if halo.is_one_tile(shape):
        w = Window.partitionBy(*keys, "tier")
        out = field.withColumns({"lo": F.min(x).over(w), "hi": F.max(x).over(w)})
    else:
        ranges = field.groupBy(*keys, "tier").agg(F.min(x).alias("lo"), F.max(x).alias("hi"))
        out = correct.attach(field, ranges, [*keys, "tier"])
    out = out.withColumn("bits", bits_of(F.col("tier"), tiers))
    out = out.withColumn("code", code(F.col(x), F.col("lo"), F.col("hi"), F.col("bits")))
    return out.withColumn("xh", decode(F.col("code"), F.col("lo"), F.col("hi"), F.col("bits"), F.col(x)))


def energy_report(coded: DataFrame, keys: list[str], x: str = "x", metric=inv.energy) -> DataFrame:
    """(*keys, original, before, fixed, low, alpha): energy of original and reconstruction, of the tiers that are kept
    and that may be rescaled, and the factor for the latter. ``metric`` may be another quadratic aggregate."""
    low = F.col("bits") <= CORRECTABLE_BITS
    v = F.col("xh")
    sums = coded.groupBy(*keys).agg(
        metric(F.col(x)).alias("original"), metric(v).alias("before"),
        F.coalesce(metric(F.when(~low, v)), F.lit(0.0)).alias("fixed"), F.coalesce(metric(F.when(low, v)), F.lit(0.0)).alias("low"),
    )
    return sums.withColumn("alpha", correct.tier_scale(F.col("original"), F.col("fixed"), F.col("low"), strictly=False))


def correct_energy(coded: DataFrame, keys: list[str], x: str = "x") -> DataFrame:
    """Adds xc: the reconstruction with its correctable tiers rescaled."""
    report = energy_report(coded, keys, x).select(*keys, "alpha")
    scaled = f32(F.col("alpha") * f64(F.col("xh")))
    return correct.attach(coded, report, keys).withColumn("xc", F.when(F.col("bits") <= CORRECTABLE_BITS, scaled).otherwise(F.col("xh")))
