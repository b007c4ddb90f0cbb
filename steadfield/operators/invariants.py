"""Aggregate expressions: sums, moments, errors, violations and drifts. All of one pass go into one ``agg``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import clamp, f32, f64


def mass(x: Column) -> Column:
    return F.sum(f64(x))


def energy(x: Column) -> Column:
    return F.sum(f64(x) * f64(x))


def weighted(x: Column, w: Column) -> Column:
    return F.sum(f64(w) * f64(x))


def total_energy(x: Column, density: float = 1.0) -> Column:
    return F.lit(0.5 * density) * energy(x)


def mean_and_variance(n: Column, s1: Column, s2: Column) -> tuple[Column, Column]:
    """From a count and two sums; the population variance as mean square less squared mean."""
    mean = s1 / n
    return mean, s2 / n - mean * mean


def invariants(field: DataFrame, x: str = "x", keys: list[str] | None = None) -> DataFrame:
    """(field_id, n, mass, energy) in one pass."""
    return field.groupBy(*(keys or ["field_id"])).agg(F.count(F.lit(1)).alias("n"), mass(F.col(x)).alias("mass"), energy(F.col(x)).alias("energy"))


def vector_invariants(field: DataFrame, components: list[str], keys: list[str]) -> DataFrame:
    """Energy over all components and the momentum of each."""
    total = sum((f64(F.col(c)) * f64(F.col(c)) for c in components[1:]), f64(F.col(components[0])) * f64(F.col(components[0])))
    return field.groupBy(*keys).agg(F.sum(total).alias("energy"), *(mass(F.col(c)).alias(f"momentum_{c}") for c in components))


def capped_moments(x: Column, mu0: Column, cap: Column) -> dict[str, Column]:
    """The five sums of the capped solve; g is the deviation from mu0, clipped at the cap."""
    v = f64(x)
    g = clamp(v - mu0, -cap, cap)
    return {"n": F.count(F.lit(1)), "s1": F.sum(v), "s2": F.sum(v * v), "g1": F.sum(g), "g2": F.sum(g * g), "xg": F.sum(v * g)}


def error_stats(x: Column, xh: Column) -> dict[str, Column]:
    d = F.abs(f64(x) - f64(xh))
    return {
        "max_abs": F.max(d),
        "mean_abs": F.avg(d),
        "rmse": F.sqrt(F.avg(d * d)),
        "max_rel_pct": F.max(d) / (F.max(F.abs(f64(x))) + F.lit(1e-12)) * 100,
    }


def psnr(x: Column, xh: Column) -> Column:
    """Peak signal-to-noise ratio of the value range, in decibels; infinite without error."""
    d = f64(x) - f64(xh)
    mse, span = F.avg(d * d), F.max(f64(x)) - F.min(f64(x))
    return F.when(mse == 0, F.lit(float("inf"))).when(span > 0, 20 * F.log10(span) - 10 * F.log10(mse))


def drift(before: Column, after: Column) -> Column:
    """Relative change; null where there is next to nothing to relate it to."""
    return F.when(F.abs(before) > 1e-12, F.abs(after - before) / F.abs(before))


def drift_or_null(before: Column, after: Column, least: float = 1.0) -> Column:
    return F.when(F.abs(before) >= least, F.abs(after - before) / F.abs(before))


def violates(x: Column, xh: Column, bound: float) -> Column:
    """Whether a reconstruction leaves the absolute bound, in 32-bit arithmetic."""
    b, x, xh = F.lit(float(bound)).cast("float"), f32(x), f32(xh)
    return (xh < x - b) | (xh > x + b) | (F.abs(x - xh) > b)


def violates_relative(x: Column, xh: Column, bound: float) -> Column:
    """Whether the ratio is further from 1 than the bound; a nonzero reconstruction of zero always is."""
    return F.when(f64(x) == 0, f64(xh) != 0).otherwise(F.abs(1 - f64(xh) / F.when(f64(x) != 0, f64(x))) > bound)


def not_finite(x: Column) -> Column:
    return F.isnan(x) | (F.abs(f64(x)) == float("inf"))


def violation_counts(x: Column, xh: Column, bound: float) -> dict[str, Column]:
    """Values outside the bound, and values whose being finite is lost, counted apart."""
    bad = not_finite(x) | not_finite(xh)
    same = (F.isnan(x) & F.isnan(xh)) | (f64(x) == f64(xh))
    return {
        "n": F.count(F.lit(1)),
        "violations": F.count_if(~bad & violates(x, xh, bound)),
        "not_finite_mismatches": F.count_if(bad & ~same),
    }


def top_k(rows: DataFrame, by: list[Column], k: int) -> DataFrame:
    """The first k rows of an order."""
    return rows.orderBy(*by).limit(k)


def geometric_mean(x: Column) -> Column:
    return F.exp(F.avg(F.ln(x)))
