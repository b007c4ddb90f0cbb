"""Differences and sums over neighbours on grids and lines, as windows over lines.

A window is partitioned by the field and all axes but the one along which it looks, so a task holds lines, not fields.
For one long line ``gradient_line`` partitions by blocks and fetches the neighbours over block edges by a join; the
``..._tiled`` operators and ``attention`` cut larger grids to tiles with a rim (``halo``), shuffled once for all axes.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import f32, f64
from . import correct, halo
from . import invariants as inv

#: A smoothing kernel is cut at so many standard deviations.
TRUNCATE = 4.0


def _along(axes: list[str], axis: str, keys: list[str]):
    return Window.partitionBy(*keys, *(a for a in axes if a != axis)).orderBy(axis)


def gradient(x: str, axes: list[str], axis: str, keys: list[str]) -> Column:
    """Central differences inside, one-sided at the two ends; 0 on a line of one value."""
    w = _along(axes, axis, keys)
    before, after, here = F.lag(f64(F.col(x))).over(w), F.lead(f64(F.col(x))).over(w), f64(F.col(x))
    return F.when(before.isNull() & after.isNull(), F.lit(0.0)).when(before.isNull(), after - here).when(after.isNull(), here - before).otherwise((after - before) / 2)


def gradient_magnitude(x: str, axes: list[str], keys: list[str]) -> Column:
    return F.sqrt(sum((gradient(x, axes, a, keys) * gradient(x, axes, a, keys) for a in axes[1:]), gradient(x, axes, axes[0], keys) * gradient(x, axes, axes[0], keys)))


def curl_2d(u: str, v: str, axes: list[str], keys: list[str]) -> Column:
    """dv/dx less du/dy, where x runs along the second axis and y along the first."""
    return gradient(v, axes, axes[1], keys) - gradient(u, axes, axes[0], keys)


def curl_3d_magnitude(u: str, v: str, w: str, axes: list[str], keys: list[str]) -> Column:
    g = lambda c, k: gradient(c, axes, axes[k], keys)
    x, y, z = g(w, 1) - g(v, 2), g(u, 2) - g(w, 0), g(v, 0) - g(u, 1)
    return F.sqrt(x * x + y * y + z * z)


def kernel(sigma: float) -> list[float]:
    """Weights of a normalised Gaussian, from the middle outwards."""
    radius = int(TRUNCATE * sigma + 0.5)
    raw = [math.exp(-0.5 * (k / sigma) ** 2) for k in range(radius + 1)]
    total = raw[0] + 2 * sum(raw[1:])
    return [r / total for r in raw]


def smooth(x: str, n: int, sigma: float, axes: list[str], axis: str, keys: list[str], part: bool = False) -> Column:
    """One axis of a separable Gaussian on a line of n values, reflected at its ends (d c b a | a b c d | d c b a). part:
    the rows hold a stretch of the line, of which the values within the kernel's radius of either end are not right."""
    w = _along(axes, axis, keys)
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    line = F.collect_list(f64(F.col(x))).over(whole)
    first = F.min(axis).over(whole) if part else F.lit(0)
    weights = kernel(sigma)
    at = lambda k: F.pmod(F.col(axis) + k, F.lit(2 * n))
    place = lambda k: F.when(at(k) < n, at(k)).otherwise(2 * n - 1 - at(k)) - first
    value = lambda k: F.get(line, F.when(place(k) >= 0, place(k)).cast("int")) if part else F.get(line, place(k).cast("int"))
    return sum(((value(k) + value(-k)) * c for k, c in enumerate(weights) if k), value(0) * weights[0])


def smooth_tiled(field: DataFrame, x: str, out: str, shape: tuple[int, ...], sigma: float, axes: list[str], keys: list[str], size: int | None = None) -> DataFrame:
    """Adds out: x smoothed along all axes, tile by tile."""
    rows = halo.tiled(field, axes, keys, len(kernel(sigma)) - 1, size, shape).withColumn(out, f64(F.col(x)))
    for axis, n in zip(axes, shape):
        rows = rows.withColumn(out, smooth(out, n, sigma, axes, axis, [*keys, *halo.tile_names(axes)], part=True))
    return halo.own(rows, axes, size)


def curl_3d_tiled(field: DataFrame, u: str, v: str, w: str, out: str, axes: list[str], keys: list[str], size: int | None = None) -> DataFrame:
    """Adds out: the magnitude of the curl, tile by tile."""
    rows = halo.tiled(field, axes, keys, 1, size)
    return halo.own(rows.withColumn(out, curl_3d_magnitude(u, v, w, axes, [*keys, *halo.tile_names(axes)])), axes, size)


def normalise(x: Column, lo: Column, hi: Column) -> Column:
    """To [0, 1] in 32 bits; all 0 where the range is next to nothing."""
    lo, hi = f32(lo), f32(hi)
    return F.when(f64(hi) - f64(lo) < 1e-12, F.lit(0.0).cast("float")).otherwise(f32(f64(f32(x) - lo) / F.when(f64(hi) - f64(lo) >= 1e-12, f64(hi - lo))))


def attention(
    field: DataFrame, components: list[str], axes: list[str], keys: list[str], sigma: float | None = 0.6, shape: tuple[int, ...] | None = None, size: int | None = None
) -> DataFrame:
    """Adds att: gradient magnitude of one component, curl of two or three, smoothed (two or three only) and scaled to
    [0, 1] within each field. Grids that a tile holds, by their shape, take their range in one window; all others are cut
    to tiles (of ``size`` along each axis), their range is an aggregate and is joined back."""
    if len(components) not in (1, 2, 3):
        raise ValueError("attention takes one to three components")
    smoothed = bool(sigma and shape and len(components) > 1)
    whole = size is None and halo.is_one_tile(shape)
    out, by = field, keys
    if not whole:
        out = halo.tiled(field, axes, keys, 1 + (len(kernel(sigma)) - 1 if smoothed else 0), size, shape)
        by = [*keys, *halo.tile_names(axes)]
    if len(components) == 1:
        raw = gradient_magnitude(components[0], axes, by)
    elif len(components) == 2:
        raw = F.abs(curl_2d(*components, axes, by))
    else:
        raw = curl_3d_magnitude(*components, axes, by)
    out = out.withColumn("_raw", raw)
    if smoothed:
        for axis, n in zip(axes, shape):
            out = out.withColumn("_raw", smooth("_raw", n, sigma, axes, axis, by, part=not whole))
    if whole:
        w = Window.partitionBy(*keys)
        out = out.withColumns({"_lo": F.min("_raw").over(w), "_hi": F.max("_raw").over(w)})
    else:
        out = halo.own(out, axes, size)
        out = correct.attach(out, out.groupBy(*keys).agg(F.min("_raw").alias("_lo"), F.max("_raw").alias("_hi")), keys)
    return out.withColumn("att", normalise(F.col("_raw"), F.col("_lo"), F.col("_hi"))).drop("_raw", "_lo", "_hi")


def gradient_line(field: DataFrame, x: str = "x", block: int = 65536, keys: list[str] | None = None) -> DataFrame:
    """Adds grad along i of long lines without a window over a whole line: rows are dealt to blocks of i, each with one
    neighbour row of either side."""
    keys = keys or ["field_id"]
    here = F.floor(F.col("i") / block).cast("long")
    blocks = F.array_distinct(F.array(here, F.floor((F.col("i") - 1) / block).cast("long"), F.floor((F.col("i") + 1) / block).cast("long")))
    spread = field.withColumn("_home", here).withColumn("_block", F.explode(blocks))
    w = Window.partitionBy(*keys, "_block").orderBy("i")
    before, after, at = F.lag(f64(F.col(x))).over(w), F.lead(f64(F.col(x))).over(w), f64(F.col(x))
    grad = F.when(before.isNull() & after.isNull(), F.lit(0.0)).when(before.isNull(), after - at).when(after.isNull(), at - before).otherwise((after - before) / 2)
    return spread.withColumn("grad", grad).filter(F.col("_block") == F.col("_home")).drop("_block", "_home")


def ring_shift(field: DataFrame, n: int, by: int, columns: list[str], keys: list[str], i: str = "i") -> DataFrame:
    """Adds next_<column>: the value ``by`` places further on a ring of n, by an equi-join."""
    moved = field.select(*keys, F.pmod(F.col(i) - by, F.lit(n)).alias(i), *(F.col(c).alias(f"next_{c}") for c in columns))
    return field.join(moved, [*keys, i])


def range_of(field: DataFrame, x: str, keys: list[str]) -> DataFrame:
    return field.groupBy(*keys).agg(F.min(x).alias("lo"), F.max(x).alias("hi"), inv.mass(F.col(x)).alias("mass"))
