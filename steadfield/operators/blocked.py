"""The blocked codec on 3-D grids: cubes of B values, each with a mode and a bit width of its own.

A grid row has i0, i1, i2 and a value; blocks are keys, not arrays. Padding is left out of all sums: a block at an edge
holds the values that are there.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import clamp, f32, f64, half_even
from ..model import CORRECTABLE_BITS, DEFAULT_TIERS, Tier
from . import correct, tiers

FULL, CONST, RAW32, DOWN2 = 0, 1, 2, 3
BLOCK_AXES, AXES = ["b0", "b1", "b2"], ["i0", "i1", "i2"]


def with_blocks(grid: DataFrame, size: int) -> DataFrame:
    """Adds b0..b2 (which block) and r0..r2 (where in it)."""
    out = {}
    for k in range(3):
        out[f"b{k}"] = F.floor(F.col(f"i{k}") / size).cast("long")
        out[f"r{k}"] = F.pmod(F.col(f"i{k}"), F.lit(size)).cast("long")
    return grid.withColumns(out)


def pad_edges(grid: DataFrame, shape: tuple[int, int, int], size: int, keys: list[str], values: list[str]) -> DataFrame:
    """The grid extended to whole blocks by repeating its last values: each edge row is copied outwards."""
    out = grid
    for k, n in enumerate(shape):
        whole = -(-n // size) * size
        copies = F.when(F.col(f"i{k}") == n - 1, F.sequence(F.lit(n - 1).cast("long"), F.lit(whole - 1).cast("long"))).otherwise(F.array(F.col(f"i{k}").cast("long")))
        out = out.withColumn(f"i{k}", F.explode(copies))
    return out.select(*keys, *AXES, *values)


def crop(grid: DataFrame, shape: tuple[int, int, int]) -> DataFrame:
    return grid.filter(" and ".join(f"i{k} < {n}" for k, n in enumerate(shape)))


def block_stats(blocks: DataFrame, keys: list[str], x: str = "x", att: str = "att") -> DataFrame:
    v = F.col(x)
    return blocks.groupBy(*keys, *BLOCK_AXES).agg(
        F.count(F.lit(1)).alias("n"), F.min(v).alias("vmin"), F.max(v).alias("vmax"), F.avg(f64(v)).alias("vmean"), F.max(att).alias("amax")
    )


def bits_for(att: Column, specs: Sequence[Tier] = DEFAULT_TIERS) -> Column:
    """By the largest attention of a block; the last tier's bits where no tier holds it."""
    return tiers.bits_of(tiers.tier_of(att, specs, otherwise=len(specs) - 1), specs)


def coarsen(grid: DataFrame, keys: list[str], x: str = "x") -> DataFrame:
    """Means over cubes of two; keys should hold the block where blocks are coarsened one by one."""
    halves = [F.floor(F.col(f"i{k}") / 2).cast("long").alias(f"i{k}") for k in range(3)]
    return grid.groupBy(*keys, *halves).agg(F.avg(f64(F.col(x))).alias(x))


def _line_weights(size: int) -> list[tuple[int, int, float]]:
    """(fine, coarse, weight) along one axis, the ends of the coarse line lying on those of the fine one."""
    coarse, out = size // 2, []
    for fine in range(size):
        at = fine * (coarse - 1) / (size - 1) if size > 1 else 0.0
        lo = min(int(at), coarse - 1)
        part = at - lo
        out.append((fine, lo, 1.0 - part))
        if part > 0:
            out.append((fine, lo + 1, part))
    return out


def upsample(coarse: DataFrame, size: int, keys: list[str], x: str = "x") -> DataFrame:
    """Trilinear interpolation of coarse cubes (c0, c1, c2 from 0 to size / 2 - 1) to fine ones (r0, r1, r2): each coarse
    value is spread over the fine places that it has a weight for, and these are summed up."""
    spark = coarse.sparkSession
    out = coarse
    for k in range(3):
        table = spark.createDataFrame(_line_weights(size), f"r{k} long, c{k} long, w{k} double")
        out = out.join(F.broadcast(table), f"c{k}")  # 2 * size rows
    weight = F.col("w0") * F.col("w1") * F.col("w2")
    return out.groupBy(*keys, "r0", "r1", "r2").agg(f32(F.sum(f64(F.col(x)) * weight)).alias("up"))


def _level(x: Column, lo: Column, hi: Column, bits: Column) -> Column:
    """Code in 64 bits and back; lo itself without spread."""
    levels = F.pow(F.lit(2.0), f64(bits)) - 1
    spread = hi - lo
    c = clamp(half_even((f64(x) - lo) / F.when(spread >= 1e-12, spread) * levels), F.lit(0.0), levels)
    return F.when(spread < 1e-12, f32(lo)).otherwise(f32(lo + c / levels * spread))


def quantize(grid: DataFrame, size: int, keys: list[str], specs: Sequence[Tier] = DEFAULT_TIERS, down: str = "none", lowest: int | None = None, x: str = "x") -> DataFrame:
    """grid (keys, i0..i2, x, att) with block, mode, bits and xh. down says what blocks of the lowest width become: whole
    blocks ("none"), one mean ("const") or a coarse cube that is interpolated ("tri", for whole even blocks)."""
    if down not in ("none", "const", "tri"):
        raise ValueError(down)
    lowest = lowest if lowest is not None else min(t.bits for t in specs)
    # a block holds size ** 3 rows at most, so its figures are a window over them: one shuffle, and no join
    v, block = F.col(x), Window.partitionBy(*keys, *BLOCK_AXES)
    figures = {"n": F.count(F.lit(1)), "vmin": F.min(v), "vmax": F.max(v), "vmean": F.avg(f64(v)), "amax": F.max("att")}
    st = with_blocks(grid, size).withColumns({k: c.over(block) for k, c in figures.items()}).withColumn("bits", bits_for(F.col("amax"), specs))
    low = F.lit(down != "none") & (F.col("bits") <= lowest)
    if down == "tri":
        low = low & (F.col("n") == size**3) & F.lit(size % 2 == 0)
    out = st.withColumn("mode", F.when(F.col("bits") >= 32, RAW32).when(low, CONST if down == "const" else DOWN2).otherwise(FULL))
    whole = _level(F.col(x), f64(F.col("vmin")), f64(F.col("vmax")), F.col("bits"))
    if down == "tri":
        halves = {f"c{k}": F.floor(F.col(f"r{k}") / 2).cast("long") for k in range(3)}
        coarse = out.filter(F.col("mode") == DOWN2).withColumns(halves).groupBy(*keys, *BLOCK_AXES, "bits", "c0", "c1", "c2").agg(F.avg(f64(F.col(x))).alias("cx"))
        span = coarse.groupBy(*keys, *BLOCK_AXES).agg(F.min("cx").alias("clo"), F.max("cx").alias("chi"))
        coded = coarse.join(span, [*keys, *BLOCK_AXES]).withColumn("cx", _level(F.col("cx"), F.col("clo"), F.col("chi"), F.col("bits")))
        fine = upsample(coded, size, [*keys, *BLOCK_AXES], "cx")
        out = out.join(fine, [*keys, *BLOCK_AXES, "r0", "r1", "r2"], "left")
    else:
        out = out.withColumn("up", F.lit(None).cast("float"))
    return out.withColumn("xh", F.when(F.col("mode") == RAW32, f32(F.col(x))).when(F.col("mode") == CONST, f32(F.col("vmean"))).when(F.col("mode") == DOWN2, F.col("up")).otherwise(whole))


def energy_factor(coded: DataFrame, keys: list[str], x: str = "x", correctable: int = CORRECTABLE_BITS) -> DataFrame:
    """(*keys, target, fixed, low, alpha)"""
    low, e = F.col("bits") <= correctable, lambda c: f64(c) * f64(c)
    sums = coded.groupBy(*keys).agg(
        F.sum(e(F.col(x))).alias("target"),
        F.coalesce(F.sum(F.when(~low, e(F.col("xh")))), F.lit(0.0)).alias("fixed"),
        F.coalesce(F.sum(F.when(low, e(F.col("xh")))), F.lit(0.0)).alias("low"),
    )
    return sums.withColumn("alpha", correct.tier_scale(F.col("target"), F.col("fixed"), F.col("low"), strictly=True))


def correct_energy(coded: DataFrame, keys: list[str], x: str = "x", correctable: int = CORRECTABLE_BITS) -> DataFrame:
    out = correct.attach(coded, energy_factor(coded, keys, x, correctable).select(*keys, "alpha"), keys)
    return out.withColumn("xc", F.when(F.col("bits") <= correctable, f32(F.col("alpha") * f64(F.col("xh")))).otherwise(F.col("xh")))


def stream_bytes(coded: DataFrame, keys: list[str], size: int, dimensions: int = 3) -> DataFrame:
    """(*keys, bytes) of the container: a header, and for each block its record. 4 bytes of name, 1 + 8
    for each dimension, 1 for the block size, 9 for width and factor, 8 for each count of blocks; 9 bytes for a raw or
    constant block, 10 for others; then the codes."""
    per = coded.groupBy(*keys, *BLOCK_AXES, "mode", "bits").agg(F.count(F.lit(1)).alias("n"))
    codes = F.when(F.col("mode") == DOWN2, tiers.packed_bytes(F.col("n") / 8, F.col("bits"))).otherwise(tiers.packed_bytes(F.col("n"), F.col("bits")))
    record = F.when(F.col("mode") == RAW32, 9 + 4 * F.col("n")).when(F.col("mode") == CONST, F.lit(9)).otherwise(10 + codes)
    header = 4 + 1 + 8 * dimensions + 1 + 9 + 8 * 3
    return per.groupBy(*keys).agg((F.sum(record) + header).cast("long").alias("bytes"))


def second_moments(blocks: DataFrame, keys: list[str], u: str = "u", v: str = "v", w: str = "w") -> DataFrame:
    """The six distinct entries of the sum of outer products of (u, v, w) in each block."""
    pairs = {"uu": (u, u), "uv": (u, v), "uw": (u, w), "vv": (v, v), "vw": (v, w), "ww": (w, w)}
    return blocks.groupBy(*keys).agg(*(F.sum(f64(F.col(a)) * f64(F.col(b))).alias(n) for n, (a, b) in pairs.items()))
