"""Stencils tile by tile are what they are on the whole grid, and no tile is larger than its side and rim allow."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from steadfield.operators import halo, stencil

AXES = ["i0", "i1", "i2"]


def grid3(spark, shape, seed=3):
    rng = np.random.default_rng(seed)
    values = [rng.standard_normal(shape).astype(np.float32) for _ in range(3)]
    at = np.indices(shape).reshape(3, -1)
    rows = zip(*(a.tolist() for a in at), *(v.ravel().tolist() for v in values))
    df = spark.createDataFrame(list(rows), "i0 long, i1 long, i2 long, u float, v float, w float").withColumn("field_id", F.lit("f"))
    return df, values


def dense(df, c, shape):
    out = np.full(shape, np.nan)
    for r in df.select(*AXES[: len(shape)], c).collect():
        out[tuple(r[:-1])] = r[-1]
    return out


@pytest.mark.parametrize("size", [5, 8, 64])
def test_curl_and_smoothing(spark, size):
    shape = (19, 8, 13)
    df, (u, v, w) = grid3(spark, shape)
    u, v, w = (x.astype(np.float64) for x in (u, v, w))
    g = np.gradient
    want = np.sqrt((g(w, axis=1) - g(v, axis=2)) ** 2 + (g(u, axis=2) - g(w, axis=0)) ** 2 + (g(v, axis=0) - g(u, axis=1)) ** 2)
    assert np.allclose(dense(stencil.curl_3d_tiled(df, "u", "v", "w", "c", AXES, ["field_id"], size), "c", shape), want)
    k = stencil.kernel(1.1)
    full = np.array(k[:0:-1] + k)

    def along(x, axis):
        pad = [(len(k) - 1, len(k) - 1) if a == axis else (0, 0) for a in range(3)]
        return np.apply_along_axis(lambda line: np.convolve(line, full, "valid"), axis, np.pad(x, pad, mode="symmetric"))

    s = u
    for a in range(3):
        s = along(s, a)
    assert np.allclose(dense(stencil.smooth_tiled(df, "u", "s", shape, 1.1, AXES, ["field_id"], size), "s", shape), s)


@pytest.mark.parametrize("components", [1, 2, 3])
def test_attention(spark, components):
    shape = (17, 12, 10)
    df, _ = grid3(spark, shape)
    axes, shape = (AXES, shape) if components != 2 else (AXES[:2], shape[:2])
    if components == 2:
        df = df.filter("i2 = 4").drop("i2")
    args = (["u", "v", "w"][:components], axes, ["field_id"])
    whole = dense(stencil.attention(df, *args, shape=shape), "att", shape)
    cut = dense(stencil.attention(df, *args, shape=shape, size=4), "att", shape)
    assert not np.isnan(whole).any() and np.array_equal(whole, cut) and whole.min() == 0 and whole.max() == 1


def test_tiles_are_small(spark):
    n, size, rim = 48, 16, 3
    df = spark.range(n**3).select(*(F.expr(f"cast(id div {n ** (2 - k)} % {n} as bigint)").alias(a) for k, a in enumerate(AXES)), F.lit(1).alias("field_id"))
    cut = halo.tiled(df, AXES, ["field_id"], rim, size, (n, n, n))
    sizes = [r[0] for r in cut.groupBy(*halo.tile_names(AXES)).count().select("count").collect()]
    assert len(sizes) == 27 and max(sizes) == (size + 2 * rim) ** 3
    assert halo.own(cut, AXES, size).count() == n**3
    plan = stencil.curl_3d_tiled(df.withColumns({c: F.rand(1).cast("float") for c in "uvw"}), "u", "v", "w", "c", AXES, ["field_id"], size)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1  # one shuffle for three axes
