"""Bit patterns and exact ranks against NumPy."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from steadfield.functions import bits as B
from steadfield.functions import words
from steadfield.operators import ranks


def odd_doubles(seed=1):
    rng = np.random.default_rng(seed)
    every = [np.ldexp(1.0, e) for e in range(-1074, 1024)]
    near = [np.nextafter(v, s) for v in every for s in (0, np.inf)]
    some = rng.integers(0, 1 << 64, 3000, dtype=np.uint64).view(np.float64)
    v = np.array([0.0, -0.0, np.inf, -np.inf, np.nan, 5e-324, -5e-324, 2.2250738585072009e-308, 1.7976931348623157e308, *every, *near, *some])
    return np.concatenate((v, -v))


def odd_floats(seed=2):
    rng = np.random.default_rng(seed)
    every = np.array([np.ldexp(np.float32(1), e) for e in range(-149, 128)], dtype=np.float32)
    near = np.concatenate([np.nextafter(every, np.float32(s)) for s in (0, np.inf)])
    some = rng.integers(0, 1 << 32, 3000, dtype=np.uint32).view(np.float32)
    v = np.concatenate((np.array([0.0, -0.0, np.inf, np.nan, 1e-45, 3.4028235e38], dtype=np.float32), every, near, some))
    return np.concatenate((v, -v))


@pytest.mark.parametrize("width", [32, 64])
def test_bits_there_and_back(spark, width):
    x = odd_doubles() if width == 64 else odd_floats()
    to, back = (B.double_to_bits, B.bits_to_double) if width == 64 else (B.float_to_bits, B.bits_to_float)
    df = spark.createDataFrame([(k, float(v)) for k, v in enumerate(x)], "k int, x double").withColumn("x", F.col("x").cast("double" if width == 64 else "float"))
    out = df.withColumn("b", to(F.col("x"))).withColumn("y", back(F.col("b"))).withColumn("o", B.order_of(F.col("x"), width)).withColumn("w", B.about_one(F.col("b"), width))
    out = out.select("k", "x", "b", "y", "o", "w", to(B.of_order(F.col("o"), width)).alias("u"), B.from_about_one(F.col("w"), width).alias("v")).orderBy("k").toPandas()
    want = x.view(np.int64 if width == 64 else np.uint32).astype(np.int64)
    nan = np.isnan(x)
    want[nan] = 0x7FF8000000000000 if width == 64 else 0x7FC00000
    assert (out.b.to_numpy() == want).all()
    y = out.y.to_numpy().astype(x.dtype)
    assert (y[~nan].view(np.int64 if width == 64 else np.uint32) == x[~nan].view(np.int64 if width == 64 else np.uint32)).all() and np.isnan(y[nan]).all()
    assert (out.u == out.b).all() and (out.v == out.b).all()
    order = np.argsort(out.o.to_numpy(), kind="stable")
    real = x[order][: (~nan).sum()]
    assert (real[1:] >= real[:-1]).all() and np.isnan(x[order][(~nan).sum() :]).all()
    if width == 32:
        assert (out.w.to_numpy() == words.rotate_sign(want.astype(np.uint32)).astype(np.int64)).all()
    null = spark.createDataFrame([(None,)], "x double").select(to(F.col("x")).alias("b")).select("b", back(F.col("b")).alias("y")).first()
    assert null.b is None and null.y is None


def fields(spark, width):
    rng = np.random.default_rng(5)
    of = {
        "narrow": 280 + rng.uniform(-1, 1, 3000),
        "same": np.full(2000, -7.25),
        "signed": np.concatenate((rng.normal(size=501), [-0.0, 0.0, np.inf, -np.inf])),
        "one": np.array([3.5]),
        "ties": rng.integers(-3, 4, 1000).astype(float),
        "wide": np.exp(rng.uniform(-80, 80, 700)) * rng.choice([-1, 1], 700),
    }
    of = {k: v.astype(np.float32 if width == 32 else np.float64) for k, v in of.items()}
    rows = [(k, float(x)) for k, v in of.items() for x in v] + [("narrow", None), ("none", None)]
    return of, spark.createDataFrame(rows, "field_id string, x double").withColumn("x", F.col("x").cast("float" if width == 32 else "double")).repartition(5)


@pytest.mark.parametrize("width", [32, 64])
def test_ranks_against_numpy(spark, width):
    of, df = fields(spark, width)
    for percent in (0.0, 37.0, 97.0, 100.0):
        got = {r.field_id: r.kth for r in ranks.kth_smallest(df, ["field_id"], F.col("x"), percent, width).collect()}
        assert got == {k: np.sort(v)[int(percent / 100 * (len(v) - 1))] for k, v in of.items()}
    got = {r.field_id: r.q for r in ranks.quantiles(df, ["field_id"], F.col("x"), (0.0, 0.25, 0.6, 0.999, 1.0), width).collect()}
    assert set(got) == set(of)
    for k, v in of.items():
        if k != "signed":
            assert np.allclose(got[k], np.quantile(v.astype(np.float64), (0.0, 0.25, 0.6, 0.999, 1.0)), rtol=1e-12, atol=0), k
    assert got["signed"][0] == -np.inf and got["signed"][-1] == np.inf


def test_no_window_over_rows(spark):
    """Each window runs over counts: above every window's exchange stands a partial count."""
    _, df = fields(spark, 32)
    plan = ranks.select(df, ["field_id"], F.col("x"), lambda n: F.array(F.struct(F.lit(0).alias("id"), (n - 1).alias("rank"))))._jdf.queryExecution().executedPlan().toString()
    assert "Window" in plan and "Python" not in plan
    lines = [x.strip(" :+-*") for x in plan.splitlines()]
    for k, line in enumerate(lines):
        if line.startswith("Window"):
            below = next(x for x in lines[k + 1 :] if not re.match("Sort |Exchange|Project", x))
            assert re.match("(Hash|Sort|ObjectHash)Aggregate", below), below


def test_empty(spark):
    df = spark.createDataFrame([], "field_id string, x float")
    assert ranks.quantiles(df, ["field_id"], F.col("x"), (0.5,)).count() == 0
