"""Order-free sums and joint restoration against exact arithmetic and NumPy."""

import math
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from steadfield.operators import joint, superacc


def test_sums_are_exact_in_any_order(spark):
    rng = np.random.default_rng(1)
    of = {
        "wide": np.concatenate((np.ldexp(rng.standard_normal(3000), rng.integers(-1000, 900, 3000)), [5e-324, -5e-324, 2.0**-1022])),
        "cancel": np.concatenate((v := rng.standard_normal(999) * 1e17, -v, [0.25, 1e-9])),
        "narrow": 280 + rng.uniform(-1, 1, 4000),
        "zero": np.array([-0.0, 0.0]),
        "huge": np.full(30, 1.7e308),
    }
    rows = [(k, float(x)) for k, v in of.items() for x in v] + [("nan", math.nan), ("nan", 1.0), ("inf", math.inf), ("inf", -5.0), ("both", math.inf), ("both", -math.inf), ("none", None), ("narrow", None)]
    df = spark.createDataFrame(rows, "field_id string, x double")
    seen = []
    for n in (1, 7):
        got = {r.field_id: (r.s, r.t) for r in superacc.exact_sums(df.repartition(n), {"s": F.col("x"), "t": -F.col("x") / 4}).collect()}
        for k, v in of.items():
            total = sum((Fraction(float(x)) for x in v), Fraction(0))
            want = math.inf if total > Fraction(1.7976931348623157e308) else total.numerator / total.denominator
            assert got[k][0] == want, k
        assert math.isnan(got["nan"][0]) and got["inf"] == (math.inf, -math.inf) and math.isnan(got["both"][0]) and got["none"] == (None, None)
        seen.append({k: v for k, v in got.items() if k not in ("nan", "both")})
    assert seen[0] == seen[1]


@pytest.mark.parametrize("k", [1, 3])
def test_all_invariants_kept(spark, k):
    rng = np.random.default_rng(2)
    rows = []
    for name, n in (("a", 800), ("b", 60)):
        x = 280 + 3 * rng.standard_normal(n).cumsum()
        w = rng.uniform(0.5, 1.5, (n, 3)) * [1, 100, 1e-3]
        rows += [(name, float(a), float(np.floor(a / 5) * 5), *map(float, u)) for a, u in zip(x, w)]
    rows += [("constant", 1.0, 2.0, 1.0, float(i), 1.0) for i in range(5)]
    df = spark.createDataFrame(rows, "field_id string, x double, xh double, w0 double, w1 double, w2 double").repartition(3)
    weights = ["w0", "w1", "w2"][:k]
    done = joint.restore(df, weights).toPandas()
    for name, g in done.groupby("field_id"):
        if name == "constant":  # weights and reconstruction that don't vary
            assert not g.ok.any() and (g.xc == g.xh).all()
            continue
        assert g.ok.all()
        for f in (lambda v: v.sum(), lambda v: (v * v).sum(), *(lambda v, w=w: (v * g[w]).sum() for w in weights)):
            assert abs(f(g.xc) / f(g.x) - 1) < 1e-12
        assert np.abs(g.xc - g.xh).max() < 20
    p = {r.field_id: r for r in joint.joint_params(df, weights).collect()}
    assert p["a"].a > 0.9 and len(p["a"].c) == k and p["constant"].a == 1


def test_a_kept_reconstruction_is_not_moved():
    rng = np.random.default_rng(3)
    x, w = rng.standard_normal(50), rng.standard_normal((50, 2))
    c, u = x - x.mean(), w - w.mean(axis=0)
    a, b, k, ok = joint.solve(50, x.mean(), x.mean(), w.mean(axis=0), c @ c, c @ c, u.T @ c, u.T @ c, u.T @ u)
    assert ok and abs(a - 1) < 1e-12 and abs(b) < 1e-12 and np.abs(k).max() < 1e-12
    assert not joint.solve(50, 0.0, 0.0, np.zeros(2), 1.0, 1.0, np.zeros(2), np.zeros(2), np.ones((2, 2)))[3]  # one weight twice
