"""Users' metrics as mergeable aggregates, and the corrections that they steer, against NumPy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from steadfield.operators import metrics


def coded(spark, seed=1):
    rng = np.random.default_rng(seed)
    rows = []
    for name, n in (("a", 900), ("b", 77)):
        x = rng.gamma(2, 3, n) * rng.choice([-1, 1], n)
        bits = rng.choice([4, 8, 32], n)
        xh = np.where(bits == 32, x, np.sign(x) * np.floor(np.abs(x) * 2) / 2)
        rows += [(name, float(p), float(q), int(b)) for p, q, b in zip(x, xh, bits)]
    return spark.createDataFrame([*rows, ("a", None, None, 4)], "field_id string, x double, xh double, bits int").repartition(5)


def by_hand(v, name):
    return v.std() if name == "deviation" else np.log1p(np.abs(v)).sum()


@pytest.mark.parametrize("name", ["deviation", "softened"])
def test_a_metric_steers_the_correction(spark, name, monkeypatch):
    monkeypatch.setattr(metrics, "FAN", 2)
    metric = {"deviation": metrics.DEVIATION, "softened": metrics.SOFTENED}[name]
    df = coded(spark)
    rows = df.filter("x is not null").toPandas()
    got = {r.field_id: r for r in metrics.steer(df, ["field_id"], metric).collect()}
    done = df if name == "softened" else metrics.correct(df, ["field_id"], metric)
    done = done.filter("x is not null").toPandas()
    for k, g in rows.groupby("field_id"):
        want = by_hand(g.x.to_numpy(), name)
        assert got[k].ok and got[k].target == pytest.approx(want, rel=1e-12) and got[k].before == pytest.approx(by_hand(g.xh.to_numpy(), name), rel=1e-12)
        assert got[k].after == pytest.approx(want, rel=1e-7) and abs(got[k].before / want - 1) > 1e-3
        if name == "softened":
            continue
        moved = done[done.field_id == k]
        assert by_hand(moved.xc.to_numpy(), name) == pytest.approx(want, rel=1e-6)
        assert (moved[moved.bits == 32].xc == moved[moved.bits == 32].xh).all()


def test_a_metric_of_ones_own(spark):
    """A histogram as state, the middle of which is the number: nothing that Spark has."""
    edges = np.linspace(-50, 50, 2001)
    mine = metrics.Metric(lambda v: np.histogram(v, np.linspace(-50, 50, 2001))[0], lambda a, b: a + b, lambda h: float(np.searchsorted(np.cumsum(h), h.sum() / 2)))
    df = coded(spark, 3)
    got = {r.field_id: r.m for r in metrics.measure(df, ["field_id"], mine, m=F.col("x")).collect()}
    for k, g in df.filter("x is not null").toPandas().groupby("field_id"):
        h = np.histogram(g.x, edges)[0]
        assert got[k] == np.searchsorted(np.cumsum(h), h.sum() / 2)


def test_nothing_to_reach(spark):
    df = spark.createDataFrame([("f", 5.0, 0.0, 4), ("f", 1.0, 0.0, 4), ("g", 2.0, 2.0, 4), ("g", -1.0, -1.0, 8)], "field_id string, x double, xh double, bits int")
    got = {r.field_id: r for r in metrics.steer(df, ["field_id"], metrics.DEVIATION).collect()}
    assert not got["f"].ok and got["f"].alpha == 1 and got["g"].ok and got["g"].alpha == 1
    assert metrics.steer(df.limit(0), ["field_id"], metrics.DEVIATION).count() == 0
