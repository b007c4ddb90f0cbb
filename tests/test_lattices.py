"""Lattice queries on all events, against a plain count and SQL."""

import math

import pytest
from pyspark.sql import functions as F

from steadfield.plans import grids, joins  # noqa: F401
from steadfield.plans.base import ORACLE_SQL, QUERIES

NAMES = [f"q_{n}" for n in ("lbm_moments", "lbm_restore", "lbm_stream", "lbm_collide", "lbm_step", "lattice_join", "opposite_join")]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("lattices"))
    spark.range(1_230).select(F.col("id").alias("event_id"), (F.col("id") % 97 / 10.0).alias("value")).write.parquet(f"{d}/events.parquet")
    return d


def test_every_event_is_a_node(spark, tables):
    n = grids.lattices(spark, tables)
    assert n.count() == 3 * 500
    rest = n.filter("g = 2 and y * 25 + x >= 230").agg(F.count("*"), F.max(F.abs(sum(F.col(f"f{k}") for k in range(9)) - 1))).first()
    assert rest[0] == 270 and rest[1] < 1e-12


def test_step_takes_in_all_lattices(spark, tables):
    steps = grids.lbm_step(spark, tables).collect()
    assert len(steps) == 3 and all(r.mass == pytest.approx(500, rel=0.05) for r in steps)


@pytest.mark.parametrize("name", NAMES)
def test_same_as_sql(spark, tables, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tables}/events.parquet/*.parquet'")
    got = sorted(map(tuple, QUERIES[name](spark, tables).collect()))
    want = sorted(con.execute(ORACLE_SQL[name]).fetchall())
    assert len(got) == len(want) and {r[0] for r in got} == {0, 1, 2}
    assert all(math.isclose(a, b, abs_tol=1e-8) for r, s in zip(got, want) for a, b in zip(r, s))
