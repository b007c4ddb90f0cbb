"""Queries on joins of fields, weights and lattices, and on suites of methods."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.numeric import f32, f64, floor_quantize, uniform_quantize
from ..operators import codecs, solvers, sweeps
from ..operators import invariants as inv
from .base import EVENTS, D, R, events, query, rnd, table
from .coding import _CANDIDATES
from .grids import _LATTICES, lattices


@query(
    "q_positional_join",
    f"""SELECT a.field_id, count(*) AS n, {R(f'max(abs({D("a.x")} - {D("b.xh")}))', 6)} AS max_abs FROM ({EVENTS}) a JOIN (SELECT field_id, i, CAST(floor({D('x')} / 0.5) * 0.5 AS FLOAT) AS xh FROM ({EVENTS})) b USING (field_id, i) GROUP BY a.field_id""",
)
def positional_join(spark, d):
    """An original and a reconstruction that are stored apart."""
    back = events(spark, d).select("field_id", "i", f32(floor_quantize(F.col("x"), 0.5)).alias("xh"))
    both = events(spark, d).join(back, ["field_id", "i"])
    return both.groupBy("field_id").agg(F.count(F.lit(1)).alias("n"), rnd(F.max(F.abs(f64(F.col("x")) - f64(F.col("xh")))), 6).alias("max_abs"))


@query(
    "q_weight_join",
    f"SELECT o_orderpriority AS field_id, {R(f'sum({D("CAST(c_acctbal AS FLOAT)")} * {D("CAST(o_totalprice AS FLOAT)")})', -6)} AS momentum, {R(f'sum({D("CAST(c_acctbal AS FLOAT)")})', 1)} AS weight FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1",
)
def weight_join(spark, d):
    """A weight that is stored in another table."""
    w = table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_acctbal").cast("float").alias("w"))
    both = table(spark, d, "orders").select("o_custkey", F.col("o_orderpriority").alias("field_id"), F.col("o_totalprice").cast("float").alias("x")).join(w, "o_custkey")
    return both.groupBy("field_id").agg(rnd(inv.weighted(F.col("x"), F.col("w")), -6).alias("momentum"), rnd(inv.mass(F.col("w")), 1).alias("weight"))


_LATTICE = ", ".join(f"({k}, {x}, {y}, {o})" for k, (x, y, o) in enumerate(zip(solvers.LATTICE_X, solvers.LATTICE_Y, solvers.OPPOSITE)))
_LONG = " UNION ALL ".join(f"SELECT g, y, x, {k} AS dir, f{k} AS f FROM a" for k in range(9))
_WITH = f"WITH l(dir, cx, cy, opp) AS (VALUES {_LATTICE}), a AS MATERIALIZED ({_LATTICES}), n AS MATERIALIZED ({_LONG})"


@query("q_lattice_join", f"{_WITH} SELECT g, y, x, {R('sum(f)', 8)} AS rho, {R('sum(f * cx)', 8)} AS jx, {R('sum(f * cy)', 8)} AS jy FROM n JOIN l USING (dir) GROUP BY g, y, x")
def lattice_join(spark, d):
    """Moments from the long form: directions as rows, joined to the lattice table of nine rows."""
    long = lattices(spark, d).select("g", "y", "x", F.posexplode(F.array(*(f"f{k}" for k in range(9)))).alias("dir", "f"))
    both = long.join(F.broadcast(solvers.lattice(spark)), "dir")
    return both.groupBy("g", "y", "x").agg(rnd(F.sum("f"), 8).alias("rho"), rnd(F.sum(F.col("f") * F.col("cx")), 8).alias("jx"), rnd(F.sum(F.col("f") * F.col("cy")), 8).alias("jy"))


_WALLS = f"WITH l(dir, cx, cy, opp) AS (VALUES {_LATTICE}), a AS MATERIALIZED (SELECT * FROM ({_LATTICES}) WHERE y = 0), n AS MATERIALIZED ({_LONG})"


@query("q_opposite_join", f"{_WALLS} SELECT n.g, n.y, n.x, CAST(n.dir AS INTEGER) AS dir, {R('o.f', 10)} AS f FROM n JOIN l USING (dir) JOIN n o ON o.g = n.g AND o.y = n.y AND o.x = n.x AND o.dir = l.opp")
def opposite_join(spark, d):
    """At walls each direction takes the value of its opposite, by a self-join on the node and the direction."""
    long = lattices(spark, d).filter("y = 0").select("g", "y", "x", F.posexplode(F.array(*(f"f{k}" for k in range(9)))).alias("dir", "f"))
    wanted = long.drop("f").join(F.broadcast(solvers.lattice(spark).select("dir", "opp")), "dir")
    other = long.select("g", "y", "x", F.col("dir").alias("opp"), "f")
    return wanted.join(other, ["g", "y", "x", "opp"]).select("g", "y", "x", "dir", rnd(F.col("f"), 10).alias("f"))


@query("q_sweep_cross", "SELECT c.name AS codec, f.field_id, CAST(b.bound AS DOUBLE) AS bound FROM (VALUES ('floor'), ('power'), ('uniform')) c(name), (SELECT DISTINCT event_type AS field_id FROM events) f, (VALUES (0.5), (0.05)) b(bound)")
def sweep_cross(spark, d):
    """Every codec with every field and bound: dimension tables of a few rows each."""
    fields = table(spark, d, "events").select(F.col("event_type").alias("field_id")).distinct()
    named = fields.withColumn("codec", F.explode(F.array(*(F.lit(n) for n in sorted(codecs.CODECS)))))
    return named.withColumn("bound", F.explode(F.array(F.lit(0.5), F.lit(0.05)))).select("codec", "field_id", "bound")


@query("q_bit_reductions", "SELECT event_type, bit_or(user_id) AS any_bit, bit_and(user_id) AS all_bits, bit_xor(user_id) AS odd_bits FROM events GROUP BY event_type")
def bit_reductions(spark, d):
    return table(spark, d, "events").groupBy("event_type").agg(F.bit_or("user_id").alias("any_bit"), F.bit_and("user_id").alias("all_bits"), F.bit_xor("user_id").alias("odd_bits"))


_RC = f"CAST(round_even({D('x')} / q, 0) * q AS FLOAT)"


@query(
    "q_drift_matched",
    f"""WITH t AS (SELECT field_id, max(q) AS q FROM (SELECT field_id, q, max(abs({D(_RC)} - {D('x')})) AS e FROM ({EVENTS}), (SELECT CAST(unnest({_CANDIDATES}) AS DOUBLE) AS q) GROUP BY field_id, q) WHERE e <= 0.3 GROUP BY field_id),
 c AS (SELECT e.field_id, q, x, {_RC} AS xh FROM ({EVENTS}) e JOIN t USING (field_id))
 SELECT field_id, q, {R(f'abs(sum({D("xh")}) - sum({D("x")})) / abs(sum({D("x")}))', 7)} AS mass_drift, {R(f'abs(sum({D("xh")} * {D("xh")}) - sum({D("x")} * {D("x")})) / sum({D("x")} * {D("x")})', 7)} AS energy_drift FROM c GROUP BY field_id, q""",
)
def drift_matched(spark, d):
    m = sweeps.matched_drift(events(spark, d), _CANDIDATES, uniform_quantize(F.col("x"), F.col("q")), 0.3)
    return m.select("field_id", "q", rnd(F.col("mass_drift"), 7).alias("mass_drift"), rnd(F.col("energy_drift"), 7).alias("energy_drift"))


_PIECES = "SELECT n, vec_id % 3 AS seed, x FROM embeddings, (VALUES (16), (32), (64)) s(n), LATERAL (SELECT unnest(embedding[1:n]) AS x)"
_METHODS = {"floor": f"floor({D('x')} / 0.02) * 0.02", "uniform": f"round_even({D('x')} / 0.02, 0) * 0.02"}
_SUITE = " UNION ALL ".join(
    f"""SELECT '{m}' AS method, n, seed, max(abs(d)) AS max_abs, sqrt(avg(d * d)) AS rmse, abs(sum(xh) - sum(x)) / abs(sum(x)) AS mass_drift, abs(sum(xh * xh) - sum(x * x)) / sum(x * x) AS energy_drift
 FROM (SELECT n, seed, {D("x")} AS x, {D(e)} AS xh, xh - x AS d FROM (SELECT n, seed, CAST(x AS FLOAT) AS x FROM ({_PIECES}))) GROUP BY n, seed"""
    for m, e in _METHODS.items()
)


@query("q_suite", f"SELECT n, method, {', '.join(f'{R(f'avg({c})', k)} AS {c}' for c, k in (('max_abs', 6), ('rmse', 6), ('mass_drift', 4), ('energy_drift', 6)))} FROM ({_SUITE}) GROUP BY n, method")
def suite(spark, d):
    """Methods on the first 16, 32 and 64 components of all vectors, averaged over three parts of the vectors."""
    sizes = F.explode(F.array(*map(F.lit, (16, 32, 64))))
    cut = table(spark, d, "embeddings").select(sizes.alias("n"), (F.col("vec_id") % 3).cast("string").alias("field_id"), "embedding")
    fields = cut.select("n", "field_id", F.explode(F.slice("embedding", 1, F.col("n"))).alias("x")).withColumn("x", F.col("x").cast("float"))
    s = sweeps.suite(fields, {"floor": floor_quantize(F.col("x"), 0.02), "uniform": uniform_quantize(F.col("x"), 0.02)})
    return s.select("n", "method", *(rnd(F.col(c), k).alias(c) for c, k in (("max_abs", 6), ("rmse", 6), ("mass_drift", 4), ("energy_drift", 6))))
