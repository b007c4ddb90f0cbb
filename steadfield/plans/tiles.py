"""Queries on one grid that grows with the tables, cut to tiles: all vectors as the lines of one grid."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.numeric import f64
from ..operators import halo, stencil, tiers
from ..operators import invariants as inv
from ..shared import keep
from .base import PLANE, VECTOR_CUBE, D, R, plane, query, rnd, vector_cube
from .grids import _BITS, _LEVELS, _TIER, g

_M, _S, _ALL = ["vec_id", "i"], ["k", "i0", "i1"], ["grid"]

_DX, _DY = g("x", "vec_id", "i"), g("x", "i", "vec_id")
_RAW = f"SELECT vec_id, i, sqrt(a * a + b * b) AS m FROM (SELECT vec_id, i, {_DX} AS a, {_DY} AS b FROM ({PLANE}))"


def _scaled(raw: str, m: str = "m") -> str:
    return f"SELECT *, CASE WHEN hi - lo < 1e-12 THEN CAST(0 AS FLOAT) ELSE CAST({D('m32 - lo')} / {D('hi - lo')} AS FLOAT) END AS att FROM (SELECT *, CAST({m} AS FLOAT) AS m32, CAST(min({m}) OVER () AS FLOAT) AS lo, CAST(max({m}) OVER () AS FLOAT) AS hi FROM ({raw}))"


def matrix(spark, d):
    return plane(spark, d).select("vec_id", "i", "x").withColumn("grid", F.lit(1))


@query("q_attention_tiled", f"SELECT vec_id, i, {R(D('att'), 5)} AS att FROM ({_scaled(_RAW)})")
def attention_tiled(spark, d):
    """Attention of all vectors as one grid, in tiles of 48 by 48."""
    return stencil.attention(matrix(spark, d), ["x"], _M, _ALL, size=48).select("vec_id", "i", rnd(f64(F.col("att")), 5).alias("att"))


_STACK = f"SELECT k, i, i // 8 AS i0, i % 8 AS i1, u, v, w FROM ({VECTOR_CUBE})"
_CURL = f"SELECT *, sqrt(a * a + b * b + c * c) AS m FROM (SELECT *, ({g('w', 'i0', 'k, i1')}) - ({g('v', 'i1', 'k, i0')}) AS a, ({g('u', 'i1', 'k, i0')}) - ({g('w', 'k', 'i0, i1')}) AS b, ({g('v', 'k', 'i0, i1')}) - ({g('u', 'i0', 'k, i1')}) AS c FROM ({_STACK}))"


def stack(spark, d):
    """Triples of vectors as the layers of one grid of three components."""
    return vector_cube(spark, d).select("k", "i", F.floor(F.col("i") / 8).cast("long").alias("i0"), (F.col("i") % 8).cast("long").alias("i1"), "u", "v", "w").withColumn("grid", F.lit(1))


@query("q_curl3d_tiled", f"SELECT k, i, {R('m', 6)} AS curl FROM ({_CURL})")
def curl3d_tiled(spark, d):
    c = stencil.curl_3d_tiled(stack(spark, d), "u", "v", "w", "c", _S, _ALL, size=16)
    return c.select("k", "i", rnd(F.col("c"), 6).alias("curl"))


_K = stencil.kernel(0.6)


def _smoothed(table: str, m: str, axis: str, n: str, others: list[str]) -> str:
    """SQL of one axis of the Gaussian, reflected at both ends of n places."""
    at = f"((a.{axis} + o) % (2 * {n}) + 2 * {n}) % (2 * {n})"
    same = " AND ".join(f"b.{c} = z.{c}" for c in others)
    return f"""SELECT {', '.join(f'z.{c}' for c in [*others, axis])}, sum({D(f'b.{m}')} * c) AS m FROM (SELECT a.*, c, CASE WHEN {at} < {n} THEN {at} ELSE 2 * {n} - 1 - {at} END AS place
 FROM {table} a, (SELECT unnest([-2, -1, 0, 1, 2]) AS o, unnest({[_K[2], _K[1], _K[0], _K[1], _K[2]]}) AS c) q) z JOIN {table} b ON {same} AND b.{axis} = z.place GROUP BY ALL"""


@query(
    "q_smooth_tiled",
    f"WITH p AS MATERIALIZED (SELECT vec_id, i, x AS m FROM ({PLANE})), n AS (SELECT max(vec_id) + 1 AS n FROM p), a AS MATERIALIZED ({_smoothed('p', 'm', 'vec_id', '(SELECT n FROM n)', ['i'])}), b AS ({_smoothed('a', 'm', 'i', '64', ['vec_id'])}) SELECT vec_id, i, {R('m', 6)} AS s FROM b",
)
def smooth_tiled(spark, d):
    f = matrix(spark, d)
    n = f.agg(F.max("vec_id")).first()[0] + 1
    return stencil.smooth_tiled(f, "x", "s", (n, 64), 0.6, _M, _ALL, size=40).select("vec_id", "i", rnd(F.col("s"), 6).alias("s"))


_ATT3 = f"""p AS MATERIALIZED (SELECT k, i0, i1, m FROM ({_CURL})), n AS (SELECT max(k) + 1 AS n FROM p), a AS MATERIALIZED ({_smoothed('p', 'm', 'k', '(SELECT n FROM n)', ['i0', 'i1'])}),
 b AS MATERIALIZED ({_smoothed('a', 'm', 'i0', '8', ['k', 'i1'])}), c AS ({_smoothed('b', 'm', 'i1', '8', ['k', 'i0'])}), att AS MATERIALIZED (SELECT k, i0, i1, att FROM ({_scaled('SELECT * FROM c')}))"""


def attention3(spark, d):
    f = stack(spark, d)
    n = f.agg(F.max("k")).first()[0] + 1
    return stencil.attention(f, ["u", "v", "w"], _S, _ALL, shape=(n, 8, 8), size=12)


@query("q_attention3_tiled", f"WITH {_ATT3} SELECT k, i0, i1, {R(D('att'), 5)} AS att FROM att")
def attention3_tiled(spark, d):
    """Smoothed curl of one grid of three components, scaled to its range, in tiles of 12 along each axis."""
    return attention3(spark, d).select("k", "i0", "i1", rnd(f64(F.col("att")), 5).alias("att"))


_FLOW = f"""WITH {_ATT3},
 t AS (SELECT *, {_TIER} AS tier FROM (SELECT c.component, c.x, att FROM att JOIN ({_STACK}) s USING (k, i0, i1), LATERAL (VALUES ('u', u), ('v', v), ('w', w)) c(component, x))),
 r AS (SELECT *, min(x) OVER q AS lo, max(x) OVER q AS hi, {_BITS} AS bits FROM t WINDOW q AS (PARTITION BY component, tier)),
 q AS (SELECT *, CASE WHEN {D('hi - lo')} >= 1e-12 AND bits < 32 THEN greatest(0, least({_LEVELS}, round_even({D(f"CAST({D('x - lo')} / {D('hi - lo')} AS FLOAT) * CAST({_LEVELS} AS FLOAT)")}, 0))) END AS code FROM r),
 h AS (SELECT *, CASE WHEN bits >= 32 THEN x WHEN {D('hi')} - {D('lo')} < 1e-12 THEN lo ELSE CAST({D('lo')} + code / {_LEVELS} * ({D('hi')} - {D('lo')}) AS FLOAT) END AS xh FROM q),
 e AS (SELECT component, sum({D('x')} * {D('x')}) AS o, coalesce(sum({D('xh')} * {D('xh')}) FILTER (bits > 16), 0) AS f, coalesce(sum({D('xh')} * {D('xh')}) FILTER (bits <= 16), 0) AS l FROM h GROUP BY component),
 x AS (SELECT h.*, o, CASE WHEN bits <= 16 THEN CAST((CASE WHEN l >= 1e-30 AND o - f >= 0 THEN sqrt((o - f) / l) ELSE 1.0 END) * {D('xh')} AS FLOAT) ELSE xh END AS xc FROM h JOIN e USING (component))
 SELECT component, count(*) AS n, {R(f'max(abs({D("xc")} - {D("x")}))', 4)} AS max_abs, abs(sum({D('xc')} * {D('xc')}) - any_value(o)) / any_value(o) < 1e-6 AS restored, {R('4.0 * count(*) / sum(bits / 8.0)', 4)} AS ratio FROM x GROUP BY component"""


@query("q_flow_pipeline", _FLOW)
def flow_pipeline(spark, d):
    """Attention, tiers, codes, restored energy and packed size of the three components of one grid."""
    # three passes follow, which needn't run the stencils again
    f = keep(attention3(spark, d).select("u", "v", "w", tiers.tier_of(F.col("att")).alias("tier")), "flow")
    long = f.select("tier", F.explode(F.array(*(F.struct(F.lit(c).alias("component"), F.col(c).alias("x")) for c in "uvw"))).alias("c")).select("tier", "c.*")
    done = tiers.correct_energy(tiers.quantize(long, ["component"]), ["component"])
    x, xc = f64(F.col("x")), f64(F.col("xc"))
    return done.groupBy("component").agg(
        F.count(F.lit(1)).alias("n"), rnd(F.max(F.abs(xc - x)), 4).alias("max_abs"), (inv.drift(F.sum(x * x), F.sum(xc * xc)) < 1e-6).alias("restored"),
        rnd(4 * F.count(F.lit(1)) / F.sum(F.col("bits") / 8), 4).alias("ratio"),
    )


@query("q_tile_sizes", f"SELECT vec_id // 48 AS tile, count(*) AS own, CAST(any_value(r) AS BIGINT) AS with_rim FROM ({PLANE}) JOIN (SELECT t, count(*) * 64 AS r FROM (SELECT DISTINCT vec_id FROM embeddings) v JOIN range(100000) AS q(t) ON vec_id BETWEEN 48 * t - 3 AND 48 * t + 50 GROUP BY t) ON t = vec_id // 48 GROUP BY vec_id // 48")
def tile_sizes(spark, d):
    """How many cells each stretch of 48 vectors has, and how many are sent for it with a rim of 3."""
    f = matrix(spark, d)
    counts = halo.tiled(f, ["vec_id"], _ALL, 3, 48).groupBy(F.col("_tile_vec_id").alias("tile")).agg(F.count_if(F.floor(F.col("vec_id") / 48) == F.col("_tile_vec_id")).alias("own"), F.count(F.lit(1)).alias("with_rim"))
    return counts.filter("own > 0")
