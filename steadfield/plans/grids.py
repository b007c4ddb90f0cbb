"""Queries on stencils, attention, tiers, blocks, rotation and solvers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.numeric import f64, parabola
from ..model import CORRECTABLE_BITS, DEFAULT_TIERS, line_out
from ..operators import blocked, rotation, solvers, stencil, tiers
from ..operators import invariants as inv
from ..sources import containers
from .base import CUBE, EVENTS, PLANE, VECTOR_CUBE, D, R, cube, events, plane, query, rnd, table, vector_cube

_P, _C, _V = ["i0", "i1"], ["i0", "i1", "i2"], ["vec_id"]


def g(c: str, axis: str, others: str) -> str:
    w = f"(PARTITION BY {others} ORDER BY {axis})"
    lag, lead = f"lag({D(c)}) OVER {w}", f"lead({D(c)}) OVER {w}"
    return f"CASE WHEN {lag} IS NULL AND {lead} IS NULL THEN 0.0 WHEN {lag} IS NULL THEN {lead} - {D(c)} WHEN {lead} IS NULL THEN {D(c)} - {lag} ELSE ({lead} - {lag}) / 2 END"


@query("q_gradient_1d", f"SELECT vec_id, i, {R(g('x', 'i', 'vec_id'), 6)} AS grad FROM ({PLANE})")
def gradient_1d(spark, d):
    return plane(spark, d).select("vec_id", "i", rnd(stencil.gradient("x", ["i"], "i", _V), 6).alias("grad"))


@query("q_gradient_line", f"SELECT field_id, i, {R(g('x', 'i', 'field_id'), 6)} AS grad FROM (SELECT 'all' AS field_id, i, x FROM ({EVENTS}))")
def gradient_line(spark, d):
    f = events(spark, d).withColumn("field_id", F.lit("all"))
    return stencil.gradient_line(f, block=1000).select("field_id", "i", rnd(F.col("grad"), 6).alias("grad"))


_GX, _GY = g("x", "i0", "vec_id, i1"), g("x", "i1", "vec_id, i0")


@query("q_gradient_mag", f"SELECT vec_id, i, {R('sqrt(gx * gx + gy * gy)', 6)} AS mag FROM (SELECT vec_id, i, {_GX} AS gx, {_GY} AS gy FROM ({PLANE}))")
def gradient_mag(spark, d):
    return plane(spark, d).select("vec_id", "i", rnd(stencil.gradient_magnitude("x", _P, _V), 6).alias("mag"))


_PAIR = f"SELECT k, i, i // 8 AS i0, i % 8 AS i1, u, v FROM ({VECTOR_CUBE})"
_CURL2 = f"SELECT k, i, i0, i1, ({g('v', 'i1', 'k, i0')}) - ({g('u', 'i0', 'k, i1')}) AS c FROM ({_PAIR})"


def pair_plane(spark, d):
    return vector_cube(spark, d).select("k", "i", F.floor(F.col("i") / 8).cast("long").alias("i0"), (F.col("i") % 8).alias("i1"), "u", "v")


@query("q_curl2d", f"SELECT k, i, {R('c', 6)} AS curl FROM ({_CURL2})")
def curl2d(spark, d):
    return pair_plane(spark, d).select("k", "i", rnd(stencil.curl_2d("u", "v", _P, ["k"]), 6).alias("curl"))


def _g3(c: str, a: int) -> str:
    return g(c, f"i{a}", ", ".join(["k"] + [f"i{b}" for b in range(3) if b != a]))


_CURL3 = f"""SELECT k, i, i0, i1, i2, u, v, w, sqrt(x * x + y * y + z * z) AS c FROM (SELECT *, ({_g3('w', 1)}) - ({_g3('v', 2)}) AS x, ({_g3('u', 2)}) - ({_g3('w', 0)}) AS y, ({_g3('v', 0)}) - ({_g3('u', 1)}) AS z FROM ({VECTOR_CUBE}))"""


@query("q_curl3d", f"SELECT k, i, {R('c', 6)} AS curl FROM ({_CURL3})")
def curl3d(spark, d):
    return vector_cube(spark, d).select("k", "i", rnd(stencil.curl_3d_magnitude("u", "v", "w", _C, ["k"]), 6).alias("curl"))


_K = stencil.kernel(0.6)
_REF = lambda e: f"CASE WHEN (({e}) % 16 + 16) % 16 < 8 THEN (({e}) % 16 + 16) % 16 ELSE 15 - (({e}) % 16 + 16) % 16 END"


@query(
    "q_smooth",
    f"""WITH p AS ({PLANE}), k AS (SELECT unnest([-2, -1, 0, 1, 2]) AS o, unnest({[_K[2], _K[1], _K[0], _K[1], _K[2]]}) AS c)
 SELECT a.vec_id, a.i, {R(f'sum({D("b.x")} * c)', 6)} AS s FROM p a, k JOIN p b ON b.vec_id = a.vec_id AND b.i0 = a.i0 AND b.i1 = {_REF('a.i1 + o')} GROUP BY a.vec_id, a.i""",
)
def smooth(spark, d):
    return plane(spark, d).select("vec_id", "i", rnd(stencil.smooth("x", 8, 0.6, _P, "i1", _V), 6).alias("s"))


_ATT = f"""SELECT vec_id, i, i0, i1, x, CASE WHEN hi - lo < 1e-12 THEN CAST(0 AS FLOAT) ELSE CAST({D('m32 - lo')} / {D('hi - lo')} AS FLOAT) END AS att FROM (
 SELECT *, CAST(m AS FLOAT) AS m32, CAST(min(m) OVER (PARTITION BY vec_id) AS FLOAT) AS lo, CAST(max(m) OVER (PARTITION BY vec_id) AS FLOAT) AS hi FROM (
 SELECT vec_id, i, i0, i1, x, sqrt(gx * gx + gy * gy) AS m FROM (SELECT *, {_GX} AS gx, {_GY} AS gy FROM ({PLANE}))))"""


def attention_plane(spark, d):
    return stencil.attention(plane(spark, d, dealt=True), ["x"], _P, _V, shape=(8, 8))


@query("q_attention", f"SELECT vec_id, i, {R(D('att'), 5)} AS att FROM ({_ATT})")
def attention(spark, d):
    return attention_plane(spark, d).select("vec_id", "i", rnd(f64(F.col("att")), 5).alias("att"))


_TIER = "CASE " + " ".join(f"WHEN {D('att')} >= {t.lo} AND {D('att')} < {t.hi} THEN {k}" for k, t in reversed(list(enumerate(DEFAULT_TIERS)))) + " ELSE 0 END"
_TIERED = f"SELECT *, {_TIER} AS tier FROM ({_ATT})"
_BITS = "CASE tier WHEN 0 THEN 4 WHEN 1 THEN 8 WHEN 2 THEN 16 ELSE 32 END"


def tiered_plane(spark, d):
    return attention_plane(spark, d).withColumn("tier", tiers.tier_of(F.col("att")))


@query("q_tiers", f"SELECT vec_id, i, CAST(tier AS INTEGER) AS tier FROM ({_TIERED})")
def tiers_(spark, d):
    return tiered_plane(spark, d).select("vec_id", "i", "tier")


@query("q_tiers_join", f"SELECT vec_id, i, CAST(tier AS INTEGER) AS tier, CAST({_BITS} AS INTEGER) AS bits FROM ({_TIERED})")
def tiers_join(spark, d):
    return tiers.join_tiers(attention_plane(spark, d), spark).select("vec_id", "i", "tier", "bits")


@query("q_tier_hist", f"SELECT CAST(tier AS INTEGER) AS tier, count(*) AS n, {R('100.0 * count(*) / sum(count(*)) OVER ()', 6)} AS pct, CAST(ceil(count(*) * any_value({_BITS}) / 8) AS BIGINT) AS bytes FROM ({_TIERED}) GROUP BY tier")
def tier_hist(spark, d):
    h = tiers.histogram(tiered_plane(spark, d).withColumn("g", F.lit(1)), ["g"])
    return h.select("tier", "n", rnd(F.col("pct"), 6).alias("pct"), "bytes")


@query("q_attention_share", f"SELECT {R('avg(CASE WHEN att >= 0.75 THEN 1.0 ELSE 0.0 END)', 4)} AS above, {R('avg(CASE WHEN att < 0.15 THEN 1.0 ELSE 0.0 END)', 4)} AS below FROM ({_ATT})")
def attention_share(spark, d):
    share = lambda c: rnd(F.avg(F.when(c, 1.0).otherwise(0.0)), 4)
    return attention_plane(spark, d).agg(share(f64(F.col("att")) >= 0.75).alias("above"), share(f64(F.col("att")) < 0.15).alias("below"))


@query("q_auto_tiers", f"SELECT vec_id, {R(f'quantile_cont({D("att")}, 0.6)', 4)} AS c60, {R(f'quantile_cont({D("att")}, 0.9)', 4)} AS c90, {R(f'quantile_cont({D("att")}, 0.99)', 4)} AS c99 FROM ({_ATT}) GROUP BY vec_id")
def auto_tiers(spark, d):
    c = tiers.auto_tiers(attention_plane(spark, d), keys=_V)
    return c.select("vec_id", *(rnd(F.element_at("cuts", k + 1), 4).alias(n) for k, n in enumerate(("c60", "c90", "c99"))))


_RANGED = f"SELECT *, min(x) OVER (PARTITION BY vec_id, tier) AS lo, max(x) OVER (PARTITION BY vec_id, tier) AS hi, {_BITS} AS bits FROM ({_TIERED})"
_LEVELS = "(pow(2, bits) - 1)"
_CODED = f"""SELECT *, CASE WHEN {D('hi - lo')} >= 1e-12 AND bits < 32 THEN greatest(0, least({_LEVELS}, round_even({D(f"CAST({D('x - lo')} / {D('hi - lo')} AS FLOAT) * CAST({_LEVELS} AS FLOAT)")}, 0))) END AS code FROM ({_RANGED})"""
_DECODED = f"""SELECT *, CASE WHEN bits >= 32 THEN x WHEN {D('hi')} - {D('lo')} < 1e-12 THEN lo ELSE CAST({D('lo')} + code / {_LEVELS} * ({D('hi')} - {D('lo')}) AS FLOAT) END AS xh FROM ({_CODED})"""


def coded_plane(spark, d):
    return tiers.quantize(tiered_plane(spark, d), _V, shape=(8, 8))


@query("q_tiered_codec", f"SELECT vec_id, i, CAST(tier AS INTEGER) AS tier, code, {R(D('xh'), 6)} AS xh FROM ({_DECODED})")
def tiered_codec(spark, d):
    return coded_plane(spark, d).select("vec_id", "i", "tier", "code", rnd(f64(F.col("xh")), 6).alias("xh"))


@query(
    "q_tier_correct",
    f"""WITH e AS (SELECT vec_id, sum({D('x')} * {D('x')}) AS original, sum({D('xh')} * {D('xh')}) AS before, coalesce(sum({D('xh')} * {D('xh')}) FILTER (bits > 16), 0) AS fixed, coalesce(sum({D('xh')} * {D('xh')}) FILTER (bits <= 16), 0) AS low FROM ({_DECODED}) GROUP BY vec_id)
 SELECT vec_id, {R('original', 5)} AS original, {R('before', 5)} AS before, {R('CASE WHEN low >= 1e-30 AND original - fixed >= 0 THEN sqrt((original - fixed) / low) ELSE 1.0 END', 6)} AS alpha FROM e""",
)
def tier_correct(spark, d):
    r = tiers.energy_report(coded_plane(spark, d), _V)
    return r.select("vec_id", rnd(F.col("original"), 5).alias("original"), rnd(F.col("before"), 5).alias("before"), rnd(F.col("alpha"), 6).alias("alpha"))


_SIZE = 3
_BLOCKED = f"SELECT *, i0 // {_SIZE} AS b0, i1 // {_SIZE} AS b1, i2 // {_SIZE} AS b2 FROM (SELECT *, CAST(abs(x) AS FLOAT) AS att FROM ({CUBE}))"
_BSTAT = f"SELECT vec_id, b0, b1, b2, count(*) AS n, min(x) AS vmin, max(x) AS vmax, avg({D('x')}) AS vmean, max(att) AS amax FROM ({_BLOCKED}) GROUP BY vec_id, b0, b1, b2"
_BTIER = "CASE " + " ".join(f"WHEN {D('amax')} >= {t.lo} AND {D('amax')} < {t.hi} THEN {t.bits}" for t in reversed(DEFAULT_TIERS)) + " ELSE 32 END"


def blocks_cube(spark, d):
    return cube(spark, d, dealt=True).withColumn("att", F.abs("x"))


@query("q_blocks", f"SELECT vec_id, b0, b1, b2, n, {R(D('vmin'), 6)} AS vmin, {R(D('vmax'), 6)} AS vmax, {R('vmean', 6)} AS vmean FROM ({_BSTAT})")
def blocks(spark, d):
    s = blocked.block_stats(blocked.with_blocks(blocks_cube(spark, d), _SIZE), _V)
    return s.select("vec_id", "b0", "b1", "b2", "n", rnd(f64(F.col("vmin")), 6).alias("vmin"), rnd(f64(F.col("vmax")), 6).alias("vmax"), rnd(F.col("vmean"), 6).alias("vmean"))


@query("q_block_bits", f"SELECT vec_id, b0, b1, b2, CAST({_BTIER} AS INTEGER) AS bits FROM ({_BSTAT})")
def block_bits(spark, d):
    s = blocked.block_stats(blocked.with_blocks(blocks_cube(spark, d), _SIZE), _V)
    return s.select("vec_id", "b0", "b1", "b2", blocked.bits_for(F.col("amax")).alias("bits"))


_BQ = f"""SELECT *, CASE WHEN bits >= 32 THEN x WHEN {D('vmax')} - {D('vmin')} < 1e-12 THEN vmin
 ELSE CAST({D('vmin')} + greatest(0, least({_LEVELS}, round_even(({D('x')} - {D('vmin')}) / ({D('vmax')} - {D('vmin')}) * {_LEVELS}, 0))) / {_LEVELS} * ({D('vmax')} - {D('vmin')}) AS FLOAT) END AS xh
 FROM (SELECT f.*, s.vmin, s.vmax, s.vmean, {_BTIER} AS bits FROM ({_BLOCKED}) f JOIN ({_BSTAT}) s USING (vec_id, b0, b1, b2))"""


@query("q_blocked_codec", f"SELECT vec_id, i, CAST(bits AS INTEGER) AS bits, {R(D('xh'), 6)} AS xh FROM ({_BQ})")
def blocked_codec(spark, d):
    return blocked.quantize(blocks_cube(spark, d), _SIZE, _V).select("vec_id", "i", "bits", rnd(f64(F.col("xh")), 6).alias("xh"))


@query(
    "q_blocked_const",
    f"""SELECT vec_id, i, {R(D(f"CASE WHEN bits <= 4 THEN CAST(vmean AS FLOAT) ELSE xh END"), 5)} AS xh FROM ({_BQ})""",
)
def blocked_const(spark, d):
    return blocked.quantize(blocks_cube(spark, d), _SIZE, _V, down="const").select("vec_id", "i", rnd(f64(F.col("xh")), 5).alias("xh"))


@query(
    "q_blocked_correct",
    f"""WITH e AS (SELECT vec_id, sum({D('x')} * {D('x')}) AS t, coalesce(sum({D('xh')} * {D('xh')}) FILTER (bits > 16), 0) AS f, coalesce(sum({D('xh')} * {D('xh')}) FILTER (bits <= 16), 0) AS l FROM ({_BQ}) GROUP BY vec_id)
 SELECT vec_id, {R('CASE WHEN l >= 1e-30 AND t - f > 0 THEN sqrt((t - f) / l) ELSE 1.0 END', 6)} AS alpha FROM e""",
)
def blocked_correct(spark, d):
    return blocked.energy_factor(blocked.quantize(blocks_cube(spark, d), _SIZE, _V), _V).select("vec_id", rnd(F.col("alpha"), 6).alias("alpha"))


@query(
    "q_blocked_bytes",
    f"""SELECT vec_id, CAST(sum(CASE WHEN bits >= 32 THEN 9 + 4 * n ELSE 10 + CAST(ceil(n * bits / 8) AS BIGINT) END) + {4 + 1 + 24 + 1 + 9 + 24} AS BIGINT) AS bytes FROM (SELECT *, {_BTIER} AS bits FROM ({_BSTAT})) GROUP BY vec_id""",
)
def blocked_bytes(spark, d):
    return blocked.stream_bytes(blocked.quantize(blocks_cube(spark, d), _SIZE, _V), _V, _SIZE)


def _sized(size: int) -> str:
    """SQL of the coded rows with another block size, with the factor of each field and the restored values."""
    q = _BQ.replace(f"// {_SIZE}", f"// {size}")
    return f"""WITH q AS ({q}), e AS (SELECT vec_id, sum({D('x')} * {D('x')}) AS t, coalesce(sum({D('xh')} * {D('xh')}) FILTER (bits > 16), 0) AS f, coalesce(sum({D('xh')} * {D('xh')}) FILTER (bits <= 16), 0) AS l FROM q GROUP BY vec_id),
 c AS (SELECT q.*, CASE WHEN bits <= 16 THEN CAST((CASE WHEN l >= 1e-30 AND t - f > 0 THEN sqrt((t - f) / l) ELSE 1.0 END) * {D('xh')} AS FLOAT) ELSE xh END AS xc FROM q JOIN e USING (vec_id))"""


@query("q_blocked_stream", f"{_sized(2)} SELECT vec_id, i, {R(D('xc'), 5)} AS xc FROM c")
def blocked_stream(spark, d):
    """Fields from the bytes of blocked containers: written, parsed and put together again."""
    coded = blocked.quantize(blocks_cube(spark, d), 2, _V)
    packed = containers.blocked_containers(coded, _V, (4, 4, 4), 2, blocked.energy_factor(coded, _V), CORRECTABLE_BITS)
    back = containers.unpack_fields(packed.select(F.col("vec_id").cast("long").alias("vec_id"), "container"), lambda data: containers.restore_blocked(data).ravel())
    return back.select("vec_id", "i", rnd(f64(F.col("x")), 5).alias("xc"))


def _compared(size: int) -> str:
    record = "CASE WHEN any_value(bits) >= 32 THEN 9 + 4 * count(*) ELSE 10 + CAST(ceil(count(*) * any_value(bits) / 8) AS BIGINT) END"
    header = f"(SELECT count(DISTINCT vec_id) FROM c) * {4 + 1 + 24 + 1 + 9 + 24}"
    sums = f"SELECT max(abs({D('xc')} - {D('x')})) AS max_err, abs(sum({D('xc')} * {D('xc')}) - sum({D('x')} * {D('x')})) / sum({D('x')} * {D('x')}) AS drift, 4 * count(*) AS raw FROM c"
    return f"({_sized(size)} SELECT 'blocked {size}' AS method, {R('raw / bytes', 4)} AS ratio, {R('max_err', 5)} AS max_err, drift < 1e-6 AS restored FROM ({sums}), (SELECT sum(n) + {header} AS bytes FROM (SELECT {record} AS n FROM c GROUP BY vec_id, b0, b1, b2)))"


@query("q_compare_blocked", " UNION ALL ".join(map(_compared, (2, 3, 4))))
def compare_blocked(spark, d):
    """Ratio, greatest error and energy drift of the blocked codec by block size."""
    out = None
    for size in (2, 3, 4):
        coded = blocked.quantize(blocks_cube(spark, d), size, _V)
        bytes_ = blocked.stream_bytes(coded, _V, size).agg(F.sum("bytes").alias("bytes"))
        x, xc = f64(F.col("x")), f64(F.col("xc"))
        sums = blocked.correct_energy(coded, _V).agg(F.max(F.abs(xc - x)).alias("max_err"), inv.drift(F.sum(x * x), F.sum(xc * xc)).alias("drift"), (4 * F.count(F.lit(1))).alias("raw"))
        one = sums.crossJoin(bytes_)  # one row and one row
        one = one.select(F.lit(f"blocked {size}").alias("method"), rnd(F.col("raw") / F.col("bytes"), 4).alias("ratio"), rnd(F.col("max_err"), 5).alias("max_err"), (F.col("drift") < 1e-6).alias("restored"))
        out = one if out is None else out.unionByName(one)
    return out


# Blocks of four: one for each cube, its coarse cube of two coded and interpolated again.
_TRI = f"""WITH c AS (SELECT vec_id, i0 // 2 AS c0, i1 // 2 AS c1, i2 // 2 AS c2, avg({D('x')}) AS cx FROM ({CUBE}) GROUP BY ALL), s AS (SELECT vec_id, min(cx) AS lo, max(cx) AS hi FROM c GROUP BY vec_id),
 l AS (SELECT c.*, CASE WHEN hi - lo < 1e-12 THEN CAST(lo AS FLOAT) ELSE CAST(lo + greatest(0, least(15, round_even((cx - lo) / (hi - lo) * 15, 0))) / 15 * (hi - lo) AS FLOAT) END AS v FROM c JOIN s USING (vec_id)),
 w(r, c, w) AS (VALUES {', '.join(f'({a}, {b}, {c!r})' for a, b, c in blocked._line_weights(4))}),
 u AS (SELECT vec_id, a.r AS i0, b.r AS i1, e.r AS i2, CAST(sum({D('v')} * CAST(a.w AS DOUBLE) * CAST(b.w AS DOUBLE) * CAST(e.w AS DOUBLE)) AS FLOAT) AS xh FROM l JOIN w a ON a.c = c0 JOIN w b ON b.c = c1 JOIN w e ON e.c = c2 GROUP BY ALL)
 SELECT f.vec_id, 3 AS mode, {R(f'max(abs({D("f.x")} - {D("xh")}))', 5)} AS max_abs FROM ({CUBE}) f JOIN u ON u.vec_id = f.vec_id AND u.i0 = f.i0 AND u.i1 = f.i1 AND u.i2 = f.i2 GROUP BY f.vec_id"""


@query("q_blocked_interpolated", _TRI)
def blocked_interpolated(spark, d):
    c = blocked.quantize(blocks_cube(spark, d).withColumn("att", F.lit(0.0).cast("float")), 4, _V, down="tri")
    return c.groupBy("vec_id").agg(F.max("mode").alias("mode"), rnd(F.max(F.abs(f64(F.col("x")) - f64(F.col("xh")))), 5).alias("max_abs"))


@query("q_coarsen", f"SELECT vec_id, i0 // 2 AS i0, i1 // 2 AS i1, i2 // 2 AS i2, {R(f'avg({D("x")})', 6)} AS x FROM ({CUBE}) GROUP BY ALL")
def coarsen(spark, d):
    return blocked.coarsen(cube(spark, d), _V).select("vec_id", *_C, rnd(F.col("x"), 6).alias("x"))


_UP = ", ".join(f"({a}, {b}, {c!r})" for a, b, c in blocked._line_weights(4))


@query(
    "q_upsample",
    f"""WITH c AS (SELECT vec_id, i0 // 2 AS c0, i1 // 2 AS c1, i2 // 2 AS c2, avg({D('x')}) AS x FROM ({CUBE}) GROUP BY ALL), w(r, c, w) AS (VALUES {_UP})
 SELECT vec_id, CAST(a.r AS BIGINT) AS r0, CAST(b.r AS BIGINT) AS r1, CAST(e.r AS BIGINT) AS r2, {R('sum(x * CAST(a.w AS DOUBLE) * CAST(b.w AS DOUBLE) * CAST(e.w AS DOUBLE))', 3)} AS up FROM c JOIN w a ON a.c = c0 JOIN w b ON b.c = c1 JOIN w e ON e.c = c2 GROUP BY ALL""",
)
def upsample(spark, d):
    c = blocked.coarsen(cube(spark, d), _V).withColumnsRenamed({"i0": "c0", "i1": "c1", "i2": "c2"})
    return blocked.upsample(c, 4, _V).select("vec_id", "r0", "r1", "r2", rnd(f64(F.col("up")), 3).alias("up"))


#: How often the value at a coordinate stands on the six places of an axis that four are padded to.
_TIMES = " * ".join(f"CASE i{k} WHEN 3 THEN 3 ELSE 1 END" for k in range(3))


@query(
    "q_pad_crop",
    f"""SELECT vec_id, CAST(216 AS BIGINT) AS padded, {R(f'sum({D("x")} * {_TIMES})', 5)} AS padded_sum, {R(f'sum({D("x")} * (i0 + 1) * (i1 + 2) * (i2 + 3))', 4)} AS cropped_moment,
 {R(f'max(CASE WHEN i0 = 3 AND i1 = 3 AND i2 = 3 THEN {D("x")} END)', 6)} AS corner, {R(f'sum(CASE WHEN i0 = 3 AND i1 = 0 THEN {D("x")} * CASE i2 WHEN 3 THEN 3 + 4 + 5 ELSE i2 END END)', 5)} AS edge FROM ({CUBE}) GROUP BY vec_id""",
)
def pad_crop(spark, d):
    """Values at the far end repeated to whole blocks: their sum, the far corner, one edge with its places as weights, and
    what is left after cropping."""
    p = blocked.pad_edges(cube(spark, d), (4, 4, 4), 3, _V, ["x"])
    i, x = [F.col(f"i{k}") for k in range(3)], f64(F.col("x"))
    inner = blocked.crop(p, (4, 4, 4)).groupBy("vec_id").agg(rnd(F.sum(x * (i[0] + 1) * (i[1] + 2) * (i[2] + 3)), 4).alias("cropped_moment"))
    corner, edge = F.max(F.when((i[0] == 5) & (i[1] == 5) & (i[2] == 5), x)), F.sum(F.when((i[0] == 5) & (i[1] == 0), x * i[2]))
    outer = p.groupBy("vec_id").agg(F.count(F.lit(1)).alias("padded"), rnd(F.sum(x), 5).alias("padded_sum"), rnd(corner, 6).alias("corner"), rnd(edge, 5).alias("edge"))
    return outer.join(inner, "vec_id")


_MOM = ", ".join(f"{R(f'sum({D(a)} * {D(b)})', 6)} AS {a}{b}" for a, b in ("uu", "uv", "uw", "vv", "vw", "ww"))


@query("q_block_second_moment", f"SELECT k, {_MOM} FROM ({VECTOR_CUBE}) GROUP BY k")
def block_second_moment(spark, d):
    m = blocked.second_moments(vector_cube(spark, d), ["k"])
    return m.select("k", *(rnd(F.col(c), 6).alias(c) for c in m.columns if c != "k"))


# The eigenvalues of a symmetric 3 x 3 matrix in closed form: the energies along the principal axes.
_ROTATED = f"""WITH m AS (SELECT k, {", ".join(f"sum({D(a)} * {D(b)}) AS {a}{b}" for a, b in ("uu", "uv", "uw", "vv", "vw", "ww"))} FROM ({VECTOR_CUBE}) GROUP BY k),
 t AS (SELECT *, (uu + vv + ww) / 3 AS q FROM m), p AS (SELECT *, sqrt(((uu - q) * (uu - q) + (vv - q) * (vv - q) + (ww - q) * (ww - q) + 2 * (uv * uv + uw * uw + vw * vw)) / 6) AS p FROM t),
 r AS (SELECT *, acos(greatest(-1.0, least(1.0, ((uu - q) * ((vv - q) * (ww - q) - vw * vw) - uv * (uv * (ww - q) - vw * uw) + uw * (uv * vw - (vv - q) * uw)) / (2 * p * p * p)))) / 3 AS a FROM p)"""


@query(
    "q_rotate",
    f"{_ROTATED} SELECT k, {R('q + 2 * p * cos(a)', 3)} AS first, {R('3 * q - (q + 2 * p * cos(a)) - (q + 2 * p * cos(a + 2 * pi() / 3))', 3)} AS second, {R('q + 2 * p * cos(a + 2 * pi() / 3)', 3)} AS third, true AS apart, true AS restored FROM r",
)
def rotate(spark, d):
    """Energies of the rotated components, whether they are uncorrelated, and whether rotating back restores the vectors."""
    v = vector_cube(spark, d)
    axes = rotation.block_axes(v, ["k"])
    turned = rotation.rotate(v, axes, ["k"])
    back = rotation.rotate(turned, axes, ["k"], inverse=True).select("k", "i", *(F.col(c).alias(f"b{c}") for c in "uvw"))
    both = v.select("k", "i", *(F.col(c).alias(f"o{c}") for c in "uvw")).join(back, ["k", "i"]).join(turned.select("k", "i", "u", "v", "w"), ["k", "i"])
    off = F.greatest(*(F.abs(f64(F.col(f"b{c}")) - f64(F.col(f"o{c}"))) for c in "uvw"))
    mixed = F.greatest(*(F.abs(inv.weighted(F.col(a), F.col(b))) for a, b in ("uv", "uw", "vw")))
    energies = {n: inv.energy(F.col(c)) for n, c in zip(("first", "second", "third"), "uvw")}
    return both.groupBy("k").agg(*(rnd(e, 3).alias(n) for n, e in energies.items()), (mixed < 1e-5 * energies["first"]).alias("apart"), (F.max(off) < 1e-5).alias("restored"))


@query("q_slice", f"SELECT vec_id, i0, i1, x FROM ({CUBE}) WHERE i2 = 2")
def slice_(spark, d):
    return line_out(cube(spark, d), i2=2).select("vec_id", "i0", "i1", "x")


@query("q_lineout", f"SELECT vec_id, i0, x FROM ({CUBE}) WHERE i1 = 2 AND i2 = 2")
def lineout(spark, d):
    return line_out(cube(spark, d), i1=2, i2=2).select("vec_id", "i0", "x")


# Solvers: a lattice of nodes from events (nine directions from the value and the position), a ring from embeddings.
_NY, _NX = 20, 25
#: Every event: node event_id % 500 of lattice g = event_id // 500. Nodes without an event hold fluid at rest.
_LATTICES = f"SELECT l.g, n.i // {_NX} AS y, n.i % {_NX} AS x, " + ", ".join(f"coalesce({w!r} * (1 + 0.01 * sin(e.value + {k})), {w!r}) AS f{k}" for k, w in enumerate(solvers.LATTICE_W)) + f" FROM (SELECT DISTINCT event_id // {_NY * _NX} AS g FROM events) l CROSS JOIN (SELECT unnest(range({_NY * _NX})) AS i) n LEFT JOIN events e ON e.event_id = l.g * {_NY * _NX} + n.i"


def lattices(spark, d):
    """All events as lattices of _NY x _NX: (g, y, x, f0..f8)."""
    e = table(spark, d, "events").select("event_id", "value")
    size = _NY * _NX
    full = e.select(F.floor(F.col("event_id") / size).cast("long").alias("g")).filter("g is not null").distinct().withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(size - 1).cast("long"))))
    f = [F.coalesce(F.lit(w) * (1 + 0.01 * F.sin(F.col("value") + k)), F.lit(w)).alias(f"f{k}") for k, w in enumerate(solvers.LATTICE_W)]
    both = full.withColumn("event_id", F.col("g") * size + F.col("i")).join(e, "event_id", "left")
    return both.select("g", F.floor(F.col("i") / _NX).cast("long").alias("y"), (F.col("i") % _NX).alias("x"), *f)


_RHO = " + ".join(f"f{k}" for k in range(9))
_JX = " + ".join(f"({c}) * f{k}" for k, c in enumerate(solvers.LATTICE_X) if c)
_JY = " + ".join(f"({c}) * f{k}" for k, c in enumerate(solvers.LATTICE_Y) if c)
_MOMENTS = f"SELECT *, greatest({_RHO}, 1e-10) AS rho, {_JX} AS jx, {_JY} AS jy FROM ({_LATTICES})"


@query("q_lbm_moments", f"SELECT g, y, x, {R('rho', 8)} AS rho, {R('jx', 8)} AS jx, {R('jy', 8)} AS jy FROM ({_MOMENTS})")
def lbm_moments(spark, d):
    return lattices(spark, d).select("g", "y", "x", *(rnd(c, 8).alias(n) for n, c in solvers.moments().items()))


@query("q_lbm_restore", f"SELECT g, y, x, {R('rho', 8)} AS rho, {R('jx', 8)} AS jx, {R('jy', 8)} AS jy FROM ({_MOMENTS})")
def lbm_restore(spark, d):
    """The moments of truncated states after restoration: those of the states before."""
    true = lattices(spark, d).withColumns({f"{n}0": c for n, c in solvers.moments().items()})
    back = solvers.restore_moments(solvers.truncate(true, 4e-3))
    return back.select("g", "y", "x", *(rnd(c, 8).alias(n) for n, c in solvers.moments().items()))


def _streamed(nodes: str) -> str:
    """SQL of one streaming step of (g, y, x, f0..f8)."""
    moved = " UNION ALL ".join(f"SELECT g, {k} AS k, (y + {cy} + {_NY}) % {_NY} AS y, (x + {cx} + {_NX}) % {_NX} AS x, f{k} AS f FROM {nodes}" for k, (cx, cy) in enumerate(zip(solvers.LATTICE_X, solvers.LATTICE_Y)))
    return "SELECT g, CAST(y AS BIGINT) AS y, CAST(x AS BIGINT) AS x, " + ", ".join(f"max(f) FILTER (k = {k}) AS f{k}" for k in range(9)) + f" FROM ({moved}) GROUP BY g, y, x"


@query("q_lbm_stream", f"WITH n AS ({_LATTICES}) SELECT g, y, x, " + ", ".join(f"{R(f'f{k}', 10)} AS f{k}" for k in range(9)) + f" FROM ({_streamed('n')})")
def lbm_stream(spark, d):
    return solvers.stream(lattices(spark, d), _NY, _NX, ["g"]).select("g", "y", "x", *(rnd(F.col(f"f{k}"), 10).alias(f"f{k}") for k in range(9)))


def _feq(k: int) -> str:
    cu = f"(3.0 * ((jx / rho) * {solvers.LATTICE_X[k]} + (jy / rho) * {solvers.LATTICE_Y[k]}))"
    return f"rho * {solvers.LATTICE_W[k]!r} * (1 + {cu} + 0.5 * {cu} * {cu} - 1.5 * ((jx / rho) * (jx / rho) + (jy / rho) * (jy / rho)))"


_COLLIDED = "SELECT g, y, x, " + ", ".join(f"f{k} - 0.8 * (f{k} - {_feq(k)}) AS f{k}" for k in range(9)) + f" FROM ({_MOMENTS})"


@query("q_lbm_collide", "SELECT g, y, x, " + ", ".join(f"{R(f'f{k}', 9)} AS f{k}" for k in range(9)) + f" FROM ({_COLLIDED})")
def lbm_collide(spark, d):
    return solvers.collide(lattices(spark, d), 0.8).select("g", "y", "x", *(rnd(F.col(f"f{k}"), 9).alias(f"f{k}") for k in range(9)))


#: The inlet's speed at its fastest; it is 0 at both walls.
_PEAK = 0.02
_SPEED = f"({4 * _PEAK} * y * ({_NY - 1} - y) / {(_NY - 1) ** 2}.0)"
_IN = f"((f0 + f2 + f4 + 2 * (f3 + f6 + f7)) / (1 - {_SPEED}))"
_ENTERING = {1: f"f3 + 2 / 3.0 * {_IN} * {_SPEED}", 5: f"f7 + 1 / 6.0 * {_IN} * {_SPEED} + 0.5 * (f4 - f2)", 8: f"f6 + 1 / 6.0 * {_IN} * {_SPEED} - 0.5 * (f4 - f2)"}
_STEP = f"""WITH c AS ({_COLLIDED}), s AS ({_streamed('c')}),
 w AS (SELECT s.g, s.y, s.x, {", ".join(f"CASE WHEN s.y IN (0, {_NY - 1}) THEN c.f{solvers.OPPOSITE[k]} ELSE s.f{k} END AS f{k}" for k in range(9))} FROM s JOIN c ON c.g = s.g AND c.y = s.y AND c.x = s.x),
 i AS (SELECT g, y, x, {", ".join(f"CASE WHEN x = 0 THEN {_ENTERING[k]} ELSE f{k} END AS f{k}" if k in _ENTERING else f"f{k}" for k in range(9))} FROM w),
 o AS (SELECT g, y, x, {", ".join(f"CASE WHEN x = {_NX - 1} THEN lag(f{k}) OVER (PARTITION BY g, y ORDER BY x) ELSE f{k} END AS f{k}" for k in range(9))} FROM i),
 m AS (SELECT g, greatest({_RHO}, 1e-10) AS rho, {_JX} AS jx, {_JY} AS jy FROM o)"""


@query("q_lbm_step", f"{_STEP} SELECT g, {R('sum(rho)', 7)} AS mass, {R('sum(jx)', 7)} AS jx, {R('max(sqrt(jx * jx + jy * jy) / rho)', 8)} AS fastest FROM m GROUP BY g")
def lbm_step(spark, d):
    """Collision, streaming, walls, a parabolic inlet and an outlet: one step of every lattice: total mass, momentum, the fastest node."""
    before = solvers.collide(lattices(spark, d), 0.8)
    s = solvers.bounce_back(solvers.stream(before, _NY, _NX, ["g"]), before, (F.col("y") == 0) | (F.col("y") == _NY - 1), ["g"])
    s = solvers.outlet(solvers.inlet(s, parabola(F.col("y"), _PEAK, _NY - 1.0)), _NX, ["g"])
    m = solvers.moments()
    sums = s.groupBy("g").agg(F.sum(m["rho"]).alias("mass"), F.sum(m["jx"]).alias("jx"), F.max(F.sqrt(m["jx"] * m["jx"] + m["jy"] * m["jy"]) / m["rho"]).alias("fastest"))
    return sums.select("g", rnd(F.col("mass"), 7).alias("mass"), rnd(F.col("jx"), 7).alias("jx"), rnd(F.col("fastest"), 8).alias("fastest"))


_RING = f"SELECT k, i, {D('u')} AS u, {D('v')} AS v FROM ({VECTOR_CUBE})"
_RING2 = f"SELECT a.k, a.i, a.u, a.v, b.u AS un, c.u AS up FROM ({_RING}) a JOIN ({_RING}) b ON b.k = a.k AND b.i = (a.i + 1) % 64 JOIN ({_RING}) c ON c.k = a.k AND c.i = (a.i + 63) % 64"


def ring(spark, d):
    return vector_cube(spark, d).select("k", "i", f64(F.col("u")).alias("u"), f64(F.col("v")).alias("v"))


@query("q_wave_energy", f"SELECT k, {R('0.5 * sum(v * v)', 6)} AS ke, {R('0.5 * sum((un - u) * (un - u))', 6)} AS pe, {R('sum(u)', 6)} AS mass FROM ({_RING2}) GROUP BY k")
def wave_energy(spark, d):
    w = solvers.wave_invariants(ring(spark, d), 64, ["k"])
    return w.select("k", *(rnd(F.col(c), 6).alias(c) for c in ("ke", "pe", "mass")))


@query("q_wave_step", f"SELECT k, i, {R('u + 0.5 * (v + 0.5 * (un - 2 * u + up))', 6)} AS u, {R('v + 0.5 * (un - 2 * u + up)', 6)} AS v FROM ({_RING2})")
def wave_step(spark, d):
    return solvers.wave_step(ring(spark, d), 64, ["k"]).select("k", "i", rnd(F.col("u"), 6).alias("u"), rnd(F.col("v"), 6).alias("v"))


@query("q_wave_correct", f"SELECT k, {R('0.5 * sum(v * v)', 6)} AS ke, {R('0.5 * sum((un - u) * (un - u))', 6)} AS pe, {R('sum(u)', 6)} AS mass FROM ({_RING2}) GROUP BY k")
def wave_correct(spark, d):
    s = ring(spark, d)
    back = solvers.wave_correct(solvers.truncate(s, 0.01, ["u", "v"]), solvers.wave_invariants(s, 64, ["k"]), 64, ["k"])
    w = solvers.wave_invariants(back, 64, ["k"])
    return w.select("k", *(rnd(F.col(c), 6).alias(c) for c in ("ke", "pe", "mass")))


@query("q_ring_difference", f"SELECT k, i, {R('un - u', 6)} AS du FROM ({_RING2})")
def ring_difference(spark, d):
    r = stencil.ring_shift(ring(spark, d), 64, 1, ["u"], ["k"])
    return r.select("k", "i", rnd(F.col("next_u") - F.col("u"), 6).alias("du"))
