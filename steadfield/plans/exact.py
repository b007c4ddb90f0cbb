"""Queries on bit patterns, exact ranks and sums that don't hang on their order."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import bits as B
from ..functions.numeric import f64, floor_quantize
from ..operators import joint, metrics, ranks, superacc
from ..streaming import running
from .base import EVENTS, PRICED, D, R, events, priced, query, rnd, table

#: Values of both signs, zeros of both signs among them, in 64 and in 32 bits.
_SIGNED = "SELECT event_id AS i, (value - 10) * CASE WHEN event_id % 7 = 0 THEN -0.0::DOUBLE WHEN event_id % 3 = 0 THEN -1.0 / 3 ELSE 1.0::DOUBLE END AS x FROM events"


def signed(spark, d):
    factor = F.when(F.col("event_id") % 7 == 0, F.lit("-0.0").cast("double")).when(F.col("event_id") % 3 == 0, F.lit(-1.0) / 3).otherwise(1.0)
    return table(spark, d, "events").select(F.col("event_id").alias("i"), ((F.col("value") - 10) * factor).alias("x"))


@query(
    "q_ieee_bits",
    f"""SELECT i, x::BIT::BIGINT AS bits64, CAST(x::FLOAT::BIT::UINTEGER AS BIGINT) AS bits32, true AS back64, true AS back32 FROM ({_SIGNED})""",
)
def ieee_bits(spark, d):
    """Bit patterns in both widths, and whether they lead back to the value; a zero's sign is compared by its text."""
    f = signed(spark, d).withColumns({"bits64": B.double_to_bits(F.col("x")), "bits32": B.float_to_bits(F.col("x").cast("float"))})
    same = lambda a, b: (a == b) & (a.cast("string") == b.cast("string"))
    return f.select("i", "bits64", "bits32", same(B.bits_to_double(F.col("bits64")), F.col("x")).alias("back64"), same(B.bits_to_float(F.col("bits32")), F.col("x").cast("float")).alias("back32"))


def _ring(size: str, one: int, ring: int) -> str:
    return f"CASE WHEN {size} >= {one} THEN {size} - {one} ELSE {size} + {ring - one + 1} END"


_R64, _R32 = (1 << 63) - 1, (1 << 31) - 1


@query(
    "q_lossless_words",
    f"""WITH b AS (SELECT i, x::BIT::BIGINT AS b64, CAST(x::FLOAT::BIT::UINTEGER AS BIGINT) AS b32 FROM ({_SIGNED})),
 a AS (SELECT *, {_ring(f'(b32 & {_R32})', 0x3F800000, _R32)} AS a32, {_ring(f'(b64 & {_R64})', 0x3FF0000000000000, _R64)} AS a64 FROM b)
 SELECT i, a32 * 2 + (b32 >> 31) AS words32, CAST((CASE WHEN a64 >= {1 << 62} THEN CAST(a64 AS HUGEINT) * 2 - {1 << 64} ELSE CAST(a64 AS HUGEINT) * 2 END) + CASE WHEN b64 < 0 THEN 1 ELSE 0 END AS BIGINT) AS words64, b32 AS back32, b64 AS back64 FROM a""",
)
def lossless_words(spark, d):
    """The transform ahead of bit planes that loses nothing, in both widths, and its way back."""
    f = signed(spark, d).withColumns({"b64": B.double_to_bits(F.col("x")), "b32": B.float_to_bits(F.col("x").cast("float"))})
    f = f.withColumns({"words32": B.about_one(F.col("b32"), 32), "words64": B.about_one(F.col("b64"), 64)})
    return f.select("i", "words32", "words64", B.from_about_one(F.col("words32"), 32).alias("back32"), B.from_about_one(F.col("words64"), 64).alias("back64"))


#: Fields that a coarse histogram can't tell apart: close to 280, one value throughout, and prices as they are.
_NARROW = """SELECT 'narrow' AS field_id, 280 + (l_discount - 0.05) + l_extendedprice / 1e7 AS x FROM lineitem UNION ALL SELECT 'same', 280.25 FROM lineitem
 UNION ALL SELECT 'price', l_extendedprice FROM lineitem"""
_AT = (0.01, 0.5, 0.75, 0.999)


def narrow(spark, d):
    t, price = table(spark, d, "lineitem"), f64(F.col("l_extendedprice"))
    of = {"narrow": F.lit(280) + (f64(F.col("l_discount")) - 0.05) + price / 1e7, "same": F.lit(280.25), "price": price}
    return t.select(F.explode(F.array(*(F.struct(F.lit(k).alias("field_id"), f64(c).alias("x")) for k, c in of.items()))).alias("f")).select("f.*")


@query("q_exact_quantiles", f"SELECT field_id, {', '.join(f'{R(f"quantile_cont({D("x")}, {p})", 7)} AS q{k}' for k, p in enumerate(_AT))} FROM ({_NARROW}) GROUP BY field_id")
def exact_quantiles(spark, d):
    q = ranks.quantiles(narrow(spark, d), ["field_id"], F.col("x"), _AT, 64)
    return q.select("field_id", *(rnd(F.col("q")[k], 7).alias(f"q{k}") for k in range(len(_AT))))


@query(
    "q_exact_ranks",
    f"""SELECT field_id, id, {R('x', 9)} AS value FROM (SELECT field_id, x, row_number() OVER (PARTITION BY field_id ORDER BY x) - 1 AS r, count(*) OVER (PARTITION BY field_id) AS n FROM ({_NARROW}))
 JOIN (SELECT unnest([0, 1, 2, 3]) AS id) k ON r = CASE id WHEN 0 THEN 0 WHEN 1 THEN n // 3 WHEN 2 THEN n // 2 ELSE n - 1 END""",
)
def exact_ranks(spark, d):
    """The least, two middle ones and the greatest, found together."""
    at = lambda n: [F.lit(0), F.floor(n / 3), F.floor(n / 2), n - 1]
    wanted = lambda n: F.array(*(F.struct(F.lit(k).alias("id"), r.cast("long").alias("rank")) for k, r in enumerate(at(n))))
    return ranks.select(narrow(spark, d), ["field_id"], F.col("x"), wanted, 64).select("field_id", "id", rnd(F.col("value"), 9).alias("value"))


@query("q_event_quantiles", f"SELECT field_id, {', '.join(f'{R(f"quantile_cont({D("x")}, {p})", 5)} AS q{k}' for k, p in enumerate(_AT))} FROM ({EVENTS}) GROUP BY field_id")
def event_quantiles(spark, d):
    q = ranks.quantiles(events(spark, d), ["field_id"], F.col("x"), _AT)
    return q.select("field_id", *(rnd(F.col("q")[k], 5).alias(f"q{k}") for k in range(len(_AT))))


#: Values of 32 bits between 2 ** -20 and 2 ** 20 are whole multiples of 2 ** -44, their squares of 2 ** -88: whole numbers sum them up.
_X = f"CAST({D('x')} * {float(1 << 44)!r} AS HUGEINT)"


@query("q_exact_sums", f"SELECT field_id, CAST(sum({_X}) AS DOUBLE) / {float(1 << 44)!r} AS mass, CAST(sum(CAST(floor(x * 8) AS HUGEINT) * CAST(floor(x * 8) AS HUGEINT)) AS DOUBLE) / 64 AS energy, count(*) AS n FROM ({EVENTS}) GROUP BY field_id")
def exact_sums(spark, d):
    """Mass of events, energy of their eighths, to the last bit, and the number of terms."""
    eighths = F.floor(F.col("x") * 8) / 8
    f = events(spark, d)
    sums = superacc.exact_sums(f, {"mass": F.col("x"), "energy": eighths * eighths})
    return sums.join(f.groupBy("field_id").agg(F.count(F.lit(1)).alias("n")), "field_id")


_JOINT = f"""WITH f AS (SELECT field_id, {D('x')} AS x, CAST(CAST(floor({D('x')} / 1000.0) * 1000.0 AS FLOAT) AS DOUBLE) AS xh, {D('w')} AS w FROM ({PRICED})),
 m AS (SELECT field_id, avg(x) AS mx, avg(xh) AS mh, avg(w) AS mw FROM f GROUP BY field_id),
 s AS (SELECT field_id, count(*) AS n, any_value(mx) AS mx, any_value(mh) AS mh, any_value(mw) AS mw, sum((x - mx) * (x - mx)) AS e0, sum((xh - mh) * (xh - mh)) AS e1, sum((x - mx) * (w - mw)) AS g0, sum((xh - mh) * (w - mw)) AS g1, sum((w - mw) * (w - mw)) AS gw FROM f JOIN m USING (field_id) GROUP BY field_id),
 p AS (SELECT *, sqrt((e0 - g0 * g0 / gw) / (e1 - g1 * g1 / gw)) AS a FROM s), q AS (SELECT *, (g0 - a * g1) / gw AS c FROM p)
 SELECT field_id, n, {R('a', 8)} AS a, {R('c', 5)} AS c, {R('mx - a * mh - c * mw', 3)} AS b, true AS ok, true AS mass_kept, true AS energy_kept, true AS momentum_kept FROM q"""


@query("q_joint_invariants", _JOINT)
def joint_invariants(spark, d):
    """Mass, energy and momentum weighted by quantity, all three kept to 1e-9."""
    f = priced(spark, d).withColumn("xh", floor_quantize(F.col("x"), 1000.0).cast("float"))
    p = joint.joint_params(f, ["w"])
    done = joint.restore(f, ["w"])
    x, xc, w = f64(F.col("x")), F.col("xc"), f64(F.col("w"))
    near = lambda a, b: F.abs(F.sum(a) - F.sum(b)) <= 1e-9 * F.abs(F.sum(b))
    kept = done.groupBy("field_id").agg(F.count(F.lit(1)).alias("n"), near(xc, x).alias("mass_kept"), near(xc * xc, x * x).alias("energy_kept"), near(w * xc, w * x).alias("momentum_kept"))
    return kept.join(p, "field_id").select("field_id", "n", rnd(F.col("a"), 8).alias("a"), rnd(F.col("c")[0], 5).alias("c"), rnd(F.col("b"), 3).alias("b"), "ok", "mass_kept", "energy_kept", "momentum_kept")


_CODED = f"SELECT field_id, i % 4 = 0 AS whole, {D('x')} AS x, CASE WHEN i % 4 = 0 THEN {D('x')} ELSE floor({D('x')} / 8) * 8 END AS xh FROM ({EVENTS})"
_STEER = f"""WITH s AS (SELECT field_id, count(*) AS n, stddev_pop(x) AS target, stddev_pop(xh) AS before, sum(CASE WHEN whole THEN 0 ELSE xh END) AS l1, sum(CASE WHEN whole THEN 0 ELSE xh * xh END) AS l2,
 sum(CASE WHEN whole THEN xh ELSE 0 END) AS f1, sum(CASE WHEN whole THEN xh * xh ELSE 0 END) AS f2 FROM ({_CODED}) GROUP BY field_id),
 q AS (SELECT *, l2 / n - l1 * l1 / n / n AS a, -2 * l1 * f1 / n / n AS b, f2 / n - f1 * f1 / n / n - target * target AS c FROM s),
 r AS (SELECT *, (-b + sqrt(b * b - 4 * a * c)) / (2 * a) AS r1, (-b - sqrt(b * b - 4 * a * c)) / (2 * a) AS r2 FROM q)
 SELECT field_id, {R('target', 6)} AS target, {R('before', 6)} AS before, {R('CASE WHEN r2 > 0 AND abs(r2 - 1) < abs(r1 - 1) THEN r2 ELSE r1 END', 5)} AS alpha, true AS kept FROM r"""


@query("q_metric_steer", _STEER)
def metric_steer(spark, d):
    """A metric of the user's own, the standard deviation of a whole field, steers the factor of its coarse values."""
    whole, x = F.col("i") % 4 == 0, f64(F.col("x"))
    f = events(spark, d).select("field_id", x.alias("x"), F.when(whole, x).otherwise(F.floor(x / 8) * 8.0).alias("xh"), F.when(whole, 32).otherwise(8).alias("bits"))
    s = metrics.steer(f, ["field_id"], metrics.DEVIATION)
    near = F.abs(F.col("after") - F.col("target")) <= 1e-7 * F.col("target")
    return s.select("field_id", rnd(F.col("target"), 6).alias("target"), rnd(F.col("before"), 6).alias("before"), rnd(F.col("alpha"), 5).alias("alpha"), near.alias("kept"))


_RUN = "(PARTITION BY field_id, span ORDER BY ts, i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
_RUNNING = f"""WITH f AS (SELECT event_type AS field_id, event_id AS i, ts, date_trunc('day', ts) AS span, {D('CAST(value AS FLOAT)')} AS x, floor({D('CAST(value AS FLOAT)')} / 2) * 2 AS h FROM events),
 s AS (SELECT field_id, i, h, count(*) OVER {_RUN} AS n, sum(x) OVER {_RUN} AS m0, sum(x * x) OVER {_RUN} AS s0, sum(h) OVER {_RUN} AS m1, sum(h * h) OVER {_RUN} AS s1 FROM f),
 v AS (SELECT *, greatest(s0 / n - (m0 / n) * (m0 / n), 0) AS v0, s1 / n - (m1 / n) * (m1 / n) AS v1 FROM s)
 SELECT field_id, i, n, {R('(CASE WHEN v1 > 1e-6 THEN sqrt(v0 / v1) ELSE 1 END) * h + m0 / n - (CASE WHEN v1 > 1e-6 THEN sqrt(v0 / v1) ELSE 1 END) * m1 / n', 3)} AS xc FROM v WHERE n > 3"""


@query("q_running_restoration", _RUNNING)
def running_restoration(spark, d):
    """Each event restored by the sums of its type and day up to itself, as on a stream; the first three of a day, whose
    variance may be nothing but rounding, are left out."""
    e = table(spark, d, "events").select(F.col("event_type").alias("field_id"), "ts", F.col("event_id").alias("i"), F.col("value").cast("float").alias("x"))
    return running.restore_running(e, F.floor(F.col("x") / 2) * 2.0).filter("n > 3").select("field_id", "i", "n", rnd(F.col("xc"), 3).alias("xc"))
