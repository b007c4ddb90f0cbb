"""Queries on quantizers, chunks, sweeps and codecs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import sums
from ..functions.numeric import AbsQuantizer, PowerQuantizer, f32, f64, floor_quantize, uniform_quantize
from ..operators import chunks, codecs, correct, scan, sweeps
from ..operators import invariants as inv
from ..shared import new_path
from ..sources import chunked, ranged, readers, writers
from .base import EVENTS, PRICED, D, R, events, priced, query, rnd, table

BOUND = 0.5
_P = PowerQuantizer(BOUND)
_ABS = AbsQuantizer(0.3)


@query("q_floor_quant", f"SELECT field_id, i, CAST(floor({D('x')} / 0.5) * 0.5 AS FLOAT) AS xh FROM ({EVENTS})")
def floor_quant(spark, d):
    return events(spark, d).select("field_id", "i", f32(floor_quantize(F.col("x"), 0.5)).alias("xh"))


@query("q_rint_quant", f"SELECT field_id, i, CAST(round_even({D('x')} / 0.5, 0) * 0.5 AS FLOAT) AS xh FROM ({EVENTS})")
def rint_quant(spark, d):
    return events(spark, d).select("field_id", "i", f32(uniform_quantize(F.col("x"), 0.5)).alias("xh"))


_INV, _W, _B = (f"CAST({float(v)!r} AS FLOAT)" for v in (_ABS.inverse, _ABS.width, _ABS.bound))


@query(
    "q_qabs",
    f"""SELECT field_id, i, CASE WHEN whole THEN NULL ELSE CAST(CASE WHEN b < 0 THEN -2 * b - 1 ELSE 2 * b END AS INTEGER) END AS code, CASE WHEN whole THEN x ELSE r END AS xh
 FROM (SELECT *, abs(b) >= 4194304 OR abs(x - r) > {_B} AS whole FROM (SELECT *, CAST(b AS FLOAT) * {_W} AS r FROM (SELECT *, round({D(f'x * {_INV}')}, 0) AS b FROM ({EVENTS}))))""",
)
def qabs(spark, d):
    return events(spark, d).select("field_id", "i", _ABS.code(F.col("x")).alias("code"), _ABS.recon(F.col("x")).alias("xh"))


_PN = f"floor(abs({D('x')}) / {2 * _P.power} + 0.5)"
_CODE = f"CASE WHEN abs(x) >= {_P.limit} THEN NULL WHEN {_PN} = 0 THEN 0 WHEN x >= 0 THEN 2 * CAST({_PN} AS BIGINT) ELSE 2 * CAST({_PN} AS BIGINT) - 1 END"
_WHOLE = f"SELECT 'all' AS field_id, event_id AS i, CAST(value AS FLOAT) AS x FROM events"


def whole(spark, d):
    return events(spark, d).withColumn("field_id", F.lit("all"))


@query("q_power_quant", f"SELECT field_id, i, CAST({_CODE} AS BIGINT) AS code, CAST(sign({D('x')}) * {_PN} * {2 * _P.power} AS FLOAT) AS xh FROM ({EVENTS})")
def power_quant(spark, d):
    return events(spark, d).select("field_id", "i", _P.code(F.col("x")).alias("code"), f32(_P.recon(F.col("x"))).alias("xh"))


_SUBS = f"""SELECT field_id, i // 4096 AS chunk, i // 128 AS sub, count(*) AS n, CASE WHEN max(coalesce({_CODE}, 4294967295)) = 0 THEN 0 ELSE length(bin(max(coalesce({_CODE}, 4294967295)))) END AS bits
 FROM ({_WHOLE}) GROUP BY ALL"""


@query("q_sub_bits", f"SELECT field_id, chunk, sub, n, CAST(bits AS INTEGER) AS bits FROM ({_SUBS})")
def sub_bits(spark, d):
    code = F.coalesce(_P.code(F.col("x")), F.lit(0xFFFFFFFF).cast("long"))
    return chunks.sub_bits(chunks.with_chunks(whole(spark, d).withColumn("code", code)))


@query("q_bit_offsets", f"SELECT field_id, chunk, sub, CAST(coalesce(sum(bits * 128) OVER (PARTITION BY field_id, chunk ORDER BY sub ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS bit_offset FROM ({_SUBS})")
def bit_offsets(spark, d):
    return chunks.bit_offsets(sub_bits(spark, d)).select("field_id", "chunk", "sub", "bit_offset")


_CHUNKS = f"SELECT field_id, chunk, CAST(4 * sum(n) AS BIGINT) AS osize, CAST(34 + 16 * sum(bits) AS BIGINT) AS packed FROM ({_SUBS}) GROUP BY ALL"
_SIZED = f"SELECT field_id, chunk, osize, CASE WHEN packed >= 16384 OR packed >= osize THEN osize ELSE packed END AS csize FROM ({_CHUNKS})"


@query("q_chunk_sizes", _SIZED)
def chunk_sizes(spark, d):
    return codecs.PowerCodec().sizes(whole(spark, d), BOUND)


@query("q_chunk_offsets", f"SELECT field_id, chunk, CAST(coalesce(sum(csize) OVER (PARTITION BY field_id ORDER BY chunk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS \"offset\" FROM ({_SIZED})")
def chunk_offsets(spark, d):
    return chunks.offsets(codecs.PowerCodec().sizes(whole(spark, d), BOUND)).select("field_id", "chunk", "offset")


@query("q_file_size", f"SELECT field_id, CAST(sum(osize) AS BIGINT) AS original, CAST(sum(csize + 2) + 8 + 16 AS BIGINT) AS bytes FROM ({_SIZED}) GROUP BY field_id")
def file_size(spark, d):
    return codecs.PowerCodec().size(whole(spark, d), BOUND, mode=3)


_WORD = "SELECT 'all' AS field_id, event_id AS i, event_id // 4096 AS chunk, CAST(floor(value * 100) AS BIGINT) & 4294967295 AS word FROM events"


def word_rows(spark, d):
    w = F.floor(F.col("value") * 100).cast("long").bitwiseAND(F.lit(0xFFFFFFFF).cast("long"))
    return chunks.with_chunks(table(spark, d, "events").select(F.lit("all").alias("field_id"), F.col("event_id").alias("i"), w.alias("word")))


_S = 0xAAAAAAAA
_DIFF = f"SELECT *, xor((((word - coalesce(lag(word) OVER (PARTITION BY chunk ORDER BY i), 0)) & 4294967295) + {_S}) & 4294967295, {_S}) AS diff FROM ({_WORD})"


@query("q_diffnb", f"SELECT i, chunk, diff FROM ({_DIFF})")
def diffnb(spark, d):
    return chunks.differences(word_rows(spark, d)).select("i", "chunk", "diff")


@query("q_diffnb_inverse", f"SELECT i, chunk, word FROM ({_WORD})")
def diffnb_inverse(spark, d):
    return chunks.undo_differences(chunks.differences(word_rows(spark, d)).drop("word")).select("i", "chunk", "word")


@query("q_max_scan", f"SELECT i, chunk, max(word) OVER (PARTITION BY chunk ORDER BY i ROWS UNBOUNDED PRECEDING) AS most FROM ({_WORD})")
def max_scan(spark, d):
    return chunks.running_max(word_rows(spark, d)).select("i", "chunk", "most")


_FR = "(SELECT unnest([0.01, 0.003, 0.001, 0.0003, 0.0001]) AS frac)"
_STUDY = f"""WITH e AS ({EVENTS}), sp AS (SELECT field_id, {D('max(x)')} - {D('min(x)')} AS span FROM e GROUP BY field_id),
 f AS (SELECT e.field_id, x, CAST(frac AS DOUBLE) AS frac, CAST(frac AS DOUBLE) * span AS b FROM e JOIN sp USING (field_id), {_FR}),
 q AS (SELECT *, CAST(round_even({D('x')} / (2 * (b * 0.9)), 0) * (2 * (b * 0.9)) AS FLOAT) AS xh FROM f),
 s AS (SELECT field_id, frac, count(*) AS n, any_value(b) AS b, sum({D('x')}) AS m0, sum({D('x')} * {D('x')}) AS s0, sum({D('xh')}) AS m1, sum({D('xh')} * {D('xh')}) AS s1 FROM q GROUP BY field_id, frac),
 p AS (SELECT field_id, frac, sqrt((s0 / n - (m0 / n) * (m0 / n)) / (s1 / n - (m1 / n) * (m1 / n))) AS a, m0 / n AS mean0, m1 / n AS mean1 FROM s),
 c AS (SELECT q.*, CAST(a * {D('xh')} + (mean0 - a * mean1) AS FLOAT) AS xc FROM q JOIN p USING (field_id, frac))
 SELECT field_id, frac, count(*) AS n, max(abs({D('xh')} - {D('x')})) / any_value(b) AS raw_over, max(abs({D('xc')} - {D('x')})) / any_value(b) AS cor_over,
 abs(sum({D('xh')}) - sum({D('x')})) / abs(sum({D('x')})) AS mass_raw, abs(sum({D('xc')}) - sum({D('x')})) / abs(sum({D('x')})) AS mass_cor, abs(sum({D('xc')} * {D('xc')}) - sum({D('x')} * {D('x')})) / sum({D('x')} * {D('x')}) AS energy_cor FROM c GROUP BY field_id, frac"""


def _recon():
    return f32(uniform_quantize(F.col("x"), 2 * F.col("bound_used")))


@query("q_study", f"SELECT field_id, frac, n, {R('raw_over', 4)} AS raw_over, {R('cor_over', 4)} AS cor_over, {R('mass_raw', 6)} AS mass_raw, mass_cor < 1e-6 AS mass_kept, energy_cor < 1e-6 AS energy_kept FROM ({_STUDY})")
def study(spark, d):
    s = sweeps.study(events(spark, d), _recon())
    return s.select("field_id", "frac", "n", rnd(F.col("max_raw_over_b"), 4).alias("raw_over"), rnd(F.col("max_cor_over_b"), 4).alias("cor_over"), rnd(F.col("mass_raw"), 6).alias("mass_raw"), (F.col("mass_cor") < 1e-6).alias("mass_kept"), (F.col("energy_cor") < 1e-6).alias("energy_kept"))


def _tight_sql(steps: int = 5) -> str:
    """Each round's pairs of field and fraction, measured, and those that fail with a tighter bound for the next."""
    parts = [f"e AS ({EVENTS})", f"t0 AS (SELECT field_id, CAST(frac AS DOUBLE) AS frac, CAST(frac AS DOUBLE) * span AS b, CAST(frac AS DOUBLE) * span * 0.9 AS bu FROM (SELECT field_id, {D('max(x)')} - {D('min(x)')} AS span FROM e GROUP BY field_id), {_FR})"]
    for k in range(steps):
        parts += [
            f"q{k} AS (SELECT field_id, frac, b, bu, {D('x')} AS x, {D(f'CAST(round_even({D("x")} / (2 * bu), 0) * (2 * bu) AS FLOAT)')} AS xh FROM e JOIN t{k} USING (field_id))",
            f"s{k} AS (SELECT field_id, frac, avg(x) AS mean0, avg(xh) AS mean1, sqrt((avg(x * x) - avg(x) * avg(x)) / (avg(xh * xh) - avg(xh) * avg(xh))) AS a FROM q{k} GROUP BY field_id, frac)",
            f"m{k} AS (SELECT field_id, frac, any_value(b) AS b, any_value(bu) AS bu, max(abs({D('CAST(a * xh + (mean0 - a * mean1) AS FLOAT)')} - x)) AS err FROM q{k} JOIN s{k} USING (field_id, frac) GROUP BY field_id, frac)",
            f"t{k + 1} AS (SELECT field_id, frac, b, bu * 0.98 * b / err AS bu FROM m{k} WHERE err > b)",
        ]
    ends = " UNION ALL ".join(f"SELECT field_id, frac, {k} AS step, b, bu, err FROM m{k}" + (" WHERE NOT err > b" if k < steps - 1 else "") for k in range(steps))
    return f"WITH {', '.join(x.replace(' AS (', ' AS MATERIALIZED (', 1) for x in parts)} SELECT field_id, frac, CAST(step AS INTEGER) AS step, {R('bu / b', 5)} AS used, {R('err / b', 4)} AS cor_over FROM ({ends})"


@query("q_study_tight", _tight_sql())
def study_tight(spark, d):
    s = sweeps.tightest(events(spark, d), _recon())
    return s.select("field_id", "frac", F.col("step").cast("int").alias("step"), rnd(F.col("bound_used") / F.col("bound"), 5).alias("used"), rnd(F.col("max_cor_over_b"), 4).alias("cor_over"))


def _bisect_sql(iterations: int = 18) -> str:
    parts = [f"e AS ({EVENTS})", "t0 AS (SELECT DISTINCT field_id, CAST(0.0001 AS DOUBLE) AS lo, CAST(10.0 AS DOUBLE) AS hi FROM e)"]
    for k in range(iterations):
        err = f"max(abs({D(f'CAST(round_even({D("x")} / sqrt(lo * hi), 0) * sqrt(lo * hi) AS FLOAT)')} - {D('x')}))"
        parts += [f"m{k} AS (SELECT field_id, lo, hi, {err} AS err FROM e JOIN t{k} USING (field_id) GROUP BY field_id, lo, hi)", f"t{k + 1} AS (SELECT field_id, CASE WHEN err <= 0.1 THEN sqrt(lo * hi) ELSE lo END AS lo, CASE WHEN err <= 0.1 THEN hi ELSE sqrt(lo * hi) END AS hi FROM m{k})"]
    return f"WITH {', '.join(x.replace(' AS (', ' AS MATERIALIZED (', 1) for x in parts)} SELECT field_id, {R('lo', 7)} AS q FROM t{iterations}"


@query("q_tolerance_bisect", _bisect_sql())
def tolerance_bisect(spark, d):
    """The coarsest step of each field whose error stays within 0.1, by 18 geometric halvings."""
    found = sweeps.bisect_fields(events(spark, d), lambda q: uniform_quantize(F.col("x"), q), 0.1, 1e-4, 10.0)
    return found.select("field_id", rnd(F.col("q"), 7).alias("q"))


def _size_sql(bound: float, name: str) -> str:
    p = PowerQuantizer(bound)
    n = f"floor(abs({D('x')}) / {2 * p.power} + 0.5)"
    code = f"CASE WHEN abs(x) >= {p.limit} THEN 4294967295 WHEN x >= 0 THEN 2 * CAST({n} AS BIGINT) ELSE greatest(0, 2 * CAST({n} AS BIGINT) - 1) END"
    subs = f"SELECT i // 4096 AS chunk, i // 128 AS sub, count(*) AS n, max({code}) AS m FROM ({_WHOLE}) GROUP BY ALL"
    chunk = f"SELECT 4 * sum(n) AS o, 34 + 16 * sum(CASE WHEN m = 0 THEN 0 ELSE length(bin(m)) END) AS p FROM ({subs}) GROUP BY chunk"
    return f"SELECT CAST(sum(o) AS BIGINT) AS original, CAST(sum(CASE WHEN p >= 16384 OR p >= o THEN o ELSE p END + 2) + 8 AS BIGINT) AS {name} FROM ({chunk})"


@query(
    "q_cr_impact",
    " UNION ALL ".join(f"SELECT CAST({e} AS DOUBLE) AS eps, {R('original / plain', 5)} AS ratio_plain, {R('original / (tight + 16)', 5)} AS ratio_tight FROM ({_size_sql(e, 'plain')}), ({_size_sql(0.9 * e, 'tight').replace('original', 'o2')})" for e in (1.1, 0.5, 0.05)),
)
def cr_impact(spark, d):
    """What a bound of nine tenths and two stored invariants cost, at three bounds from one pass."""
    bounds = (1.1, 0.5, 0.05)
    at = codecs.PowerCodec().sizes_at(whole(spark, d), [b for e in bounds for b in (e, 0.9 * e)])
    of = lambda b: F.max(F.when(F.col("bound") == b, F.col("bytes")))
    sums = at.groupBy("field_id").agg(F.max("original").alias("o"), *(of(b).alias(f"{n}{k}") for k, e in enumerate(bounds) for n, b in (("p", e), ("t", 0.9 * e))))
    each = F.explode(F.array(*(F.struct(F.lit(e).alias("eps"), rnd(F.col("o") / F.col(f"p{k}"), 5).alias("ratio_plain"), rnd(F.col("o") / (F.col(f"t{k}") + 16), 5).alias("ratio_tight")) for k, e in enumerate(bounds))))
    return sums.select(each.alias("e")).select("e.*")


_CANDIDATES = [2.0**-k for k in range(8)]


@query(
    "q_tolerance_grid",
    f"""SELECT field_id, max(q) AS q FROM (SELECT field_id, q, max(abs({D(f"CAST(round_even({D('x')} / q, 0) * q AS FLOAT)")} - {D('x')})) AS e FROM ({EVENTS}), (SELECT CAST(unnest({_CANDIDATES}) AS DOUBLE) AS q) GROUP BY field_id, q) WHERE e <= 0.1 GROUP BY field_id""",
)
def tolerance_grid(spark, d):
    return sweeps.feasible_step(events(spark, d), _CANDIDATES, uniform_quantize(F.col("x"), F.col("q")), F.lit(0.1))


_SHEET = """SELECT event_type AS input, CAST(user_id % 5 AS DOUBLE) AS error_bound, CAST(CASE WHEN event_id % 2 = 0 THEN 0 ELSE 3 END AS INTEGER) AS mode, avg(value) AS compression_ratio, min(value) AS mass_i, max(value) AS energy_i
 FROM events GROUP BY ALL"""


def _sheet(spark, d):
    e = table(spark, d, "events")
    keys = [F.col("event_type").alias("input"), (F.col("user_id") % 5).cast("double").alias("error_bound"), F.when(F.col("event_id") % 2 == 0, 0).otherwise(3).alias("mode")]
    return e.groupBy(*keys).agg(F.avg("value").alias("compression_ratio"), F.min("value").alias("mass_i"), F.max("value").alias("energy_i"))


@query(
    "q_mode_compare",
    f"""WITH r AS ({_SHEET}) SELECT a.input, a.error_bound, {R('a.compression_ratio', 6)} AS ratio_plain, {R('b.compression_ratio', 6)} AS ratio_restored, a.mass_i AS mass_plain, b.mass_i AS mass_restored, a.energy_i AS energy_plain, b.energy_i AS energy_restored
 FROM r a JOIN r b ON a.input = b.input AND a.error_bound = b.error_bound WHERE a.mode = 0 AND b.mode = 3""",
)
def mode_compare(spark, d):
    c = sweeps.compare_modes(_sheet(spark, d))
    return c.withColumns({k: rnd(F.col(k), 6) for k in ("ratio_plain", "ratio_restored")})


@query("q_geomean", f"WITH r AS ({_SHEET}) SELECT mode, {R('exp(avg(ln(compression_ratio)))', 6)} AS geomean, {R('max(compression_ratio)', 6)} AS most FROM r GROUP BY mode")
def geomean(spark, d):
    return _sheet(spark, d).groupBy("mode").agg(rnd(inv.geometric_mean(F.col("compression_ratio")), 6).alias("geomean"), rnd(F.max("compression_ratio"), 6).alias("most"))


@query("q_mean_by_grid", f"SELECT CAST(l_quantity AS BIGINT) % 10 AS n, {R('avg(l_extendedprice)', 4)} AS mean FROM lineitem GROUP BY 1")
def mean_by_grid(spark, d):
    return table(spark, d, "lineitem").groupBy((F.col("l_quantity").cast("long") % 10).alias("n")).agg(rnd(F.avg("l_extendedprice"), 4).alias("mean"))


@query(
    "q_scrape",
    r"""SELECT page_id, CAST(nullif(regexp_extract(url, 'page=\D*?([+-]?[0-9]+\.?[0-9]*(?:[eE][+-]?[0-9]+)?)', 1), '') AS DOUBLE) AS page FROM pages""",
)
def scrape(spark, d):
    return readers.scrape(table(spark, d, "pages"), "url", {"page": "page="}).select("page_id", "page")


@query(
    "q_methods",
    " UNION ALL ".join(
        f"""SELECT '{n}' AS method, field_id, {R('max(e)', 5)} AS max_abs, {R('sqrt(avg(e * e))', 5)} AS rmse FROM (SELECT field_id, abs({D(x)} - {D('x')}) AS e FROM ({EVENTS})) GROUP BY field_id"""
        for n, x in (("floor", f"CAST(floor({D('x')} / 0.5) * 0.5 AS FLOAT)"), ("uniform", f"CAST(round_even({D('x')} / 1.0, 0) * 1.0 AS FLOAT)"), ("power", f"CAST(sign({D('x')}) * {_PN} * {2 * _P.power} AS FLOAT)"))
    ),
)
def methods(spark, d):
    recon = {n: c.recon(F.col("x"), BOUND) for n, c in codecs.CODECS.items()}
    r = sweeps.run_methods(events(spark, d), recon)
    return r.select("method", "field_id", rnd(F.col("max_abs"), 5).alias("max_abs"), rnd(F.col("rmse"), 5).alias("rmse"))


@query("q_mode_targets", f"SELECT field_id, {R(f'sum({D("x")})', 2)} AS p1, {R(f'sum({D("x")} * {D("x")})', -2)} AS p2 FROM ({PRICED}) GROUP BY field_id")
def mode_targets(spark, d):
    p = codecs.mode_params(priced(spark, d), 3)
    return p.select("field_id", rnd(F.col("p1"), 2).alias("p1"), rnd(F.col("p2"), -2).alias("p2"))


@query(
    "q_check_conservation",
    f"""WITH s AS (SELECT field_id, {D('max(x)')} - {D('min(x)')} AS span FROM ({EVENTS}) GROUP BY field_id), f AS (SELECT e.*, CAST(0.001 * span AS FLOAT) AS b, CAST(floor({D('x')} / 0.25) * 0.25 AS FLOAT) AS xh FROM ({EVENTS}) e JOIN s USING (field_id))
 SELECT field_id, count(*) AS n, count(*) FILTER (xh < x - b OR xh > x + b OR abs(x - xh) > b) AS violations, {R(f'abs(sum({D("xh")}) - sum({D("x")})) / abs(sum({D("x")}))', 7)} AS mass_drift FROM f GROUP BY field_id""",
)
def check_conservation(spark, d):
    f = events(spark, d)
    s = f.groupBy("field_id").agg((F.lit(0.001) * (f64(F.max("x")) - f64(F.min("x")))).cast("float").alias("b"))
    g = f.withColumn("xh", f32(floor_quantize(F.col("x"), 0.25))).join(s, "field_id")
    x, xh, b = F.col("x"), F.col("xh"), F.col("b")
    bad = (xh < x - b) | (xh > x + b) | (F.abs(x - xh) > b)
    return g.groupBy("field_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(bad).alias("violations"), rnd(inv.drift(inv.mass(x), inv.mass(xh)), 7).alias("mass_drift"))


def _roundtrip(spark, d, codec: str, bound: float):
    """(original, bytes, max_abs, n) of all events as one field through a byte codec and back."""
    f = whole(spark, d)
    e = codecs.encode_chunks(f, bound, codec)
    back = codecs.decode_chunks(e, bound, codec).select("i", "xh")
    worst = f.join(back, "i").agg(rnd(F.max(F.abs(f64(F.col("x")) - f64(F.col("xh")))), 6).alias("max_abs"), F.count(F.lit(1)).alias("n"))
    return e.agg(F.sum("osize").alias("original"), F.sum("csize").alias("bytes")).crossJoin(worst)  # one row and one row


@query(
    "q_planes_roundtrip",
    f"""SELECT CAST(4 * count(*) AS BIGINT) AS original, true AS smaller, {R(f'max(abs({D("x")} - {D("xh")}))', 6)} AS max_abs, count(*) AS n FROM (SELECT x, CASE WHEN whole THEN x ELSE r END AS xh
 FROM (SELECT *, abs(b) >= 4194304 OR abs(x - r) > {_B} AS whole FROM (SELECT *, CAST(b AS FLOAT) * {_W} AS r FROM (SELECT *, round({D(f'x * {_INV}')}, 0) AS b FROM ({EVENTS})))))""",
)
def planes_roundtrip(spark, d):
    """Bit-plane chunks: whether they are smaller, and the greatest error after decoding."""
    return _roundtrip(spark, d, "planes", 0.3).select("original", (F.col("bytes") < F.col("original")).alias("smaller"), "max_abs", "n")


@query(
    "q_widths_roundtrip",
    f"""SELECT s.original, s.bytes, {R(f'max(abs({D(f"CASE WHEN abs(x) >= {_P.limit} THEN x ELSE CAST(sign({D('x')}) * {_PN} * {2 * _P.power} AS FLOAT) END")} - {D('x')}))', 6)} AS max_abs, count(*) AS n
 FROM ({EVENTS}), (SELECT CAST(sum(osize) AS BIGINT) AS original, CAST(sum(csize) AS BIGINT) AS bytes FROM ({_SIZED})) s GROUP BY ALL""",
)
def widths_roundtrip(spark, d):
    return _roundtrip(spark, d, "widths", BOUND)


_QABS = f"SELECT field_id, i, x, CASE WHEN whole THEN x ELSE r END AS xh FROM (SELECT *, abs(b) >= 4194304 OR abs(x - r) > {_B} AS whole FROM (SELECT *, CAST(b AS FLOAT) * {_W} AS r FROM (SELECT *, round({D(f'x * {_INV}')}, 0) AS b FROM ({EVENTS}))))"


@query(
    "q_scaled_roundtrip",
    f"""WITH q AS ({_QABS}), a AS (SELECT field_id, sqrt(sum({D('x')} * {D('x')}) / sum({D('xh')} * {D('xh')})) AS alpha FROM q GROUP BY field_id)
 SELECT field_id, {R('any_value(alpha)', 7)} AS alpha, {R(f'max(abs({D(f"CAST(alpha * {D('xh')} AS FLOAT)")} - {D("x")}))', 5)} AS max_abs, {R(f'sum({D("x")} * {D("x")})', -1)} AS energy, count(*) AS n FROM q JOIN a USING (field_id) GROUP BY field_id""",
)
def scaled_roundtrip(spark, d):
    """A byte codec with a stored factor, into files and back: the energy is that of the original."""
    ranked = scan.rank(events(spark, d), ["field_id"], "i", "at").select("field_id", F.col("at").alias("i"), "x")
    files = chunked.compress_scaled(ranked, 0.3, new_path(spark, "scaled"))
    both = ranked.join(chunked.decompress_scaled(files, 0.3), ["field_id", "i"])
    x, xc = f64(F.col("x")), f64(F.col("xc"))
    sums = both.groupBy("field_id").agg(rnd(F.max(F.abs(xc - x)), 5).alias("max_abs"), rnd(F.sum(xc * xc), -1).alias("energy"), F.count(F.lit(1)).alias("n"))
    factors = chunked.read_chunked(files, True, True).groupBy("field_id").agg(rnd(F.first("alpha"), 7).alias("alpha"))
    return sums.join(factors, "field_id")


@query("q_field_ranks", f"SELECT field_id, i, row_number() OVER (PARTITION BY field_id ORDER BY i) - 1 AS rank, CAST(coalesce(sum(CAST(floor(x) AS BIGINT)) OVER (PARTITION BY field_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before FROM ({EVENTS})")
def field_ranks(spark, d):
    """Ranks and running sums of whole fields by scans over blocks of 512."""
    ranked = scan.rank(events(spark, d), ["field_id"], "i", block=512)
    return scan.prefix(ranked, ["field_id"], "i", F.floor("x").cast("long"), "before", block=512, levels=3).select("field_id", "i", "rank", "before")


@query(
    "q_chunked_file",
    f"""SELECT s.original, s.bytes, s.chunks, count(*) AS n, {R(f'max(abs({D(f"CASE WHEN abs(x) >= {_P.limit} THEN x ELSE CAST(sign({D('x')}) * {_PN} * {2 * _P.power} AS FLOAT) END")} - {D('x')}))', 6)} AS max_abs
 FROM ({EVENTS}), (SELECT CAST(sum(osize) AS BIGINT) AS original, CAST(16 + sum(csize + 2) + 16 AS BIGINT) AS bytes, count(*) AS chunks FROM ({_SIZED})) s GROUP BY ALL""",
)
def chunked_file(spark, d):
    """All events as one file of chunks with two kept sums, written and read by many tasks."""
    f = whole(spark, d)
    encoded = codecs.encode_chunks(f, BOUND, "widths")
    kept = f.groupBy("field_id").agg(F.array(inv.mass(F.col("x")), inv.energy(F.col("x"))).alias("targets"))
    files = chunked.write_chunked(encoded, new_path(spark, "chunked"), BOUND, kept)
    rows = chunked.read_chunked(files)
    back = codecs.decode_chunks(rows, BOUND, "widths").select("i", "xh")
    worst = f.join(back, "i").agg(F.count(F.lit(1)).alias("n"), rnd(F.max(F.abs(f64(F.col("x")) - f64(F.col("xh")))), 6).alias("max_abs"))
    sizes = rows.agg(F.sum("osize").alias("original"), F.count(F.lit(1)).alias("chunks"))
    return sizes.crossJoin(files.agg(F.sum("bytes").alias("bytes"))).crossJoin(worst)  # one row each


@query("q_ranged_scan", f"SELECT field_id, row_number() OVER (PARTITION BY field_id ORDER BY i) - 1 AS i, x FROM ({EVENTS}) WHERE x >= 5")
def ranged_scan(spark, d):
    """Headerless files, read by ranges of 4,000 bytes. A part of a field is a file; its name and place lead back."""
    folder = new_path(spark, "ranged")
    parts = correct.hold(writers.write_raw(events(spark, d).filter("x >= 5"), folder))
    placed = scan.prefix(parts, ["field_id"], "first", F.col("n"), "at", levels=1).select("field_id", F.col("path").alias("part"), "at")
    found = ranged.scan(spark, folder, range_bytes=4_000).withColumnRenamed("field_id", "part")
    return found.join(placed, "part").select("field_id", (F.col("at") + F.col("i")).alias("i"), "x")


@query("q_raw_roundtrip", f"SELECT field_id, row_number() OVER (PARTITION BY field_id ORDER BY i) - 1 AS i, x FROM ({EVENTS})")
def raw_roundtrip(spark, d):
    """Fields as headerless files, and back."""
    return writers.read_parts(correct.hold(writers.write_raw(events(spark, d), new_path(spark, "raw"))))


_BYTES = f"SELECT field_id, k, (x::BIT::UINTEGER >> (8 * k)) & 255 AS byte FROM ({EVENTS}), range(4) AS r(k)"


@query(
    "q_entropy_ratio",
    f"""SELECT field_id, CAST(max(n) AS BIGINT) AS n, {R('sum(log2(n) - cl / n)', 6)} AS bits, {R('32 / sum(log2(n) - cl / n)', 6)} AS ratio FROM (
 SELECT field_id, k, sum(c) AS n, sum(c * log2(c)) AS cl FROM (SELECT field_id, k, byte, count(*) AS c FROM ({_BYTES}) GROUP BY ALL) GROUP BY ALL) GROUP BY field_id""",
)
def entropy_ratio(spark, d):
    e = codecs.entropy_ratio(events(spark, d))
    return e.select("field_id", "n", rnd(F.col("bits"), 6).alias("bits"), rnd(F.col("ratio"), 6).alias("ratio"))


_STEP = "lambda a, b: {'s': a.s + (b.s - a.c), 'c': ((a.s + (b.s - a.c)) - a.s) - (b.s - a.c)}"
_PARTS = f"""SELECT field_id, list_reduce(list(x ORDER BY i), lambda a, b: a + b) AS plain, list_reduce(list({{'s': x, 'c': CAST(0 AS FLOAT)}} ORDER BY i), {_STEP}).s AS kahan, sum({D('x')}) AS exact
 FROM ({EVENTS}) GROUP BY field_id, i // {sums.SEGMENT}, i % {sums.STRIDES}"""


@query("q_kahan_sums", f"SELECT field_id, {R(f'sum({D("plain")})', 4)} AS plain, {R(f'sum({D("kahan")})', 4)} AS kahan, {R('sum(exact)', 4)} AS exact FROM ({_PARTS}) GROUP BY field_id")
def kahan_sums(spark, d):
    return sums.compensated_sums(events(spark, d)).select("field_id", *(rnd(F.col(c), 4).alias(c) for c in ("plain", "kahan", "exact")))


def restored(spark, d):
    return correct.conserve(events(spark, d).withColumn("xh", _ABS.recon(F.col("x"))), 3)
