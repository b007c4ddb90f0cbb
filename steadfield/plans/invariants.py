"""Queries on sums, correctors, reports and ranks."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..functions.numeric import f32, f64, floor_quantize, uniform_quantize
from ..operators import correct, ranks
from ..operators import invariants as inv
from .base import BALANCES, EVENTS, PRICED, VECTOR_CUBE, D, R, balances, events, priced, query, rnd, vector_cube

Q = 0.5
FLOORED = f"SELECT *, CAST(floor({D('x')} / {Q}) * {Q} AS FLOAT) AS xh FROM ({EVENTS})"
SUMS = f"count(*) AS n, sum({D('x')}) AS m0, sum({D('x')} * {D('x')}) AS s0, sum({D('xh')}) AS m1, sum({D('xh')} * {D('xh')}) AS s1"
STATS = f"SELECT field_id, {SUMS} FROM ({FLOORED}) GROUP BY field_id"
A_BOTH = "sqrt((s0 / n - (m0 / n) * (m0 / n)) / (s1 / n - (m1 / n) * (m1 / n)))"


def floored(spark, d):
    return events(spark, d).withColumn("xh", f32(floor_quantize(F.col("x"), Q)))


def _after(params_sql: str, stats: str = STATS, rows: str = FLOORED, out: str = "", value: str = "") -> str:
    """Rows mapped by params (field_id, a, b) and summed up."""
    return f"""WITH f AS ({rows}), p AS (SELECT field_id, n, m0, s0, {params_sql} FROM ({stats})),
 c AS (SELECT f.*, p.a, p.b, CAST(p.a * {D('f.xh')} + p.b AS FLOAT) AS xc FROM f JOIN p USING (field_id)),
 g AS (SELECT field_id, any_value(a) AS a, any_value(b) AS b, count(*) AS n, sum({D('xc')}) AS mc, sum({D('xc')} * {D('xc')}) AS sc, sum({D('x')}) AS m0, sum({D('x')} * {D('x')}) AS s0 {value} FROM c GROUP BY field_id)
 SELECT field_id, n, {R('a', 8)} AS a, {R('b', 6)} AS b, {R('mc', 1)} AS mass, {R('sc', 0)} AS energy, abs(mc - m0) <= 1e-6 * abs(m0) AS mass_kept, abs(sc - s0) <= 1e-6 * s0 AS energy_kept {out} FROM g"""


def _report(coded, p, keys=("field_id",), value=(), out=()):
    keys = list(keys)
    mapped = correct.attach(coded, p.select(*keys, "a", "b"), keys).withColumn("xc", correct.affine(F.col("xh"), F.col("a"), F.col("b")))
    g = mapped.groupBy(*keys).agg(
        F.first("a").alias("a"), F.first("b").alias("b"), F.count(F.lit(1)).alias("n"), inv.mass(F.col("xc")).alias("mc"), inv.energy(F.col("xc")).alias("sc"),
        inv.mass(F.col("x")).alias("m0"), inv.energy(F.col("x")).alias("s0"), *value,
    )
    return g.select(
        *keys, "n", rnd(F.col("a"), 8).alias("a"), rnd(F.col("b"), 6).alias("b"), rnd(F.col("mc"), 1).alias("mass"), rnd(F.col("sc"), 0).alias("energy"),
        (F.abs(F.col("mc") - F.col("m0")) <= 1e-6 * F.abs(F.col("m0"))).alias("mass_kept"), (F.abs(F.col("sc") - F.col("s0")) <= 1e-6 * F.col("s0")).alias("energy_kept"), *out,
    )


@query("q_invariants", f"SELECT field_id, count(*) AS n, {R(f'sum({D("x")})', 2)} AS mass, {R(f'sum({D("x")} * {D("x")})', 0)} AS energy FROM ({EVENTS}) GROUP BY field_id")
def invariants(spark, d):
    g = inv.invariants(events(spark, d))
    return g.select("field_id", "n", rnd(F.col("mass"), 2).alias("mass"), rnd(F.col("energy"), 0).alias("energy"))


@query("q_total_energy", f"SELECT field_id, {R(f'0.5 * 1.2 * sum({D("x")} * {D("x")})', 0)} AS energy FROM ({EVENTS}) GROUP BY field_id")
def total_energy(spark, d):
    return events(spark, d).groupBy("field_id").agg(rnd(inv.total_energy(F.col("x"), 1.2), 0).alias("energy"))


_WSTATS = f"""SELECT field_id, {SUMS}, sum({D('w')} * {D('x')}) AS l0, sum({D('w')} * {D('xh')}) AS l1, sum({D('w')}) AS sw
 FROM (SELECT *, CAST(floor({D('x')} / 10.0) * 10.0 AS FLOAT) AS xh FROM ({PRICED})) GROUP BY field_id"""


@query(
    "q_weighted_linear",
    f"SELECT field_id, n, {R('l0', -3)} AS momentum, {R('sw', 0)} AS weight, {R('(l0 - l1) / sw', 6)} AS b FROM ({_WSTATS})",
)
def weighted_linear(spark, d):
    st = correct.stats(priced(spark, d).withColumn("xh", f32(floor_quantize(F.col("x"), 10.0))), w="w")
    p = correct.params(st, 1, use_weights=True)
    return p.select("field_id", "n", rnd(F.col("l0"), -3).alias("momentum"), rnd(F.col("sw"), 0).alias("weight"), rnd(F.col("b"), 6).alias("b"))


@query(
    "q_vector_invariants",
    f"""SELECT k, {R(f'sum({D("u")} * {D("u")} + {D("v")} * {D("v")} + {D("w")} * {D("w")})', 6)} AS energy, {R(f'sum({D("u")})', 6)} AS momentum_u,
 {R(f'sum({D("v")})', 6)} AS momentum_v, {R(f'sum({D("w")})', 6)} AS momentum_w FROM ({VECTOR_CUBE}) GROUP BY k""",
)
def vector_invariants(spark, d):
    g = inv.vector_invariants(vector_cube(spark, d), ["u", "v", "w"], ["k"])
    return g.select("k", *(rnd(F.col(c), 6).alias(c) for c in g.columns if c != "k"))


@query("q_conserve_mass_energy", _after(f"{A_BOTH} AS a, m0 / n - {A_BOTH} * (m1 / n) AS b"))
def conserve_mass_energy(spark, d):
    f = floored(spark, d)
    return _report(f, correct.params(correct.stats(f), 3))


@query("q_conserve_linear", _after("CAST(1.0 AS DOUBLE) AS a, (m0 - m1) / n AS b"))
def conserve_linear(spark, d):
    f = floored(spark, d)
    return _report(f, correct.params(correct.stats(f), 1))


@query("q_conserve_energy", _after("CASE WHEN s1 > 0 THEN sqrt(s0 / s1) ELSE 1.0 END AS a, CAST(0.0 AS DOUBLE) AS b"))
def conserve_energy(spark, d):
    f = floored(spark, d)
    return _report(f, correct.params(correct.stats(f), 2))


_TEN = f"SELECT *, CAST(floor({D('x')} / 10.0) * 10.0 AS FLOAT) AS xh FROM ({PRICED})"


@query(
    "q_conserve_linear_w",
    f"""WITH f AS ({_TEN}), p AS (SELECT field_id, (l0 - l1) / sw AS b FROM ({_WSTATS})), c AS (SELECT f.*, CAST({D('f.xh')} + p.b AS FLOAT) AS xc FROM f JOIN p USING (field_id)),
 g AS (SELECT field_id, count(*) AS n, sum({D('w')} * {D('x')}) AS l0, sum({D('w')} * {D('xh')}) AS l1, sum({D('w')} * {D('xc')}) AS lc FROM c GROUP BY field_id)
 SELECT field_id, n, {R('abs(l1 - l0) / l0', 7)} AS drift_before, abs(lc - l0) <= 1e-6 * l0 AS kept FROM g""",
)
def conserve_linear_w(spark, d):
    f = priced(spark, d).withColumn("xh", f32(floor_quantize(F.col("x"), 10.0)))
    g = correct.conserve(f, 1, w="w").groupBy("field_id").agg(F.count(F.lit(1)).alias("n"), *(inv.weighted(F.col(c), F.col("w")).alias(k) for c, k in (("x", "l0"), ("xh", "l1"), ("xc", "lc"))))
    return g.select("field_id", "n", rnd(F.abs(F.col("l1") - F.col("l0")) / F.col("l0"), 7).alias("drift_before"), (F.abs(F.col("lc") - F.col("l0")) <= 1e-6 * F.col("l0")).alias("kept"))


_MODE = f"""SELECT field_id, mode, CASE mode WHEN 3 THEN {A_BOTH} WHEN 2 THEN sqrt(s0 / s1) ELSE 1.0 END AS a,
 CASE mode WHEN 3 THEN m0 / n - {A_BOTH} * (m1 / n) WHEN 1 THEN (m0 - m1) / n ELSE 0.0 END AS b FROM ({STATS}), (SELECT unnest([0, 1, 2, 3]) AS mode)"""


@query("q_conserve_apply_modes", f"SELECT field_id, CAST(mode AS INTEGER) AS mode, {R('a', 8)} AS a, {R('b', 6)} AS b, CAST(8 * bit_count(mode) AS INTEGER) AS side_bytes FROM ({_MODE})")
def conserve_apply_modes(spark, d):
    st = correct.stats(floored(spark, d))
    out = None
    for mode in range(4):
        p = correct.params(st, mode).select("field_id", F.lit(mode).alias("mode"), "a", "b")
        out = p if out is None else out.unionByName(p)
    return out.select("field_id", "mode", rnd(F.col("a"), 8).alias("a"), rnd(F.col("b"), 6).alias("b"), (8 * F.bit_count("mode")).cast("int").alias("side_bytes"))


_REL = f"SELECT *, CAST(round_even({D('x')} / {Q}, 0) * {Q} AS FLOAT) AS xh FROM ({EVENTS}) WHERE x <> 0"
_RELSTATS = f"SELECT field_id, {SUMS} FROM ({_REL}) GROUP BY field_id"


def nonzero(spark, d):
    return events(spark, d).filter("x <> 0").withColumn("xh", f32(uniform_quantize(F.col("x"), Q)))


@query("q_rel_scale_mass", _after("CASE WHEN m1 <> 0 THEN m0 / m1 ELSE 1.0 END AS a, CAST(0.0 AS DOUBLE) AS b", _RELSTATS, _REL))
def rel_scale_mass(spark, d):
    f = nonzero(spark, d)
    return _report(f, correct.relative_params(correct.stats(f), 1))


@query("q_rel_scale_energy", _after("sqrt(s0 / s1) AS a, CAST(0.0 AS DOUBLE) AS b", _RELSTATS, _REL))
def rel_scale_energy(spark, d):
    f = nonzero(spark, d)
    return _report(f, correct.relative_params(correct.stats(f), 2))


@query(
    "q_rel_additive_violation",
    f"""WITH f AS ({FLOORED}), p AS (SELECT field_id, (m0 - m1) / n AS b FROM ({STATS}))
 SELECT field_id, count(*) AS n, count(*) FILTER (x <> 0 AND abs(1 - {D('xh')} / {D('x')}) > 0.01) AS before, count(*) FILTER (x <> 0 AND abs(1 - {D('CAST(' + D('xh') + ' + b AS FLOAT)')} / {D('x')}) > 0.01) AS after
 FROM f JOIN p USING (field_id) GROUP BY field_id""",
)
def rel_additive_violation(spark, d):
    f = correct.conserve(floored(spark, d), 1)
    bad = lambda c: F.count_if((F.col("x") != 0) & inv.violates_relative(F.col("x"), F.col(c), 0.01))
    return f.groupBy("field_id").agg(F.count(F.lit(1)).alias("n"), bad("xh").alias("before"), bad("xc").alias("after"))


@query("q_rel_refuse_joint", f"SELECT field_id, CAST(1.0 AS DOUBLE) AS a, CAST(0.0 AS DOUBLE) AS b, false AS ok FROM ({_RELSTATS})")
def rel_refuse_joint(spark, d):
    return correct.relative_params(correct.stats(nonzero(spark, d)), 3).select("field_id", "a", "b", "ok")


@query("q_params_affine", f"SELECT field_id, {R(A_BOTH, 8)} AS a3, {R(f'm0 / n - {A_BOTH} * (m1 / n)', 6)} AS b3, {R('(m0 - m1) / n', 6)} AS b1, {R('sqrt(s0 / s1)', 8)} AS a2 FROM ({STATS})")
def params_affine(spark, d):
    st = correct.stats(floored(spark, d))
    (a3, b3), (_, b1), (a2, _) = correct.both_params(), correct.mass_params(), correct.energy_params()
    return st.select("field_id", rnd(a3, 8).alias("a3"), rnd(b3, 6).alias("b3"), rnd(b1, 6).alias("b1"), rnd(a2, 8).alias("a2"))


@query(
    "q_maxdisp",
    f"""WITH p AS (SELECT field_id, {A_BOTH} AS a, m0 / n - {A_BOTH} * (m1 / n) AS b FROM ({STATS}))
 SELECT field_id, {R(f'max(abs((a - 1) * {D("xh")} + b))', 6)} AS maxdisp FROM ({FLOORED}) JOIN p USING (field_id) GROUP BY field_id""",
)
def maxdisp(spark, d):
    f = floored(spark, d)
    p = correct.params(correct.stats(f), 3).select("field_id", "a", "b")
    return correct.attach(f, p).groupBy("field_id").agg(rnd(F.max(correct.displacement(F.col("xh"), F.col("a"), F.col("b"))), 6).alias("maxdisp"))


@query(
    "q_cap_percentile",
    f"""WITH m AS (SELECT field_id, CAST(avg({D('x')}) AS FLOAT) AS mu FROM ({EVENTS}) GROUP BY field_id),
 v AS (SELECT field_id, abs(x - mu) AS v FROM ({EVENTS}) JOIN m USING (field_id)),
 r AS (SELECT field_id, v, row_number() OVER (PARTITION BY field_id ORDER BY v) - 1 AS r, count(*) OVER (PARTITION BY field_id) AS n FROM v)
 SELECT field_id, {R(D('v'), 3)} AS kth FROM r WHERE r = CAST(floor(97.0 / 100 * (n - 1)) AS BIGINT)""",
)
def cap_percentile(spark, d):
    f = events(spark, d)
    m = f.groupBy("field_id").agg(f32(F.avg(f64(F.col("x")))).alias("mu"))
    return ranks.kth_smallest(f.join(m, "field_id"), ["field_id"], F.abs(F.col("x") - F.col("mu")), 97.0).select("field_id", rnd(f64(F.col("kth")), 3).alias("kth"))


_CAP = f"(CASE WHEN k = {correct.CAP_TRIES - 1} THEN CAST('infinity' AS DOUBLE) ELSE 20.0 * pow(2, k) END)"


def _capped_sql(energy_only: bool, restored: bool = False) -> str:
    if energy_only:
        a_, b_, c_, dd = "g2", "2 * xg", "s2 - s0", "CAST(0.0 AS DOUBLE)"
        lin = "CAST(0.0 AS DOUBLE)"
    else:
        dd = "(m0 - s1)"
        a_, b_, c_ = "(g2 - g1 * g1 / n)", "2 * (xg - s1 * g1 / n)", f"(s2 + 2 * s1 * {dd} / n + {dd} * {dd} / n - s0)"
        lin = f"({dd} - b * g1) / n"
    return f"""WITH f AS ({FLOORED}), t AS (SELECT field_id, sum({D('x')}) AS m0, sum({D('x')} * {D('x')}) AS s0, avg({D('xh')}) AS mu0 FROM f GROUP BY field_id),
 e AS (SELECT field_id, k, mu0, m0, s0, {D('xh')} AS v, greatest(-{_CAP}, least({_CAP}, {D('xh')} - mu0)) AS g FROM f JOIN t USING (field_id), (SELECT unnest(range({correct.CAP_TRIES})) AS k)),
 s AS (SELECT field_id, k, count(*) AS n, any_value(m0) AS m0, any_value(s0) AS s0, sum(v) AS s1, sum(v * v) AS s2, sum(g) AS g1, sum(g * g) AS g2, sum(v * g) AS xg FROM e GROUP BY field_id, k),
 q AS (SELECT *, {a_} AS qa, {b_} AS qb, {c_} AS qc FROM s), z AS (SELECT *, qb * qb - 4 * qa * qc AS disc FROM q), ok AS (SELECT *, (-qb + sqrt(disc)) / (2 * qa) AS r1, (-qb - sqrt(disc)) / (2 * qa) AS r2 FROM z WHERE qa > 0 AND disc >= 0),
 w AS (SELECT *, CASE WHEN abs(r1) < abs(r2) THEN r1 ELSE r2 END AS b FROM ok), l AS (SELECT field_id, k, {lin} AS a, b FROM w), best AS (SELECT field_id, min(k) AS k, arg_min(a, k) AS a, arg_min(b, k) AS b FROM l GROUP BY field_id)""" + (
        f"""SELECT field_id, {R('sum(xc)', 1)} AS mass, {R('sum(xc * xc)', -1)} AS energy, {R('max(abs(xc - v))', 4)} AS moved
 FROM (SELECT field_id, v, {D("CAST(v + a + b * g AS FLOAT)")} AS xc FROM e JOIN best USING (field_id, k)) GROUP BY field_id"""
        if restored
        else f"SELECT field_id, CAST(k AS INTEGER) AS k, {R('a', 6)} AS a, {R('b', 6)} AS b FROM best"
    )


def _targets(f):
    return f.groupBy("field_id").agg(inv.mass(F.col("x")).alias("m0"), inv.energy(F.col("x")).alias("s0"), F.avg(f64(F.col("xh"))).alias("mu0"), F.lit(20.0).alias("cap0"))


def _capped(spark, d, energy_only):
    f = floored(spark, d)
    found = correct.cap_search(f, _targets(f), energy_only=energy_only)
    return found.select("field_id", F.col("k").cast("int").alias("k"), rnd(F.col("a"), 6).alias("a"), rnd(F.col("b"), 6).alias("b"))


def _capped_restored(spark, d, energy_only):
    f = floored(spark, d)
    xc, xh = f64(F.col("xc")), f64(F.col("xh"))
    out = correct.capped_restore(f, _targets(f), energy_only=energy_only).groupBy("field_id")
    return out.agg(rnd(F.sum(xc), 1).alias("mass"), rnd(F.sum(xc * xc), -1).alias("energy"), rnd(F.max(F.abs(xc - xh)), 4).alias("moved"))


@query("q_capped_me", _capped_sql(False))
def capped_me(spark, d):
    return _capped(spark, d, False)


@query("q_capped_energy", _capped_sql(True))
def capped_energy(spark, d):
    return _capped(spark, d, True)


@query("q_capped_restore", _capped_sql(False, restored=True))
def capped_restored(spark, d):
    return _capped_restored(spark, d, False)


@query("q_capped_restore_energy", _capped_sql(True, restored=True))
def capped_restored_energy(spark, d):
    return _capped_restored(spark, d, True)


@query(
    "q_error_stats",
    f"""SELECT field_id, {R('max(e)', 6)} AS max_abs, {R('avg(e)', 6)} AS mean_abs, {R('sqrt(avg(e * e))', 6)} AS rmse, {R(f'max(e) / (max(abs({D("x")})) + 1e-12) * 100', 6)} AS max_rel_pct
 FROM (SELECT *, abs({D('x')} - {D('xh')}) AS e FROM ({FLOORED})) GROUP BY field_id""",
)
def error_stats(spark, d):
    return floored(spark, d).groupBy("field_id").agg(*(rnd(c, 6).alias(n) for n, c in inv.error_stats(F.col("x"), F.col("xh")).items()))


@query("q_psnr", f"SELECT field_id, {R(f'20 * log10(max({D("x")}) - min({D("x")})) - 10 * log10(avg(({D("x")} - {D("xh")}) * ({D("x")} - {D("xh")})))', 5)} AS psnr FROM ({FLOORED}) GROUP BY field_id")
def psnr(spark, d):
    return floored(spark, d).groupBy("field_id").agg(rnd(inv.psnr(F.col("x"), F.col("xh")), 5).alias("psnr"))


_BFLOOR = f"SELECT *, CAST(floor({D('x')} / 5.0) * 5.0 AS FLOAT) AS xh FROM ({BALANCES})"


@query("q_drift_signed", f"SELECT field_id, {R(f'abs(sum({D("xh")}) - sum({D("x")})) / sum(abs({D("x")}))', 7)} AS mass_drift, {R(f'abs(sum({D("xh")} * {D("xh")}) - sum({D("x")} * {D("x")})) / sum({D("x")} * {D("x")})', 7)} AS energy_drift FROM ({_BFLOOR}) GROUP BY field_id")
def drift_signed(spark, d):
    f = balances(spark, d).withColumn("xh", f32(floor_quantize(F.col("x"), 5.0)))
    m = F.abs(inv.mass(F.col("xh")) - inv.mass(F.col("x"))) / F.sum(F.abs(f64(F.col("x"))))
    return f.groupBy("field_id").agg(rnd(m, 7).alias("mass_drift"), rnd(inv.drift(inv.energy(F.col("x")), inv.energy(F.col("xh"))), 7).alias("energy_drift"))


@query(
    "q_violations",
    f"""SELECT field_id, count(*) AS n, count(*) FILTER (xh < x - b OR xh > x + b OR abs(x - xh) > b) AS violations FROM (SELECT *, CAST(0.3 AS FLOAT) AS b FROM ({FLOORED})) GROUP BY field_id""",
)
def violations(spark, d):
    c = inv.violation_counts(F.col("x"), F.col("xh"), 0.3)
    return floored(spark, d).groupBy("field_id").agg(c["n"].alias("n"), c["violations"].alias("violations"))


@query(
    "q_inf_nan",
    f"""SELECT field_id, count(*) AS n, count(*) FILTER (isnan(x) OR isinf(x)) AS odd, count(*) FILTER (isnan(x) <> isnan(xh) OR (isinf(x) AND x <> xh)) AS not_finite_mismatches
 FROM (SELECT field_id, CASE i % 100 WHEN 0 THEN CAST('nan' AS FLOAT) WHEN 1 THEN CAST('inf' AS FLOAT) ELSE x END AS x, CASE i % 300 WHEN 0 THEN CAST('nan' AS FLOAT) WHEN 1 THEN CAST('inf' AS FLOAT) ELSE x END AS xh FROM ({EVENTS})) GROUP BY field_id""",
)
def inf_nan(spark, d):
    odd = lambda m: F.when(F.col("i") % m == 0, F.lit(math.nan)).when(F.col("i") % m == 1, F.lit(math.inf)).otherwise(F.col("x")).cast("float")
    f = events(spark, d).withColumns({"y": odd(100), "xh": odd(300)})
    c = inv.violation_counts(F.col("y"), F.col("xh"), 1.0)
    return f.groupBy("field_id").agg(c["n"].alias("n"), F.count_if(inv.not_finite(F.col("y"))).alias("odd"), c["not_finite_mismatches"].alias("not_finite_mismatches"))


@query("q_near_zero_guard", f"SELECT field_id, CASE WHEN abs(m0) >= 1 THEN {R('abs(m1 - m0) / abs(m0)', 8)} END AS drift FROM ({STATS})")
def near_zero_guard(spark, d):
    return correct.stats(floored(spark, d)).select("field_id", rnd(inv.drift_or_null(F.col("m0"), F.col("m1")), 8).alias("drift"))


@query("q_topk_worst", f"SELECT field_id, i, {R('e', 5)} AS e FROM (SELECT field_id, i, abs({D('x')} - {D('xh')}) AS e FROM ({FLOORED})) ORDER BY e DESC, i LIMIT 5")
def topk_worst(spark, d):
    f = floored(spark, d).withColumn("e", F.abs(f64(F.col("x")) - f64(F.col("xh"))))
    return inv.top_k(f, [F.desc("e"), F.col("i")], 5).select("field_id", "i", rnd(F.col("e"), 5).alias("e"))


@query("q_argmax_worst", f"SELECT field_id, arg_max(i, (e, -i)) AS i, {R('max(e)', 5)} AS e FROM (SELECT field_id, i, abs({D('x')} - {D('xh')}) AS e FROM ({FLOORED})) GROUP BY field_id")
def argmax_worst(spark, d):
    f = floored(spark, d).withColumn("e", F.abs(f64(F.col("x")) - f64(F.col("xh"))))
    return f.groupBy("field_id").agg(F.max_by("i", F.struct("e", -F.col("i"))).alias("i"), rnd(F.max("e"), 5).alias("e"))


@query(
    "q_window_invariants",
    f"SELECT date_trunc('day', ts) AS start, event_type, count(*) AS n, {R('sum(CAST(CAST(value AS FLOAT) AS DOUBLE))', 2)} AS mass, {R('sum(CAST(CAST(value AS FLOAT) AS DOUBLE) * CAST(CAST(value AS FLOAT) AS DOUBLE))', 0)} AS energy FROM events GROUP BY 1, 2",
)
def window_invariants(spark, d):
    from ..streaming import windows
    from .base import table

    g = windows.window_invariants(table(spark, d, "events"), F.col("value").cast("float"), keys=["event_type"])
    return g.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", rnd(F.col("mass"), 2).alias("mass"), rnd(F.col("energy"), 0).alias("energy"))


@query(
    "q_exact_sums",
    "SELECT event_type AS field_id, CAST(sum(CAST(value AS DECIMAL(18, 2))) AS DOUBLE) AS mass FROM events GROUP BY event_type",
)
def exact_sums(spark, d):
    from .base import table

    return table(spark, d, "events").groupBy(F.col("event_type").alias("field_id")).agg(F.sum(F.col("value").cast("decimal(18,2)")).cast("double").alias("mass"))


@query("q_union_masks", "SELECT event_id AS i, value > 100 OR event_type = 'error' AS masked FROM events")
def union_masks(spark, d):
    from .base import table

    return table(spark, d, "events").select(F.col("event_id").alias("i"), ((F.col("value") > 100) | (F.col("event_type") == "error")).alias("masked"))
