"""Sweeps over bounds and codecs: rate, error, violations and drift before and after restoration."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import f32, f64
from . import correct
from . import invariants as inv

#: Fractions of the range that a study tries, and the headroom that restoration gets.
FRACTIONS = (1e-2, 3e-3, 1e-3, 3e-4, 1e-4)
HEADROOM = 0.9


def with_bounds(field: DataFrame, fractions: Sequence[float] = FRACTIONS, headroom: float = HEADROOM, keys: list[str] | None = None) -> DataFrame:
    """Each row once for each fraction, with its bound (that fraction of its field's range) and bound_used.
    The ranges are one row for each field; the fractions are an array in the plan."""
    keys = keys or ["field_id"]
    span = field.groupBy(*keys).agg((f64(F.max("x")) - f64(F.min("x"))).alias("span"))
    tried = correct.attach(field, span, keys).withColumn("frac", F.explode(F.array(*(F.lit(float(f)) for f in fractions))))
    return tried.withColumn("bound", F.col("frac") * F.col("span")).withColumn("bound_used", F.col("bound") * headroom).drop("span")


def study(field: DataFrame, recon: Column, fractions: Sequence[float] = FRACTIONS, headroom: float = HEADROOM, keys: list[str] | None = None) -> DataFrame:
    """(*keys, frac, n, bound, max_raw_over_b, max_cor_over_b, mass_raw, mass_cor, energy_raw, energy_cor, violations): all
    bounds in one plan. recon is an expression of x and bound_used."""
    keys = keys or ["field_id"]
    return _measured(with_bounds(field, fractions, headroom, keys), recon, [*keys, "frac"]).drop("bound_used")


def _measured(tried: DataFrame, recon: Column, by: list[str]) -> DataFrame:
    coded = tried.withColumn("xh", recon)
    fixed = correct.apply_affine(coded, correct.params(correct.stats(coded, keys=by), 3), keys=by)
    off = lambda c: F.abs(f64(F.col(c)) - f64(F.col("x")))
    out = fixed.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.first("bound").alias("bound"), F.first("bound_used").alias("bound_used"), F.max(off("xh")).alias("e_raw"), F.max(off("xc")).alias("e_cor"),
        F.count_if(off("xc") > F.col("bound")).alias("violations"), *(s(F.col(c)).alias(f"{k}{c}") for k, s in (("m", inv.mass), ("e", inv.energy)) for c in ("x", "xh", "xc")),
    )
    ratio = lambda e: F.when(F.col("bound") > 0, F.col(e) / F.when(F.col("bound") > 0, F.col("bound")))
    return out.select(
        *by, "n", "bound", "bound_used", ratio("e_raw").alias("max_raw_over_b"), ratio("e_cor").alias("max_cor_over_b"), inv.drift(F.col("mx"), F.col("mxh")).alias("mass_raw"),
        inv.drift(F.col("mx"), F.col("mxc")).alias("mass_cor"), inv.drift(F.col("ex"), F.col("exh")).alias("energy_raw"), inv.drift(F.col("ex"), F.col("exc")).alias("energy_cor"), "violations",
    )


def tightest(field: DataFrame, recon, steps: int = 5, shrink: float = 0.98, keys: list[str] | None = None, fractions: Sequence[float] = FRACTIONS) -> DataFrame:
    """As study, with the bound in use tightened where the restored error leaves the bound: by ``shrink`` times the bound
    over that error, again and again, up to ``steps`` tries in all (then the last stands). (*keys, frac, bound_used) of the
    pairs that fail is a small table; each round is one aggregate plan over their fields, and none if no pair fails."""
    keys = keys or ["field_id"]
    by = [*keys, "frac"]
    out = None
    now = _measured(with_bounds(field, fractions, HEADROOM, keys), recon, by)
    for k in range(steps):
        done = correct.hold(now.withColumn("step", F.lit(k)))
        ends = F.lit(k == steps - 1) | ~F.coalesce((F.col("max_cor_over_b") > 1) & ~F.isnan("max_cor_over_b"), F.lit(False))
        part = done.filter(ends)
        out = part if out is None else out.unionByName(part)
        again = done.filter(~ends).select(*by, "bound", (F.col("bound_used") * shrink / F.col("max_cor_over_b")).alias("bound_used"))
        if k == steps - 1 or again.isEmpty():
            break
        now = _measured(correct.attach(field, again, keys), recon, by)
    return out.select(*by, "step", "bound", "bound_used", "max_cor_over_b", "mass_cor", "energy_cor", "violations")


def feasible_step(field: DataFrame, candidates: Sequence[float], recon, limit: Column, keys: list[str] | None = None) -> DataFrame:
    """(*keys, q): the largest candidate whose greatest error stays within the limit (an aggregate or a literal)."""
    keys = keys or ["field_id"]
    tried = field.withColumn("q", F.explode(F.array(*(F.lit(float(q)) for q in candidates))))
    errors = tried.withColumn("e", F.abs(f64(f32(recon)) - f64(F.col("x")))).groupBy(*keys, "q").agg(F.max("e").alias("e"), limit.alias("lim"))
    return errors.filter("e <= lim").groupBy(*keys).agg(F.max("q").alias("q"))


def bisect(evaluate, lo: float, hi: float, limit: float, iterations: int = 18) -> float:
    """The largest tolerance whose error, which ``evaluate`` runs a job for, stays within the limit, by geometric halves."""
    for _ in range(iterations):
        mid = (lo * hi) ** 0.5
        lo, hi = (mid, hi) if evaluate(mid) <= limit else (lo, mid)
    return lo


#: Halvings that one pass of ``bisect_fields`` decides.
HALVINGS = 3


def bisect_fields(field: DataFrame, recon, limit: float, lo: float, hi: float, iterations: int = 18, keys: list[str] | None = None) -> DataFrame:
    """(*keys, q): for each field the largest tolerance whose error stays within the limit, by geometric halves of lo to hi.

    recon is a function of a column of tolerances. All fields are searched at once; a pass measures the seven
    tolerances that three halvings could come to, as columns of one aggregate, and keeps where they lead."""
    keys, parts = keys or ["field_id"], 2**HALVINGS
    state = correct.hold(field.select(*keys).distinct().withColumns({"lo": F.lit(float(lo)), "hi": F.lit(float(hi))}))
    at = lambda j: F.exp(F.log("lo") + (F.log("hi") - F.log("lo")) * j / parts)
    for _ in range(-(-iterations // HALVINGS)):
        errors = [F.max(F.abs(f64(f32(recon(at(F.lit(j))))) - f64(F.col("x")))) for j in range(1, parts)]
        place, width, one = F.lit(0), parts, correct.attach(field, state, keys).groupBy(*keys, "lo", "hi").agg(F.array(*errors).alias("e"))
        while width > 1:
            width //= 2
            place = F.when(F.element_at("e", place + width) <= limit, place + width).otherwise(place)
        one = one.withColumn("p", place)
        state = correct.hold(one.select(*keys, at(F.col("p")).alias("lo"), at(F.col("p") + 1).alias("hi")))
    return state.select(*keys, F.col("lo").alias("q"))


def compare_modes(results: DataFrame, keys: Sequence[str] = ("input", "error_bound"), plain: int = 0, restored: int = 3) -> DataFrame:
    """Rows of two modes side by side, with the change of ratio and of drifts."""
    a, b = results.filter(F.col("mode") == plain).alias("a"), results.filter(F.col("mode") == restored).alias("b")
    return a.join(b, list(keys)).select(
        *keys, F.col("a.compression_ratio").alias("ratio_plain"), F.col("b.compression_ratio").alias("ratio_restored"), F.col("a.mass_i").alias("mass_plain"),
        F.col("b.mass_i").alias("mass_restored"), F.col("a.energy_i").alias("energy_plain"), F.col("b.energy_i").alias("energy_restored"),
    )


def run_methods(field: DataFrame, methods: dict[str, Column], keys: list[str] | None = None) -> DataFrame:
    """One row of errors and drifts for each field and method, as a union of aggregates."""
    keys = keys or ["field_id"]
    out = None
    for name, recon in methods.items():
        coded = field.withColumn("xh", recon)
        sums = coded.groupBy(*keys).agg(*(c.alias(n) for n, c in inv.error_stats(F.col("x"), F.col("xh")).items()), inv.drift(inv.mass(F.col("x")), inv.mass(F.col("xh"))).alias("mass_drift"), inv.drift(inv.energy(F.col("x")), inv.energy(F.col("xh"))).alias("energy_drift"))
        sums = sums.select(F.lit(name).alias("method"), *sums.columns)
        out = sums if out is None else out.unionByName(sums)
    return out


def matched_drift(field: DataFrame, candidates: Sequence[float], recon, limit: float, keys: list[str] | None = None) -> DataFrame:
    """(*keys, q, mass_drift, energy_drift) at the coarsest candidate whose greatest error stays within the limit."""
    keys = keys or ["field_id"]
    found = feasible_step(field, candidates, recon, F.lit(float(limit)), keys)
    coded = correct.attach(field, found, keys).withColumn("xh", f32(recon))
    return coded.groupBy(*keys, "q").agg(inv.drift(inv.mass(F.col("x")), inv.mass(F.col("xh"))).alias("mass_drift"), inv.drift(inv.energy(F.col("x")), inv.energy(F.col("xh"))).alias("energy_drift"))


def suite(fields: DataFrame, methods: dict[str, Column]) -> DataFrame:
    """Errors and drifts of methods over fields of several sizes (n, field_id, x), averaged over the fields of each size."""
    one = run_methods(fields, methods, ["n", "field_id"])
    return one.groupBy("n", "method").agg(*(F.avg(c).alias(c) for c in ("max_abs", "rmse", "mass_drift", "energy_drift")))
