"""Closed-form restoration of invariants: statistics of a reconstruction to parameters, parameters to a map.

Every corrector is ``stats`` (one aggregation) -> ``params`` (a row for each field) -> ``apply`` (a projection). The
parameters are one row for each field. ``attach`` runs the aggregation, and if it gives ``BROADCAST_ROWS`` rows or
fewer, they are broadcast and the rows of the field never leave their tasks; beyond that it is a join of two shuffled
sides, which adaptive execution may split. Params that were stored at encoding make decoding a projection.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import clamp, f32, f64
from ..model import Invariant
from ..shared import keep
from . import invariants as inv

#: Fixed value: how often a cap is doubled, the last time to infinity.
CAP_TRIES = 64
#: Rows up to which parameters are sent to all tasks; a row is a few numbers.
BROADCAST_ROWS = 50_000


def stats(field: DataFrame, xh: str = "xh", x: str = "x", w: str | None = None, keys: list[str] | None = None) -> DataFrame:
    """Sums of the original and the reconstruction in one pass."""
    sums = [
        F.count(F.lit(1)).alias("n"), inv.mass(F.col(x)).alias("m0"), inv.energy(F.col(x)).alias("s0"),
        inv.mass(F.col(xh)).alias("m1"), inv.energy(F.col(xh)).alias("s1"),
    ]
    if w:
        sums += [inv.weighted(F.col(x), F.col(w)).alias("l0"), inv.weighted(F.col(xh), F.col(w)).alias("l1"), inv.mass(F.col(w)).alias("sw")]
    return field.groupBy(*(keys or ["field_id"])).agg(*sums)


def both_params(clamp_variance: bool = False) -> tuple[Column, Column]:
    """Mass and energy: a scale about the mean. A reconstruction without variance is only shifted."""
    n, m0, s0, m1, s1 = (F.col(c) for c in ("n", "m0", "s0", "m1", "s1"))
    mean0, var0 = inv.mean_and_variance(n, m0, s0)
    mean, var = inv.mean_and_variance(n, m1, s1)
    if clamp_variance:
        var0 = F.greatest(var0, F.lit(0.0))
    a = F.when(var > 0, F.sqrt(var0 / F.when(var > 0, var))).otherwise(F.lit(1.0))
    return a, mean0 - a * mean


def mass_params() -> tuple[Column, Column]:
    return F.lit(1.0), (F.col("m0") - F.col("m1")) / F.col("n")


def weighted_params() -> tuple[Column, Column]:
    """An unweighted offset that restores the weighted sum."""
    return F.lit(1.0), F.when(F.col("sw") != 0, (F.col("l0") - F.col("l1")) / F.when(F.col("sw") != 0, F.col("sw"))).otherwise(F.lit(0.0))


def energy_params(least: float = 0.0) -> tuple[Column, Column]:
    return F.when(F.col("s1") > least, F.sqrt(F.col("s0") / F.when(F.col("s1") > least, F.col("s1")))).otherwise(F.lit(1.0)), F.lit(0.0)


def scale_mass_params() -> tuple[Column, Column]:
    """Mass by a factor, which keeps relative bounds."""
    return F.when(F.col("m1") != 0, F.col("m0") / F.when(F.col("m1") != 0, F.col("m1"))).otherwise(F.lit(1.0)), F.lit(0.0)


def params(st: DataFrame, mode: int, use_weights: bool = False) -> DataFrame:
    """Adds a and b of the map a * x + b for a mode of Invariant."""
    if mode == Invariant.BOTH:
        a, b = both_params()
    elif mode == Invariant.MASS:
        a, b = weighted_params() if use_weights else mass_params()
    elif mode == Invariant.ENERGY:
        a, b = energy_params()
    else:
        a, b = F.lit(1.0), F.lit(0.0)
    return st.withColumns({"a": a, "b": b})


def relative_params(st: DataFrame, mode: int) -> DataFrame:
    """As params, by factors alone. Mass and energy can't both be kept by one factor: ok is false and nothing changes."""
    if mode == Invariant.BOTH:
        return st.withColumns({"a": F.lit(1.0), "b": F.lit(0.0), "ok": F.lit(False)})
    a, b = scale_mass_params() if mode == Invariant.MASS else energy_params() if mode == Invariant.ENERGY else (F.lit(1.0), F.lit(0.0))
    return st.withColumns({"a": a, "b": b, "ok": F.lit(True)})


def attach(field: DataFrame, p: DataFrame, keys: list[str] | None = None, how: str = "inner") -> DataFrame:
    """Joins parameters, one row for each value of keys, to rows. Runs a job for the parameters."""
    keys = keys or ["field_id"]
    rows = p.limit(BROADCAST_ROWS + 1).collect()
    if len(rows) > BROADCAST_ROWS:
        return field.join(p, keys, how)
    return field.join(F.broadcast(p.sparkSession.createDataFrame(rows, p.schema)), keys, how)


def affine(xh: Column, a: Column, b: Column) -> Column:
    """The map in 64 bits, stored in 32."""
    return f32(a * f64(xh) + b)


def apply_affine(field: DataFrame, p: DataFrame, xh: str = "xh", out: str = "xc", keys: list[str] | None = None) -> DataFrame:
    keys = keys or ["field_id"]
    return attach(field, p.select(*keys, "a", "b"), keys).withColumn(out, affine(F.col(xh), F.col("a"), F.col("b"))).drop("a", "b")


def conserve(field: DataFrame, mode: int, xh: str = "xh", x: str = "x", w: str | None = None, out: str = "xc", keys: list[str] | None = None) -> DataFrame:
    """Statistics, parameters and map in one plan."""
    st = stats(field, xh, x, w, keys)
    return apply_affine(field, params(st, mode, bool(w)), xh, out, keys)


def displacement(xh: Column, a: Column, b: Column) -> Column:
    """How far the map moves a value."""
    return F.abs((a - 1) * f64(xh) + b)


def capped_solution(energy_only: bool = False) -> dict[str, Column]:
    """From n, s1, s2, g1, g2, xg and the targets m0, s0: the coefficients a and b of x + a + b * g, and solved. Of the
    roots of the quadratic the smaller in size is taken, the second on a tie."""
    n, s1, s2, g1, g2, xg, m0, s0 = (F.col(c) for c in ("n", "s1", "s2", "g1", "g2", "xg", "m0", "s0"))
    if energy_only:
        qa, qb, qc, d = g2, 2 * xg, s2 - s0, F.lit(0.0)
    else:
        d = m0 - s1
        qa, qb, qc = g2 - g1 * g1 / n, 2 * (xg - s1 * g1 / n), s2 + 2 * s1 * d / n + d * d / n - s0
    disc = qb * qb - 4 * qa * qc
    solved = (qa > 0) & (disc >= 0)
    root = F.sqrt(F.when(solved, disc))
    r1, r2 = (-qb + root) / F.when(solved, 2 * qa), (-qb - root) / F.when(solved, 2 * qa)
    b = F.when(F.abs(r1) < F.abs(r2), r1).otherwise(r2)
    a = F.lit(0.0) if energy_only else (d - b * g1) / n
    return {"a": F.when(solved, a), "b": F.when(solved, b), "solved": solved}


def capped_map(xh: Column, a: Column, b: Column, mu0: Column, cap: Column) -> Column:
    return f32(f64(xh) + a + b * clamp(f64(xh) - mu0, -cap, cap))


def hold(rows: DataFrame) -> DataFrame:
    """One row for each field or setting, held so that later rounds don't run the earlier ones again: by the driver up to
    a checked number, else as a table in the shared folder."""
    spark = rows.sparkSession
    some = rows.limit(BROADCAST_ROWS + 1).collect()
    if len(some) <= BROADCAST_ROWS:
        return spark.createDataFrame(some, rows.schema)
    return keep(rows, "held")


def cap_search(field: DataFrame, targets: DataFrame, xh: str = "xh", energy_only: bool = False, keys: list[str] | None = None, tries: int = CAP_TRIES, at_once: int = 8) -> DataFrame:
    """(*keys, mu0, cap, a, b, k): the least doubling of the first cap that can be solved, the last being no cap at all.

    targets: (*keys, m0, s0, mu0, cap0). A pass sums up ``at_once`` candidates as columns, so rows are not multiplied;
    fields that none of them solves go on to the next candidates, and most need one pass."""
    keys = keys or ["field_id"]
    left, out, fixed = targets, None, ["mu0", "m0", "s0", "cap0"]
    for first in range(0, tries, at_once):
        caps = {k: F.lit(math.inf) if k == tries - 1 else F.col("cap0") * 2.0**k for k in range(first, min(first + at_once, tries))}
        sums = {k: inv.capped_moments(F.col(xh), F.col("mu0"), cap) for k, cap in caps.items()}
        of_cap = ("g1", "g2", "xg")  # the others don't depend on the cap
        shared = {n: c for n, c in sums[first].items() if n not in of_cap}
        summed = attach(field, left, keys).groupBy(*keys, *fixed).agg(*(c.alias(n) for n, c in shared.items()), *(sums[k][n].alias(f"{n}_{k}") for k in caps for n in of_cap))
        tried = F.explode(F.array(*(F.struct(F.lit(k).alias("k"), cap.alias("cap"), *(F.col(f"{n}_{k}").alias(n) for n in of_cap)) for k, cap in caps.items())))
        one = summed.select(*keys, *fixed, *shared, tried.alias("t")).select(*keys, *fixed, *shared, "t.*").withColumns(capped_solution(energy_only))
        best = F.min_by(F.when(F.col("solved"), F.struct("mu0", "cap", "a", "b", "k")), F.when(F.col("solved"), F.col("k"))).alias("p")
        done = hold(one.groupBy(*keys).agg(best))
        solved = done.filter("p is not null").select(*keys, "p.*")
        out = solved if out is None else out.unionByName(solved)
        left = left.join(done.filter("p is null").select(*keys), keys, "left_semi")
        if done.filter("p is null").isEmpty():
            break
    return out


def capped_restore(field: DataFrame, targets: DataFrame, xh: str = "xh", x: str = "x", energy_only: bool = False, keys: list[str] | None = None, out: str = "xc", tries: int = CAP_TRIES) -> DataFrame:
    """The capped map of each field, or, where no cap can be solved, the scale about the mean (of energy alone: the scale)."""
    keys = keys or ["field_id"]
    found = cap_search(field, targets, xh, energy_only, keys, tries).select(*keys, "mu0", "cap", F.col("a").alias("ca"), F.col("b").alias("cb"))
    plain = params(stats(field, xh, x, keys=keys), Invariant.ENERGY if energy_only else Invariant.BOTH).select(*keys, "a", "b")
    both = attach(field, plain.join(found, keys, "left"), keys)
    capped = capped_map(F.col(xh), F.col("ca"), F.col("cb"), F.col("mu0"), F.col("cap"))
    return both.withColumn(out, F.when(F.col("cap").isNotNull(), capped).otherwise(affine(F.col(xh), F.col("a"), F.col("b")))).drop("a", "b", "ca", "cb", "mu0", "cap")


def tier_scale(target: Column, fixed: Column, low: Column, strictly: bool) -> Column:
    """The factor for values that may be rescaled, so that the whole keeps its energy; 1 where none can."""
    rest = target - fixed
    ok = (low >= 1e-30) & ((rest > 0) if strictly else (rest >= 0))
    return F.when(ok, F.sqrt(F.when(ok, rest / F.when(low >= 1e-30, low)))).otherwise(F.lit(1.0))
