"""Mass, energy and any number of weighted momenta of one field, restored together.

What is linear in a field (its mass, its momenta) is its projection on the constant and the weights; what is left is at right
angles to these, and only its length counts for the energy. So a reconstruction keeps all of them after the map
a * xh + b + sum c_j * w_j, whose a is the ratio of the two lengths, the root nearest to no change of the one quadratic equation
that is left, and whose b and c take the projection of the original. Sums are taken about the means, in two passes, so that
they keep their digits; the system of the weights is solved for each field from one row of sums.

Refused (ok is false and nothing changes): fields whose weights are constant or depend on each other, reconstructions that
are nothing but constant and weights.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DoubleType, StructField, StructType

from ..functions.numeric import f64
from ..runtime import ship
from .correct import attach, hold

_LEAST = 1e-12


def solve(n: float, mean0: float, mean1: float, means: np.ndarray, e0: float, e1: float, g0: np.ndarray, g1: np.ndarray, gram: np.ndarray) -> tuple[float, float, np.ndarray, bool]:
    """a, b, c and whether it is solved, from sums about the means: e0, e1 of squares of original and reconstruction, g0, g1 of
    their products with the weights, gram of the weights among themselves."""
    none = 1.0, 0.0, np.zeros(len(means)), False
    scale = np.sqrt(np.diag(gram))
    if not n or (scale <= 0).any():
        return none
    unit = gram / np.outer(scale, scale)
    if np.linalg.eigvalsh(unit)[0] <= _LEAST:
        return none
    beta0, beta1 = (np.linalg.solve(unit, g / scale) / scale for g in (g0, g1))
    left0, left1 = e0 - g0 @ beta0, e1 - g1 @ beta1
    if left1 <= _LEAST * e1 or left0 < -_LEAST * e0:
        return none
    a = float(np.sqrt(max(left0, 0.0) / left1))
    c = beta0 - a * beta1
    return a, float(mean0 - a * mean1 - c @ means), c, True


def joint_params(field: DataFrame, weights: list[str], xh: str = "xh", x: str = "x", keys: list[str] | None = None) -> DataFrame:
    """(*keys, a, b, c, ok), one row a field. c: as many doubles as there are weights."""
    ship(field.sparkSession)
    keys, k = keys or ["field_id"], len(weights)
    columns = [x, xh, *weights]
    means = hold(field.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), *(F.avg(f64(F.col(c))).alias(f"_m{j}") for j, c in enumerate(columns))))
    v = [f64(F.col(c)) - F.col(f"_m{j}") for j, c in enumerate(columns)]
    pairs = [(0, 0), (1, 1), *((j, 2 + w) for j in (0, 1) for w in range(k)), *((2 + p, 2 + q) for p in range(k) for q in range(p, k))]
    sums = attach(field, means, keys).groupBy(*keys, "_n", *(f"_m{j}" for j in range(len(columns)))).agg(F.array(*(F.sum(v[p] * v[q]) for p, q in pairs)).alias("_s"))
    packed = sums.select(*keys, "_n", F.array(*(f"_m{j}" for j in range(len(columns)))).alias("_means"), "_s")
    out = StructType([f for f in packed.schema.fields if f.name in keys] + [StructField("a", DoubleType()), StructField("b", DoubleType()), StructField("c", ArrayType(DoubleType())), StructField("ok", BooleanType())])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            made = []
            for n, m, s in zip(pdf["_n"], pdf["_means"], pdf["_s"]):
                s, m, gram, at = np.asarray(s), np.asarray(m), np.zeros((k, k)), 2 + 2 * k
                for p in range(k):
                    for q in range(p, k):
                        gram[p, q] = gram[q, p] = s[at]
                        at += 1
                made.append(solve(n, m[0], m[1], m[2:], s[0], s[1], s[2 : 2 + k], s[2 + k : 2 + 2 * k], gram))
            yield pdf[keys].assign(a=[r[0] for r in made], b=[r[1] for r in made], c=[r[2].tolist() for r in made], ok=[r[3] for r in made])

    return packed.mapInPandas(run, out)


def restore(field: DataFrame, weights: list[str], xh: str = "xh", x: str = "x", keys: list[str] | None = None, out: str = "xc") -> DataFrame:
    """Adds out, in 64 bits, and ok."""
    keys = keys or ["field_id"]
    p = joint_params(field, weights, xh, x, keys).select(*keys, F.col("a").alias("_a"), F.col("b").alias("_b"), F.col("c").alias("_c"), "ok")
    moved = F.col("_a") * f64(F.col(xh)) + F.col("_b")
    for j, w in enumerate(weights):
        moved = moved + F.col("_c")[j] * f64(F.col(w))
    return attach(field, hold(p), keys).withColumn(out, F.when(F.col("ok"), moved).otherwise(f64(F.col(xh)))).drop("_a", "_b", "_c")
