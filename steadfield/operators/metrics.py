"""Metrics that users bring as functions on arrays, taken as mergeable aggregates, and corrections that they steer.

A ``Metric`` makes a state of an array, puts two states together and turns the last one into a number. Each task makes one
state for each field from its Arrow batches; states of one field are then put together in groups of ``FAN``, level by
level, so that no task holds more than that many, however many tasks there were.

``steer`` finds the factor for the values that may be rescaled (tiers of few bits) with which a metric of the whole
field is what it was, also where it is no power of the factor: each round takes the metric at ``AT_ONCE`` factors in one pass
and goes on between the two that enclose the target. Where the metric is as the target already the factor is 1.

Defined results: nulls don't count; a field without values has the metric of an empty array; where no factor between 0 and
``WIDEST`` meets the target, the factor is 1 and ok is false.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import BinaryType, IntegerType, StructField, StructType

from ..functions.numeric import f32, f64
from ..model import CORRECTABLE_BITS
from ..runtime import ship
from .correct import attach, hold

FAN, AT_ONCE, WIDEST, ROUNDS = 64, 33, 4.0, 6


@dataclass(frozen=True)
class Metric:
    """partial: array to state; merge: two states to one; finish: state to a number. Functions must be ones that tasks can
    get (of an installed module, or without references to others)."""

    partial: Callable[[np.ndarray], Any]
    merge: Callable[[Any, Any], Any]
    finish: Callable[[Any], float]


def states(rows: DataFrame, keys: list[str], metric: Metric, values: list[Column]) -> DataFrame:
    """(*keys, k, state): of each field and each of the columns, put together over all tasks."""
    ship(rows.sparkSession)
    base = rows.select(*keys, F.array(*(f64(v) for v in values)).alias("_v"))
    out = StructType([f for f in base.schema.fields if f.name != "_v"] + [StructField("k", IntegerType()), StructField("state", BinaryType())])
    arrow, width = to_arrow_schema(out), len(keys)

    def partials(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, Any] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            table = np.asarray(batch.column(width).flatten().to_numpy(zero_copy_only=False), dtype=np.float64).reshape(batch.num_rows, -1)
            names = pd.MultiIndex.from_arrays([batch.column(j).to_pandas() for j in range(width)])
            group, distinct = pd.factorize(names)
            for g, key in enumerate(distinct):
                for k in range(table.shape[1]):
                    v = table[group == g, k]
                    state = metric.partial(v[~np.isnan(v)])
                    at = (*key, k)
                    held[at] = metric.merge(held[at], state) if at in held else state
        columns = list(zip(*held)) if held else [()] * (width + 1)
        yield pa.RecordBatch.from_arrays([*(pa.array(list(c), f.type) for c, f in zip(columns, arrow)), pa.array([pickle.dumps(s) for s in held.values()], pa.binary())], schema=arrow)

    def together(pdf: pd.DataFrame) -> pd.DataFrame:
        state = None
        for s in sorted(pdf["state"]):  # the same order however rows arrive
            state = pickle.loads(s) if state is None else metric.merge(state, pickle.loads(s))
        return pdf.iloc[:1].assign(state=[pickle.dumps(state)])[[*keys, "k", "state"]]

    now = hold(base.mapInArrow(partials, out))
    while True:
        most = now.groupBy(*keys, "k").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0]
        if not most or most == 1:
            return now
        dealt = now.withColumn("_part", F.pmod(F.xxhash64("state"), F.lit(max(1, -(-most // FAN)))))
        now = hold(dealt.groupBy(*keys, "k", "_part").applyInPandas(together, out))


def measure(rows: DataFrame, keys: list[str], metric: Metric, **values: Column) -> DataFrame:
    """(*keys, *names): the metric of each named column."""
    names = list(values)
    finish = F.udf(lambda s: float(metric.finish(pickle.loads(bytes(s)))), "double")  # on one row a field and column
    found = states(rows, keys, metric, list(values.values())).withColumn("m", finish("state"))
    return found.groupBy(*keys).agg(*(F.max(F.when(F.col("k") == k, F.col("m"))).alias(n) for k, n in enumerate(names)))


def steer(coded: DataFrame, keys: list[str], metric: Metric, x: str = "x", xh: str = "xh", correctable: int = CORRECTABLE_BITS) -> DataFrame:
    """(*keys, target, before, alpha, after, ok) of coded rows (keys, x, xh, bits)."""
    moved = lambda a: F.when(F.col("bits") <= correctable, f64(F.col(xh)) * a).otherwise(f64(F.col(xh)))
    first = hold(measure(coded, keys, metric, target=F.col(x), before=F.col(xh)))
    left = first.select(*keys, "target", F.lit(0.0).alias("lo"), F.lit(WIDEST).alias("hi"))
    step = lambda j: F.col("lo") + (F.col("hi") - F.col("lo")) * (j / (AT_ONCE - 1))
    for _ in range(ROUNDS):
        rows = attach(coded, left, keys)
        found = measure(rows, keys, metric, **{f"m{j}": moved(step(j)) for j in range(AT_ONCE)})
        both = left.join(found, keys)
        over = [F.col(f"m{j}") - F.col("target") for j in range(AT_ONCE)]
        crossed = [(over[j] <= 0) & (over[j + 1] >= 0) | (over[j] >= 0) & (over[j + 1] <= 0) for j in range(AT_ONCE - 1)]
        # of several crossings that nearest to no change
        ends = [F.when(c, F.struct(F.abs(step(j + 0.5) - 1).alias("far"), step(j).alias("lo"), step(j + 1).alias("hi"))) for j, c in enumerate(crossed)]
        left = hold(both.withColumn("e", F.array_min(F.filter(F.array(*ends), lambda e: e.isNotNull()))).select(*keys, "target", F.col("e.lo").alias("lo"), F.col("e.hi").alias("hi")))
    same = F.abs(F.col("before") - F.col("target")) <= 1e-12 * F.abs(F.col("target"))
    met = first.join(left.select(*keys, "lo", "hi"), keys)
    ok = same | F.col("lo").isNotNull()
    alpha = hold(met.select(*keys, "target", "before", F.when(same | F.col("lo").isNull(), F.lit(1.0)).otherwise((F.col("lo") + F.col("hi")) / 2).alias("alpha"), ok.alias("ok")))
    after = measure(attach(coded, alpha.select(*keys, "alpha"), keys), keys, metric, after=moved(F.col("alpha")))
    return alpha.join(after, keys).select(*keys, "target", "before", "alpha", "after", "ok")


def correct(coded: DataFrame, keys: list[str], metric: Metric, x: str = "x", xh: str = "xh", correctable: int = CORRECTABLE_BITS, out: str = "xc") -> DataFrame:
    """Adds out: the reconstruction, its correctable tiers rescaled so that the metric is kept."""
    p = steer(coded, keys, metric, x, xh, correctable).select(*keys, "alpha")
    return attach(coded, p, keys).withColumn(out, F.when(F.col("bits") <= correctable, f32(F.col("alpha") * f64(F.col(xh)))).otherwise(F.col(xh))).drop("alpha")


# Metrics that are no power of a factor, as examples and for the queries.


def _spread(v: np.ndarray) -> tuple[int, float, float]:
    return len(v), float(v.sum()), float((v * v).sum())


def _add(a: tuple, b: tuple) -> tuple:
    return tuple(p + q for p, q in zip(a, b))


def _deviation(s: tuple[int, float, float]) -> float:
    n, s1, s2 = s
    return float(np.sqrt(max(s2 / n - (s1 / n) ** 2, 0.0))) if n else 0.0


def _softened(v: np.ndarray) -> tuple[float]:
    return (float(np.log1p(np.abs(v)).sum()),)


#: The standard deviation, and the sum of log(1 + |x|).
DEVIATION = Metric(_spread, _add, _deviation)
SOFTENED = Metric(_softened, _add, lambda s: s[0])
