"""Sums in 32 bits, plain and compensated, beside the 64-bit sum: how much accuracy each keeps."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import ship

#: Values that one sum runs over lie STRIDES apart in i, and within SEGMENT of each other.
STRIDES, SEGMENT = 1024, 1 << 16


def strided_sums(i: np.ndarray, x: np.ndarray) -> tuple[float, float, float]:
    """Of values in order of i: plain and compensated 32-bit sums over the values of each stride, which are then added in
    64 bits, and the 64-bit sum. What i a value has says where it goes, so the layout of the table has no say."""
    stride = i % STRIDES
    by = np.argsort(stride, kind="stable")
    stride, v = stride[by], x[by]
    start = np.flatnonzero(np.concatenate(([True], stride[1:] != stride[:-1])))
    size = np.diff(np.append(start, len(v)))
    plain, s, c = (np.zeros(len(start), dtype=np.float32) for _ in range(3))
    for k in range(int(size.max(initial=0))):  # the k-th value of every stride that has one
        on = np.flatnonzero(size > k)
        step = v[start[on] + k]
        plain[on] += step
        y = step - c[on]
        t = s[on] + y
        c[on], s[on] = (t - s[on]) - y, t
    return float(plain.astype(np.float64).sum()), float(s.astype(np.float64).sum()), float(v.astype(np.float64).sum())


def compensated_sums(field: DataFrame) -> DataFrame:
    """(field_id, plain, kahan, exact): partial sums of each segment of i, added in 64 bits."""
    ship(field.sparkSession)

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by("i")
        sums = strided_sums(t.column("i").to_numpy(), t.column("x").to_numpy())
        return pa.table({"field_id": t.column("field_id")[:1], **{n: [v] for n, v in zip(("plain", "kahan", "exact"), sums)}})

    rows = field.select("field_id", "i", "x", F.floor(F.col("i") / SEGMENT).alias("segment"))
    parts = rows.groupBy("field_id", "segment").applyInArrow(run, "field_id string, plain double, kahan double, exact double")
    return parts.groupBy("field_id").agg(*(F.sum(c).alias(c) for c in ("plain", "kahan", "exact")))
