"""Running restoration: each value of a stream is restored by the sums of its field and span of time up to itself.

State is one row of sums for each field and span, and the values that wait for the watermark, as later ones may still come
before them. A timer stands at the least time that waits; when the watermark passes it, what is due is put in order of (time, i), the
sums run on over it, and the restored values go out, once. When the watermark passes the end of a span, its state goes. So
what is held is bounded by the values of the watermark's delay and by one row for each open span, and results don't hang on how rows
come in batches: they are those of ``restore_running`` on a table, which are windows over the same spans.

Late rows, whose time the watermark has passed, are not restored, as their place in the order is over; with a delay that no row
exceeds there are none. Rows without a field or time are dropped; null values take no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions.numeric import f64
from ..runtime import ship

OUT = "field_id string, span timestamp, ts timestamp, i long, n long, xc double"
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_SUMS = ("n", "m0", "s0", "m1", "s1")


def spanned(rows: DataFrame, span: str, x: str, xh: Column) -> DataFrame:
    """(field_id, span, ts, i, x, xh) of rows (field_id, ts, i, x)."""
    named = rows.select(F.col("field_id").cast("string").alias("field_id"), F.col("ts").cast("timestamp").alias("ts"), F.col("i").cast("long").alias("i"), f64(F.col(x)).alias("x"), f64(xh).alias("xh"))
    return named.filter("field_id is not null and ts is not null and x is not null and xh is not null").withColumn("span", F.date_trunc(span, "ts"))


def restore_running(rows: DataFrame, xh: Column, x: str = "x", span: str = "day") -> DataFrame:
    """The same on a table: (field_id, span, ts, i, n, xc)."""
    w = Window.partitionBy("field_id", "span").orderBy("ts", "i").rowsBetween(Window.unboundedPreceding, 0)
    v, h = F.col("x"), F.col("xh")
    sums = dict(zip(_SUMS, (F.count(F.lit(1)).over(w), F.sum(v).over(w), F.sum(v * v).over(w), F.sum(h).over(w), F.sum(h * h).over(w))))
    run = spanned(rows, span, x, xh).withColumns({f"_{n}": c for n, c in sums.items()})
    n, m0, s0, m1, s1 = (F.col(f"_{c}") for c in _SUMS)
    var0, var1 = F.greatest(s0 / n - (m0 / n) * (m0 / n), F.lit(0.0)), s1 / n - (m1 / n) * (m1 / n)
    a = F.when(var1 > 0, F.sqrt(var0 / F.when(var1 > 0, var1))).otherwise(F.lit(1.0))
    return run.select("field_id", "span", "ts", "i", n.alias("n"), (a * h + (m0 / n - a * (m1 / n))).alias("xc"))


class Restorer(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.sums = handle.getValueState("sums", "n long, m0 double, s0 double, m1 double, s1 double")
        self.waiting = handle.getListState("waiting", "ts long, i long, x double, xh double")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        came = []
        for pdf in rows:
            at = pdf["ts"].astype("datetime64[us]").astype("int64")
            came += [t for t in zip(at.tolist(), pdf["i"].tolist(), pdf["x"].tolist(), pdf["xh"].tolist()) if t[0] >= passed]
        if came:
            self.waiting.appendList(came)
            self._wake(min(t[0] for t in came))
        yield from ()

    def _wake(self, least: int) -> None:
        """A timer just after the time, in whole milliseconds; timers that are there already stay."""
        self.handle.registerTimer(least // 1000 + 1)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        held = [tuple(t) for t in self.waiting.get()] if self.waiting.exists() else []
        due, left = sorted(t for t in held if t[0] < passed), [t for t in held if t[0] >= passed]
        if left:
            self.waiting.put(left)
            self._wake(min(t[0] for t in left))
        elif held:
            self.waiting.clear()
        if not due:
            yield from ()
            return
        before = self.sums.get() if self.sums.exists() else (0, 0.0, 0.0, 0.0, 0.0)
        ts, i = (np.array([t[k] for t in due], dtype=np.int64) for k in (0, 1))
        x, xh = (np.array([t[k] for t in due], dtype=np.float64) for k in (2, 3))
        n = before[0] + np.arange(1, len(due) + 1)
        m0, s0, m1, s1 = (np.cumsum(np.concatenate(([b], v)))[1:] for b, v in zip(before[1:], (x, x * x, xh, xh * xh)))
        self.sums.update((int(n[-1]), float(m0[-1]), float(s0[-1]), float(m1[-1]), float(s1[-1])))
        var0, var1 = np.maximum(s0 / n - (m0 / n) * (m0 / n), 0.0), s1 / n - (m1 / n) * (m1 / n)
        a = np.where(var1 > 0, np.sqrt(var0 / np.where(var1 > 0, var1, 1.0)), 1.0)
        when = pd.Series(ts).astype("datetime64[us]")
        yield pd.DataFrame({"field_id": key[0], "span": pd.Series([key[1]] * len(due)).astype("datetime64[us]"), "ts": when, "i": i, "n": n, "xc": a * xh + (m0 / n - a * (m1 / n))})

    def close(self) -> None:
        return


def restore_stream(stream: DataFrame, xh: Column, late: str, x: str = "x", span: str = "day") -> DataFrame:
    """stream (field_id, ts, i, x) restored as ``restore_running`` does; late: how long a value may come after later ones."""
    spark = stream.sparkSession
    ship(spark)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    rows = spanned(stream, span, x, xh).withWatermark("ts", late)
    return rows.groupBy("field_id", "span").transformWithStateInPandas(statefulProcessor=Restorer(), outputStructType=OUT, outputMode="Append", timeMode="EventTime")
