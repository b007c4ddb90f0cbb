"""Invariants of a stream by tumbling windows of event time, and their restoration batch by batch. An extension: a
stream needs what a table does, with a watermark to bound the state."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import correct
from ..operators import invariants as inv


def event_time(ts: Column) -> Column:
    """Timestamps without a zone can't carry a watermark."""
    return ts.cast("timestamp")


def window_invariants(events: DataFrame, value: Column, width: str = "1 day", late: str | None = None, keys: list[str] | None = None, ts: str = "ts") -> DataFrame:
    """(start, *keys, n, mass, energy); late bounds how long a window waits, on a stream."""
    rows = events.withColumn("_at", event_time(F.col(ts)))
    if late:
        rows = rows.withWatermark("_at", late)
    grouped = rows.groupBy(F.window("_at", width), *(keys or [])).agg(F.count(F.lit(1)).alias("n"), inv.mass(value).alias("mass"), inv.energy(value).alias("energy"))
    return grouped.select(F.col("window.start").alias("start"), *(keys or []), "n", "mass", "energy")


def correct_each_batch(stream: DataFrame, recon: Column, mode: int, sink: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """stream (field_id, i, x): each micro-batch is quantized, restored and handed to sink(rows, batch number)."""

    def one(batch: DataFrame, number: int) -> None:
        sink(correct.conserve(batch.withColumn("xh", recon), mode), number)

    return stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
