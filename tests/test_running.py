"""Running restoration of a stream is that of a table, however rows come in batches."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from steadfield.functions.numeric import floor_quantize
from steadfield.streaming import running

T0 = dt.datetime(2024, 3, 1, 20, 0)
SCHEMA = "field_id string, ts timestamp, i long, x float"


@pytest.mark.parametrize("files", [1, 3])
def test_stream_is_the_table(spark, tmp_path, files):
    rng = random.Random(4)
    rows = [(rng.choice("ab"), T0 + dt.timedelta(seconds=90 * k), k, 280 + rng.gauss(0, 3)) for k in range(300)]
    rows += [("a", T0 + dt.timedelta(seconds=900), 1000 + k, 5.0 * k) for k in range(3)] + [("a", T0, 5000, None)]  # ties of time, a null
    mixed = sorted(rows, key=lambda r: (r[1] - T0).total_seconds() + rng.uniform(0, 1500))  # up to 25 minutes out of order
    end = [("zz", T0 + dt.timedelta(days=9), 9999, 1.0)]
    parts = [mixed[k::9] if files == 1 else mixed[k * 35 : (k + 1) * 35] for k in range(9)] + [end]
    if files == 1:
        parts = [mixed[k * 60 : (k + 1) * 60] for k in range(6)] + [end]
    for k, part in enumerate(parts):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/in/b{k:03d}")
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    xh = floor_quantize(F.col("x"), 2.0)
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    try:
        q = running.restore_stream(stream, xh, "40 minutes").writeStream.format("memory").queryName(f"run{files}").outputMode("append").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
        q.awaitTermination()
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass") if before is None else spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    got = {(r.field_id, r.span, r.ts, r.i): (r.n, r.xc) for r in spark.table(f"run{files}").collect()}
    table = spark.createDataFrame(rows, SCHEMA)
    want = {(r.field_id, r.span, r.ts, r.i): (r.n, r.xc) for r in running.restore_running(table, xh).collect()}
    assert len(want) == 303 and len({k[1] for k in want}) == 2  # over midnight
    assert got.keys() == want.keys()
    assert all(got[k][0] == want[k][0] and abs(got[k][1] - want[k][1]) < 1e-9 for k in want)
