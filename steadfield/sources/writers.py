"""Writing decoded fields as headerless 32-bit files.

A field of any length is a folder of parts, each a run of its values in order of i, named by the first of them: put one
after another in order of name they are the file that a single writer would give. Rows are dealt by range, so no task
holds a field, and a part goes out as its rows come. Each attempt of a task writes under a name of its own, and only the
rows of the attempt that counts name files.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from urllib.parse import quote

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import ship


def file_system(uri: str):
    """(file system, path) of an address that all tasks share."""
    from pyarrow import fs

    return fs.FileSystem.from_uri("s3://" + uri.removeprefix("s3a://") if uri.startswith("s3a://") else uri)


def write_raw(field: DataFrame, folder: str, x: str = "x") -> DataFrame:
    """(field_id, first, n, path) of the parts of each field of (field_id, i, x). Null values are written as NaN."""
    ship(field.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        target, base = file_system(folder)
        out, now = None, None
        done: list[dict] = []
        for batch in batches:
            ids, i, v = batch.column(0).to_pylist(), batch.column(1).to_numpy(), batch.column(2).to_numpy(zero_copy_only=False).astype("<f4")
            cuts = [0, *(k for k in range(1, len(ids)) if ids[k] != ids[k - 1]), len(ids)]
            for a, z in zip(cuts[:-1], cuts[1:]):
                if a < z and (now is None or now["field_id"] != ids[a]):
                    if out is not None:
                        out.close()
                    place = f"{quote(str(ids[a]), safe='')}/{i[a]:020d}-{uuid.uuid4().hex[:8]}.f32"
                    target.create_dir(f"{base}/{place.partition('/')[0]}", recursive=True)
                    out = target.open_output_stream(f"{base}/{place}")
                    now = {"field_id": ids[a], "first": int(i[a]), "n": 0, "path": f"{folder}/{place}"}
                    done.append(now)
                if a < z:
                    out.write(np.ascontiguousarray(v[a:z]).tobytes())
                    now["n"] += z - a
        if out is not None:
            out.close()
        yield pa.RecordBatch.from_pylist(done, schema=pa.schema([("field_id", pa.string()), ("first", pa.int64()), ("n", pa.int64()), ("path", pa.string())]))

    rows = field.select(F.col("field_id").cast("string").alias("field_id"), F.col("i").cast("long").alias("i"), F.col(x).cast("float").alias("x"))
    return rows.repartitionByRange("field_id", "i").sortWithinPartitions("field_id", "i").mapInArrow(run, "field_id string, first long, n long, path string")


def read_parts(parts: DataFrame) -> DataFrame:
    """(field_id, i, x) from the rows of ``write_raw``; i counts the values of a field from 0."""
    from pyspark.sql import Window

    ship(parts.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                source, path = file_system(r["path"])
                with source.open_input_stream(path) as f:
                    v = np.frombuffer(f.read(), "<f4")
                yield pa.RecordBatch.from_arrays([pa.array([r["field_id"]] * len(v), pa.string()), pa.array(r["at"] + np.arange(len(v)), pa.int64()), pa.array(v, pa.float32())], names=["field_id", "i", "x"])

    order = Window.partitionBy("field_id").orderBy("first")  # one row for each part
    placed = parts.withColumn("at", F.sum("n").over(order) - F.col("n")).select("field_id", "path", "at")
    return placed.mapInArrow(run, "field_id string, i long, x float")
