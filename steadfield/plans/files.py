"""Queries that write containers as files by many tasks and read the files back."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..functions.numeric import f64
from ..model import CORRECTABLE_BITS
from ..operators import blocked
from ..shared import new_path
from ..sources import chunked, containers
from .base import D, R, query, rnd
from .grids import _DECODED, _V, _sized, blocks_cube, coded_plane


def _restored(files, restore):
    """(vec_id, i, x) of files (field_id, path), each a small grid."""

    def one(path):
        with open(path.removeprefix("file://"), "rb") as h:
            return np.asarray(restore(h.read()), dtype=np.float32).ravel()

    tasks = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return containers.unpack_fields(files.select(F.col("field_id").cast("long").alias("vec_id"), "path").repartition(tasks, "path"), one)


@query("q_tiered_file", f"SELECT vec_id, i, {R(D('xh'), 6)} AS xh FROM ({_DECODED})")
def tiered_file(spark, d):
    """Tiered containers of all vectors as files, and the values that they give back."""
    coded = coded_plane(spark, d).withColumnRenamed("vec_id", "field_id")
    files = chunked.write_tiered(coded, new_path(spark, "tiered"), (8, 8))
    back = _restored(files, lambda data: containers.restore_tiered(containers.read_tiered(data)))
    return back.select("vec_id", "i", rnd(f64(F.col("x")), 6).alias("xh"))


@query("q_blocked_file", f"{_sized(2)} SELECT vec_id, i, {R(D('xc'), 5)} AS xc FROM c")
def blocked_file(spark, d):
    """Blocked containers of all vectors as files, with the factor that restores their energy."""
    coded = blocked.quantize(blocks_cube(spark, d), 2, _V)
    files = chunked.write_blocked(coded, new_path(spark, "blocked"), "vec_id", (4, 4, 4), 2, blocked.energy_factor(coded, _V), CORRECTABLE_BITS)
    return _restored(files, containers.restore_blocked).select("vec_id", "i", rnd(f64(F.col("x")), 5).alias("xc"))
