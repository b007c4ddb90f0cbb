"""Principal-axis rotation of the vectors in each block."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import f32, f64
from ..runtime import ship
from .blocked import second_moments

_MOMENTS = ["uu", "uv", "uw", "vv", "vw", "ww"]
_SCHEMA = ", ".join(f"r{i}{j} double" for i in range(3) for j in range(3)) + ", q0 double, q1 double, q2 double, q3 double"


def proper_axes(moments: np.ndarray) -> np.ndarray:
    """Rotations (n, 3, 3) whose rows are the principal axes, largest first; each with determinant 1 and its first two
    axes turned so that their largest entry is positive."""
    _, vectors = np.linalg.eigh(moments)
    r = np.swapaxes(vectors, 1, 2)[:, ::-1, :].copy()
    largest = np.take_along_axis(r, np.argmax(np.abs(r), axis=2)[:, :, None], axis=2)
    r *= np.where(largest < 0, -1.0, 1.0)
    r[:, 2, :] *= np.where(np.linalg.det(r) < 0, -1.0, 1.0)[:, None]
    return r


def quaternions(r: np.ndarray) -> np.ndarray:
    """Unit quaternions (w, x, y, z) with w >= 0: the eigenvector of the largest eigenvalue of the symmetric 4x4 matrix
    of a rotation."""
    xx, xy, xz, yx, yy, yz, zx, zy, zz = r.reshape(-1, 9).T
    k = np.stack([
        np.stack([xx + yy + zz, zy - yz, xz - zx, yx - xy], -1), np.stack([zy - yz, xx - yy - zz, yx + xy, zx + xz], -1),
        np.stack([xz - zx, yx + xy, yy - xx - zz, zy + yz], -1), np.stack([yx - xy, zx + xz, zy + yz, zz - xx - yy], -1),
    ], -2)
    q = np.linalg.eigh(k)[1][:, :, -1]
    return q * np.where(q[:, :1] < 0, -1.0, 1.0)


def block_axes(vectors: DataFrame, keys: list[str]) -> DataFrame:
    """(*keys, r00..r22, q0..q3): nine sums for each block, then eigenvectors in Arrow batches of blocks."""
    ship(vectors.sparkSession)
    m = second_moments(vectors, keys)
    key_fields = [f for f in m.schema.fields if f.name in keys]
    from pyspark.sql.types import StructType

    out = StructType(key_fields + StructType.fromDDL(_SCHEMA).fields)

    def run(batches):
        for b in batches:
            uu, uv, uw, vv, vw, ww = (b.column(c).to_numpy(zero_copy_only=False) for c in _MOMENTS)
            r = proper_axes(np.stack([np.stack([uu, uv, uw], -1), np.stack([uv, vv, vw], -1), np.stack([uw, vw, ww], -1)], -2))
            q = quaternions(r)
            made = [pa.array(r[:, i, j]) for i in range(3) for j in range(3)] + [pa.array(q[:, i]) for i in range(4)]
            yield pa.RecordBatch.from_arrays([b.column(k) for k in keys] + made, names=[f.name for f in out.fields])

    return m.select(*keys, *_MOMENTS).mapInArrow(run, out)


def rotate(vectors: DataFrame, axes: DataFrame, keys: list[str], inverse: bool = False, names: tuple[str, str, str] = ("u", "v", "w")) -> DataFrame:
    """Replaces the three components by their rotation, or back."""
    joined = vectors.join(axes, keys)
    c = [f64(F.col(n)) for n in names]
    entry = lambda i, j: F.col(f"r{j}{i}" if inverse else f"r{i}{j}")
    turned: list[Column] = [f32(entry(i, 0) * c[0] + entry(i, 1) * c[1] + entry(i, 2) * c[2]) for i in range(3)]
    return joined.withColumns({f"_{n}": t for n, t in zip(names, turned)}).drop(*names).withColumnsRenamed({f"_{n}": n for n in names}).select(*vectors.columns)
