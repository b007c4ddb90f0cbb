"""Files read by ranges of bytes against NumPy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from steadfield.sources import ranged, readers


def test_raw_ranges(spark, tmp_path):
    rng = np.random.default_rng(1)
    x, y = rng.standard_normal(100_003).astype("<f4"), rng.standard_normal(5_000)
    (tmp_path / "deep").mkdir()
    x.tofile(tmp_path / "a.f32")
    y.astype("<f4").tofile(tmp_path / "deep" / "b.f32")
    (tmp_path / "empty.f32").write_bytes(b"")
    df = ranged.scan(spark, str(tmp_path), pattern="*.f32", range_bytes=40_000)
    assert df.rdd.getNumPartitions() == 11 + 1  # none for the empty file
    got = {k: v.sort_values("i") for k, v in df.toPandas().groupby("field_id")}
    a, b = (f"file://{tmp_path}/{n}" for n in ("a.f32", "deep/b.f32"))
    assert set(got) == {a, b} and (got[a].i.to_numpy() == np.arange(len(x))).all() and (got[a].x.to_numpy() == x).all()
    assert (got[b].x.to_numpy() == y.astype(np.float32)).all()
    y.astype(">f8").tofile(tmp_path / "c.f64")
    wide = ranged.scan(spark, f"file://{tmp_path}/c.f64", dtype=">f8", range_bytes=999)
    assert wide.schema["x"].dataType.typeName() == "double" and (wide.orderBy("i").toPandas().x.to_numpy() == y).all()
    assert readers.read_raw(spark, str(tmp_path / "deep")).count() == 5_000


def test_conditions_leave_out_ranges(spark, tmp_path):
    x = np.arange(50_000, dtype="<f4")
    for name in "ab":
        x.tofile(tmp_path / f"{name}.f32")
    df = ranged.scan(spark, str(tmp_path), range_bytes=4_000)
    assert df.rdd.getNumPartitions() == 100
    part = df.filter((F.col("i") >= 4_500) & (F.col("i") < 6_001) & (F.col("field_id") == f"file://{tmp_path}/b.f32"))
    assert [r.i for r in part.orderBy("i").collect()] == list(range(4_500, 6_001))
    assert part.rdd.getNumPartitions() == 3
    assert df.filter("i = 49999").count() == 2 and df.filter("i > 49999").count() == 0


@pytest.mark.parametrize("dtype", ["<f4", ">f4", "<f8"])
def test_npy(spark, tmp_path, dtype):
    x = np.random.default_rng(2).standard_normal((7, 30, 11)).astype(dtype)
    np.save(tmp_path / "x.npy", x)
    assert ranged.list_files(str(tmp_path), form="npy")[0].shape == (7, 30, 11)
    got = ranged.scan(spark, str(tmp_path), "npy", range_bytes=1_000).orderBy("i").toPandas()
    assert (got.x.to_numpy() == x.ravel()).all() and len(got) == x.size
    assert (readers.read_npy(spark, str(tmp_path)).orderBy("i").toPandas().x.to_numpy() == x.ravel().astype(np.float32)).all()


def test_what_is_refused(spark, tmp_path):
    (tmp_path / "bad.f32").write_bytes(b"12345")
    np.save(tmp_path / "f.npy", np.asfortranarray(np.ones((3, 4), dtype=np.float32)))
    np.save(tmp_path / "i.npy", np.ones(4, dtype=np.int32))
    np.save(tmp_path / "s.npy", np.ones(400))
    (tmp_path / "s.npy").write_bytes((tmp_path / "s.npy").read_bytes()[:-8])
    for form, name, words in (("raw", "bad.f32", "whole number"), ("npy", "f.npy", "Fortran"), ("npy", "i.npy", "int32"), ("npy", "s.npy", "short")):
        with pytest.raises(ValueError, match=words):
            ranged.list_files(str(tmp_path), name, form)
    with pytest.raises(FileNotFoundError):
        ranged.list_files(str(tmp_path / "none"))
    (tmp_path / "e").mkdir()
    assert ranged.scan(spark, str(tmp_path / "e")).count() == 0
