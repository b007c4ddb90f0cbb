"""Container files written by many tasks, byte for byte those of the single writers; scans against NumPy."""

import os
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from steadfield.model import DEFAULT_TIERS
from steadfield.operators import blocked, codecs, scan, tiers
from steadfield.plans import grids as grids_
from steadfield.plans import registry
from steadfield.sources import chunked, containers


def field(spark, n, name="f", seed=1):
    x = np.cumsum(np.random.default_rng(seed).standard_normal(n)).astype(np.float32)
    return spark.createDataFrame([(name, i, float(v)) for i, v in enumerate(x)], "field_id string, i long, x float").repartition(4), x


def data_of(files):
    return {r.field_id: open(r.path.removeprefix("file://"), "rb").read() for r in files.collect()}


@pytest.fixture
def small(monkeypatch):
    monkeypatch.setattr(chunked, "BLOCK", 3)
    monkeypatch.setattr(chunked, "GROUP", 64)


@pytest.mark.parametrize("codec", ["planes", "widths"])
def test_chunked_files(spark, tmp_path, small, codec):
    (a, x), (b, y) = field(spark, 4096 * 8 + 100), field(spark, 50, "g/ h+", 2)
    f = a.unionByName(b)
    encoded = codecs.encode_chunks(f, 0.25, codec)
    sums = f.groupBy("field_id").agg(F.array(F.sum(F.col("x").cast("double")), F.lit(-2.5)).alias("targets"))
    files = chunked.write_chunked(encoded, f"file://{tmp_path}/c", 0.25, sums)
    rows = sorted(encoded.collect(), key=lambda r: (r.field_id, r.chunk))
    kept, data = {r.field_id: r.targets for r in sums.collect()}, data_of(files)
    for name, v in (("f", x), ("g/ h+", y)):
        own = [r for r in rows if r.field_id == name]
        assert data[name] == containers.write_chunked([r.csize for r in own], [bytes(r.payload) for r in own], 4 * len(v), 0.25, kept[name])
    assert {r.path for r in files.collect()} == {chunked.file_name(f"file://{tmp_path}/c", n) for n in ("f", "g/ h+")}
    back = chunked.read_chunked(files).drop("alpha").select("field_id", "chunk", "osize", "csize", "payload")
    assert sorted(back.collect()) == sorted(encoded.select(*back.columns).collect())
    bare = chunked.write_chunked(encoded, f"file://{tmp_path}/bare")
    assert sorted(chunked.read_chunked(bare, with_bound=False).select(*back.columns).collect()) == sorted(back.collect())


def test_scaled_files(spark, tmp_path, small):
    (a, x), (b, y) = field(spark, 4096 * 4 + 9), field(spark, 700, "g", 4)
    f = a.unionByName(b)
    files = chunked.compress_scaled(f, 0.5, f"file://{tmp_path}/s")
    one = {r.field_id: bytes(r.container) for r in codecs.compress_scaled(f, 0.5).collect()}
    data = data_of(files)
    for name in one:  # the factor is a sum of doubles in another order
        assert data[name][:4] == one[name][:4] and data[name][12:] == one[name][12:]
        assert abs(struct.unpack_from("<d", data[name], 4)[0] / struct.unpack_from("<d", one[name], 4)[0] - 1) < 1e-12
    back = chunked.decompress_scaled(files, 0.5).filter("field_id = 'f'").orderBy("i").toPandas().xc.to_numpy(dtype=np.float64)
    assert abs((back @ back) / (x.astype(np.float64) @ x.astype(np.float64)) - 1) < 1e-6


def test_tiered_files(spark, tmp_path, small):
    rng = np.random.default_rng(5)
    rows = [(n, i, float(v), float(a)) for n, m in (("f", 343), ("g", 343)) for i, (v, a) in enumerate(zip(rng.standard_normal(m), rng.random(m) * (1 if n == "f" else 0.4)))]
    f = spark.createDataFrame(rows, "field_id string, i long, x float, att float").repartition(3)
    coded = tiers.quantize(f.withColumn("tier", tiers.tier_of(F.col("att"))), ["field_id"])
    data = data_of(chunked.write_tiered(coded, f"file://{tmp_path}/t", (7, 7, 7)))
    one = {r.field_id: bytes(r.container) for r in containers.tiered_containers(coded, (7, 7, 7)).collect()}
    assert data == one and len(one) == 2
    assert {len(p.indices) > 0 for p in containers.read_tiered(one["g"]).parts} == {True, False}  # an empty tier, too
    assert len(DEFAULT_TIERS) == len(containers.read_tiered(data["f"]).parts)


def test_blocked_files(spark, tmp_path, small):
    rng = np.random.default_rng(6)
    at = np.indices((5, 4, 6)).reshape(3, -1)
    rows = [(n, *map(int, c), float(v)) for n in "fg" for c, v in zip(at.T, rng.standard_normal(120).cumsum())]
    g = spark.createDataFrame(rows, "field_id string, i0 long, i1 long, i2 long, x float").withColumn("i", (F.col("i0") * 4 + F.col("i1")) * 6 + F.col("i2")).withColumn("att", (F.col("i") % 97 / 97).cast("float"))
    whole = blocked.pad_edges(g, (5, 4, 6), 2, ["field_id"], ["x", "att"]).withColumn("i", F.lit(0).cast("long"))
    coded = blocked.quantize(whole, 2, ["field_id"])
    factor = blocked.energy_factor(coded, ["field_id"])
    factor = spark.createDataFrame(factor.collect(), factor.schema)  # one factor for both writers
    data = data_of(chunked.write_blocked(coded, f"file://{tmp_path}/b", "field_id", (5, 4, 6), 2, factor, 16))
    assert data == {r.field_id: bytes(r.container) for r in containers.blocked_containers(coded, ["field_id"], (5, 4, 6), 2, factor, 16).collect()}
    assert os.listdir(tmp_path / "b") and len(containers.read_blocked(data["f"])[3]) == 3 * 2 * 3


@pytest.mark.parametrize("levels", [1, 2, 3])
def test_prefix_scans(spark, levels):
    rng = np.random.default_rng(7)
    i, size = np.sort(rng.choice(10_000, 700, replace=False)), rng.integers(0, 50, 700)
    rows = [(k, int(a), int(s)) for k in "ab" for a, s in zip(i, size if k == "a" else size[::-1])] + [("c", 5, None)]
    df = spark.createDataFrame(rows, "field_id string, i long, s long").repartition(5)
    got = scan.prefix(df, ["field_id"], "i", F.col("s"), block=16, levels=levels).orderBy("field_id", "i").toPandas()
    for k, s in (("a", size), ("b", size[::-1])):
        assert (got[got.field_id == k].offset.to_numpy() == np.concatenate(([0], np.cumsum(s)[:-1]))).all()
    ranks = scan.rank(df, ["field_id"], "i", block=16, levels=levels).orderBy("field_id", "i").toPandas()
    assert ranks["rank"].tolist() == [*range(700), *range(700), 0]
    assert "offset" in scan.prefix(df.limit(0), ["field_id"], "i", F.col("s")).columns


def grids(spark, folder, n, name="embeddings"):
    rng = np.random.default_rng(8)
    rows = [(3 * k if k else None, [float(v) for v in rng.standard_normal(64) / 8]) for k in range(n)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


@pytest.fixture
def narrow(spark):
    """Arrow batches of 100 rows, which fields of 64 don't fit."""
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
    yield
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_small_tiered_fields_whole(spark, tmp_path, narrow, monkeypatch):
    """Small fields, also one without a name, are packed many in a task, after one shuffle of whole vectors; the files are
    those that are written as pieces."""
    coded = grids_.coded_plane(spark, grids(spark, tmp_path, 30)).withColumnRenamed("vec_id", "field_id")
    packed = containers.tiered_containers(coded, (8, 8))
    plan = plan_of(packed)
    assert "FlatMapGroupsInArrow" not in plan and "Join" not in plan and plan.count("Exchange hashpartitioning") == 1
    files = chunked.write_tiered(coded, f"file://{tmp_path}/whole", (8, 8))
    assert all(os.path.getsize(r.path.removeprefix("file://")) == r.bytes and r.path == chunked.file_name(f"file://{tmp_path}/whole", r.field_id) for r in files.collect())
    back = registry.QUERIES["q_tiered_file"](spark, str(tmp_path))
    assert sorted(back.collect(), key=str) == sorted(registry.QUERIES["q_tiered_codec"](spark, str(tmp_path)).select("vec_id", "i", "xh").collect(), key=str)
    monkeypatch.setattr(chunked, "GROUP", 16)
    named = coded.filter("field_id is not null")
    whole, pieces = data_of(files), data_of(chunked.write_tiered(named, f"file://{tmp_path}/pieces", (8, 8)))
    assert len(whole) == 30 and len(pieces) == 29 and {k: v for k, v in whole.items() if k is not None} == pieces


def test_small_blocked_fields_whole(spark, tmp_path, narrow, monkeypatch):
    """As the tiered ones; their factors come from the same dealt vectors."""
    coded = blocked.quantize(grids_.blocks_cube(spark, grids(spark, tmp_path, 30)).filter("vec_id is not null"), 2, ["vec_id"])
    factor = blocked.energy_factor(coded, ["vec_id"])
    plan = plan_of(containers.blocked_containers(coded, ["vec_id"], (4, 4, 4), 2, factor, 16))
    assert "FlatMapGroupsInArrow" not in plan and plan.count("Exchange hashpartitioning") <= 2  # the vectors, for rows and factors
    factor = spark.createDataFrame(factor.collect(), factor.schema)
    whole = data_of(chunked.write_blocked(coded, f"file://{tmp_path}/whole", "vec_id", (4, 4, 4), 2, factor, 16))
    monkeypatch.setattr(chunked, "GROUP", 16)
    pieces = data_of(chunked.write_blocked(coded, f"file://{tmp_path}/pieces", "vec_id", (4, 4, 4), 2, factor, 16))
    assert len(whole) == 29 and whole == pieces
    with pytest.raises(Exception, match="whole blocks"):
        containers.blocked_containers(coded.filter("vec_id > 3 or i > 0"), ["vec_id"], (4, 4, 4), 2, factor, 16).collect()
