import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from steadfield.functions import numeric as N
from steadfield.functions import words
from steadfield.operators import codecs

floats = st.lists(st.floats(width=32, allow_nan=True, allow_infinity=True), min_size=1, max_size=300)


def column(spark, values, kind="double"):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i long, x {kind}")


def test_rounding(spark):
    d = column(spark, [2.5, -2.5, 0.5, 1.5, -0.4, 3.49])
    r = d.select(N.half_even(F.col("x")).alias("e"), N.half_away(F.col("x")).alias("a")).collect()
    assert [x.e for x in r] == [2, -2, 0, 2, 0, 3] and [x.a for x in r] == [3, -3, 1, 2, 0, 3]


def test_zigzag_and_negabinary_invert(spark):
    values = [0, -1, 1, -2, 2, 2**22 - 1, -(2**22) + 1]
    r = column(spark, values, "long").select("x", N.zigzag(F.col("x")).alias("z"), N.unzigzag(N.zigzag(F.col("x"))).alias("b")).collect()
    assert [x.b for x in r] == values and [x.z for x in r][:5] == [0, 1, 2, 3, 4]
    rng = np.random.default_rng(1)
    w = [int(x) for x in rng.integers(0, 2**32, 500)]
    r = column(spark, w, "long").select(N.from_negabinary(N.negabinary(F.col("x"))).alias("b")).collect()
    assert [x.b for x in r] == w


def test_bits_needed(spark):
    r = column(spark, [0, 1, 2, 255, 256, 2**32 - 1], "long").select(N.bits_needed(F.col("x")).alias("b")).collect()
    assert [x.b for x in r] == [0, 1, 2, 8, 9, 32]


@pytest.mark.parametrize("bound", [0.3, 0.5, 1e-3])
def test_quantizers_keep_the_bound(spark, bound):
    rng = np.random.default_rng(2)
    x = np.concatenate((rng.standard_normal(500) * 10 ** rng.uniform(-6, 9, 500), [0.0, math.nan, math.inf, -math.inf])).astype(np.float32)
    d = column(spark, [float(v) for v in x], "float")
    a, p = N.AbsQuantizer(bound), N.PowerQuantizer(bound)
    r = d.select("x", a.recon(F.col("x")).alias("a"), p.recon(F.col("x")).alias("p"), a.code(F.col("x")).alias("ac"), p.code(F.col("x")).alias("pc")).collect()
    for row in r:
        if math.isfinite(row.x):
            assert abs(np.float32(row.a) - np.float32(row.x)) <= np.float32(bound) and abs(row.p - row.x) <= bound
        else:
            assert row.ac is None and row.pc is None and (row.a == row.x or math.isnan(row.x))


@settings(max_examples=60, deadline=None)
@given(floats, st.sampled_from([0.5, 0.3, 1e-3, 8.0]))
def test_plane_chunks_round_trip(values, bound):
    x = np.array(values, dtype=np.float32)
    back = codecs.decode_planes(codecs.encode_planes(x, bound), len(x), bound)
    ok = np.isfinite(x)
    with np.errstate(all="ignore"):
        assert (np.abs(back[ok] - x[ok]) <= np.float32(bound)).all()
    assert (back[~ok].view(np.uint32) == x[~ok].view(np.uint32)).all()


@settings(max_examples=60, deadline=None)
@given(floats, st.sampled_from([0.5, 0.3, 1e-3, 8.0]))
def test_width_chunks_round_trip(values, bound):
    x = np.array(values, dtype=np.float32)
    back = codecs.decode_widths(codecs.encode_widths(x, bound), len(x), bound)
    ok = np.isfinite(x)
    with np.errstate(all="ignore"):
        assert (np.abs(back[ok].astype(np.float64) - x[ok]) <= bound).all()
    assert (np.isnan(back) == np.isnan(x)).all() and (back[np.isinf(x)] == x[np.isinf(x)]).all()


def test_width_chunks_of_64_bits():
    x = np.random.default_rng(3).standard_normal(2048) * 100
    back = codecs.decode_widths(codecs.encode_widths(x, 0.5, 64), len(x), 0.5, 64)
    assert np.abs(back - x).max() <= 0.5 and len(codecs.encode_widths(x, 0.5, 64)) < x.nbytes


def test_chunks_without_gain_are_kept_whole():
    x = np.random.default_rng(4).integers(0, 2**32, 4096, dtype=np.uint64).astype(np.uint32).view(np.float32)
    x = np.where(np.isfinite(x), x, np.float32(1e30))
    assert codecs.encode_planes(x, 1e-30) == x.tobytes()
    assert len(codecs.encode_planes(np.zeros(4096, dtype=np.float32), 0.1)) == 2


@settings(max_examples=80, deadline=None)
@given(st.binary(max_size=3000))
def test_zero_bytes(data):
    body = words.drop_zeros(data)
    assert body is None or words.restore_zeros(body) == data


@given(st.lists(st.integers(0, 15), max_size=50), st.sampled_from([4, 5, 7, 8, 16, 32]))
def test_packing(codes, bits):
    c = np.array(codes, dtype=np.uint32)
    assert words.unpack(words.pack(c, bits), bits, len(c)).tolist() == codes
    if bits in (4, 8, 16, 32):
        packed = words.pack_fast(c, bits)
        assert words.unpack_fast(packed, bits, len(c)).tolist() == codes and len(packed) == -(-len(c) * bits // 8)


def test_bit_planes_and_signs():
    w = np.random.default_rng(5).integers(0, 2**32, 100, dtype=np.uint64).astype(np.uint32)
    assert (words.restore_bits(words.transpose_bits(w)) == w).all()
    assert (words.transpose_bits(np.full(32, 0x80000000, dtype=np.uint32)) == [0xFFFFFFFF] + [0] * 31).all()
    assert (words.restore_sign(words.rotate_sign(w)) == w).all()
    assert words.rotate_sign(np.array([1.0], dtype=np.float32).view(np.uint32))[0] == 0
