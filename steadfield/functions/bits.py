"""IEEE 754 bit patterns of floating-point columns, there and back, in column expressions alone.

A magnitude is split into its binary exponent, found by a logarithm, and a whole number of 53 or 24 bits, got by scaling
with powers of two in two steps that neither overflow nor round. Zeros tell their sign by their text. NaN has one pattern, the quiet one without a sign.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numeric import f64

#: Fixed values of the two formats: bits of the fraction, bias of the exponent, pattern of NaN.
SINGLE = (23, 127, 0x7FC00000)
DOUBLE = (52, 1023, 0x7FF8000000000000)


def _long(v: int) -> Column:
    return F.lit(v).cast("long")


def _pattern(x: Column, form: tuple[int, int, int]) -> Column:
    """The pattern without its sign of x in 64 bits, which holds every value of either format."""
    fraction, bias, nan = form
    size = F.abs(x)
    # the exponent, or one less close above a power of two: whole is then up to twice as large, and still exact
    exponent = F.greatest(F.floor(F.log2(F.when(size > 0, size)) - 1e-9).cast("long"), _long(1 - bias))
    whole = (size * F.pow(F.lit(2.0), F.lit(fraction - 60) - exponent) * F.lit(2.0**60)).cast("long")
    finite = (exponent + (bias - 1)) * _long(1 << fraction) + F.least(whole, _long(1 << fraction) + F.shiftright(whole, 1))
    infinite = _long((2 * bias + 1) << fraction)
    return F.when(F.isnan(x), _long(nan)).when(size == float("inf"), infinite).when(size == 0, _long(0)).otherwise(finite)


def _negative(x: Column) -> Column:
    return ~F.isnan(x) & ((x < 0) | ((x == 0) & F.startswith(x.cast("string"), F.lit("-"))))


def double_to_bits(x: Column) -> Column:
    """The 64 bits of a double, as a long."""
    x = f64(x)
    return F.when(x.isNotNull(), _pattern(x, DOUBLE) + F.when(_negative(x), _long(-(1 << 63))).otherwise(_long(0)))


def float_to_bits(x: Column) -> Column:
    """The 32 bits of a float, as a long from 0 to 2 ** 32 - 1."""
    x = f64(x)
    return F.when(x.isNotNull(), _pattern(x, SINGLE) + F.when(_negative(x), _long(1 << 31)).otherwise(_long(0)))


def _value(pattern: Column, negative: Column, form: tuple[int, int, int]) -> Column:
    fraction, bias, _ = form
    exponent = F.shiftright(pattern, fraction)
    part = pattern.bitwiseAND(_long((1 << fraction) - 1))
    whole = part + F.when(exponent > 0, _long(1 << fraction)).otherwise(_long(0))
    size = f64(whole) * F.lit(2.0**-40) * F.pow(F.lit(2.0), F.greatest(exponent, _long(1)) - (bias + fraction - 40))
    top = exponent == 2 * bias + 1
    sign = F.when(negative, F.lit(-1.0)).otherwise(F.lit(1.0))
    return F.when(top & (part != 0), F.lit("nan").cast("double")).when(top, sign * F.lit("infinity").cast("double")).otherwise(sign * size)


def bits_to_double(bits: Column) -> Column:
    bits = bits.cast("long")
    return _value(bits.bitwiseAND(_long((1 << 63) - 1)), bits < 0, DOUBLE)


def bits_to_float(bits: Column) -> Column:
    bits = bits.cast("long")
    return _value(bits.bitwiseAND(_long((1 << 31) - 1)), bits >= _long(1 << 31), SINGLE).cast("float")


def order_of(x: Column, width: int) -> Column:
    """A long of so many bits, sign included, that orders as the values do, NaN last, zero with a sign before zero."""
    x = f64(x)
    return F.when(x.isNotNull(), _pattern(x, SINGLE if width == 32 else DOUBLE).bitwiseXOR(F.when(_negative(x), _long(-1)).otherwise(_long(0))))


def of_order(rank: Column, width: int) -> Column:
    """The value of width 32 or 64 that ``order_of`` made the long of."""
    rank = rank.cast("long")
    value = _value(rank.bitwiseXOR(F.shiftright(rank, 63)), rank < 0, SINGLE if width == 32 else DOUBLE)
    return value.cast("float") if width == 32 else value


def about_one(bits: Column, width: int) -> Column:
    """The lossless transform of floats ahead of bit planes: the magnitude counted from that of 1.0, round the ring of
    magnitudes, with the sign as the lowest bit. Width 32 or 64."""
    one, ring = (0x3F800000, (1 << 31) - 1) if width == 32 else (0x3FF0000000000000, (1 << 63) - 1)
    bits = bits.cast("long")
    size = bits.bitwiseAND(_long(ring))
    # the difference is taken within the ring, so it can't overflow
    away = F.when(size >= _long(one), size - _long(one)).otherwise(size + _long(ring - one + 1))
    sign = F.when(bits < 0, _long(1)).otherwise(_long(0)) if width == 64 else F.shiftright(bits, 31)
    return F.shiftleft(away, 1).bitwiseOR(sign)


def from_about_one(words: Column, width: int) -> Column:
    one, ring = (0x3F800000, (1 << 31) - 1) if width == 32 else (0x3FF0000000000000, (1 << 63) - 1)
    words = words.cast("long")
    away = F.shiftrightunsigned(words, 1)
    size = F.when(away <= _long(ring - one), away + _long(one)).otherwise(away - _long(ring - one + 1))
    sign = words.bitwiseAND(_long(1))
    return F.when(sign == 1, size + _long(1 << 31) if width == 32 else size + _long(-(1 << 63))).otherwise(size)
