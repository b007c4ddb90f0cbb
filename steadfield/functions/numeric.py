"""Column expressions for 32-bit arithmetic, rounding, error-bounded quantizers and their codes.

Every step that a 32-bit implementation rounds is rounded here: Spark divides floats in 64 bits, and a 64-bit quotient
rounded to 32 bits is the 32-bit quotient.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

MASK32 = 0xFFFFFFFF
NEGABINARY = 0xAAAAAAAA


def f32(c: Column) -> Column:
    return c.cast("float")


def f64(c: Column) -> Column:
    return c.cast("double")


def div32(a: Column, b: Column) -> Column:
    return f32(f64(a) / f64(b))


def half_even(c: Column) -> Column:
    """Rounds to the nearest integer, halves to the even one."""
    return F.rint(f64(c))


def half_away(c: Column) -> Column:
    """Rounds to the nearest integer, halves away from zero."""
    return f64(F.signum(f64(c))) * f64(F.floor(F.abs(f64(c)) + 0.5))


def clamp(c: Column, lo: float | Column, hi: float | Column) -> Column:
    as_col = lambda v: v if isinstance(v, Column) else F.lit(float(v))
    return F.greatest(as_col(lo), F.least(as_col(hi), c))


def floor_quantize(x: Column, q: float | Column) -> Column:
    """The largest multiple of q that is not above x."""
    q = q if isinstance(q, Column) else F.lit(float(q))
    return f64(F.floor(f64(x) / q)) * q


def uniform_quantize(x: Column, q: float | Column) -> Column:
    """The multiple of q nearest to x, halves to the even multiple."""
    q = q if isinstance(q, Column) else F.lit(float(q))
    return half_even(f64(x) / q) * q


def zigzag(n: Column) -> Column:
    """Signed to unsigned: 0, -1, 1, -2 ... become 0, 1, 2, 3 ..."""
    n = n.cast("int")
    return F.shiftleft(n, 1).bitwiseXOR(F.shiftright(n, 31))


def unzigzag(u: Column) -> Column:
    u = u.cast("int")
    return F.shiftrightunsigned(u, 1).bitwiseXOR(-(u.bitwiseAND(F.lit(1))))


def negabinary(d: Column) -> Column:
    """A 32-bit difference (held in a bigint) in base -2."""
    s = F.lit(NEGABINARY).cast("long")
    return (d + s).bitwiseAND(F.lit(MASK32).cast("long")).bitwiseXOR(s)


def from_negabinary(n: Column) -> Column:
    s = F.lit(NEGABINARY).cast("long")
    return (n.bitwiseXOR(s) - s).bitwiseAND(F.lit(MASK32).cast("long"))


def bits_needed(n: Column) -> Column:
    """The number of binary digits of an unsigned number; 0 for 0."""
    return F.when(n == 0, F.lit(0)).otherwise(F.length(F.bin(n.cast("long")))).cast("int")


class AbsQuantizer:
    """Bins of width twice the bound in 32-bit arithmetic. A value is kept as it is where its bin does not fit 22 bits,
    it is not finite or at the threshold or beyond, or rounding would break the bound."""

    MAX_BIN = 1 << 22

    def __init__(self, bound: float, threshold: float = math.inf) -> None:
        self.bound = np.float32(bound)
        self.width, self.inverse = np.float32(2) * self.bound, np.float32(0.5) / self.bound
        self.threshold = np.float32(threshold)

    def bin(self, x: Column) -> Column:
        return half_away(f32(x) * F.lit(float(self.inverse)).cast("float"))

    def lossless(self, x: Column) -> Column:
        b = self.bin(x)
        off = F.abs(f32(f64(x)) - f32(b) * F.lit(float(self.width)).cast("float"))
        return F.isnan(x) | (F.abs(b) >= self.MAX_BIN) | (F.abs(x) >= F.lit(float(self.threshold)).cast("float")) | (off > F.lit(float(self.bound)).cast("float"))

    def recon(self, x: Column) -> Column:
        return F.when(self.lossless(x), f32(x)).otherwise(f32(self.bin(x)) * F.lit(float(self.width)).cast("float"))

    def code(self, x: Column) -> Column:
        """The code of a quantized value; null where the value is kept as it is."""
        return F.when(~self.lossless(x), zigzag(self.bin(x)))


class PowerQuantizer:
    """Bins whose width is twice the largest power of two that is not above the bound. Values from 2**24 times that power
    on are kept as they are (2**53 for 64-bit data)."""

    def __init__(self, bound: float, mantissa_bits: int = 23) -> None:
        self.power = 2.0 ** (math.frexp(bound)[1] - 1)
        self.limit = self.power * 2.0 ** (mantissa_bits + 1)

    def _bin(self, x: Column) -> Column:
        return f64(F.floor(F.abs(f64(x)) / F.lit(2 * self.power) + 0.5))

    def lossless(self, x: Column) -> Column:
        return F.isnan(x) | (F.abs(f64(x)) >= F.lit(self.limit))

    def recon(self, x: Column) -> Column:
        kept = F.signum(f64(x)) * self._bin(x) * F.lit(2 * self.power)
        return F.when(self.lossless(x), f64(x)).otherwise(kept)

    def code(self, x: Column) -> Column:
        q = self._bin(x).cast("long")
        return F.when(self.lossless(x), F.lit(None).cast("long")).when(q == 0, F.lit(0).cast("long")).when(f64(x) >= 0, 2 * q).otherwise(2 * q - 1)


def equilibrium(rho: Column, ux: Column, uy: Column, cx: float, cy: float, weight: float) -> Column:
    """The second-order equilibrium of a lattice direction."""
    cu = F.lit(3.0) * (ux * cx + uy * cy)
    return rho * weight * (1 + cu + 0.5 * cu * cu - 1.5 * (ux * ux + uy * uy))


def parabola(y: Column, peak: float, width: float) -> Column:
    """A parabolic profile that is 0 at y = 0 and y = width and has the given peak between."""
    return F.lit(4.0 * peak) * y * (width - y) / (width * width)
