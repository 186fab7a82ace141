"""Codes of bit strings, whole-number sample arithmetic and prediction formulas as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def bits(value: Column, width: int) -> Column:
    """A whole number as a string of so many bits."""
    return F.lpad(F.bin(value.cast("bigint")), width, "0")


def ue(text: Column, at: Column | int) -> Column:
    """struct<value, next> of the Exp-Golomb number that begins at a place (from 1) of a bit string; null beyond its end or 32 zeros."""
    rest = F.substring(text, F.lit(at) if isinstance(at, int) else at, F.lit(1 << 20))
    zeros = F.instr(rest, "1") - 1
    body = F.substring(rest, zeros + 1, zeros + 1)
    ok = (zeros >= 0) & (zeros <= 32) & (F.length(body) == zeros + 1)
    return F.when(ok, F.struct((F.conv(body, 2, 10).cast("bigint") - 1).alias("value"), ((F.lit(at) if isinstance(at, int) else at) + 2 * zeros + 1).alias("next")))


def se(value: Column) -> Column:
    """The signed number that an Exp-Golomb value stands for: 0, 1, -1, 2, -2, ..."""
    return F.when(value % 2 == 1, F.floor((value + 1) / 2)).otherwise(-F.floor(value / 2)).cast("bigint")


def saturate16(x: Column) -> Column:
    return F.greatest(F.least(x, F.lit(32767)), F.lit(-32768))


def round_shift(x: Column, shift: int) -> Column:
    """x / 2^shift, halves away from zero."""
    half = 1 << (shift - 1)
    return F.when(x < 0, -F.shiftright(-x + half, shift)).otherwise(F.shiftright(x + half, shift))


def six_tap(a: Column, b: Column, c: Column, d: Column, e: Column, f: Column) -> Column:
    """The half-sample between c and d."""
    return F.greatest(F.least(F.shiftright(a - 5 * b + 20 * c + 20 * d - 5 * e + f + 16, 5), F.lit(255)), F.lit(0))


def median3(a: Column, b: Column, c: Column) -> Column:
    return a + b + c - F.greatest(a, b, c) - F.least(a, b, c)


def slice_group(kind: Column, x: Column, y: Column, width: Column, groups: Column) -> Column:
    """Group of a macroblock: 0 interleaved in runs of 3, 1 dispersed, others by halves of the raster scan."""
    i = y * width + x
    spread = (i % width + F.floor(F.floor(i / width) * groups / 2)) % groups
    return F.when(kind == 0, F.floor(i / 3) % groups).when(kind == 1, spread).otherwise(F.when(i < width * 4, 0).otherwise(1)).cast("int")


def cosine(k: int, n: int) -> int:
    """The k-th row of the 8-point inverse cosine transform at n, in 13-bit fixed point."""
    return round(8192 * (math.sqrt(0.125) if k == 0 else 0.5 * math.cos((2 * n + 1) * k * math.pi / 16)))
