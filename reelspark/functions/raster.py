"""Colour conversion, packing and index maps as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clamp(x: Column) -> Column:
    return F.greatest(F.least(x, F.lit(255)), F.lit(0))


def rgb565(r: Column, g: Column, b: Column) -> Column:
    return F.shiftright(r, 3) * 2048 + F.shiftright(g, 2) * 32 + F.shiftright(b, 3)


def nearest(d: Column, source: Column, target: Column) -> Column:
    """The source index of target index d: centre sampling, ((2d + 1) source) div (2 target)."""
    return F.floor((2 * d + 1) * source / (2 * target)).cast("int")


def yuv_to_rgb(y: Column, u: Column, v: Column) -> tuple[Column, Column, Column]:
    """BT.601 limited range in eight-bit fixed point."""
    c, d, e = 298 * (y - 16), u - 128, v - 128
    fixed = lambda x: clamp(F.shiftright(x, 8))
    return fixed(c + 409 * e + 128), fixed(c - 100 * d - 208 * e + 128), fixed(c + 516 * d + 128)


def ycbcr_to_rgb(y: Column, cb: Column, cr: Column) -> tuple[Column, Column, Column]:
    """Full range as in still images; cb and cr are centred on 128."""
    b, r = cb - 128, cr - 128
    return clamp(y + F.shiftright(359 * r, 8)), clamp(y - F.shiftright(88 * b + 183 * r, 8)), clamp(y + F.shiftright(454 * b, 8))


def detile_offset(x: Column, y: Column, column_bytes: Column) -> Column:
    """Where byte x of line y lies in 128-byte-wide columns."""
    return F.floor(x / 128).cast("bigint") * column_bytes + y * 128 + x % 128


def unpack10(word: Column, k: Column) -> Column:
    """Sample k (0 to 2) of a word of three 10-bit samples, in the high bits of 16."""
    return F.floor(word / F.pow(F.lit(2), 10 * k)).cast("bigint").bitwiseAND(1023) * 64


def paeth(a: Column, b: Column, c: Column) -> Column:
    p = a + b - c
    pa, pb, pc = F.abs(p - a), F.abs(p - b), F.abs(p - c)
    return F.when((pa <= pb) & (pa <= pc), a).when(pb <= pc, b).otherwise(c)


def expand_bits(value: Column, depth: Column) -> Column:
    """A grey sample of 1, 2, 4, 8 or 16 bits in 8 bits."""
    return F.when(depth == 1, value * 255).when(depth == 2, value * 85).when(depth == 4, value * 17).when(depth == 16, F.shiftright(value, 8)).otherwise(value)


def interlace_row(k: Column, height: Column) -> Column:
    """The line on which stored line k of an interlaced GIF frame lies (passes of every 8th, 8th from 4, 4th from 2, 2nd from 1)."""
    n1, n2, n3 = F.floor((height + 7) / 8), F.floor((height + 3) / 8), F.floor((height + 1) / 4)
    line = F.when(k < n1, k * 8).when(k < n1 + n2, (k - n1) * 8 + 4).when(k < n1 + n2 + n3, (k - n1 - n2) * 4 + 2).otherwise((k - n1 - n2 - n3) * 2 + 1)
    return line.cast("int")


def plane_sample(content: Column, at: Column) -> Column:
    """The byte at a place of a planar buffer; null beyond its end."""
    h = F.hex(F.substring(content, at.cast("int") + 1, F.lit(1)))
    return F.when((at >= 0) & (h != ""), F.conv(h, 16, 10).cast("int"))


def i420(content: Column, width: Column, height: Column, x: Column, y: Column) -> tuple[Column, Column, Column]:
    """Luma and both chroma samples of a pixel of a 4:2:0 buffer: a full plane, then two of half the width and height, rounded up."""
    half = F.floor((width + 1) / 2)
    chroma = width * height + F.floor(y / 2) * half + F.floor(x / 2)
    return plane_sample(content, y * width + x), plane_sample(content, chroma), plane_sample(content, chroma + half * F.floor((height + 1) / 2))
