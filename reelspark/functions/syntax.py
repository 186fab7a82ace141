"""Small predicates, fields and geometry of coded video and images as column expressions."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType

from reelspark.functions.arrays import matrix, numbers


def bound(value: Column, use) -> Column:
    """use(value), with the value computed once however often it is used, inside lambdas too."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def is_wide_gamut(present: Column, primaries: Column) -> Column:
    return present & (primaries == 9)


def is_high_bit_depth(luma: Column, chroma: Column) -> Column:
    return (luma > 8) | (chroma > 8)


def is_shown_slice(nal_type: Column) -> Column:
    """Whether an H.265 NAL is a slice that the tools list: intra random access points and trailing pictures."""
    return nal_type.between(16, 21) | nal_type.isin(0, 1)


def hevc_level(level_idc: Column) -> Column:
    """struct<major, minor> of a general level, which counts thirtieths."""
    return F.struct(F.floor(level_idc / 30).cast("int").alias("major"), F.floor(level_idc % 30 / 3).cast("int").alias("minor"))


def total_div(a: Column, b: Column) -> Column:
    """a div b; 0 for a divisor of 0."""
    return F.when(b == 0, F.lit(0)).otherwise(F.floor(a / F.when(b == 0, 1).otherwise(b))).cast("bigint")


def total_rem(a: Column, b: Column) -> Column:
    return F.when(b == 0, F.lit(0)).otherwise(a % F.when(b == 0, 1).otherwise(b)).cast("bigint")


def token_fields(word: Column) -> Column:
    """struct<token_bits, trailing_ones, total_coeff, bits, info>: a coefficient token's word, and the two fields of the other code words."""
    part = lambda at, width: F.shiftright(word, at).bitwiseAND((1 << width) - 1).cast("int")
    return F.struct(part(0, 5).alias("token_bits"), part(5, 6).alias("trailing_ones"), part(11, 5).alias("total_coeff"), part(0, 4).alias("bits"), part(4, 4).alias("info"))


def h264_kinds(nal_type: Column, slice_type: Column, mb_type: Column, status: Column) -> Column:
    """What H.264 numbers say: IDR units, P and I slices, intra and PCM macroblocks, and a picture's status (0 unused, 1 missing, 2 short, 3 long)."""
    return F.struct(
        (nal_type == 5).alias("idr"), slice_type.isin(0, 5).alias("p_slice"), slice_type.isin(2, 7).alias("i_slice"), (mb_type > 5).alias("intra"), (mb_type == 31).alias("pcm"),
        (status != 0).alias("reference"), (status > 1).alias("existing"), status.isin(1, 2).alias("short_term"), (status == 3).alias("long_term"),
    )


def probe_point(k: Column, ctb: int, last_column: Column, width: Column, height: Column) -> Column:
    """struct<x, y>: where luma is probed in CTB row k: 20 pixels into the last CTB column, x a multiple of 4, inside the picture."""
    x = F.least(last_column * ctb + 20, width - 4)
    return F.struct((x - x % 4).alias("x"), F.least(k * ctb, height - 1).alias("y"))


def surface(width: Column, height: Column, bit_depth: Column) -> Column:
    """Geometry of a picture in columns of 128 bytes: padded size, columns, bytes of columns and planes, strides in units of 64 bytes."""
    per = F.when(bit_depth >= 10, 96).otherwise(128)
    columns, tall = F.ceil(width / per), F.ceil(height / 8) * 8
    return F.struct(
        per.alias("column_pixels"), (columns * per).alias("padded_width"), tall.alias("padded_height"), columns.alias("columns"), (tall * 128).alias("luma_column_bytes"),
        (columns * tall * 128).alias("luma_plane_bytes"), (tall * 64).alias("chroma_column_bytes"), (columns * tall * 64).alias("chroma_plane_bytes"), (tall * 2).alias("luma_stride"), tall.alias("chroma_stride"),
    )


def crop(width_mbs: Column, height_mbs: Column, cropped: Column, left: Column, right: Column, top: Column, bottom: Column) -> Column:
    """struct<width, height, left, top> of the shown part of a picture of macroblocks; crop offsets are in units of two samples."""
    cut = lambda v: F.when(cropped, v).otherwise(F.lit(0)).cast("bigint")
    return F.struct((width_mbs * 16 - cut(2 * (left + right))).alias("width"), (height_mbs * 16 - cut(2 * (top + bottom))).alias("height"), cut(2 * left).alias("left"), cut(2 * top).alias("top"))


def neighbours(mb: Column, width: Column) -> Column:
    """struct<a, b, c, d>: the macroblocks left, above, above right and above left; null outside the picture."""
    inner, up, last = mb % width != 0, mb >= width, mb % width == width - 1
    return F.struct(F.when(inner, mb - 1).alias("a"), F.when(up, mb - width).alias("b"), F.when(up & ~last, mb - width + 1).alias("c"), F.when(up & inner, mb - width - 1).alias("d"))


def raster_fits(width: Column, height: Column) -> Column:
    """Whether a raster of two bytes a pixel has a size below 2^32."""
    return width.cast("bigint") * height * 2 < 1 << 32


def _context_words(init_values: pa.Array, qp: pa.Array) -> pa.Array:
    sizes = pc.fill_null(pc.list_value_length(init_values), 0).to_numpy(zero_copy_only=False)
    most = int(sizes.max(initial=0) + 2) // 4 * 4
    v, there = matrix(init_values, most)
    q, known = numbers(qp)
    q = np.clip(np.where(known, q, 51), 0, 51)[:, None]
    first = np.where(there, np.clip((((v >> 4) * 5 - 45) * q >> 4) + (v & 15) * 8 - 16, 1, 126), 126)
    packed = np.where(first > 63, (first - 64) * 2 + 1, (63 - first) * 2)
    packed[np.arange(most) >= sizes[:, None]] = 0
    words = (packed.reshape(len(v), -1, 4) << np.array([0, 8, 16, 24])).sum(axis=2)
    mine = np.arange(most // 4) < ((sizes + 2) // 4)[:, None]
    ends = np.concatenate([[0], np.cumsum(mine.sum(axis=1))])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(words[mine], pa.int64()), mask=init_values.is_null())


_CONTEXT_WORDS = F.arrow_udf(_context_words, ArrayType(LongType()))


def context_words(init_values: Column, qp: Column) -> Column:
    """39 words of an array of 154 first context values: first state and most probable symbol (bitstream.cabac_context) of four contexts each, little end first, two bytes of zero at the end."""
    return _CONTEXT_WORDS(init_values, qp)


def slice_group(kind: Column, x: Column, y: Column, width: int, height: int, groups: int, run: int, units: Column, backwards: Column, boxes: list[tuple[int, int, int, int]]) -> Column:
    """Slice group of a macroblock of a picture of width x height for map types 0 to 5; `units` is the size of group 0.

    0 interleaved in runs; 1 dispersed; 2 the first of the boxes (left, top, right, bottom) that holds it, else the last
    group; 3 box-out: needs the place in the spiral, see box_order; 4 raster scan; 5 wipe, by columns. Type 6 lists groups.
    """
    i = y * width + x
    upper = F.when(backwards, width * height - units).otherwise(units)
    side = lambda at: F.when(at < upper, backwards.cast("int")).otherwise(1 - backwards.cast("int"))
    inside = F.lit(groups - 1)
    for g, (left, top, right, bottom) in reversed(list(enumerate(boxes))):
        inside = F.when(x.between(left, right) & y.between(top, bottom), g).otherwise(inside)
    return (
        F.when(kind == 0, F.floor(i / run) % groups).when(kind == 1, (x + F.floor(y * groups / 2)) % groups).when(kind == 2, inside)
        .when(kind == 4, side(i)).when(kind == 5, side(x * height + y)).cast("int")
    )


def box_order(x: Column, y: Column, width: int, height: int, backwards: Column) -> Column:
    """A number that rises along the box-out spiral from the picture's middle: the ring, then the way round it from its left side.

    Group 0 has the first `units` macroblocks in this order (those inside the picture); backwards mirrors the way.
    """
    flag = backwards.cast("int")
    dx, dy = x - F.floor((width - flag) / 2), y - F.floor((height - flag) / 2)
    a, b = F.when(backwards, -dy).otherwise(dx), F.when(backwards, -dx).otherwise(dy)
    r = F.greatest(F.abs(a), F.abs(b))
    way = F.when((a == -r) & (b < r), r - 1 - b).when((b == -r) & (a > -r), 3 * r - 1 + a).when((a == r) & (b > -r), 5 * r - 1 + b).otherwise(7 * r - 1 - a)
    return F.when(r == 0, 0).otherwise((2 * r - 1) * (2 * r - 1) + way).cast("bigint")


def whole(content: Column, at: Column | int, size: int) -> Column:
    """A big-endian whole number at an offset of some bytes; null beyond their end."""
    at = F.lit(at) if isinstance(at, int) else at
    h = F.hex(F.substring(content, at.cast("int") + 1, F.lit(size)))
    return F.when(F.length(h) == 2 * size, F.conv(h, 16, 10).cast("bigint"))


def first_of(content: Column, at: Column, count: Column) -> Column:
    """struct<at, first>: past so many units with 16-bit lengths, null where they are cut, and the first unit."""
    start = F.struct(at.cast("bigint").alias("at"), F.lit(None).cast("binary").alias("first"))

    def step(acc: Column, i: Column) -> Column:
        size = whole(content, acc["at"], 2)
        end = acc["at"] + 2 + size
        return F.struct(F.when(end <= F.length(content), end).alias("at"), F.when(i == 1, F.substring(content, acc["at"].cast("int") + 3, size.cast("int"))).otherwise(acc["first"]).alias("first"))

    units = F.when(count > 0, F.sequence(F.lit(1), count.cast("int"))).otherwise(F.array().cast("array<int>"))
    return F.aggregate(units, start, step)


def avcc(content: Column) -> Column:
    """struct<nal_length, sps, pps> of an H.264 configuration record: the first sets of both kinds; null for another version, a cut record or one without both."""

    def sets(s: Column) -> Column:
        pps = first_of(content, s["at"] + 1, F.coalesce(whole(content, s["at"], 1), F.lit(0)))
        return bound(pps, lambda p: F.when(
            p["at"].isNotNull() & (F.length(s["first"]) > 0) & (F.length(p["first"]) > 0),
            F.struct((whole(content, 4, 1).bitwiseAND(3) + 1).cast("int").alias("nal_length"), s["first"].alias("sps"), p["first"].alias("pps")),
        ))

    found = bound(first_of(content, F.lit(6), F.coalesce(whole(content, 5, 1), F.lit(0)).bitwiseAND(31)), sets)
    return F.when((F.length(content) >= 7) & (whole(content, 0, 1) == 1), found)


#: Bytes of a parameter set that a decoder takes from a configuration record at most.
SET_BYTES = 128


def adoptable(record: Column) -> Column:
    """Whether a decoder takes the sets of an avcc() record."""
    return F.coalesce((F.length(record["sps"]) <= SET_BYTES) & (F.length(record["pps"]) <= SET_BYTES), F.lit(False))


def hvcc(content: Column) -> Column:
    """struct<nal_length, vps, sps, pps> of an H.265 configuration record: of each kind the first of its latest list; null for another version or a cut record."""
    none = F.lit(None).cast("binary")
    start = F.struct(F.lit(23).cast("bigint").alias("at"), none.alias("vps"), none.alias("sps"), none.alias("pps"))

    def step(acc: Column, _: Column) -> Column:
        kind, count = whole(content, acc["at"], 1).bitwiseAND(63), whole(content, acc["at"] + 1, 2)
        put = lambda f, code, old: F.when((kind == code) & (count > 0), f["first"]).otherwise(old)
        return bound(first_of(content, acc["at"] + 3, F.coalesce(count, F.lit(0))), lambda f: F.struct(
            F.when(count.isNotNull(), f["at"]).alias("at"), put(f, 32, acc["vps"]).alias("vps"), put(f, 33, acc["sps"]).alias("sps"), put(f, 34, acc["pps"]).alias("pps"),
        ))

    lists = F.coalesce(whole(content, 22, 1), F.lit(0))
    found = F.aggregate(F.when(lists > 0, F.sequence(F.lit(1), lists.cast("int"))).otherwise(F.array().cast("array<int>")), start, step)
    told = bound(found, lambda f: F.when(f["at"].isNotNull(), F.struct((whole(content, 21, 1).bitwiseAND(3) + 1).cast("int").alias("nal_length"), f["vps"].alias("vps"), f["sps"].alias("sps"), f["pps"].alias("pps"))))
    return F.when((F.length(content) >= 23) & (whole(content, 0, 1) == 1), told)
