"""Slice headers of H.264 read bit by bit, and reference lists changed by the commands that stand in them.

A header is a row. Headers of any number of slices are read in one pass over the units without a shuffle: each element is
read of all units of a batch at once, where the one before ended.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

#: Bytes of a unit that its header can reach into: some 160 codes of at most 65 bits, with emulation bytes.
HEADER_BYTES = 2048
#: The fields of parameter sets that a header depends on.
SET_FIELDS = (
    "set_id", "macroblocks", "reference_frames", "frame_num_bits", "order_type", "lsb_bits", "delta_zero", "order_present", "top_to_bottom",
    "redundant_present", "refs_active", "qp", "deblocking_present", "cycle_bits", "cycle_most",
)
FIELDS = (
    "first_mb", "slice_type", "pps_id", "frame_num", "idr_pic_id", "lsb", "delta_bottom", "delta_0", "delta_1", "redundant", "active", "no_output", "long_term_idr",
    "qp_delta", "deblocking", "alpha", "beta", "group_cycle",
)
#: Arguments of the commands by number: to the reference list, which 3 ends, and to the marking, which 0 ends.
CHANGES = np.array((1, 1, 1, 0))
ARGUMENTS = np.array((0, 1, 1, 2, 1, 0, 1))
#: Stands for a number that is not there.
NONE = -(1 << 62)
#: Names of faults; 'no slice' and those of elements in the order of reading, then 'end'.
FAULTS = ("no slice", "first_mb", "slice_type", "set_id", "frame_num", "idr_pic_id", "order", "redundant", "active", "changes", "marks", "qp", "deblocking", "group_cycle", "end")
_COMMANDS = ArrayType(StructType([StructField(name, LongType()) for name in ("op", "a", "b")]))
_HEADER = StructType([*(StructField(name, LongType()) for name in FIELDS), StructField("changes", _COMMANDS), StructField("marks", _COMMANDS)])


class _Bits:
    """The bits of many NAL units without emulation bytes; at has the place where each is read on.

    A code's value is NONE where the bits end before it does.
    """

    def __init__(self, units: pa.Array) -> None:
        sizes = pc.fill_null(pc.binary_length(units), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        octets = np.frombuffer(b"".join(u for u in units.to_pylist() if u), np.uint8)
        ends = np.cumsum(sizes)
        place = np.arange(len(octets)) - np.repeat(ends - sizes, sizes)
        kept = np.ones(len(octets), bool)
        kept[2:] = (octets[2:] != 3) | (octets[1:-1] != 0) | (octets[:-2] != 0) | (place[2:] < 2)
        upto = np.append(0, np.cumsum(kept))
        self.at, self.end = 8 * upto[ends - sizes], 8 * upto[ends]
        self._words = np.lib.stride_tricks.sliding_window_view(np.append(octets[kept], np.zeros(16, np.uint8)), 8)

    def _peek(self, at: np.ndarray, width: np.ndarray) -> np.ndarray:
        """The numbers of so many bits, 1 to 57, that begin at these places."""
        words = np.ascontiguousarray(self._words[at >> 3]).view(">u8")[:, 0].astype(np.uint64)
        return (words << (at & 7).astype(np.uint64) >> (64 - width).astype(np.uint64)).astype(np.int64)

    def u(self, rows: np.ndarray, width: np.ndarray) -> np.ndarray:
        """Numbers of so many bits, 57 at most."""
        at = self.at[rows]
        there = (width >= 0) & (width <= 57) & (at + width <= self.end[rows])
        value = np.where(width == 0, 0, self._peek(at, np.clip(width, 1, 57)))
        self.at[rows] = np.where(there, at + width, at)
        return np.where(there, value, NONE)

    def ue(self, rows: np.ndarray) -> np.ndarray:
        """Exp-Golomb numbers of at most 32 zeros."""
        at = self.at[rows]
        # The exponent of a whole number below 2^53 is its length in bits.
        zeros = 33 - np.frexp(self._peek(at, np.full(len(at), 33)).astype(np.float64))[1].astype(np.int64)
        there = (zeros <= 32) & (at + 2 * zeros + 1 <= self.end[rows])
        value = self._peek(at + zeros, zeros + 1) - 1
        self.at[rows] = np.where(there, at + 2 * zeros + 1, at)
        return np.where(there, value, NONE)

    def se(self, rows: np.ndarray) -> np.ndarray:
        v = self.ue(rows)
        return np.where(v == NONE, NONE, np.where(v % 2 == 1, (v + 1) // 2, -(v // 2)))


def _whole(v: np.ndarray) -> pa.Array:
    return pa.array(v, mask=v == NONE)


def _headers(unit: pa.Array, sets: pa.Array) -> pa.Array:
    """struct<header, fault> of each unit: every element is read of all units that have it and are without fault so far."""
    n, bits = len(unit), _Bits(unit)
    s = {name: pc.fill_null(v, NONE).to_numpy(zero_copy_only=False) for name, v in zip(SET_FIELDS, sets.flatten())}
    on = lambda name: s[name] == 1
    live = unit.is_valid().to_numpy(zero_copy_only=False) & sets.is_valid().to_numpy(zero_copy_only=False) & (bits.end - bits.at >= 8)
    fault = np.where(live, -1, 0).astype(np.int8)

    def check(name: str, broken: np.ndarray) -> None:
        broken = live & broken
        fault[broken] = FAULTS.index(name)
        live[broken] = False

    def element(code, there: np.ndarray | bool = True) -> np.ndarray:
        rows, v = np.flatnonzero(live & there), np.full(n, NONE)
        v[rows] = code(rows)
        check("end", there & (v == NONE))
        return v

    def commands(name: str, listed: np.ndarray, most: np.ndarray, needs: np.ndarray, last: int, broken) -> tuple:
        """Operations with as many arguments as each needs until the last one, at most so many (null where there is no list); how many; and how many of a kind."""
        told, found, more = np.zeros(n, np.int64), [], listed & live
        while more.any():
            check(name, more & (told > most))
            op = element(bits.ue, more & live)
            check(name, more & (op >= len(needs)))
            more &= live & (op != last)
            wants = needs[np.where(more, op, last)]
            a = element(bits.ue, more & (wants > 0))
            b = element(bits.ue, more & live & (wants > 1))
            check(name, more & broken(op, a))
            more &= live
            rows = np.flatnonzero(more)
            told[rows] += 1
            found.append(np.stack([rows, op[rows], a[rows], b[rows]]))
        rows, *parts = np.concatenate(found or [np.zeros((4, 0), np.int64)], axis=1)
        order = np.argsort(rows, kind="stable")
        values = pa.StructArray.from_arrays([_whole(v[order]) for v in parts], ["op", "a", "b"])
        offsets = np.append(0, np.cumsum(np.bincount(rows, minlength=n)))

        def counted(k: int) -> np.ndarray:
            return np.bincount(rows[parts[0] == k], minlength=n)

        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values, mask=pa.array(~listed)), told, counted

    u = lambda width: lambda rows: bits.u(rows, np.broadcast_to(width, n)[rows])
    first = element(u(8))
    kind, ref = first % 32, first >> 5 & 3
    check("no slice", ~np.isin(kind, (1, 5)))
    idr, h = kind == 5, {}
    h["first_mb"] = element(bits.ue)
    check("first_mb", (s["macroblocks"] != NONE) & (h["first_mb"] >= s["macroblocks"]))
    h["slice_type"] = t = element(bits.ue)
    p = np.isin(t, (0, 5))
    check("slice_type", ~np.isin(t, (0, 2, 5, 7)) | p & (idr | (s["reference_frames"] == 0)))
    h["pps_id"] = element(bits.ue)
    check("set_id", (s["set_id"] != NONE) & (h["pps_id"] != s["set_id"]))
    h["frame_num"] = element(u(s["frame_num_bits"]))
    check("frame_num", idr & (h["frame_num"] != 0))
    h["idr_pic_id"] = element(bits.ue, idr)
    check("idr_pic_id", h["idr_pic_id"] > 65535)

    # The order count of an IDR picture is 0.
    given = lambda v: np.where(v == NONE, 0, v)
    plain = s["order_type"] == 0
    stepped = (s["order_type"] == 1) & (s["delta_zero"] == 0)
    h["lsb"] = element(u(s["lsb_bits"]), plain)
    h["delta_bottom"] = element(bits.se, plain & on("order_present"))
    check("order", idr & plain & ((2 * h["lsb"] > 1 << np.clip(s["lsb_bits"], 0, 57)) | (np.minimum(h["lsb"], h["lsb"] + given(h["delta_bottom"])) != 0)))
    h["delta_0"] = element(bits.se, stepped)
    h["delta_1"] = element(bits.se, stepped & on("order_present"))
    check("order", idr & stepped & (s["top_to_bottom"] != NONE) & (np.minimum(h["delta_0"], h["delta_0"] + s["top_to_bottom"] + given(h["delta_1"])) != 0))
    h["redundant"] = element(bits.ue, on("redundant_present"))
    check("redundant", h["redundant"] > 127)

    override = element(u(1), p) == 1
    more = element(bits.ue, override)
    h["active"] = np.where(p, np.where(override, more + 1, s["refs_active"]), NONE)
    check("active", h["active"] > 16)
    listed = element(u(1), p) == 1
    bound = 1 << np.clip(s["frame_num_bits"], 0, 57)
    # A set without a number of pictures bounds a list by the most that any may have.
    most = np.where(h["active"] == NONE, 17, h["active"])
    changes, told, _ = commands("changes", listed, most, CHANGES, 3, lambda op, a: (op < 2) & (a >= bound))
    check("changes", listed & (told == 0))

    h["no_output"] = element(u(1), (ref > 0) & idr)
    h["long_term_idr"] = element(u(1), (ref > 0) & idr)
    frames = s["reference_frames"]
    check("marks", (h["long_term_idr"] == 1) & (frames == 0))
    listed = element(u(1), (ref > 0) & ~idr) == 1
    marks, _, counted = commands("marks", listed, np.where(frames == NONE, 0, 2 * frames + 2), ARGUMENTS, 0, lambda op, a: (op == 4) & (a > frames))
    check("marks", (counted(4) > 1) | (counted(5) > 1) | (counted(6) > 1) | (counted(5) > 0) & (counted(1) + counted(2) + counted(3) > 0))

    h["qp_delta"] = element(bits.se)
    check("qp", (s["qp"] != NONE) & ((h["qp_delta"] + s["qp"] < 0) | (h["qp_delta"] + s["qp"] > 51)))
    h["deblocking"] = element(bits.ue, on("deblocking_present"))
    check("deblocking", h["deblocking"] > 2)
    filtered = on("deblocking_present") & (h["deblocking"] != 1)
    for name in ("alpha", "beta"):
        h[name] = element(bits.se, filtered)
        check("deblocking", filtered & (np.abs(h[name]) > 6))
    h["group_cycle"] = element(u(s["cycle_bits"]), s["cycle_bits"] > 0)
    check("group_cycle", (s["cycle_most"] != NONE) & (h["group_cycle"] > s["cycle_most"]))

    header = pa.StructArray.from_arrays([*(_whole(h[f]) for f in FIELDS), changes, marks], [*FIELDS, "changes", "marks"], mask=pa.array(~live))
    names = pa.array([*FAULTS, None]).take(pa.array(np.where(live, len(FAULTS), fault)))
    return pa.StructArray.from_arrays([header, names], ["header", "fault"])


_HEADERS = F.arrow_udf(_headers, StructType([StructField("header", _HEADER), StructField("fault", StringType())]))


def read(units: DataFrame) -> DataFrame:
    """units (unit: hex of a NAL unit, sets: struct of SET_FIELDS) with header: struct of FIELDS, changes, marks, and with fault.

    sets are those that the slice is to be read with; its flags are booleans, cycle_bits is 0 without a group cycle. changes and marks
    are array<struct<op, a, b>>: commands to the reference list (differences are less one, as coded) and to the marking.
    fault names the first element in the order of reading that breaks a rule, or 'end' where the bits end before the
    header; the header is then null, as it is for a null unit, null sets or a unit that is no slice or no hex ('no slice').
    Only I and P slices are read; elements that a slice does not have are null. Columns of units named header or fault are replaced.
    """
    units = units.drop("header", "fault")
    size = F.least(F.length("unit"), F.lit(2 + 2 * HEADER_BYTES))
    octets = F.unhex(F.substring(F.col("unit"), F.lit(1), size - size % 2))
    sets = F.when(F.col("sets").isNotNull(), F.struct(*[F.col("sets")[f].cast("bigint").alias(f) for f in SET_FIELDS]))
    x = units.withColumn("_read", _HEADERS(octets, sets))
    return x.select(*units.columns, F.col("_read.header").alias("header"), F.col("_read.fault").alias("fault"))


def _bound(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), with value worked out once."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def changed_list(short: Column, long: Column, frame_num: Column, active: Column, changes: Column, wrap: int) -> Column:
    """The reference list of a slice as an array of pictures, `active` long: its first list after the commands that the header holds.

    short and long are array<struct<number, picture>> in the order of the first list, the numbers those of pictures and of long-term
    ones. Commands 0 and 1 step down or up from the number last named (the slice's own first) by the coded difference plus 1, modulo
    wrap; command 2 names a long-term picture. Places without a picture are null. Null where a command names a picture that is not there.
    """
    names = lambda a: F.transform(a, lambda p: p["picture"])
    place = active.cast("int")
    padded = F.slice(F.concat(names(short), names(long), F.array_repeat(F.lit(None).cast("bigint"), place)), F.lit(1), place)
    state = lambda at, last, found, lost: F.struct(at.cast("int").alias("at"), last.cast("bigint").alias("last"), found.alias("list"), lost.alias("lost"))
    named = lambda a, number: F.get(names(F.filter(a, lambda p: p["number"] == number)), F.lit(0))

    def put(s: Column, m: Column, stepped: Column) -> Column:
        number = F.when(stepped > frame_num, stepped - wrap).otherwise(stepped)
        picture = F.when(m["op"] == 2, named(long, m["a"])).otherwise(named(short, number))
        moved = lambda p: F.slice(F.concat(F.slice(s["list"], F.lit(1), s["at"]), F.array(p), F.filter(F.slice(s["list"], s["at"] + 1, place), lambda q: ~q.eqNullSafe(p))), F.lit(1), place)
        return _bound(picture, lambda p: state(s["at"] + 1, F.when(m["op"] == 2, s["last"]).otherwise(stepped), F.when(p.isNotNull(), moved(p)).otherwise(s["list"]), s["lost"] | p.isNull()))

    def step(s: Column, m: Column) -> Column:
        by = m["a"] + 1
        return _bound(F.pmod(s["last"] + F.when(m["op"] == 1, by).otherwise(-by), F.lit(wrap)), lambda stepped: put(s, m, stepped))

    return F.aggregate(changes, state(F.lit(0), frame_num, padded, F.lit(False)), step, lambda s: F.when(~s["lost"], s["list"]))
