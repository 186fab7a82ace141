"""Media files as tables: one row per frame, chunk or element, found by walking each object's framing.

Objects come from spark.read.format("binaryFile"). The walks are sequential by nature (each header says where the next
one is), so each is a small generator that runs inside mapInPandas, object by object; what follows is relational.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Collection, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from reelspark.functions import audio, bitstream

FRAMES = "object_id string, seq bigint, kind string, offset bigint, length bigint"
# EBML ids whose children are walked.
MASTERS = {0x18538067, 0x1F43B675, 0x1654AE6B, 0xAE, 0xE0, 0xE1, 0x1C53BB6B, 0xBB, 0xB7, 0x114D9B74, 0x4DBB, 0xA0, 0x1549A966}


def objects(spark: SparkSession, path: str) -> DataFrame:
    """(object_id, content) of files."""
    return spark.read.format("binaryFile").load(path).select(F.col("path").alias("object_id"), "content")


def riff_chunks(b: bytes) -> Iterator[tuple[str, int, int]]:
    """Chunks of a RIFF file; odd ones are padded; one that says more than there is, and data of size 0, end with the file."""
    at = 12
    while b[:4] == b"RIFF" and at + 8 <= len(b):
        size = struct.unpack_from("<I", b, at + 4)[0]
        if b[at : at + 4] == b"data" and not size:
            size = len(b) - at - 8
        yield b[at : at + 4].decode("latin-1"), at + 8, min(size, len(b) - at - 8)
        at += 8 + size + size % 2


def png_chunks(b: bytes) -> Iterator[tuple[str, int, int]]:
    at = 8
    while b[:8] == b"\x89PNG\r\n\x1a\n" and at < len(b):
        size = struct.unpack_from(">I", b, at)[0] if at + 12 <= len(b) else len(b)
        if at + 12 + size > len(b):
            yield "fault", at, len(b) - at
            return
        yield b[at + 4 : at + 8].decode("latin-1"), at + 8, size
        at += 12 + size


def adts_frames(b: bytes) -> Iterator[tuple[str, int, int]]:
    """ADTS frames; bytes that begin no frame are passed over, a cut last frame is a fault."""
    at = 0
    while at + 7 <= len(b):
        size = (b[at + 3] & 3) << 11 | b[at + 4] << 3 | b[at + 5] >> 5
        if b[at] == 0xFF and b[at + 1] & 0xF6 == 0xF0 and size >= 7 and (b[at + 2] >> 2) & 15 <= 12:
            yield ("frame" if at + size <= len(b) else "fault"), at, min(size, len(b) - at)
            at += size
        else:
            at = b.find(b"\xff", at + 1) % (len(b) + 1)


def mp3_frames(b: bytes) -> Iterator[tuple[str, int, int]]:
    """MPEG-1 Layer III frames after any ID3 tag."""
    at = 0
    if b[:3] == b"ID3" and len(b) >= 10:
        at = 10 + sum((b[6 + i] & 127) << 7 * (3 - i) for i in range(4))
    while at + 4 <= len(b):
        word = struct.unpack_from(">I", b, at)[0]
        kbps, rate = (word >> 12) & 15, (word >> 10) & 3
        if word >> 17 == 0x7FFD and 0 < kbps < 15 and rate < 3:
            size = 144000 * audio.MP3_KBPS[kbps] // audio.MP3_RATES[rate] + ((word >> 9) & 1)
            yield ("frame" if at + size <= len(b) else "fault"), at, min(size, len(b) - at)
            at += size
        else:
            at = b.find(b"\xff", at + 1) % (len(b) + 1)


def prefixed_nals(width: int) -> Callable[[bytes], Iterator[tuple[str, int, int]]]:
    """NALs after lengths of 1, 2 or 4 bytes; a cut one is a fault."""

    def step(b: bytes) -> Iterator[tuple[str, int, int]]:
        at = 0
        while at < len(b):
            size = int.from_bytes(b[at : at + width], "big")
            if at + width + size > len(b):
                yield "fault", at, len(b) - at
                return
            yield "nal", at + width, size
            at += width + size

    return step


def ebml_elements(b: bytes, at: int = 0) -> Iterator[tuple[str, int, int]]:
    """(id in hex, offset of the payload, its length) of elements from a place, masters before their children; an element of unknown size has length -1."""

    def number(at: int, keep: bool) -> tuple[int, int]:
        width = 9 - b[at].bit_length() if b[at] else 0
        if not width or at + width > len(b):
            return -1, 0
        value = int.from_bytes(b[at : at + width], "big")
        return (value if keep else value - (1 << 7 * width)), width

    while at < len(b):
        ident, w = number(at, True)
        if not w or w > 4 or at + w >= len(b):
            yield "fault", at, len(b) - at
            return
        size, v = number(at + w, False)
        if not v:
            yield "fault", at, len(b) - at
            return
        unknown = size == (1 << 7 * v) - 1
        at += w + v
        yield f"{ident:X}", at, -1 if unknown else size
        if ident not in MASTERS:
            if unknown:
                yield "fault", at, len(b) - at
                return
            at += size


WALKS: dict[str, Callable[[bytes], Iterator[tuple[str, int, int]]]] = {
    "riff": riff_chunks, "png": png_chunks, "adts": adts_frames, "mp3": mp3_frames, "ebml": ebml_elements, **{f"nal{w}": prefixed_nals(w) for w in (1, 2, 4)},
}
#: Rows, and bytes of payload, that a task of a walk holds before it hands them on.
WALK_ROWS, WALK_BYTES = 20_000, 8_000_000


def walk(media: DataFrame, how: str, keep: Callable[[str, int], bool] | None = None) -> DataFrame:
    """(object_id, seq, kind, offset, length) of media (object_id, content); null contents have no rows, broken ones a 'fault'.

    With keep there is payload too: the bytes of the rows whose kind and length it takes, from the walk itself.
    """
    import pandas as pd

    step = WALKS[how]
    names = ["object_id", "seq", "kind", "offset", "length", *(["payload"] if keep else [])]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows, held = [], 0
        for batch in batches:
            for i, b in zip(batch["object_id"], batch["content"], strict=True):
                for n, (kind, at, size) in enumerate(step(bytes(b)) if b is not None else ()):
                    payload = [bytes(b[at : at + size]) if keep(kind, size) else None] if keep else []
                    rows.append((i, n, kind, at, size, *payload))
                    held += len(payload[0]) if payload and payload[0] else 0
                    if len(rows) >= WALK_ROWS or held >= WALK_BYTES:
                        yield pd.DataFrame(rows, columns=names)
                        rows, held = [], 0
        yield pd.DataFrame(rows, columns=names)

    key = media.schema["object_id"].dataType.simpleString()
    return media.select("object_id", "content").mapInPandas(run, FRAMES.replace("object_id string", f"object_id {key}") + (", payload binary" if keep else ""))


def unsigned(content: Column, at: Column | int, size: int, little: bool = True) -> Column:
    """A whole number of 1 to 7 bytes at an offset; null beyond the content."""
    at = F.lit(at) if isinstance(at, int) else at
    h = F.hex(F.substring(content, at.cast("int") + 1, F.lit(size)))
    if little:
        h = F.array_join(F.reverse(F.regexp_extract_all(h, F.lit(".."), F.lit(0))), "")
    return F.when(F.length(h) == 2 * size, F.conv(h, 16, 10).cast("bigint"))


def signed16(content: Column, at: Column) -> Column:
    v = unsigned(content, at, 2)
    return F.when(v >= 32768, v - 65536).otherwise(v).cast("int")


def wav_info(media: DataFrame) -> DataFrame:
    """(object_id, channels, sample_rate_hz, block_align, bit_depth, data_offset, data_bytes) of PCM WAV files; others have no row.

    The first fmt and data chunks count; a data size of 0 means all that is left.
    """
    first = lambda v, kind: F.min_by(v, F.when(F.col("kind") == kind, F.col("seq")))
    chunks = walk(media, "riff", lambda kind, size: kind == "fmt ").where("kind in ('fmt ', 'data')")
    x = chunks.groupBy("object_id").agg(first("payload", "fmt ").alias("f"), first(F.struct("offset", "length"), "data").alias("d"))
    f = F.col("f")
    return x.where(unsigned(f, 0, 2) == 1).select(
        "object_id", unsigned(f, 2, 2).cast("int").alias("channels"), unsigned(f, 4, 4).cast("int").alias("sample_rate_hz"), unsigned(f, 12, 2).cast("int").alias("block_align"),
        unsigned(f, 14, 2).cast("int").alias("bit_depth"), F.col("d.offset").alias("data_offset"), F.col("d.length").alias("data_bytes"),
    )


def wav_samples(media: DataFrame) -> DataFrame:
    """(object_id, n, ch, v) of 16-bit WAV files, one row per sample and channel."""
    info = wav_info(media).where("bit_depth = 16 and channels > 0")
    data = walk(media, "riff", lambda kind, size: kind == "data").where("kind = 'data'").select("object_id", F.col("offset").alias("data_offset"), "payload")
    x = info.join(data, ["object_id", "data_offset"])
    # Blocks of samples are dealt out first, so that one long file does not become one long row.
    count = F.floor(F.col("data_bytes") / 2)
    parts = x.where(count > 0).withColumn("part", F.explode(F.sequence(F.lit(0), F.floor((count - 1) / 4096))))
    cut = parts.select("object_id", "channels", "part", F.substring("payload", (F.col("part") * 8192 + 1).cast("int"), F.least(F.lit(8192), 2 * count - F.col("part") * 8192).cast("int")).alias("c"))
    each = cut.repartition("object_id", "part").withColumn("i", F.explode(F.sequence(F.lit(0), F.floor(F.length("c") / 2) - 1)))
    at = F.col("part") * 4096 + F.col("i")
    return each.select("object_id", F.floor(at / F.col("channels")).alias("n"), (at % F.col("channels")).cast("int").alias("ch"), signed16(F.col("c"), F.col("i") * 2).alias("v"))


def bmp_pixels(media: DataFrame) -> DataFrame:
    """(object_id, x, y, r, g, b) of 24-bit uncompressed BMP files, top line first; others, and cut lines, have no rows."""
    c = F.col("content")
    signed32 = lambda at: F.when(unsigned(c, at, 4) >= 1 << 31, unsigned(c, at, 4) - (1 << 32)).otherwise(unsigned(c, at, 4))
    x = media.where((F.hex(F.substring(c, 1, 2)) == "424D") & (unsigned(c, 28, 2) == 24) & (unsigned(c, 30, 4) == 0))
    x = x.select("object_id", "content", unsigned(c, 10, 4).alias("start"), signed32(18).alias("w"), signed32(22).alias("h")).where("w > 0 and h <> 0")
    stride = F.floor((F.col("w") * 3 + 3) / 4) * 4
    lines = x.withColumn("y", F.explode(F.sequence(F.lit(0), F.abs("h") - 1)))
    stored = F.when(F.col("h") > 0, F.col("h") - 1 - F.col("y")).otherwise(F.col("y"))
    lines = lines.select("object_id", "w", "y", F.substring("content", (F.col("start") + stored * stride + 1).cast("int"), (F.col("w") * 3).cast("int")).alias("line")).where(F.length("line") == F.col("w") * 3)
    each = lines.withColumn("x", F.explode(F.sequence(F.lit(0), F.col("w") - 1)))
    byte = lambda k: unsigned(F.col("line"), F.col("x") * 3 + k, 1).cast("int")
    return each.select("object_id", F.col("x").cast("int").alias("x"), F.col("y").cast("int").alias("y"), byte(2).alias("r"), byte(1).alias("g"), byte(0).alias("b"))


#: Objects that are still walked together, below which each is walked alone.
FEW_OBJECTS = 16
# The width of a number by its first octet, 0 for none.
_WIDTHS = np.array([0, *(9 - o.bit_length() for o in range(1, 256))], np.int64)
_MASTERS = np.array(sorted(MASTERS))


class _Contents:
    """The contents of a batch, or some of them, as one run of octets, with where each begins and ends."""

    def __init__(self, octets: np.ndarray, starts: np.ndarray, ends: np.ndarray):
        self.octets, self.starts, self.ends = np.concatenate([octets, np.zeros(8, np.uint8)]), starts, ends
        # The eight octets from each place on as one number.
        self.words = np.ndarray((len(octets) + 1,), ">u8", self.octets, strides=(1,))

    def number(self, at: np.ndarray, width: np.ndarray) -> np.ndarray:
        """The numbers of 1 to 8 octets at places."""
        return (self.words[at].astype(np.uint64) >> (64 - 8 * width).astype(np.uint64)).astype(np.int64)

    def reach(self, who: np.ndarray, at: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where payloads begin in the run, and how much of them is there."""
        start = self.starts[who] + at
        return start, np.clip(size, 0, self.ends[who] - start)

    def elements(self) -> np.ndarray:
        """ebml_elements() of all contents as rows of five arrays (content, seq, id, offset, length), content by content; id 0 is a fault.

        The n-th elements of all contents are read in one step; the last few contents are walked one by one.
        """
        who, n, out = np.flatnonzero(self.starts < self.ends), 0, []
        at = self.starts[who]
        while len(who) > FEW_OBJECTS:
            end = self.ends[who]
            w = _WIDTHS[self.octets[at]]
            fault = (w == 0) | (w > 4) | (at + w >= end)
            w[fault] = 1
            v = _WIDTHS[self.octets[at + w]]
            fault |= (v == 0) | (at + w + v > end)
            v[fault] = 1
            size = self.number(at + w, v) - (1 << 7 * v)
            ident, begin, unknown = np.where(fault, 0, self.number(at, w)), np.where(fault, at, at + w + v), ~fault & (size == (1 << 7 * v) - 1)
            size = np.where(fault, end - at, np.where(unknown, -1, size))
            out.append(np.stack([who, np.full(len(who), n), ident, begin - self.starts[who], size]))
            master = np.isin(ident, _MASTERS)
            lost = unknown & ~master
            if lost.any():
                out.append(np.stack([who[lost], np.full(lost.sum(), n + 1), np.zeros(lost.sum(), np.int64), (begin - self.starts[who])[lost], (end - begin)[lost]]))
            after = np.where(master, begin, begin + size)
            on = ~fault & ~lost & (after < end)
            who, at, n = who[on], after[on], n + 1
        rest = [(i, m, _ident(kind), o, size) for i, a in zip(who, at, strict=True) for m, (kind, o, size) in enumerate(ebml_elements(self.octets[self.starts[i] : self.ends[i]].tobytes(), int(a - self.starts[i])), n)]
        out.append(np.array(rest, np.int64).reshape(-1, 5).T)
        rows = np.concatenate(out, axis=1)
        return rows[:, np.argsort(rows[0], kind="stable")]


def _ident(kind: str) -> int:
    return 0 if kind == "fault" else int(kind, 16)


def _ebml(contents: pa.Array) -> Iterator[tuple[_Contents, np.ndarray, int]]:
    """Contents of a batch in groups of at most WALK_BYTES, with their elements and the number of the group's first content.

    Elements of a larger content come in pieces, which begin at blocks, clusters and cue points.
    """
    contents = contents.cast(pa.large_binary())
    places = np.frombuffer(contents.buffers()[1], np.int64)[contents.offset : contents.offset + len(contents) + 1] if len(contents) else np.zeros(1, np.int64)
    data = np.frombuffer(contents.buffers()[2] or b"", np.uint8)
    first = 0
    while first < len(contents):
        last = max(first + 1, int(np.searchsorted(places, places[first] + WALK_BYTES, "right")) - 1)
        group = _Contents(data[places[first] : places[last]], places[first:last] - places[first], places[first + 1 : last + 1] - places[first])
        if group.ends[-1] <= WALK_BYTES:
            yield group, group.elements(), first
        else:
            rows, held = [], 0
            for n, (kind, at, size) in enumerate(ebml_elements(group.octets[:-8].tobytes())):
                if (len(rows) >= WALK_ROWS or held >= WALK_BYTES) and kind in ("BB", "A3", "A0", "1F43B675"):
                    yield group, np.array(rows, np.int64).T, first
                    rows, held = [], 0
                rows.append((0, n, _ident(kind), at, size))
                held += 0 if _ident(kind) in MASTERS else max(size, 0)
            yield group, np.array(rows, np.int64).reshape(-1, 5).T, first
        first = last


def matroska(media: DataFrame, kinds: Collection[str] | None = None) -> DataFrame:
    """Elements of Matroska files: (object_id, seq, kind, offset, length, payload), only those of the ids in kinds if there are any. Payloads are whole; faults and masters over 8 KiB have none."""
    wanted = None if kinds is None else np.array([_ident(k) for k in kinds])

    def told(ids: pa.Array, group: _Contents, rows: np.ndarray, first: int) -> pa.RecordBatch:
        who, n, ident, at, size = rows
        there = (ident > 0) & (size >= 0) & (~np.isin(ident, _MASTERS) | (size <= 8192))
        start, held = group.reach(who, at, size)
        held = np.where(there, held, 0)
        ends = np.concatenate([[0], np.cumsum(held)])
        octets = group.octets[np.repeat(start - ends[:-1], held) + np.arange(ends[-1])]
        payload = pa.Array.from_buffers(pa.binary(), len(who), [pa.py_buffer(np.packbits(there, bitorder="little")), pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(octets)])
        known, place = np.unique(ident, return_inverse=True)
        names = pa.array([f"{i:X}" if i else "fault" for i in known.tolist()], pa.string()).take(pa.array(place))
        return pa.RecordBatch.from_arrays([ids.take(pa.array(who + first)), pa.array(n), names, pa.array(at), pa.array(size), payload], ["object_id", "seq", "kind", "offset", "length", "payload"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for group, rows, first in _ebml(batch.column("content")):
                rows = rows if wanted is None else rows[:, np.isin(rows[2], wanted)]
                # Batches end where WALK_ROWS or WALK_BYTES are held.
                bulk = np.cumsum(np.maximum(rows[4], 0)) // WALK_BYTES + np.arange(rows.shape[1]) // WALK_ROWS
                for part in np.split(rows, np.flatnonzero(np.diff(bulk)) + 1, axis=1):
                    if part.shape[1]:
                        yield told(batch.column("object_id"), group, part, first)

    key = media.schema["object_id"].dataType.simpleString()
    return media.select("object_id", "content").mapInArrow(run, FRAMES.replace("object_id string", f"object_id {key}") + ", payload binary")


def _whole() -> Column:
    return F.conv(F.hex("payload"), 16, 10).cast("bigint")


def _inside(elements: DataFrame, **masters: str) -> DataFrame:
    """Elements with, for each name, the seq of the latest element of that id so far."""
    order = Window.partitionBy("object_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    return elements.withColumns({n: F.last(F.when(F.col("kind") == k, F.col("seq")), ignorenulls=True).over(order) for n, k in masters.items()})


def matroska_segments(elements: DataFrame) -> DataFrame:
    """(object_id, data_offset) of segments: where their payload begins, the base of all positions."""
    return elements.where("kind = '18538067'").select("object_id", F.col("offset").alias("data_offset"))


def matroska_cues(elements: DataFrame) -> DataFrame:
    """(object_id, ticks, track, position, relative) from matroska(): one row for each track position of a cue point, whose time they share."""
    x = _inside(elements.where("kind in ('BB', 'B3', 'B7', 'F7', 'F1', 'F0')"), point="BB", place="B7").where("point is not null")
    x = x.withColumn("ticks", F.max(F.when(F.col("kind") == "B3", _whole())).over(Window.partitionBy("object_id", "point")))
    leaf = lambda k: F.max(F.when(F.col("kind") == k, _whole()))
    told = x.where("place > point and kind in ('B7', 'F7', 'F1', 'F0')").groupBy("object_id", "place", "ticks").agg(leaf("F7").alias("track"), leaf("F1").alias("position"), leaf("F0").alias("relative"))
    return told.select("object_id", "ticks", "track", "position", "relative")


def cue_positions(media: DataFrame) -> DataFrame:
    """matroska_cues() of the elements of Matroska files (object_id, content), put together in the walk itself; nothing is shuffled. Numbers of more than 63 bits are null."""
    bb, b7, leaves = 0xBB, 0xB7, (0xF7, 0xF1, 0xF0)

    def places(group: _Contents, rows: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        who, _, ident, at, size = rows
        start, held = group.reach(who, at, size)
        good = (held > 0) & (held <= 8)
        # -1 stands for no number.
        value = np.where(good, group.number(np.where(good, start, 0), np.where(good, held, 1)), -1)
        place = np.arange(len(who))
        point, inside = (np.maximum.accumulate(np.where(ident == k, place, -1)) for k in (bb, b7))
        # Cue points of another content, and track positions of another point, are none.
        mine = (point >= 0) & (who[point] == who)
        there = mine & (inside > point)

        def most(kind: int, by: np.ndarray, on: np.ndarray) -> np.ndarray:
            out = np.full(len(who), -1)
            np.maximum.at(out, by[on & (ident == kind)], value[on & (ident == kind)])
            return out

        told = np.flatnonzero(there & (ident == b7))
        return who[told], [most(0xB3, point, mine)[point[told]], *(most(k, inside, there)[told] for k in leaves)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for group, rows, first in _ebml(batch.column("content")):
                rows = rows[:, np.isin(rows[2], (bb, 0xB3, b7, *leaves))]
                if rows.shape[1]:
                    who, numbers = places(group, rows)
                    columns = [batch.column("object_id").take(pa.array(who + first)), *(pa.array(v, mask=v < 0) for v in numbers)]
                    yield pa.RecordBatch.from_arrays(columns, ["object_id", "ticks", "track", "position", "relative"])

    key = media.schema["object_id"].dataType.simpleString()
    return media.select("object_id", "content").mapInArrow(run, f"object_id {key}, ticks bigint, track bigint, position bigint, relative bigint")


def matroska_seek_entries(elements: DataFrame) -> DataFrame:
    """(object_id, element_id, position) from matroska(): where the seek head says that elements are, ids in hex."""
    x = _inside(elements.where("kind in ('4DBB', '53AB', '53AC')"), entry="4DBB").where("entry is not null")
    told = x.groupBy("object_id", "entry").agg(F.max(F.when(F.col("kind") == "53AB", F.hex("payload"))).alias("element_id"), F.max(F.when(F.col("kind") == "53AC", _whole())).alias("position"))
    return told.select("object_id", "element_id", "position")


#: Ids that matroska_tracks() looks at.
TRACK_KINDS = ("1654AE6B", "1F43B675", "1C53BB6B", "114D9B74", "1549A966", "AE", "D7", "86", "B0", "BA", "B5", "9F")


def matroska_tracks(elements: DataFrame) -> DataFrame:
    """(object_id, track, codec_id, codec, kind, width, height, sample_rate_hz, channels, selected) from matroska()."""
    order = Window.partitionBy("object_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    x = elements.withColumn("entry", F.last(F.when(F.col("kind") == "AE", F.col("seq")), ignorenulls=True).over(order))
    x = x.withColumn("top", F.last(F.when(F.col("kind").isin("1654AE6B", "1F43B675", "1C53BB6B", "114D9B74", "1549A966"), F.col("kind")), ignorenulls=True).over(order))
    whole = F.conv(F.hex("payload"), 16, 10).cast("bigint")
    leaf = lambda k, v: F.max(F.when(F.col("kind") == k, v))
    # IEEE numbers as bits: a double's and a float's whole part by shifts of the significand.
    bits, n = F.conv(F.hex("payload"), 16, 10).cast("decimal(20,0)"), F.length("payload")
    power = F.when(n == 8, F.floor(bits / F.lit(2**52)).cast("bigint") % 2048 - 1023).otherwise(F.floor(bits / F.lit(2**23)).cast("bigint") % 256 - 127)
    fraction = F.when(n == 8, (bits % F.lit(2**52).cast("decimal(20,0)")).cast("double") / 2.0**52).otherwise((bits % F.lit(2**23).cast("decimal(20,0)")).cast("double") / 2.0**23)
    rate = F.when((power >= 0) & (power < 32), F.floor((1 + fraction) * F.pow(F.lit(2.0), power))).otherwise(0)
    tracks = x.where("top = '1654AE6B' and entry is not null").groupBy("object_id", "entry").agg(
        leaf("D7", whole).alias("track"), leaf("86", F.rtrim(F.decode("payload", "UTF-8"))).alias("codec_id"), leaf("B0", whole).alias("width"), leaf("BA", whole).alias("height"),
        leaf("B5", rate).alias("sample_rate_hz"), leaf("9F", whole).alias("channels"),
    )
    c = F.col("codec_id")
    named = tracks.withColumn("kind", bitstream.kind(c)).withColumn("codec", F.coalesce(bitstream.video_codec(c), bitstream.audio_codec(c))).withColumn("track", bitstream.track_id(F.col("track")))
    first = F.row_number().over(Window.partitionBy("object_id", "kind").orderBy("entry")) == 1
    return named.select("object_id", "track", "codec_id", "codec", "kind", "width", "height", "sample_rate_hz", "channels", (F.col("kind").isNotNull() & first).alias("selected"))


def lace_bounds(lacing: int | None, body: bytes | None) -> list[int] | None:
    """Where the frames of a lace (1 Xiph, 2 fixed, 3 EBML) begin in the bytes after a block's header, and its end; null for a broken lace."""
    if not body:
        return None
    n, at, sizes = body[0] + 1, 1, []
    if lacing == 2:
        size, left = divmod(len(body) - 1, n)
        return None if left else [1 + size * i for i in range(n + 1)]
    while len(sizes) < n - 1:
        if lacing == 1:
            size = 0
            while at < len(body) and body[at] == 255:
                size, at = size + 255, at + 1
            if at >= len(body):
                return None
            size, at = size + body[at], at + 1
        else:
            w = 9 - body[at].bit_length() if at < len(body) and body[at] else 0
            if not w or at + w > len(body):
                return None
            size = int.from_bytes(body[at : at + w], "big") - (1 << 7 * w)
            if sizes:
                size += sizes[-1] - ((1 << 7 * w - 1) - 1)
            at += w
        sizes.append(size)
    if min(sizes, default=0) < 0 or at + sum(sizes) > len(body):
        return None
    return [at + sum(sizes[:i]) for i in range(n)] + [len(body)]


def block_frames(block: bytes, cluster: int | None, simple: bool) -> list[tuple]:
    """(track, ts, keyframe, lacing, frame, payload, fault) of the frames of a whole block; of a broken one, one row with fault."""
    none = [(None, None, None, None, None, None, True)]
    w = 9 - block[0].bit_length() if block and block[0] else 0
    if not w or len(block) < w + 3:
        return none
    track, flags = int.from_bytes(block[:w], "big") - (1 << 7 * w), block[w + 2]
    ts = None if cluster is None else cluster + int.from_bytes(block[w : w + 2], "big", signed=True)
    lacing, body = flags >> 1 & 3, block[w + 3 :]
    head = (track, ts, simple and flags & 128 != 0, lacing)
    if not lacing:
        return [(*head, 0, body, False)]
    bounds = lace_bounds(lacing, body)
    if bounds is None:
        return [(*head, None, None, True)]
    return [(*head, i, body[a:z], False) for i, (a, z) in enumerate(zip(bounds, bounds[1:], strict=False))]


def matroska_frames(media: DataFrame) -> DataFrame:
    """(object_id, seq, track, ts, keyframe, lacing, frame, payload, fault) of the blocks of Matroska files (object_id, content), one row for each frame.

    A block's time is its cluster's plus its own 16 bits; all frames of a lace share it and count from 0. A block that is
    cut or has a broken header or lace is one row with fault, without frame and payload. All comes from one walk, in
    which clusters stand before their blocks; nothing is shuffled.
    """
    key = media.schema["object_id"].dataType.simpleString()
    ddl = f"object_id {key}, seq bigint, track bigint, ts bigint, keyframe boolean, lacing int, frame int, payload binary, fault boolean"
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.int32(), pa.int32(), pa.binary(), pa.bool_()]

    def rows_of(b: bytes) -> Iterator[tuple]:
        time = None
        for n, (kind, at, size) in enumerate(ebml_elements(b)):
            if kind == "E7":
                time = int.from_bytes(b[at : at + size], "big")
            elif kind in ("A3", "A1"):
                whole = at + size <= len(b)
                yield from ((n, *row) for row in (block_frames(b[at : at + size], time, kind == "A3") if whole else [(None, None, None, None, None, None, True)]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, rows, held = [], [], 0

            def told() -> pa.RecordBatch:
                columns = [batch.column("object_id").take(pa.array(ids, pa.int64())), *(pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds))]  # noqa: B023
                return pa.RecordBatch.from_arrays(columns, ["object_id", "seq", "track", "ts", "keyframe", "lacing", "frame", "payload", "fault"])

            for i, content in enumerate(batch.column("content")):
                for row in rows_of(content.as_py()) if content.is_valid else ():
                    ids.append(i)
                    rows.append(row)
                    held += len(row[6] or b"")
                    if len(rows) >= WALK_ROWS or held >= WALK_BYTES:
                        yield told()
                        ids, rows, held = [], [], 0
            if rows:
                yield told()

    return media.select("object_id", "content").mapInArrow(run, ddl)
