"""Media files read by byte ranges: a file of any size is many partitions, and no file is ever one row.

A partition owns the elements of the segment that begin in its range. It finds the first of them from the file's own
index: the greatest cue at or before the range, or else the first element of the segment, is where it begins to step from header to
header, without reading payloads. So a file gives the same rows however it is cut. matroska() first has files whose cues lie
further apart than ranges stepped through once, a task each, to tell where every range's first element begins: without that each
range of such a file would step through all that lies before it.
"""

from __future__ import annotations

import json
import re
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from reelspark.sources.files import MASTERS, block_frames

#: Bytes of a range, and bytes that one read of a file fetches at least.
RANGE_BYTES, READ_BYTES = 64 << 20, 1 << 16
#: Rows, and bytes of payload, of a batch.
BATCH_ROWS, BATCH_BYTES = 5_000, 4_000_000
# Ids of the segment, of its children, and of what cues and blocks are made of.
SEGMENT, CLUSTER, CUES, SEEK_HEAD = 0x18538067, 0x1F43B675, 0x1C53BB6B, 0x114D9B74
TOP = {CLUSTER, CUES, SEEK_HEAD, 0x1549A966, 0x1654AE6B, 0x1043A770, 0x1254C367, 0x1941A469, 0xEC, 0xBF}
FRAMES = "object_id string, offset bigint, track bigint, ts bigint, keyframe boolean, lacing int, frame int, payload binary, fault boolean"
ELEMENTS = "object_id string, seq bigint, kind string, offset bigint, length bigint, payload binary"


def place(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path or URI, and the path there."""
    return pafs.FileSystem.from_uri(re.sub(r"^file:/+", "/", path))


class Bytes:
    """A file as bytes at places, fetched in pieces."""

    def __init__(self, file, size: int):
        self.file, self.size = file, size
        self.at, self.held = 0, b""

    def get(self, at: int, n: int) -> bytes:
        """n bytes from at, fewer at the end of the file."""
        if not self.at <= at or at + n > self.at + len(self.held):
            self.at, self.held = at, self.file.read_at(max(0, min(max(n, READ_BYTES), self.size - at)), at)
        return self.held[at - self.at : at - self.at + n]


@dataclass
class Element:
    """An element: where its header begins, its id, where its payload begins, and its length (-1: unknown). id 0 is a broken header."""

    begin: int
    ident: int
    at: int
    length: int


def element(b: Bytes, begin: int) -> Element:
    head = b.get(begin, 12)
    w = 9 - head[0].bit_length() if head and head[0] else 0
    v = 9 - head[w].bit_length() if 0 < w <= 4 and len(head) > w and head[w] else 0
    if not v or len(head) < w + v:
        return Element(begin, 0, begin, b.size - begin)
    size = int.from_bytes(head[w : w + v], "big") - (1 << 7 * v)
    return Element(begin, int.from_bytes(head[:w], "big"), begin + w + v, -1 if size == (1 << 7 * v) - 1 else size)


def children(b: Bytes, parent: Element, stop: int) -> Iterator[Element]:
    """Elements inside a master; one of unknown length ends before an element that only a segment has. The last may be a broken one."""
    at, end = parent.at, stop if parent.length < 0 else min(stop, parent.at + parent.length)
    while at < end:
        e = element(b, at)
        if parent.length < 0 and parent.ident != SEGMENT and e.ident in TOP - {0xEC, 0xBF}:
            return
        if e.ident and e.length >= 0 and e.at + e.length > end:
            e = Element(at, 0, at, end - at)
        yield e
        if not e.ident:
            return
        at = _after(b, e, end)


def _after(b: Bytes, e: Element, end: int) -> int:
    """Where the next sibling begins; after a master of unknown length, where its last child ends."""
    if e.length >= 0:
        return e.at + e.length
    at = e.at
    if e.ident in MASTERS:
        for c in children(b, e, end):
            at = _after(b, c, end) if c.ident else end
        return at
    return end


def _number(b: Bytes, e: Element) -> int:
    return int.from_bytes(b.get(e.at, e.length), "big")


@dataclass
class Layout:
    """Of a file: its segment, and the places of clusters that its cues name, in order, as far as clusters stand there."""

    segment: Element | None
    end: int = 0
    cues: list[int] = field(default_factory=list)


def layout(b: Bytes) -> Layout:
    """From the file's first elements, the seek head and the cues that it names."""
    at = 0
    while at < b.size:
        e = element(b, at)
        if not e.ident:
            break
        if e.ident == SEGMENT:
            out = Layout(e, b.size if e.length < 0 else min(b.size, e.at + e.length))
            first = next(children(b, e, out.end), None)
            named = [e.at + p for p in _seek(b, first, out.end)] if first and first.ident == SEEK_HEAD else []
            for p in named:
                index = element(b, p) if p < out.end else None
                if index and index.ident == CUES and index.length >= 0:
                    out.cues = sorted({e.at + q for q in _cued(b, index, out.end) if element(b, e.at + q).ident == CLUSTER})
            return out
        at = e.at + e.length if e.length >= 0 else b.size
    return Layout(None)


def _seek(b: Bytes, head: Element, end: int) -> Iterator[int]:
    """Positions of cues that a seek head names."""
    for entry in children(b, head, end):
        leaves = {c.ident: c for c in children(b, entry, end)} if entry.ident == 0x4DBB else {}
        if 0x53AB in leaves and 0x53AC in leaves and _number(b, leaves[0x53AB]) == CUES:
            yield _number(b, leaves[0x53AC])


def _cued(b: Bytes, index: Element, end: int) -> Iterator[int]:
    """Positions of clusters in cues."""
    for point in children(b, index, end):
        for track in children(b, point, end) if point.ident == 0xBB else ():
            yield from (_number(b, c) for c in children(b, track, end) if track.ident == 0xB7 and c.ident == 0xF1)


def owned(b: Bytes, start: int, stop: int, first: int | None = None) -> Iterator[Element]:
    """The children of the file's segment that begin in [start, stop), in order; first is where the first of them begins, if that is known.

    A broken header is one of them, with id 0. The walk comes by every cue, also behind broken headers and lengths.
    """
    told = layout(b)
    if told.segment is None:
        if start == 0 and (stop or not b.size):
            yield Element(0, 0, 0, b.size)
        return
    at = max([told.segment.at, *(c for c in told.cues if c <= start)]) if first is None else first
    while at < min(stop, told.end):
        e, limit = element(b, at), next(iter(told.cues[(k := bisect_right(told.cues, at)) : k + 1]), told.end)
        # No element reaches past the next cue or the end: a length that says so is broken, and what is left is taken.
        after = _after(b, e, told.end) if e.ident else limit
        if e.at > limit:
            e, after = Element(at, 0, at, limit - at), limit
        elif after > limit:
            e, after = Element(at, e.ident, e.at, limit - e.at), limit
        if at >= start:
            yield e
        at = after


def range_starts(b: Bytes, range_bytes: int) -> list[int]:
    """Of each range of a file, where the first element at or behind its beginning stands (the file's size: nowhere); nothing if cues lead there in less than two ranges."""
    told = layout(b)
    spots = [told.segment.at, *told.cues, told.end] if told.segment else []
    if max((z - a for a, z in zip(spots, spots[1:], strict=False)), default=0) <= 2 * range_bytes:
        return []
    out: list[int] = []
    for e in owned(b, 0, b.size):
        out += [e.begin] * (e.begin // range_bytes + 1 - len(out))
    return out + [b.size] * (-(-b.size // range_bytes) - len(out))


def frames(b: Bytes, start: int, stop: int, first: int | None = None) -> Iterator[tuple]:
    """(offset, track, ts, keyframe, lacing, frame, payload, fault) of the blocks of the clusters that begin in [start, stop)."""
    none = (None,) * 6
    for e in owned(b, start, stop, first):
        if not e.ident:
            yield e.begin, *none, True
        if e.ident != CLUSTER:
            continue
        time = None
        for c in children(b, e, b.size):
            blocks = [c] if c.ident == 0xA3 else [x for x in children(b, c, b.size) if x.ident == 0xA1 or not x.ident] if c.ident == 0xA0 else []
            if c.ident == 0xE7:
                time = _number(b, c)
            elif not c.ident:
                yield c.begin, *none, True
            for x in blocks:
                for row in block_frames(b.get(x.at, x.length), time, x.ident == 0xA3) if x.ident else [(*none, True)]:
                    yield x.begin, *row


def elements(b: Bytes, start: int, stop: int, first: int | None = None) -> Iterator[tuple]:
    """(seq, kind, offset, length, payload) of all elements but clusters' in [start, stop), masters first, without payload; seq is where an element begins."""

    def below(e: Element) -> Iterator[tuple]:
        nested = e.ident in MASTERS and e.ident != CLUSTER
        yield e.begin, f"{e.ident:X}" if e.ident else "fault", e.at, e.length, b.get(e.at, e.length) if e.ident and not nested and e.ident != CLUSTER and e.length >= 0 else None
        if nested:
            for c in children(b, e, b.size):
                yield from below(c)

    if (told := layout(b)).segment and start <= told.segment.begin < stop:
        yield told.segment.begin, f"{SEGMENT:X}", told.segment.at, told.segment.length, None
    for e in owned(b, start, stop, first):
        yield from below(e)


@dataclass
class Range(InputPartition):
    """Bytes of one file."""

    path: str
    size: int
    start: int
    stop: int
    first: int | None = None


def _listed(path: str) -> list[tuple[str, int]]:
    """(path, size) of a file, or of the files below a folder."""
    fs, at = place(path)
    found = fs.get_file_info(at)
    infos = [found] if found.type == pafs.FileType.File else fs.get_file_info(pafs.FileSelector(at, recursive=True))
    return sorted((i.path, i.size) for i in infos if i.type == pafs.FileType.File and i.base_name[0] not in "._")


class _Reader(DataSourceReader):
    def __init__(self, options: dict, schema: pa.Schema, walk):
        self.path, self.schema, self.walk, self.options = options["path"], schema, walk, options
        self.range_bytes = int(options.get("range_bytes", RANGE_BYTES))

    def partitions(self) -> list[Range]:
        starts = json.loads(self.options.get("starts", "{}"))
        first = lambda p, k: starts[p][k] if starts.get(p) else None
        return [Range(p, n, a, min(a + self.range_bytes, n), first(p, a // self.range_bytes)) for p, n in _listed(self.path) for a in range(0, max(n, 1), self.range_bytes)] or [Range("", 0, 0, 0)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        fs, _ = place(self.path)
        rows, held = [], 0
        with fs.open_input_file(partition.path) as file:
            for row in self.walk(Bytes(file, partition.size), partition.start, partition.stop, partition.first):
                rows.append((partition.path, *row))
                held += sum(len(v) for v in row if isinstance(v, bytes))
                if len(rows) >= BATCH_ROWS or held >= BATCH_BYTES:
                    yield self._batch(rows)
                    rows, held = [], 0
        yield self._batch(rows)

    def _batch(self, rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(self.schema)], schema=self.schema)


class MatroskaRanges(DataSource):
    """spark.read.format("matroska_ranges").load(file or folder): frames of blocks, or with option rows=elements all other elements.

    Options: range_bytes, the bytes of a partition; starts, range_starts() of files by path, as JSON, for the same range_bytes. Frames are those of files.matroska_frames(), with the block's offset in
    place of its number; elements are as files.matroska() has them, with their offsets as numbers, clusters without their
    children. A file without a segment is one fault; a broken header is a fault, and the walk goes on at the next cue.
    """

    @classmethod
    def name(cls) -> str:
        return "matroska_ranges"

    def schema(self) -> str:
        return ELEMENTS if self.options.get("rows") == "elements" else FRAMES

    def reader(self, schema) -> DataSourceReader:
        from pyspark.sql.pandas.types import to_arrow_schema

        return _Reader(self.options, to_arrow_schema(schema), elements if self.options.get("rows") == "elements" else frames)


def _starts(spark: SparkSession, path: str, range_bytes: int) -> str:
    """range_starts() of the files of more than one range, found by a task for each file; one number a range comes to the driver."""
    long = [f for f in _listed(path) if f[1] > range_bytes]
    if not long:
        return "{}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = place(path)
        for batch in batches:
            for p, n in zip(batch.column("path").to_pylist(), batch.column("size").to_pylist(), strict=True):
                with fs.open_input_file(p) as file:
                    yield pa.RecordBatch.from_arrays([pa.array([p]), pa.array([range_starts(Bytes(file, n), range_bytes)], pa.list_(pa.int64()))], ["path", "starts"])

    found = spark.createDataFrame(long, "path string, size bigint").repartition(len(long)).mapInArrow(run, "path string, starts array<bigint>")
    return json.dumps({r.path: r.starts for r in found.collect() if r.starts})


def matroska(spark: SparkSession, path: str, rows: str = "frames", range_bytes: int = RANGE_BYTES) -> DataFrame:
    spark.dataSource.register(MatroskaRanges)
    starts = _starts(spark, path, range_bytes)
    return spark.read.format("matroska_ranges").option("rows", rows).option("range_bytes", range_bytes).option("starts", starts).load(path)
