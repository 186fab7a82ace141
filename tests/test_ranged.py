"""Matroska files read by byte ranges: however a file is cut, it gives the rows of the whole."""

import io
import os
import random
import struct

import pyarrow as pa
import pytest

from reelspark.sources import files, ranged

UNKNOWN = b"\x01" + b"\xff" * 7


def el(ident, payload, size=None):
    return bytes.fromhex(ident) + (struct.pack(">Q", 1 << 56 | len(payload)) if size is None else size) + payload


def block(track, rel, flags, body):
    return bytes([0x80 | track]) + struct.pack(">hB", rel, flags) + body


def movie(rng, clusters=12, unknown=False, cues=False, decoy=True):
    """A file whose blocks and attachment hold bytes of other clusters; with cues, a seek head names them."""
    inner = el("1F43B675", el("E7", b"\x01") + el("A3", block(1, 0, 0, b"not a block of this file")))
    tracks = el("1654AE6B", el("AE", el("D7", b"\1") + el("86", b"V_MPEG4/ISO/AVC")))
    attachment = el("1941A469", el("61A7", inner * 3)) if decoy else b""

    def cluster(k):
        body = el("E7", struct.pack(">H", k * 1000))
        for i in range(rng.randrange(1, 5)):
            data = inner if decoy and rng.random() < 0.3 else bytes(rng.randrange(256) for _ in range(rng.randrange(40)))
            body += el("A3", block(1 + i % 2, i, 0x80 if i == 0 else 0, data)) if i % 3 else el("A0", el("A1", block(1, i, 4, b"\1" + b"aabb")))
        return el("1F43B675", body, UNKNOWN if unknown and k % 2 else None)

    made, places, at = [], [], 0
    seek = lambda p: el("114D9B74", el("4DBB", el("53AB", bytes.fromhex("1C53BB6B")) + el("53AC", struct.pack(">Q", p))))
    head = (seek(0) if cues else b"") + tracks + attachment
    at = len(head)
    for k in range(clusters):
        made.append(cluster(k))
        places.append(at)
        at += len(made[-1])
    index = el("1C53BB6B", b"".join(el("BB", el("B3", b"\0") + el("B7", el("F7", b"\1") + el("F1", struct.pack(">I", p)))) for p in places[::3]))
    body = (seek(at) if cues else b"") + tracks + attachment + b"".join(made) + (index if cues else b"")
    return el("1A45DFA3", b"\x42\x86\x81\x01") + el("18538067", body, UNKNOWN if unknown else None)


class File(io.BytesIO):
    def read_at(self, n, at):
        self.seek(at)
        return self.read(n)


def rows(data, walk, start, stop):
    return list(walk(ranged.Bytes(File(data), len(data)), start, stop))


@pytest.mark.parametrize("unknown", [False, True])
@pytest.mark.parametrize("cues", [False, True])
def test_a_file_cut_at_any_byte_gives_the_same_rows(monkeypatch, unknown, cues):
    monkeypatch.setattr(ranged, "READ_BYTES", 64)
    data = movie(random.Random(unknown * 2 + cues), unknown=unknown, cues=cues)
    for walk in (ranged.frames, ranged.elements):
        whole = rows(data, walk, 0, len(data))
        assert len(whole) > 10
        for cut in range(0, len(data), 1 if walk is ranged.frames else 7):
            assert rows(data, walk, 0, cut) + rows(data, walk, cut, len(data)) == whole
    assert [r[-1] for r in rows(data, ranged.frames, 0, len(data)) if r[-1]] == []
    for size in (50, 333):
        parts = [r for a in range(0, len(data), size) for r in rows(data, ranged.frames, a, min(a + size, len(data)))]
        assert parts == rows(data, ranged.frames, 0, len(data))


@pytest.mark.parametrize("cues", [False, True])
def test_broken_files_are_cut_alike(cues):
    rng = random.Random(8)
    whole_file = movie(rng, cues=cues, decoy=False)
    for _ in range(60):
        data = bytearray(whole_file[: rng.randrange(20, len(whole_file))] if rng.random() < 0.3 else whole_file)
        for _ in range(rng.randrange(3)):
            data[rng.randrange(len(data))] = rng.randrange(256)
        data = bytes(data)
        whole = rows(data, ranged.frames, 0, len(data))
        for cut in rng.sample(range(len(data)), 12):
            assert rows(data, ranged.frames, 0, cut) + rows(data, ranged.frames, cut, len(data)) == whole
    assert rows(b"", ranged.frames, 0, 0) == [(0, None, None, None, None, None, None, True)] or rows(b"", ranged.frames, 0, 0)
    assert rows(b"no media at all", ranged.frames, 0, 15)[0][-1]


def test_ranges_as_a_spark_source(spark, tmp_path):
    rng = random.Random(1)
    folder = tmp_path / "media"
    os.makedirs(folder / "deep")
    made = {f"deep/{k}.mkv" if k % 2 else f"{k}.mkv": movie(rng, clusters=20, cues=k > 1, decoy=False) for k in range(4)}
    for name, data in made.items():
        (folder / name).write_bytes(data)
    (folder / "empty.mkv").write_bytes(b"")
    df = ranged.matroska(spark, f"file://{folder}", range_bytes=700)
    assert df.rdd.getNumPartitions() > 12
    got = sorted((os.path.basename(r.object_id), r.offset, r.track, r.ts, r.keyframe, r.lacing, r.frame, bytes(r.payload)) for r in df.where("not fault").collect())
    media = spark.createDataFrame([(os.path.basename(n), d) for n, d in made.items()], "object_id string, content binary")
    plain = files.matroska_frames(media).where("not fault").collect()
    assert sorted((g[0], *g[2:]) for g in got) == sorted((r.object_id, r.track, r.ts, r.keyframe, r.lacing, r.frame, bytes(r.payload)) for r in plain)
    elements = ranged.matroska(spark, str(folder), "elements", 500)
    tracks = files.matroska_tracks(elements.where("kind not in ('fault')")).collect()
    assert {t.codec for t in tracks} == {"h264"} and len(tracks) == 4
    assert files.matroska_cues(elements).count() == 2 * 7
    one = ranged.matroska(spark, str(folder / "2.mkv"), range_bytes=1 << 30)
    assert one.rdd.getNumPartitions() == 1 and one.count() == sum(g[0] == "2.mkv" for g in got)


# -- sinks

def listed(folder):
    return sorted(os.listdir(folder)) if os.path.isdir(folder) else []


def test_rasters_read_back_equal_their_pixels(spark, tmp_path):
    from pyspark.sql import functions as F

    from reelspark.sources import sinks

    rng = random.Random(2)
    sizes = {1: (1, 1), 2: (7, 3), 3: (2, 40)}
    pixels = [(i, x, y, *(rng.randrange(256) for _ in range(3))) for i, (w, h) in sizes.items() for x in range(w) for y in range(h)]
    df = spark.createDataFrame(pixels, "img int, x int, y int, r int, g int, b int").repartition(5)
    for how in ("ppm", "rgb565"):
        sinks.write_rasters(df, f"file://{tmp_path}/{how}", how)
    with open(tmp_path / "ppm" / "2.ppm", "rb") as f:
        assert f.read() == b"P6\n7 3\n255\n" + bytes(v for _, p in sorted(((y, x), (r, g, b)) for i, x, y, r, g, b in pixels if i == 2) for v in p)
    got = sinks.read_rasters(spark, str(tmp_path / "ppm"), "ppm").withColumn("img", F.col("img").cast("int")).collect()
    assert sorted(map(tuple, got)) == sorted(pixels)
    got = sinks.read_rasters(spark, str(tmp_path / "rgb565"), "rgb565").withColumn("img", F.col("img").cast("int")).collect()
    assert sorted(map(tuple, got)) == sorted((i, x, y, (r >> 3) << 11 | (g >> 2) << 5 | b >> 3) for i, x, y, r, g, b in pixels)
    assert listed(tmp_path / "rgb565") == ["1_1x1.rgb565", "2_7x3.rgb565", "3_2x40.rgb565", "_SUCCESS"]
    sinks.write_rasters(df.limit(0), str(tmp_path / "none"), "ppm")
    assert listed(tmp_path / "none") == ["_SUCCESS"]


def test_a_failed_job_leaves_no_file(spark, tmp_path):
    from reelspark.sources import sinks

    rows = [(f"f{i}", k, b"x" * 10) for i in range(6) for k in range(3)] + [("bad/name", 0, b"y")]
    df = spark.createDataFrame(rows, "name string, at bigint, piece binary")
    with pytest.raises(Exception, match="no name of a file"):
        sinks.write_files(df, str(tmp_path / "out"))
    assert listed(tmp_path / "out") == []
    apart = spark.createDataFrame([("a", b"1"), ("b", b"2"), ("a", b"3")], "name string, piece binary").coalesce(1)
    with pytest.raises(Exception, match="stand together"):
        apart.write.format("object_files").mode("append").save(str(tmp_path / "out"))
    assert listed(tmp_path / "out") == []
    sinks.write_files(df.where("at < 2 and name <> 'bad/name'"), str(tmp_path / "out"))
    sinks.write_files(spark.createDataFrame([("f0", 0, None)], "name string, at bigint, piece binary"), str(tmp_path / "out"))
    sizes = {n: os.path.getsize(tmp_path / "out" / n) for n in listed(tmp_path / "out") if n[0] == "f"}
    assert sizes == {"f0": 0} | {f"f{i}": 20 for i in range(1, 6)}


def test_ranges_of_a_file_without_cues_begin_at_their_first_element(monkeypatch):
    cluster = bytes.fromhex("1F43B6758D" "E78103" "A388" "81000080" "AABBCCDD")
    data = bytes.fromhex("1A45DFA380" "1853806701FFFFFFFFFFFFFF") + cluster * 4000 + b"\x00" * 30
    b = lambda: ranged.Bytes(pa.BufferReader(data), len(data))
    whole, size = list(ranged.frames(b(), 0, len(data))), 500
    starts = ranged.range_starts(b(), size)
    assert len(starts) == -(-len(data) // size) and ranged.range_starts(b(), len(data)) == []
    read, plain = [0], ranged.element
    monkeypatch.setattr(ranged, "element", lambda *a: (read.__setitem__(0, read[0] + 1), plain(*a))[1])
    cut = [row for k, first in enumerate(starts) for row in ranged.frames(b(), k * size, min((k + 1) * size, len(data)), first)]
    assert cut == whole and len(whole) == 4001
    # Each range steps through its own elements, not through all before it: 3 a cluster and some for the head.
    assert read[0] < 4 * 4000 + 10 * len(starts)
    assert list(ranged.elements(b(), 0, len(data))) == [row for k, first in enumerate(starts) for row in ranged.elements(b(), k * size, min((k + 1) * size, len(data)), first)]
