"""Media operators: every query against its SQL on the smallest tables, whole domains by brute force, and files written here."""

import os
import struct
import zlib

import pytest
from pyspark.sql import functions as F

from reelspark.functions import audio, bitstream, raster
from reelspark.operators import containers, pictures
from reelspark.plans import registry
from reelspark.sources import files
from reelspark.streaming import records as live

TABLES = "/root/testdata/sf0.001"
duckdb = pytest.importorskip("duckdb")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(TABLES):
        con.execute(f"create view {f.split('.')[0]} as select * from '{TABLES}/{f}'")
    return con


def plain(v):
    return round(v, 9) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query_equals_its_sql(spark, duck, name):
    got = registry.queries()[name](spark, TABLES)
    want = duck.sql(registry.oracle_sql()[name])
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    rows = sorted((tuple(plain(x) for x in r) for r in got.select(*columns).collect()), key=repr)
    assert rows and rows == sorted((tuple(plain(r[want.columns.index(c)]) for c in columns) for r in want.fetchall()), key=repr)


def ulaw(x):
    m, u = min(abs(x), 32635) + 132, 128 if x < 0 else 0
    seg = max(0, m.bit_length() - 8)
    return ~(u | seg << 4 | (m >> seg + 3) & 15) & 255


def test_companding_over_its_whole_domain(spark):
    s = spark.range(65536).select((F.col("id") - 32768).cast("int").alias("x"))
    rows = s.select("x", audio.ulaw_encode(F.col("x")).alias("u"), audio.alaw_encode(F.col("x")).alias("a")).collect()
    assert all(r.u == ulaw(r.x) for r in rows)
    codes = spark.range(256).select(F.col("id").cast("int").alias("c"))
    back = codes.select("c", audio.ulaw_encode(audio.ulaw_decode(F.col("c"))).alias("u"), audio.alaw_encode(audio.alaw_decode(F.col("c"))).alias("a")).collect()
    assert [r.c for r in back if r.u != r.c] == [127] and all(r.a == r.c for r in back)
    law = {r.c: r.d for r in codes.select("c", audio.alaw_decode(F.col("c")).alias("d")).collect()}
    heard = [law[r.a] for r in rows]
    assert heard == sorted(heard)


def test_context_states_over_their_whole_domain(spark):
    got = spark.range(256 * 52).select((F.col("id") % 256).cast("int").alias("v"), F.floor(F.col("id") / 256).cast("int").alias("q")).select("v", "q", bitstream.cabac_context(F.col("v"), F.col("q")).alias("c")).collect()
    for r in got:
        pre = max(1, min(126, (((r.v >> 4) * 5 - 45) * r.q >> 4) + ((r.v & 15) << 3) - 16))
        assert (r.c.state, r.c.mps) == ((pre - 64, 1) if pre > 63 else (63 - pre, 0))


def test_interlaced_lines(spark):
    for h in (1, 2, 3, 5, 8, 17, 64):
        want = [*range(0, h, 8), *range(4, h, 8), *range(2, h, 4), *range(1, h, 2)]
        got = spark.range(h).select("id", raster.interlace_row(F.col("id"), F.lit(h)).alias("y")).orderBy("id").collect()
        assert [r.y for r in got] == want


def test_nulls_and_empty_tables(spark):
    assert spark.createDataFrame([(None,)], "b binary").select(bitstream.sniff(F.col("b"))).first()[0] == "detecting"
    empty = spark.createDataFrame([], "stream_id bigint, n bigint, lsb bigint, tid bigint, idr boolean")
    assert pictures.picture_order(empty, 4).count() == 0


def test_emulation_bytes_and_start_codes(spark):
    row = spark.createDataFrame([("0000010900000167000003010000010068",)], "s string").select(containers.split_annexb(F.col("s")).alias("n")).first()
    assert row.n == ["09", "6700000301", "0068"]
    assert spark.range(1).select(containers.strip_emulation(F.lit("67000003010000030003"))).first()[0] == "6700000100000003"


# -- files

def wav(samples, channels=2, rate=8000, extra=b"", size=None):
    data = struct.pack(f"<{len(samples)}h", *samples)
    fmt = struct.pack("<HHIIHH", 1, channels, rate, rate * channels * 2, channels * 2, 16)
    return b"RIFF\0\0\0\0WAVE" + extra + b"fmt " + struct.pack("<I", 16) + fmt + b"data" + struct.pack("<I", len(data) if size is None else size) + data


def test_wav_samples(spark):
    samples = [(i * 77) % 65536 - 32768 for i in range(10_000)]
    media = [("a", wav(samples, extra=b"odd " + struct.pack("<I", 3) + b"xyz\0")), ("b", wav([1, -2, 3], 1, size=0)), ("c", b"RIFF"), ("d", None), ("e", b"")]
    df = spark.createDataFrame(media, "object_id string, content binary")
    got = {}
    for r in files.wav_samples(df).collect():
        got.setdefault(r.object_id, {})[r.n, r.ch] = r.v
    assert got["a"] == {(i // 2, i % 2): v for i, v in enumerate(samples)} and got["b"] == {(0, 0): 1, (1, 0): -2, (2, 0): 3} and set(got) == {"a", "b"}


def test_bmp_pixels(spark):
    def bmp(w, h, up):
        lines = [bytes(c for x in range(w) for c in (x, y, x + y)) + b"\0" * (-w * 3 % 4) for y in range(h)]
        return b"BM" + struct.pack("<IHHIIiiHHIIIIII", 0, 0, 0, 54, 40, w, h if up else -h, 1, 24, 0, 0, 0, 0, 0, 0) + b"".join(lines[::-1] if up else lines)

    df = spark.createDataFrame([("up", bmp(3, 2, True)), ("down", bmp(5, 4, False)), ("cut", bmp(3, 2, False)[:-5]), ("no", b"BM")], "object_id string, content binary")
    got = {(r.object_id, r.x, r.y): (r.b, r.g, r.r) for r in files.bmp_pixels(df).collect()}
    assert {k: v for k, v in got.items() if k[0] != "cut"} == {(n, x, y): (x, y, x + y) for n, w, h in (("up", 3, 2), ("down", 5, 4)) for x in range(w) for y in range(h)}
    assert len([k for k in got if k[0] == "cut"]) == 3


def test_png_and_audio_frames(spark):
    chunk = lambda k, b: struct.pack(">I", len(b)) + k + b + struct.pack(">I", zlib.crc32(k + b))
    png = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", bytes(13)) + chunk(b"IDAT", zlib.compress(b"x")) + chunk(b"IEND", b"")
    adts = lambda n: bytes([0xFF, 0xF1, 0x50, 0x80 | n + 7 >> 11, n + 7 >> 3 & 255, (n + 7 & 7) << 5 | 31, 0xFC]) + bytes(n)
    mp3 = struct.pack(">I", 0xFFFB9000) + bytes(413)
    walk = lambda how, b: [(r.kind, r.offset, r.length) for r in files.walk(spark.createDataFrame([("x", b)], "object_id string, content binary"), how).orderBy("seq").collect()]
    assert [k for k, *_ in walk("png", png)] == ["IHDR", "IDAT", "IEND"] and walk("png", png[:40])[-1][0] == "fault"
    assert walk("adts", b"zz" + adts(20) + adts(9) + adts(30)[:-1]) == [("frame", 2, 27), ("frame", 29, 16), ("fault", 45, 36)]
    assert walk("mp3", b"ID3\3\0\0\0\0\0\5hello" + mp3 + mp3) == [("frame", 15, 417), ("frame", 432, 417)]


def el(ident, payload, size=None):
    i = bytes.fromhex(ident)
    return i + (struct.pack(">Q", 1 << 56 | len(payload)) if size is None else size) + payload


def test_matroska_tracks_and_blocks(spark):
    video = el("AE", el("D7", b"\1") + el("86", b"V_MPEG4/ISO/AVC") + el("E0", el("B0", b"\2\x80") + el("BA", b"\1\xe0")))
    sound = el("AE", el("D7", b"\2") + el("86", b"A_AAC") + el("E1", el("B5", struct.pack(">d", 44100.7)) + el("9F", b"\2")))
    other = el("AE", el("D7", b"\3") + el("86", b"A_OPUS") + el("E1", el("B5", struct.pack(">f", 8000.0))))
    block = lambda track, rel, flags, body: bytes([0x80 | track]) + struct.pack(">hB", rel, flags) + body
    cluster = el("1F43B675", el("E7", b"\3\xe8") + el("A3", block(1, -5, 0x80, b"ab")) + el("A0", el("A1", block(2, 7, 0, b"c"))), size=b"\xff")
    later = el("1F43B675", el("E7", b"\x07\xd0") + el("EC", b"pad") + el("A3", block(1, 0, 0, b"")))
    data = el("1A45DFA3", b"") + el("18538067", el("1654AE6B", video + sound + other) + cluster + later, size=b"\x01" + b"\xff" * 7)
    media = spark.createDataFrame([("m", data), ("bad", data[:60] + b"\0"), ("none", None)], "object_id string, content binary")
    elements = files.matroska(media)
    tracks = {r.track: r for r in files.matroska_tracks(elements).where("object_id = 'm'").collect()}
    assert [(t.codec, t.kind, t.selected) for _, t in sorted(tracks.items())] == [("h264", "video", True), ("aac", "audio", True), ("opus", "audio", False)]
    assert (tracks[1].width, tracks[1].height, tracks[2].sample_rate_hz, tracks[3].sample_rate_hz) == (640, 480, 44100, 8000)
    blocks = files.matroska_frames(media).orderBy("seq").collect()
    assert [(b.track, b.ts, b.keyframe, bytes(b.payload)) for b in blocks] == [(1, 995, True, b"ab"), (2, 1007, False, b"c"), (1, 2000, False, b"")]


def test_matroska_blocks_of_any_length_lacing_and_track_width(spark):
    big, a, b, c = bytes(range(256)) * 80, b"a" * 300, b"b" * 20, b"c" * 20
    head = lambda track, flags: track + struct.pack(">hB", 1, flags)
    xiph = head(b"\x81", 2) + b"\2" + bytes([255, 45, 20]) + a + b + c
    fixed = head(b"\x81", 4) + b"\1" + b + c
    ebml = head(b"\x81", 6) + b"\2" + struct.pack(">HH", 0x4000 | 300, 0x4000 | 8191 - 280) + a + b + c
    bad = [head(b"\x81", 4) + b"\2" + b"1234", b"\x81\0", b"\0" * 9, b""]
    blocks = [head(b"\x81", 0x80) + big, head(b"\x20\x40\0", 0) + b"x", head(b"\1" + bytes(5) + b"\1\2", 0) + b"y", xiph, fixed, ebml, *bad]
    data = el("1F43B675", el("E7", b"\5") + b"".join(el("A3", x) for x in blocks), size=b"\xff") + el("A3", head(b"\x81", 0) + b"cut short")[:-2]
    got = files.matroska_frames(spark.createDataFrame([("m", data)], "object_id string, content binary")).orderBy("seq", "frame").collect()
    assert [bytes(r.payload) for r in got if not r.fault] == [big, b"x", b"y", a, b, c, b, c, a, b, c]
    assert [r.track for r in got[:3]] == [1, 0x4000, 0x102] and got[0].keyframe and {r.ts for r in got if not r.fault} == {6}
    assert [r.frame for r in got if r.lacing == 1] == [0, 1, 2] and [r.fault for r in got[11:]] == [True] * 5 and all(r.payload is None for r in got[11:])


# -- streams

def test_streaming_gaps_equal_the_batch_form(spark, tmp_path):
    from reelspark.operators import records
    from reelspark.sources.views import view

    units = view(spark, TABLES, "units").where("seq % 7 <> 0")
    for i in range(3):  # three files in order of seq: three micro-batches
        units.where(f"seq div 334 = {i}").coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
    source = spark.readStream.schema(units.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    query = live.fill_gaps(source).writeStream.format("memory").queryName("gaps").option("checkpointLocation", f"{tmp_path}/state").start()
    query.processAllAvailable()
    query.stop()
    got = sorted(tuple(r) for r in spark.table("gaps").select("stream_id", "seq", "silence").collect())
    want = sorted(tuple(r) for r in records.fill_gaps(units).select("stream_id", "seq", "silence").collect())
    assert got == want


def test_streaming_bitrate_closes_windows(spark, tmp_path):
    from reelspark.sources.views import view

    units = view(spark, TABLES, "units")
    units.coalesce(1).write.parquet(f"{tmp_path}/in")
    source = spark.readStream.schema(units.schema).parquet(f"{tmp_path}/in")
    query = live.bitrate(source).writeStream.outputMode("complete").format("memory").queryName("rate").start()
    query.processAllAvailable()
    query.stop()
    assert spark.table("rate").agg(F.sum("units")).first()[0] == units.count()


# -- Matroska files walked together

def test_contents_walked_together_have_the_elements_of_each_walked_alone(monkeypatch):
    import random

    import numpy as np
    import pyarrow as pa

    rng = random.Random(5)
    good = bytes.fromhex("1A45DFA380" "1853806701FFFFFFFFFFFFFF" "1C53BB6B91" "BB8F" "B38101" "B78A" "F78101" "F1820203" "F08104" "1F43B67583" "E78109")
    contents = [None, b"", b"\x00", b"\xbb", b"\xa3\xff\x01", b"\x1a\x45"] + [good[: rng.randrange(len(good) + 1)] for _ in range(60)]
    contents += [bytes(rng.choice((rng.randrange(256), o)) if rng.random() < 0.05 else o for o in good * rng.randrange(1, 4)) for _ in range(200)]
    for most in (files.WALK_BYTES, 40):  # the second makes most groups one content, and walks long contents in pieces
        monkeypatch.setattr(files, "WALK_BYTES", most)
        got = [[] for _ in contents]
        for _, rows, first in files._ebml(pa.array(contents, pa.binary())):
            for who, n, ident, at, size in rows.T.tolist():
                got[who + first].append((n, f"{ident:X}" if ident else "fault", at, size))
        assert got == [[(n, *e) for n, e in enumerate(files.ebml_elements(c or b""))] for c in contents]
        assert not np.any([len(g) for g in got[:2]])


def test_cues_of_the_walk_equal_those_of_the_elements(spark):
    point = lambda body: "BB" + f"{len(body) // 2 + 128:02X}" + body
    spots = ["B38107" "B786" "F78101" "F18109", "B786" "F78102" "F18108" "B3820301", "B380" "B789" "F78101" "F18105" "F08106" "B783" "F18103", "B38104"]
    stray = "F18111" "B783F78101"
    contents = ["1A45DFA380" "1853806701FFFFFFFFFFFFFF" + stray + "1C53BB6B01FFFFFFFFFFFFFF" + "".join(point(s) for s in spots[i % 4 :]) for i in range(40)]
    media = spark.createDataFrame([(i, bytes.fromhex(c)) for i, c in enumerate(contents)] + [(99, None)], "object_id bigint, content binary").repartition(3)
    plain = sorted(map(str, files.matroska_cues(files.matroska(media)).collect()))
    assert sorted(map(str, files.cue_positions(media).collect())) == plain and len(plain) == 10 * (4 + 3 + 2)
    kinds = files.matroska(media, ("B3", "F1")).where("kind not in ('B3', 'F1')")
    assert kinds.count() == 0
    # The walk puts cues together itself: no row is shuffled for it.
    assert "Exchange" not in files.cue_positions(media.coalesce(1).localCheckpoint())._jdf.queryExecution().executedPlan().toString()
