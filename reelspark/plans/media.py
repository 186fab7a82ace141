"""Queries over real bytes: files are put together from the test tables as binary values and read back through the file sources."""

from __future__ import annotations

from pyspark.sql import functions as F

from reelspark.functions import syntax
from reelspark.operators import containers
from reelspark.sources import files
from reelspark.sources.views import PIXELS_SQL, pixels, sql, table, view

QUERIES, ORACLE_SQL = {}, {}
C = F.col


def _hex(value, size: int, little: bool = False):
    """A whole number as so many bytes in hex."""
    h = F.lpad(F.hex(value.cast("bigint")), 2 * size, "0")
    return F.array_join(F.transform(F.sequence(F.lit(size - 1), F.lit(0)), lambda i: F.substring(h, 2 * i + 1, F.lit(2))), "") if little else h


def _joined(rows, key: str, order: list[str], piece):
    """(key, body): the pieces of hex of a key's rows, in order, as one text. Rows are dealt out before they become pieces."""
    return rows.repartition(key).groupBy(key).agg(F.array_join(F.sort_array(F.collect_list(F.struct(*order, piece.alias("piece"))))["piece"], "").alias("body"))


def wav_media(spark, d):
    """Stereo 16-bit WAV files of the sample streams, with an odd chunk before the data; odd streams say a data size of 0."""
    both = F.concat(_hex(F.pmod(C("l"), F.lit(65536)), 2, True), _hex(F.pmod(C("r"), F.lit(65536)), 2, True))
    body = _joined(view(spark, d, "pcm"), "stream_id", ["n"], both)
    size = F.length("body") / 2
    head = F.concat(F.lit("52494646"), _hex(size + 46, 4, True), F.lit("57415645666D74201000000001000200401F0000007D0000040010004C4953540300000061626300"), F.lit("64617461"), _hex(F.when(C("stream_id") % 2 == 1, 0).otherwise(size), 4, True))
    return body.select(C("stream_id").alias("object_id"), F.unhex(F.concat(head, "body")).alias("content"))


QUERIES["wav_samples"] = lambda spark, d: files.wav_samples(wav_media(spark, d))
ORACLE_SQL["wav_samples"] = f"WITH {sql('pcm')} SELECT stream_id AS object_id, n, 0 AS ch, l AS v FROM pcm UNION ALL SELECT stream_id, n, 1, r FROM pcm"
QUERIES["wav_info"] = lambda spark, d: files.wav_info(wav_media(spark, d))
ORACLE_SQL["wav_info"] = f"WITH {sql('pcm')} SELECT stream_id AS object_id, 2 AS channels, 8000 AS sample_rate_hz, 4 AS block_align, 16 AS bit_depth, 56 AS data_offset, count(*) * 4 AS data_bytes FROM pcm GROUP BY 1"


def bmp_media(spark, d):
    """24-bit BMP files of the images, bottom line first for even ones; a header of 54 bytes."""
    even = C("img") % 2 == 0
    p = pixels(spark, d).withColumn("line", F.when(even, -C("y")).otherwise(C("y")))
    body = _joined(p, "img", ["line", "x"], F.concat(_hex(C("b"), 1), _hex(C("g"), 1), _hex(C("r"), 1)))
    tall = (F.length("body") / 48).cast("bigint")
    head = F.concat(F.lit("424D"), _hex(F.length("body") / 2 + 54, 4, True), F.lit("00000000360000002800000008000000"), _hex(F.when(even, tall).otherwise(4294967296 - tall), 4, True), F.lit("0100180000000000" + "00" * 20))
    return body.select(C("img").alias("object_id"), F.unhex(F.concat(head, "body")).alias("content"))


QUERIES["bmp_pixels"] = lambda spark, d: files.bmp_pixels(bmp_media(spark, d))
ORACLE_SQL["bmp_pixels"] = f"WITH {PIXELS_SQL} SELECT img AS object_id, x, y, r, g, b FROM pixels"


def png_chunks(spark, d):
    """Chunks of PNG files: a header, a text and an end; of every fifth the last chunk is cut."""
    text = F.hex(F.encode("text", "UTF-8"))
    t = table(spark, d, "documents").where("text is not null").select("doc_id", F.concat(F.lit("89504E470D0A1A0A0000000D49484452" + "00" * 17), _hex(F.length(text) / 2, 4), F.lit("74455874"), text, F.lit("00000000" + "0000000049454E44" + "00000000")).alias("h"))
    cut = F.when(C("doc_id") % 5 == 0, F.expr("left(h, length(h) - 2)")).otherwise(C("h"))
    return files.walk(t.select(C("doc_id").alias("object_id"), F.unhex(cut).alias("content")), "png")


QUERIES["png_chunks"] = png_chunks
ORACLE_SQL["png_chunks"] = """WITH t AS (SELECT doc_id AS object_id, strlen(text) AS n FROM documents WHERE text IS NOT NULL)
SELECT object_id, 0 AS seq, 'IHDR' AS kind, 16 AS "offset", 13 AS length FROM t UNION ALL SELECT object_id, 1, 'tEXt', 41, n FROM t
UNION ALL SELECT object_id, 2, CASE WHEN object_id % 5 = 0 THEN 'fault' ELSE 'IEND' END, CASE WHEN object_id % 5 = 0 THEN n + 45 ELSE n + 53 END, CASE WHEN object_id % 5 = 0 THEN 11 ELSE 0 END FROM t"""


def adts_frames(spark, d):
    """ADTS frames of objects, each after two bytes that begin none."""
    size = C("b1") % 50 + 7
    head = F.concat(F.lit("00FFFFF150"), _hex(F.lit(128) + F.shiftright(size, 11), 1), _hex(F.shiftright(size, 3).bitwiseAND(255), 1), _hex(size.bitwiseAND(7) * 32 + 31, 1), F.lit("FC"))
    media = _joined(view(spark, d, "octets"), "object_id", ["k", "w", "b0", "b1", "b2"], F.concat(head, F.repeat(F.lit("00"), (size - 7).cast("int"))))
    return files.walk(media.select("object_id", F.unhex("body").alias("content")), "adts")


QUERIES["adts_frames"] = adts_frames
ORACLE_SQL["adts_frames"] = f"""WITH {sql('octets')}, f AS (SELECT object_id, b1 % 50 + 7 AS length, row_number() OVER w - 1 AS seq, sum(b1 % 50 + 9) OVER w AS stop FROM octets WINDOW w AS (PARTITION BY object_id ORDER BY k, w, b0, b1, b2 ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
SELECT object_id, seq, 'frame' AS kind, (stop - length)::BIGINT AS "offset", length FROM f"""


def mp3_frames(spark, d):
    """MPEG-1 Layer III frames of 32 to 48 kbit/s and 44.1 kHz after an ID3 tag of five bytes; the last is cut by one byte."""
    kbps = C("b1") % 3 + 1
    size = F.floor(144000 * F.get(F.array(F.lit(32), F.lit(40), F.lit(48)), (kbps - 1).cast("int")) / 44100) + C("b2") % 2
    head = F.concat(F.lit("FFFB"), _hex(kbps * 16 + C("b2") % 2 * 2, 1), F.lit("00"))
    media = _joined(view(spark, d, "octets"), "object_id", ["k", "w", "b0", "b1", "b2"], F.concat(head, F.repeat(F.lit("00"), (size - 4).cast("int"))))
    return files.walk(media.select("object_id", F.unhex(F.concat(F.lit("4944330300000000000511223344AA"), F.expr("left(body, length(body) - 2)"))).alias("content")), "mp3")


QUERIES["mp3_frames"] = mp3_frames
ORACLE_SQL["mp3_frames"] = f"""WITH {sql('octets')}, s AS (SELECT *, 144000 * ([32, 40, 48])[b1 % 3 + 1] // 44100 + b2 % 2 AS size FROM octets),
f AS (SELECT object_id, size, row_number() OVER w - 1 AS seq, sum(size) OVER w AS stop, count(*) OVER (PARTITION BY object_id) AS n FROM s WINDOW w AS (PARTITION BY object_id ORDER BY k, w, b0, b1, b2 ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
SELECT object_id, seq, CASE WHEN seq = n - 1 THEN 'fault' ELSE 'frame' END AS kind, (stop - size + 15)::BIGINT AS "offset", CASE WHEN seq = n - 1 THEN size - 1 ELSE size END AS length FROM f"""


def nal_reframe(spark, d):
    """Length-prefixed units of 1, 2 or 4 bytes of length walked, and one Annex B stream made of them after the object's parameter sets."""
    width = F.get(F.array(F.lit(1), F.lit(2), F.lit(4)), (C("object_id") % 3).cast("int"))
    x = view(spark, d, "octets")
    unit = F.concat(_hex(C("b0"), 1), F.repeat(_hex(C("b2"), 1), (C("b1") % 40).cast("int")))
    sized = lambda n: F.concat(_hex(F.length(unit) / 2, n), unit)
    media = _joined(x, "object_id", ["k", "w", "b0", "b1", "b2"], F.when(width == 1, sized(1)).when(width == 2, sized(2)).otherwise(sized(4)))
    media = media.select("object_id", F.unhex("body").alias("content"), width.alias("width"))
    nals = [files.walk(media.where(C("width") == w), f"nal{w}", lambda kind, size: kind == "nal") for w in (1, 2, 4)]
    told = nals[0].unionByName(nals[1]).unionByName(nals[2]).where("kind = 'nal'").select("object_id", C("seq").alias("nal_no"), F.hex("payload").alias("body"))
    return containers.to_annexb(containers.with_parameter_sets(told, media.select("object_id", F.lit("67AA").alias("sps"), F.lit("68BB").alias("pps"))))


QUERIES["nal_reframe"] = nal_reframe
ORACLE_SQL["nal_reframe"] = f"""WITH {sql('octets')}, u AS (SELECT *, printf('%02X', b0) || repeat(printf('%02X', b2), (b1 % 40)::INT) AS unit FROM octets),
s AS (SELECT object_id, '0000000167AA0000000168BB' || string_agg('00000001' || unit, '' ORDER BY k, w, b0, b1, b2) AS stream FROM u GROUP BY 1)
SELECT object_id, length(stream) // 2 AS bytes, stream FROM s"""


def _el(ident: str, payload, size=None):
    """An EBML element with a size of four bytes, in hex; size is that of the payload in bytes, where it is known."""
    if isinstance(size, int):
        return F.concat(F.lit(f"{ident}{size + 0x10000000:08X}"), payload)
    return F.concat(F.lit(ident), _hex((F.length(payload) / 2 if size is None else size) + 0x10000000, 4), payload)


def matroska_media(spark, d):
    """Matroska files of orders: a seek head, two tracks, a cluster with a laced block and simple blocks, and cues.

    object_id is the order; its lines are its blocks, of track 1 or 2. Lines are dealt to tasks by order before they become pieces.
    """
    x = view(spark, d, "octets").repartition("object_id")
    lit = lambda h: F.lit(h)
    block = F.concat(_hex(C("w") % 2 + 129, 1), _hex(C("w"), 2), F.when(C("b0") % 2 == 1, lit("80")).otherwise(lit("00")), F.repeat(_hex(C("b2"), 1), (C("b1") % 20).cast("int")))
    first = C("b1") % 200
    size = F.when(first < 127, _hex(first + 128, 1)).otherwise(_hex(first + 16384, 2))
    laced = F.concat(lit("810005"), lit("06"), lit("01"), size, F.repeat(lit("AA"), first.cast("int")), F.repeat(lit("BB"), (C("b2") % 20).cast("int")))
    laced_size = F.when(first < 127, 6).otherwise(7) + first + C("b2") % 20
    position = lambda track, of, *more: _el("B7", F.concat(_el("F7", lit(track), 1), _el("F1", _hex(of, 2), 2), *more), 13 + 6 * len(more))
    cue = _el("BB", F.concat(_el("B3", _hex(C("w"), 2), 2), position("01", C("b1")), position("02", C("b2"), _el("F0", _hex(C("b0"), 1), 1))), 49)
    order = ["k", "w", "b0", "b1", "b2"]
    pieces = F.struct(*order, _el("A3", block, 4 + C("b1") % 20).alias("simple"), _el("A0", _el("A1", laced, laced_size), 5 + laced_size).alias("laced"), cue.alias("cue"))
    lists = x.groupBy("object_id").agg(F.sort_array(F.collect_list(pieces)).alias("l"))
    all_ = lists.select("object_id", *(F.array_join(C("l")[f], "").alias(f) for f in ("laced", "simple", "cue")))
    seek = _el("114D9B74", F.concat(_el("4DBB", F.concat(_el("53AB", lit("1C53BB6B"), 4), _el("53AC", _hex(C("object_id") % 65536, 2), 2)), 18), _el("4DBB", F.concat(_el("53AB", lit("1654AE6B"), 4), _el("53AC", lit("20"), 1)), 17)), 47)
    h264, aac = b"V_MPEG4/ISO/AVC".hex().upper(), b"A_AAC".hex().upper()
    video = _el("AE", F.concat(_el("D7", lit("01"), 1), _el("83", lit("01"), 1), _el("86", lit(h264), 15), _el("E0", F.concat(_el("B0", lit("0280"), 2), _el("BA", _hex(C("object_id") % 1000 + 1, 2), 2)), 14)), 51)
    audio = _el("AE", F.concat(_el("D7", lit("02"), 1), _el("83", lit("02"), 1), _el("86", lit(aac), 5), _el("E1", F.concat(_el("B5", lit("472C4400"), 4), _el("9F", lit("02"), 1)), 15)), 42)
    cluster = _el("1F43B675", F.concat(_el("E7", _hex(C("object_id") % 65536, 2), 2), C("laced"), C("simple")), 7 + (F.length("laced") + F.length("simple")) / 2)
    body = F.concat(seek, _el("1654AE6B", F.concat(video, audio), 103), cluster, _el("1C53BB6B", C("cue"), F.length("cue") / 2))
    return all_.select("object_id", F.unhex(F.concat(lit("1A45DFA380"), lit("1853806701FFFFFFFFFFFFFF"), body)).alias("content"))


def matroska(spark, d, kinds=None):
    return files.matroska(matroska_media(spark, d), kinds)


QUERIES["matroska_tracks"] = lambda spark, d: files.matroska_tracks(matroska(spark, d, files.TRACK_KINDS))
ORACLE_SQL["matroska_tracks"] = f"""WITH {sql('octets')}, o AS (SELECT DISTINCT object_id FROM octets)
SELECT object_id, 1 AS track, 'V_MPEG4/ISO/AVC' AS codec_id, 'h264' AS codec, 'video' AS kind, 640 AS width, object_id % 1000 + 1 AS height, NULL::BIGINT AS sample_rate_hz, NULL::BIGINT AS channels, true AS selected FROM o
UNION ALL SELECT object_id, 2, 'A_AAC', 'aac', 'audio', NULL, NULL, 44100, 2, true FROM o"""
QUERIES["matroska_cues"] = lambda spark, d: files.cue_positions(matroska_media(spark, d))
ORACLE_SQL["matroska_cues"] = f"""WITH {sql('octets')} SELECT object_id, w AS ticks, 1 AS track, b1 AS position, NULL::BIGINT AS relative FROM octets UNION ALL SELECT object_id, w, 2, b2, b0 FROM octets"""


def matroska_seek_entries(spark, d):
    """The seek head's entries with the segment's base, from one walk of the files."""
    elements = matroska(spark, d, ("18538067", "4DBB", "53AB", "53AC")).repartition("object_id")
    return files.matroska_seek_entries(elements).join(files.matroska_segments(elements), "object_id")


QUERIES["matroska_seek_entries"] = matroska_seek_entries
ORACLE_SQL["matroska_seek_entries"] = f"""WITH {sql('octets')}, o AS (SELECT DISTINCT object_id FROM octets)
SELECT object_id, '1C53BB6B' AS element_id, object_id % 65536 AS position, 17 AS data_offset FROM o UNION ALL SELECT object_id, '1654AE6B', 32, 17 FROM o"""
QUERIES["matroska_frames"] = lambda spark, d: files.matroska_frames(matroska_media(spark, d)).select("object_id", "track", "ts", "keyframe", "lacing", "frame", F.length("payload").alias("bytes"), "fault")
ORACLE_SQL["matroska_frames"] = f"""WITH {sql('octets')}, c AS (SELECT *, object_id % 65536 AS t FROM octets)
SELECT object_id, (w % 2 + 1)::BIGINT AS track, t + CASE WHEN w >= 32768 THEN w - 65536 ELSE w END AS ts, b0 % 2 = 1 AS keyframe, 0 AS lacing, 0 AS frame, (b1 % 20)::INT AS bytes, false AS fault FROM c
UNION ALL SELECT object_id, 1, t + 5, false, 3, 0, (b1 % 200)::INT, false FROM c UNION ALL SELECT object_id, 1, t + 5, false, 3, 1, (b2 % 20)::INT, false FROM c"""


def configuration_sets(spark, d):
    """H.264 configuration records: length size, first parameter sets, and whether a decoder takes them; every seventh is cut."""
    x = view(spark, d, "octets")
    sps, pps = F.repeat(_hex(C("b0"), 1), (C("b1") % 150).cast("int")), F.repeat(_hex(C("b1"), 1), (C("b2") % 9).cast("int"))
    sized = lambda h: F.concat(_hex(F.length(h) / 2, 2), h)
    n = C("w") % 3
    h = F.concat(F.lit("0164001F"), _hex(C("w") % 4 + 252, 1), _hex(n + 224, 1), F.when(n > 0, sized(sps)).otherwise(""), F.when(n > 1, F.lit("0001EE")).otherwise(""), F.lit("01"), sized(pps))
    cut = F.when(C("k") == 7, F.expr("left(h, length(h) - 2)")).otherwise(C("h"))
    r = x.select("object_id", "k", h.alias("h")).select("object_id", "k", F.unhex(cut).alias("c")).select("object_id", "k", syntax.avcc(C("c")).alias("r"))
    return r.select("object_id", "k", C("r.nal_length"), F.hex("r.sps").alias("sps"), F.hex("r.pps").alias("pps"), syntax.adoptable(C("r")).alias("adopted"))


QUERIES["configuration_sets"] = configuration_sets
ORACLE_SQL["configuration_sets"] = f"""WITH {sql('octets')}, x AS (SELECT *, k <> 7 AND w % 3 > 0 AND b1 % 150 > 0 AND b2 % 9 > 0 AS ok FROM octets)
SELECT object_id, k, CASE WHEN ok THEN (w % 4 + 1)::INT END AS nal_length, CASE WHEN ok THEN repeat(printf('%02X', b0), (b1 % 150)::INT) END AS sps, CASE WHEN ok THEN repeat(printf('%02X', b1), (b2 % 9)::INT) END AS pps, ok AND b1 % 150 <= 128 AS adopted FROM x"""


def hevc_configuration_sets(spark, d):
    """H.265 configuration records: length size and the first set of each kind; records of 22 bytes, and every seventh, are none."""
    x = view(spark, d, "octets")
    of = lambda code, count, h: F.concat(F.lit(code), F.lit(count), F.concat(_hex(F.length(h) / 2, 2), h), F.lit("0002FFFF" if count == "0002" else ""))
    body = F.concat(of("A0", "0001", _hex(C("b0"), 1)), of("21", "0002", F.repeat(_hex(C("b1"), 1), (C("b2") % 9).cast("int"))), F.when(C("w") % 3 == 0, F.lit("270000")).otherwise(of("22", "0001", _hex(C("b2"), 1))))
    h = F.concat(F.when(C("w") % 5 == 0, "02").otherwise("01"), F.lit("00" * 20), _hex(C("w") % 4 + 252, 1), F.lit("03"), body)
    cut = F.when(C("k") == 7, F.expr("left(h, length(h) - 2)")).otherwise(C("h"))
    r = x.select("object_id", "k", h.alias("h")).select("object_id", "k", F.unhex(cut).alias("c")).select("object_id", "k", syntax.hvcc(C("c")).alias("r"))
    return r.select("object_id", "k", C("r.nal_length"), F.hex("r.vps").alias("vps"), F.hex("r.sps").alias("sps"), F.hex("r.pps").alias("pps"))


QUERIES["hevc_configuration_sets"] = hevc_configuration_sets
ORACLE_SQL["hevc_configuration_sets"] = f"""WITH {sql('octets')}, x AS (SELECT *, k <> 7 AND w % 5 <> 0 AS ok FROM octets)
SELECT object_id, k, CASE WHEN ok THEN (w % 4 + 1)::INT END AS nal_length, CASE WHEN ok THEN printf('%02X', b0) END AS vps, CASE WHEN ok THEN repeat(printf('%02X', b1), (b2 % 9)::INT) END AS sps, CASE WHEN ok AND w % 3 <> 0 THEN printf('%02X', b2) END AS pps FROM x"""
