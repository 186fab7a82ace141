"""Sniffing, container and NAL queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from reelspark.functions import bitstream
from reelspark.operators import containers
from reelspark.sources.views import HEADS_SQL, heads, sql, table, view

QUERIES, ORACLE_SQL = {}, {}
C = F.col


def sniff_format(spark, d):
    x = heads(spark, d).withColumn("format", bitstream.sniff(C("content")))
    return x.select("object_id", bitstream.family(C("format")).alias("family"), "format")


QUERIES["sniff_format"] = sniff_format
ORACLE_SQL["sniff_format"] = f"""WITH {HEADS_SQL}, s AS (SELECT object_id, CASE WHEN length(h) < 4 THEN 'detecting' WHEN h LIKE '1A45DFA3%' THEN 'matroska' WHEN h LIKE '424D%' THEN 'bmp' WHEN h LIKE '47494638%' THEN 'gif'
  WHEN h LIKE '89504E470D0A1A0A%' THEN 'png' WHEN h LIKE 'FFD8FF%' THEN 'jpeg' WHEN h LIKE '52494646%' THEN 'wav' WHEN h LIKE '494433%' THEN 'mp3'
  WHEN h LIKE 'FF%' AND (b & 224) = 224 AND ((b >> 1) & 3) = 1 THEN 'mp3' WHEN h LIKE 'FF%' AND (b & 240) = 240 AND (b & 6) = 0 THEN 'aac' WHEN length(h) >= 16 THEN 'pcm' ELSE 'detecting' END AS format
  FROM (SELECT *, CASE WHEN length(h) >= 4 THEN ('0x' || substr(h, 3, 2))::INT END AS b FROM heads))
SELECT object_id, CASE WHEN format IN ('bmp', 'gif', 'png', 'jpeg') THEN 'image' WHEN format = 'matroska' THEN 'video' WHEN format = 'detecting' THEN 'unknown' ELSE 'audio' END AS family, format FROM s"""

# CodecIDs, known and unknown.
CODEC_IDS = ("A_AAC", "A_AAC/MPEG4/LC", "A_MPEG/L3", "A_MPEG/L2", "A_AC3", "A_AC3/BSID9", "A_AC3X", "A_EAC3", "A_DTS/LOSSLESS", "A_TRUEHD", "A_MLP", "A_FLAC", "A_OPUS", "A_VORBIS", "A_PCM/INT/LIT", "A_PCM/INT/BIG",
             "A_REAL", "V_MPEG4/ISO/AVC", "V_MPEGH/ISO/HEVC", "V_VP9", "S_TEXT/UTF8", "", "V_MPEG4/ISO/ASP", "A_PCM/FLOAT/IEEE", "a_aac")
_IDS = f"([{', '.join(repr(c) for c in CODEC_IDS)}])"
_CODEC = """CASE WHEN c LIKE 'A\\_AAC%' ESCAPE '\\' THEN 'aac' WHEN c = 'A_MPEG/L3' THEN 'mp3' WHEN c IN ('A_MPEG/L2', 'A_MPEG/L1') THEN 'mp2' WHEN c = 'A_AC3' OR starts_with(c, 'A_AC3/') THEN 'ac3' WHEN c = 'A_EAC3' THEN 'eac3'
  WHEN starts_with(c, 'A_DTS') THEN 'dts' WHEN c = 'A_TRUEHD' OR starts_with(c, 'A_MLP') THEN 'truehd' WHEN c = 'A_FLAC' THEN 'flac' WHEN c = 'A_OPUS' THEN 'opus' WHEN starts_with(c, 'A_VORBIS') THEN 'vorbis'
  WHEN starts_with(c, 'A_PCM/INT/LIT') THEN 'pcm_s16le' WHEN starts_with(c, 'A_PCM/INT/BIG') THEN 'pcm_s16be' WHEN starts_with(c, 'A_') THEN 'other' END"""
_VIDEO = "CASE c WHEN 'V_MPEG4/ISO/AVC' THEN 'h264' WHEN 'V_MPEGH/ISO/HEVC' THEN 'h265' END"


def codec_id_map(spark, d):
    ids = F.array(*[F.lit(c) for c in CODEC_IDS])
    n = table(spark, d, "part").select(C("p_partkey").alias("track"), F.get(ids, (C("p_partkey") % len(CODEC_IDS)).cast("int")).alias("c"))
    return n.select("track", C("c").alias("codec_id"), F.coalesce(bitstream.video_codec(C("c")), bitstream.audio_codec(C("c"))).alias("codec"), bitstream.kind(C("c")).alias("kind"))


QUERIES["codec_id_map"] = codec_id_map
ORACLE_SQL["codec_id_map"] = f"""WITH n AS (SELECT p_partkey AS track, {_IDS}[p_partkey % {len(CODEC_IDS)} + 1] AS c FROM part)
SELECT track, c AS codec_id, coalesce({_VIDEO}, {_CODEC}) AS codec, CASE WHEN {_VIDEO} IS NOT NULL THEN 'video' WHEN {_CODEC} IS NOT NULL THEN 'audio' END AS kind FROM n"""


def track_select(spark, d):
    ids = F.array(*[F.lit(c) for c in CODEC_IDS])
    t = view(spark, d, "octets").select((C("object_id") % 500).alias("object_id"), (C("object_id") * 8 + C("k")).alias("track"), F.get(ids, (C("w") % len(CODEC_IDS)).cast("int")).alias("codec_id"))
    return containers.select_tracks(t).where("kind is not null")


QUERIES["track_select"] = track_select
ORACLE_SQL["track_select"] = f"""WITH {sql('octets')}, t AS (SELECT object_id % 500 AS object_id, object_id * 8 + k AS track, {_IDS}[w % {len(CODEC_IDS)} + 1] AS c FROM octets),
n AS (SELECT *, CASE WHEN {_VIDEO} IS NOT NULL THEN 'video' WHEN {_CODEC} IS NOT NULL THEN 'audio' END AS kind FROM t)
SELECT object_id, track, c AS codec_id, kind, row_number() OVER (PARTITION BY object_id, kind ORDER BY track, c) = 1 AS selected FROM n WHERE kind IS NOT NULL"""


def ebml_varint(spark, d):
    """Width and value of EBML numbers of up to eight bytes, whether they are of unknown size, and time scales; -1 for none."""
    x = view(spark, d, "octets")
    w = bitstream.ebml_width(C("b0"))
    tail = ((C("b1") * 256 + C("b2")) * 65536 + C("w")) * 16777216 + (C("object_id") * 31 + C("k")) % 16777216
    y = x.select("object_id", "k", "b0", "w", w.cast("int").alias("width"), tail.alias("tail"))
    rest = F.expr("shiftright(tail, 8 * (8 - width))")
    ones = F.pow(F.lit(2), 7 * C("width")).cast("bigint") - 1
    y = y.select("object_id", "k", "width", F.coalesce(bitstream.ebml_value(C("b0"), rest), F.lit(-1)).alias("value"), ones.alias("ones"), "w")
    return y.select("object_id", "k", "width", "value", (C("value") == C("ones")).alias("unknown"), bitstream.timescale(C("w") * 100).alias("timescale"), bitstream.track_id(C("w") * 2).alias("track"))


QUERIES["ebml_varint"] = ebml_varint
ORACLE_SQL["ebml_varint"] = f"""WITH {sql('octets')}, x AS (SELECT *, CASE WHEN b0 > 0 THEN 9 - length(bin(b0)) ELSE 0 END AS width, ((b1 * 256 + b2) * 65536 + w) * 16777216 + (object_id * 31 + k) % 16777216 AS tail FROM octets),
y AS (SELECT *, CASE WHEN width > 0 THEN (b0 - (1 << (8 - width)::INT)) * (1::BIGINT << (8 * (width - 1))::INT) + (tail >> (8 * (8 - width))::INT) ELSE -1 END AS value FROM x)
SELECT object_id, k, width::INT AS width, value, value = (1::BIGINT << (7 * width)::INT) - 1 AS "unknown", CASE WHEN w > 0 THEN 1000000000 // (w * 100) ELSE 0 END AS timescale, CASE WHEN w * 2 BETWEEN 1 AND 65535 THEN w * 2 END AS track FROM y"""

QUERIES["cluster_time"] = lambda spark, d: containers.cluster_time(view(spark, d, "elements"))
ORACLE_SQL["cluster_time"] = f"""WITH {sql('elements')}, t AS (SELECT *, val + last_value(CASE WHEN kind = 'cluster' THEN val END IGNORE NULLS) OVER (PARTITION BY object_id ORDER BY off ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS ts FROM elements)
SELECT object_id, off, ts, flags & 128 <> 0 AS keyframe FROM t WHERE kind <> 'cluster' AND ts IS NOT NULL"""


def keyframe_interval(spark, d):
    """Access units and keyframes of each object, and the mean ticks from one keyframe to the next, rounded down."""
    t = containers.cluster_time(view(spark, d, "elements"))
    keys = F.count(F.when(C("keyframe"), 1))
    span = F.max(F.when(C("keyframe"), C("ts"))) - F.min(F.when(C("keyframe"), C("ts")))
    return t.groupBy("object_id").agg(F.count("*").alias("units"), keys.alias("keyframes"), F.when(keys > 1, F.floor(span / (keys - 1))).alias("interval"))


QUERIES["keyframe_interval"] = keyframe_interval
ORACLE_SQL["keyframe_interval"] = f"WITH t AS ({ORACLE_SQL['cluster_time']}) SELECT object_id, count(*) AS units, count(*) FILTER (WHERE keyframe) AS keyframes, CASE WHEN count(*) FILTER (WHERE keyframe) > 1 THEN (max(ts) FILTER (WHERE keyframe) - min(ts) FILTER (WHERE keyframe)) // (count(*) FILTER (WHERE keyframe) - 1) END AS \"interval\" FROM t GROUP BY 1"


def lacing(spark, d):
    """Sizes of laced frames, equal and Xiph-coded, as text; null for laces that do not add up."""
    x = view(spark, d, "octets")
    octets = F.array(F.lit(255).cast("bigint"), C("b0"), C("b1"), F.lit(255).cast("bigint"), F.lit(255).cast("bigint"), C("b2") % 255)
    return x.select("object_id", "k", F.array_join(containers.fixed_lace(C("w"), C("k") + 1), ",").alias("fixed"), F.array_join(containers.xiph_lace(octets, C("w") % 2000), ",").alias("xiph"))


QUERIES["lacing"] = lacing
ORACLE_SQL["lacing"] = f"""WITH {sql('octets')}, s AS (SELECT *, w % 2000 AS p, CASE WHEN b0 = 255 AND b1 = 255 THEN [1275 + b2 % 255] WHEN b0 = 255 THEN [510 + b1, 510 + b2 % 255] WHEN b1 = 255 THEN [255 + b0, 765 + b2 % 255] ELSE [255 + b0, b1, 510 + b2 % 255] END AS z FROM octets)
SELECT object_id, k, CASE WHEN w % (k + 1) = 0 THEN array_to_string(list_transform(range(k + 1), lambda i: w // (k + 1)), ',') END AS fixed,
  CASE WHEN list_sum(z) <= p THEN array_to_string(list_append(z, p - list_sum(z)), ',') END AS xiph FROM s"""


def ebml_lacing(spark, d):
    x = view(spark, d, "octets")
    sizes = containers.ebml_lace(C("b0"), F.array(C("b1") % 128, C("w") % 16384), F.array(F.lit(1), F.lit(2)), F.lit(20000))
    return x.select("object_id", "k", F.array_join(sizes, ",").alias("sizes"))


QUERIES["ebml_lacing"] = ebml_lacing
ORACLE_SQL["ebml_lacing"] = f"""WITH {sql('octets')}, s AS (SELECT *, b0 + b1 % 128 - 63 AS y, b0 + b1 % 128 - 63 + w % 16384 - 8191 AS z FROM octets)
SELECT object_id, k, CASE WHEN y >= 0 AND z >= 0 AND b0 + y + z <= 20000 THEN concat_ws(',', b0, y, z, 20000 - b0 - y - z) END AS sizes FROM s"""


def cue_seek(spark, d):
    cues = view(spark, d, "elements").where("kind = 'cluster'").select("object_id", C("val").alias("ticks"), C("off").alias("position"))
    wanted = table(spark, d, "orders").select((C("o_orderkey") % 97).alias("object_id"), C("o_orderkey").alias("request"), (C("o_custkey") * 900).alias("ticks"))
    return containers.seek(cues, wanted)


QUERIES["cue_seek_asof"] = cue_seek
ORACLE_SQL["cue_seek_asof"] = f"""WITH {sql('elements')}, cues AS (SELECT object_id, val AS ticks, max(off) AS position FROM elements WHERE kind = 'cluster' GROUP BY 1, 2), wanted AS (SELECT o_orderkey % 97 AS object_id, o_orderkey AS request, o_custkey * 900 AS ticks FROM orders)
SELECT w.object_id, w.request, w.ticks, c.ticks AS cue_ticks, c.position FROM wanted w ASOF LEFT JOIN cues c ON w.object_id = c.object_id AND w.ticks >= c.ticks"""


def annexb(spark, d):
    """Length-prefixed NAL units joined to Annex B, split again, and stripped of emulation bytes."""
    nals = view(spark, d, "octets").select("object_id", C("k").alias("nal_no"), F.concat(F.lpad(F.hex(C("b0") + 0), 2, "0"), F.when(C("b1") % 2 == 0, "000003").otherwise(""), F.lpad(F.hex(C("b2")), 2, "0"), F.lit("7F")).alias("body"))
    out = containers.to_annexb(nals).withColumn("nals", containers.split_annexb(C("stream")))
    return out.select("object_id", "bytes", F.md5("stream").alias("stream_md5"), F.size("nals").alias("n"), F.array_join(F.transform("nals", lambda b: containers.strip_emulation(b)), ",").alias("bodies"))


QUERIES["annexb"] = annexb
ORACLE_SQL["annexb"] = f"""WITH {sql('octets')}, n AS (SELECT object_id, k, printf('%02X', b0::INT) || CASE WHEN b1 % 2 = 0 THEN '000003' ELSE '' END || printf('%02X7F', b2::INT) AS body,
  printf('%02X', b0::INT) || CASE WHEN b1 % 2 = 0 THEN '0000' ELSE '' END || printf('%02X7F', b2::INT) AS bare FROM octets)
SELECT object_id, (sum(length(body) // 2 + 4))::BIGINT AS bytes, md5(string_agg('00000001' || body, '' ORDER BY k, body)) AS stream_md5, count(*)::INT AS n, string_agg(bare, ',' ORDER BY k, body) AS bodies FROM n GROUP BY 1"""


def bitrate_hist(spark, d):
    u = view(spark, d, "units")
    return u.groupBy("stream_id", F.floor(C("pts") / 8000).alias("second")).agg(F.sum(C("samples") * 8).alias("bits"), F.count("*").alias("units"))


QUERIES["bitrate_hist"] = bitrate_hist
ORACLE_SQL["bitrate_hist"] = f"WITH {sql('units')} SELECT stream_id, pts // 8000 AS second, sum(samples * 8)::BIGINT AS bits, count(*) AS units FROM units GROUP BY 1, 2"
