"""Audio and record-stream queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from reelspark.functions import audio
from reelspark.operators import records
from reelspark.sources.views import sql, view

QUERIES, ORACLE_SQL = {}, {}

_HALF = "CASE WHEN l + r < 0 THEN -((-(l + r)) >> 1) ELSE (l + r) >> 1 END"
_ULAW = """(255 - (CASE WHEN s < 0 THEN 128 ELSE 0 END + seg * 16 + ((m >> (seg + 3)::INT) & 15)))"""
_ULAW_FROM = """(SELECT *, CASE WHEN m <= 255 THEN 0 WHEN m <= 511 THEN 1 WHEN m <= 1023 THEN 2 WHEN m <= 2047 THEN 3 WHEN m <= 4095 THEN 4 WHEN m <= 8191 THEN 5 WHEN m <= 16383 THEN 6 ELSE 7 END AS seg
  FROM (SELECT *, least(abs(s), 32635) + 132 AS m FROM (SELECT *, {half} AS s FROM pcm)))"""
_ALAW = """xor((CASE WHEN s >= 0 THEN 128 ELSE 0 END + seg * 16 + (CASE WHEN seg = 0 THEN m >> 1 ELSE m >> seg::INT END & 15))::INT, 85)"""
_ALAW_FROM = """(SELECT *, CASE WHEN m < 32 THEN 0 WHEN m < 64 THEN 1 WHEN m < 128 THEN 2 WHEN m < 256 THEN 3 WHEN m < 512 THEN 4 WHEN m < 1024 THEN 5 WHEN m < 2048 THEN 6 ELSE 7 END AS seg
  FROM (SELECT *, least(CASE WHEN s >= 0 THEN s >> 3 ELSE (-s - 1) >> 3 END, 4095) AS m FROM (SELECT *, {half} AS s FROM pcm)))"""


def _mono(spark, d):
    return view(spark, d, "pcm").select("stream_id", "n", audio.mono(F.col("l"), F.col("r")).alias("sample"))


def _packets(code, source, size):
    return f"""WITH {sql('pcm')}, coded AS (SELECT stream_id, n, {code} AS o FROM {source.format(half=_HALF)})
SELECT stream_id, n // {size} * {size} AS pts, string_agg(printf('%02X', o::INT), '' ORDER BY n) AS octets, count(*)::INT AS n FROM coded GROUP BY 1, 2"""


QUERIES["g711_encode_units"] = lambda spark, d: records.packetise(_mono(spark, d), audio.ulaw_encode, 20)
ORACLE_SQL["g711_encode_units"] = _packets(_ULAW, _ULAW_FROM, 160)
QUERIES["alaw_encode_units"] = lambda spark, d: records.packetise(_mono(spark, d), audio.alaw_encode, 30)
ORACLE_SQL["alaw_encode_units"] = _packets(_ALAW, _ALAW_FROM, 240)


def g711_decode_pcm(spark, d):
    """Octets back to stereo samples (both channels the same), by either law."""
    code = (F.col("l") + 32768) % 256
    return view(spark, d, "pcm").select("stream_id", "n", audio.ulaw_decode(code).alias("ulaw_left"), audio.ulaw_decode(code).alias("ulaw_right"), audio.alaw_decode(code).alias("alaw"))


QUERIES["g711_decode_pcm"] = g711_decode_pcm
ORACLE_SQL["g711_decode_pcm"] = f"""WITH {sql('pcm')}, c AS (SELECT stream_id, n, (255 - (l + 32768) % 256)::INT AS u, xor(((l + 32768) % 256)::INT, 85) AS a FROM pcm),
x AS (SELECT *, ((u & 15) * 8 + 132) << ((u >> 4) & 7) AS t, (a >> 4) & 7 AS s, a & 15 AS q FROM c),
y AS (SELECT *, CASE WHEN u & 128 <> 0 THEN 132 - t ELSE t - 132 END AS z, (CASE WHEN s = 0 THEN q * 2 + 1 ELSE (q * 2 + 33) << greatest(s - 1, 0) END) * 8 AS v FROM x)
SELECT stream_id, n, z AS ulaw_left, z AS ulaw_right, CASE WHEN a & 128 <> 0 THEN v ELSE -v END AS alaw FROM y"""


def g711_gap_fill(spark, d):
    units = view(spark, d, "units").where("not lost")
    return records.fill_gaps(units).select("stream_id", "seq", "pts", "expected", "silence", (F.col("silence") + F.col("samples")).alias("samples_out"))


QUERIES["g711_gap_fill"] = g711_gap_fill
ORACLE_SQL["g711_gap_fill"] = f"""WITH {sql('units')}, w AS (SELECT *, lag(pts + samples) OVER (PARTITION BY stream_id ORDER BY seq) AS expected FROM units WHERE NOT lost),
f AS (SELECT *, CASE WHEN discontinuity AND pts - expected BETWEEN 1 AND {records.MAX_SILENCE} THEN pts - expected ELSE 0 END AS silence FROM w)
SELECT stream_id, seq, pts, expected, silence, silence + samples AS samples_out FROM f"""


def loudness_by_stream(spark, d):
    x = _mono(spark, d)
    return x.groupBy("stream_id").agg(F.max(F.abs("sample")).alias("peak"), F.sum(F.col("sample").cast("bigint") * F.col("sample")).alias("energy"), F.count("*").alias("samples"))


QUERIES["loudness_by_stream"] = loudness_by_stream
ORACLE_SQL["loudness_by_stream"] = f"""WITH {sql('pcm')} SELECT stream_id, max(abs(s))::INT AS peak, sum(s * s)::BIGINT AS energy, count(*) AS samples FROM (SELECT *, {_HALF} AS s FROM pcm) GROUP BY 1"""


def mp3_frame_headers(spark, d):
    word = F.lit(0xFFE00000) + F.col("b0") % 32 * 65536 + (F.col("w") + F.col("object_id") * 4099) % 65536
    x = view(spark, d, "octets").select("object_id", "k", audio.mp3_header(word).alias("h"))
    return x.where("h is not null").select("object_id", "k", "h.*")


QUERIES["mp3_frame_headers"] = mp3_frame_headers
ORACLE_SQL["mp3_frame_headers"] = f"""WITH {sql('octets')}, x AS (SELECT object_id, k, 4292870144 + b0 % 32 * 65536 + (w + object_id * 4099) % 65536 AS h FROM octets),
p AS (SELECT *, ([{', '.join(map(str, audio.MP3_KBPS))}, NULL])[((h >> 12) & 15) + 1] AS kbps, ([{', '.join(map(str, audio.MP3_RATES))}, NULL])[((h >> 10) & 3) + 1] AS rate FROM x
  WHERE (h >> 19) & 3 = 3 AND (h >> 17) & 3 = 1)
SELECT object_id, k, kbps, rate, ((h >> 9) & 1)::INT AS padding, ((h >> 6) & 3)::INT AS mode, CASE WHEN (h >> 6) & 3 = 3 THEN 1 ELSE 2 END AS channels, (h >> 16) & 1 = 0 AS has_crc,
  (144000 * kbps // rate + ((h >> 9) & 1))::INT AS frame_bytes FROM p WHERE kbps > 0 AND rate IS NOT NULL"""


def adts_framing(spark, d):
    """Raw units of a stream with an AudioSpecificConfig as ADTS frames: their headers."""
    x = view(spark, d, "octets").select("object_id", "k", audio.adts_template(F.col("w")).alias("t"), (F.col("w") % 9000).alias("payload"))
    return x.where("t is not null").select("object_id", "k", "t.*", "payload", audio.adts_header(F.col("t"), F.col("payload")).alias("header"))


QUERIES["adts_framing"] = adts_framing
ORACLE_SQL["adts_framing"] = f"""WITH {sql('octets')}, x AS (SELECT object_id, k, w % 9000 AS payload, ((w >> 11) & 31)::INT AS object_type, ((w >> 7) & 15)::INT AS sfi, ((w >> 3) & 15)::INT AS channels FROM octets)
SELECT object_id, k, object_type, sfi, channels, payload, CASE WHEN payload <= 8184 THEN printf('FFF1%02X%02X%02X%02XFC', (object_type - 1) * 64 + sfi * 4 + (channels >> 2),
  ((channels & 3) * 64 + ((payload + 7) >> 11))::INT, (((payload + 7) >> 3) & 255)::INT, (((payload + 7) & 7) * 32 + 31)::INT) END AS header
FROM x WHERE object_type BETWEEN 1 AND 4 AND sfi <= 12 AND channels BETWEEN 1 AND 7"""

_BOUND = f"""{sql('records')}, open AS (SELECT *, CASE WHEN kind <> 'UNIT' THEN seq END AS control FROM records),
last AS (SELECT *, CASE WHEN kind = 'END' THEN last_value(control IGNORE NULLS) OVER (PARTITION BY stream_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
  ELSE last_value(control IGNORE NULLS) OVER (PARTITION BY stream_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) END AS ctl FROM open),
bound AS (SELECT *, CASE WHEN ctl % 10 = 0 THEN ctl END AS bound_seq FROM last)"""
QUERIES["record_bind"] = lambda spark, d: records.bind(view(spark, d, "records")).select("stream_id", "seq", "kind", "bound_seq")
ORACLE_SQL["record_bind"] = f"WITH {_BOUND} SELECT stream_id, seq, kind, bound_seq FROM bound"
QUERIES["record_faults"] = lambda spark, d: records.faults(view(spark, d, "records"))
ORACLE_SQL["record_faults"] = f"WITH {_BOUND} SELECT stream_id, seq, kind FROM bound WHERE kind <> 'STREAM' AND bound_seq IS NULL"
QUERIES["record_reassemble"] = lambda spark, d: records.reassemble(view(spark, d, "records"))
ORACLE_SQL["record_reassemble"] = f"""WITH {_BOUND}, u AS (SELECT *, CASE WHEN lag(continues) OVER w THEN 0 ELSE 1 END AS start FROM bound WHERE kind = 'UNIT' AND bound_seq IS NOT NULL WINDOW w AS (PARTITION BY stream_id, bound_seq ORDER BY seq)),
n AS (SELECT *, sum(start) OVER (PARTITION BY stream_id, bound_seq ORDER BY seq) AS unit_no FROM u)
SELECT stream_id, bound_seq, min(seq) AS first_seq, max(seq) AS last_seq, count(*) AS fragments, sum(bytes)::BIGINT AS bytes FROM n GROUP BY stream_id, bound_seq, unit_no
HAVING NOT bool_or(truncated) AND NOT arg_max(continues, seq)"""


def video_pts(spark, d):
    clock = F.when(F.col("stream_id") % 2 == 0, 90000).otherwise(48000)
    return view(spark, d, "units").select("stream_id", "seq", records.scaled_pts(F.col("pts") * 90 - 1000, clock).alias("pts_ms"))


QUERIES["video_pts_ms"] = video_pts
ORACLE_SQL["video_pts_ms"] = f"WITH {sql('units')} SELECT stream_id, seq, (greatest(pts * 90 - 1000, 0) * (65536000 // CASE WHEN stream_id % 2 = 0 THEN 90000 ELSE 48000 END)) >> 16 AS pts_ms FROM units"


def stream_admission(spark, d):
    """Accepted and refused units by reason: whole, small enough, and of a stream that the G.711 port takes."""
    r = view(spark, d, "records").where("kind = 'UNIT'")
    codec = F.get(F.array(*[F.lit(c) for c in ("pcmu", "pcma", "aac", "mp3", "h264")]), (F.col("stream_id") % 5).cast("int"))
    reason = F.when(~codec.isin("pcmu", "pcma"), "codec").when(F.col("truncated"), "truncated").when(F.col("continues"), "fragment").when(F.col("bytes") > 1460, "size").otherwise("accepted")
    return r.select(codec.alias("codec"), reason.alias("reason"), "bytes").groupBy("codec", "reason").agg(F.count("*").alias("units"), F.sum("bytes").alias("bytes"))


QUERIES["stream_admission"] = stream_admission
ORACLE_SQL["stream_admission"] = f"""WITH {sql('records')}, c AS (SELECT *, (['pcmu', 'pcma', 'aac', 'mp3', 'h264'])[stream_id % 5 + 1] AS codec FROM records WHERE kind = 'UNIT')
SELECT codec, CASE WHEN codec NOT IN ('pcmu', 'pcma') THEN 'codec' WHEN truncated THEN 'truncated' WHEN continues THEN 'fragment' WHEN bytes > 1460 THEN 'size' ELSE 'accepted' END AS reason, count(*) AS units, sum(bytes)::BIGINT AS bytes FROM c GROUP BY 1, 2"""
