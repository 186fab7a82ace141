"""Queries of small predicates, fields and geometry, of admission and refusal, and of pictures' times."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from reelspark.functions import bitstream, syntax
from reelspark.operators import records
from reelspark.sources.views import PIXELS_SQL, pixels, sql, table, view

QUERIES, ORACLE_SQL = {}, {}
C = F.col


def colour_flags(spark, d):
    """High dynamic range, wide gamut and bit depth of streams, and the slices that the tools list."""
    x = view(spark, d, "octets")
    present = C("w") % 3 != 0
    return x.select(
        "object_id", "k", bitstream.is_hdr(present, C("b1") % 12, C("b0") % 20).alias("hdr"), syntax.is_wide_gamut(present, C("b1") % 12).alias("wide"),
        syntax.is_high_bit_depth(C("b1") % 4 + 7, C("b2") % 4 + 7).alias("deep"), syntax.is_shown_slice(C("b0") % 48).alias("shown_slice"),
        syntax.hevc_level(C("b2"))["major"].alias("level_major"), syntax.hevc_level(C("b2"))["minor"].alias("level_minor"),
    )


QUERIES["colour_flags"] = colour_flags
ORACLE_SQL["colour_flags"] = f"""WITH {sql('octets')} SELECT object_id, k, w % 3 <> 0 AND b0 % 20 IN (16, 18) AS hdr, w % 3 <> 0 AND b1 % 12 = 9 AS wide, b1 % 4 > 1 OR b2 % 4 > 1 AS deep,
  b0 % 48 IN (0, 1) OR b0 % 48 BETWEEN 16 AND 21 AS shown_slice, (b2 // 30)::INT AS level_major, (b2 % 30 // 3)::INT AS level_minor FROM octets"""


def h264_fields(spark, d):
    """H.264 predicates, whole-number division without faults, and the fields of code-table words."""
    x = view(spark, d, "octets")
    kinds, token = syntax.h264_kinds(C("b0") % 32, C("b1") % 10, C("b2") % 32, C("w") % 4), syntax.token_fields(C("w"))
    return x.select("object_id", "k", kinds.alias("is"), token.alias("t"), syntax.total_div(C("w"), C("b1") % 5).alias("quotient"), syntax.total_rem(C("w"), C("b1") % 5).alias("remainder")).select("object_id", "k", "is.*", "t.*", "quotient", "remainder")


QUERIES["h264_fields"] = h264_fields
ORACLE_SQL["h264_fields"] = f"""WITH {sql('octets')} SELECT object_id, k, b0 % 32 = 5 AS idr, b1 % 10 IN (0, 5) AS p_slice, b1 % 10 IN (2, 7) AS i_slice, b2 % 32 > 5 AS intra, b2 % 32 = 31 AS pcm,
  w % 4 <> 0 AS reference, w % 4 > 1 AS existing, w % 4 IN (1, 2) AS short_term, w % 4 = 3 AS long_term,
  (w & 31)::INT AS token_bits, ((w >> 5) & 63)::INT AS trailing_ones, ((w >> 11) & 31)::INT AS total_coeff, (w & 15)::INT AS bits, ((w >> 4) & 15)::INT AS info,
  CASE WHEN b1 % 5 = 0 THEN 0 ELSE w // (b1 % 5) END AS quotient, CASE WHEN b1 % 5 = 0 THEN 0 ELSE w % (b1 % 5) END AS remainder FROM octets"""


def picture_geometry(spark, d):
    """Tiled surfaces, shown parts and probe points of pictures, and whether their rasters fit."""
    x = view(spark, d, "octets").select("object_id", "k", (C("w") + 16).alias("width"), (C("b1") * 8 + 16).alias("height"), "b0", "b2")
    s = syntax.surface(C("width"), C("height"), F.when(C("b0") % 2 == 0, 8).otherwise(10))
    shown = syntax.crop(F.ceil(C("width") / 16), F.ceil(C("height") / 16), C("b2") % 2 == 0, C("b0") % 4, C("b0") % 3, C("b2") % 4, C("b2") % 3)
    probe = syntax.probe_point(C("b2") % 4, 64, F.floor((C("width") - 1) / 64), C("width"), C("height"))
    return x.select("object_id", "k", s.alias("s"), shown.alias("c"), probe.alias("p"), syntax.raster_fits(C("width") * 16, C("height") * 16).alias("fits")).select(
        "object_id", "k", "s.*", C("c.width").alias("shown_width"), C("c.height").alias("shown_height"), "c.left", "c.top", C("p.x").alias("probe_x"), C("p.y").alias("probe_y"), "fits"
    )


QUERIES["picture_geometry"] = picture_geometry
ORACLE_SQL["picture_geometry"] = f"""WITH {sql('octets')}, x AS (SELECT *, w + 16 AS wide, b1 * 8 + 16 AS tall, CASE WHEN b0 % 2 = 0 THEN 128 ELSE 96 END AS per FROM octets),
y AS (SELECT *, (wide + per - 1) // per AS n, (tall + 7) // 8 * 8 AS h, CASE WHEN b2 % 2 = 0 THEN 1 ELSE 0 END AS cut, (wide + 15) // 16 * 16 AS mw, (tall + 15) // 16 * 16 AS mh FROM x)
SELECT object_id, k, per AS column_pixels, n * per AS padded_width, h AS padded_height, n AS columns, h * 128 AS luma_column_bytes, n * h * 128 AS luma_plane_bytes, h * 64 AS chroma_column_bytes, n * h * 64 AS chroma_plane_bytes,
  h * 2 AS luma_stride, h AS chroma_stride, mw - cut * 2 * (b0 % 4 + b0 % 3) AS shown_width, mh - cut * 2 * (b2 % 4 + b2 % 3) AS shown_height, cut * 2 * (b0 % 4) AS "left", cut * 2 * (b2 % 4) AS "top",
  least((wide - 1) // 64 * 64 + 20, wide - 4) // 4 * 4 AS probe_x, least(b2 % 4 * 64, tall - 1) AS probe_y, wide * 16 * tall * 16 * 2 < 4294967296 AS fits FROM y"""


def macroblock_neighbours(spark, d):
    """The four neighbours of macroblocks, and how many of them are in the same slice: one array of slices for each picture."""
    mb = C("y") * 8 + C("x")
    p = pixels(spark, d).select("img", mb.alias("mb"), F.floor(mb / (C("img") % 20 + 5)).cast("int").alias("slice"))
    held = p.groupBy("img").agg(F.transform(F.sort_array(F.collect_list(F.struct("mb", "slice"))), lambda s: s["slice"]).alias("slices"))
    each = held.select("img", "slices", F.posexplode("slices").alias("mb", "slice")).select("*", syntax.neighbours(C("mb"), F.lit(8)).alias("n"))
    same = sum(F.when(F.get("slices", C(f"n.{k}")) == C("slice"), 1).otherwise(0) for k in "abcd")
    return each.select("img", "mb", "n.a", "n.b", "n.c", "n.d", same.alias("available"))


QUERIES["macroblock_neighbours"] = macroblock_neighbours
ORACLE_SQL["macroblock_neighbours"] = f"""WITH {PIXELS_SQL}, m AS (SELECT img, x, y, y * 8 + x AS mb, (y * 8 + x) // (img % 20 + 5) AS s FROM pixels)
SELECT m.img, m.mb, a.mb AS a, b.mb AS b, c.mb AS c, d.mb AS d, (coalesce(a.s = m.s, false)::INT + coalesce(b.s = m.s, false)::INT + coalesce(c.s = m.s, false)::INT + coalesce(d.s = m.s, false)::INT) AS available FROM m
LEFT JOIN m a ON a.img = m.img AND a.y = m.y AND a.x = m.x - 1 LEFT JOIN m b ON b.img = m.img AND b.y = m.y - 1 AND b.x = m.x
LEFT JOIN m c ON c.img = m.img AND c.y = m.y - 1 AND c.x = m.x + 1 LEFT JOIN m d ON d.img = m.img AND d.y = m.y - 1 AND d.x = m.x - 1"""


def context_init(spark, d):
    """The context words of a slice: 154 first values of a table row and a QP."""
    x = table(spark, d, "part").select("p_partkey", (C("p_size") % 52).alias("qp")).repartition("p_partkey")
    values = F.transform(F.sequence(F.lit(0), F.lit(153)), lambda i: ((C("p_partkey") * 7 + i * 31) % 256).cast("int"))
    x = x.select("p_partkey", "qp", values.alias("v")).select("p_partkey", syntax.context_words(C("v"), C("qp")).alias("words"))
    return x.select(C("p_partkey").alias("slice_id"), F.size("words").alias("n"), F.array_join("words", ",").alias("words"))


QUERIES["context_init"] = context_init
ORACLE_SQL["context_init"] = """WITH i AS (SELECT p_partkey AS slice_id, p_size % 52 AS qp, i, (p_partkey * 7 + i * 31) % 256 AS v FROM part, generate_series(0, 155) t(i)),
s AS (SELECT slice_id, i, greatest(least((((v >> 4) * 5 - 45) * least(qp, 51) >> 4) + (v & 15) * 8 - 16, 126), 1) AS p FROM i),
b AS (SELECT slice_id, i, CASE WHEN i > 153 THEN 0 WHEN p > 63 THEN (p - 64) * 2 + 1 ELSE (63 - p) * 2 END AS c FROM s),
w AS (SELECT slice_id, i // 4 AS k, sum(c << (8 * (i % 4)::INT))::BIGINT AS word FROM b GROUP BY 1, 2)
SELECT slice_id, count(*)::INT AS n, string_agg(word::VARCHAR, ',' ORDER BY k) AS words FROM w GROUP BY 1"""


def slice_group_maps(spark, d):
    """Slice group of every macroblock of 8 x 8 pictures, by map types 0 to 6; images are parameter sets."""
    kind, units, back = C("img") % 7, (C("img") * 5) % 65, C("img") % 2 == 1
    p = pixels(spark, d).select("img", kind.alias("kind"), units.alias("units"), back.alias("back"), "x", "y", (C("r") % 4).cast("int").alias("listed"))
    p = p.withColumn("place", syntax.box_order(C("x"), C("y"), 8, 8, C("back")))
    at = F.row_number().over(Window.partitionBy("img").orderBy("place"))
    told = syntax.slice_group(C("kind"), C("x"), C("y"), 8, 8, 4, 3, C("units"), C("back"), [(1, 1, 3, 3), (2, 2, 5, 4), (0, 6, 7, 7)])
    group = F.when(C("kind") == 3, F.when(C("at") <= C("units"), 0).otherwise(1)).when(C("kind") == 6, C("listed")).otherwise(told)
    return p.withColumn("at", at).select("img", "kind", "x", "y", group.alias("slice_group"))


QUERIES["slice_group_maps"] = slice_group_maps
ORACLE_SQL["slice_group_maps"] = f"""WITH RECURSIVE {PIXELS_SQL},
walk(back, x, y, l, t, r, b, dx, dy, n) AS (
  SELECT f, (8 - f) // 2, (8 - f) // 2, (8 - f) // 2, (8 - f) // 2, (8 - f) // 2, (8 - f) // 2, f - 1, f, 0 FROM (VALUES (0), (1)) v(f)
  UNION ALL SELECT back,
    CASE WHEN dx = -1 AND x = l THEN greatest(l - 1, 0) WHEN dx = 1 AND x = r THEN least(r + 1, 7) WHEN dy = -1 AND y = t OR dy = 1 AND y = b THEN x ELSE x + dx END,
    CASE WHEN dx = -1 AND x = l OR dx = 1 AND x = r THEN y WHEN dy = -1 AND y = t THEN greatest(t - 1, 0) WHEN dy = 1 AND y = b THEN least(b + 1, 7) ELSE y + dy END,
    CASE WHEN dx = -1 AND x = l THEN greatest(l - 1, 0) ELSE l END, CASE WHEN dy = -1 AND y = t THEN greatest(t - 1, 0) ELSE t END,
    CASE WHEN dx = 1 AND x = r THEN least(r + 1, 7) ELSE r END, CASE WHEN dy = 1 AND y = b THEN least(b + 1, 7) ELSE b END,
    CASE WHEN dx = -1 AND x = l OR dx = 1 AND x = r THEN 0 WHEN dy = -1 AND y = t THEN 1 - 2 * back WHEN dy = 1 AND y = b THEN 2 * back - 1 ELSE dx END,
    CASE WHEN dx = -1 AND x = l THEN 2 * back - 1 WHEN dx = 1 AND x = r THEN 1 - 2 * back WHEN dy = -1 AND y = t OR dy = 1 AND y = b THEN 0 ELSE dy END, n + 1 FROM walk WHERE n < 400),
place AS (SELECT back, x, y, row_number() OVER (PARTITION BY back ORDER BY min(n)) AS nth FROM walk GROUP BY back, x, y),
m AS (SELECT p.*, img % 7 AS kind, img * 5 % 65 AS units, img % 2 AS f, y * 8 + x AS i, x * 8 + y AS j FROM pixels p),
u AS (SELECT *, CASE WHEN f = 1 THEN 64 - units ELSE units END AS upper FROM m)
SELECT img, kind, u.x, u.y, (CASE kind WHEN 0 THEN i // 3 % 4 WHEN 1 THEN (u.x + u.y * 4 // 2) % 4
  WHEN 2 THEN CASE WHEN u.x BETWEEN 1 AND 3 AND u.y BETWEEN 1 AND 3 THEN 0 WHEN u.x BETWEEN 2 AND 5 AND u.y BETWEEN 2 AND 4 THEN 1 WHEN u.y >= 6 THEN 2 ELSE 3 END
  WHEN 3 THEN CASE WHEN nth <= units THEN 0 ELSE 1 END WHEN 4 THEN CASE WHEN i < upper THEN f ELSE 1 - f END WHEN 5 THEN CASE WHEN j < upper THEN f ELSE 1 - f END ELSE r % 4 END)::INT AS slice_group
FROM u JOIN place ON place.back = f AND place.x = u.x AND place.y = u.y"""


def record_admission(spark, d):
    """Record streams that a decoder takes, by codec, packing and port; others are refused and counted."""
    r = view(spark, d, "records").where("kind = 'STREAM'")
    pick = lambda names, by: F.get(F.array(*[F.lit(n) for n in names]), (by % len(names)).cast("int"))
    r = r.select("stream_id", "seq", pick(("aac", "mp3", "h264", "opus"), C("stream_id")).alias("codec"), pick(("raw", "framed", "annexb", "length"), C("seq") / 10).alias("packing"), pick(("audio", "video"), C("seq") / 20).alias("port"))
    return records.admitted(r).groupBy("codec", "packing", "port", "admitted").agg(F.count("*").alias("streams"))


QUERIES["record_admission"] = record_admission
ORACLE_SQL["record_admission"] = f"""WITH {sql('records')}, s AS (SELECT (['aac', 'mp3', 'h264', 'opus'])[stream_id % 4 + 1] AS codec, (['raw', 'framed', 'annexb', 'length'])[seq // 10 % 4 + 1] AS packing, (['audio', 'video'])[seq // 20 % 2 + 1] AS port FROM records WHERE kind = 'STREAM')
SELECT codec, packing, port, (codec, packing, port) IN (('aac', 'raw', 'audio'), ('aac', 'framed', 'audio'), ('mp3', 'framed', 'audio'), ('h264', 'annexb', 'video'), ('h264', 'length', 'video')) AS admitted, count(*) AS streams FROM s GROUP BY ALL"""


def object_faults(spark, d):
    """Objects and requests that are refused, with the reason: too large a file, too large a raster, a mode that is not built, a video track of another codec."""
    o = table(spark, d, "documents").select(
        "doc_id", F.octet_length("text").cast("bigint").alias("bytes"), (C("doc_id") * 997 % 66000).alias("w"), (C("doc_id") * 7919 % 66000).alias("h"),
        F.get(F.array(*[F.lit(m) for m in ("none", "stretch", "fit", "fill")]), (C("doc_id") % 4).cast("int")).alias("mode"), F.when(C("doc_id") % 5 < 3, "V_MPEG4/ISO/AVC").otherwise("V_MPEGH/ISO/HEVC").alias("codec_id"),
    )
    reasons = F.filter(F.array(
        F.when(C("bytes") > 8000, "size"), F.when(~syntax.raster_fits(C("w"), C("h")), "raster"), F.when(C("mode").isin("fit", "fill"), "mode"), F.when(bitstream.video_codec(C("codec_id")) != "h264", "track"),
    ), lambda r: r.isNotNull())
    return o.select("doc_id", F.explode(reasons).alias("reason"))


QUERIES["object_faults"] = object_faults
ORACLE_SQL["object_faults"] = """SELECT doc_id, unnest(list_filter([CASE WHEN strlen(text) > 8000 THEN 'size' END, CASE WHEN (doc_id * 997 % 66000) * (doc_id * 7919 % 66000) * 2 >= 4294967296 THEN 'raster' END,
  CASE WHEN doc_id % 4 > 1 THEN 'mode' END, CASE WHEN doc_id % 5 > 2 THEN 'track' END], lambda r: r IS NOT NULL)) AS reason FROM documents"""


def shown_times(spark, d):
    """Times of shown pictures: the n-th picture of a stream in display order takes the n-th time that went in."""
    s = view(spark, d, "slices").select("stream_id", "n", (C("n") * 40 - C("lsb") * 3).alias("pts"), (C("lsb") * 2 + C("tid")).alias("poc"))
    return records.pop_times(s)


QUERIES["shown_times"] = shown_times
ORACLE_SQL["shown_times"] = f"""WITH {sql('slices')}, s AS (SELECT stream_id, n, n * 40 - lsb * 3 AS pts, lsb * 2 + tid AS poc FROM slices),
a AS (SELECT stream_id, pts, row_number() OVER (PARTITION BY stream_id ORDER BY n) AS i FROM s), b AS (SELECT stream_id, n, row_number() OVER (PARTITION BY stream_id ORDER BY poc, n) AS i FROM s)
SELECT b.stream_id, b.n, a.pts FROM b JOIN a ON a.stream_id = b.stream_id AND a.i = b.i"""


def gap_silence(spark, d):
    """The units of lossy streams with a row of silence before each gap that is filled, in order."""
    return records.with_silence(view(spark, d, "units").where("not lost"))


QUERIES["gap_silence"] = gap_silence
ORACLE_SQL["gap_silence"] = f"""WITH {sql('units')}, w AS (SELECT *, lag(pts + samples) OVER (PARTITION BY stream_id ORDER BY seq) AS expected FROM units WHERE NOT lost)
SELECT stream_id, seq, pts, samples, false AS silence FROM w
UNION ALL SELECT stream_id, seq, expected, pts - expected, true FROM w WHERE discontinuity AND pts - expected BETWEEN 1 AND {records.MAX_SILENCE}"""


def raster_chunks(spark, d):
    """RGB565 rasters in chunks of so many bytes, low byte first, as a sink takes them."""
    from reelspark.functions import raster

    v = raster.rgb565(C("r"), C("g"), C("b")).cast("bigint")
    p = pixels(spark, d).select("img", "y", "x", F.concat(F.lpad(F.hex(v % 256), 2, "0"), F.lpad(F.hex(F.floor(v / 256)), 2, "0")).alias("h"))
    return records.chunks(p.groupBy("img").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("y", "x", "h"))), lambda q: q["h"]), "").alias("raster")), "img", "raster", 48)


QUERIES["raster_chunks"] = raster_chunks
ORACLE_SQL["raster_chunks"] = f"""WITH {PIXELS_SQL}, v AS (SELECT img, y, x, (r >> 3) * 2048 + (g >> 2) * 32 + (b >> 3) AS v FROM pixels),
h AS (SELECT img, string_agg(printf('%02X%02X', v % 256, v // 256), '' ORDER BY y, x) AS raster FROM v GROUP BY 1)
SELECT img, i AS chunk, substr(raster, i * 96 + 1, 96) AS bytes FROM (SELECT *, unnest(generate_series(0, (length(raster) - 1) // 96)) AS i FROM h)"""
