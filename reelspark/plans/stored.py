"""Queries through stored files: tables are written as media files by the sinks and read back by the file sources."""

from __future__ import annotations

from pyspark.sql import functions as F

from reelspark.plans.media import _el, _hex, _joined
from reelspark.sources import ranged, sinks
from reelspark.sources.views import PIXELS_SQL, pixels, sql, view

QUERIES, ORACLE_SQL = {}, {}
C = F.col


def _rasters(spark, d, how):
    folder = sinks.scratch(spark, f"rasters-{how}")
    sinks.write_rasters(pixels(spark, d), folder, how)
    return sinks.read_rasters(spark, folder, how).withColumn("img", C("img").cast("bigint"))


QUERIES["ppm_files"] = lambda spark, d: _rasters(spark, d, "ppm")
ORACLE_SQL["ppm_files"] = f"WITH {PIXELS_SQL} SELECT img, x, y, r, g, b FROM pixels"
QUERIES["rgb565_files"] = lambda spark, d: _rasters(spark, d, "rgb565")
ORACLE_SQL["rgb565_files"] = f"WITH {PIXELS_SQL} SELECT img, x, y, (r >> 3) * 2048 + (g >> 2) * 32 + (b >> 3) AS rgb565 FROM pixels"

#: Files that hold the clusters of all orders, and the bytes of a range of one.
VOLUMES, RANGE_BYTES = 8, 1 << 20


def matroska_ranges(spark, d):
    """Volumes of one cluster an order, written piece by piece, read by byte ranges."""
    x = view(spark, d, "octets")
    block = F.concat(_hex(C("w") % 2 + 129, 1), _hex(C("w"), 2), F.when(C("b0") % 2 == 1, F.lit("80")).otherwise(F.lit("00")), F.repeat(_hex(C("b2"), 1), (C("b1") % 20).cast("int")))
    clusters = _joined(x, "object_id", ["k", "w", "b0", "b1", "b2"], _el("A3", block))
    cluster = _el("1F43B675", F.concat(_el("E7", _hex(C("object_id") % 65536, 2)), C("body")))
    name = F.concat(F.lit("volume-"), (C("object_id") % VOLUMES).cast("string"), F.lit(".mkv"))
    pieces = clusters.select(name.alias("name"), C("object_id").cast("bigint").alias("at"), F.unhex(cluster).alias("piece"))
    heads = x.select(name.alias("name")).distinct().select("name", F.lit(-1).cast("bigint"), F.unhex(F.lit("1A45DFA380" + "1853806701FFFFFFFFFFFFFF")))
    folder = sinks.scratch(spark, "volumes")
    sinks.write_files(pieces.union(heads), folder)
    frames = ranged.matroska(spark, folder, range_bytes=RANGE_BYTES)
    return frames.select(F.regexp_extract("object_id", "([^/]+)$", 1).alias("volume"), "track", "ts", "keyframe", "lacing", "frame", F.hex("payload").alias("payload"), "fault")


QUERIES["matroska_ranges"] = matroska_ranges
ORACLE_SQL["matroska_ranges"] = f"""WITH {sql('octets')}
SELECT 'volume-' || object_id % {VOLUMES} || '.mkv' AS volume, (w % 2 + 1)::BIGINT AS track, (object_id % 65536 + CASE WHEN w >= 32768 THEN w - 65536 ELSE w END)::BIGINT AS ts, b0 % 2 = 1 AS keyframe, 0 AS lacing, 0 AS frame,
  repeat(printf('%02X', b2), (b1 % 20)::INT) AS payload, false AS fault FROM octets"""
