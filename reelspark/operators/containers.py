"""Container algebra: cluster time, lacing, track selection, seeking and NAL re-framing over element tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reelspark.functions import bitstream


def cluster_time(elements: DataFrame) -> DataFrame:
    """Blocks (object_id, off, ts, keyframe) of elements (object_id, off, kind, val, flags): a block's time is its cluster's plus its own."""
    order = Window.partitionBy("object_id").orderBy("off").rowsBetween(Window.unboundedPreceding, 0)
    cluster = F.last(F.when(F.col("kind") == "cluster", F.col("val")), ignorenulls=True).over(order)
    timed = elements.withColumn("ts", cluster + F.col("val")).where("kind <> 'cluster' and ts is not null")
    return timed.select("object_id", "off", "ts", (F.col("flags").bitwiseAND(128) != 0).alias("keyframe"))


def fixed_lace(size: Column, frames: Column) -> Column:
    """Sizes of frames of equal length; null if they do not divide the payload."""
    return F.when((frames > 0) & (size % frames == 0), F.array_repeat(F.floor(size / frames).cast("bigint"), frames.cast("int")))


def xiph_lace(octets: Column, payload: Column) -> Column:
    """Frame sizes of a Xiph lace: octets are summed up to one below 255; the last frame has what is left of the payload.

    The octets are whole: what follows the last one below 255 counts for nothing.
    """
    start = F.struct(F.lit(0).cast("bigint").alias("run"), F.array().cast("array<bigint>").alias("out"))
    sizes = F.aggregate(
        octets, start,
        lambda a, o: F.struct(F.when(o == 255, a["run"] + 255).otherwise(F.lit(0)).cast("bigint").alias("run"), F.when(o == 255, a["out"]).otherwise(F.concat(a["out"], F.array(a["run"] + o))).alias("out")),
        lambda a: a["out"],
    )
    told = F.aggregate(sizes, F.lit(0).cast("bigint"), lambda a, s: a + s)
    return F.when(told <= payload, F.concat(sizes, F.array(payload - told)))


def ebml_lace(first: Column, coded: Column, widths: Column, payload: Column) -> Column:
    """Frame sizes of an EBML lace: the first as it is, then differences coded with a bias of 2^(7w-1) - 1, the last implied."""
    deltas = F.zip_with(coded, widths, lambda v, w: v - (F.pow(F.lit(2), 7 * w - 1).cast("bigint") - 1))
    sizes = F.aggregate(deltas, F.array(first), lambda a, d: F.concat(a, F.array(F.element_at(a, -1) + d)))
    told = F.aggregate(sizes, F.lit(0).cast("bigint"), lambda a, s: a + s)
    return F.when(~F.exists(sizes, lambda s: s < 0) & (told <= payload), F.concat(sizes, F.array(payload - told)))


def select_tracks(tracks: DataFrame) -> DataFrame:
    """tracks (object_id, track, codec_id) with kind and selected: the first video track that can be decoded, the first audio track with a name."""
    named = tracks.withColumn("kind", bitstream.kind(F.col("codec_id")))
    order = Window.partitionBy("object_id", "kind").orderBy("track", "codec_id")
    return named.withColumn("selected", F.col("kind").isNotNull() & (F.row_number().over(order) == 1))


def seek(cues: DataFrame, wanted: DataFrame) -> DataFrame:
    """For each (object_id, request, ticks) the last cue at or before it: as-of join by one union and one window.

    cues has object_id, ticks and position; requests before the first cue have a null position.
    """
    both = cues.select("object_id", "ticks", F.lit(0).alias("side"), F.lit(None).cast("bigint").alias("request"), F.struct("ticks", "position").alias("cue")).unionByName(
        wanted.select("object_id", "ticks", F.lit(1).alias("side"), "request", F.lit(None).cast("struct<ticks:bigint,position:bigint>").alias("cue"))
    )
    order = Window.partitionBy("object_id").orderBy("ticks", "side", "cue.position").rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("cue", F.last("cue", ignorenulls=True).over(order)).where("side = 1")
    return found.select("object_id", "request", "ticks", F.col("cue.ticks").alias("cue_ticks"), F.col("cue.position").alias("position"))


def to_annexb(nals: DataFrame) -> DataFrame:
    """(object_id, bytes, stream): NAL rows (object_id, nal_no, body hex) as one Annex B stream of four-byte start codes, in hex."""
    joined = nals.groupBy("object_id").agg(F.sort_array(F.collect_list(F.struct("nal_no", "body"))).alias("all"))
    stream = F.array_join(F.transform("all", lambda x: F.concat(F.lit("00000001"), x["body"])), "")
    return joined.select("object_id", (F.length(stream) / 2).cast("bigint").alias("bytes"), stream.alias("stream"))


def with_parameter_sets(nals: DataFrame, sets: DataFrame) -> DataFrame:
    """NAL rows (object_id, nal_no, body) and before an object's first one, once, its sets (object_id, sps, pps), all in hex."""
    put = lambda column, no: sets.select("object_id", F.lit(no).cast("bigint").alias("nal_no"), F.col(column).alias("body")).where("body is not null")
    return nals.select("object_id", F.col("nal_no").cast("bigint").alias("nal_no"), "body").unionByName(put("sps", -2)).unionByName(put("pps", -1))


def split_annexb(stream: Column) -> Column:
    """NAL bodies (hex) of an Annex B stream in hex: what lies between start codes, trailing zero bytes stripped."""
    octets = F.array_join(F.regexp_extract_all(stream, F.lit(".."), F.lit(0)), " ")
    parts = F.split(octets, r"(?:^|(?<= ))00 00 01(?: |$)")
    bare = F.transform(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(1))), lambda p: F.regexp_replace(F.trim(p), r"(?:^| )(?:00 ?)+$", ""))
    return F.filter(F.transform(bare, lambda p: F.regexp_replace(p, " ", "")), lambda p: p != "")


def strip_emulation(body: Column) -> Column:
    """A NAL body in hex without its emulation-prevention bytes: the 03 of every 00 00 03."""
    octets = F.array_join(F.regexp_extract_all(body, F.lit(".."), F.lit(0)), " ")
    return F.regexp_replace(F.regexp_replace(octets, r"(?<![^ ])00 00 03(?![^ ])", "00 00"), " ", "")
