"""Sniffing, identifiers, variable-length integers and header fields as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# NAL unit types of H.265 by code, where named.
HEVC_SLICES = {0: "TRAIL_N", 1: "TRAIL_R", 16: "BLA_W_LP", 17: "BLA_W_RADL", 18: "BLA_N_LP", 19: "IDR_W_RADL", 20: "IDR_N_LP", 21: "CRA", 32: "VPS", 33: "SPS", 34: "PPS", 35: "AUD", 36: "EOS", 37: "EOB", 39: "PREFIX_SEI", 40: "SUFFIX_SEI"}


def sniff(content: Column) -> Column:
    """The format of an object's first bytes: container, then image, then audio magic; 'pcm' from 8 unclaimed bytes, else 'detecting'."""
    h = F.hex(content)
    b1 = F.conv(F.substring(h, 3, 2), 16, 10).cast("int")
    sync = h.startswith("FF")
    return (
        F.when(F.coalesce(F.length(h), F.lit(0)) < 4, "detecting")
        .when(h.startswith("1A45DFA3"), "matroska")
        .when(h.startswith("424D"), "bmp")
        .when(h.startswith("47494638"), "gif")
        .when(h.startswith("89504E470D0A1A0A"), "png")
        .when(h.startswith("FFD8FF"), "jpeg")
        .when(h.startswith("52494646"), "wav")
        .when(h.startswith("494433"), "mp3")
        .when(sync & (b1.bitwiseAND(224) == 224) & (F.shiftright(b1, 1).bitwiseAND(3) == 1), "mp3")
        .when(sync & (b1.bitwiseAND(240) == 240) & (b1.bitwiseAND(6) == 0), "aac")
        .when(F.length(h) >= 16, "pcm")
        .otherwise("detecting")
    )


def family(fmt: Column) -> Column:
    return F.when(fmt.isin("bmp", "gif", "png", "jpeg"), "image").when(fmt == "matroska", "video").when(fmt == "detecting", "unknown").otherwise("audio")


def audio_codec(codec_id: Column) -> Column:
    """The audio codec that a Matroska CodecID names; 'other' for unknown A_ ids, null for the rest."""
    c = codec_id
    return (
        F.when(c.startswith("A_AAC"), "aac").when(c == "A_MPEG/L3", "mp3").when(c.isin("A_MPEG/L2", "A_MPEG/L1"), "mp2")
        .when((c == "A_AC3") | c.startswith("A_AC3/"), "ac3").when(c == "A_EAC3", "eac3").when(c.startswith("A_DTS"), "dts")
        .when((c == "A_TRUEHD") | c.startswith("A_MLP"), "truehd").when(c == "A_FLAC", "flac").when(c == "A_OPUS", "opus")
        .when(c.startswith("A_VORBIS"), "vorbis").when(c.startswith("A_PCM/INT/LIT"), "pcm_s16le").when(c.startswith("A_PCM/INT/BIG"), "pcm_s16be")
        .when(c.startswith("A_"), "other")
    )


def video_codec(codec_id: Column) -> Column:
    return F.when(codec_id == "V_MPEG4/ISO/AVC", "h264").when(codec_id == "V_MPEGH/ISO/HEVC", "h265")


def kind(codec_id: Column) -> Column:
    return F.when(video_codec(codec_id).isNotNull(), "video").when(audio_codec(codec_id).isNotNull(), "audio")


def bit_length(x: Column) -> Column:
    """The number of bits of a whole number from 1; 1 for 0."""
    return F.length(F.bin(x.cast("bigint")))


def ebml_width(first: Column) -> Column:
    """Bytes of an EBML number by its first byte's marker bit; 0 without one."""
    return F.when(first > 0, 9 - bit_length(first)).otherwise(0)


def ebml_value(first: Column, rest: Column) -> Column:
    """Value of an EBML number from its first byte and the whole of the bytes that follow; null without a marker."""
    w = ebml_width(first)
    marker = F.pow(F.lit(2), 8 - w).cast("bigint")
    return F.when(w > 0, (first - marker) * F.pow(F.lit(2), 8 * (w - 1)).cast("bigint") + rest)


def timescale(scale_ns: Column) -> Column:
    """Ticks a second, 10^9 div the nanoseconds of a tick; 0 for none or beyond 32 bits."""
    return F.when((scale_ns > 0) & (scale_ns <= 4294967295), F.floor(F.lit(1000000000) / scale_ns)).otherwise(F.lit(0)).cast("bigint")


def track_id(number: Column) -> Column:
    """A track number from 1 to 65535; null for others, never a saturated one."""
    return F.when(number.between(1, 65535), number)


def h264_nal(b0: Column) -> Column:
    return F.struct(F.shiftright(b0, 5).bitwiseAND(3).cast("int").alias("ref_idc"), b0.bitwiseAND(31).cast("int").alias("nal_type"), (b0 >= 128).alias("forbidden"))


def hevc_nal(b0: Column, b1: Column) -> Column:
    """struct<nal_type, layer_id, temporal_id, is_irap, is_parameter_set>; null if the forbidden bit is set or the id plus 1 is 0."""
    t = F.shiftright(b0, 1).bitwiseAND(63).cast("int")
    fields = F.struct(
        t.alias("nal_type"), (b0.bitwiseAND(1) * 32 + F.shiftright(b1, 3)).cast("int").alias("layer_id"), (b1.bitwiseAND(7) - 1).cast("int").alias("temporal_id"),
        t.between(16, 21).alias("is_irap"), t.between(32, 34).alias("is_parameter_set"),
    )
    return F.when((b0 < 128) & (b1.bitwiseAND(7) > 0), fields)


def hevc_nal_name(nal_type: Column) -> Column:
    names = F.create_map(*[x for k, v in HEVC_SLICES.items() for x in (F.lit(k), F.lit(v))])
    return F.coalesce(names[nal_type], F.lit("OTHER"))


def is_hdr(present: Column, primaries: Column, transfer: Column) -> Column:
    return present & transfer.isin(16, 18)


def cabac_context(init_value: Column, qp: Column) -> Column:
    """struct<state, mps> of a context's first state at a slice QP."""
    m, n = F.shiftright(init_value, 4) * 5 - 45, init_value.bitwiseAND(15) * 8 - 16
    pre = F.greatest(F.least(F.shiftright(m * F.greatest(F.least(qp, F.lit(51)), F.lit(0)), 4) + n, F.lit(126)), F.lit(1))
    return F.struct(F.when(pre > 63, pre - 64).otherwise(63 - pre).cast("int").alias("state"), F.when(pre > 63, 1).otherwise(0).alias("mps"))


def buffer_size(x: Column) -> Column:
    """3 * 2^max(8, floor(log2 x)): the step in which working buffers grow."""
    return 3 * F.pow(F.lit(2), F.greatest(bit_length(x) - 1, F.lit(8))).cast("bigint")


def reference_lists(before: Column, after: Column, slice_type: Column, n0: Column, n1: Column) -> tuple[Column, Column]:
    """First reference lists as arrays of POCs: both sets in turn, cycled to the wanted length (16 at most); none for I, the second for B only."""

    def build(first: Column, second: Column, want: Column, on: Column) -> Column:
        # Sizes alone tell where an element comes from: no list of both is made for each element.
        split, size = F.size(first), F.size(first) + F.size(second)
        element = lambda i: F.when(i % size < split, F.get(first, i % size)).otherwise(F.get(second, i % size - split))
        cycled = F.transform(F.sequence(F.lit(0), F.greatest(F.least(want, F.lit(16)) - 1, F.lit(0))), element)
        return F.when(on & (size > 0) & (want > 0), cycled).otherwise(F.array().cast("array<int>"))

    return build(before, after, n0, slice_type != "I"), build(after, before, n1, slice_type == "B")
