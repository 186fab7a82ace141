"""G.711 companding and audio frame headers as column expressions: integers in, integers out, all inside codegen."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Sampling rates by index (MPEG-4), bit rates in kbit/s and sampling rates (MPEG-1 Layer III).
AAC_RATES = (96000, 88200, 64000, 48000, 44100, 32000, 24000, 22050, 16000, 12000, 11025, 8000, 7350)
MP3_KBPS = (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320)
MP3_RATES = (44100, 48000, 32000)


def lookup(values: tuple, index: Column) -> Column:
    """values[index], null outside."""
    return F.get(F.array(*[F.lit(v) for v in values]), index.cast("int"))


def _segment(magnitude: Column, ends: tuple) -> Column:
    """How many of the ascending segment ends lie below the magnitude."""
    found = F.when(magnitude <= ends[0], 0)
    for i, end in enumerate(ends[1:], 1):
        found = found.when(magnitude <= end, i)
    return found.otherwise(len(ends))


def ulaw_encode(sample: Column) -> Column:
    """The mu-law octet of a 16-bit sample (clip 32635, bias 132, eight segments)."""
    m = F.least(F.abs(sample.cast("int")), F.lit(32635)) + 132
    seg = _segment(m, (255, 511, 1023, 2047, 4095, 8191, 16383))
    mantissa = F.floor(m / F.pow(F.lit(2), seg + 3)).cast("int").bitwiseAND(15)
    octet = F.when(sample < 0, 128).otherwise(0) + seg * 16 + mantissa
    return (255 - octet).cast("int")


def ulaw_decode(code: Column) -> Column:
    """The 16-bit sample of a mu-law octet."""
    c = 255 - code.cast("int")
    t = (c.bitwiseAND(15) * 8 + 132) * F.pow(F.lit(2), F.shiftright(c, 4).bitwiseAND(7)).cast("int")
    return F.when(c.bitwiseAND(128) != 0, 132 - t).otherwise(t - 132)


def alaw_encode(sample: Column) -> Column:
    """The A-law octet of a 16-bit sample (13-bit magnitude, XOR 0x55)."""
    s = sample.cast("int")
    m = F.least(F.when(s >= 0, F.shiftright(s, 3)).otherwise(F.shiftright(-s - 1, 3)), F.lit(4095))
    seg = _segment(m, (31, 63, 127, 255, 511, 1023, 2047))
    mantissa = F.when(seg == 0, F.shiftright(m, 1)).otherwise(F.floor(m / F.pow(F.lit(2), seg)).cast("int")).bitwiseAND(15)
    return (F.when(s >= 0, 128).otherwise(0) + seg * 16 + mantissa).bitwiseXOR(85)


def alaw_decode(code: Column) -> Column:
    """The 16-bit sample of an A-law octet: the middle of its interval."""
    c = code.cast("int").bitwiseXOR(85)
    s, q = F.shiftright(c, 4).bitwiseAND(7), c.bitwiseAND(15)
    v = F.when(s == 0, q * 2 + 1).otherwise((q * 2 + 33) * F.pow(F.lit(2), F.greatest(s - 1, F.lit(0))).cast("int")) * 8
    return F.when(c.bitwiseAND(128) != 0, v).otherwise(-v)


def mono(left: Column, right: Column) -> Column:
    """(l + r) / 2, truncated towards zero."""
    both = left.cast("int") + right.cast("int")
    return F.when(both < 0, -F.shiftright(-both, 1)).otherwise(F.shiftright(both, 1))


def mp3_header(word: Column) -> Column:
    """struct<kbps, rate, padding, mode, channels, has_crc, frame_bytes> of a 32-bit MPEG-1 Layer III header; null if it is none."""
    part = lambda shift, mask: F.shiftright(word, shift).bitwiseAND(mask)
    kbps, rate, pad = lookup(MP3_KBPS, part(12, 15)), lookup(MP3_RATES, part(10, 3)), part(9, 1)
    ok = (part(21, 2047) == 2047) & (part(19, 3) == 3) & (part(17, 3) == 1) & (kbps > 0) & rate.isNotNull()
    size = F.floor(F.lit(144000) * kbps / rate).cast("int") + pad.cast("int")
    fields = F.struct(
        kbps.alias("kbps"), rate.alias("rate"), pad.cast("int").alias("padding"), part(6, 3).cast("int").alias("mode"),
        F.when(part(6, 3) == 3, 1).otherwise(2).alias("channels"), (part(16, 1) == 0).alias("has_crc"), size.alias("frame_bytes"),
    )
    return F.when(ok, fields)


def adts_template(asc: Column) -> Column:
    """struct<object_type, sfi, channels> of a 16-bit AudioSpecificConfig that ADTS can carry; else null."""
    ot, sfi, ch = F.shiftright(asc, 11).bitwiseAND(31), F.shiftright(asc, 7).bitwiseAND(15), F.shiftright(asc, 3).bitwiseAND(15)
    return F.when(ot.between(1, 4) & (sfi <= 12) & ch.between(1, 7), F.struct(ot.cast("int").alias("object_type"), sfi.cast("int").alias("sfi"), ch.cast("int").alias("channels")))


def adts_header(template: Column, payload: Column) -> Column:
    """The 7 header octets, as hex, before a raw unit of so many bytes; null beyond 8184 of them."""
    n = payload + 7
    octet = lambda x: F.lpad(F.hex(x.cast("bigint")), 2, "0")
    out = F.concat(
        F.lit("FFF1"),
        octet((template["object_type"] - 1) * 64 + template["sfi"] * 4 + F.shiftright(template["channels"], 2)),
        octet(template["channels"].bitwiseAND(3) * 64 + F.shiftright(n, 11)),
        octet(F.shiftright(n, 3).bitwiseAND(255)),
        octet(n.bitwiseAND(7) * 32 + 31),
        F.lit("FC"),
    )
    return F.when(template.isNotNull() & (payload <= 8184), out)
