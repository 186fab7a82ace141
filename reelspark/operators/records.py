"""Encoded-record streams: binding, reassembly, faults, packetising and gap filling, as windows over ordered records."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Samples of silence that fill a gap at most: one second at 8 kHz.
MAX_SILENCE = 8000
#: Packet times in ms; any other asks for 20.
PACKET_MS = (10, 20, 30, 40)


def bind(records: DataFrame) -> DataFrame:
    """records (stream_id, seq, kind, ...) with bound_seq: the seq of the STREAM record that is open there; null for none.

    A STREAM opens, an END closes; a STREAM while one is open replaces it. Streams are apart; order is by seq.
    """
    before = Window.partitionBy("stream_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.partitionBy("stream_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    control = F.when(F.col("kind") != "UNIT", F.struct("kind", "seq"))
    last = F.when(F.col("kind") == "END", F.last(control, ignorenulls=True).over(earlier)).otherwise(F.last(control, ignorenulls=True).over(before))
    return records.withColumn("_last", last).withColumn("bound_seq", F.when(F.col("_last.kind") == "STREAM", F.col("_last.seq"))).drop("_last")


def faults(records: DataFrame) -> DataFrame:
    """The records out of order: units and ends without an open stream."""
    return bind(records).where("kind <> 'STREAM' and bound_seq is null").select("stream_id", "seq", "kind")


def reassemble(records: DataFrame) -> DataFrame:
    """Whole units of bound fragments: (stream_id, bound_seq, first_seq, last_seq, fragments, bytes).

    A fragment that `continues` is followed by more of its unit; a unit with a `truncated` fragment, or without its
    last one, is discarded.
    """
    units = bind(records).where("kind = 'UNIT' and bound_seq is not null")
    order = Window.partitionBy("stream_id", "bound_seq").orderBy("seq")
    starts = F.when(F.coalesce(F.lag("continues").over(order), F.lit(False)), 0).otherwise(1)
    numbered = units.withColumn("_start", starts).withColumn("unit_no", F.sum("_start").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    whole = numbered.groupBy("stream_id", "bound_seq", "unit_no").agg(
        F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"), F.count("*").alias("fragments"), F.sum("bytes").alias("bytes"),
        F.max("truncated").alias("cut"), F.max_by("continues", "seq").alias("open"),
    )
    return whole.where("not cut and not open").select("stream_id", "bound_seq", "first_seq", "last_seq", "fragments", "bytes")


def packetise(samples: DataFrame, encode, ptime: int = 20) -> DataFrame:
    """Units of 8 * ptime encoded samples: (stream_id, pts, octets, n); samples has stream_id, n (from 0) and sample.

    A unit is a count window: its number follows from n alone, so one aggregation makes it.
    """
    size = 8 * (ptime if ptime in PACKET_MS else 20)
    coded = samples.select("stream_id", "n", F.lpad(F.hex(encode(F.col("sample")).cast("bigint")), 2, "0").alias("octet"))
    unit = F.floor(F.col("n") / size) * size
    packed = coded.groupBy("stream_id", unit.alias("pts")).agg(F.sort_array(F.collect_list(F.struct("n", "octet"))).alias("all"))
    return packed.select("stream_id", "pts", F.array_join(F.transform("all", lambda x: x["octet"]), "").alias("octets"), F.size("all").alias("n"))


def fill_gaps(units: DataFrame) -> DataFrame:
    """units (stream_id, seq, pts, samples, discontinuity) with expected pts and the silence (samples) put before each."""
    order = Window.partitionBy("stream_id").orderBy("seq")
    expected = F.lag(F.col("pts") + F.col("samples")).over(order)
    gap = F.col("pts") - F.col("expected")
    return units.withColumn("expected", expected).withColumn("silence", F.when(F.col("discontinuity") & gap.between(1, MAX_SILENCE), gap).otherwise(F.lit(0)))


def scaled_pts(pts, clock):
    """Milliseconds of a video pts: (max(pts, 0) * ((1000 << 16) div clock)) >> 16."""
    return F.shiftright(F.greatest(pts, F.lit(0)) * F.floor(F.lit(65536000) / clock).cast("bigint"), 16)


# What record ports take, as (codec, packing, port).
ADMITTED = (("aac", "raw", "audio"), ("aac", "framed", "audio"), ("mp3", "framed", "audio"), ("h264", "annexb", "video"), ("h264", "length", "video"))


def admitted(streams: DataFrame) -> DataFrame:
    """streams (codec, packing, port, ...) with admitted: whether a decoder of that port takes them; nulls are refused."""
    taken = F.struct("codec", "packing", "port").isin(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(("codec", "packing", "port"), t, strict=True)]) for t in ADMITTED])
    return streams.withColumn("admitted", F.coalesce(taken, F.lit(False)))


def pop_times(pictures: DataFrame) -> DataFrame:
    """(stream_id, n, pts): the n-th picture of a stream in display order (poc) takes the n-th pts of decoding order (n)."""
    order = lambda *c: F.row_number().over(Window.partitionBy("stream_id").orderBy(*c))
    both = pictures.select("stream_id", "n", "pts", order("n").alias("i"), order("poc", "n").alias("j"))
    # One shuffle: both numberings and this window have the same partitioning.
    tagged = both.select("stream_id", F.explode(F.array(F.struct(F.col("i").alias("at"), F.lit(None).cast("bigint").alias("n"), "pts"), F.struct(F.col("j").alias("at"), "n", F.lit(None).cast("bigint").alias("pts")))).alias("s"))
    met = tagged.groupBy("stream_id", "s.at").agg(F.max("s.n").alias("n"), F.max("s.pts").alias("pts"))
    return met.select("stream_id", "n", "pts")


def with_silence(units: DataFrame) -> DataFrame:
    """(stream_id, seq, pts, samples, silence): the units, and before each gap that fill_gaps() fills a row of silence of its length."""
    gap = F.struct(F.col("expected").alias("pts"), F.col("silence").alias("samples"), F.lit(True).alias("silence"))
    own = F.struct("pts", "samples", F.lit(False).alias("silence"))
    rows = F.when(F.col("silence") > 0, F.array(gap, own)).otherwise(F.array(own))
    return fill_gaps(units).select("stream_id", "seq", F.explode(rows).alias("u")).select("stream_id", "seq", "u.*")


def chunks(objects: DataFrame, key: str, column: str, size: int) -> DataFrame:
    """(key, chunk, bytes): the hex text of a column in chunks of so many bytes; empty and null ones have none."""
    n = F.ceil(F.length(column) / (2 * size)).cast("int")
    each = objects.where(F.length(column) > 0).select(key, column, F.explode(F.sequence(F.lit(0), n - 1)).alias("chunk"))
    return each.select(key, "chunk", F.substring(F.col(column), F.col("chunk") * (2 * size) + 1, F.lit(2 * size)).alias("bytes"))
