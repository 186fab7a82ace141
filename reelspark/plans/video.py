"""Video syntax queries: NAL headers, picture order, reference lists, context states and register words."""

from __future__ import annotations

from pyspark.sql import functions as F

from reelspark.functions import bitstream
from reelspark.operators import pictures
from reelspark.sources.views import sql, view

QUERIES, ORACLE_SQL = {}, {}
C = F.col


def nal_header(spark, d):
    x = view(spark, d, "octets").select("object_id", "k", bitstream.h264_nal(C("b0")).alias("a"), bitstream.hevc_nal(C("b0"), C("b1")).alias("h"))
    return x.select("object_id", "k", C("a.ref_idc"), C("a.nal_type").alias("h264_type"), C("a.forbidden"), C("h.nal_type").alias("hevc_type"), C("h.layer_id"), C("h.temporal_id"), C("h.is_irap"), C("h.is_parameter_set"))


QUERIES["nal_header"] = nal_header
ORACLE_SQL["nal_header"] = f"""WITH {sql('octets')}, x AS (SELECT *, b0 < 128 AND b1 & 7 > 0 AS ok FROM octets)
SELECT object_id, k, ((b0 >> 5) & 3)::INT AS ref_idc, (b0 & 31)::INT AS h264_type, b0 >= 128 AS forbidden, CASE WHEN ok THEN ((b0 >> 1) & 63)::INT END AS hevc_type, CASE WHEN ok THEN ((b0 & 1) * 32 + (b1 >> 3))::INT END AS layer_id,
  CASE WHEN ok THEN ((b1 & 7) - 1)::INT END AS temporal_id, CASE WHEN ok THEN (b0 >> 1) & 63 BETWEEN 16 AND 21 END AS is_irap, CASE WHEN ok THEN (b0 >> 1) & 63 BETWEEN 32 AND 34 END AS is_parameter_set FROM x"""


def nal_census(spark, d):
    x = view(spark, d, "octets").select(bitstream.hevc_nal(C("b0"), C("b1")).alias("h"))
    return x.where("h is not null").groupBy(bitstream.hevc_nal_name(C("h.nal_type")).alias("name")).agg(F.count("*").alias("nals"))


QUERIES["nal_census"] = nal_census
ORACLE_SQL["nal_census"] = f"WITH {sql('octets')} SELECT CASE (b0 >> 1) & 63 " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in bitstream.HEVC_SLICES.items()) + " ELSE 'OTHER' END AS name, count(*) AS nals FROM octets WHERE b0 < 128 AND b1 & 7 > 0 GROUP BY 1"

QUERIES["picture_order"] = lambda spark, d: pictures.picture_order(view(spark, d, "slices"), 4).select("stream_id", "n", "lsb", "tid", "idr", "poc")
ORACLE_SQL["picture_order"] = f"""WITH RECURSIVE {sql('slices')}, s AS (SELECT stream_id, n, lsb, tid, idr, row_number() OVER (PARTITION BY stream_id ORDER BY n) AS i FROM slices),
step AS (
  SELECT stream_id, n, lsb, tid, idr, i, CASE WHEN idr THEN 0 ELSE lsb END AS poc, CASE WHEN idr THEN 0 WHEN tid = 0 THEN lsb END AS p_lsb, CASE WHEN idr OR tid = 0 THEN 0::BIGINT END AS p_msb FROM s WHERE i = 1
  UNION ALL
  SELECT stream_id, n, lsb, tid, idr, i, CASE WHEN idr THEN 0 ELSE msb + lsb END, CASE WHEN idr THEN 0 WHEN tid = 0 THEN lsb ELSE p_lsb END, CASE WHEN idr THEN 0 WHEN tid = 0 THEN msb ELSE p_msb END
  FROM (SELECT s.*, p.p_lsb, p.p_msb, CASE WHEN p.p_lsb IS NULL THEN 0 WHEN s.lsb < p.p_lsb AND p.p_lsb - s.lsb >= 8 THEN p.p_msb + 16 WHEN s.lsb > p.p_lsb AND s.lsb - p.p_lsb > 8 THEN p.p_msb - 16 ELSE p.p_msb END AS msb
    FROM step p JOIN s ON s.stream_id = p.stream_id AND s.i = p.i + 1))
SELECT stream_id, n, lsb, tid, idr, poc::BIGINT AS poc FROM step"""

QUERIES["display_order"] = lambda spark, d: pictures.output_order(view(spark, d, "slices").withColumn("poc", C("lsb") * 2 + C("tid"))).select("stream_id", "n", "display_no")
ORACLE_SQL["display_order"] = f"""WITH {sql('slices')}, r AS (SELECT *, sum(idr::INT) OVER (PARTITION BY stream_id ORDER BY n) AS run FROM slices)
SELECT stream_id, n, (row_number() OVER (PARTITION BY stream_id ORDER BY run, lsb * 2 + tid, n) - 1)::INT AS display_no FROM r"""


def param_set_bind(spark, d):
    x = view(spark, d, "slices").withColumn("kind", F.when(C("n") % 9 == 0, "set").otherwise("slice"))
    return pictures.bind_parameters(x)


QUERIES["param_set_bind"] = param_set_bind
ORACLE_SQL["param_set_bind"] = f"""WITH {sql('slices')}, b AS (SELECT *, last_value(CASE WHEN n % 9 = 0 THEN n END IGNORE NULLS) OVER (PARTITION BY stream_id, set_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS set_n FROM slices)
SELECT stream_id, n, set_id, set_n FROM b WHERE n % 9 <> 0"""

QUERIES["au_boundary"] = lambda spark, d: pictures.access_units(view(spark, d, "slices"), ["lsb", "pps", "idr"]).select("stream_id", "n", "au_no")
ORACLE_SQL["au_boundary"] = f"""WITH {sql('slices')}, c AS (SELECT *, CASE WHEN (lag(lsb) OVER w, lag(pps) OVER w, lag(idr) OVER w) IS DISTINCT FROM (lsb, pps, idr) THEN 1 ELSE 0 END AS new FROM slices WINDOW w AS (PARTITION BY stream_id ORDER BY n))
SELECT stream_id, n, (sum(new) OVER (PARTITION BY stream_id ORDER BY n) - 1)::BIGINT AS au_no FROM c"""

QUERIES["sliding_window_marking"] = lambda spark, d: pictures.sliding_window(view(spark, d, "slices"), 4).select("stream_id", "n", F.array_join("held", ",").alias("held"))
ORACLE_SQL["sliding_window_marking"] = f"""WITH {sql('slices')}, r AS (SELECT *, sum(idr::INT) OVER (PARTITION BY stream_id ORDER BY n) AS run FROM slices),
h AS (SELECT *, list(n) FILTER (WHERE is_reference) OVER (PARTITION BY stream_id, run ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS held FROM r)
SELECT stream_id, n, CASE WHEN idr OR held IS NULL THEN '' ELSE array_to_string(held[greatest(len(held) - 3, 1):], ',') END AS held FROM h"""


def ref_lists(spark, d):
    """Reference sets of each picture by its deltas, and the first lists made of them."""
    x = view(spark, d, "octets")
    poc = (C("w") % 1000).cast("int")
    before = F.transform(F.sequence(F.lit(1), (C("b0") % 4 + 1).cast("int")), lambda i: poc - i * 2)
    after = F.transform(F.sequence(F.lit(1), (C("b1") % 3 + 1).cast("int")), lambda i: poc + i)
    kind = F.get(F.array(F.lit("B"), F.lit("P"), F.lit("I")), (C("b2") % 3).cast("int"))
    sets = x.select("object_id", "k", "b0", "b1", poc.alias("poc"), before.alias("before"), after.alias("after"), kind.alias("slice_type"))
    l0, l1 = bitstream.reference_lists(C("before"), C("after"), C("slice_type"), (C("b0") % 8).cast("int"), (C("b1") % 20).cast("int"))
    lists = sets.select("object_id", "k", "poc", "slice_type", l0.alias("l0"), l1.alias("l1"))
    later = lambda p: F.coalesce(F.array_max(p) > C("poc"), F.lit(False))
    return lists.select("object_id", "k", "slice_type", F.array_join("l0", ",").alias("l0"), F.array_join("l1", ",").alias("l1"), (~(later(C("l0")) | later(C("l1")))).alias("no_backward"))


QUERIES["ref_lists"] = ref_lists
ORACLE_SQL["ref_lists"] = f"""WITH {sql('octets')}, x AS (SELECT *, w % 1000 AS poc, (['B', 'P', 'I'])[b2 % 3 + 1] AS t FROM octets),
s AS (SELECT *, list_transform(generate_series(1, b0 % 4 + 1), lambda i: poc - i * 2) AS bef, list_transform(generate_series(1, b1 % 3 + 1), lambda i: poc + i) AS aft FROM x),
l AS (SELECT *, CASE WHEN t = 'I' THEN [] ELSE list_transform(range(least(b0 % 8, 16)), lambda i: (bef || aft)[i % len(bef || aft) + 1]) END AS l0, CASE WHEN t <> 'B' THEN [] ELSE list_transform(range(least(b1 % 20, 16)), lambda i: (aft || bef)[i % len(bef || aft) + 1]) END AS l1 FROM s)
SELECT object_id, k, t AS slice_type, array_to_string(l0, ',') AS l0, array_to_string(l1, ',') AS l1, len(list_filter(l0 || l1, lambda p: p > poc)) = 0 AS no_backward FROM l"""


def cabac_contexts(spark, d):
    x = view(spark, d, "octets").select("object_id", "k", bitstream.cabac_context(C("b1"), C("b2") % 60 - 4).alias("c"))
    return x.select("object_id", "k", C("c.state"), C("c.mps"))


QUERIES["cabac_contexts"] = cabac_contexts
ORACLE_SQL["cabac_contexts"] = f"""WITH {sql('octets')}, x AS (SELECT *, greatest(least((((b1 >> 4) * 5 - 45) * greatest(least(b2 % 60 - 4, 51), 0) >> 4) + (b1 & 15) * 8 - 16, 126), 1) AS p FROM octets)
SELECT object_id, k, (CASE WHEN p > 63 THEN p - 64 ELSE 63 - p END)::INT AS state, (p > 63)::INT AS mps FROM x"""


def working_buffers(spark, d):
    """First buffer sizes of pictures, the size after an overflow, and the block address word."""
    x = view(spark, d, "octets").select("object_id", "k", (C("w") + 1).alias("width"), (C("b1") * 16 + 8).alias("height"), "b0", "b2")
    pu = bitstream.buffer_size(F.floor(C("width") * C("height") / 4))
    return x.select("object_id", "k", pu.alias("pu"), bitstream.buffer_size(C("width") * C("height")).alias("coeff"), bitstream.buffer_size(pu + 1).alias("grown"), (C("b0") + C("b2") * 65536).alias("ctb_addr"))


QUERIES["working_buffers"] = working_buffers
_S = "(3 * (1::BIGINT << greatest(length(bin(({})::BIGINT)) - 1, 8)))"
ORACLE_SQL["working_buffers"] = f"""WITH {sql('octets')}, x AS (SELECT *, w + 1 AS width, b1 * 16 + 8 AS height FROM octets)
SELECT object_id, k, {_S.format('width * height // 4')} AS pu, {_S.format('width * height')} AS coeff, {_S.format(_S.format('width * height // 4') + ' + 1')} AS grown, b0 + b2 * 65536 AS ctb_addr FROM x"""
